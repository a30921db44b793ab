"""Secret scan with multipart credential linking, in SQL functions only.

Base findings are three kinds of strings (``assign``, ``access``, ``hex``).
Weaker parts mean nothing alone: short access identifiers, long mixed tokens
and endpoints. They are *linked*: parts become rows (document, kind, start,
end), and an interval join within a scope of ``reach`` code points keeps a
weak part only where a complementary part lies at most that far before or
behind it, counted between the nearer end and start (an identifier or an
endpoint wants a secret; a token wants an identifier).

The interval join runs on bins of ``reach`` code points. For each document,
role and bin the first and last end (of parts that lie before) and the first
and last start (of parts behind) are aggregated, with map-side combine. What
lies before a part ends in the bin of its start or the one before; what lies
behind starts in the bin of its end or the next; the first and last of these
decide exactly, however long the parts are. So no pairs are made, however many
parts a document has.

A string is no complement of itself: a token that overlaps a named value or an
access key, and a weak part inside a base finding, are that other part and
link nothing (an identifier whose value is a long token stands alone).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .found import matches, pieces

REACH = 200

#: kind -> (pattern, least code points, group whose length counts, literals of
#: which a text with a match holds one). The first three are the base kinds and
#: fixed; their order breaks ties of start. Runs of one character class are
#: matched whole, so their least length can stand in the pattern.
BASE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
               r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               6, 1, (":", "=")),
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0, ("AKIA",)),
    "hex": (r"[0-9a-f]{24,}", 24, 0, ()),
}
WEAK = {
    # identifiers of a client or account, by name
    "ident": (r"(?i:(?:client|account|access_?key|user)_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]+)", 3, 1,
              (":", "=")),
    # a long run of token characters that holds a digit and a letter
    "blob": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 20, 0, ()),
    "endpoint": (r"(?<![a-z])(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D\"'<>]+",
                 8, 0, ("://",)),
}
KINDS = {**BASE, **WEAK}
#: role of each kind, and the roles a weak kind needs near it
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "ident": "id", "blob": "token", "endpoint": "place"}
NEEDS = {"ident": ("secret", "token"), "blob": ("id",), "endpoint": ("secret",)}


def _parts(text: Column) -> Column:
    """array<struct<kind, m, gap, size, part>> of all matches, long enough or not.

    ``gap``: code points between the match before and this one."""
    out = []
    for i, (pattern, least, group, literals) in enumerate(KINDS.values()):
        whole = matches(text, pattern)
        sized = matches(text, pattern, group) if group else whole
        there = text.rlike(pattern)
        if literals:
            there = reduce(or_, [text.contains(x) for x in literals]) & there
        out.append(F.when(there, F.transform(
            F.arrays_zip(F.slice(F.transform(pieces(text, pattern), F.length), 1, F.size(whole)).alias("gap"),
                         F.transform(whole, F.length).alias("size"),
                         F.transform(sized, lambda s: F.length(s) >= least).alias("ok")),
            lambda z, j: F.struct(F.lit(i).alias("kind"), j.alias("m"), z["gap"].alias("gap"),
                                  z["size"].alias("size"), z["ok"].alias("ok")))))
    empty = F.array().cast("array<struct<kind:int,m:int,gap:int,size:int,ok:boolean>>")
    return F.concat(*[F.coalesce(x, empty) for x in out])


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end) of every part long enough, weak ones too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "th", F.inline(_parts(F.col("text")))).distinct()
    before = Window.partitionBy("doc_id", "th", "kind").orderBy("m")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    return (rows.withColumn("end", end).filter("ok")
            .select("doc_id", "th", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def _own(every: DataFrame) -> DataFrame:
    """Parts without the weak ones that are part of another string's finding."""
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    by = Window.partitionBy("doc_id", "th").orderBy("start")
    till, since = (by.rangeBetween(Window.unboundedPreceding, Window.currentRow),
                   by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    named = kind.isin("assign", "access", "ident")
    # the nearest of the others on both sides decide, as all before end before the largest end
    last = F.max(F.when(named, end)).over(till)
    following = F.min(F.when(named, start)).over(since)
    around = F.max(F.when(kind.isin(*BASE), end)).over(till)
    rows = every.withColumns({"__last": last, "__next": following, "__around": around})
    touched = F.coalesce(F.col("__last") > start, F.lit(False)) | F.coalesce(F.col("__next") < end, F.lit(False))
    inside = F.coalesce(F.col("__around") >= end, F.lit(False))
    drop = ((kind == "blob") & touched) | (~kind.isin(*BASE) & inside)
    return rows.filter(~drop).select(every.columns)


def findings(docs: DataFrame, reach: int = REACH, gaps: bool = False) -> DataFrame:
    """(doc_id, th, kind, start, end): base findings, and weak ones with a complement in reach.

    ``gaps``: the reach counts from the end of the earlier part to the start
    of the later one, as ``scan`` and ``masked`` have it; else from start to start.
    ``th`` tells rows of one doc_id with different texts apart; repeated
    rows give one set of findings."""
    names = F.array(*[F.lit(k) for k in KINDS])
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    every = C.stored(_own(parts(docs).withColumn("kind", names[F.col("kind")])))
    base = every.filter(F.col("kind").isin(*BASE))
    behind = F.col("end" if gaps else "start")

    def sides(before: Column, after: Column) -> Column:
        return F.inline(F.array(F.struct(F.lit(True).alias("before"), before.alias("at")),
                                F.struct(F.lit(False).alias("before"), after.alias("at"))))

    bins = (every.select("doc_id", "th", role[F.col("kind")].alias("role"), sides(behind, F.col("start")))
            .groupBy("doc_id", "th", "role", "before", F.floor(F.col("at") / reach).alias("bin"))
            .agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
    # each bin is offered to itself and, of what lies before, the next one, else the one before
    near = bins.withColumn("step", F.explode(F.array(F.lit(0), F.when(F.col("before"), 1).otherwise(-1)))).select(
        F.col("doc_id").alias("d2"), F.col("th").alias("t2"), (F.col("bin") + F.col("step")).alias("b2"),
        F.col("role").alias("need"), F.col("before").alias("side"), "step", "lo", "hi")
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    weak = (every.filter(~F.col("kind").isin(*BASE)).select("*", sides(F.col("start"), behind))
            .select("*", F.floor(F.col("at") / reach).alias("bin"), F.explode(needs[F.col("kind")]).alias("want")))
    hit = (F.when(F.col("step") == 1, F.col("at") - F.col("hi") <= reach)
           .when(F.col("step") == -1, F.col("lo") - F.col("at") <= reach)
           .when(F.col("before"), F.col("lo") <= F.col("at")).otherwise(F.col("hi") >= F.col("at")))
    linked = weak.join(near.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))
                       & (F.col("bin") == F.col("b2")) & (F.col("want") == F.col("need"))
                       & (F.col("before") == F.col("side")) & hit, "left_semi")
    return base.unionAll(linked.select("doc_id", "th", "kind", "start", "end").distinct())


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), one row per row of ``docs``.

    Null and empty texts: no findings (sha256 of the empty text, spans ''). Null doc_ids are kept.
    Extra columns are ignored; repeated rows each get their findings."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    one = F.struct("start", order[F.col("kind")].alias("o"), "end", "kind")
    per = (findings(docs, reach, gaps=True).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(one)).alias("f")))
    per = per.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "f")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"))
    rows = keyed.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    f = F.coalesce("f", F.array().cast("array<struct<start:bigint,o:int,end:bigint,kind:string>>"))
    say = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(f, lambda x: x["o"] < len(BASE))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, say), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(f, say), ",").alias("spans"),
        (F.size(f) - F.size(base)).cast("long").alias("n_linked"))


def masked(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` (same columns and rows) with every finding of its text cut out
    and replaced by ``[secret]``; overlapping findings are cut as one. ``n_chars``,
    if there, follows the new text. Rows without a finding are unchanged."""
    one = F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))
    per = (findings(docs, reach, gaps=True).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(one)).alias("cuts"))
           .select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "cuts"))
    rows = C.row_of(docs, F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"), F.col("text").alias("text"))
    rows = rows.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    cut = F.expr("""
      aggregate(cuts, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> CASE WHEN x.e <= a.at THEN a ELSE named_struct('at', x.e, 'out',
          CASE WHEN x.s < a.at THEN a.out
               ELSE concat(a.out, array(substring(text, a.at + 1, x.s - a.at), '[secret]')) END) END,
        a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))""")
    found = F.col("cuts").isNotNull()
    rows = rows.select("row", found.alias("found"), F.when(found, cut).otherwise(F.col("text")).alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("found"), F.length("cut").cast("long")).otherwise(
        F.col("row")["n_chars"] if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
