"""One registered query per operator, over its whole table with production
parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontaminate, minhash_dedup, mixing, periodic_runs, pseudonyms, quality, secrets,
               simhash_dedup, substring_dedup, token_counts, toxicity, vector_search)
from .common import table

#: Key of the pseudonyms; a deployment passes its own.
DEMO_KEY = "shelfcast-demo-key"
TOKENIZER = "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data: counts by kind and the new text."""
    n = [f"n_{k}" for k in pseudonyms.KINDS]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, DEMO_KEY)
    return out.filter(" + ".join(n) + " > 0").select("doc_id", *n, F.col("new_text").alias("text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return quality.scores(table(spark, sf_dir, "documents"), labels)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and the benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return toxicity.scores(table(spark, sf_dir, "documents"), labels)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs; every tenth document has a period put in first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted().alias("text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(
        x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(
        x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), 1)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"),
                         F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(
                             ",", *(r[c].cast("string") for c in ("start", "length")), F.concat(r["period"].cast("string"), F.lit("\n")))))
                         .alias("lines"), "collapsed")
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                        F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"),
                        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_pseudonyms, op3_quality_classifier, op4_mix_sources, op5_substring_dedup, op6_minhash_dedup,
    op7_decontaminate, op8_toxicity, op9_token_counts, op10_vector_search, op11_simhash_dedup, op12_collocations,
    op13_periodic_runs)}

_OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) AS t(p)),
twice AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM g JOIN twice USING (k), range(35) AS r(o)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s
         FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w)
         ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(p)
      WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id
         JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN reach AS r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12 = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM p, range(1, 4) AS s(k), unnest(range(1, len(ws) - k + 2)) AS r(i) GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
part AS (SELECT lang, phrase, a, k, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest
         FROM cand, range(1, 3) AS s(j) WHERE j < k),
often AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= 10),
cut AS (SELECT c.*, x.a AS l, y.a AS r,
               CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
        FROM part AS c JOIN often AS x ON x.lang = c.lang AND x.phrase = c.first
        JOIN often AS y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM cand, range(1, 3) AS s(i)
           WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best AS b LEFT JOIN longer AS g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2
         WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

# the checksum's table of 256 values by its rule, then one step per digit of doc_id
_OP13 = r"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)))
               AS digits FROM documents),
h AS (SELECT doc_id, id, ws, len(ws) AS n,
             xor(list_reduce(digits, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, t),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS s FROM h),
w AS (SELECT doc_id, id, n, i, CASE WHEN i < a OR a IS NULL THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // s) + 1] END AS x
      FROM g, unnest(range(n)) AS r(i)),
same AS (SELECT u.id, u.i, v.i - u.i AS q FROM w AS u JOIN w AS v ON u.id = v.id AND u.x = v.x AND u.i < v.i
         AND 2 * (v.i - u.i) <= u.n),
stretch AS (SELECT id, q, min(i) AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS part FROM same) GROUP BY id, q, part),
run AS (SELECT id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY id, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS s
          FROM run GROUP BY id),
gone AS (SELECT DISTINCT id, i FROM (SELECT id, unnest(range(start + period, start + length)) AS i FROM run)),
kept AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS s FROM w ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (id) LEFT JOIN lines USING (id) LEFT JOIN kept USING (id)
"""

ORACLES = {"op5_substring_dedup": _OP5, "op6_minhash_dedup": _OP6, "op12_collocations": _OP12, "op13_periodic_runs": _OP13}
