"""Periodic runs, SimHash groups and phrase collocations against brute force, and
on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import collocations, periodic_runs, queries, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CLASH = ["fp", "low", "comp", "prefix", "runs", "collapsed", "n", "k", "phrase", "whole", "part", "bucket", "blob", "a", "id"]


def with_clashes(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH})


def odd_texts():
    rnd = random.Random(8)
    line = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(90))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "few words"), (5, "Few  WORDS"), (6, line), (7, line + " end"), (8, line),
            (9, "again " * 5000), (10, "x" * 40000), (11, "to be or not. " * 60), (None, "no id here. no id here"), (None, line),
            (12, "é ü 日本 " * 30), (13, "same row"), (13, "same row"), (13, line.upper()), (14, "a b. a b, a\nb a"),
            (15, " ".join(str(i % 50) for i in range(20000)))]


def odd(spark):
    return with_clashes(spark.createDataFrame(
        [(i, t, None if i in (4, 11) else "en", "s") for i, t in odd_texts()],
        "doc_id long, text string, lang string, source string")).repartition(3)


# ------------------------------------------------------------ periodic runs

def brute_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def by_start_then_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def periodic_texts():
    rnd = random.Random(6)
    yield []
    yield ["one"] * 700
    yield fibonacci(600)
    yield ["ab"[bin(i).count("1") & 1] for i in range(512)]
    for p in (11, 31, 32, 33, 64, 100, 255):
        unit = [str(rnd.randrange(40)) for _ in range(p)]
        yield ["x"] * rnd.randrange(40) + unit * 3 + unit[: rnd.randrange(p)]
    for _ in range(25):  # squares of words that are periodic themselves
        base = [rnd.choice("abc") for _ in range(rnd.randrange(2, 6))]
        unit = base * rnd.randrange(4, 30) + base[: rnd.randrange(len(base))]
        yield unit + unit + [rnd.choice("abc")] + unit
    for _ in range(25):
        unit = ["a"] * rnd.randrange(1, 80) + ["b"] * rnd.randrange(1, 80)
        yield unit * rnd.randrange(1, 5) + unit[: rnd.randrange(len(unit))]
    for _ in range(25):
        out = []
        while len(out) < 400:
            out += [rnd.choice("abcd") for _ in range(rnd.randrange(1, 60))] * rnd.choice([1, 2, 2, 3, 5])
        yield out


def test_runs_equal_brute_force(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(periodic_texts())]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = 0
    for i, w in enumerate(periodic_texts()):
        want = by_start_then_period(brute_runs(w))
        assert got[i] == want, i
        long += sum(q >= periodic_runs.DIRECT for _, _, q in want)
    assert long > 200


def test_runs_at_another_length(spark):
    w = "a b a b a c c c d".split()
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), min_words=3).first()
    assert [tuple(x) for x in r.runs] == by_start_then_period(brute_runs(w, 3)) == [(0, 5, 2), (5, 3, 1)]
    assert r.collapsed == "a b c d"


def test_short_text_of_one_word_costs_no_more_pairs_than_words():
    _, number, _ = periodic_runs.numbered([b"a " * 20000])
    levels = periodic_runs.gram_levels(number)
    for j in range(2, len(levels)):
        assert len(periodic_runs.seeds(levels[j], 1 << j)[0]) <= 4 * 20000


def plant(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_period_query_on_odd_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = odd_texts() + [(i, " ".join(rnd.choice("ab") + str(rnd.randrange(90)) for _ in range(rnd.randrange(1, 300))))
                          for i in range(100, 200)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        got.append((r.doc_id or -1, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
    want = []
    for i, t in rows:
        w = plant(i, t)
        # brute force over a whole long text of one short period is done by its rule
        runs = by_start_then_period(brute_runs(w) if len(w) < 3000 else [(0, len(w), 50 if i == 15 else 1)])
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i or -1, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(i is not None and i >= 100 and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    fps = sorted(set(fps))
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                up[find(x)] = find(y)
    return find


def test_fingerprint_is_spark_xxhash(spark):
    t = "one two three four"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] & (1 << 64) - 1 == simhash_dedup.shingle_hashes(t.encode(), 4)[0]


def test_simhash_groups(spark):
    rnd = random.Random(12)
    rows = odd_texts()
    base = [rnd.choice("abc") + str(rnd.randrange(500)) for _ in range(600)]
    for i in range(200, 260):
        base = base.copy()
        base[rnd.randrange(600)] = f"new{i}"
        rows.append((i, " ".join(base)))
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    got = simhash_dedup.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    find = brute_groups(fps)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    want = [(i or -1, f, low.get(find(f), -1)) for (i, _), f in zip(rows, fps)]
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1, r.component_id or -1) for r in got) == sorted(want)
    assert len({x[2] for x in want}) < len({x[1] for x in want})
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [200, 1 << 21])
def test_ball_links_connect_what_the_radius_connects(spark, chunk):
    rnd = random.Random(chunk)
    fps = {0, 1, 15, 31, (1 << 64) - 1, 1 << 63}
    for _ in range(4):
        center = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash_dedup.ball_links(df, chunk=chunk).collect()
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        up[root(r.a & (1 << 64) - 1)] = root(r.b & (1 << 64) - 1)
    find = brute_groups(fps)
    assert {frozenset(y for y in fps if root(y) == root(x)) for x in fps} == {frozenset(y for y in fps if find(y) == find(x)) for x in fps}


def test_radius_must_be_even(spark):
    with pytest.raises(ValueError):
        simhash_dedup.ball_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


# ------------------------------------------------------------- collocations

def brute_phrases(rows, least, top=2000, m=3):
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, m + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i:i + k]] = max(most[lang, p[i:i + k]], a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * most[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                    for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    got = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        got += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(got)


def phrase_rows(seed, n=400):
    rnd = random.Random(seed)
    vocab = ["The", "of", "a", "x", "new", "york", "city", "los", "angeles", "ÉCOLE", "日本"]
    out = []
    for i in range(n):
        t = " ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rnd.randrange(40)))
        if i % 3 == 0:
            t += " in new york city we met at five o clock sharp. good morning everyone, "
        out.append((rnd.choice(["en", "de", None, "und"]), t))
    return out


def collect(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"hot": 2, "bucket_chars": 500}, {"slice_words": 50, "bucket_chars": 2000}, {"min_count": 3}])
def test_collocations(spark, kw):
    rows = phrase_rows(3)
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string")).repartition(5)
    got = collect(collocations.collocations(df, **kw))
    assert got == brute_phrases(rows, kw.get("min_count", 10))
    assert len(got) > 100


def test_collocations_of_four_words_and_few_ranks(spark):
    rows = phrase_rows(4)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collect(collocations.collocations(df, max_words=4, top=7, hot=5))
    assert got == brute_phrases(rows, 10, 7, 4)


def test_collocations_on_odd_rows(spark):
    rows = odd_texts()
    langs = [None if i in (4, 11) else "en" for i, _ in rows]
    got = collect(collocations.collocations(odd(spark), min_count=2))
    assert got == brute_phrases([(g, t) for g, (_, t) in zip(langs, rows)], 2)
    assert collocations.collocations(odd(spark).limit(0)).count() == 0


def test_unary_paths_hold_whole_phrases(spark):
    rows = [("en", "we met at five o clock sharp")] * 12 + [("en", "met at noon")] * 3
    g = collocations.graph(spark.createDataFrame(rows, "lang string, text string"))
    paths = {r.phrase: (r.n, r.edges) for r in collocations.unary_paths(g).collect()}
    assert paths == {"we met at": (12, 1), "met at five o clock sharp": (12, 4)}


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a = 3_000_000_007
    df = spark.createDataFrame([(a, a + 1, a + 5)], "a long, l long, r long")
    big = "cast({} AS decimal(15, 0))"
    got = df.selectExpr(f"cast(1000000 * {big.format('a')} * {big.format('a')} AS decimal(38, 0)) div "
                        f"({big.format('l')} * {big.format('r')}) AS s").first()[0]
    assert got == 1000000 * a * a // ((a + 1) * (a + 5))
    assert np.iinfo(np.int64).max < 1000000 * a * a
