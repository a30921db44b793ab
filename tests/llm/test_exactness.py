"""Cases that hashes, seeds and buckets must not lose or confuse: long Thue-Morse
words, heavily edited copies, texts on one template, clashing names, repeated rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import common, decontaminate, minhash_dedup, secrets, substring_dedup


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def plain(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice("klmnop") + str(rnd.randrange(900)) for _ in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_a_polynomial_confuses_stay_apart(spark, n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    rest = plain(34, 3)
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (3, one), (4, other), (5, f"x {one} y {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.dedup_substrings(df).orderBy("doc_id").collect()] == [0] * 5
    comp = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert comp[3] == 3 and comp[4] == 4
    item = [one, *plain(3, 9)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([other, "p", "q", "r"])), (2, " ".join([one, item[1], "q", "r"]))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [2]


def test_long_spans_of_words_that_a_polynomial_confuses():
    w = np.array([5, 9], np.uint64)[[bin(i).count("1") & 1 for i in range(2048)]]
    both = np.concatenate([w, np.uint64(14) - w])
    h = [common.seq_hashes(both, np.array([0, 2048]), np.array([2048, 4096]), k) for k in (0, 1)]
    assert h[0][0] != h[0][1] and h[1][0] != h[1][1]
    again = np.concatenate([w[:100], w])
    at, end = np.array([0, 100, 3]), np.array([100, 200, 103])
    h = common.seq_hashes(again, at, end)
    assert h[0] == h[1] and h[0] != h[2]


def test_a_copy_with_every_third_word_replaced_is_found(spark):
    item = plain(60, 1)
    edited = [f"new{i}" if i % 3 == 2 else w for i, w in enumerate(item)]
    between = [x for w in item for x in (w, "and")]
    rows = [(1, " ".join(plain(40, 2) + edited + plain(20, 4))), (2, " ".join(plain(300, 5))), (3, " ".join(between)),
            (4, " ".join(item[::2])), (5, " ".join(item[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.leaks(df, bench, rare=0.0, few=0).collect()}
    code = {w: i for i, w in enumerate(item)}
    want = {}
    for i, t in rows:
        s = decontaminate.align(np.arange(60), np.array([code.get(w, -1) for w in t.split()]))[0]
        if s >= decontaminate.LEAK:
            want[i] = s
    assert got == want and set(got) == {1, 3}


def test_seeds_meet_the_bound_on_random_edits():
    """Neighbouring matches at most one error apart: as many as the docstring says."""
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(3, 30)
        item = [f"i{rnd.randrange(12)}" for _ in range(n)]
        doc = []
        for w in item:
            doc += rnd.choice([[w], [w], [w], [], ["x"], [w, "y"]])
        doc = ["z"] * rnd.randrange(5) + doc
        code = {w: k for k, w in enumerate(dict.fromkeys(item + doc))}
        score = decontaminate.align(np.array([code[w] for w in item]), np.array([code[w] for w in doc]))[0]
        if score < decontaminate.LEAK:
            continue
        keys = set(decontaminate.seeds([" ".join(doc).encode()])[2].tolist())
        _, start, key = decontaminate.seeds([" ".join(item).encode()])
        hit = {s for s, k in zip(start.tolist(), key.tolist()) if k in keys}
        assert len(hit) >= max(1, decontaminate.matches_needed(n, decontaminate.LEAK) - 1)


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    f = decontaminate.Filter(16)
    keys = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    f.add(keys)
    assert len(f.among(keys)) == len(keys)
    assert len(f.among(rng.integers(0, 2**63, 100_000, dtype=np.uint64))) < 2000


def templated(n, own=40):
    common_words = plain(150, 7)
    return [(i, " ".join(common_words + [f"own{i}x{j}" for j in range(own)])) for i in range(n)]


def test_texts_on_one_template_are_not_compared_with_each_other(spark):
    """Members of shared buckets with Jaccard about 0.6: time follows their number."""
    took = []
    for n in (1000, 4000):
        df = spark.createDataFrame(templated(n), "doc_id long, text string").repartition(4).cache()
        df.count()
        t = time.time()
        got = minhash_dedup.near_duplicates(df).agg(F.countDistinct("component_id"), F.count("kept")).first()
        took.append(time.time() - t)
        assert tuple(got) == (n, n)
    assert took[1] < 4 * took[0] + 5


def test_linked_texts_on_a_template_are_found(spark):
    rows = templated(200)
    near = [(1000 + i, t.replace(f"own{i}x39", "other")) for i, t in rows[::5]]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()
    comp = {r.doc_id: r.component_id for r in got}
    assert all(comp[1000 + i] == i for i, _ in rows[::5]) and all(comp[i] == i for i, _ in rows)


def test_helper_names_do_not_meet_the_tables(spark):
    names = ["__cuts", "__d2", "__t2", "__th", "__id", "__n", "__d", "row", "cuts", "d2", "t2", "th", "id", "n", "found", "cut", "a.b"]
    rows = [(1, "token=abcdef123 x"), (2, " ".join(plain(40, 3))), (2, " ".join(plain(40, 3))), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"is {c}") for c in names if "." not in c})
    df = df.withColumn("a.b", F.lit("is a.b"))
    bench = spark.createDataFrame([(1, " ".join(plain(40, 3)))], "item_id long, text string")
    for out, n in ((secrets.masked(df), 4), (minhash_dedup.deduplicated(df), 3), (decontaminate.clean(df, bench), 2)):
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == n and all(r[c] == f"is {c}" for r in got for c in names)


def test_the_row_kept_of_repeated_ones_is_the_same_on_every_run(spark):
    rows = [(1, "same text of one document", f"source {i}") for i in range(40)]
    kept = set()
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 40), "doc_id long, text string, source string").repartition(seed + 1)
        kept.add(tuple(minhash_dedup.deduplicated(df).collect()))
    assert len(kept) == 1 and len(next(iter(kept))) == 1
