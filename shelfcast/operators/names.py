"""Names that contain one another, for whole tables of requests.

An inverted index over trigrams: of a searched name only its rarest trigram is
looked up (names that contain it contain all of its trigrams), and ``contains`` is
checked on what meets there. Searched names of one or two characters are looked
up as they are. So no request is compared with every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.filters import store_name_forms, store_name_spellings
from shelfcast.session import cut_lineage

GRAM = 3


def _grams(text: str, size: str) -> Column:
    """Distinct pieces of ``size`` characters."""
    return F.array_distinct(F.expr(f"transform(sequence(1, greatest(length({text}) - {size} + 1, 1)), i -> substring({text}, i, {size}))"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): every pair of distinct non-empty ``needle`` and ``text`` in which the text
    contains the needle, capital letters told apart."""
    needles = needles.select("needle").filter("needle <> ''").distinct()
    texts = texts.select("text").filter("text <> ''").distinct()
    sizes = [F.transform(_grams("text", str(n)), lambda g: g) for n in range(1, GRAM + 1)]
    index = texts.select("text", F.explode(F.array_distinct(F.concat(*sizes))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    asked = needles.select("needle", F.explode(_grams("needle", f"least({GRAM}, length(needle))")).alias("gram"))
    # a gram that no name has rules its needle out; else the rarest one is looked up
    asked = asked.join(often, "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g"))
    asked = asked.filter("g.c > 0").select("needle", F.col("g.gram").alias("gram"))
    return asked.join(index, "gram").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")


def store_name_matches(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """P3 for many names: (request, store_name), every pair that
    :func:`shelfcast.operators.filters.store_name_match` accepts."""
    asked = requests.select("request").distinct()
    asked = asked.select("request", F.explode(store_name_spellings(F.col("request"))).alias("needle"))
    names = stores.select("store_name").filter(F.trim("store_name") != "").distinct()
    names = names.select("store_name", F.explode(F.array_distinct(store_name_forms(F.col("store_name")))).alias("text"))
    equal = (asked.withColumn("key", F.lower("needle")).join(names.withColumn("key", F.lower("text")), "key")
             .select("request", "store_name"))
    part = containing(asked, names).join(asked, "needle").join(names, "text").select("request", "store_name")
    return equal.union(part).distinct()


def stock_signals(stock: DataFrame, requests: DataFrame) -> DataFrame:
    """J8 + I21 for a table of requests (request_id, product_name, store_name): what
    :func:`shelfcast.operators.inventory.tolerant_stock_signal` answers to each, with
    ``request_id``; no row where no product name matches.

    Only the first row of each product name, and of each product and store
    name, can answer; they meet the requests by the pairs of matching names."""
    order = [F.desc("frozen_money"), "store_name", "product_id"]
    cols = [c for c in stock.columns]
    rows = stock.select(F.struct(*cols).alias("row"), F.coalesce("product_name", F.lit("")).alias("name"),
                        F.coalesce("store_name", F.lit("")).alias("store"), *(F.col(c) for c in ("frozen_money", "store_name", "product_id")))
    first = lambda d, *by: d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
    # written once, as six steps below read them; a name's first row is the first of its stores' first rows
    of_both = cut_lineage(first(rows, "name", "store"))
    of_name = cut_lineage(first(of_both, "name"))
    asked = (requests.select("request_id", F.trim(F.coalesce("product_name", F.lit(""))).alias("p"), F.coalesce("store_name", F.lit("")).alias("s"))
             .filter("p <> ''"))
    names, wanted = of_name.select("name").distinct(), asked.select("p").distinct()
    near = (containing(wanted.select(F.col("p").alias("needle")), names.select(F.col("name").alias("text")))
            .select(F.col("needle").alias("p"), F.col("text").alias("name")))
    far = (containing(names.select(F.col("name").alias("needle")), wanted.select(F.col("p").alias("text")))
           .select(F.col("text").alias("p"), F.col("needle").alias("name")))
    # a row without a product name is contained in every request
    blank = wanted.withColumn("name", F.lit("")).join(names, "name", "left_semi").select("p", "name")
    pairs = asked.join(near.union(far).union(blank).distinct(), "p")
    stores = of_both.select("store").distinct()
    at = containing(asked.select(F.col("s").alias("needle")), stores.select(F.col("store").alias("text"))).select(
        F.col("needle").alias("s"), F.col("text").alias("store"))
    at = at.union(asked.filter("s <> ''").select("s").distinct().withColumn("store", F.lit("")))
    here = pairs.join(at, "s").join(of_both, ["name", "store"]).withColumn("_pref", F.lit(0))
    any_store = pairs.join(of_name.drop("store"), "name").withColumn("_pref", F.when(F.col("s") == "", 0).otherwise(1))
    both = here.select("request_id", "_pref", "row", "frozen_money", "store_name", "product_id").unionByName(
        any_store.select("request_id", "_pref", "row", "frozen_money", "store_name", "product_id"))
    best = Window.partitionBy("request_id").orderBy("_pref", *order)
    out = both.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("request_id", "row.*")
    signal = F.when(F.col("safety_stock") <= 0, "green").when(F.col("inventory") < F.col("safety_stock"), "red").otherwise("green")
    return out.withColumn("signal", signal)
