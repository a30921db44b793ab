"""Connected components of a link table by alternating large-star and
small-star steps; every step is a partial aggregate and an equi-join, and the
links of each step are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): for every id that occurs in a link with another id, the
    smallest id of its component."""
    edges = C.stored(links.filter(F.col(a) != F.col(b))
                     .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _flat(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = C.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = C.stored(both.join(low.hint("merge"), "u").filter("v > u AND v <> m")
                         .selectExpr("v AS u", "m AS v").distinct())
        low = C.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("merge"), "u").filter("v <> m").selectExpr("v AS u", "m AS v")
        edges = C.stored(small.unionAll(low.selectExpr("u", "m AS v")).distinct())
    return edges.selectExpr("u AS id", "v AS comp").unionAll(edges.selectExpr("v AS id", "v AS comp").distinct())


def _flat(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(edges.selectExpr("v AS x", "0 AS up"))
    return (ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("down"))
            .filter("ups > 1 OR (ups = 1 AND down = 0)").isEmpty())
