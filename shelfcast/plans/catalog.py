"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` over
the driver's tables, paired with equivalent DuckDB SQL (or ``None`` when the
job is not SQL-expressible and only a rows check applies)."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}

FAMILIES = [
    "shelfcast.plans.q_sales",
    "shelfcast.plans.q_demand",
    "shelfcast.plans.q_forecast",
    "shelfcast.plans.q_inventory",
    "shelfcast.plans.q_recommend",
    "shelfcast.plans.q_scoring",
    "shelfcast.plans.q_funnel",
    "shelfcast.plans.q_prep",
    "shelfcast.plans.q_stream",
    "shelfcast.plans.q_select",
    "shelfcast.plans.q_names",
    "shelfcast.plans.q_io",
    "shelfcast.plans.q_store",
]


def register(key: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, note)
        return fn
    return deco


def load() -> dict[str, Query]:
    for mod in FAMILIES:
        importlib.import_module(mod)
    return REGISTRY


# ---- SQL text helpers shared by the oracle queries -------------------------
def sql_years(first: int, last: int, col: str = "sale_year") -> str:
    return f"{col} BETWEEN {int(first)} AND {int(last)}"


def sql_round_int(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


# Exact money sum in cents, mirroring shelfcast.functions.numeric.money_sum.
def sql_cents(expr: str) -> str:
    return f"CAST(round(coalesce({expr}, 0) * 100) AS BIGINT)"


MS = "CAST(sum(CAST(round(coalesce(total_sales, 0) * 100) AS BIGINT)) AS BIGINT)"


def sql_cents_to_int(expr: str) -> str:
    return f"CAST(round_even(({expr}) / 100.0, 0) AS BIGINT)"


def sql_cents_to_money(expr: str, scale: int = 2) -> str:
    return f"round_even(({expr}) / 100.0, {scale})"


def sql_norm_text(x: str) -> str:
    """DuckDB text of shelfcast.functions.text.norm_text."""
    t = f"trim(regexp_replace(trim(CAST({x} AS VARCHAR)), '^''(.*)''$|^\"(.*)\"$', '\\1\\2'))"
    return f"(CASE WHEN {x} IS NULL OR {t} IN ('None', 'nan', 'NaN') THEN '' ELSE {t} END)"


def sql_ols(x: str, y: str, target) -> str:
    """DuckDB text of shelfcast.operators.forecast.ols_predict."""
    return (f"(CASE WHEN count({y}) = 0 THEN 0.0 WHEN regr_slope({y}, {x}) IS NULL THEN avg({y}) "
            f"ELSE regr_slope({y}, {x}) * {float(target)} + regr_intercept({y}, {x}) END)")


def sql_forecast_ctes(years, target) -> str:
    """``py`` (quantity per base year) and ``fc`` (one row: total_quantity,
    predicted_quantity) as CTE text, for queries that need the forecast."""
    y = sql_years(*years)
    return f"""py AS (SELECT sale_year, CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS q FROM sales WHERE {y} GROUP BY sale_year),
fc AS (SELECT CAST(coalesce(sum(q), 0) AS BIGINT) AS total_quantity,
              greatest(0, CAST(round_even({sql_ols('sale_year', 'q', target)}, 0) AS BIGINT)) AS predicted_quantity,
              'linear_trend' AS method FROM py)"""
