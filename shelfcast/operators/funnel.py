"""Funnel, feedback and opportunity cost (U1-U4) on event / inventory data.

The reference holds these as constants; here they are computed from the
event log (unique users per stage) and from the inventory snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
# event type -> (stage order, reference stage name, recommendation weight)
STAGES = [("view", 1, "Main_Exposure", 1.2), ("click", 2, "Product_Click", 1.0),
          ("signup", 3, "Add_to_Cart", 1.5), ("purchase", 4, "Purchase", 1.0)]
DROP_OFF_PCT = 40.0
DEFAULT_STAGE_WEIGHT = 1.0
CLICK_EVENT, VIEW_EVENT = "click", "view"
NEW_DAYS = 30.0
COST_OF_CAPITAL = 0.08
# ---------------------------------------------------------------------------


def _stage_map():
    items = []
    for e, o, n, w in STAGES:
        items += [F.lit(e), F.struct(F.lit(o).alias("o"), F.lit(n).alias("n"), F.lit(w).alias("w"))]
    return F.create_map(*items)


def journey_funnel(events: DataFrame, by_day: bool = True) -> DataFrame:
    """Unique users per stage (per day), step conversion % against the
    previous stage (first = 100), overall conversion last/first, and the
    drop-off flag (< 40 %)."""
    e = events.filter(F.col("event_type").isin(*[s[0] for s in STAGES]))
    e = e.select(F.to_date("ts").alias("day") if by_day else F.lit(None).cast("date").alias("day"), "event_type", "user_id")
    return funnel_rates(e.groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("user_count")))


def funnel_rates(counts: DataFrame) -> DataFrame:
    """Rates of U1 from (day, event_type, user_count)."""
    m = F.element_at(_stage_map(), F.col("event_type"))
    g = counts.select("day", m.alias("st"), "user_count").select(
        "day", F.col("st.o").alias("stage_order"), F.col("st.n").alias("stage"), "user_count")
    w = Window.partitionBy("day").orderBy("stage_order")
    prev = F.lag("user_count").over(w)
    conv = F.when(prev.isNull(), F.lit(100.0)).otherwise(F.col("user_count") / prev * 100.0)
    wd = Window.partitionBy("day")
    first = F.min_by("user_count", "stage_order").over(wd)
    last = F.max_by("user_count", "stage_order").over(wd)
    out = g.withColumn("conv", conv)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage_order", "stage", "user_count", F.bround("conv", 2).alias("conversion_rate"),
                      (F.col("conv") < DROP_OFF_PCT).alias("drop_off"),
                      F.bround(last / first * 100.0, 2).alias("overall_cvr"))


def stage_weight(df: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Stage -> recommendation weight (1.0 for unknown stages)."""
    items = []
    for _, _, n, w in STAGES:
        items += [F.lit(n), F.lit(w)]
    return df.withColumn("recommendation_weight",
                         F.coalesce(F.element_at(F.create_map(*items), F.col(stage_col)), F.lit(DEFAULT_STAGE_WEIGHT)))


def feedback_from_events(events: DataFrame) -> DataFrame:
    """Feedback records from the event log: product id = props.k,
    feedback value 1 for a click, 0 for a view."""
    e = events.filter(F.col("event_type").isin(CLICK_EVENT, VIEW_EVENT))
    return e.select("ts", "user_id", F.get_json_object("props", "$.k").alias("product_id"),
                    F.when(F.col("event_type") == CLICK_EVENT, 1).otherwise(0).alias("value"))


def feedback_clicks(feedback: DataFrame) -> DataFrame:
    """Impressions, clicks and click rate (%) per product."""
    g = feedback.groupBy("product_id").agg(F.count(F.lit(1)).alias("impressions"), F.sum("value").cast("long").alias("clicks"))
    return g.withColumn("click_rate", F.bround(F.col("clicks") / F.col("impressions") * 100.0, 2))


def opportunity_cost(values: DataFrame, value_col: str, days_col: str, new_days: float = NEW_DAYS,
                     rate: float = COST_OF_CAPITAL) -> DataFrame:
    """U4: cost = value x days / 365 x rate, before (``days_col``) and after
    (``new_days``), and the annual saving; zero when days <= 0."""
    v = F.col(value_col).cast("double")
    d = F.col(days_col).cast("double")
    before = v * (d / 365.0) * rate
    after = v * (F.lit(float(new_days)) / 365.0) * rate
    ok = (d > 0) & (v >= 0)
    return values.select("*",
                         F.when(ok, F.bround(before, 2)).otherwise(0.0).alias("opportunity_cost_before"),
                         F.when(ok, F.bround(after, 2)).otherwise(0.0).alias("opportunity_cost_after"),
                         F.when(ok, F.bround(F.greatest(before - after, F.lit(0.0)), 2)).otherwise(0.0)
                          .alias("opportunity_cost_saved_annual"))
