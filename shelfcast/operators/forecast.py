"""Trend forecasts D1-D4 (yearly) and D5-D12 (daily / quarterly).

All fits are grouped aggregates (``regr_slope``/``regr_intercept``) so one
job fits every group; a single global fit is a one-row aggregate used as a
scalar subquery, never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.numeric import cents, cents_to_int, round_decimal, round_int
from shelfcast.operators.filters import base_years
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR

METHOD_LINEAR = "linear_trend"
#: A forecast model of the user's: (xs, ys, target) -> value.
Model = Callable[["numpy.ndarray", "numpy.ndarray", float], float]  # noqa: F821


def ols_predict(x: str, y: str, target) -> Column:
    """D1 as an aggregate expression: OLS of y on x evaluated at ``target``;
    one point -> its value; zero variance in x -> mean; no points -> 0."""
    t = target if isinstance(target, Column) else F.lit(float(target))
    slope = F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))
    icept = F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double"))
    return (F.when(F.count(F.col(y)) == 0, F.lit(0.0))
             .when(slope.isNull(), F.avg(F.col(y).cast("double")))
             .otherwise(slope * t + icept))


def linear_trend(df: DataFrame, keys: list[str], x: str, y: str, target) -> DataFrame:
    """D1 grouped: ``max(0, round(prediction))`` for every group at once."""
    return df.groupBy(*keys).agg(F.greatest(F.lit(0), round_int(ols_predict(x, y, target))).alias("predicted"))


def yearly_quantity(sales: DataFrame, years=BASE_YEARS) -> DataFrame:
    """Quantity per base year plus the all-years total (year NULL)."""
    s = base_years(sales, years)
    return (s.rollup(F.col("sale_year").alias("year"))
             .agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity")))


def series_forecast(df: DataFrame, keys: list[str], x: str, y: str, target: float, model: Model | None = None) -> DataFrame:
    """D1 or a model of the user's, for every series at once: (keys, predicted, method),
    ``predicted`` a whole number of at least 0.

    ``model(xs, ys, target)`` gets one series' points in order of ``x`` (points without a
    value left out) and gives its value at ``target``; it runs in the tasks, a series in one
    of them. A model that raises or gives no finite number falls back on D1 for that
    series (its method says so)."""
    if model is None:
        return linear_trend(df, keys, x, y, target).withColumn("method", F.lit(METHOD_LINEAR))
    name = getattr(model, "__name__", type(model).__name__)

    def one(xs, ys):
        import numpy as np
        try:
            value, how = float(model(xs, ys, float(target))), name
        except Exception:  # noqa: BLE001  a user's model may fail on a series
            value, how = float("nan"), METHOD_LINEAR
        if not np.isfinite(value):
            how = METHOD_LINEAR
            line = np.ptp(xs) > 0 if len(xs) else False
            value = float(np.polyval(np.polyfit(xs, ys, 1), target)) if line else float(ys.mean()) if len(ys) else 0.0
        return max(0, round(value)), how

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            series = b.column("_s")
            ends = np.cumsum(series.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            # copies that a model may change
            x, y = (np.array(c.to_numpy(zero_copy_only=False), float) for c in series.flatten().flatten())
            got = [one(x[a:z], y[a:z]) for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())],
                [*keys, "predicted", "method"])

    # a series is one row: a batch of them goes to Python, not a frame each
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    some = F.when(~(F.isnull("_x") | F.isnull("_y") | F.isnan("_x") | F.isnan("_y")), F.struct("_x", "_y"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(some)).alias("_s"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["predicted long", "method string"])
    return rows.mapInArrow(run, schema)


def forecast_scalar(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, model: Model | None = None) -> DataFrame:
    """One row: base-year total quantity and the target-year forecast
    (linear trend over the yearly totals, or ``model``, see :func:`series_forecast`)."""
    s = base_years(sales, years)
    per_year = s.groupBy("sale_year").agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("q"))
    if model is not None:
        fc = series_forecast(per_year.withColumn("_all", F.lit(0)), ["_all"], "sale_year", "q", target, model)
        total = per_year.agg(F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("total_quantity"))
        pick = lambda c: fc.select(c).scalar()
        return total.select("total_quantity", F.coalesce(pick("predicted"), F.lit(0)).cast("long").alias("predicted_quantity"),
                            F.coalesce(pick("method"), F.lit(METHOD_LINEAR)).alias("method"))
    return per_year.agg(
        F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("total_quantity"),
        F.greatest(F.lit(0), round_int(ols_predict("sale_year", "q", target))).alias("predicted_quantity"),
        F.lit(METHOD_LINEAR).alias("method"))


def predicted_quantity(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, model: Model | None = None) -> Column:
    """The global forecast as a scalar-subquery column."""
    return forecast_scalar(sales, years, target, model).select("predicted_quantity").scalar()


def quantity_forecast(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, model: Model | None = None) -> DataFrame:
    """D2 (long form): ``section`` year | total | predicted | category with
    ``key`` and ``quantity``. Categories get the forecast times their share
    of base-year quantity (rounded, zero rows dropped)."""
    s = base_years(sales, years)
    q = F.coalesce("quantity", F.lit(0))
    yearly = s.groupBy("sale_year").agg(F.sum(q).cast("long").alias("quantity"))
    fc = forecast_scalar(sales, years, target, model)
    pred = fc.select("predicted_quantity").scalar()
    by_cat = s.groupBy(F.trim("category_name").alias("key")).agg(F.sum(q).cast("long").alias("cq"))
    tot_cat = s.select(F.sum(q)).scalar()
    cat_rows = (by_cat.select(F.lit("category").alias("section"), "key",
                              F.greatest(F.lit(0), round_int(pred * (F.col("cq") / tot_cat))).alias("quantity"))
                .filter((F.col("quantity") > 0) & (tot_cat > 0) & (pred > 0)))
    out = (yearly.select(F.lit("year").alias("section"), F.col("sale_year").cast("string").alias("key"), "quantity")
           .unionByName(fc.select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"),
                                  F.col("total_quantity").alias("quantity")))
           .unionByName(fc.select(F.lit("predicted").alias("section"), F.col("method").alias("key"),
                                  F.col("predicted_quantity").alias("quantity")))
           .unionByName(cat_rows))
    return out


def sales_forecast_from_qty(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR) -> DataFrame:
    """D3: money forecast = quantity forecast x (base-year sales / base-year
    quantity); falls back to a linear trend on yearly money when either
    side is zero. Yearly money is the sum of rounded store-year totals."""
    s = base_years(sales, years)
    store_year = (s.groupBy("store_id", "city", "country", "sale_year")
                   .agg(cents_to_int(F.sum(cents(F.col("total_sales")))).alias("t")))
    by_year = store_year.groupBy("sale_year").agg(F.sum("t").alias("t"))
    money = by_year.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total_sales"),
                        F.greatest(F.lit(0), round_int(ols_predict("sale_year", "t", target))).alias("lin"))
    fc = forecast_scalar(sales, years, target)
    j = money.select(
        "*", fc.select("predicted_quantity").scalar().alias("pq"), fc.select("total_quantity").scalar().alias("tq"))
    use_q = (F.col("pq") > 0) & (F.col("tq") > 0) & (F.col("total_sales") > 0)
    return j.select(
        F.when(use_q, F.greatest(F.lit(0), round_int(F.col("pq") * (F.col("total_sales") / F.col("tq")))))
         .otherwise(F.col("lin")).alias("predicted_sales"),
        F.lit(METHOD_LINEAR).alias("method"),
        F.col("total_sales"))


def endpoint_trend(df: DataFrame, keys: list[str], year: str, value: str, target: int) -> DataFrame:
    """Per group: the actual value when the target year exists, else
    last + (last - first) / (last_year - first_year) * (target - last_year);
    a single year -> its value. Floors at 0."""
    first_y = F.min(year)
    last_y = F.max(year)
    first_v = F.min_by(value, year)
    last_v = F.max_by(value, year)
    actual = F.max(F.when(F.col(year) == target, F.col(value)))
    span = (last_y - first_y).cast("double")
    proj = F.when(span > 0, last_v + (last_v - first_v) / span * (F.lit(target) - last_y)).otherwise(last_v)
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(actual.cast("double"), proj.cast("double"))).alias("forecast"))


# ---- daily forecasts (D5-D7) ------------------------------------------------
Z95 = 1.96
MEAN_BAND = 0.15


def daily_sales_dense(sales: DataFrame) -> DataFrame:
    """Per store, daily sales (exact cents) on every calendar day between
    its first and last sale, zero where nothing was sold."""
    s = sales.filter(F.col("sale_date").isNotNull())
    d = s.groupBy("store_id", "sale_date").agg(F.sum(cents(F.col("total_sales"))).alias("c"))
    # each sale day and the days without a sale up to the next one: a store's days come from its own
    # rows, so that what follows by store needs no exchange of the dense series
    after = F.lead("sale_date").over(Window.partitionBy("store_id").orderBy("sale_date"))
    d = d.withColumn("until", F.coalesce(F.date_sub(after, 1), F.col("sale_date")))
    d = d.select("*", F.explode(F.sequence("sale_date", "until")).alias("day"))
    sold = F.col("store_id").isNotNull() & (F.col("day") == F.col("sale_date"))
    return d.select("store_id", F.col("day").alias("sale_date"), (F.coalesce(F.when(sold, F.col("c")), F.lit(0)) / 100.0).alias("value"))


def store_sales_forecast(sales: DataFrame, days: int = 30) -> DataFrame:
    """For every store: D5, IQR outlier removal, OLS of value on the
    position 0..n-1 of the kept days, predictions for the next ``days``
    days after the last kept day (floored at 0) with a +-1.96 sigma band
    (sigma = population sd of residuals; of values when n <= 2; 0.1 x mean
    when not positive)."""
    from shelfcast.operators.filters import iqr_outlier
    days = max(1, min(90, int(days)))
    dense = daily_sales_dense(sales)
    ok = dense.groupBy("store_id").agg(F.count(F.lit(1)).alias("_n0")).filter("_n0 >= 2").select("store_id")
    kept = iqr_outlier(dense.join(ok, "store_id", "left_semi"), ["store_id"], "value")
    w = Window.partitionBy("store_id").orderBy("sale_date")
    kept = kept.withColumn("pos", (F.row_number().over(w) - 1).cast("double"))
    fit = kept.groupBy("store_id").agg(
        F.regr_slope("value", "pos").alias("b1"), F.regr_intercept("value", "pos").alias("b0"),
        F.count(F.lit(1)).alias("n"), F.max("sale_date").alias("last"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd_y")).filter("n >= 2")
    res = (kept.join(fit, "store_id").groupBy("store_id")
               .agg(F.stddev_pop(F.col("value") - (F.col("b1") * F.col("pos") + F.col("b0"))).alias("sd_r")))
    f = fit.join(res, "store_id")
    sd = F.when(F.col("n") > 2, F.col("sd_r")).otherwise(F.col("sd_y"))
    sd = F.when(sd.isNull() | F.isnan(sd) | (sd <= 0), F.col("mean") * 0.1).otherwise(sd)
    f = f.withColumn("sd", sd).select("store_id", "b1", "b0", "n", "last", "sd",
                                      F.explode(F.sequence(F.lit(1), F.lit(days))).alias("i"))
    val = F.greatest(F.lit(0.0), F.col("b1") * (F.col("n") + F.col("i") - 1) + F.col("b0"))
    return f.select("store_id", F.date_format(F.date_add("last", F.col("i")), "yyyy-MM-dd").alias("date"),
                    F.bround(val, 2).alias("value"),
                    F.bround(F.greatest(F.lit(0.0), val - Z95 * F.col("sd")), 2).alias("lower"),
                    F.bround(val + Z95 * F.col("sd"), 2).alias("upper"))


def mean_forecast(sales: DataFrame, days: int = 30) -> DataFrame:
    """Fallback: the mean of the daily series without its IQR outliers,
    continued from the last kept day, band +-15 %; stores with fewer than
    two (kept) days give no rows."""
    from shelfcast.operators.filters import iqr_outlier
    dense = daily_sales_dense(sales)
    several = dense.groupBy("store_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("store_id")
    kept = iqr_outlier(dense.join(several, "store_id", "left_semi"), ["store_id"], "value")
    m = kept.groupBy("store_id").agg(F.avg("value").alias("m"), F.max("sale_date").alias("last"),
                                     F.count(F.lit(1)).alias("n")).filter("n >= 2")
    f = m.select("store_id", "m", "last", F.explode(F.sequence(F.lit(1), F.lit(int(days)))).alias("i"))
    return f.select("store_id", F.date_format(F.date_add("last", F.col("i")), "yyyy-MM-dd").alias("date"),
                    F.bround("m", 2).alias("value"), F.bround(F.col("m") * (1 - MEAN_BAND), 2).alias("lower"),
                    F.bround(F.col("m") * (1 + MEAN_BAND), 2).alias("upper"))


# ---- quarterly fallback / override / merge (D10-D12) ------------------------
GROWTH_CLIP = 0.25
FALLBACK_QUARTERS = 6


def quarter_growth_fallback(quarterly: DataFrame, quarters: int = FALLBACK_QUARTERS) -> DataFrame:
    """Per product from its quarterly actuals (product_id, qi, q):
    growth = (last - previous) / previous clipped to +-25 %; forecast
    last x (1 + g)^i for the next ``quarters`` quarters; products with one
    quarter give no rows."""
    w = Window.partitionBy("product_id").orderBy("qi")
    t = quarterly.withColumn("prev", F.lag("q").over(w))
    last = t.groupBy("product_id").agg(F.max_by(F.struct("qi", "q", "prev"), "qi").alias("l"),
                                       F.count(F.lit(1)).alias("n")).filter("n >= 2")
    g = F.when(F.col("l.prev") > 0, (F.col("l.q") - F.col("l.prev")) / F.col("l.prev")).otherwise(0.0)
    g = F.least(F.greatest(g, F.lit(-GROWTH_CLIP)), F.lit(GROWTH_CLIP))
    f = last.select("product_id", F.col("l.qi").alias("qi0"), F.col("l.q").cast("double").alias("q0"), g.alias("growth"),
                    F.explode(F.sequence(F.lit(1), F.lit(quarters))).alias("i"))
    qi = F.col("qi0") + F.col("i")
    return f.select("product_id", F.format_string("%d-Q%d", F.floor(qi / 4).cast("int"), (qi % 4 + 1).cast("int")).alias("month"),
                    F.bround("growth", 4).alias("growth"),
                    round_decimal(F.col("q0") * F.pow(1 + F.col("growth"), F.col("i")), 2).alias("yhat"))


# Labels and messages of the fallback chart.
LABEL_ACTUAL, LABEL_ACTUAL_STOCK, MESSAGE_ACTUAL = "판매 실적: %s대", "당분기 재고 기준 (실적)", "과거 실적"
LABEL_FORECAST, LABEL_FORECAST_STOCK = "예측 판매량: %s대", "권장 재고: %s대 (상한선 기준)"
MESSAGE_STEADY, MESSAGE_UP, MESSAGE_DOWN = "적정 재고 유지", "수요 증가 추세 — 선제적 발주 권장", "수요 감소 추세 — 재고 과잉 주의"
BAND, STOCK_SHARE, GROWTH_TOLD = (0.85, 1.15), 1.125, 0.07


def growth_fallback_chart(sales: DataFrame, first_year: int, quarters: int = FALLBACK_QUARTERS) -> DataFrame:
    """D10 as a chart: per product of at least two sale quarters (the last not before
    ``first_year``) its past quarters from ``first_year`` and ``quarters`` forecast ones, each with
    its band, stock, labels and message. Past quarters have their stock if the sales have
    ``store_stock_quantity``; the first forecast quarter tells a growth beyond 7 %."""
    stock = F.col("store_stock_quantity") if "store_stock_quantity" in sales.columns else F.lit(None).cast("double")
    per = (sales.filter(F.col("sale_date").isNotNull())
           .groupBy("product_id", (F.year("sale_date") * 4 + F.quarter("sale_date") - 1).alias("qi"))
           .agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("double").alias("q"), F.sum(stock).cast("double").alias("stock")))
    w = Window.partitionBy("product_id").orderBy("qi")
    t = per.withColumn("prev", F.lag("q").over(w))
    last = t.groupBy("product_id").agg(F.max_by(F.struct("qi", "q", "prev"), "qi").alias("l"), F.count(F.lit(1)).alias("n"))
    last = last.filter((F.col("n") >= 2) & (F.col("l.qi") >= 4 * int(first_year)))
    label = F.format_string("%d-Q%d", F.floor(F.col("qi") / 4).cast("int"), (F.col("qi") % 4 + 1).cast("int")).alias("month")
    whole = lambda c: F.format_number(c, 0)  # noqa: E731  half-even
    q2 = F.bround("q", 2)
    past = (per.filter(F.col("qi") >= 4 * int(first_year)).join(last.select("product_id"), "product_id", "left_semi")
            .select("product_id", label, q2.alias("yhat"), q2.alias("yhat_lower"), q2.alias("yhat_upper"),
                    F.bround("stock", 2).alias("store_stock_quantity"), F.format_string(LABEL_ACTUAL, whole("q")).alias("sales_label"),
                    F.lit(LABEL_ACTUAL_STOCK).alias("stock_label"), F.lit(MESSAGE_ACTUAL).alias("message")))
    g = F.when(F.col("l.prev") > 0, (F.col("l.q") - F.col("l.prev")) / F.col("l.prev")).otherwise(0.0)
    g = F.least(F.greatest(g, F.lit(-GROWTH_CLIP)), F.lit(GROWTH_CLIP))
    f = last.select("product_id", F.col("l.qi").alias("qi0"), F.col("l.q").alias("q0"), g.alias("g"),
                    F.explode(F.sequence(F.lit(1), F.lit(quarters))).alias("i"))
    f = f.withColumn("qi", F.col("qi0") + F.col("i")).withColumn(
        "y", F.greatest(F.col("q0") * F.pow(1 + F.col("g"), F.col("i")), F.lit(0.0)))
    message = (F.when((F.col("i") == 1) & (F.col("g") > GROWTH_TOLD), MESSAGE_UP)
               .when((F.col("i") == 1) & (F.col("g") < -GROWTH_TOLD), MESSAGE_DOWN).otherwise(MESSAGE_STEADY))
    exact = lambda c, n: round_decimal(c, n)
    coming = f.select("product_id", label, exact(F.col("y"), 2).alias("yhat"), exact(F.col("y") * BAND[0], 2).alias("yhat_lower"),
                      exact(F.col("y") * BAND[1], 2).alias("yhat_upper"), exact(F.col("y") * STOCK_SHARE, 2).alias("store_stock_quantity"),
                      F.format_string(LABEL_FORECAST, whole(exact(F.col("y"), 6))).alias("sales_label"),
                      F.format_string(LABEL_FORECAST_STOCK, whole(exact(F.col("y") * BAND[1], 6))).alias("stock_label"),
                      message.alias("message"))
    return past.unionByName(coming)


def product_forecast(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, model: Model | None = None) -> DataFrame:
    """(product_id, predicted_quantity, method): the target year's quantity of each product
    from its own yearly totals, for D11; D1 or ``model``."""
    s = base_years(sales, years)
    per = s.groupBy("product_id", "sale_year").agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("q"))
    return series_forecast(per, ["product_id"], "sale_year", "q", target, model).select(
        "product_id", F.col("predicted").cast("long").alias("predicted_quantity"), "method")


def chart_override(actual: DataFrame, predicted_year: DataFrame, target: int) -> DataFrame:
    """Actual quarterly rows before the target year, and the target
    year's four quarters replaced by the product's yearly prediction / 4
    (later quarters dropped). ``actual``: (product_id, month 'YYYY-Qn', yhat);
    ``predicted_year``: (product_id, predicted_quantity)."""
    a = actual.filter(F.substring("month", 1, 4).cast("int") < target).withColumn("is_predicted", F.lit(False))
    p = predicted_year.select("product_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("qq"),
                              (F.col("predicted_quantity") / 4.0).alias("yhat"))
    p = p.select("product_id", F.format_string("%d-Q%d", F.lit(target), F.col("qq")).alias("month"),
                 F.bround("yhat", 2).alias("yhat"), F.lit(True).alias("is_predicted"))
    return a.select("product_id", "month", "yhat", "is_predicted").unionByName(p)


def actual_predicted_merge(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Full outer merge of actual and forecast series by (product, month)."""
    return actual.select("product_id", "month", F.col("yhat").alias("actual")).join(
        forecast.select("product_id", "month", F.col("yhat").alias("predicted")), ["product_id", "month"], "full")
