"""Inventory snapshot (I1-I4) and the inventory views I5-I22, D8-D9.

The snapshot adds safety stock, inventory, status and frozen money to
every sale row. It is the one shared intermediate of this family: build it
once per session (``inventory_snapshot``), persist or write it, and run the
views on it. Per-product statistics are a partial+final hash aggregate
joined back on the product key: AQE broadcasts the statistics when they are
small and falls back to a skew-aware sort-merge join when they are not.

Randomness of the reference (NumPy draws that depend on row order) is
replaced by md5 hash-uniforms of the sale / product key, so every engine
and every partitioning gives the same snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.numeric import cents, hash_uniform, round_int
from shelfcast.functions.rows import first_row
from shelfcast.operators.forecast import predicted_quantity
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR

# ---- fixed values (reference rules) ---------------------------------------
OVERSTOCK_PRODUCTS = ["MacBook Pro 16-inch", "Mac Studio", "Apple Watch Ultra",
                      "iPad Pro 12.9-inch", "iMac 24-inch"]
OVERSTOCK_MULT_RANGE = (3.0, 4.5)
DANGER_SHARE = 0.03
DANGER_FACTOR_RANGE = (0.30, 0.95)
INVENTORY_JITTER = 5            # inventory = safety + qty + {0..4}
OVERSTOCK_FACTOR = 3            # Overstock when inventory > 3 x safety
CRITICAL_HEALTH = 70.0
FORECAST_QUARTERS = 6
BAND_LOW, BAND_HIGH, STOCK_FACTOR = 0.85, 1.15, 1.125
NORMAL_WORDS = ["Normal", "정상"]
# ---------------------------------------------------------------------------

SNAPSHOT_COLS = ["safety_stock", "inventory", "status", "frozen_money"]


def u(key: Column | str, salt: str) -> Column:
    return hash_uniform(key, salt)


def safety_stock(sales: DataFrame, product_col: str = "product_id", noise: bool = False) -> DataFrame:
    """Per product ceil((mean + 2 * sample sd) * noise); sd of a single
    row is 0; noise is 1 unless enabled (then 0.8 + 0.7 * u(product))."""
    q = F.coalesce(F.col("quantity"), F.lit(0)).cast("double")
    st = sales.groupBy(product_col).agg(F.avg(q).alias("_m"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("_sd"))
    nz = (F.lit(0.8) + F.lit(0.7) * u(product_col, "noise")) if noise else F.lit(1.0)
    return st.select(product_col, F.ceil((F.col("_m") + 2 * F.col("_sd")) * nz).cast("long").alias("safety_stock"))


def inventory_snapshot(sales: DataFrame, product_col: str = "product_id", noise: bool = False,
                       overstock_products: list[str] | None = None, precomputed: str = "auto",
                       finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """I1-I4 on every sale row. ``precomputed='auto'`` keeps supplied
    inventory/safety/status columns (clipped at 0, frozen money filled).
    ``finish`` gets the rows with their safety stock, before the columns that follow from
    them are made: it may move rows and add columns of the sale (``sale_id`` ...) that
    need not have moved."""
    q = F.coalesce(F.col("quantity"), F.lit(0))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    have = all(c in sales.columns for c in ("inventory", "safety_stock", "status"))
    if precomputed == "auto" and have:
        inv = F.greatest(F.coalesce(F.col("inventory").cast("long"), F.lit(0)), F.lit(0))
        out = finish(sales).withColumn("inventory", inv).withColumn(
            "safety_stock", F.greatest(F.coalesce(F.col("safety_stock").cast("long"), F.lit(0)), F.lit(0)))
        fm = F.greatest((F.col("inventory") - q) * price, F.lit(0.0))
        cur = F.col("frozen_money").cast("double") if "frozen_money" in sales.columns else F.lit(None).cast("double")
        return out.withColumn("frozen_money", F.coalesce(cur, fm))
    base = sales.drop(*[c for c in SNAPSHOT_COLS if c in sales.columns])
    s = finish(base.join(safety_stock(base, product_col, noise), product_col, "left"))
    safety = F.col("safety_stock")
    inv = safety + q + F.floor(u("sale_id", "inventory") * INVENTORY_JITTER).cast("long")
    targets = overstock_products if overstock_products is not None else OVERSTOCK_PRODUCTS
    if targets:
        lo, hi = OVERSTOCK_MULT_RANGE
        mult = F.bround(F.lit(lo) + F.lit(hi - lo) * u(F.col("product_name"), "overstock"), 2)
        inv = F.when(F.col("product_name").isin(*targets), F.bround(safety * mult, 0).cast("long")).otherwise(inv)
    dlo, dhi = DANGER_FACTOR_RANGE
    factor = F.lit(dlo) + F.lit(dhi - dlo) * u("sale_id", "danger_factor")
    inv = F.when(u("sale_id", "danger") < DANGER_SHARE,
                 F.greatest(F.floor(F.coalesce(safety, F.lit(1)) * factor), F.lit(0)).cast("long")).otherwise(inv)
    s = s.withColumn("inventory", inv.cast("long"))
    return (s.withColumn("status", inventory_status(F.col("inventory"), safety))
             .withColumn("frozen_money", F.greatest((F.col("inventory") - q) * price, F.lit(0.0))))


def inventory_status(inventory: Column, safety: Column) -> Column:
    """Danger below safety stock, Overstock above 3 x safety, else
    Normal (first match wins)."""
    return (F.when(inventory < safety, "Danger")
             .when(inventory > safety * OVERSTOCK_FACTOR, "Overstock").otherwise("Normal"))


def health_index() -> Column:
    return F.when(F.col("safety_stock") > 0, F.col("inventory") / F.col("safety_stock") * 100.0).otherwise(0.0)


def status_counts(snap: DataFrame) -> DataFrame:
    """Rows per status plus the total (status NULL)."""
    return snap.rollup("status").agg(F.count(F.lit(1)).alias("count"))


def _first(col: str) -> Column:
    return F.min_by(col, F.struct("sale_date", "sale_id"))


def inventory_list(snap: DataFrame, statuses: list[str] | None = None, by_store: bool = True) -> DataFrame:
    """Per (store_name, product): first inventory/safety/status/price and
    total frozen money; optional status filter; product-only variant."""
    s = snap if not statuses else snap.filter(F.col("status").isin(*statuses))
    keys = (["store_name"] if by_store else []) + ["product_id"]
    g = s.groupBy(*keys).agg(first_row("product_name", "inventory", "safety_stock", "status", "price").alias("_f"),
                             F.sum(cents(F.col("frozen_money"))).alias("_fc"))
    return g.select(*keys, F.col("_f.product_name").alias("product_name"), F.col("_f.inventory").alias("inventory"),
                    F.col("_f.safety_stock").alias("safety_stock"), F.col("_f.status").alias("status"),
                    F.bround(F.col("_fc") / 100.0, 2).alias("frozen_money"),
                    F.coalesce(F.col("_f.price"), F.lit(0.0)).alias("price"))


def kpi_summary(snap: DataFrame, sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR) -> DataFrame:
    """Global frozen money, Danger and Overstock counts, and for every
    product the predicted demand per forecast quarter (D9 share) and the
    expected revenue at its first price."""
    g = snap.agg(F.bround(F.sum(cents(F.col("frozen_money"))) / 100.0, 2).alias("f"),
                 F.count_if(F.col("status") == "Danger").alias("d"),
                 F.count_if(F.col("status") == "Overstock").alias("o"))
    share = product_quarter_share(sales, years, target)
    price = sales.groupBy("product_id").agg(F.coalesce(_first("price"), F.lit(0.0)).alias("price"))
    demand = round_int(F.col("product_total") / float(FORECAST_QUARTERS))
    return share.join(price, "product_id", "left").select(
        "product_id", g.select("f").scalar().alias("total_frozen_money"),
        g.select("d").scalar().alias("danger_count"), g.select("o").scalar().alias("overstock_count"),
        demand.alias("predicted_demand"), F.bround(demand * F.coalesce("price", F.lit(0.0)), 2).alias("expected_revenue"))


def overstock_by_region(snap: DataFrame) -> DataFrame:
    """I8: Overstock rows: excess = max(0, inventory - safety) and frozen
    money per (store, country, continent); primary category = category with
    the largest excess (ties: smallest name)."""
    s = snap.filter(F.col("status") == "Overstock")
    cont = F.col("continent") if "continent" in s.columns else F.lit(None).cast("string")
    from shelfcast.functions.geo import INVENTORY_COUNTRY_TO_CONTINENT, continent_of_col
    country = F.trim(F.coalesce("country", F.lit("")))
    s = s.select(F.col("store_name"), country.alias("country"),
                 F.coalesce(cont, continent_of_col(country, None, INVENTORY_COUNTRY_TO_CONTINENT), F.when(country != "", country), F.lit("Unknown")).alias("continent"),
                 F.trim(F.coalesce("category_name", F.lit(""))).alias("category"),
                 F.greatest(F.col("inventory") - F.col("safety_stock"), F.lit(0)).alias("x"),
                 cents(F.col("frozen_money")).alias("fc"))
    detail = s.groupBy("store_name", "country", "continent", "category").agg(
        F.sum("x").alias("x"), F.sum("fc").alias("fc"))
    return detail.groupBy("store_name", "country", "continent").agg(
        F.sum("x").cast("long").alias("overstock_qty"),
        F.bround(F.sum("fc") / 100.0, 2).alias("frozen_money"),
        F.min_by("category", F.struct(-F.col("x"), F.col("category"))).alias("category"))


def overstock_top5(snap: DataFrame, n: int = 5) -> DataFrame:
    """By product over Overstock rows: current and target inventory
    sums, excess, excess %, savings = excess x first price; top n."""
    s = snap.filter(F.col("status") == "Overstock")
    a = s.groupBy("product_id").agg(F.sum("inventory").cast("long").alias("current_inventory"),
                                    F.sum("safety_stock").cast("long").alias("target_inventory"),
                                    first_row("price", "product_name").alias("_f"))
    a = a.select("product_id", "current_inventory", "target_inventory",
                 F.coalesce(F.col("_f.price"), F.lit(0.0)).alias("_p"), F.col("_f.product_name").alias("product_name"))
    a = a.withColumn("overstock_qty", F.greatest(F.col("current_inventory") - F.col("target_inventory"), F.lit(0)))
    a = a.filter(F.col("overstock_qty") > 0)
    return (a.select("product_id", "product_name", "current_inventory", "target_inventory", "overstock_qty",
                     F.when(F.col("target_inventory") > 0,
                            F.bround(F.col("overstock_qty") / F.col("target_inventory") * 100.0, 1)).otherwise(0.0).alias("overstock_pct"),
                     F.bround(F.col("overstock_qty") * F.col("_p"), 0).alias("savings_amount"))
             .orderBy(F.desc("overstock_qty"), "product_id").limit(n))


def risky_top5(snap: DataFrame, n: int = 5) -> DataFrame:
    """By product over Danger rows: order quantity = target - current
    (> 0), expenditure = order x first price; top n by expenditure, ranked."""
    s = snap.filter(F.col("status") == "Danger")
    a = s.groupBy("product_id").agg(F.sum("inventory").cast("long").alias("current_inventory"),
                                    F.sum("safety_stock").cast("long").alias("target_inventory"),
                                    first_row("price", "product_name").alias("_f"))
    a = a.select("product_id", "current_inventory", "target_inventory",
                 F.coalesce(F.col("_f.price"), F.lit(0.0)).alias("_p"), F.col("_f.product_name").alias("product_name"))
    a = a.withColumn("order_quantity", F.greatest(F.col("target_inventory") - F.col("current_inventory"), F.lit(0)))
    a = a.filter(F.col("order_quantity") > 0).withColumn("expenditure", F.bround(F.col("order_quantity") * F.col("_p"), 0))
    top = a.orderBy(F.desc("expenditure"), "product_id").limit(n)
    w = Window.orderBy(F.desc("expenditure"), "product_id")  # over <= n rows
    return top.select(F.row_number().over(w).alias("rank"), "product_id", "product_name", "current_inventory",
                      "target_inventory", "order_quantity", "expenditure")


def critical_alerts(snap: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct (store, product, health, inventory, safety) with
    health < 70, lowest first, at most ``limit`` (1..200) rows, each carrying
    the count before the limit."""
    limit = max(1, min(200, int(limit)))
    c = snap.select("store_name", "product_id", health_index().alias("h"), "inventory", "safety_stock") \
            .filter(F.col("h") < CRITICAL_HEALTH).distinct()
    n = c.select(F.count(F.lit(1))).scalar()
    top = c.orderBy("h", "store_name", "product_id", "inventory").limit(limit)
    return top.select("store_name", "product_id", F.bround("h", 1).alias("health_index"),
                      "inventory", "safety_stock", n.alias("critical_count"))


def inventory_health(snap: DataFrame) -> DataFrame:
    """First health index per product (1 decimal)."""
    return snap.groupBy("product_id").agg(F.bround(_first_expr(health_index()), 1).alias("health_index"))


def _first_expr(c: Column) -> Column:
    return F.min_by(c, F.struct("sale_date", "sale_id"))


def frozen_money_alert(snap: DataFrame) -> DataFrame:
    """I7 rows flagged when frozen money is at or above the interpolated P75
    of all rows and the status is Normal (English or Korean)."""
    from shelfcast.functions.rows import exact_percentile
    from shelfcast.session import cut_lineage
    lst = cut_lineage(inventory_list(snap))  # the percentile reads it several times
    p75 = exact_percentile(lst, "frozen_money", 0.75)
    return lst.withColumn("investor_alert", (F.col("frozen_money") >= p75) & F.col("status").isin(*NORMAL_WORDS))


def _quarter_label() -> Column:
    return F.format_string("%d-Q%d", F.year("sale_date"), F.quarter("sale_date"))


def _region(sales: DataFrame, category, continent, country, store_name) -> DataFrame:
    s = sales
    if category:
        s = s.filter(F.lower(F.trim("category_name")) == category.strip().lower())
    if continent:
        s = s.filter(F.lower(F.trim("continent")) == continent.strip().lower())
    if country:
        s = s.filter(F.lower(F.trim("country")) == country.strip().lower())
    if store_name:
        s = s.filter(F.lower(F.trim("store_name")) == store_name.strip().lower())
    return s


def quarter_store_matrix(sales: DataFrame, category=None, continent=None, country=None, store_name=None) -> DataFrame:
    """I14 (long form): quantity per (category, quarter, store) with the
    store's country and continent; all categories unless one is given."""
    s = _region(sales, category, continent, country, store_name).filter(F.col("sale_date").isNotNull())
    return s.groupBy(F.trim("category_name").alias("category"), _quarter_label().alias("period"),
                     "store_name", "country", "continent").agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity"))


def sales_by_product(sales: DataFrame, category=None, continent=None, country=None, store_name=None,
                     period: str | None = None) -> DataFrame:
    """Quantity per product (within category / region / quarter)."""
    from shelfcast.operators.filters import period_filter
    s = period_filter(_region(sales, category, continent, country, store_name), period)
    return s.groupBy(F.trim("category_name").alias("category"), "product_id").agg(
        _first("product_name").alias("product_name"),
        F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity"))


def store_period_total(sales: DataFrame, year: int, n_stores: int = 12) -> DataFrame:
    """I16: per quarter of ``year``, total quantity over the first
    ``n_stores`` store names (alphabetical)."""
    s = sales.filter(F.col("sale_year") == int(year))
    first = s.select("store_name").distinct().orderBy("store_name").limit(n_stores)
    s = s.join(F.broadcast(first), "store_name", "left_semi")  # <= n_stores rows
    return s.groupBy(_quarter_label().alias("period")).agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity"))


def danger_top5_store_product(lst: DataFrame, n: int = 5) -> DataFrame:
    """I7 Danger rows: needed = safety - inventory, expenditure =
    needed x price; top n by needed."""
    d = lst.filter(F.col("status") == "Danger").withColumn("needed", F.col("safety_stock") - F.col("inventory"))
    return (d.withColumn("expenditure", F.bround(F.col("needed") * F.col("price"), 2))
             .orderBy(F.desc("needed"), "store_name", "product_id").limit(n))


def overstock_top5_store(lst: DataFrame, n: int = 5) -> DataFrame:
    """I7 Overstock rows by excess = inventory - safety."""
    d = lst.filter(F.col("status") == "Overstock").withColumn("excess", F.col("inventory") - F.col("safety_stock"))
    return d.orderBy(F.desc("excess"), "store_name", "product_id").limit(n)


def normal_below_safety(lst: DataFrame) -> DataFrame:
    """Rows labelled Normal whose inventory is below safety stock."""
    return lst.filter(F.col("status").isin(*NORMAL_WORDS) & (F.col("inventory") < F.col("safety_stock")))


def frozen_ratio_top20(lst: DataFrame, n: int = 20) -> DataFrame:
    """Frozen money per unit of inventory (2 decimals, half up) and as a whole
    percentage, top n by frozen money."""
    ratio = (F.col("frozen_money") / F.col("inventory")).cast("decimal(38,10)")
    some = F.col("inventory") > 0
    r = lst.withColumns({"frozen_ratio": F.when(some, F.round(ratio, 2).cast("double")).otherwise(0.0),
                         "frozen_ratio_pct": F.when(some, F.round(ratio * 100, 0).cast("long")).otherwise(0)})
    return r.orderBy(F.desc("frozen_money"), "store_name", "product_id").limit(n)


def stock_signal(lst: DataFrame) -> DataFrame:
    """Red when inventory < safety stock, else green."""
    return lst.withColumn("signal", F.when(F.col("inventory") < F.col("safety_stock"), "red").otherwise("green"))


def overstock_filters(by_region: DataFrame, n_stores: int = 12) -> DataFrame:
    """Distinct (continent, country, store) options of I8, the first
    ``n_stores`` stores per country."""
    d = by_region.select("continent", "country", "store_name").distinct()
    w = Window.partitionBy("continent", "country").orderBy("store_name")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_stores).drop("_r")


def _qidx(c_date: Column) -> Column:
    return F.year(c_date) * 4 + F.quarter(c_date) - 1


def product_quarter_share(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, model=None) -> DataFrame:
    """Per product: its last sale quarter (split), its share of all quantity
    in the four quarters ending there, and ``product_total`` = global
    forecast x share. Quarter totals are a small table (one row per
    quarter) joined on an exploded 4-quarter window: an equi-join, no range
    or cross join."""
    s = sales.filter(F.col("sale_date").isNotNull()).select(
        "product_id", _qidx(F.col("sale_date")).alias("qi"), F.coalesce("quantity", F.lit(0)).alias("q"))
    per_q = s.groupBy("qi").agg(F.sum("q").alias("tq"))
    pq = s.groupBy("product_id", "qi").agg(F.sum("q").alias("pq"))
    split = pq.groupBy("product_id").agg(F.max("qi").alias("split"))
    win = split.select("product_id", "split", F.explode(F.sequence(F.col("split") - 3, F.col("split"))).alias("qi"))
    j = (win.join(per_q, "qi", "left").join(pq, ["product_id", "qi"], "left")
            .groupBy("product_id", "split").agg(F.coalesce(F.sum("tq"), F.lit(0)).alias("t4"),
                                                F.coalesce(F.sum("pq"), F.lit(0)).alias("p4")))
    pred = predicted_quantity(sales, years, target, model).cast("double")
    share = F.when(F.col("t4") > 0, F.col("p4") / F.col("t4")).otherwise(0.0)
    return j.select("product_id", "split", share.alias("share"), (F.greatest(pred, F.lit(0.0)) * share).alias("product_total"))


def quarter_forecast_share(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR,
                           quarters: int = FORECAST_QUARTERS, model=None) -> DataFrame:
    """For every product, ``quarters`` future quarters after its split
    quarter: yhat = product_total / quarters, band 0.85 / 1.15, stock x1.125."""
    sh = product_quarter_share(sales, years, target, model)
    f = sh.select("product_id", "split", "product_total", F.explode(F.sequence(F.lit(1), F.lit(quarters))).alias("i"))
    qi = F.col("split") + F.col("i")
    yhat = F.greatest(F.col("product_total") / float(quarters), F.lit(0.0))
    return f.select("product_id", F.format_string("%d-Q%d", F.floor(qi / 4).cast("int"), (qi % 4 + 1).cast("int")).alias("month"),
                    F.bround(yhat, 2).alias("yhat"), F.bround(yhat * BAND_LOW, 2).alias("yhat_lower"),
                    F.bround(yhat * BAND_HIGH, 2).alias("yhat_upper"), F.bround(yhat * STOCK_FACTOR, 2).alias("store_stock_quantity"))


def quarter_demand_chart(sales: DataFrame, start_year: int = BASE_YEARS[0]) -> DataFrame:
    """Per product, quarterly actual quantity (and synthetic store stock,
    K3) from ``start_year`` Q1 up to its last sale quarter; products with
    fewer than two sale dates are left out."""
    from shelfcast.operators.prep import synth_store_stock
    s = synth_store_stock(sales.filter(F.col("sale_date").isNotNull()))
    ok = s.groupBy("product_id").agg(F.countDistinct("sale_date").alias("_nd")).filter(F.col("_nd") >= 2).select("product_id")
    s = s.join(ok, "product_id", "left_semi").filter(F.col("sale_year") >= int(start_year))
    return s.groupBy("product_id", _quarter_label().alias("month")).agg(
        F.sum(F.coalesce("quantity", F.lit(0))).cast("double").alias("yhat"),
        F.sum("store_stock_quantity").cast("double").alias("store_stock_quantity"))


def tolerant_stock_signal(lst: DataFrame, product_name: str, store_name: str | None = None) -> DataFrame:
    """J8 + I21 for one request: the first I7 row (largest frozen money
    first) whose product name equals, contains or is contained in
    ``product_name`` and whose store matches (blank, equal or containing
    ``store_name``); if no row matches the store, the first product-only
    match. Returns at most one row with ``signal`` red / green (green when
    safety stock is 0). The request values are literals: a filter, no join."""
    p = (product_name or "").strip()
    if not p:
        return lst.limit(0).withColumn("signal", F.lit(None).cast("string"))
    name = F.coalesce(F.col("product_name"), F.lit(""))
    prod_ok = (name == p) | name.contains(p) | F.lit(p).contains(name)
    st = F.coalesce(F.col("store_name"), F.lit(""))
    store_ok = (st == "") | F.lit(not store_name) | (st == (store_name or "")) | st.contains(store_name or "\u0000")
    cand = lst.filter(prod_ok).withColumn("_pref", F.when(store_ok, 0).otherwise(1))
    best = cand.orderBy("_pref", F.desc("frozen_money"), "store_name", "product_id").limit(1).drop("_pref")
    signal = F.when(F.col("safety_stock") <= 0, "green").when(F.col("inventory") < F.col("safety_stock"), "red").otherwise("green")
    return best.withColumn("signal", signal)
