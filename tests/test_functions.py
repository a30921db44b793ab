from pyspark.sql import functions as F

from shelfcast.functions import geo, text
from shelfcast.operators.filters import store_name_match, store_name_spellings


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


def test_strip_quotes_and_norm_text(spark):
    assert one(spark, text.strip_quotes, "'  x  '") == "x"
    assert one(spark, text.strip_quotes, '"b"') == "b"
    assert one(spark, text.norm_text, None) == ""
    assert one(spark, text.norm_text, "nan") == ""
    assert one(spark, text.norm_text, "None") == ""
    assert one(spark, text.norm_text, " 'Spain' ") == "Spain"


def test_brand_and_keys(spark):
    assert one(spark, text.strip_brand, "apple SoHo") == "SoHo"
    assert one(spark, text.strip_brand, "애플 강남") == "강남"
    assert one(spark, text.strip_brand_store, "Apple Store SoHo") == "SoHo"
    assert one(spark, text.norm_name_key, "MacBook Pro 16-inch") == "macbookpro16inch"
    assert one(spark, text.norm_parens, "소호 (SoHo)") == "소호(SoHo)"


def test_store_user_id(spark):
    assert one(spark, text.store_user_id, "ST-10") == 10
    assert one(spark, text.store_user_id, "x7y") == 7
    assert one(spark, text.store_user_id, "abc") == 1025


def test_tags_and_charger(spark):
    df = spark.createDataFrame([("MagSafe Charger", "Power Adapters"), ("Widget", ""), ("USB-C Cable", "usb-c")],
                               "n string, c string")
    rows = df.select(text.compat_tags("n", "c").alias("t")).collect()
    assert rows[0]["t"] == ["magsafe", "power_adapters"]
    assert rows[1]["t"] == ["general"]
    assert rows[2]["t"] == ["usb-c"]
    r = df.select(text.charger_type(text.compat_tags("n", "c"), F.col("n")).alias("k")).collect()
    assert [x["k"] for x in r] == ["magsafe", None, "usb-c"]


def test_status_list():
    assert text.status_list("") == []
    assert text.status_list("Danger,Overstock") == ["Danger", "Overstock"]
    assert text.status_list("위험") == ["Danger"]


def test_geo(spark):
    assert one(spark, geo.resolve_country, "한국") == "South Korea"
    assert one(spark, geo.resolve_country, "korea") == "South Korea"
    assert one(spark, geo.resolve_country, "Atlantis") == "Atlantis"
    assert one(spark, geo.resolve_country, "") == ""
    assert one(spark, lambda c: geo.display_label(c, "country"), "South Korea") == "한국(South Korea)"
    assert one(spark, lambda c: geo.display_label(c, "store"), "apple SoHo") == "소호(apple SoHo)"
    assert one(spark, lambda c: geo.continent_of_col(c), "UAE") == "Asia"


def test_store_name_spellings(spark):
    c = one(spark, store_name_spellings, "소호 (SoHo)")
    assert "SoHo" in c and "소호(SoHo)" in c
    assert "Rideau Center" in one(spark, store_name_spellings, "Rideau Centre")
    for stored, asked, hit in (("Apple Store SoHo", "소호(SoHo)", True), ("Rideau Center", "Rideau Centre", True),
                               ("apple soho", "SoHo", True), ("Apple Ginza", "SoHo", False), ("Apple Ginza", "", False)):
        assert one(spark, lambda col: store_name_match(col, asked), stored) is hit, (stored, asked)


def test_inventory_continents(spark):
    for country, continent in (("Switzerland", "Europe"), ("Hong Kong", "Asia"), ("Macau", "Asia"), ("India", "Asia"),
                               ("New Zealand", "Oceania"), ("Brazil", "South America"), ("Argentina", "South America"),
                               ("United Arab Emirates", "Asia")):
        assert one(spark, lambda c: geo.continent_of_col(c, None, geo.INVENTORY_COUNTRY_TO_CONTINENT), country) == continent


def test_period_labels(spark):
    import datetime as dt
    from shelfcast.functions.calendar import period_label, quarter_index
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2021, 12, 31),)], "d date")
    r = df.select(period_label("d").alias("en"), period_label("d", "ko").alias("ko"), quarter_index("d").alias("qi")).collect()
    assert [(x["en"], x["ko"], x["qi"]) for x in r] == [("2020-Q1", "2020 1분기", 8080), ("2021-Q4", "2021 4분기", 8087)]
