"""Scalar text functions (F1-F6, F11-F16) as native column expressions.

All of these stay inside whole-stage codegen: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's rules) ----------------------
# Tokens that mean "no value" after text cleaning.
NULL_TOKENS = ["None", "nan", "NaN"]
# Brand prefixes dropped from store names (case-insensitive), in test order.
BRAND_PREFIXES = ["apple ", "애플 "]
BRAND_STORE_PREFIXES = ["apple store ", "apple ", "애플 "]
# Connector tags: canonical tag -> spellings searched in names and tags.
CHARGER_SPELLINGS_IN_NAME = [
    ("magsafe", ["magsafe", "mag safe"]),
    ("usb-c", ["usb-c", "usbc", "usb c"]),
    ("lightning", ["lightning"]),
]
CHARGER_SPELLINGS_IN_TAG = [
    ("magsafe", ["magsafe", "mag safe"]),
    ("usb-c", ["usb-c", "usbc", "usb_c"]),
    ("lightning", ["lightning"]),
]
GENERAL_TAG = "general"
DEFAULT_USER_ID = 1025
# Korean status words accepted by filters.
STATUS_WORDS = {"위험": "Danger", "과잉": "Overstock", "정상": "Normal"}
# ---------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_quotes(x: Column | str) -> Column:
    """trim, drop one pair of matching wrapping quotes, trim again."""
    t = F.trim(_c(x))
    return F.trim(F.regexp_replace(t, r"(?s)^(['\"])(.*)\1$", "$2"))


def norm_text(x: Column | str) -> Column:
    """F1, then "None"/"nan"/"NaN" and NULL become ''."""
    s = strip_quotes(_c(x).cast("string"))
    return F.when(s.isNull() | s.isin(*NULL_TOKENS), F.lit("")).otherwise(s)


def _prefix_regex(prefixes: list[str]) -> str:
    alts = "|".join(p.replace(" ", r"\s") for p in prefixes)
    return rf"(?i)^({alts})"


def strip_brand(x: Column | str, prefixes: list[str] | None = None) -> Column:
    """drop a leading brand word ("Apple ", "애플 "), then trim."""
    t = F.trim(_c(x))
    return F.trim(F.regexp_replace(t, _prefix_regex(prefixes or BRAND_PREFIXES), ""))


def strip_brand_store(x: Column | str) -> Column:
    """also drops "Apple Store "."""
    return strip_brand(x, BRAND_STORE_PREFIXES)


def norm_name_key(x: Column | str) -> Column:
    """keep ASCII letters/digits, lower-case."""
    return F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^A-Za-z0-9]+", ""))


def norm_parens(x: Column | str) -> Column:
    """'소호 (SoHo)' -> '소호(SoHo)': no spaces around parentheses."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    t = F.regexp_replace(t, r"\s*\)\s*", ")")
    return F.regexp_replace(t, r"\s*\(\s*", "(")


def store_user_id(x: Column | str) -> Column:
    """"ST-10" -> 10; otherwise all digits of the id; else 1025."""
    s = F.upper(F.trim(_c(x).cast("string")))
    st = F.when(s.startswith("ST-"), F.trim(F.substring(s, 4, 1 << 20)).try_cast("long"))
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9]", "")
    return F.coalesce(st, F.when(digits != "", digits.try_cast("long")), F.lit(DEFAULT_USER_ID).cast("long"))


def _contains_any(s: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | s.contains(w)
    return cond


def compat_tags(product_name: Column | str, category_name: Column | str) -> Column:
    """connector tags from the name, the category (spaces -> '_'),
    else ["general"]; duplicates removed, first occurrence kept."""
    name = F.lower(F.coalesce(_c(product_name), F.lit("")))
    cat = F.lower(F.coalesce(_c(category_name), F.lit("")))
    parts = [F.when(_contains_any(name, words), F.lit(tag)) for tag, words in CHARGER_SPELLINGS_IN_NAME]
    parts.append(F.when(cat != "", F.regexp_replace(cat, " ", "_")))
    tags = F.array_compact(F.array(*parts))
    return F.array_distinct(F.when(F.size(tags) == 0, F.array(F.lit(GENERAL_TAG))).otherwise(tags))


def charger_type(tags: Column | str, product_name: Column | str) -> Column:
    """first connector found in the tags (in tag order), else in the name."""
    def tag_kind(t: Column) -> Column:
        t = F.lower(t)
        expr = None
        for tag, words in CHARGER_SPELLINGS_IN_TAG:
            cond = _contains_any(t, words)
            expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
        return expr
    from_tags = F.try_element_at(
        F.filter(F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), tag_kind),
                 lambda k: k.isNotNull()), F.lit(1))
    name = F.lower(F.coalesce(_c(product_name), F.lit("")))
    from_name = None
    for tag, words in CHARGER_SPELLINGS_IN_NAME:
        cond = _contains_any(name, words)
        from_name = F.when(cond, F.lit(tag)) if from_name is None else from_name.when(cond, F.lit(tag))
    return F.coalesce(from_tags, from_name)


def status_normalize(x: Column | str) -> Column:
    """Korean status words -> English; other values trimmed as given."""
    s = F.trim(_c(x))
    expr = None
    for ko, en in STATUS_WORDS.items():
        expr = F.when(s == ko, F.lit(en)) if expr is None else expr.when(s == ko, F.lit(en))
    return expr.otherwise(s)


def status_list(csv_text: str | None) -> list[str]:
    """F14 for a request parameter: "Danger,위험" -> ["Danger"]. Plain
    Python on one short literal, not on data."""
    if not csv_text:
        return []
    out = []
    for part in str(csv_text).split(","):
        p = part.strip()
        if p:
            p = STATUS_WORDS.get(p, p)
            if p not in out:
                out.append(p)
    return out


def safe_float_clamp(x: Column | str, default: float = 0.0,
                     low: float | None = None, high: float | None = None) -> Column:
    """NULL/NaN/unparsable -> default, then clamp to [low, high]."""
    v = _c(x).cast("string").try_cast("double")
    v = F.when(v.isNull() | F.isnan(v), F.lit(float(default))).otherwise(v)
    if low is not None:
        v = F.greatest(v, F.lit(float(low)))
    if high is not None:
        v = F.least(v, F.lit(float(high)))
    return v


def sale_label(sale_id: Column | str, product_name: Column | str) -> Column:
    """F16: "sale_id (first 18 characters of the product name)"."""
    name = F.coalesce(_c(product_name).cast("string"), F.lit(""))
    return F.concat(_c(sale_id).cast("string"), F.lit(" ("), F.substring(name, 1, 18), F.lit(")"))
