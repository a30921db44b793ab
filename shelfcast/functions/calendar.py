"""year / quarter / period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
KO_QUARTER_SUFFIX = "분기"    # "2020 1분기"
# ---------------------------------------------------------------------------


def period_label(date_col, lang: str = "en") -> Column:
    """"2020-Q1" (en) or "2020 1분기" (ko) for a date column."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    if lang == "ko":
        return F.format_string("%d %d" + KO_QUARTER_SUFFIX, F.year(d), F.quarter(d))
    return F.format_string("%d-Q%d", F.year(d), F.quarter(d))


def quarter_index(date_col) -> Column:
    """Consecutive quarter number (year * 4 + quarter - 1), for quarter arithmetic."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.year(d) * 4 + F.quarter(d) - 1
