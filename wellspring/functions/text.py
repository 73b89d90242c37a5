"""Column-expression helpers for text.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.fixed_values import CRISIS_MARKER, EMAIL_PATTERN, PHONE_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace (Spark ``trim``
    removes spaces only, T21)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def normalise_email(x, strip: bool = True) -> Column:
    """``strip().lower()`` (sign-in, reset, resend) or only ``lower()`` (signup)."""
    c = _c(x)
    return F.lower(py_strip(c) if strip else c)


def is_valid_email(x) -> Column:
    """The email pattern anchored at the start only, so ``a@b.c@d`` passes."""
    return F.coalesce(_c(x).rlike(EMAIL_PATTERN), F.lit(False))


def contains_any(x, keywords: list[str], lower: bool = True) -> Column:
    """True when any keyword is a plain substring of the (lower-cased) text."""
    text = F.lower(_c(x)) if lower else _c(x)
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.exists(arr, lambda k: F.contains(text, k))


def matching_keywords(x, keywords: list[str], lower: bool = True) -> Column:
    """Keywords (in declared order) that occur as substrings of the text."""
    text = F.lower(F.coalesce(_c(x), F.lit(""))) if lower else F.coalesce(_c(x), F.lit(""))
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.filter(arr, lambda k: F.contains(text, k))


def normalise_quotes(x) -> Column:
    """Optional (T27): typographic apostrophes become straight ones before matching."""
    return F.translate(_c(x), "’‘", "''")


def phone_extract(x) -> Column:
    """First phone-number-like run (8+ characters) with whitespace removed; null if none."""
    m = F.regexp_extract(_c(x), PHONE_PATTERN, 1)
    return F.when(m == "", F.lit(None)).otherwise(F.regexp_replace(m, r"\s+", ""))


def capitalize(x) -> Column:
    """Python ``str.capitalize()``: first character upper, the rest lower."""
    c = _c(x)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def truthy_or(x, default) -> Column:
    """Python ``x or default`` for text: null and '' fall to the default."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def last_item(arr) -> Column:
    """``a[-1]``."""
    return F.try_element_at(_c(arr), F.lit(-1))


def all_but_last(arr) -> Column:
    """``a[:-1]``."""
    a = _c(arr)
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def last_n(arr, n: int) -> Column:
    """``a[-n:]``."""
    a = _c(arr)
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def has_crisis_marker(x) -> Column:
    """The client's crisis-reply test."""
    return F.contains(F.lower(_c(x)), F.lit(CRISIS_MARKER))
