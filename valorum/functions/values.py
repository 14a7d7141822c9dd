"""Value Column expressions: scaling, clamps, guards, coalescing, flags, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
THOUSANDS_SCALE = "MIL"      # scale label meaning "value in thousands"
PLAUSIBLE_EPS_LIMIT = 100.0  # |EPS| above this is discarded
PAYOUT_CAP = 1.5             # payout ratio clamp
PAYOUT_DEFAULT = 0.45        # payout when it cannot be computed
DIVIDEND_SCALE = 1000.0      # dividends are always in thousands
KE_MODE_LABELS = ("nom", "real")  # 0 -> nominal, non-zero -> real
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scale_units(value, scale, thousands_label: str = THOUSANDS_SCALE) -> Column:
    """F8: thousands to units when the scale column says so."""
    v = _c(value)
    return F.when(_c(scale) == thousands_label, v * 1000.0).otherwise(v)


def clamp(x, lo: float, hi: float) -> Column:
    """clamp to [lo, hi]; null stays null (least/greatest would turn it into lo)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def numeric_guard(x) -> Column:
    """non-numeric text (or NaN) to null, numeric to double."""
    d = _c(x).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def falsy_coalesce(*cols, kind: str = "number") -> Column:
    """first value that is neither null nor zero (``kind='number'``) / empty (``'text'``)."""
    wrap = nonzero if kind == "number" else nonblank
    return F.coalesce(*[wrap(c) for c in cols])


def nonzero(x) -> Column:
    """F13 helper: zero to null."""
    return F.nullif(_c(x), F.lit(0))


def nonblank(x) -> Column:
    """F13 helper: empty text to null."""
    return F.nullif(_c(x), F.lit(""))


def flag_override(flag, value, default) -> Column:
    """the stored value when its 'use default' flag is off and the value is present.

    A NULL or absent flag counts as 'use default' (D1).
    """
    use_default = F.coalesce(_c(flag).cast("boolean"), F.lit(True))
    v = _c(value)
    return F.when(~use_default & v.isNotNull(), v).otherwise(
        default if isinstance(default, Column) else F.lit(default))


def tags_from_json(text) -> Column:
    """JSON text to an array of strings, empty text to an empty array."""
    return F.from_json(F.coalesce(nonblank(text), F.lit("[]")), "array<string>")


def tags_to_json(tags) -> Column:
    """array of strings to JSON text, null to '[]'."""
    return F.coalesce(F.to_json(_c(tags)), F.lit("[]"))


_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts, ntz: bool) -> Column:
    """Epoch microseconds. A timestamp without zone is read as UTC wall-clock time whatever
    the session time zone; a timestamp with zone is an instant already."""
    c = _c(ts)
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), c)
    return F.unix_micros(c.cast("timestamp"))


def epoch_millis(ts, ntz: bool = True) -> Column:
    """F16: timestamp to epoch milliseconds (floored, like the browser's ``ts * 1000``)."""
    return F.floor(epoch_micros(ts, ntz) / 1000).cast("long")


def is_ntz(df, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "timestamp_ntz"


def round_half_up(x, places: int = 2) -> Column:
    """D8 / F9 (quotes): multiply, round half up, divide - the browser-side rule for cents."""
    m = float(10 ** places)
    return F.floor(_c(x) * m + 0.5) / m


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant


def _split(v: float) -> tuple[float, float]:
    c = _SPLIT * v
    hi = c - (c - v)
    return hi, v - hi


def _exact_product(x: Column, m: float) -> tuple[Column, Column]:
    """x * m as a float and the exact error of that multiply (Dekker's two-product, plain double arithmetic)."""
    hm, lm = _split(m)
    p = x * m
    c = x * _SPLIT
    hx = c - (c - x)
    lx = x - hx
    return p, ((hx * hm - p) + hx * lm + lx * hm) + lx * lm


def round_half_even(x, places: int = 2) -> Column:
    """F9 (build figures): Python's ``round(x, places)``: half-to-even on the exact binary value.

    The exact error of ``x * 10**places`` decides
    the apparent ties: 2.675 is 2.67499999... in binary, so it rounds to 2.67.
    """
    m = float(10 ** places)
    p, err = _exact_product(_c(x), m)
    fl = F.floor(p).cast("double")
    tie = (p - fl) == 0.5
    r = F.when(tie & (err > 0), fl + 1.0).when(tie & (err < 0), fl).otherwise(F.rint(p))
    return r / m


def format_ptbr(x, places: int = 2, prefix: str = "") -> Column:
    """Brazilian number text: '.' thousands, ',' decimals.

    Rounds the exact binary value, as the browser does: 4.015 (a little less in binary) shows 4,01, and
    exact ties go away from zero (12.5 at 0 places shows 13).
    """
    x, m = _c(x), float(10 ** places)
    p, err = _exact_product(F.abs(x), m)
    fl = F.floor(p).cast("double")
    shown = F.when(((p - fl) == 0.5) & (err == 0), F.signum(x) * (fl + 1.0) / m).otherwise(x)
    body = F.translate(F.format_number(shown, places), ",.", ".,")
    return F.concat(F.lit(prefix), body) if prefix else body


def format_pct(x, places: int = 0) -> Column:
    """percent text of a number in percent; decimals that are all zero are dropped: '12,5%', '12%'."""
    return F.concat(F.regexp_replace(format_ptbr(x, places), ",0+$", ""), F.lit("%"))


def format_brl(x) -> Column:
    """currency text 'R$ 1.234,56'."""
    return format_ptbr(x, 2, "R$ ")


def mode_to_text(v) -> Column:
    """numeric mode to its label (non-zero -> 'real')."""
    v = _c(v)
    return F.when(F.coalesce(v, F.lit(0.0)) != 0, F.lit(KE_MODE_LABELS[1])).otherwise(F.lit(KE_MODE_LABELS[0]))


def text_to_mode(t) -> Column:
    """label back to its number."""
    return F.when(_c(t) == KE_MODE_LABELS[1], F.lit(1.0)).otherwise(F.lit(0.0))


def plausible(x, limit: float = PLAUSIBLE_EPS_LIMIT) -> Column:
    """P5: keep a value only if it is non-zero and |x| <= limit."""
    x = _c(x)
    return F.when((F.abs(x) <= limit) & (x != 0), x)


def first_plausible(*cols, limit: float = PLAUSIBLE_EPS_LIMIT) -> Column:
    """V2: first plausible value among the sources, in order."""
    return F.coalesce(*[plausible(c, limit) for c in cols])
