"""Column expressions for cleaning and coercion.

Everything here returns a ``Column`` built from JVM built-ins, so it stays inside whole-stage codegen.
ANSI mode stays on; lossy conversions go through ``try_*`` functions instead of plain casts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   numeric text cleaning removes the characters , $ % and treats these tokens as missing:
#   "-", "", "nan", "None" (after trimming, case as written) and the no-break space.
MISSING_NUMERIC_TOKENS = ["-", "", "nan", "None"]
# a date written month/day/four-digit-year, as on the policy pages
DATE_MDY_PATTERN = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
DATE_MDY_FULL = r"^\d{1,2}/\d{1,2}/\d{4}$"
# the first dollar amount: a "$", optional blanks, digits, optional decimals
DOLLAR_PATTERN = r"\$\s*([0-9]+(?:\.[0-9]+)?)"
# line that only consists of table-rule characters
TABLE_RULE_PATTERN = r"^[|\-: ]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim all leading/trailing whitespace (Python ``str.strip``), not only blanks like ``trim``."""
    return F.regexp_replace(_c(x), r"^[\s ]+|[\s ]+$", "")


def to_double(x) -> Column:
    """Lossy numeric cast: bad text becomes NULL."""
    return _c(x).try_cast("double")


def to_long(x) -> Column:
    return _c(x).try_cast("bigint")


def clean_numeric(x, strip_all_dashes: bool = False) -> Column:
    """P5: remove ``, $ %`` and NBSP, trim; missing tokens -> NULL; then a lossy double cast.

    ``strip_all_dashes=True`` reproduces the variant that deletes every ``-`` (so ``-5`` -> 5, N11).
    """
    s = F.regexp_replace(_c(x).cast("string"), "[,$% ]", "")
    if strip_all_dashes:
        s = F.regexp_replace(s, "-", "")
    s = strip_ws(s)
    return F.when(s.isin(MISSING_NUMERIC_TOKENS), F.lit(None)).otherwise(s).try_cast("double")


def nan_to_null(x) -> Column:
    """NaN and +-inf become NULL (Spark orders NaN above every number, so `NaN > 0` is true)."""
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def nans_to_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Apply :func:`nan_to_null` to every floating column (or the given ones) once, at the scan."""
    from pyspark.sql.types import DoubleType, FloatType

    targets = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[nan_to_null(c).alias(c) if c in targets else F.col(c) for c in df.columns])


def indicator(pred: Column) -> Column:
    """Null-safe 0/1 dummy; NULL predicate -> 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def zero_pad(x, width: int = 2) -> Column:
    """Left-pad a code with zeros, keep it a string."""
    return F.lpad(_c(x).cast("string"), width, "0")


def zero_fill(df: DataFrame, cols: Iterable[str], dtype: str = "bigint") -> DataFrame:
    """Missing counts become 0 and are cast to an integer type, for the listed columns only."""
    cols = set(cols)
    return df.select(*[F.coalesce(F.col(c).try_cast(dtype), F.lit(0).cast(dtype)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def rate_per(numerator, denominator, per: float = 100000.0, denominator_scale: float = 1.0) -> Column:
    """``numerator / (denominator * scale) * per``; a zero or missing denominator gives NULL."""
    den = _c(denominator).cast("double") * F.lit(float(denominator_scale))
    return F.try_divide(_c(numerator).cast("double"), den) * F.lit(float(per))


def parse_mdy(x) -> Column:
    """safe ``%m/%d/%Y`` parse; anything else -> NULL."""
    c = strip_ws(x)
    return F.when(c.rlike(DATE_MDY_FULL), F.try_to_date(c, "M/d/yyyy"))


def jan_first(year) -> Column:
    return F.make_date(_c(year).cast("int"), F.lit(1), F.lit(1))


def first_dollar_amount(x) -> Column:
    """the first ``$`` amount in a text, as double; NULL when there is none."""
    v = F.regexp_extract(_c(x), DOLLAR_PATTERN, 1)
    return F.when(v != "", v.try_cast("double"))


def is_table_rule(x) -> Column:
    return _c(x).rlike(TABLE_RULE_PATTERN)


def fmt_or_na(x, decimals: int = 3) -> Column:
    """fixed decimals, ``NA`` for missing (``printf`` of NULL would be the text 'null')."""
    return F.when(_c(x).isNull(), F.lit("NA")).otherwise(F.format_string(f"%.{decimals}f", _c(x)))


def normalize_name(x) -> Column:
    """P3 (text part): trim, NBSP -> blank, double blank -> blank.  The dimension lookup (P2) follows."""
    c = F.regexp_replace(_c(x), " ", " ")
    c = F.regexp_replace(c, "  ", " ")
    return strip_ws(c)


def decode_event_term(x) -> Column:
    """``evt_m5`` -> -5, ``evt_p3`` -> 3."""
    c = _c(x)
    n = F.regexp_extract(c, r"^evt_[mp](\d+)$", 1).try_cast("int")
    return F.when(c.startswith("evt_m"), -n).when(c.startswith("evt_p"), n)


def event_term_name(k: int) -> str:
    """Dummy name of event time ``k``."""
    return f"evt_m{abs(k)}" if k < 0 else f"evt_p{k}"


def not_contains_ci(x, needle: str) -> Column:
    """P10: case-insensitive "does not contain"; a NULL text counts as not containing (false -> kept)."""
    return ~F.coalesce(F.lower(_c(x)).contains(needle.lower()), F.lit(False))
