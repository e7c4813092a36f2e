"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cents(x: ColumnLike) -> Column:
    """Two-decimal amounts as exact integers, so that sums do not depend on their order."""
    return F.round(col(x) * 100).cast("long")


def mean_to_cents(total: Column, n: Column) -> Column:
    """total / n for integer amounts in cents, rounded half up to the cent in integers, so that no engine differs; null without rows."""
    return F.when(n > 0, F.floor((2 * total + n).cast("decimal(38,0)") / (2 * n).cast("decimal(19,0)")).cast("double") / 100)


def hundredths(x: ColumnLike) -> Column:
    """Rounded to two decimals, halves up, in decimals: what floating point adds beyond six places doesn't count."""
    return F.round(col(x).cast("decimal(24,6)"), 2).cast("double")


def truthy(x: ColumnLike) -> Column:
    """Present and not zero or empty (numbers and strings alike)."""
    c = col(x)
    return F.coalesce((c.cast("string") != "") & ~c.cast("string").isin("0", "0.0", "-0.0"), F.lit(False))


def clamp(x: ColumnLike, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col(x)))


def integral(x: ColumnLike) -> Column:
    return col(x) == F.floor(col(x))


def weekend(x: ColumnLike) -> Column:
    return F.weekday(col(x)) >= 5


def day_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """Whole days from b to a, rounded down."""
    sec = lambda x: F.unix_timestamp(col(x).cast("timestamp"))
    return F.floor((sec(a) - sec(b)) / 86400).cast("int")


def amount_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """(1 - |a-b| / max) * 100 for positive amounts."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), (1 - F.abs(a - b) / F.greatest(a, b)) * 100)


def date_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(day_difference(a, b)) / F.lit(365.0)) * 100


def first_argmax(**named: Column) -> Column:
    """Name of the largest value; the first wins ties."""
    top = F.greatest(*named.values())
    out = F.lit(None).cast("string")
    for name, c in reversed(named.items()):
        out = F.when(c == top, F.lit(name)).otherwise(out)
    return out


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are present, by weight; null if none is."""
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def sorted_tokens(x: ColumnLike) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(col(x)), r"\s+"), lambda t: t != "")), " ")


# Words that a query does not search for.
STOP_WORDS = ("the", "a", "an", "is", "in", "on", "at", "to", "of", "and", "or", "for", "it", "by", "as", "be", "was")


def query_tokens(x: ColumnLike) -> Column:
    """Lower-case alphanumeric tokens of two characters or more without stop words; repeats stay."""
    return F.filter(F.split(F.lower(col(x)), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def parse_amount(x: ColumnLike) -> Column:
    """Commas out, then a number; anything else is null."""
    return F.replace(col(x), F.lit(","), F.lit("")).try_cast("double")


# Date formats in the order in which they are tried; month-first wins over day-first.
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yy", "d/M/yy")


def parse_date(x: ColumnLike) -> Column:
    """The first format that fits; two-digit years from 69 on are of the last century."""
    c = F.trim(col(x))
    tries = []
    for f in DATE_FORMATS:
        d = F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")
        if f.endswith("/yy"):
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200).cast("timestamp_ntz")).otherwise(d)
        tries.append(d)
    return F.coalesce(*tries)


# Currency symbols.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}


def currency(x: ColumnLike) -> Column:
    c = F.upper(F.trim(col(x)))
    out = F.when(c.rlike("^[A-Z]{3}$"), c)
    for sign, code in SYMBOLS.items():
        out = F.when(c == sign, F.lit(code)).otherwise(out)
    return out


def hamming_similarity(a: ColumnLike, b: ColumnLike, bits: int = 256) -> Column:
    """Share of equal bits of two arrays of longs, in percent."""
    d = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return (1 - d / F.lit(float(bits))) * 100


def squared_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def iso_timestamp(x: ColumnLike) -> Column:
    """A date or time in ISO form as a timestamp; anything else is null."""
    c = F.trim(col(x))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def relative_time(x: ColumnLike, now: ColumnLike) -> Column:
    """Age in words: just now, then whole minutes, hours and days, of the difference in seconds, fractions rounded (halves to even)."""
    at = lambda t: F.unix_micros(col(t).cast("timestamp")) / 1e6
    sec = F.rint(at(now) - at(x)).cast("long")
    said = lambda n, unit: F.concat(F.floor(sec / n).cast("string"), F.lit(unit))
    return F.when(sec < 60, "just now").when(sec < 3600, said(60, "m ago")).when(sec < 86400, said(3600, "h ago")).otherwise(said(86400, "d ago"))
