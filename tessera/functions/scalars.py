"""Scalar column helpers with defined null, sign and zero behaviour (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, in pairs.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"


def normalize_name(name: Column) -> Column:
    """Lower case, accents removed, then only a-z and 0-9."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]", "")


def clean_text(text: Column) -> Column:
    """Stripped text; blank is null."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def typed_double(text: Column) -> Column:
    """A double, or null where the whole stripped text isn't a number."""
    t = clean_text(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def typed_long(text: Column) -> Column:
    """An integer, or null where the number has a fraction or isn't finite."""
    d = typed_double(text)
    return F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.try_cast("bigint"))


def year_of(period: Column) -> Column:
    """The year that a period text begins with (four ASCII digits), else null."""
    return F.when(F.substring(clean_text(period), 1, 4).rlike("^[0-9]{4}$"), F.substring(clean_text(period), 1, 4).try_cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; 0 where both are 0."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), scale))


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation; null on constant input and fewer than two rows, where corr() may raise."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), sx * sy))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) where n is 0."""
    k, m = successes.cast("double"), n.cast("double")
    p = F.try_divide(k, m)
    scale = 1 + F.try_divide(F.lit(z * z), m)
    centre = (p + F.try_divide(F.lit(z * z / 2), m)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z / 4), m * m)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def fisher_interval(rho: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Fisher-z interval of a correlation; null for n <= 3 or |rho| >= 1."""
    inside = (n > 3) & (F.abs(rho) < 1)
    r = F.when(inside, rho)
    width = F.try_divide(F.lit(z), F.sqrt(F.when(n > 3, n - 3).cast("double")))
    return F.when(inside, F.tanh(F.atanh(r) - width)), F.when(inside, F.tanh(F.atanh(r) + width))


def median_of(values: Column) -> Column:
    """Median of an array of doubles without nulls; null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def canonical_json(entries: Column) -> Column:
    """JSON of a string map with sorted keys; equal maps give equal text, null stays null."""
    return F.when(entries.isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))))


def flag_array(**flags: Column) -> Column:
    """Names of the flags that are true, in the order given; null counts as false."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def has_flag(flags: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(flags, name), F.lit(False))
