"""Column expressions shared by every operator; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that count as "no value" after trimming and lower-casing.
MISSING_TOKENS = ("", "na", "n/a", "null", "nan", "none")

WHITESPACE = " \t\n\x0b\x0c\r"
Z95 = 1.96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every ASCII white-space character, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_missing(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin(*MISSING_TOKENS)


def has_text(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) > 0


def hash_rank(seed: int | str | Column, *keys: Column | str) -> Column:
    """Portable 32-bit hash of (seed, keys): the order used for all randomness."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", seed_col.cast("string"), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def limit(c: Column, lo: float, hi: float) -> Column:
    """As :func:`clamp` for callers that rule out NULL; refers to ``c`` once."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den as double; ``default`` (or NULL) where the denominator is 0."""
    out = F.when(den != 0, num.cast("double") / den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """95 % score interval of k successes in n, clamped to [0, 1]; (0, 0) for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    safe = F.when(n > 0, n)
    p = k / safe
    z2 = z * z
    den = 1.0 + z2 / safe
    centre = (p + z2 / (2.0 * safe)) / den
    half = (z / den) * F.sqrt(p * (1.0 - p) / safe + z2 / (4.0 * safe * safe))
    lo = F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))
    hi = F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(0.0))
    return lo, hi


def band(c: Column) -> Column:
    """Clamp a rating component to 1..9 (0 and 10 are reserved for people)."""
    return limit(c, 1, 9).cast("int")


def scale_band(share: Column) -> Column:
    """Share in [0, 1] to a 1..9 rating, half-even rounding."""
    return band(F.bround(share * 10.0, 0).cast("int"))


def detectability(width: Column, base: int | Column = 8) -> Column:
    """Rating of how precise the evidence is: one step down per 0.05 of interval width."""
    base_col = base if isinstance(base, Column) else F.lit(base)
    steps = F.floor(F.greatest(width, F.lit(0.0)) / 0.05).cast("int")
    return F.when(width.isNull(), base_col).otherwise(band(base_col - steps)).cast("int")


def max_changes(budget: Column | str) -> Column:
    """Attack budget to number of changed characters, 1..8."""
    return clamp(F.bround(col(budget) * 100.0, 0).cast("int"), 1, 8)


def risk_score(o: Column | str, s: Column | str, d: Column | str) -> Column:
    """Cube root of O*S*D; NULL when a component is missing or outside 0..10."""
    o, s, d = col(o), col(s), col(d)
    valid = reduce(lambda a, b: a & b, [c.between(0, 10) for c in (o, s, d)])
    product = (o * s * d).cast("double")
    return F.when(
        valid,
        F.when(product == 0, F.lit(0.0)).when(product == 1000, F.lit(10.0)).otherwise(F.cbrt(product)),
    )


def geometric_mean(values: list[Column]) -> Column:
    """Geometric mean of values in [0, 1]; a zero absorbs."""
    capped = [limit(v, 0.0, 1.0) for v in values]
    any_zero = reduce(lambda a, b: a | b, [v == 0.0 for v in capped])
    logs = reduce(lambda a, b: a + b, [F.ln(F.when(v > 0, v)) for v in capped])
    return F.when(any_zero, F.lit(0.0)).otherwise(limit(F.exp(logs / len(capped)), 0.0, 1.0))


def geometric_mean_agg(value: Column) -> Column:
    """Aggregate form of :func:`geometric_mean` (NULLs ignored, empty group gives 0)."""
    capped = clamp(value, 0.0, 1.0)
    any_zero = F.coalesce(F.bool_or(capped == 0.0), F.lit(False))
    return F.when(any_zero, F.lit(0.0)).otherwise(
        F.coalesce(F.exp(F.avg(F.ln(F.when(capped > 0, capped)))), F.lit(0.0))
    )


def contains_any(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs])
    return F.filter(arr, lambda x: x.isNotNull())


def first_case(*pairs: tuple[Column, object], default: object = None) -> Column:
    """Ordered cascade: the first condition that holds decides."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    A plain nested expression would be re-evaluated at every use, also inside lambdas.
    """
    return F.transform(F.array(value), body)[0]


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])
