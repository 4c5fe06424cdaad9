"""Scalar expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_most(x: Column, high: float) -> Column:
    """``x``, no more than ``high``; null stays null (``least`` would give the bound)."""
    return F.when(x > high, F.lit(float(high))).otherwise(x)


def at_least(x: Column, low: float) -> Column:
    """``x``, no less than ``low``; null stays null."""
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return at_most(at_least(x, low), high)


def headroom(pct: Column) -> Column:
    return at_least(100.0 - pct, 0.0)


def pressure_index(used: Column, swap: Column) -> Column:
    return at_most(0.7 * used + 0.3 * swap, 100.0)


#: Splits a double into halves of 26 bits whose products are exact.
_HALVES = 134217729.0


def _halves(x: Column) -> tuple[Column, Column]:
    t = x * _HALVES
    high = t - (t - x)
    return high, x - high


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` places by its exact binary value, exact ties to even, as Python's ``round`` does.

    The product with a power of ten is carried as a double and its exact error, so a value just under a tie (2.675) isn't
    taken for one.  Null, NaN and values without a fraction at that scale stay as they are."""
    x = x.cast("double")
    a, scale = F.abs(x), float(10**digits)
    p = a * scale
    (ah, al), (sh, sl) = _halves(a), _halves(F.lit(scale))
    error = ((ah * sh - p) + ah * sl + al * sh) + al * sl
    k = F.floor(p).cast("double")
    over = (p - k - 0.5) + error  # above, at or under the tie between k and k + 1
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(k % 2)
    # an error that takes the product under a whole number leaves that number as the nearest
    return F.when(p < float(1 << 52), F.signum(x) * (k + up) / scale).otherwise(x)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def stage_key(query: Column, stage: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(F.trim(query)), F.lit("::"), stage), 256), 1, 16)


def query_key(queries: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(queries), "|")), 1, 12)


#: Fibonacci numbers for retry delays, by rule.
def fibonacci(n: int) -> list[int]:
    return reduce(lambda a, _: [*a, a[-1] + a[-2]], range(n - 2), [1, 1])


def backoff(kind: str, base: float, attempt: Column, cap: float = 60.0) -> Column:
    """Delay before an attempt (counted from 1): exponential, linear, constant or fibonacci, under a cap."""
    k = F.greatest(attempt, F.lit(1))
    fib = fibonacci(30)
    raw = {
        "exponential": lambda: base * F.pow(F.lit(2.0), k - 1),
        "linear": lambda: base * k.cast("double"),
        "constant": lambda: F.lit(base),
        "fibonacci": lambda: base * F.element_at(F.array(*[F.lit(float(x)) for x in fib]), F.least(k, F.lit(len(fib))).cast("int")),
    }[kind]()
    return F.round(F.least(F.lit(cap), raw), 3)


def cosine(a: Column, b: Column) -> Column:
    double = lambda x: x.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = double(a), double(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def megabytes(n: Column) -> Column:
    return n / 1048576.0


def gigabytes(n: Column) -> Column:
    return n / 1073741824.0


def title(name: Column) -> Column:
    """Words of an underscored name with capitals."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def unfenced(content: Column) -> Column:
    """What stands in the first code fence, without its language mark; without a fence the stripped text."""
    bare = F.regexp_replace(content, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(F.element_at(F.split(bare, "```"), 2), r"^[json]+", ""), r"^\s+|\s+$", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def jittered(delay: Column, seed: int, share: float = 0.2) -> Column:
    """A delay moved by up to ``share`` either way, at least 0.1; applied after the cap, so it may pass it."""
    return F.greatest(F.lit(0.1), delay * (1 - share + 2 * share * F.rand(seed)))


def short_id(n: int = 8) -> Column:
    """The head of a random id; never the same twice, so not for compared results."""
    return F.substring(F.uuid(), 1, n)


def items_by_value(df, column: str, out: str = "items"):
    """Entries of a map of counts, largest first, as ``key:value`` joined by commas."""
    entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return df.withColumn(out, F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(":"), (-e["v"]).cast("string"))), ","))
