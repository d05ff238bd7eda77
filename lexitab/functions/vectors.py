"""Expressions over probability vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the semantics.
TIED = -99
UNAVAILABLE = -100
TIE_TOLERANCE = 1e-12
_TINY = 1e-300


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(p: Column | str) -> Column:
    """Sum of the elements."""
    return F.aggregate(_col(p), F.lit(0.0), lambda a, x: a + x)


def binary_vector(p: Column | str) -> Column:
    """[1 - p, p]."""
    return F.array(1 - _col(p), _col(p))


def is_simplex(p: Column | str, tolerance: float = 1e-5) -> Column:
    """Whether all elements are finite, within [0, 1], and sum to 1."""
    p = _col(p)
    inside = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(inside & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def entropy(p: Column | str) -> Column:
    """Shannon entropy over its maximum; a zero counts nothing."""
    p = _col(p)
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(F.greatest(x, F.lit(_TINY)))) / F.ln(F.size(p))


def js_divergence(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint vectors."""
    middle = F.zip_with(_col(p), _col(q), lambda a, b: (a + b) / 2)
    part = lambda v: F.aggregate(F.zip_with(v, middle, lambda x, m: F.when(x > 0, x * F.log2(x / F.greatest(m, F.lit(_TINY)))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return (part(_col(p)) + part(_col(q))) / 2


def total_variation(p: Column | str, q: Column | str) -> Column:
    """Half the sum of absolute differences."""
    return total(F.zip_with(_col(p), _col(q), lambda a, b: F.abs(a - b))) / 2


def earth_movers(p: Column | str, q: Column | str) -> Column:
    """Sum of absolute differences of the cumulative sums, the last left out."""
    p, q = _col(p), _col(q)
    steps = F.slice(F.zip_with(p, q, lambda a, b: a - b), 1, F.greatest(F.size(p) - 1, F.lit(0)))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    move = lambda s, x: F.struct((s["run"] + x).alias("run"), (s["sum"] + F.abs(s["run"] + x)).alias("sum"))
    return F.aggregate(steps, start, move, lambda s: s["sum"])


def expected_level(p: Column | str, lowest: int = -4) -> Column:
    """Mean of the levels lowest, lowest + 1, ... under p."""
    p = _col(p)
    return total(F.transform(p, lambda x, i: x * (i + lowest)))


def level_variance(p: Column | str, lowest: int = -4) -> Column:
    """Variance of the levels under p."""
    p = _col(p)
    return total(F.transform(p, lambda x, i: x * (i + lowest) * (i + lowest))) - F.pow(expected_level(p, lowest), 2)


def top_answer(p: Column | str) -> Column:
    """Zero-based place of the largest element; TIED within the tolerance; UNAVAILABLE for a null vector or element."""
    p = _col(p)
    best = F.array_max(p)
    near = F.size(F.filter(p, lambda x: x >= best - TIE_TOLERANCE))
    missing = p.isNull() | F.exists(p, lambda x: x.isNull() | F.isnan(x))
    return F.when(missing, UNAVAILABLE).when(near > 1, TIED).otherwise(F.array_position(p, best).cast("int") - 1)


def mean_of_others(all_sum: Column, own: Column, n: Column) -> Column:
    """Element-wise (sum - own) / (n - 1); null for fewer than two vectors."""
    return F.when(n > 1, F.zip_with(all_sum, own, lambda s, x: (s - x) / (n - 1)))


def normalised(p: Column | str) -> Column:
    """The elements over their sum; null where that is 0."""
    p = _col(p)
    return F.when(total(p) > 0, F.transform(p, lambda x: x / total(p)))


def band(x: Column | str, edges: tuple[float, ...], prefix: str) -> Column:
    """prefix_i with i the number of edges at or below x (bins open on the right)."""
    x = _col(x)
    return F.concat(F.lit(f"{prefix}_"), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)).cast("string"))


def equal_width_bin(x: Column | str, low: float, high: float, bins: int) -> Column:
    """0 to bins - 1; the last bin is closed and values outside are clipped to the ends."""
    step = F.floor((_col(x) - low) / ((high - low) / bins))
    return F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1)).cast("int")


def bounded_projection(p: Column | str, half_step: float, rounds: int = 60) -> Column:
    """The vector within half_step of p, and within [0, 1], that sums to 1 by one common shift, found by bisection."""
    start = F.struct(F.lit(-half_step).alias("lo"), F.lit(half_step).alias("hi"))
    moved = lambda v, shift: F.transform(v, lambda x: F.least(F.greatest(x + shift, x - half_step, F.lit(0.0)), x + half_step, F.lit(1.0)))

    def search(v):
        def halve(s, _):
            kept = lambda middle: lambda below: F.struct(F.when(below, middle).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle).alias("hi"))
            return _once((s["lo"] + s["hi"]) / 2, lambda middle: _once(total(moved(v, middle)) < 1, kept(middle)))

        shift = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        return _once(shift, lambda found: moved(v, found))

    return _once(_col(p), search)


def _once(value: Column, body) -> Column:
    """body(value) with the value worked out once, not at each place and in each round where body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def realigned(p: Column | str, order: Column | str) -> Column:
    """The vector in the original order, where order names for each shown place the original place (from 0)."""
    p, order = _col(p), _col(order)
    return F.transform(p, lambda _, i: F.element_at(p, F.array_position(order, i.cast("long")).cast("int")))


def mean_vector(*vectors: Column | str) -> Column:
    """Element-wise mean of vectors of one length; null if one is null."""
    out = _col(vectors[0])
    for v in vectors[1:]:
        out = F.zip_with(out, _col(v), lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(vectors))


def ordinal_target(level: Column | str, size: int, smoothing: float) -> Column:
    """1 - smoothing on the level (from 0), the rest shared by its neighbours."""
    level = _col(level)
    neighbours = F.when((level == 0) | (level == size - 1), 1).otherwise(2)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == level, 1 - smoothing).when(F.abs(k - level) == 1, smoothing / neighbours).otherwise(0.0))


def within_rounding(x: Column | str, decimals: int) -> Column:
    """Whether a number has at most so many decimals, up to 1e-8 of the last."""
    scaled = _col(x) * 10**decimals
    return F.abs(scaled - F.round(scaled)) <= 1e-8


def score_range(p: Column | str, half_step: float, lowest: int = -4) -> Column:
    """Struct low, high: the least and largest expected level of vectors within half_step of p that sum to 1.

    Greedy: all elements start at their lower bounds, and the missing mass goes to the lowest (highest) levels first.
    """
    p = _col(p)
    bounds = F.transform(p, lambda x, i: F.struct(F.greatest(x - half_step, F.lit(0.0)).alias("lo"), F.least(x + half_step, F.lit(1.0)).alias("hi"), (i + lowest).cast("double").alias("level")))
    base = F.aggregate(bounds, F.lit(0.0), lambda s, b: s + b["lo"] * b["level"])
    missing = 1 - F.aggregate(bounds, F.lit(0.0), lambda s, b: s + b["lo"])

    def fill(ordered):
        start = F.struct(missing.alias("left"), F.lit(0.0).alias("sum"))
        give = lambda s, b: F.greatest(F.lit(0.0), F.least(s["left"], b["hi"] - b["lo"]))
        return F.aggregate(ordered, start, lambda s, b: F.struct((s["left"] - give(s, b)).alias("left"), (s["sum"] + give(s, b) * b["level"]).alias("sum")), lambda s: base + s["sum"])

    return F.struct(fill(bounds).alias("low"), fill(F.reverse(bounds)).alias("high"))
