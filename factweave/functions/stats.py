"""Comparison statistics as column expressions; null means missing and is never zero.

Kernels on baselines take an array column (nulls are missing observations)
and return a struct whose flags tell, in order, what is thin or degenerate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Adequacy and baseline thresholds, and the MAD of a normal distribution as its sigma.
MIN_BASELINE_POINTS = 3
RATE_MIN_DENOMINATOR = 30
RATE_MIN_CELL = 5
MAD_TO_SIGMA = 1.4826
FLOOR_SHARE = 0.01

NO_FLAGS = "array<string>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def delta(current: Column, prior: Column) -> Column:
    return current - prior


def pct_change(current: Column, prior: Column) -> Column:
    return F.try_divide(current - prior, F.abs(prior)) * 100.0


def contribution_share(cut_delta: Column, overall_delta: Column) -> Column:
    return F.try_divide(cut_delta, overall_delta) * 100.0


def values_match(claimed: Column, computed: Column, tolerance: Column) -> Column:
    both = F.abs(claimed - computed) <= tolerance
    return F.when(claimed.isNull() | computed.isNull(), claimed.isNull() & computed.isNull()).otherwise(both)


def usable(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mean(values: Column) -> Column:
    """Of an array without nulls; null if empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def sample_sd(values: Column) -> Column:
    """Of an array without nulls; null under two values, exactly 0 where all are equal."""
    squares = let(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    flat = F.array_min(values) == F.array_max(values)
    return F.when(F.size(values) < 2, F.lit(None).cast("double")).when(flat, F.lit(0.0)).otherwise(
        F.sqrt(F.try_divide(squares, F.size(values) - 1))
    )


def median(values: Column) -> Column:
    """Of an array without nulls, between the middle two."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)

    return let(F.sort_array(values), middle)


def median_absolute_deviation(values: Column) -> Column:
    return let(median(values), lambda m: median(F.transform(values, lambda x: F.abs(x - m))))


def compare_to_baseline(current: Column, baseline: Column) -> Column:
    """Struct mean, sd, n, pct, z, flags of ``current`` against an array of earlier values."""

    def of(v: Column) -> Column:
        n = F.size(v)
        return let(F.struct(mean(v).alias("mean"), sample_sd(v).alias("sd")), lambda m: F.struct(
            m["mean"].alias("mean"), m["sd"].alias("sd"), n.alias("n"), pct_change(current, m["mean"]).alias("pct"),
            F.when(m["sd"] > 0, (current - m["mean"]) / m["sd"]).alias("z"),
            flags(
                (n < MIN_BASELINE_POINTS, "thin_baseline"), (n == 0, "no_baseline"), ((n > 0) & current.isNull(), "no_current_value"),
                ((n > 0) & current.isNotNull() & F.coalesce(m["sd"] == 0, F.lit(True)), "degenerate_baseline_scale"),
            ).alias("flags"),
        ))

    return let(usable(baseline), of)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z of two proportions; null where a sample is empty or the pooled rate is not inside (0, 1)."""
    pooled = F.try_divide(k1 + k2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    fine = (n1 > 0) & (n2 > 0) & (pooled > 0) & (pooled < 1)
    return F.when(fine, F.try_divide(F.try_divide(k1, n1) - F.try_divide(k2, n2), se))


def rate_adequacy_flags(numerator: Column, denominator: Column) -> Column:
    some = denominator > 0
    return flags(
        (~some, "no_exposure"), (some & (denominator < RATE_MIN_DENOMINATOR), "small_denominator"),
        (some & (F.least(numerator, denominator - numerator) < RATE_MIN_CELL), "small_cell"),
    )


def robust_scale_floor(centre: Column, metric_type: Column) -> Column:
    return F.when(metric_type == "count", F.sqrt(F.greatest(centre, F.lit(1.0)))).otherwise(F.abs(centre) * FLOOR_SHARE)


def robust_score(current: Column, baseline: Column, metric_type: Column) -> Column:
    """Struct median, mad, scale, n, score, flags of a day against its earlier same weekdays."""

    def of(v: Column) -> Column:
        n = F.size(v)
        return let(F.struct(median(v).alias("median"), median_absolute_deviation(v).alias("mad")), lambda m: let(
            F.struct(
                ((m["median"] == 0) & (m["mad"] == 0)).alias("zero"), (m["mad"] * MAD_TO_SIGMA).alias("wide"),
                robust_scale_floor(m["median"], metric_type).alias("floor"),
            ), lambda s: let(F.greatest(s["wide"], s["floor"]), lambda scale: F.struct(
                m["median"].alias("median"), m["mad"].alias("mad"),
                F.when(~s["zero"] & (scale > 0), scale).alias("scale"), n.alias("n"),
                F.when(~s["zero"] & (scale > 0), (current - m["median"]) / scale).alias("score"),
                flags(
                    (n < MIN_BASELINE_POINTS, "thin_baseline"), (n == 0, "no_baseline"), (s["zero"], "all_zero_baseline"),
                    (s["zero"] & (current != 0), "new_event"), (~s["zero"] & (s["floor"] > s["wide"]), "scale_floored"),
                    (~s["zero"] & (scale <= 0), "degenerate_scale"),
                    (~s["zero"] & (scale > 0) & current.isNull(), "no_current_value"),
                ).alias("flags"),
            ))))

    return let(usable(baseline), of)
