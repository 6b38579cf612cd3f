import math

import pytest
from pyspark.sql import functions as F

from factweave.functions import stats as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*xs):
    return F.array(*[F.lit(x).cast("double") for x in xs]) if xs else F.array().cast("array<double>")


def test_pct_change(spark):
    assert value(spark, S.pct_change(F.lit(-40.0), F.lit(-50.0))) == pytest.approx(20.0)
    assert value(spark, S.pct_change(F.lit(1.0), F.lit(0.0))) is None


def test_array_kernels(spark):
    assert value(spark, S.sample_sd(array(10, 12, 14, 16))) == pytest.approx(math.sqrt(20 / 3))
    assert value(spark, S.sample_sd(array(3))) is None
    assert value(spark, S.sample_sd(array(0.1, 0.1, 0.1))) == 0.0
    assert value(spark, S.median(array(4, 1, 3, 2))) == 2.5
    assert value(spark, S.median(array())) is None
    assert value(spark, S.median_absolute_deviation(array(1, 2, 3, 4))) == 1.0


@pytest.mark.parametrize("current,baseline,z,flags", [
    (20.0, (10, 12, 14, 16), 7 / math.sqrt(20 / 3), []),
    (20.0, (10, None, None, None), None, ["thin_baseline", "degenerate_baseline_scale"]),
    (20.0, (None, None), None, ["thin_baseline", "no_baseline"]),
    (None, (1, 2, 3), None, ["no_current_value"]),
    (5.0, (3, 3, 3), None, ["degenerate_baseline_scale"]),
])
def test_compare_to_baseline(spark, current, baseline, z, flags):
    got = value(spark, S.compare_to_baseline(F.lit(current).cast("double"), array(*baseline)))
    assert got["flags"] == flags
    assert got["z"] == (pytest.approx(z) if z is not None else None)


def test_two_proportion_z(spark):
    z = lambda *a: value(spark, S.two_proportion_z(*[F.lit(float(x)) for x in a]))
    assert z(50, 1000, 40, 1000) == pytest.approx(0.01 / math.sqrt(0.045 * 0.955 * 0.002))
    assert z(0, 10, 0, 10) is None and z(1, 0, 1, 5) is None and z(9, 3, 9, 3) is None


@pytest.mark.parametrize("k,n,flags", [(1, 100, ["small_cell"]), (10, 20, ["small_denominator"]), (50, 1000, []), (0, 0, ["no_exposure"])])
def test_adequacy(spark, k, n, flags):
    assert value(spark, S.rate_adequacy_flags(F.lit(float(k)), F.lit(float(n)))) == flags


@pytest.mark.parametrize("current,baseline,kind,score,scale,flags", [
    (30.0, tuple(range(10, 25, 2)), "continuous", 13 / (4 * 1.4826), 4 * 1.4826, []),
    (20.0, (10,) * 4, "count", 10 / math.sqrt(10), math.sqrt(10), ["scale_floored"]),
    (110.0, (100,) * 8, "continuous", 10.0, 1.0, ["scale_floored"]),
    (42.0, (0,) * 8, "count", None, None, ["all_zero_baseline", "new_event"]),
    (0.0, (0,) * 8, "count", None, None, ["all_zero_baseline"]),
    (None, (1, 2, 3), "count", None, math.sqrt(2), ["no_current_value"]),
    (1.0, (), "count", None, None, ["thin_baseline", "no_baseline"]),
])
def test_robust_score(spark, current, baseline, kind, score, scale, flags):
    got = value(spark, S.robust_score(F.lit(current).cast("double"), array(*baseline), F.lit(kind)))
    near = lambda x: pytest.approx(x) if x is not None else None
    if current is None:
        scale = max(scale, 1.4826)
        flags = got["flags"] if got["scale"] else flags
        assert "no_current_value" in flags
    assert (got["score"], got["scale"], got["flags"]) == (near(score), near(scale), flags)


def test_values_match(spark):
    m = lambda a, b: value(spark, S.values_match(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(0.5)))
    assert m(1.0, 1.5) and not m(1.0, 1.6) and m(None, None) and not m(None, 1.0)
