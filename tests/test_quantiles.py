"""Exact percentiles by counting, against numpy."""

import numpy as np
import pytest
from fieldloom.operators import robust

FRACTIONS = (0.0, 0.05, 0.5, 0.9, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("parts", [1 << 16])
def test_few_quantiles_equal_numpy(spark, parts):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=3001) * 1e6, "b": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "c": np.array([5.0]), "d": np.array([1e300, -1e300, 1e-300, 0.0]), "e": 1 + np.arange(1000) * 2.0**-52, None: np.arange(10.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("only odd", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["n"], x["q"]) for x in robust.few_quantiles(df, ["g"], "v", FRACTIONS, parts).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][0] == len(v) and got[g][1] == pytest.approx(np.quantile(v, FRACTIONS).tolist(), rel=1e-12, abs=1e-12)
    whole = robust.few_quantiles(df, [], "v", FRACTIONS, parts).first()
    assert whole["q"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), FRACTIONS).tolist(), rel=1e-12)
    assert robust.few_quantiles(df.limit(0), ["g"], "v", FRACTIONS).collect() == []


def test_few_distributions_equal_distribution(spark):
    df = spark.createDataFrame([(k % 3, float("nan") if k % 7 == 0 else float(k * k % 977)) for k in range(4000)], "g long, v double")
    a, b = ({r["g"]: tuple(r) for r in f(df, ["g"], "v").collect()} for f in (robust.distribution, robust.few_distributions))
    assert a.keys() == b.keys() and all(a[g] == pytest.approx(b[g]) for g in a)
    assert robust.few_distributions(df.limit(0), [], "v").first()["p50"] is None
