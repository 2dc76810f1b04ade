"""Exact quantiles against numpy, in rounds over few bins."""

import numpy as np
import pytest

from spendlens.operators import quantile


@pytest.mark.parametrize("bins,few", [(quantile.BINS, quantile.FEW), (3, 2)])
def test_exact_quantile(spark, monkeypatch, bins, few):
    monkeypatch.setattr(quantile, "BINS", bins)
    monkeypatch.setattr(quantile, "FEW", few)
    rng = np.random.default_rng(bins)
    heavy = np.concatenate([rng.normal(size=150), np.full(80, 0.25), np.exp(rng.normal(size=20) * 20), [-1e308, 1e308]])
    tiny = np.array([5e-324, 0.0, 1e-323, 5e-324])
    for values in (heavy, tiny, np.full(7, 3.5), np.array([2.0]), np.array([1.0, np.nextafter(1.0, 2)])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3).cache()
        for p in (0.0, 0.05, 0.5, 0.9, 1.0) if bins > 3 else (0.7,):
            place = p * (len(values) - 1)
            a, b = np.sort(values)[[int(np.floor(place)), int(np.ceil(place))]].tolist()
            want = a if a == b else a + (place - np.floor(place)) * (b - a)
            assert quantile.exact_quantile(df, "x", p) == pytest.approx(want, rel=1e-14, abs=0)


def test_ends(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert quantile.exact_quantile(df, "x", 0.0) == -np.inf and quantile.exact_quantile(df, "x", 1.0) == np.inf
    assert quantile.exact_quantile(df, "x", 0.5) == 1.5
    assert quantile.exact_quantile(df.where("false"), "x", 0.5) is None
    with pytest.raises(ValueError):
        quantile.exact_quantile(df, "x", 1.5)
