import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from porespark.functions import stats
from porespark.plans import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and many ties."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ms_id": np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 9, 3000)), "id": np.arange(3000),
                        "v": rng.integers(0, 40, 3000).astype(float), "w": rng.random(3000)})
    return spark.createDataFrame(pdf), pdf


def both(fn):
    return [sorted(map(tuple, fn(limit).collect())) for limit in (10 ** 9, 0)]


def test_position_same_on_both_paths(skewed):
    df, pdf = skewed
    a, b = both(lambda n: ordering.with_position(df, ["ms_id"], [F.col("v").desc(), F.col("id").asc()], "pos", n))
    assert a == b
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("ms_id").cumcount() + 1
    got = {r[1]: r[-1] for r in ((r[0], r[1], r[-1]) for r in b)}
    assert all(got[i] == want[i] for i in pdf["id"])


def test_running_sum_same_on_both_paths(skewed):
    df, _ = skewed
    a, b = both(lambda n: ordering.with_running_sum(df.select("ms_id", "id", "v"), ["ms_id"], [F.col("id").asc()], "v", "run", n)
                .select("ms_id", "id", "v", "run"))
    assert a == b


def test_average_rank_is_pandas_rank(skewed):
    df, pdf = skewed
    want = pdf.groupby("ms_id")["v"].rank()
    for limit in (10 ** 9, 0):
        got = ordering.with_average_rank(df, ["ms_id"], "v", ["id"], "r", limit).select("id", "r").toPandas().set_index("id")["r"]
        assert np.allclose(got.sort_index().to_numpy(), want.to_numpy())


def test_quantiles_are_pandas_quantiles(skewed):
    df, pdf = skewed
    for limit in (10 ** 9, 0):
        got = ordering.group_quantiles(df, ["ms_id"], "w", {"a": 0.1, "b": 0.9, "c": 0.5}, ["id"], limit).toPandas().set_index("ms_id")
        for name, p in (("a", 0.1), ("b", 0.9), ("c", 0.5)):
            assert np.allclose(got[name].sort_index(), pdf.groupby("ms_id")["w"].quantile(p))


def test_correlations_match_pandas(skewed):
    df, pdf = skewed
    for limit in (10 ** 9, 0):
        got = stats.correlations(df, ["ms_id"], "v", "w", ["id"], window_rows=limit).toPandas().set_index("ms_id").sort_index()
        for ms, part in pdf.groupby("ms_id"):
            assert got.loc[ms, "spearman"] == pytest.approx(part["v"].rank().corr(part["w"].rank()))
            assert got.loc[ms, "pearson"] == pytest.approx(part["v"].corr(part["w"]))


def test_p_values():
    assert stats.correlation_p_value(0.5, 10) == pytest.approx(0.14111328125)
    assert stats.correlation_p_value(1.0, 10) == 0.0
    assert stats.mann_whitney_p_value(23.0, 5, 5, 0) == pytest.approx(0.031746, abs=1e-6)
    # all orderings of 3 against 4: the exact tail by enumeration
    import itertools
    u = [sum(c) - 6 for c in itertools.combinations(range(1, 8), 3)]
    assert stats.mann_whitney_p_value(10.0, 3, 4, 0) == pytest.approx(2 * np.mean([x >= 10 for x in u]))
