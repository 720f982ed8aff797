"""Hand fixture: n = 8, three target classes, three clusters."""

import math

import pytest
from pyspark.sql import functions as F

from grovelight.functions.numeric import ln_overlap_chance
from grovelight.operators import flat_scores as fs

TARGET, PRED = "aaabbbcc", "11222233"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(TARGET, PRED))]
    return spark.createDataFrame(rows, "id long, target string, pred string").cache()


def test_scores(labels):
    row = fs.fm_significance(labels).first()
    assert row["fm"] == pytest.approx(0.668153, abs=1e-6)
    assert row["threshold"] == pytest.approx(0.502261, abs=1e-6)
    assert row["significant"]
    moments = fs.fm_moments(labels).first()
    assert moments["e_fm"] == pytest.approx(0.267261, abs=1e-6)
    assert moments["v_fm"] == pytest.approx(0.020408, abs=1e-6)
    flat = fs.flat_scores(labels).first()
    assert flat["rand"] == pytest.approx(0.821429, abs=1e-6)
    assert flat["ari"] == pytest.approx(0.545455, abs=1e-6)
    assert flat["ami"] == pytest.approx(0.621821, abs=1e-6)


@pytest.mark.parametrize("a, b, n", [(3, 4, 8), (50, 400, 10**6), (1000, 2000, 10**10), (100_000, 300_000, 10**10)])
def test_overlap_chances_keep_their_digits(spark, a, b, n):
    """Against exact whole numbers, also where ln(n!) has eleven digits before the point."""
    from fractions import Fraction

    middle = a * b // n
    ms = sorted({max(0, a + b - n), middle, middle + 1, min(a, b, middle + 3)})
    df = spark.createDataFrame([(m, a, b, n) for m in ms], "m long, a long, b long, n long")
    chance = F.exp(ln_overlap_chance(F.col("m"), F.col("a"), F.col("b"), F.col("n")))
    for row in df.select("m", chance.alias("p")).collect():
        m, log = row["m"], Fraction(1)
        for i in range(m):  # C(a, m) C(n - a, b - m) / C(n, b) with the large factors cancelled
            log *= Fraction((a - i) * (b - i), (i + 1) * (n - i))
        exact = float(log)
        rest = sum(math.log1p(-(a - m) / (n - m - i)) for i in range(b - m))
        assert row["p"] == pytest.approx(exact * math.exp(rest), rel=1e-9)


def test_null_label_gives_null_moments(spark):
    rows = [(0, "a", "1"), (1, None, "1"), (2, "a", "2"), (3, "b", "2")]
    row = fs.fm_moments(spark.createDataFrame(rows, "id long, target string, pred string")).first()
    assert row["fm"] is None and row["e_fm"] is None and row["v_fm"] is None


def test_one_cluster_and_singletons(spark):
    one = spark.createDataFrame([(i, "x", "y") for i in range(5)], "id long, target string, pred string")
    row = fs.flat_scores(one).first()
    assert (row["ari"], row["ami"], row["rand"]) == (1.0, 1.0, 1.0)
    alone = spark.createDataFrame([(i, str(i), str(i)) for i in range(5)], "id long, target string, pred string")
    row = fs.flat_scores(alone).first()
    assert row["fm"] == 0.0 and row["ari"] == 1.0


def test_expected_overlap_of_very_large_clusters(spark):
    """Four cells of a quarter of a billion rows: listing every possible overlap would not end."""
    cells = spark.createDataFrame([(0, a, b, 250_000_000) for a in "xy" for b in "xy"], "g int, target string, pred string, n_ij long")
    found = fs.expected_mutual_info(cells, ["g"]).first()["emi"]
    assert found == pytest.approx(1 / (2 * 1_000_000_000), rel=1e-3)  # (rows - 1) (columns - 1) / 2n
