import numpy as np
import pytest
from pyspark.sql import functions as F
from sunder.llm import pu_quality as pu


def _mixture(prior, seed=1, n=3000):
    rng = np.random.default_rng(seed)
    good, bad = rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3))
    k = round(prior * n)
    return good, np.concatenate([rng.normal(1.5, 1, (k, 3)), bad[: n - k]]), np.arange(n) < k


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_and_classes_without_negatives(prior):
    xp, xu, truth = _mixture(prior)
    assert abs(pu.class_prior(xp, xu) - prior) < 0.06
    score = pu.minimise(xp, xu, pu.class_prior(xp, xu)).score(xu)
    assert ((score >= 0.5) == truth).mean() > 0.9


def test_slope_by_finite_differences():
    xp, xu, _ = _mixture(0.4, n=200)
    model = pu.Model(xu.mean(0), xu.std(0), np.zeros(7), 0.4)
    p, u = model.inputs(xp), model.inputs(xu)
    w = np.random.default_rng(2).normal(0, 0.3, 7)
    value, slope = pu.risk(w, p, u, 0.4)
    for i in range(7):
        e = np.eye(7)[i] * 1e-6
        assert abs((pu.risk(w + e, p, u, 0.4)[0] - pu.risk(w - e, p, u, 0.4)[0]) / 2e-6 - slope[i]) < 1e-6


def test_step_where_the_second_part_is_below_zero():
    p, u, w = np.array([[1.0, 2.0]]), np.array([[1.0, -2.0]]), np.array([0.0, 1.0])  # positives score high, unlabelled ones low
    su, sp = pu._sigmoid(u @ w), pu._sigmoid(p @ w)
    assert -np.log(1 - su).mean() + 0.5 * np.log(1 - sp).mean() < 0
    value, step = pu.risk(w, p, u, 0.5)
    assert np.isclose(value, -0.5 * np.log(sp).mean()) and np.allclose(step, -(u.T @ su - 0.5 * (p.T @ sp)))


def test_rows_to_the_driver_are_bounded(spark):
    docs = spark.range(1000).select(F.when(F.col("id") < 900, 2).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(0).alias("_text"), F.lit(0).alias("x"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    seen, real = [], pu.minimise
    pu.minimise = lambda xp, xu, *a, **k: seen.append((len(xp), len(xu))) or real(xp, xu, *a, **k)
    try:
        assert pu.scored(docs, labels, rows=5).count() == 1000
    finally:
        pu.minimise = real
    assert seen and all(a <= 5 and b <= 10 for a, b in seen)
    assert pu.scored(docs.limit(0), labels).count() == 0
