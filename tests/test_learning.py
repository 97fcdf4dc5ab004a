"""The learning workflow against its formulas."""

import math

import numpy as np

from tessera.operators import learning
from tessera.plans import learning as plan


def test_coefficients_are_where_the_penalised_loss_is_flat(spark, sf):
    train, _ = learning.split(plan.features(spark, sf), "l_orderkey")
    fitted = learning.fit(train, plan.FEATURES, "label").stages[-1]
    rows = train.select(*plan.FEATURES, "label").collect()
    x, y = np.array([[float(r[f]) for f in plan.FEATURES] for r in rows]), np.array([r.label for r in rows])
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = np.append(x.T @ (p - y) + w, np.sum(p - y)) / len(y)
    at_zero = np.append(x.T @ (0.5 - y), np.sum(0.5 - y)) / len(y)
    assert np.abs(slope).max() < 1e-3 * np.abs(at_zero).max()


def test_chances_confusion_and_report(spark, sf):
    train, test = learning.split(plan.features(spark, sf), "l_orderkey")
    model = learning.fit(train, plan.FEATURES, "label")
    predicted = learning.predict(model, test).cache()
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    rows = predicted.collect()
    for r in rows:
        assert math.isclose(r.chance, 1 / (1 + math.exp(-(sum(c * float(r[f]) for c, f in zip(w, plan.FEATURES, strict=True)) + b))), abs_tol=1e-9) and r.prediction == (r.chance > 0.5)
    pairs = [(int(r.label), int(r.prediction)) for r in rows]
    assert {(r.actual, r.predicted): r.n for r in learning.confusion(predicted, "label").collect()} == {k: pairs.count(k) for k in set(pairs)}
    tp, said, are = pairs.count((1, 1)), sum(p for _, p in pairs), sum(a for a, _ in pairs)
    got = learning.report(predicted, "label").first()
    assert got.n == len(pairs) and math.isclose(got.accuracy, sum(a == p for a, p in pairs) / len(pairs)) and math.isclose(got.f1, 2 * tp / (said + are))
    assert train.join(test, "l_orderkey").count() == 0 and 0.7 < train.count() / (train.count() + len(rows)) < 0.9
    empty = learning.report(predicted.limit(0), "label").first()
    assert empty.n == 0 and empty.accuracy is None
