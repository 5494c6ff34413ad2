"""The predictor: its untrained form, its gradient, what training gains, and saved models."""

import numpy as np
import pytest

from chronoweave.operators import features
from chronoweave.operators.features import Predictor, _sums


def batch(x, y):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(y.tolist())], ["features", "label"])


def some(n=60, kmax=4, width=7, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    x[:, 0] = r.integers(0, kmax + 1, n)
    return x, np.clip(x[:, 0] + (x[:, 1] > 0.8) - (x[:, 2] > 0.8), 0, kmax).astype(int)


def test_untrained_is_persistence(spark):
    x, y = some()
    m = Predictor.untrained(4, 7)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, features array<double>")
    assert [r.pred for r in m.predict(df).collect()] == x[:, 0].astype(int).tolist()


def test_gradient_and_columns(spark):
    x, y = some()
    r = np.random.default_rng(1)
    pos = np.array([1.0, 2.0, 1.5, 3.0])

    def model(theta):
        return Predictor(4, 5, [0.1] * 7, [1.5] * 7, theta[:28].reshape(4, 7).tolist(), theta[28:].tolist())

    theta = r.normal(size=32) * 0.2
    loss = lambda t: next(_sums([batch(x, y)], model(t), pos, False)).column(1)[0].as_py()
    got = np.array(next(_sums([batch(x, y)], model(theta), pos, True)).column(3)[0].as_py())
    step = 1e-6 * np.eye(32)
    assert got == pytest.approx([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in step], rel=1e-4, abs=1e-5)
    # the columns say what numpy says
    df = spark.createDataFrame([(a.tolist(),) for a in x], "features array<double>")
    assert [p.pred for p in model(theta).predict(df).collect()] == (model(theta).logits(x) > 0).sum(axis=1).tolist()


def test_training_gains_and_saves(spark, tmp_path):
    x, y = some(900)
    rows = [("train" if i < 500 else "val" if i < 700 else "test", a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "split string, features array<double>, label int").repartition(3)
    m = features.fit_predictor(df, 4, features.Defaults(epochs=40, patience=5), hmax=9)
    test = df.where("split = 'test'")
    right = lambda model: features.evaluate(model, test, np.ones(4))[2]
    assert right(m) > right(Predictor.untrained(4, 7)) + 0.05
    m.save(spark, f"{tmp_path}/model.json")
    again = Predictor.load(spark, f"{tmp_path}/model.json", kmax=4, width=7, hmax=9)
    assert again == m
    for bad in ({"kmax": 5}, {"width": 8}, {"hmax": 10}):
        with pytest.raises(ValueError):
            Predictor.load(spark, f"{tmp_path}/model.json", **bad)
    m.bias = m.bias[1:]
    m.save(spark, f"{tmp_path}/model.json")
    with pytest.raises(ValueError):
        Predictor.load(spark, f"{tmp_path}/model.json")
