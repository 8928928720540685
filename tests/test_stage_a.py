"""The linear model over embeddings: all values of C in one pass a round."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from siftmill.operators import calibrate


def plain_fit(x, t, c, steps=6000):
    """The same minimum by plain gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((t.shape[1], x.shape[1]))
    rate = 1 / (0.5 * c * np.linalg.norm(x, 2) ** 2 + 1)
    for _ in range(steps):
        z = np.exp(x @ w.T - (x @ w.T).max(1, keepdims=True))
        g = c * ((z / z.sum(1, keepdims=True)) * t.sum(1, keepdims=True) - t).T @ x
        g[:, :-1] += w[:, :-1]
        w -= rate * g
    return w


def test_weights_and_choice_equal_a_plain_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    t = np.eye(3)[np.argmax(x + rng.normal(size=(120, 3)) * 0.8, axis=1)] * 0.9 + 0.1 / 3
    dev = np.arange(120) % 5 == 0
    df = spark.createDataFrame([(a.tolist(), b.tolist(), bool(d)) for a, b, d in zip(x, t, dev)], "embedding array<double>, target array<double>, is_dev boolean").repartition(3)
    weights, c, losses = calibrate.train_linear(df)
    assert set(losses) == set(calibrate.C_GRID) and len(losses) == 7 and c == min(losses, key=losses.get)
    for one in (0.01, 0.3):
        w = plain_fit(x[~dev], t[~dev], one)
        z = np.column_stack([x[dev], np.ones(dev.sum())]) @ w.T
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        assert losses[one] == pytest.approx(-(t[dev] * logp).sum() / dev.sum(), abs=1e-4)
    want = plain_fit(x, t, c)
    assert np.allclose(weights[:, :-1], want[:, :-1], atol=2e-3)
    got = calibrate.linear_logits(df.limit(5), weights).select("embedding", *calibrate.LOGITS).collect()
    for r in got:
        assert np.allclose([r[k] for k in calibrate.LOGITS], weights @ [*r["embedding"], 1.0])


def test_missing_and_empty_dev_fold(spark):
    with pytest.raises(ValueError):
        calibrate.train_linear(spark.createDataFrame([], "embedding array<double>, target array<double>, is_dev boolean"))
    rows = spark.createDataFrame([([1.0], [1.0, 0.0]), ([-1.0], [0.0, 1.0])], "embedding array<double>, target array<double>").withColumn("is_dev", F.lit(False))
    weights, c, _ = calibrate.train_linear(rows, grid=(0.5, 1.0))
    assert c == 0.5 and weights[0, 0] > 0 > weights[1, 0]


def test_entry_without_the_training_data_folder(tmp_path):
    """A folder of caches alone counts as absent."""
    for name in ("__spark_entry__.py", "siftmill"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "siftmill" / "llm", ignore_errors=True)
    (tmp_path / "siftmill" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("raise RuntimeError('not to be imported')")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr
