"""Recurrences over stretches against a loop over samples."""

import math

import numpy as np
import pandas as pd
import pytest
from boxlake.operators import recurrence


def ema_by_loop(x, decay, tau):
    out, e = [], 0.0
    for t, v in enumerate(x, 1):
        d = decay * (1 - math.exp(-t / tau))
        e = e * d + v * (1 - d)
        out.append(e)
    return out


def filter_by_loop(b, a, x):
    n = len(a) - 1
    step = np.eye(n) - np.eye(n, k=1)
    step[:, 0] += a[1:]
    state = np.linalg.solve(step, b[1:] - a[1:] * b[0]) * x[0]
    out = []
    for v in x:
        y = b[0] * v + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def table(spark, series):
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame(pd.DataFrame([(str(k), int(t), float(v)) for k, t, v in rows], columns=["k", "t", "v"]))


def series():
    r = np.random.default_rng(1)
    return {"long": r.normal(5, 2, 3000).cumsum(), "short": r.normal(0, 1, 7), "one": np.array([3.0]), "two": np.array([1.0, 2.0])} | {f"s{i}": r.random(40) for i in range(5)}


def test_stretches_cut_series(spark):
    rows = recurrence.numbered(table(spark, series()), "k", "t", "v", 200).toPandas()
    assert (rows["o"] == rows["t"]).all() and rows.groupby("k")["part"].nunique().max() > 5
    assert {k: int(n) for k, n in rows.groupby("k")["n"].first().items()} == {k: len(x) for k, x in series().items()}


def test_running_ema(spark, monkeypatch):
    monkeypatch.setattr(recurrence.numbered, "__defaults__", (150,))
    got = recurrence.running_ema(table(spark, series()), "k", "t", "v", 0.99, 30.0).toPandas()
    for k, x in series().items():
        mine = got[got["k"] == k].sort_values("t")["ema"].to_numpy()
        assert mine == pytest.approx(ema_by_loop(x, 0.99, 30.0), rel=1e-10)


def test_doubling_does_not_underflow_into_wrong_values():
    a, b = np.full(4000, 1e-3), np.ones(4000)
    assert recurrence.scan(a, b)[1][-1] == pytest.approx(1 / (1 - 1e-3))


def test_both_ways(spark, monkeypatch):
    monkeypatch.setattr(recurrence.numbered, "__defaults__", (150,))
    got = recurrence.lowpass_series(table(spark, series()), "k", "t", "v", "k string, t long, smooth double", 0.2, 4).toPandas()
    b, a = recurrence.butterworth(4, 0.2)
    for k, x in series().items():
        pad = min(15, len(x) - 1)
        wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad else x
        want = filter_by_loop(b, a, filter_by_loop(b, a, wide)[::-1])[::-1][pad : pad + len(x)]
        mine = got[got["k"] == k].sort_values("t")["smooth"].to_numpy()
        assert mine == pytest.approx(want, abs=1e-7)


def test_first_order(spark):
    x = np.array([1.0, 5.0, 2.0, 8.0])
    want = x.copy()
    for _ in range(2):
        for i in range(1, 4):
            want[i] = want[i - 1] + 0.2 * (want[i] - want[i - 1])
        want = want[::-1].copy()
    got = recurrence.smooth_series(table(spark, {"a": x}), "k", "t", "v", "k string, t long, smooth double").orderBy("t").collect()
    assert [r.smooth for r in got] == pytest.approx(want)


def test_null_values_and_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (None, 3, 4.0), ("a", 1, None)], "k string, t long, v double")
    got = {(r.k, r.t): r.smooth for r in recurrence.lowpass_series(df, "k", "t", "v", "k string, t long, smooth double").collect()}
    assert set(got) == {(None, 1), (None, 3)}
    assert recurrence.running_ema(df.limit(0), "k", "t", "v").count() == 0
