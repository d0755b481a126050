"""Percentiles of sliding windows against numpy over the rows of each window."""

import datetime as dt

import numpy as np
import pytest

from logquarry.operators.metrics import sliding_percentile

START = dt.datetime(2024, 1, 1)


def by_hand(rows, q, width):
    out = {}
    timed = [(t.replace(second=0, microsecond=0), v) for t, v in rows if t is not None and v is not None]
    for end in {t + dt.timedelta(minutes=i) for t, _ in timed for i in range(1, width + 1)}:
        values = sorted(v for t, v in timed if end - dt.timedelta(minutes=width) <= t < end)
        out[end] = float(np.quantile(values, q))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def check(spark, rows, q, width, k):
    got = {r.window_end: r.p for r in sliding_percentile(frame(spark, rows), "v", q, width, "p", k=k).collect()}
    want = by_hand(rows, q, width)
    assert got.keys() == want.keys()
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want)


@pytest.mark.parametrize("q, width, k", [(0.95, 5, 800), (0.5, 3, 800), (0.95, 5, 8), (0.0, 2, 8), (1.0, 1, 8)])
def test_windows(spark, q, width, k):
    """One minute holds a third of the rows; gaps, ties, nulls; with the smallest sketch brackets miss or reach far."""
    r = np.random.default_rng(7)
    minutes = np.where(r.random(6_000) < 0.33, 4, r.choice([0, 1, 2, 5, 6, 30, 31], 6_000))
    rows = [(START + dt.timedelta(minutes=int(m), seconds=int(s)), float(v) if v > 1 else None)
            for m, s, v in zip(minutes, r.integers(0, 60, 6_000), np.round(r.exponential(20, 6_000), 1))]
    check(spark, [*rows, (None, 5.0), (START + dt.timedelta(minutes=90), 1.5)], q, width, k)


def test_few_and_no_rows(spark):
    check(spark, [(START, 2.0), (START, 4.0)], 0.95, 5, 800)
    assert sliding_percentile(frame(spark, []), "v", 0.95, 5, "p").count() == 0
    assert sliding_percentile(frame(spark, [(START, None), (None, 1.0)]), "v", 0.95, 5, "p").count() == 0


def test_not_a_number_is_the_largest(spark):
    rows = [(START, 1.0), (START, 2.0), (START, float("nan"))]
    got = sliding_percentile(frame(spark, rows), "v", 0.5, 1, "p").collect()
    assert [r.p for r in got] == [2.0]
    got = sliding_percentile(frame(spark, rows[2:]), "v", 0.5, 1, "p").collect()
    assert len(got) == 1 and np.isnan(got[0].p)
