"""The work of a group of documents doesn't grow with the number of shards."""

import random
import time

import pyarrow as pa
import pytest
from llm import jaccard_join, lm_score


def batch():
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(6000)}" for _ in range(20_000))
    return pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})


def timed(run):
    best, rows = 1e9, None
    for _ in range(3):
        start = time.perf_counter()
        rows = [x for b in run(iter([batch()])) for x in b.to_pylist()]
        best = min(best, time.perf_counter() - start)
    return best, rows


@pytest.mark.parametrize("make", [lambda s: lm_score._exploded(3, s, 500_000), lambda s: jaccard_join._postings(5, s, 200_000)])
def test_shards_without_entries_cost_nothing(make):
    few, many, huge = (timed(make(s)) for s in (10, 1_000_000, 1 << 30))
    assert len(many[1]) <= 60_001 and abs(len(huge[1]) - len(many[1])) < 0.05 * len(huge[1]) + 20_000
    per_row = 5e-5  # what a row with a few entries may cost
    assert many[0] < few[0] + per_row * len(many[1]) and huge[0] < few[0] + per_row * len(huge[1])


def test_runs_cover_all_entries():
    import numpy as np

    assert lm_score.runs_of(np.array([2, 2, 5, 9, 9], np.uint64)) == [(2, 0, 2), (5, 2, 3), (9, 3, 5)]
    assert lm_score.runs_of(np.empty(0, np.uint64)) == []
