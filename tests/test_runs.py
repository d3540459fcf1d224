"""Runs from anchors against plain models."""

import random

import pytest
from simloom.operators import runs
from test_fragments import dedup_model, pairs_model, runs_model, tokens


def test_repeated_words_travel_as_blocks():
    """Two texts of one word meet in one row, not in a row for each of their 45 times 75 pairs of windows."""
    pa = runs.pa
    table = pa.RecordBatch.from_pydict({"file": [1, 2], "ids": pa.array([[7] * 49, [7] * 79], pa.list_(pa.int64()))})
    anchors = pa.Table.from_batches(list(runs._anchors(iter([table]), 5))).sort_by([("g", "ascending"), ("file", "ascending"), ("at", "ascending")])
    pieces = [r for b in runs._pieces(iter(anchors.to_batches()), 5) for r in zip(*b.to_pydict().values())]
    assert pieces == [(1, 2, 0, 0, 1, 45, 75)]
    assert sum(b.num_rows for b in runs._across(iter([pa.RecordBatch.from_pydict(dict(zip(("f1", "f2", "s1", "s2", "n", "l1", "l2"), ([x] for x in pieces[0]))))]), 5, False)) == 45 * 75


@pytest.mark.parametrize("at_once", [3, 1 << 19])
def test_window_runs(spark, monkeypatch, at_once):
    """Random, repeated-word and copied texts, pairs listed in parts of any size."""
    rnd = random.Random(at_once)
    files = {f: [rnd.choice("abc") for _ in range(rnd.randrange(0, 45))] for f in range(5)} | {5: ["a"] * 30, 6: ["a"] * 17, 13: ["a"] * 9 + ["q", "r"] + ["a"] * 23, 14: ["z"] * 16, 15: ["z"] * 8, 16: ["z"] * 21}
    files |= {7: [f"x{i}" for i in range(40)], 8: [f"x{i}" for i in range(40)], 9: [f"x{i}" for i in range(5, 60)] + ["a"] * 12, 10: [], 11: ["x"] * 4}
    w = 5
    want = runs_model(pairs_model(files, w), w)
    apart = [r for r in want if r[0] != r[3] or max(r[1], r[4]) > min(r[2], r[5])]
    df = tokens(spark, files)
    assert sorted(map(tuple, runs.window_runs(df, w).collect())) == want
    assert sorted(map(tuple, runs.window_runs(df, w, dedup=True).collect())) == dedup_model(apart)
    # The same parts in one process, where the limit holds.
    monkeypatch.setattr(runs, "AT_ONCE", at_once)
    pa, np = runs.pa, runs.np
    ids = [np.array([hash(t) for t in v], np.int64) for v in files.values()]
    table = pa.RecordBatch.from_pydict({"file": list(files), "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))})
    for dedup, all_runs in ((False, want), (True, dedup_model(apart))):
        found = [r for b in runs._within(iter([table]), w, dedup) for r in zip(*b.to_pydict().values())]
        anchors = pa.Table.from_batches(list(runs._anchors(iter([table]), w))).sort_by([("g", "ascending"), ("file", "ascending"), ("at", "ascending")])
        pieces = pa.Table.from_batches(list(runs._pieces(iter(anchors.combine_chunks().to_batches(max_chunksize=7)), w))).sort_by([(c, "ascending") for c in ("f1", "f2", "s1", "s2")])
        found += [r for b in runs._across(iter(pieces.combine_chunks().to_batches(max_chunksize=6)), w, dedup) for r in zip(*b.to_pydict().values())]
        assert sorted(found) == all_runs
