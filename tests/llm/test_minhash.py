import random

import brute
import numpy as np
import pytest
from simloom.llm import minhash
from simloom.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string"


def run(spark, rows, **kw):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


@pytest.mark.parametrize("width,num,den", [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, width, num, den):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [[rnd.choice(vocab) for _ in range(n)] for n in (3, 6, 8, 12, 40, 90, 200, 150)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    for i in range(400):
        w = list(rnd.choice(base)) if i % 3 else [rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))] + passage
        for _ in range(rnd.randrange(0, 1 + max(1, len(w) // 25))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            w = w[: -rnd.randrange(1, 3)] or w
        rows.append((i * 3, " ".join(w).title() if i % 2 else "\n".join(w)))
    assert run(spark, rows, width=width, num=num, den=den) == brute.near_duplicates(rows, width, num, den)


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE Two"), (6, "one two three"), (7, "one"), (9, "a b c d"), (None, "a b c d"), (11, "a\u00a0b c d"), (12, "a b c d"), (12, "one two")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, 100).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out)
    # A no-break space (11) parts no words. Rows of one doc_id are one vertex: 12 joins the copies of both its texts.
    assert got == [(0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (9, 2, 4, False), (11, 1, 11, True), (12, 1, 4, False), (12, 2, 4, False)]


def test_empty_table_and_extra_columns(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "x", 2)], "doc_id long, text string, component_id string, n long")
    assert [tuple(r) for r in near_duplicates(df, 3, 85, 100).collect()] == [(1, 1, 1, True)]


def test_large_similar_sets_share_many_runs():
    """The bound behind three common lists: of 4000 pairs at just the asked similarity none comes near it."""
    rng = np.random.default_rng(4)
    runs = lambda s: {tuple(s[i : i + 3]) for i in range(len(s) - 2)}
    found = []
    for _ in range(4000):
        n = int(rng.integers(80, 3000))
        side = n * 75 // 1000
        values = rng.integers(-(2**62), 2**62, n - n * 85 // 100 - 2 * side + n * 85 // 100 + 2 * side)
        shared, a, b = values[: n - 2 * side], values[n - 2 * side : n - side], values[n - side :]
        sketch = lambda own: np.sort(np.concatenate([shared, own]))[: minhash.SKETCH].tolist()  # noqa: B023, E731
        found.append(len(runs(sketch(a)) & runs(sketch(b))))
    assert min(found) >= 10 and 35 < np.mean(found) < 45


def test_open_clusters_are_compared_by_size(spark, monkeypatch):
    """Sets that no star joins still find each other, over blocks and neighbouring sizes."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = base[: rnd.choice([200, 230, 260, 300, 345, 400])] if i % 2 else base[rnd.choice([0, 20, 40, 60]) :]
        for _ in range(rnd.randrange(0, 12)):
            w = [*w]
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, width=3, num=85, den=100) == brute.near_duplicates(rows, 3, 85, 100)


def test_against_sql(spark):
    import oracle
    from simloom.llm import minhash, queries

    oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), queries.op1_minhash_near_dedup, minhash.oracle_sql(), "/root/testdata/sf0.001")
