import hashlib
import random

import numpy as np
import pytest
from simloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"


def model(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                k = b[i : i + 50]
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49 if d is not None else 0):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_deep_shallow_sorts():
    rnd = random.Random(3)
    pool = [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(6)]
    buf = np.frombuffer(b"".join(rnd.choice(pool)[: rnd.randrange(20, 60)] for _ in range(80)), dtype=np.uint8)
    starts = np.arange(len(buf) - 49)
    order, same = sd.deep_shallow(buf, starts)
    strings = [buf[s : s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


@pytest.mark.parametrize("words", [4, 40, 400])
def test_blind_trie(words):
    rnd = random.Random(words)
    strings = list({bytes(rnd.choice(b"xyz") for _ in range(12)) for _ in range(words)})
    assert [strings[i] for i in sd.BlindTrie(strings).order()] == sorted(strings)


def test_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["thé", "of", "and", "réeux", "ing", "tion", "ha", "\n", "st"]
    passages = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (8, 14, 20, 60, 300)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                parts.append(p[a : a + rnd.randrange(20, 400)])
            else:
                parts.append(" ".join(rnd.choice(vocab) + str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 60))))
        rows.append((rnd.randrange(90), " ".join(parts)))
    rows += [(None, passages[3]), (5, None), (6, ""), (7, "x" * 3000), (3, "x" * 200), (8, "x" * 49), (9, "x" * 50), (200, passages[4]), (200, passages[4])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_bytes int").repartition(7)
    assert sorted(map(tuple, sd.suffix_dedup(df).collect()), key=repr) == model(rows)


def test_empty(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    out = sd.suffix_dedup(spark.createDataFrame([(2, "y" * 60), (1, "y" * 60)], SCHEMA), with_texts=True).collect()
    assert {(r.doc_id, r.kept_text) for r in out} == {(1, "y" * 60), (2, "")}


def test_against_sql(spark):
    import oracle
    from simloom.llm import suffix_dedup, queries

    oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), queries.op9_suffix_dedup, suffix_dedup.ORACLE, "/root/testdata/sf0.001")
