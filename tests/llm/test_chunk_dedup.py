import random

import numpy as np
from simloom.llm import chunk_dedup as cd
from simloom.llm.bytetext import texts

import pyarrow as pa

SCHEMA = "doc_id long, text string"


def cuts(data):
    """Chunk ends by the definition: the gear hash of 16 bytes is smallest within the radius."""
    h = [sum(int(cd._GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFFFFFF for i in range(len(data))]
    h = [int(x) >> 33 for x in cd.mix64(np.array(h, np.uint64))]
    out = [i + 1 for i in range(len(h)) if all(h[i] < x for x in h[max(0, i - cd.RADIUS) : i]) and all(h[i] <= x for x in h[i + 1 : i + 1 + cd.RADIUS])]
    return out if out and out[-1] == len(data) or not data else [*out, len(data)]


def model(rows, min_run=cd.MIN_RUN):
    chunked = []
    for d, t in rows:
        b = (t or "").encode()
        ends = cuts(b)
        chunked.append((d, b, list(zip([0, *ends[:-1]], ends))))
    first = {}
    for d, b, cs in chunked:
        for x, y in cs if d is not None else []:
            first[b[x:y]] = min(first.get(b[x:y], (d, x)), (d, x))
    out = []
    for d, b, cs in chunked:
        gone = [(x, y) for x, y in cs if d is not None and first[b[x:y]] != (d, x)]
        runs = []
        for x, y in gone:
            if runs and runs[-1][1] == x:
                runs[-1][1] = y
            else:
                runs.append([x, y])
        runs = [r for r in runs if r[1] - r[0] >= min_run]
        out.append((d, len(b), len(cs), sum(y - x for x, y in runs), len(runs), ",".join(f"{x}-{y}" for x, y in runs)))
    return sorted(out, key=repr)


def test_boundaries_resist_insertions():
    rnd = random.Random(1)
    s = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    ends = lambda x: set(cd.boundaries(texts(pa.array([x])))[1].tolist())
    assert sorted(ends(s)) == cuts(s.encode())
    assert {e + 5 for e in ends(s) if e > 60} <= ends("12345" + s)


def test_against_model(spark):
    rnd = random.Random(4)
    words = ["thé", "of", "and", "réeux", "tion", "ha", "\n"]
    passages = [" ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(n)) for n in (10, 60, 200)]
    rows = []
    for i in range(80):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choice(words) + str(rnd.randrange(10**6)) for _ in range(rnd.randrange(1, 80))) for _ in range(rnd.randrange(0, 4))]
        rows.append((i, " ".join(parts)))
    rows += [(None, passages[2]), (500, None), (501, ""), (502, "x" * 2000), (503, "x" * 2000), (504, passages[1]), (504, passages[1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", at int").repartition(5)
    assert sorted(map(tuple, cd.chunk_dedup(df).collect()), key=repr) == model(rows)
    kept = {r.doc_id: r.text for r in cd.cleaned(df).collect()}
    assert len(kept[503]) < 64 and kept[502] and cd.cleaned(df).count() == len(rows)


def test_columns_of_any_name_stay(spark):
    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3), (None, None, 1, 2, 3)], SCHEMA + ", key int, runs int, row int")
    got = sorted(map(tuple, cd.cleaned(df).collect()), key=repr)
    assert got[0] == (1, long, 1, 2, 3) and got[1][0] == 2 and len(got[1][1]) < 64 and got[2] == (None, None, 1, 2, 3)


def test_empty(spark):
    assert cd.chunk_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
