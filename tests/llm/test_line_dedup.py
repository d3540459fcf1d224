import hashlib
import random
import re

import corpus_pipeline
import oracle
from simloom.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def model(rows, m=2):
    seqs = []
    for d, t in rows:
        lines = (t or "").split("\n")
        seqs.append((d, lines, [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]))
    first = {}
    for d, lines, at in seqs:
        for k in range(len(at) - m + 1 if d is not None else 0):
            w = tuple(lines[i] for i in at[k : k + m])
            first[w] = min(first.get(w, (d, k)), (d, k))
    out = []
    for d, lines, at in seqs:
        gone = set()
        for k in range(len(at) - m + 1 if d is not None else 0):
            if first[tuple(lines[i] for i in at[k : k + m])] < (d, k):
                gone |= set(range(k, k + m))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in {at[k] for k in gone})
        out.append((d, len(at), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(5, "a\nb\nc\nd"), (1, "x\na\nb\n\ny"), (2, "a\nb\nc"), (3, None), (4, ""), (None, "a\nb"), (7, "q\nq\nq\nq"), (8, "\n \n"), (9, "x\n\n\na\nb\nc\nd\nzz"), (10, "one line"), (11, "one line"), (12, "a\r\nb"), (13, "L" * 5000 + "\nb\nc")]


def test_against_model(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], SCHEMA + ", lines string")
    for m in (1, 2, 3, 5):
        assert sorted(map(tuple, line_dedup.line_dedup(df, m).collect()), key=repr) == model(ROWS, m), m


def random_rows(seed):
    rnd = random.Random(seed)
    block = lambda: [rnd.choice("abcdef") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 12))]
    shared = [block() for _ in range(4)]
    return [(d, "\n".join(x for _ in range(rnd.randrange(0, 4)) for x in (rnd.choice(shared) if rnd.random() < 0.6 else block()))) for d in range(40)]


def test_random_texts_against_model(spark):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for m in (2, 3):
        assert sorted(map(tuple, line_dedup.line_dedup(df, m).collect()), key=repr) == model(rows, m), m


def test_runs_have_exact_common_prefixes_and_are_maximal(spark):
    rows = random_rows(4) + [(100 + i, "\n".join(f"line {j}" for j in range(37))) for i in range(3)]
    lines = {d: t.split("\n") for d, t in rows}
    places = line_dedup.materialize(line_dedup.line_places(spark.createDataFrame(rows, SCHEMA)), "lines")
    levels = line_dedup.suffix_levels(places)
    assert [d for d, _ in levels][:3] == [1, 2, 4] and levels[-1][0] >= 32 and levels[-1][1].count() > 0
    runs = [(r.doc_id, r.k, r.lcp, r.first.doc_id, r.first.k) for r in line_dedup.maximal_runs(levels).collect()]
    for d, k, n, e, f in runs:
        assert (e, f) < (d, k)
        a, b = lines[d][k:], lines[e][f:]
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) >= 2
        assert not any(d2 == d and (k2, n2) != (k, n) and k2 <= k and k2 + n2 >= k + n for d2, k2, n2, _, _ in runs)
    assert {(101, 0, 37, 100, 0), (102, 0, 37, 100, 0)} <= set(runs)


def test_cleaned_keeps_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a\nb", 7), (2, "a\nb", 8), (2, "a\nb", 8), (3, "", 9)], SCHEMA + ", rank int")
    assert sorted(map(tuple, line_dedup.cleaned(df).collect())) == [(1, "a\nb", 7), (3, "", 9)]
    odd = spark.createDataFrame([(1, "a\nb", 7, 1, 2), (2, "c\na\nb", 8, 1, 2), (3, None, 9, 1, 2)], SCHEMA + ", key int, lines int, row int")
    assert sorted(map(tuple, line_dedup.cleaned(odd).collect())) == [(1, "a\nb", 7, 1, 2), (2, "c", 8, 1, 2), (3, None, 9, 1, 2)]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = queries.op6_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_against_sql(spark):
    oracle.compare(spark, oracle.connect(SF), queries.op6_line_dedup, line_dedup.ORACLE, SF)


def test_a_long_single_line_goes_in_the_pipeline(spark):
    words, glued = " ".join(f"w{i}" for i in range(51)), "x" * 401
    rows = [(1, f"a\n{words}\nb"), (2, f"c\n{words}\nd"), (3, words), (4, f"{glued}\ne"), (5, f"f\n{glued}"), (6, "short"), (7, "short"), (8, f"{words} more"), (9, f"g\n\n{words}\n{words}\na")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [rows[0], (2, "c\nd"), rows[3], (5, "f"), rows[5], rows[6], rows[7], (9, "g\n\na")]
    assert sorted(map(tuple, corpus_pipeline.dedup_lines(spark, df, SF).collect())) == want
    assert [(r.doc_id, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(df, long_lines=True).collect() if r.n_removed] == [(2, 1, 1), (3, 1, 1), (5, 1, 1), (9, 2, 1)]
