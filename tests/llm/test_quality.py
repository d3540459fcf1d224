import re
import tracemalloc
from collections import Counter

import oracle
import pyarrow as pa
from simloom.llm import quality

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "\n \t\n", "one", "a b c a b c", "x y\nx y\n\nx y \nz", "A" * 300, "é ü " * 40, "w%% " * 60, "\n".join(f"l{i} m n o" for i in range(20)), "LOUD " * 30 + " ".join(f"q{i}" for i in range(30)), "a b \x0b\x0c c"]


def model(text):
    text = text or ""
    b = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(b[i : i + 3]) for i in range(len(b) - 2))
    covered = {i + j for i in range(len(b) - 2) if wins[tuple(b[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(b), sum(map(len, b)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_ledger(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b c a b c", "x"), (3, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    led = quality.judged(df).collect()
    got = sorted(((r.doc_id, *[r[m] for m in quality.MEASURES[:5]]) for r in led), key=repr)
    assert got == sorted(((d, *model(t)) for d, t, _ in rows), key=repr)
    for r in led:
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.kept or not r.base_failed)
    accepted = quality.accepted(df)
    assert accepted.columns == df.columns and accepted.count() == sum(r.kept for r in led)
    assert quality.ledger(df.limit(0)).count() == 0


def test_ablations(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    led = quality.ledger(df)
    policy = quality.POLICIES["strict"]
    got = {r.rule: (r.failing, r.only_this) for r in quality.ablations(led, policy).collect()}
    bits, order = [r.failed_rules for r in led.collect()], list(quality.RULES)
    assert got == {r: (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits)) for i, r in enumerate(order)}


def test_policies_are_masks_of_one_ledger(spark):
    texts = ["- a\n- b\n* c\n+ d", "1 2 3 4 5 x", "a b c", " ".join(f"w{i}x" for i in range(60)), "\n".join(f"- word{i} and more of it" for i in range(12)), "7 " * 3 + "12345678 " * 60]
    led = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    order, by = list(quality.RULES), {r.doc_id: r for r in led}
    failed = lambda i: {order[b] for b in range(len(order)) if by[i].failed_rules >> b & 1}
    assert failed(0) == {"few_words", "bullets", "short_words", "symbols"} and failed(1) >= {"digits"} and failed(3) == set() and failed(4) == {"bullets", "repeated_windows"}
    assert [p.mask for p in (quality.POLICIES["base"], quality.POLICIES["default"], quality.POLICIES["strict"])] == [3, 63, 511]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(60)), 1, 2, 3, 4)], "doc_id long, text string, row int, failed_rules int, n_words int, `a.b` int")
    assert [tuple(r) for r in quality.accepted(df).collect()] == [tuple(r) for r in df.collect()]


def test_against_sql(spark):
    from simloom.llm import queries

    oracle.compare(spark, oracle.connect(SF), queries.op4_quality_rules, quality.ORACLE, SF)


def test_memory_of_a_batch():
    """The arrays beside a batch of short texts are bounded by a slice, not by the batch."""
    texts = [f"w{i} " * 5 + "lorem ipsum dolor sit amet " * 20 for i in range(4000)]
    rows = pa.StructArray.from_arrays([pa.array(texts)], names=["text"])
    batch = pa.RecordBatch.from_arrays([rows], names=["row"])
    tracemalloc.start()
    words = sum(sum(part.column("n_words").to_pylist()) for part in quality._measured(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 105 * 4000 and peak < 40_000_000
