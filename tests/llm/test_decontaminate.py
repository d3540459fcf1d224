import pickle
import random
from collections import Counter
from types import SimpleNamespace

import brute
import pyarrow as pa
from simloom.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def model(docs, items, num=80, den=100):
    out = []
    for d, t in docs:
        w, found = brute.words(t), set()
        for i, x in items:
            q = brute.words(x)
            if not q or i is None:
                continue
            k, n = min(5, len(q)), min(len(q), len(w))
            want = grams(q, k)
            for s in range(len(w) - n + 1):
                have = grams(w[s : s + n], k)
                least = sum((have & want).values())
                if least and least * den >= num * (sum(have.values()) + sum(want.values()) - least):
                    found.add(i)
                    break
        out.append((d, bool(found), len(found), ",".join(map(str, sorted(found)))))
    return sorted(out, key=repr)


def data():
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(rnd.randrange(15, 58)))) for i in range(25)]
    items += [(30, "short item here"), (31, None), (32, " "), (None, items[0][1]), (33, "aa bb aa bb aa bb aa bb aa bb aa bb"), (34, items[1][1])]
    docs = [(900, None), (901, ""), (902, "a SHORT\nItem here b"), (903, "aa bb " * 40), (None, items[2][1]), (904, items[3][1].upper()), (905, " ".join(items[4][1].split()[:-2]))]
    for d in range(150):
        w = make(rnd.randrange(1, 300))
        if d % 2:
            x = rnd.choice(items[:25])[1].split()
            for _ in range(rnd.randrange(0, 4)):
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                x.insert(rnd.randrange(len(x)), "new")
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, ("\n" if d % 3 else " ").join(w)))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], DOCS + ", n_items int, items int").repartition(4)
    bench = spark.createDataFrame(items, ITEMS)
    want = model(docs, items)
    assert sum(r[1] for r in want) > 20
    assert sorted(map(tuple, dc.contamination(df, bench).collect()), key=repr) == want
    monkeypatch.setattr(dc, "ITEMS_A_PASS", 7)  # several passes give the same
    assert sorted(map(tuple, dc.contamination(df, bench).collect()), key=repr) == want
    assert dc.clean(df, bench).columns == df.columns
    assert sorted(str(r.doc_id) for r in dc.clean(df, bench).collect()) == sorted(str(r[0]) for r in want if not r[1])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in dc.contamination(docs, items.limit(0)).collect()] == [(1, False, 0, "")]
    assert [tuple(r) for r in dc.contamination(docs, items).collect()] == [(1, True, 1, "1")]


def test_a_worker_never_takes_another_item_set():
    """Tasks unpickle their items to addresses that were in use before, as in a worker that lives on."""
    words = ["one two three four five six", "seven eight nine ten eleven twelve"]
    blobs = [pickle.dumps(dc._Packed(SimpleNamespace(value=([i], [w])), True)) for i, w in enumerate(words)]
    batch = pa.RecordBatch.from_pydict({"row": [{"doc_id": i, "text": w} for i, w in enumerate(words)]})
    for step in range(40):
        packed = pickle.loads(blobs[step % 2])
        got = [x for b in dc._scan(iter([batch]), packed, 80, 100) for x in b.column("items").to_pylist()]
        assert got == ([[0], []] if step % 2 == 0 else [[], [1]]), step
        del packed


def test_index_finds_all_within_the_radius_and_what_is_similar():
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [make(rnd.randrange(12, 90)) for _ in range(300)]
    index = dc.Index(list(range(300)), [" ".join(x) for x in items])
    near, prints = [], []
    for i in rnd.choices(range(300), k=3000):
        x = list(items[i])
        for _ in range(rnd.randrange(1, 3)):
            x[rnd.choice([0, 1, 2, -1, -2, -3, rnd.randrange(len(x))])] = rnd.choice(vocab)
        have, want = grams(x, 5), grams(items[i], 5)
        least = sum((have & want).values())
        if 0.8 <= least / (sum(have.values()) + sum(want.values()) - least) < 0.9:
            near.append(i)
            prints.append(dc.Index([0], [" ".join(x)]).prints[0])
    prints = dc.np.array(prints, dtype=dc.np.uint64)
    w, k, d = index.within(prints)
    assert len(near) > 300 and sum(i in set(k[w == j].tolist()) for j, i in enumerate(near)) >= 0.98 * len(near)
    brute_force = {(j, i) for j, p in enumerate(prints.tolist()) for i, q in enumerate(index.prints.tolist()) if bin(p ^ q).count("1") <= dc.RADIUS}
    assert set(zip(w.tolist(), k.tolist())) == brute_force
    some = dc.np.array([rnd.getrandbits(64) for _ in range(500)], dtype=dc.np.uint64)
    looked_at = sum(int((cut[v + 1] - cut[v]).sum()) for b, (cut, _) in enumerate(index.lists) for v in [dc._block(some, b)])
    assert looked_at < 0.25 * 500 * 300  # an unrelated print meets few items


def test_against_sql(spark):
    import oracle
    from simloom.llm import decontaminate, queries

    oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), queries.op10_decontamination, decontaminate.ORACLE, "/root/testdata/sf0.001")
