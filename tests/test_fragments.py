import random

import pytest
from simloom.functions.similarity import lcs_similarity
from simloom.operators import clones, fragments
from simloom.operators.components import connected_components


def tokens(spark, files):
    return spark.createDataFrame(list(files.items()), "file long, tokens array<string>")


def pairs_model(files, w):
    wins = [(f, s, tuple(t[s : s + w])) for f, t in sorted(files.items()) for s in range(len(t) - w + 1)]
    return sorted((f1, s1, f2, s2) for i, (f1, s1, a) in enumerate(wins) for f2, s2, b in wins[i + 1 :] if a == b and (f1 != f2 or s2 - s1 >= w))


def runs_model(pairs, w):
    out = []
    for p in sorted(pairs, key=lambda p: (p[0], p[2], p[1], p[3])):
        if out and out[-1][0] == (p[0], p[2]) and (out[-1][2] + 1, out[-1][4] + 1) == (p[1], p[3]):
            out[-1][2], out[-1][4], out[-1][5] = p[1], p[3], out[-1][5] + 1
        else:
            out.append([(p[0], p[2]), p[1], p[1], p[3], p[3], 1])
    return sorted((f[0], s1, e1 + w - 1, f[1], s2, e2 + w - 1, w + n - 1) for f, s1, e1, s2, e2, n in out)


def dedup_model(runs):
    kept, hit = [], lambda a, b, c, d: max(a, c) <= min(b, d)
    for r in sorted(runs, key=lambda r: (r[0], r[3], r[1], r[4], -r[6])):
        if not any(k[0] == r[0] and k[3] == r[3] and hit(k[1], k[2], r[1], r[2]) and hit(k[4], k[5], r[4], r[5]) for k in kept):
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_runs_dedup(spark, seed):
    rnd = random.Random(seed)
    files = {f: [rnd.choice("abc") for _ in range(rnd.randrange(0, 45))] for f in range(5)}
    w = 5
    df = tokens(spark, files)
    pairs = fragments.window_pairs(df, w)
    want = pairs_model(files, w)
    assert sorted(map(tuple, pairs.collect())) == want
    runs = fragments.merge_runs(pairs, w)
    assert sorted(map(tuple, runs.collect())) == runs_model(want, w)
    apart = [r for r in runs_model(want, w) if r[0] != r[3] or max(r[1], r[4]) > min(r[2], r[5])]
    assert sorted(map(tuple, fragments.greedy_dedup(fragments.drop_self_overlaps(runs)).collect())) == dedup_model(apart)


def test_near_blocks(spark):
    rnd = random.Random(4)
    base = [f"t{rnd.randrange(40)}" for _ in range(60)]
    files = {}
    for f in range(8):
        t = list(base)
        for _ in range(rnd.randrange(0, 12)):
            t[rnd.randrange(len(t))] = f"n{rnd.randrange(30)}"
        files[f] = t
    size, threshold, q = 20, 0.7, 3
    blocks = [(f, s, t[s : s + size]) for f, t in files.items() for s in range(0, len(t) - size + 1, size // 2)]

    def jac(a, b):
        from collections import Counter

        x, y = (Counter(tuple(v[i : i + q]) for i in range(size - q + 1)) for v in (a, b))
        return sum((x & y).values()) / sum((x | y).values())

    want = sorted(
        (f1, s1, f2, s2, round(sim, 6))
        for i, (f1, s1, a) in enumerate(blocks)
        for f2, s2, b in blocks[i + 1 :]
        if (f1 != f2 or abs(s1 - s2) >= size) and jac(a, b) >= 0.7 * threshold and threshold <= (sim := lcs_similarity(a, b)) < 1
    )
    got = [(r.f1, r.s1, r.f2, r.s2, round(r.similarity, 6)) for r in fragments.near_blocks(tokens(spark, files), size, threshold, q).collect()]
    assert len(want) > 20 and sorted(g if g[:2] < g[2:4] else (*g[2:4], *g[:2], g[4]) for g in got) == want


def test_near_blocks_of_copies(spark, monkeypatch):
    """Contents are compared once whatever their copies, no words are written, and no pair of places is lost."""
    rnd = random.Random(8)
    one = [f"a{rnd.randrange(10**6)}" for _ in range(20)]
    two, far = [*one[:17], "x", "y", "z"], [f"b{i}" for i in range(20)]
    files = {i: (one, two)[i % 2] if i < 24 else far for i in range(26)}
    written, keep = [], fragments.materialize

    def watched(df, name):
        back = keep(df, name)
        written.append((name, back.count(), [t for _, t in back.dtypes]))
        return back

    monkeypatch.setattr(fragments, "materialize", watched)
    got = fragments.near_blocks(tokens(spark, files), 20, 0.7).collect()
    assert sorted((min(r.f1, r.f2), max(r.f1, r.f2)) for r in got) == sorted((i, j) for i in range(24) for j in range(i + 1, 24) if (i + j) % 2)
    assert {round(r.similarity, 6) for r in got} == {0.85} and all((r.s1, r.s2) == (0, 0) for r in got)
    assert not any(t.startswith("array<string") for _, _, types in written for t in types)
    assert all(n <= len(files) for _, n, _ in written)
    assert fragments.near_blocks(tokens(spark, {1: ["a"], 2: []}), 20, 0.7).count() == 0


def test_near_miss_methods(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        s = [f"s{rnd.randrange(8)}" for _ in range(rnd.choice([4, 5, 6, 9, 10]))] if i % 2 else [f"s{k}" for k in range(10)][: rnd.randrange(7, 11)] + [f"s{rnd.randrange(4)}"]
        rows.append((i, s))
    from collections import Counter

    want = []
    for i, a in rows:
        for j, b in rows:
            if i < j and "|".join(a) != "|".join(b) and max(len(a), len(b)) <= 1.25 * min(len(a), len(b)):
                x, y = Counter(a), Counter(b)
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= 0.8:
                    want.append((i, j, round(sim, 6)))
    got = clones.near_miss_pairs(spark.createDataFrame(rows, "seq long, stmts array<string>"), 0.8).collect()
    assert want and sorted((r.a, r.b, round(r.similarity, 6)) for r in got) == sorted(want)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(3, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in got} == {v: find(v) for v in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_reject_bad_size(spark):
    with pytest.raises(ValueError):
        fragments.windows(tokens(spark, {1: ["a"]}), 0)


def test_rolling_hash_slides():
    """Every window's hash is that of the window by itself, whatever its size."""
    ids = fragments.np.array([5, 12, 7, 99, 3, 42, 7, 99, 3, 10**12], dtype="int64")
    for size in (1, 2, 3, 5, 7, 8, 10, 11):
        for base, mod in fragments.ROLLING:
            want = []
            for i in range(len(ids) - size + 1):
                h = 0
                for x in ids[i : i + size].tolist():
                    h = (h * base + x) % mod
                want.append(h)
            assert fragments.rolling_hashes(ids, size, base, mod).tolist() == want
    with pytest.raises(ValueError):
        fragments.rolling_hashes(ids, 0, 131, 7)


def test_window_names_and_counts(spark):
    rnd = random.Random(6)
    files = {f: [rnd.choice("ab") for _ in range(rnd.randrange(0, 30))] for f in range(6)}
    df, w = tokens(spark, files), 4
    named = {}
    for r in fragments.hashed_windows(df, w).collect():
        text = tuple(files[r.file][r.start : r.start + w])
        assert len(text) == w and named.setdefault((r.h, r.h2), text) == text
    assert len(set(named.values())) == len(named)
    counts = {}
    for f1, s1, f2, _ in pairs_model(files, w):
        n, lo = counts.get((f1, f2), (0, s1))
        counts[f1, f2] = n + 1, min(lo, s1)
    assert {(r.f1, r.f2): (r.pairs, r.first_start) for r in fragments.window_pair_counts(df, w).collect()} == counts
    with pytest.raises(ValueError):
        fragments.hashed_windows(df, 0)


def test_first_pairs_links_and_counts(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("uvwx"), rnd.choice(["c1", "c2", "c3", f"own{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, key string, content string")
    bucket = {}
    for s, _, c in rows:
        bucket.setdefault(c, s)
    pairs = sorted((bucket[c1], s1, s2, "|".join(sorted((k1, k2)))) for i, (s1, k1, c1) in enumerate(rows) for s2, k2, c2 in rows[i + 1 :] if c1 == c2)
    first, alone = {}, {}
    for b, s1, s2, k in pairs:
        first.setdefault(k, (b, s1, s2))
        alone[k] = min(alone.get(k, (s1, s2)), (s1, s2))
    assert {r.key: (r.bucket, r.a, r.b) for r in clones.first_pairs(df).collect()} == first
    assert {r.key: (r.a, r.b) for r in clones.first_pairs(df, by_content=False).collect()} == alone
    by = {}
    for _, s1, _, _ in pairs:
        by[rows[s1][1]] = by.get(rows[s1][1], 0) + 1
    assert {r.key: r.pairs for r in clones.exact_pair_counts(df, "key").collect()} == by
    labels = {r.vertex: r.component for r in connected_components(clones.exact_links(df)).collect()}
    assert labels == {s: bucket[c] for s, _, c in rows if sum(c == x[2] for x in rows) > 1}
