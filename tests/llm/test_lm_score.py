import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
from simloom.llm import lm_score as lm

SCHEMA = "doc_id long, text string"


def test_base_and_counts(spark):
    rows = [(i, t) for i, t in enumerate(["The cat", "the dog the", None, "", "a b The", "x " * 700, "dog", "cat cat", "q", "r s t"] * 3)] + [(None, "no id"), (4, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int").repartition(3)
    out = lm.lm_scores(df).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update([*brute.words(t), "END"])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        tokens = [*brute.words(t), "END"]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((d, held(d), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(*tuple(r)[:5], round(r.base_score, 6)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm.lm_scores(df.limit(0)).count() == 0


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    follow = rng.permutation(40)
    w = [0, 1]
    for _ in range(30000):
        w.append(int(follow[w[-1]]) if rng.random() < 0.7 else int(rng.integers(40)))
    w = np.array(w)
    lead = np.arange(len(w) - 1) // 10000
    keys, n = np.unique((lead * lm.CLASSES + w[:-1]) * lm.CLASSES + w[1:], return_counts=True)
    table = lm.train(keys, n, 900).table()
    assert np.allclose((10**table).sum(axis=2), 1)
    uniform = -math.log10(40)
    assert table[lead, w[:-1], w[1:]].mean() > uniform * 0.65


def test_all_words_and_one_unknown_share_a_whole():
    """Frequent words, the words of each topic, the end and any word not met add up to 1 in every context."""
    rng = np.random.default_rng(3)
    keys, n = np.unique(rng.integers(0, lm.LEADS * lm.CLASSES * lm.CLASSES, 5000), return_counts=True)
    table = lm.train(keys[keys % lm.CLASSES != lm.START], n[keys % lm.CLASSES != lm.START], 50).table()
    counts = [rng.integers(1, 50, rng.integers(0, 30)) for _ in range(lm.TOPICS)]
    words, kinds = np.array([c.sum() for c in counts], float), np.array([len(c) for c in counts], float)
    unknown = lm.unknown_table(table, words, kinds)
    inside = np.array([((c + lm.SMOOTH) / (m + lm.SMOOTH * (v + 1))).sum() for c, m, v in zip(counts, words, kinds)])
    total = (10 ** table[:, :, : lm.WORDS]).sum(axis=2) + (10 ** table[:, :, lm.END]) + (10 ** table[:, :, lm.WORDS : lm.END] * inside).sum(axis=2) + 10**unknown
    assert np.allclose(total, 1)


def test_contexts_look_back_only():
    rnd = random.Random(7)
    lengths = np.array([rnd.choice([1, 2, 5, 900, 70_000]) for _ in range(12)])
    topic = np.array([rnd.choice([-1, 0, 1, 2, 2, 5]) for _ in range(lengths.sum())])
    cls = np.where(topic < 0, -1, lm.WORDS + topic)
    lead, one = lm._contexts(cls, topic, lengths)
    at = 0
    for n in lengths:
        seen = Counter()
        for i in range(at, at + n):
            want = min(seen, key=lambda g: (-seen[g], g)) if seen else lm.TOPICS
            assert lead[i] == want
            assert one[i] == (lm.START if i == at else cls[i - 1] if cls[i - 1] >= 0 else lm.WORDS + (want if want < lm.TOPICS else 0))
            if topic[i] >= 0:
                seen[int(topic[i])] += 1
        at += n


def test_held_out_accuracy(spark):
    rnd = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(f"the {rnd.choice(nouns)} {rnd.choice(verbs)} a {rnd.choice(nouns)}" for _ in range(rnd.randrange(3, 30)))) for i in range(400)]
    out = [r for r in lm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert len(out) > 15 and sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_topics_tell_languages_apart(spark):
    rnd = random.Random(5)
    tongue = lambda k: [f"{k}{rnd.choice('abcdefgh')}{rnd.choice('mnopqrst')}{i}" for i in range(400)]
    tongues = [tongue(k) for k in "xyz"]
    rows = [(i, " ".join(rnd.choice(tongues[i % 3][: rnd.choice([20, 400])]) for _ in range(rnd.randrange(20, 90)))) for i in range(600)]
    out = [r for r in lm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    gain = 1 - sum(r.score for r in out) / sum(r.base_score for r in out)
    assert len(out) > 30 and gain > 0.12  # a third of the words in a text's language: 0.48 of about 2.5
