"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

The corpus is encoded once: a slice of documents becomes its distinct word
hashes and the places of its words among them. Word counts come from the
slices' sums; joining them back hands every slice the counts of its own words
only, so no table of the whole vocabulary is ever sent to a worker.

Every word of the training part has a class. The frequent words are classes of
their own; all others belong to one of ``TOPICS`` topic classes, learned from
the documents that hold them: documents are vectors over hashed words, reduced
to their main directions and clustered in rounds over all of them, and a word's
class is the topic it prefers. Within its class a word has its smoothed share
of the counts, so the vocabulary is as large as the corpus makes it.

The model predicts a class from the class of the word before and from the topic
that leads among all words before: their vectors pass through one matrix each,
and the sum meets each class's output vector and bias. Its training data are
the counts of all contexts of the whole training part; numpy draws mini-batches
by them, more of them the more contexts there are, and noise classes by
frequency. Batched matrix products give the normalised log-probabilities of all
contexts at once. A word that the training part lacks may come from any topic:
each keeps a share for one, and the shares are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import give_back, packed, sliced, unpacked
from simloom.scratch import bucketed, materialize, release

#: Classes: words by frequency, then topics of all other words, end of text, start of text.
CLASSES, TOPICS = 256, 24
WORDS = CLASSES - TOPICS - 2
END, START = WORDS + TOPICS, WORDS + TOPICS + 1
#: Leading topics as context; before the first word there is none.
LEADS = TOPICS + 1
SLICE = 4 << 20
SMOOTH = 0.1
#: Hashed words of a document vector, directions kept, rounds of clustering.
BUCKETS, AXES, ROUNDS = 256, 11, 4
#: Training: vector size, mini-batch, least number of them and contexts that ask for one more, noise classes, step.
DIM, BATCH, STEPS, CONTEXTS_A_STEP, NOISE, RATE, SEED = 32, 2048, 600, 400, 48, 0.15, 17
#: Hash that stands for the end of a text.
END_HASH = 0x7E57E4D
#: A word's place in its slice, its topic and its count travel in one number; frequent words' counts travel by themselves.
PLACE_BITS, TOPIC_BITS = 26, 5
PLACE, TOPIC = (1 << PLACE_BITS) - 1, (1 << TOPIC_BITS) - 1
BUCKET_BYTES = 16 << 20


def held_out(doc_id: int | None) -> bool:
    """Documents kept out of training; one without doc_id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part_id, seq = TaskContext.get().partitionId(), 0
    for part, t in sliced(batches, "text", SLICE):
        low = t.lowered()
        start, end, row = low.words()
        h = np.concatenate([low.hashes(start, end), np.full(t.rows, END_HASH, np.uint64)])
        row = np.concatenate([row, np.arange(t.rows)])
        order = np.argsort(row, kind="stable")  # a text's end after its words
        h, row = h[order], row[order]
        kinds, at, times = np.unique(h, return_inverse=True, return_counts=True)
        by_count = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty_like(by_count)
        place[by_count] = np.arange(len(by_count))
        kinds, at = kinds[by_count], place[at]
        ids = part.column("doc_id").to_pylist()
        out = np.array([held_out(d) for d in ids], dtype=bool)
        trained = np.bincount(at[~out[row]], minlength=len(kinds))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part_id << 32 | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([out.tolist()], pa.list_(pa.bool_())),
                pa.array([t.per_row(row)], pa.list_(pa.int64())), pa.array([kinds.view(np.int64)], pa.list_(pa.int64())), pa.array([trained], pa.list_(pa.int64())),
                pa.array([packed(at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
            ],
            names=["slice", "ids", "held", "lengths", "kinds", "trained", "words"],
        )
        seq += 1


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """Each slice: its row, lengths, held flags, word kinds, and the kind of every token."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            at = np.ascontiguousarray(np.frombuffer(unpacked(row.column("words")[0].as_py()), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
            flat = (row.column(n)[0].values.to_numpy(zero_copy_only=False) for n in ("lengths", "held", "kinds"))
            yield row, *flat, at
    give_back()


def _histograms(lengths: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed words in each document; its end is left out."""
    bucket = (kinds.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    words = kinds[at] != END_HASH
    n = np.bincount(row[words] * BUCKETS + bucket[at[words]], minlength=len(lengths) * BUCKETS).reshape(-1, BUCKETS)
    return np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the training documents' vectors, row by row; the last row holds plain sums and their number."""
    total = np.zeros((BUCKETS + 1, BUCKETS + 1))
    for _, lengths, held, kinds, at in _unpacked(batches):
        v = np.c_[_histograms(lengths, kinds, at), np.ones(len(lengths))][~held]
        total += v.T @ v
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(list(map(bytes, total.astype("<f8"))), pa.binary())], names=["i", "v"])


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": frame["i"].iloc[:1], "v": [sum(np.frombuffer(v, "<f8") for v in frame["v"]).tobytes()]})


def _directions(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, main directions and first centres of the documents, from the sums of products."""
    n = max(1.0, moments[-1, -1])
    mean = moments[-1, :-1] / n
    values, vectors = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :AXES]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(AXES)] < 0, -1, 1)
    spread = np.sqrt(np.maximum(values[::-1][:AXES], 0))
    centres = np.concatenate([np.diag(spread), -np.diag(spread), np.zeros((TOPICS, AXES))])[:TOPICS]
    return mean, axes, centres


def _located(batches: Iterator[pa.RecordBatch], mean: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, lengths, held, kinds, at in _unpacked(batches):
        z = ((_histograms(lengths, kinds, at) - mean) @ axes)[~held]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(z[:, k])) for k in range(AXES)], names=[f"z{k}" for k in range(AXES)])


def _nearest(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((z[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        z = np.stack([c.to_numpy() for c in b.columns], axis=1) if b.num_rows else np.zeros((0, AXES))
        yield pa.RecordBatch.from_arrays([pa.array(_nearest(z, centres)), *b.columns], names=["topic", *b.schema.names])


def _topics(coded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, directions and centres that assign documents to topics, from all training documents."""
    parts = coded.mapInArrow(_moments, "i long, v binary").groupBy("i").applyInPandas(_summed, "i long, v binary").collect()
    moments = np.zeros((BUCKETS + 1, BUCKETS + 1))
    for r in parts:  # a row a bucket
        moments[r.i] = np.frombuffer(r.v, "<f8")
    mean, axes, centres = _directions(moments)
    names = [f"z{k}" for k in range(AXES)]
    fields = ", ".join(f"{n} double" for n in names)
    placed = materialize(coded.mapInArrow(partial(_located, mean=mean, axes=axes), fields), "document-vectors")
    for _ in range(ROUNDS):
        near = placed.mapInArrow(partial(_assigned, centres=centres), f"topic long, {fields}")
        for r in near.groupBy("topic").agg(*[F.avg(n).alias(n) for n in names]).collect():  # a row a topic
            centres[r.topic] = [r[n] for n in names]
    release(placed)
    return mean, axes, centres


def _votes(batches: Iterator[pa.RecordBatch], mean: np.ndarray, axes: np.ndarray, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each slice's kinds with their training counts and the topic that holds the largest share of its words in them."""
    for row, lengths, held, kinds, at in _unpacked(batches):
        topic = _nearest((_histograms(lengths, kinds, at) - mean) @ axes, centres)
        use = ~np.repeat(held, lengths)
        of = np.repeat(topic, lengths)[use]
        key, n = np.unique(at[use].astype(np.int64) * TOPICS + of, return_counts=True)
        kind, g = np.divmod(key, TOPICS)
        share = n / np.maximum(np.bincount(of, minlength=TOPICS), 1)[g]
        order = np.lexsort((g, -share, kind))
        first = order[np.r_[True, kind[order][1:] != kind[order][:-1]]] if len(order) else order
        vote = np.zeros(len(kinds), np.int8)
        vote[kind[first]] = g[first]
        yield pa.RecordBatch.from_arrays([row.column("slice"), row.column("kinds"), row.column("trained"), pa.array([vote], pa.list_(pa.int8()))], names=["slice", "kinds", "trained", "votes"])


def _opened(batches: Iterator[pa.RecordBatch], top: np.ndarray, top_counts: np.ndarray):
    """Each slice: row, lengths, held flags, and per token its count, class (WORDS + topic for rare words, -1 if unknown) and topic (-1)."""
    order = np.argsort(top)
    for row, lengths, held, kinds, at in _unpacked(batches):
        known = np.array(row.column("known")[0].values.to_numpy(zero_copy_only=False) if row.column("known")[0].is_valid else [], dtype=np.int64)
        count, topic = np.zeros(len(kinds), np.int64), np.full(len(kinds), -1, np.int64)
        count[known & PLACE], topic[known & PLACE] = known >> (PLACE_BITS + TOPIC_BITS), known >> PLACE_BITS & TOPIC
        cls = np.where(topic >= 0, WORDS + topic, -1)
        if len(top):
            at_top = order[np.minimum(np.searchsorted(top, kinds, sorter=order), len(top) - 1)]
            hit = top[at_top] == kinds
            cls, count = np.where(hit, at_top, cls), np.where(hit, top_counts[at_top], count)
        cls[kinds == END_HASH], topic[kinds == END_HASH] = END, -1
        yield row, lengths, held, count[at], cls[at], topic[at]


def _contexts(cls: np.ndarray, topic: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The topic that leads among all words before each word (of equal ones the smallest), and the class of the word before.

    Before a text stands its start; an unknown word before counts as one of the leading topic.
    """
    first = np.cumsum(lengths) - lengths
    lead = np.empty(len(cls), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    for low in range(0, len(cls), 1 << 16):
        part = slice(low, low + (1 << 16))
        seen = np.zeros((len(cls[part]), TOPICS), np.int32)
        has = np.flatnonzero(topic[part] >= 0)
        seen[has, topic[part][has]] = 1
        total = np.concatenate([np.zeros((1, TOPICS), np.int32), np.cumsum(seen, axis=0, dtype=np.int32)])
        start = np.maximum(first[rows[part]] - low, 0)
        held_over = np.where((first[rows[part]] < low)[:, None], carry[None], 0) if low else 0  # noqa: F821
        before = total[:-1] - total[start] + held_over
        lead[part] = np.where(before.any(axis=1), before.argmax(axis=1), TOPICS)
        last = first[rows[part][-1]]  # what the text that goes on has seen so far
        carry = total[-1] - total[max(last - low, 0)] + (carry if low and last < low else 0)  # noqa: F821
    one = np.full(len(cls), START)
    one[1:] = cls[:-1]
    one[first] = START
    unknown = one < 0
    one[unknown] = WORDS + np.where(lead[unknown] < TOPICS, lead[unknown], 0)
    return lead, one


def _triples(batches: Iterator[pa.RecordBatch], top: np.ndarray, top_counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, lengths, held, _, cls, topic in _opened(batches, top, top_counts):
        lead, one = _contexts(cls, topic, lengths)
        use = ~np.repeat(held, lengths)
        keys, n = np.unique((lead[use] * CLASSES + one[use]) * CLASSES + cls[use], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n)], names=["triple", "n"])


def _by_row(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values that go to each of ``size`` rows."""
    order = np.argsort(rows, kind="stable")
    placed = rows[order]
    first = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
    out = np.zeros((size, *values.shape[1:]), dtype=np.float32)
    out[placed[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class LogBilinear:
    """Scores s(w | a, b) = (P[a] A + R[b] B) . Q[w] + bias[w] for a leading topic a and a class b before."""

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.noise = unigram + 1.0
        self.noise[START] = 1e-12
        self.noise /= self.noise.sum()
        self.params = {
            "P": rng.normal(0, 0.1, (LEADS, dim)), "R": rng.normal(0, 0.1, (CLASSES, dim)), "A": np.eye(dim), "B": np.eye(dim), "Q": rng.normal(0, 0.1, (CLASSES, dim)), "bias": np.log(self.noise),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}
        self.squares = {k: np.full_like(v, 1e-3) for k, v in self.params.items()}
        self.rng = rng

    def predicted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self.params
        return p["P"][a] @ p["A"] + p["R"][b] @ p["B"]

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, noise: int = NOISE, rate: float = RATE) -> float:
        """One NCE mini-batch: tell the words from ``noise`` shared draws of the noise distribution."""
        p, n = self.params, len(w)
        drawn = self.rng.choice(CLASSES, size=noise, p=self.noise)
        r = self.predicted(a, b)
        base = np.log(noise * self.noise).astype(np.float32)
        pos = (r * p["Q"][w]).sum(axis=1) + p["bias"][w] - base[w]
        neg = r @ p["Q"][drawn].T + p["bias"][drawn] - base[drawn]
        g_pos, g_neg = -1 / (1 + np.exp(np.clip(pos, -30, 30))) / n, 1 / (1 + np.exp(-np.clip(neg, -30, 30))) / n
        dr = (g_pos[:, None] * p["Q"][w] + g_neg @ p["Q"][drawn]).astype(np.float32)
        grads = {
            "Q": _by_row(w, g_pos[:, None] * r, CLASSES) + _by_row(drawn, g_neg.T @ r, CLASSES), "bias": _by_row(w, g_pos, CLASSES) + _by_row(drawn, g_neg.sum(axis=0), CLASSES),
            "A": p["P"][a].T @ dr, "B": p["R"][b].T @ dr, "P": _by_row(a, dr @ p["A"].T, LEADS), "R": _by_row(b, dr @ p["B"].T, CLASSES),
        }
        for k, g in grads.items():
            self.squares[k] += g * g
            p[k] -= (rate * g / np.sqrt(self.squares[k])).astype(np.float32)
        return float(np.log1p(np.exp(-np.clip(pos, -30, 30))).mean() + np.log1p(np.exp(np.clip(neg, -30, 30))).sum(axis=1).mean())

    def table(self) -> np.ndarray:
        """Normalised log10 probabilities [a, b, w]; the start of a text is never predicted."""
        a, b = np.divmod(np.arange(LEADS * CLASSES), CLASSES)
        scores = (self.predicted(a, b) @ self.params["Q"].T + self.params["bias"]).astype(np.float64)
        scores[:, START] = -np.inf
        scores -= scores.max(axis=1, keepdims=True)
        return ((scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)).reshape(LEADS, CLASSES, CLASSES)


def train(triples: np.ndarray, counts: np.ndarray, steps: int | None = None) -> LogBilinear:
    """Fit by mini-batches drawn in proportion to the counts of all contexts and classes."""
    left, w = np.divmod(triples, CLASSES)
    a, b = np.divmod(left, CLASSES)
    model = LogBilinear(np.bincount(w, weights=counts, minlength=CLASSES).astype(float))
    steps = STEPS + len(triples) // CONTEXTS_A_STEP if steps is None else steps
    if len(triples):
        share = np.cumsum(counts) / counts.sum()
        for s in range(steps):
            pick = np.minimum(np.searchsorted(share, model.rng.random(BATCH)), len(triples) - 1)
            model.step(a[pick], b[pick], w[pick], rate=RATE * (1 - 0.9 * s / steps))
    return model


def unknown_table(table: np.ndarray, words: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 probability [a, b] of a word that the training part lacks: the shares that all topics keep for one.

    ``words`` and ``kinds``: tokens and distinct words of each topic in the training part.
    """
    kept = SMOOTH / (words + SMOOTH * (kinds + 1))
    return np.log10((10 ** table[:, :, WORDS : WORDS + TOPICS] * kept).sum(axis=2))


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    table, unknown, n_all, v_all, words, kinds, top, top_counts = shared.value
    for row, lengths, held, count, cls, topic in _opened(batches, top, top_counts):
        lead, one = _contexts(cls, topic, lengths)
        base = np.log10((count + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
        score = table[lead, one, cls].astype(np.float64)
        rare = np.flatnonzero((cls >= WORDS) & (cls < END))
        g = cls[rare] - WORDS
        score[rare] += np.log10((count[rare] + SMOOTH) / (words[g] + SMOOTH * (kinds[g] + 1)))
        new = cls < 0
        score[new] = unknown[lead[new], one[new]]
        first = np.cumsum(lengths) - lengths
        ids = row.column("ids")[0].values
        each = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        cols = [ids, pa.array(held), pa.array(lengths), pa.array(each((count > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(lengths), n_all, np.int64)), pa.array(each(base).astype(float)), pa.array(each(score).astype(float))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A text's tokens are its lower-cased words and one end; a null text is the
    end alone. ``base_score`` is the smoothed unigram log10 probability,
    ``score`` the model's. A row without doc_id takes part in training; rows
    that repeat count as often. Whole texts are scored, however long: a text
    and its tokens are held in memory. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "slice long, ids array<long>, held array<boolean>, lengths array<long>, kinds array<long>, trained array<long>, words binary"
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    coded = bucketed(source.mapInArrow(_encode, schema), "slice", buckets, "coded")
    mean, axes, centres = _topics(coded)
    voted = coded.mapInArrow(partial(_votes, mean=mean, axes=axes, centres=centres), "slice long, kinds array<long>, trained array<long>, votes array<tinyint>")
    flat = voted.select(F.explode(F.arrays_zip("kinds", "trained", "votes")).alias("s")).select(F.col("s.kinds").alias("kind"), F.col("s.trained").alias("n"), F.col("s.votes").alias("vote")).where("n > 0")
    totals = materialize(flat.groupBy("kind").agg(F.sum("n").alias("count"), F.max(F.struct("n", "vote"))["vote"].alias("topic")), "counts")
    sums = totals.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    best = totals.where(F.col("kind") != END_HASH).orderBy(F.col("count").desc(), "kind").limit(WORDS).collect()
    top, top_counts = np.array([r.kind for r in best], dtype=np.int64), np.array([r["count"] for r in best], dtype=np.int64)
    ends = totals.where(F.col("kind") == END_HASH).agg(F.max("count")).first()[0] or 0
    least = max(ends, int(top_counts.min()) if len(best) else 0)  # no word outside the frequent ones has more
    used = coded.select("slice", F.posexplode("kinds").alias("place", "kind"))
    place_count = F.shiftleft(F.least("count", F.lit(least).cast("long")), PLACE_BITS + TOPIC_BITS).bitwiseOR(F.shiftleft(F.col("topic").cast("long"), PLACE_BITS)).bitwiseOR(F.col("place").cast("long"))
    known = materialize(used.join(totals, "kind").groupBy("slice").agg(F.collect_list(place_count).alias("known")), "known")
    known = known.withColumnRenamed("slice", "s").hint("shuffle_hash")
    ready = coded.join(known, coded.slice == known.s, "left").select("slice", "ids", "held", "lengths", "kinds", "words", "known")
    triples = ready.mapInArrow(partial(_triples, top=top, top_counts=top_counts), "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).orderBy("triple").toPandas()
    model = train(triples["triple"].to_numpy(np.int64), triples["n"].to_numpy(np.int64))
    rare = totals.where((F.col("kind") != END_HASH) & ~F.col("kind").isin([r.kind for r in best])) if best else totals.where("false")
    words, kinds = np.zeros(TOPICS), np.zeros(TOPICS)
    for r in rare.groupBy("topic").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        words[r.topic], kinds[r.topic] = r.n, r.v
    table = model.table()
    shared = spark.sparkContext.broadcast((table.astype(np.float32), unknown_table(table, words, kinds), sums.n, sums.v, words, kinds, top, top_counts))
    return ready.mapInArrow(partial(_score, shared=shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
