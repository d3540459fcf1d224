"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its
encoding: the longest-known candidates are tried, and a candidate stands when
the token that ends the remaining shorter prefix may legally precede it (no
merge crosses their border before both are whole). The table of last tokens
is all the state there is, so bytes can be appended exactly, and the encoding
is read off backwards. ``EditableText`` re-splits and re-encodes only the
pieces around an edit.

Texts are split by the tokenizer's pattern first. The pieces of a slice that
were not met before go through the same table together: ``PieceTable`` extends
all their prefixes by one byte at a time in numpy, and whether a token may
follow another is decided once a pair. A worker keeps the encodings of the
pieces it has met, up to a bound that limits memory and nothing else.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import Texts, give_back, texts

#: Pieces and token pairs a worker remembers before it starts over.
REMEMBERED = 100_000
#: Characters of text that are split and looked up together.
SLICE_CHARS = 500_000
#: New pieces that go through the table together: its arrays take some hundred bytes a byte of them.
PIECES = 16_384
#: Longer pieces (bytes) are encoded one by one.
TOGETHER = 24
_NONE = 1 << 60


class PrefixEncoder:
    """Encoder over ``ranks`` (token bytes -> id); every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self._edges: dict[int, tuple[list[bytes], list[bytes]] | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain lowest-rank-first merging, down to ``stop`` parts: the definition everything else is checked against."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > stop:
            found = [rank(x + y, _NONE) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == _NONE:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list[bytes], list[bytes]] | None:
        """Parts at the token's left and right edge while it is merged from bytes, smallest first; None if merging never makes it."""
        known = self._edges.get(token, _NONE)
        if known is _NONE:
            data = self.tokens[token]
            parts = [data] if len(data) == 1 else self.merged(data, 2)
            if len(data) == 1:
                known = [data], [data]
            elif len(parts) != 2 or self.merged(data) != [data] or None in (ends := [self.edges(self.ranks[p]) for p in parts]):
                known = None
            else:
                known = [*ends[0][0], data], [*ends[1][1], data]
            self._edges[token] = known
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Whether nothing merges across the border of the two tokens before each of them is whole."""
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        rank, a, b, i, j = self.ranks.get, a[1], b[0], 0, 0
        while True:
            across = rank(a[i] + b[j], _NONE)
            next_a = rank(a[i + 1]) if i + 1 < len(a) else _NONE
            next_b = rank(b[j + 1]) if j + 1 < len(b) else _NONE
            if across < next_a and across <= next_b and across != _NONE:  # of equal ranks the leftmost merges first
                return False
            if next_a == next_b == _NONE:
                return True
            if next_a <= next_b:
                i += 1
            if next_b <= next_a:
                j += 1

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may come directly after ``left``; ``left`` -1 stands for the start."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            known = self.edges(right) is not None if left < 0 else self._stays(left, right)
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def extend(self, last: list[int], data: bytes, start: int) -> None:
        """Append to ``last`` the final token of each prefix of ``data`` longer than ``start``.

        The automaton yields, for each end, the tokens that end there.
        """
        pairs, follows, base = self._pairs, self.follows, max(0, start - self.longest)
        have = start
        for end, (token, size) in self.automaton.iter(data[base:].decode("latin-1")):
            end += base + 1
            if end <= have:
                continue
            if end > have + 1:
                break
            at = end - size
            left = last[at - 1] if at else -1
            stands = pairs.get(left << 32 | token)
            if stands or stands is None and follows(left, token):
                last.append(token)
                have = end
        if have < len(data):
            raise ValueError(f"no token ends the prefix of {have + 1} bytes")

    def read(self, last: list[int]) -> list[int]:
        """The token ids that a table of last tokens stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(last, piece, 0)
        return self.read(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """A growing piece with its table of last tokens."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        start, self.data = len(self.data), self.data + data
        self.encoder.extend(self.last, self.data, start)

    def truncate(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length:]

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder.read(self.last)


class EditableText:
    """A text with its encoding; edits re-encode the pieces they touch."""

    def __init__(self, encoder: PrefixEncoder, pattern: str, text: str = "") -> None:
        self.encoder, self.pattern = encoder, regex.compile(pattern)
        self.text, self.starts, self.ids = "", [], []
        self.replaced = 0
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[start:end]."""
        old_starts, shift = self.starts, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        ends = [*old_starts[1:], len(self.text) - shift]
        first = bisect.bisect_left(ends, start) if old_starts else 0  # a piece that ends at the edit has looked beyond its end
        at = old_starts[first] if first < len(old_starts) else len(self.text) - len(new) if not old_starts else start
        known = {s + shift: i for i, s in enumerate(old_starts) if s >= end and i > first}
        starts, ids, resume = [], [], len(old_starts)
        for m in self.pattern.finditer(self.text, at):
            if m.start() in known:
                resume = known[m.start()]
                break
            starts.append(m.start())
            ids.append(self.encoder.encode(m[0].encode()))
        self.replaced = len(ids)
        self.starts = old_starts[:first] + starts + [s + shift for s in old_starts[resume:]]
        self.ids = self.ids[:first] + ids + self.ids[resume:]

    def flat(self) -> list[int]:
        return list(chain.from_iterable(self.ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Hashed:
    """Numbers under 64-bit keys, looked up by whole arrays (open addressing)."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        bits = max(10, max(len(keys), room).bit_length() + 1)
        self.shift, self.mask, self.used = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, self.FREE), np.full(1 << bits, -1, np.int32)
        self.add(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put distinct new keys."""
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.used += len(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] == self.FREE]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value under each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != self.FREE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != self.FREE)]
        return out


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.int64) + 1) << 32 | right.astype(np.int64)).view(np.uint64)


def table_of(encoder: PrefixEncoder) -> dict[str, np.ndarray]:
    """The vocabulary as arrays: edge parts of every token (smallest first, -1 past the end) and the token of every two that join."""
    size = max(encoder.tokens) + 1
    edges = {i: encoder.edges(i) for i in encoder.tokens}
    deep = max((len(side) for e in edges.values() if e for side in e), default=0) + 1
    out = {"left": np.full((size, deep), -1, np.int32), "right": np.full((size, deep), -1, np.int32)}
    for i, e in edges.items():
        for name, side in zip(("left", "right"), e or ([], []), strict=True):
            out[name][i, : len(side)] = [encoder.ranks[p] for p in side]
    rank, joined = encoder.ranks.get, []
    for t, i in encoder.ranks.items():
        for k in range(1, len(t)):
            a, b = rank(t[:k]), rank(t[k:])
            if a is not None and b is not None:
                joined.append((a, b, i))
    out["joined"] = np.array(joined, dtype=np.int32).reshape(-1, 3)
    return out


class PieceTable:
    """Tables of last tokens of many pieces at once; the same results as ``PrefixEncoder``."""

    def __init__(self, ranks: dict[bytes, int], table: dict[str, np.ndarray]) -> None:
        self.left, self.right = table["left"], table["right"]
        a, b, c = table["joined"].T
        self.joined = _Hashed(_pair(a, b), c)
        tokens = list(ranks)
        t = texts(pa.array(tokens, pa.binary()))
        self.size = np.zeros(len(self.left), np.int64)
        self.size[list(ranks.values())] = np.diff(t.off)
        self.ids = _Hashed(t.hashes(t.off[:-1], t.off[1:]), np.array(list(ranks.values()), np.int32))
        self.longest = max(map(len, tokens))
        self._forget()

    def _forget(self) -> None:
        self.stands = _Hashed(np.zeros(0, np.uint64), np.zeros(0, np.int32), room=2 * REMEMBERED)

    def _stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether nothing merges across the border of left and right before both are whole; left -1 stands for the start."""
        ok = (self.left[right, 0] >= 0) & ((left < 0) | (self.right[np.maximum(left, 0), 0] >= 0))
        at = np.flatnonzero(ok & (left >= 0))
        i, j = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        big = np.int64(_NONE)
        number = lambda x: np.where(x < 0, big, x)
        while len(at):
            a, b = left[at], right[at]
            across = number(self.joined.get(_pair(self.right[a, i], self.left[b, j])).astype(np.int64))
            next_a, next_b = number(self.right[a, i + 1].astype(np.int64)), number(self.left[b, j + 1].astype(np.int64))
            bad = (across < next_a) & (across <= next_b) & (across != big)
            ok[at[bad]] = False
            go = ~bad & ((next_a != big) | (next_b != big))
            i, j = i + (next_a <= next_b), j + (next_b <= next_a)
            at, i, j = at[go], i[go], j[go]
        return ok

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = _pair(left, right)
        known = self.stands.get(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            kinds, one, at = np.unique(key[new], return_index=True, return_inverse=True)
            stays = self._stays(left[new[one]].astype(np.int64), right[new[one]].astype(np.int64)).astype(np.int32)
            known[new] = stays[at]
            if self.stands.used + len(kinds) > 2 * REMEMBERED:
                self._forget()
            if len(kinds) <= 2 * REMEMBERED:
                self.stands.add(kinds, stays)
        return known > 0

    def last_tokens(self, t: Texts) -> np.ndarray:
        """Per byte of the pieces: the one token that can end the prefix up to it."""
        size = np.diff(t.off)
        order = np.argsort(-size, kind="stable")
        first, ordered = t.off[:-1][order], size[order]
        deep = int(ordered[0]) if len(ordered) else 0
        place = np.arange(len(t.buf)) - np.repeat(t.off[:-1], size)
        token = np.full((min(deep, self.longest) + 1, len(t.buf)), -1, np.int32)  # [length, last byte]
        for n in range(1, len(token)):
            end = np.flatnonzero(place >= n - 1) + 1
            token[n, end - 1] = self.ids.get(t.hashes(end - n, end))
        last = np.full(len(t.buf), -1, np.int32)
        for e in range(1, deep + 1):
            open_ = first[: np.searchsorted(-ordered, -e, side="right")] + (e - 1)
            for n in range(min(e, len(token) - 1), 0, -1):
                at = open_[token[n, open_] >= 0]
                if len(at):
                    before = last[at - n] if e > n else np.full(len(at), -1, np.int32)
                    good = at[self.follows(before, token[n, at])]
                    last[good] = token[n, good]
                    open_ = open_[last[open_] < 0]
                    if not len(open_):
                        break
            if len(open_):
                raise ValueError(f"no token ends the prefix of {e} bytes")
        return last

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece, read off its table of last tokens."""
        if not pieces:
            return []
        t = texts(pa.array(pieces, pa.binary()))
        last = self.last_tokens(t)
        at, rows, found, live = t.off[1:].copy(), [], [], np.flatnonzero(np.diff(t.off) > 0)
        while len(live):
            token = last[at[live] - 1]
            rows.append(live)
            found.append(token)
            at[live] -= self.size[token]
            live = live[at[live] > t.off[live]]
        row, token = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int32)])
        order = np.argsort(row, kind="stable")  # of each piece the last token first
        ids, cut = token[order].tolist(), np.cumsum(np.bincount(row, minlength=t.rows)).tolist()
        return [ids[a:b][::-1] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class _Pieces:
    """Ids (as text) and decoded bytes of the pieces met lately."""

    def __init__(self, encoder: PrefixEncoder, table: dict[str, np.ndarray]) -> None:
        self.encoder, self.table = encoder, PieceTable(encoder.ranks, table)
        self.now: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def of(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        """All of ``pieces``; those not met before are encoded together."""
        now, older = self.now, self.older
        if len(now) >= REMEMBERED:
            self.now, self.older = now, older = {}, now
        new = []
        for p in pieces:
            if p not in now:
                if p in older:
                    now[p] = older[p]
                else:
                    new.append(p)
        data = [p.encode() for p in new]
        many = [i for i, b in enumerate(data) if len(b) <= TOGETHER and b not in self.encoder.ranks]
        ids = [None] * len(new)
        for at in range(0, len(many), PIECES):
            part = many[at : at + PIECES]
            for i, x in zip(part, self.table.encode([data[i] for i in part]), strict=True):
                ids[i] = x
        have = now
        if len(now) + len(new) > 2 * REMEMBERED:
            have = {p: now[p] for p in pieces if p in now}  # this slice alone passes the bound: not remembered
        for p, b, x in zip(new, data, ids, strict=True):
            x = self.encoder.encode(b) if x is None else x
            have[p] = ",".join(map(str, x)), self.encoder.decode(x)
        return have

    def rest(self) -> None:
        """Between tasks only the pieces met last stay: other stages run beside the idle worker."""
        self.older = {}
        if len(self.now) > REMEMBERED:
            self.now = {}


_LOADED: dict[tuple[bytes, str], tuple] = {}


def _tools(packed: tuple[bytes, dict], pattern: str) -> tuple:
    ranks, table = packed
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        encoder = PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
        _LOADED[key] = encoder, regex.compile(pattern), _Pieces(encoder, table)
    return _LOADED[key]


def _encode(batches: Iterator[pa.RecordBatch], packed, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    _, split, memory = _tools(packed.value, pattern)
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_CHARS, side="right")))
            part = batch.slice(at, to - at)
            at = to
            pieces = [split.findall(x or "") for x in part.column("text").to_pylist()]
            known = memory.of(set(chain.from_iterable(pieces)))
            counts, ids, decoded = [], [], []
            for p in pieces:
                both = [known[x] for x in p]
                text = ",".join([x for x, _ in both])
                counts.append(text.count(",") + 1 if text else 0)
                ids.append(text)
                decoded.append(hashlib.sha256(b"".join([x for _, x in both])).hexdigest())
            cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), "decoded_sha256": pa.array(decoded)}
            if with_ids:
                cols["ids"] = pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    memory.rest()
    give_back()


_TABLES: dict[bytes, dict] = {}


def _packed(ranks: bytes) -> tuple[bytes, dict]:
    """The rank file with its arrays, made once a driver."""
    key = hashlib.sha256(ranks).digest()
    if key not in _TABLES:
        _TABLES[key] = table_of(PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}))
    return ranks, _TABLES[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of each whole text's ids and of the bytes decoded from them.

    One row per input row, whatever its doc_id; a null or empty text has no
    tokens and the digests of nothing. Whole texts are encoded, however long:
    a text and its pieces are held in memory, pieces of any length are encoded
    in time linear in it. Repeated rows give repeated results, an empty table
    an empty one; other columns are ignored. The rank file is read on the
    driver; it and the arrays made of it (some megabytes, bounded by the
    vocabulary) go to every executor once.
    """
    with open(ranks_path, "rb") as f:
        packed = docs.sparkSession.sparkContext.broadcast(_packed(f.read()))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(partial(_encode, packed=packed, pattern=pattern, with_ids=with_ids), schema)
