import random

import numpy as np
import pyarrow as pa
from simloom.llm import quality
from simloom.llm import suffix_dedup as sd
from simloom.llm.bytetext import texts


def thue_morse(n, one="b", zero="a"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_equal_bytes_and_only_those_hash_equal():
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("ab é") for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 63, 64, 65, 200) for _ in range(6)]
    rows = [rnd.choice(pool) for _ in range(400)]
    t = texts(pa.array(rows))
    h = t.hashes(t.off[:-1], t.off[1:])
    d = [tuple(x) for x in t.digests(t.off[:-1], t.off[1:]).tolist()]
    for got in (h.tolist(), d):
        kinds = {}
        assert all(kinds.setdefault(r, x) == x for r, x in zip(rows, got)) and len(set(kinds.values())) == len(kinds)


def test_thue_morse_texts_stay_apart():
    for n in (8, 64, 1024, 4096):
        a, b = thue_morse(n), thue_morse(n, "a", "b")
        t = texts(pa.array([a, b, a.replace("a", "\x00"), b.replace("a", "\x00")]))
        assert len(set(t.hashes(t.off[:-1], t.off[1:]).tolist())) == 4
        assert len(set(map(tuple, t.digests(t.off[:-1], t.off[1:]).tolist()))) == 4


def test_thue_morse_lines_and_words_are_no_repeats():
    a, b = thue_morse(1024), thue_morse(1024, "a", "b")
    m = quality._measure(texts(pa.array([f"{a}\n{b}", f"{a}\n{a}", " ".join([a, "x", "y", b, "x", "y"])])))
    assert m["n_dup_lines"].tolist() == [0, 1, 0] and m["n_repeat_words"].tolist() == [0, 0, 0]


def test_thue_morse_contexts_stay_apart():
    a, b = thue_morse(1024), thue_morse(1024, "a", "b")
    t = texts(pa.array([a, b, a]))
    one, kind = sd._kinds(np.zeros(3, np.uint64), t.digests(t.off[:-1], t.off[1:]))
    assert len(one) == 2 and kind[0] == kind[2] != kind[1]
