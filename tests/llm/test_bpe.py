import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from simloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tools():
    ranks = bpe.load_ranks(PATH)
    return bpe.PrefixEncoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    yield from ("", " ", "   \n\n  x", "a" * 3000, "é\U0001f600" * 50, "\x00\x01<|endoftext|>", " " * 500, "don't 'RE 12345 ....!!!??", "x   y\x1c\x85z")
    for _ in range(150):
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000)])) for _ in range(rnd.randrange(1, 200)))


def test_prefix_table_equals_merging(tools):
    encoder, _ = tools
    rnd = random.Random(1)
    for _ in range(300):
        data = bytes(rnd.choice(b"abcdeth \xc3\xa9") for _ in range(rnd.randrange(1, 40)))
        grown = bpe.Prefixes(encoder)
        for i in range(0, len(data), 3):
            grown.append(data[i : i + 3])
        assert encoder.read(grown.last) == [encoder.ranks[p] for p in encoder.merged(data)]
        grown.truncate(len(data) // 2)
        assert encoder.read(grown.last) == [encoder.ranks[p] for p in encoder.merged(data[: len(data) // 2])]


def test_edits_equal_encoding_anew(tools):
    encoder, library = tools
    rnd = random.Random(2)
    text = bpe.EditableText(encoder, public_tokenizers.PATTERN, "Some words, 12 of them...\n\n  and more  ")
    for _ in range(300):
        a = rnd.randrange(len(text.text) + 1)
        text.replace(a, min(len(text.text), a + rnd.randrange(6)), rnd.choice(["", " ", "x", "\n ", "  hello", "'s", "é9"]))
        assert text.flat() == library.encode_ordinary(text.text)
        assert encoder.decode(text.flat()) == text.text.encode()


def test_query_equals_library(spark, tools):
    _, library = tools
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "null id"), (7, None), (7, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encoded(df, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert bpe.encoded(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_pieces_together_equal_one_by_one(tools, monkeypatch):
    encoder, _ = tools
    rnd = random.Random(3)
    pieces = ["".join(chr(rnd.choice([rnd.randrange(97, 123), rnd.randrange(97, 123), rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000)])) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    data = [p.encode() for p in pieces]
    table = bpe.table_of(encoder)
    want = [[encoder.ranks[x] for x in encoder.merged(d)] for d in data]
    assert bpe.PieceTable(encoder.ranks, table).encode(data) == want
    assert bpe.PieceTable(encoder.ranks, table).encode([]) == []
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    memory = bpe._Pieces(encoder, table)
    for low in range(0, len(pieces), 70):
        some = set(pieces[low : low + 70]) | set(pieces[:20])
        known = memory.of(some)
        assert all(known[p] == (",".join(map(str, encoder.encode(p.encode()))), p.encode()) for p in some)
        assert len(memory.now) <= 100


def test_memory_of_many_new_pieces(tools):
    """What a slice of new pieces takes beside its results is bounded by the pieces that go through the table together."""
    encoder, _ = tools
    rnd = random.Random(3)
    pieces = {"".join(rnd.choice("abcdefghij") for _ in range(12)) for _ in range(60_000)}
    memory = bpe._Pieces(encoder, bpe.table_of(encoder))
    memory.of(set(list(pieces)[:100]))
    tracemalloc.start()
    got = memory.of(pieces)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - held < 60_000_000
    assert all(got[p][1] == p.encode() and got[p][0] == ",".join(map(str, encoder.encode(p.encode()))) for p in list(pieces)[:300])
    memory.now, memory.older = {str(i): ("0", b"!") for i in range(bpe.REMEMBERED + 1)}, got
    memory.rest()
    assert not memory.older and not memory.now
    assert memory.of({"abc"})["abc"][1] == b"abc"
