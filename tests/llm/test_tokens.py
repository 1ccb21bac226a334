"""Tokenising, packing and the Huffman files: exact round trips."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stripelake.llm import huffman, queries, tokens
from stripelake.llm.packing import pack, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_the_library(tok, texts):
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\n\n", " \n", "\t", " ", " ", "　", "\x1c", "\x85", ".", ",", "'s", "'", "é", "×", "÷", "ß", "a", "B", "word", "12", "½", "中", "<|endoftext|>", "’", "\r\n", "​", "!", "_"]
    mixed = texts + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got, at = tokens.encode(mixed, PATH)
    for i, t in enumerate(mixed):
        assert got[at[i] : at[i + 1]].tolist() == ids_of(tok, t)


def test_pieces():
    n = np.array([1, 5, 2048, 2049, 4096 + 7])
    doc, start, length = pieces(n, 2048)
    for i, total in enumerate(n):
        own = length[doc == i]
        assert own.sum() == total and (start[doc == i] == np.cumsum(own) - own).all()
        assert all(x & (x - 1) == 0 for x in own.tolist()) and max(own) <= 2048


def test_pack(docs, tok):
    rows = pack(docs, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for r in docs.select("doc_id", "text").distinct().collect():
        want = ids_of(tok, r["text"]) + [1]
        got = sorted(by[r["doc_id"]], key=lambda x: x["start"])
        copies = len(got) // max(1, len({x["start"] for x in got}))
        at = 0
        for x in got[::copies]:
            assert x["start"] == at and x["offset"] == 0 and x["doc_tokens"] == len(want) and x["length"].bit_count() == 1
            assert np.frombuffer(x["ids"], dtype="<u4").tolist() == want[at : at + x["length"]]
            at += x["length"]
        assert at == len(want)


@pytest.mark.parametrize("counts", [[0, 0, 5], [1, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34], [2**k for k in range(30)], [3] * 1000])
def test_code_lengths(counts):
    c = np.array(counts)
    lengths = huffman.code_lengths(c)
    used = lengths[c > 0].astype(int)
    assert (lengths[c == 0] == 0).all() and used.max() <= huffman.LIMIT and sum(2.0**-used) <= 1
    if len(used) > 1:
        assert sum(2.0**-used) == 1
    codec = huffman.Codec(lengths)
    ids = np.random.RandomState(2).choice(np.flatnonzero(c), 1000)
    bits, marks = codec.encode(ids)
    assert len(bits) == (lengths[ids].astype(int).sum() + 7) // 8
    assert all((x == y).all() for x, y in zip(codec.decode([(1000, bits, marks), (3, *codec.encode(ids[:3])), (0, b"", b"")]), [ids, ids[:3], ids[:0]]))


def test_optimal_where_no_limit_binds():
    import heapq

    c = np.random.RandomState(1).randint(1, 1000, 200)
    heap = [(int(x), i) for i, x in enumerate(c)]
    heapq.heapify(heap)
    cost, nxt = 0, len(c)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], nxt))
        nxt += 1
    assert (huffman.code_lengths(c).astype(int) * c).sum() == cost


def test_file_round_trip(spark, docs, tok):
    path = huffman.write(docs, PATH)
    got = huffman.read(spark, path).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [g["id"] for g in got] == [r["doc_id"] for r in rows]
    at = 0
    for g, r in zip(got, rows):
        want = ids_of(tok, r["text"]) + [2]
        assert (g["start"], g["n_tokens"]) == (at, len(want)) and np.frombuffer(g["ids"], dtype="<u4").tolist() == want
        at += len(want)


def test_empty_tables(none):
    assert pack(none, PATH).count() == 0
    assert huffman.read(none.sparkSession, huffman.write(none, PATH)).count() == 0


def test_files_decode_in_another_process(spark, tmp_path, tok):
    """No state of the writer is needed: a fresh process reads the folder."""
    import subprocess
    import sys

    texts = ["one two", "", "three"]
    huffman.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, f"{tmp_path}/file")
    script = f"""
from stripelake.session import build
from stripelake.llm import huffman, queries
spark = build("local[1]", "reader", spark__ui__enabled="false")
queries.table(spark, "/root/testdata/sf0.001", "region")
print([(r["id"], r["n_tokens"], bytes(r["ids"]).hex()) for r in huffman.read(spark, "{tmp_path}/file").orderBy("start").collect()])
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=queries.ROOT, timeout=300, check=True).stdout
    want = [ids_of(tok, t) + [2] for t in texts]
    assert eval(out.strip().splitlines()[-1]) == [(i, len(w), np.array(w, dtype="<u4").tobytes().hex()) for i, w in enumerate(want)]


def test_packing_takes_little_memory_at_once(spark, monkeypatch):
    """A worker encodes a large batch in slices; arrays of all of its bytes at once would take over 60 MB."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from stripelake.llm import packing

    taken = []
    frame = type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, fn, schema: taken.append(fn) or plain(self, fn, schema))
    pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([" ".join(rng.choices(vocab, k=800)) for _ in range(500)])], names=["id", "text"])
    monkeypatch.setattr(tokens, "_caches", {})
    from stripelake.llm import text_hash

    monkeypatch.setattr(text_hash, "_cache", {})
    for _ in taken[0](iter([batch.slice(0, 10)])):  # the cache's table is made
        pass
    tracemalloc.start()
    n = sum(sum(out.column("length").to_pylist()) for out in taken[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 500 * 800 and peak < 45e6
