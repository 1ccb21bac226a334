"""Token-id files in a canonical, length-limited Huffman code.

The code's lengths come from the global counts of ids by package-merge, its codes are canonical, so
the files' header needs no more than the lengths.  A block holds whole documents and decodes on its own: the bit
offsets of every ``STRIDE``-th id are checkpoints from which table-driven decoders run side by side.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut, release
from .scratch import Table, new_path
from .tokens import encode, load, with_end

LIMIT = 18
STRIDE = 128
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, packages = [], weight[:0]
    for _ in range(limit):
        both = np.concatenate((weight, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by id, ids in canonical order)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    ln = lengths[order].astype(np.int64)
    step = np.left_shift(1, LIMIT - ln)
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = ((np.cumsum(step) - step) >> (LIMIT - ln)).astype(np.uint64)
    return codes, order


class Codec:
    """Encoder and decoder for one table of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes, order = canonical(lengths)
        ln = self.lengths[order]
        self.symbol = np.zeros(1 << LIMIT, dtype=np.uint32)
        self.length = np.full(1 << LIMIT, LIMIT, dtype=np.uint8)
        size = np.left_shift(1, LIMIT - ln)
        self.symbol[: size.sum()] = np.repeat(order, size)
        self.length[: size.sum()] = np.repeat(ln, size)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, checkpoints): big-endian bits and the offset of every STRIDE-th id as unsigned 64-bit integers."""
        if not len(ids):
            return b"", b""
        ln = self.lengths[ids]
        end = np.cumsum(ln)
        pos = end - ln
        word = pos >> 5
        v = self.codes[ids] << (64 - (pos & 31) - ln).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(end[-1] + 31 >> 5) + 1, dtype=np.uint64)
        at = word[first]
        out[at] += np.add.reduceat(v >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], pos[::STRIDE].astype("<u8").tobytes()

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of blocks (number of ids, bits, checkpoints), decoded side by side from their checkpoints."""
        base, data, pos, left = [], [], [], []
        at = 0
        for n, bits, marks in blocks:
            marks = np.frombuffer(marks, dtype="<u8").astype(np.int64)
            pos.append(marks + 8 * at)
            left.append(np.minimum(n - STRIDE * np.arange(len(marks)), STRIDE))
            data.append(bits)
            at += len(bits)
            base.append(len(marks))
        buf = b"".join(data) + b"\0" * 8
        view = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
        p = np.concatenate(pos) if pos else np.zeros(0, dtype=np.int64)
        many = np.concatenate(left) if left else p
        out = np.zeros((STRIDE, len(p)), dtype=np.uint32)
        for k in range(int(many.max()) if len(many) else 0):
            x = view[np.minimum(p >> 3, len(buf) - 8)].astype(np.uint64)
            peek = ((x << (p & 7).astype(np.uint64)) >> np.uint64(64 - LIMIT)).astype(np.int64)
            out[k] = self.symbol[peek]
            p = p + self.length[peek]
        result, lane = [], 0
        for (n, _, _), lanes in zip(blocks, base):
            result.append(out[:, lane : lane + lanes].T.reshape(-1)[:n])
            lane += lanes
        return result


#: The version of the layout below.
FORMAT = 1


def write(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> str:
    """Tokenises, counts and encodes ``docs`` in ascending order of id; returns the folder of the files, from which ``read`` alone decodes.

    ``path`` must not exist; without one the files are intermediate and go with the session.  ``path/blocks`` holds Parquet files with a row a
    block: (shard, block, first, n_ids, doc_ids, doc_tokens, bits, marks); shards ascend with the ids, ``first`` is the number of the
    block's first id in its shard.  ``path/header`` holds one row: (format, tokenizer, end_id, limit, stride, lengths), where lengths has the
    bits of each id's code as one byte an id, and tokenizer is the vocabulary file's name.  A null or empty text is the end id alone; rows
    without an id come first; repeated rows are all written.  Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-file")
    vocab = len(load(tokenizer)[1])
    kind = "<u2" if max(vocab, end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def tokenize(batches):
        shard, block, at = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        who: list[int | None] = []
        names = ["shard", "block", "first", "n_ids", "doc_ids", "doc_tokens", "ids"]

        def flush():
            nonlocal block, at, held, who
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([who], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([ids.astype(kind).tobytes()], pa.binary())], names=names)
            block, at, held, who = block + 1, at + len(ids), [], []
            return out

        size = 0
        for batch in cut(batches, "text", 2 << 20):
            ids, upto = with_end(*encode(batch.column("text").to_pylist(), tokenizer), end_id)
            for i, d in enumerate(batch.column("id").to_pylist()):
                held.append(ids[upto[i] : upto[i + 1]])
                who.append(d)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        release()

    raw = Table(rows.mapInArrow(tokenize, "shard int, block long, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, ids binary"), "token-ids")

    def count(batches):
        total = np.zeros(1 << 16 if kind == "<u2" else 1 << 18, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                c = np.bincount(np.frombuffer(x.as_buffer(), dtype=kind))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(1 << 16 if kind == "<u2" else 1 << 18, dtype=np.int64)
    for r in raw.df.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)

    def compress(batches):
        codec = Codec(shared.value)
        for batch in batches:
            done = [codec.encode(np.frombuffer(x.as_buffer(), dtype=kind).astype(np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("shard", "block", "first", "n_ids", "doc_ids", "doc_tokens")] + [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary())], names=["shard", "block", "first", "n_ids", "doc_ids", "doc_tokens", "bits", "marks"])

    coded = raw.df.mapInArrow(compress, "shard int, block long, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, bits binary, marks binary")
    coded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    header = [(FORMAT, os.path.basename(tokenizer), end_id, LIMIT, STRIDE, bytearray(lengths.tobytes()))]
    spark.createDataFrame(header, "format int, tokenizer string, end_id long, limit int, stride int, lengths binary").coalesce(1).write.parquet(f"{path}/header")
    raw.drop()
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files in ``path``: one row per document, (id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start
    the number of ids of all documents before it."""
    header = spark.read.parquet(f"{path}/header").first()
    if (header["format"], header["limit"], header["stride"]) != (FORMAT, LIMIT, STRIDE):
        raise ValueError(f"{path} is in another format")
    lengths = np.frombuffer(bytes(header["lengths"]), dtype=np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # a row a shard
    before, at = {}, 0
    for shard in sorted(sizes):
        before[shard] = at
        at += sizes[shard]
    shared = spark.sparkContext.broadcast((lengths, before))

    def decode(batches):
        lengths_, before_ = shared.value
        codec = Codec(lengths_)
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32).to_pylist()
                for r, ids in zip(part, codec.decode([(r["n_ids"], r["bits"], r["marks"]) for r in part])):
                    n = np.array(r["doc_tokens"], dtype=np.int64)
                    upto = np.concatenate(([0], np.cumsum(n)))
                    data = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(upto[:-1] + r["first"] + before_[r["shard"]]), pa.array(n), pa.array([data[4 * a : 4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "id long, start long, n_tokens long, ids binary")
