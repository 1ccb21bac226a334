"""Removal of byte strings that occur more than once, by anchors and external induced sorting.

Any ``size``-byte string holds a minimizer: the least hash of the ``SEED``-byte strings in it.  Equal strings hold
the same one at the same place, so only anchors whose hash occurs again can lie in a repeat.  Around an anchor
lies its slice, every string that it can be the minimizer of.  Slices equal as a whole (128 bits) settle all their strings
at once.  The rest, with one of each equal set, are dealt to shards by anchor, and each shard
sorts the suffixes of its slices by induction, carrying common prefixes: a string is repeated when the common prefix with a
neighbour reaches ``size``.  A group larger than memory is sorted through queues on disk.

An anchor with very many different slices is divided first.  The strings that start in a range of columns have a core in common, the bytes
that all of them hold, so slices whose cores differ cannot share any of them: they part, and cores that occur once leave.  What is still
too large has its range halved, down to single columns, where the core is the string and equality of its bytes decides.
Texts equal as a whole take part as one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, map_batches, release
from .filters import left_join, packed, passes, touched
from .induced import IN_MEMORY, External, repeated
from .scratch import Table, folder
from .text_hash import _BASE, _INV, U64, mix, powers

SEED = 32
#: Slices of one shard, about; and slices of one anchor, or of one core, from which the group is divided.
SHARD = 20_000
HOT = 100_000
PAD = 0xFF  # no UTF-8 text holds this byte


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over x[i : i + width] at every i (at the end over what there is)."""
    out, span, n = x.copy(), 1, len(x)
    while span * 2 <= width and span < n:
        out[: n - span] = least(out[: n - span], out[span:])
        span *= 2
    if 0 < width - span < n:
        out[: n - (width - span)] = least(out[: n - (width - span)], out[width - span :])
    return out


class Anchors:
    """The anchors of one text: positions, their hashes, and the hashes of their slices."""

    def __init__(self, data: bytes, size: int):
        buf = np.frombuffer(data, dtype=np.uint8)
        n, window = len(buf), size - SEED + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((buf.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
            back = powers(_INV, n + 1)
            h = mix((sums[SEED:] - sums[:-SEED]) * back[: n - SEED + 1])
            low = _slide(h, window, np.minimum)[: len(h) - window + 1]
            edge = np.zeros(window - 1, dtype=U64)
            self.at = np.flatnonzero(_slide(np.concatenate((edge, low, edge)), window, np.maximum)[: len(h)] == h)
            self.hash = h[self.at]
            self.start, self.end = np.maximum(self.at - (size - SEED), 0), np.minimum(self.at + size, n)
            own = (sums[self.end] - sums[self.start]) * back[self.start]
            place = (self.at - self.start).astype(U64) << U64(32) | (self.end - self.start).astype(U64)
            second = np.zeros(n + 1, dtype=U64)  # another polynomial: over 8 bytes at a time, in another base
            wide = mix((sums[8:] - sums[:-8]) * back[: n - 7], 5)
            np.cumsum(wide * powers(_BASE2, n - 7), out=second[1 : n - 6])
            self.slice2 = mix(mix((second[self.end - 7] - second[self.start]) * powers(_INV2, n)[self.start], 6) + place)
            self.slice = mix(mix(own, 3) + (self.at - self.start).astype(U64) * U64(0x9E3779B97F4A7C15) + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93) + self.hash)


_BASE2 = U64(0x9E3779B97F4A7C15)
_INV2 = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _tag(key: int, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(at.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(key & 0xFFFFFFFFFFFFFFFF), 9)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal disjoint ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return s[first], reach[np.append(first[1:], len(s)) - 1]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _sorter(size: int, in_memory: int, shared: str):
    """A task that reads slices in order of their groups (g, key, key2, at, lo, hi, slice) and gives the spans that repeat (key, key2, spans).

    Of a group, strings from column lo to hi count.  Memory holds ``in_memory`` slices; a larger group goes to disk as it comes.
    """
    left, width = size - SEED, 2 * size - SEED

    def spans(meta: np.ndarray, hit: np.ndarray, data_edges: np.ndarray):
        """Rows of (key, key2, at, lo, hi), the strings that repeat, and (first, last) columns within the text."""
        r, c = np.nonzero(hit)
        inside = (c >= np.maximum(meta[r, 3], data_edges[r, 0])) & (c <= meta[r, 4]) & (c + size <= data_edges[r, 1])
        r, c = r[inside], c[inside]
        start = meta[r, 2] - left + c
        names, of = np.unique(meta[:, :2], axis=0, return_inverse=True)
        of = of.ravel()[r]
        by = np.argsort(of, kind="stable")
        of, start = of[by], start[by]
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        keys, out = [], []
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(of)).tolist()):
            s, e = _spans(start[a:b], start[a:b] + size)
            keys.append(names[of[a]])
            out.append(np.stack((s, e), axis=1).astype("<i8").tobytes())
        keys = np.array(keys, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(out, pa.binary())], names=["key", "key2", "spans"])

    def edges_of(text: np.ndarray) -> np.ndarray:
        real = text != PAD
        return np.stack((real.argmax(axis=1), width - real[:, ::-1].argmax(axis=1)), axis=1)

    def run(batches):
        g, meta, text = np.zeros(0, dtype=np.int64), np.zeros((0, 5), dtype=np.int64), np.zeros((0, width), dtype=np.uint8)
        big: tuple[External, int, list] | None = None

        def finish():
            group, _, parts = big
            return spans(np.concatenate([m for m, _ in parts]), group.repeated(), np.concatenate([e for _, e in parts]))

        for batch in cut(batches, "slice", 4 << 20):
            more = np.frombuffer(b"".join(batch.column("slice").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
            g = np.concatenate((g, batch.column("g").to_numpy()))
            meta = np.concatenate((meta, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "key2", "at", "lo", "hi")], axis=1)))
            text = np.concatenate((text, more))
            if big and big[1] == g[0]:
                n = int(np.argmax(g != big[1])) or (len(g) if g[-1] == big[1] else 0)
                big[0].append(text[:n])
                big[2].append((meta[:n], edges_of(text[:n])))
                g, meta, text = g[n:], meta[n:], text[n:]
            if big and len(g):
                yield finish()
                big = None
            if not len(g):
                continue
            done = len(g) - int(np.argmax(g[::-1] != g[-1])) if g[0] != g[-1] else 0  # rows of groups that have ended
            if done and (len(g) > in_memory or len(text) * width > 16 << 20):
                yield spans(meta[:done], repeated(text[:done], g[:done], left, size), edges_of(text[:done]))
                g, meta, text = g[done:], meta[done:], text[done:]
            if g[0] == g[-1] and len(g) > in_memory:
                big = External(shared, left, size), int(g[0]), []
                big[0].append(text)
                big[2].append((meta, edges_of(text)))
                g, meta, text = g[:0], meta[:0], text[:0]
        if big:
            yield finish()
        if len(g):
            yield spans(meta, repeated(text, g, left, size), edges_of(text))
        release()

    return run


def _divide(rows: DataFrame, size: int, hot: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Divides groups (g, key, key2, at, lo, hi, slice) of more than ``hot`` slices by their cores.

    Returns groups of at most ``hot`` slices, and (key, key2, first) of the strings that are settled here.
    """
    small: DataFrame | None = None
    settled: DataFrame | None = None
    place = F.struct("key", "key2", "at")
    while True:
        # A core that runs over a text's edge holds no string.
        cores = rows.withColumn("core", F.substring("slice", F.col("hi") + 1, F.lit(size) - F.col("hi") + F.col("lo"))).where(~F.contains("core", F.lit(b"\xff")))
        cores = cores.withColumn("g", F.xxhash64("g", "lo", "hi", "core"))
        groups = Table(cores.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "cores").df
        level = Table(cores.join(groups, "g"), "divided").df
        part = level.where(F.col("m") <= hot).drop("core", "m")
        small = part if small is None else small.unionByName(part)
        wide = level.where((F.col("m") > hot) & (F.col("lo") < F.col("hi")))
        single = level.where((F.col("m") > hot) & (F.col("lo") == F.col("hi")))
        twice = single.groupBy("lo", "core").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("lo", "core")
        found = single.join(twice, ["lo", "core"]).select("key", "key2", (F.col("at") - (size - SEED) + F.col("lo")).alias("first"))
        settled = found if settled is None else settled.unionByName(found)
        if not wide.limit(1).count():
            return small, settled
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi"))))
        rows = wide.select("g", "key", "key2", "at", "slice", halves.alias("half")).select("g", "key", "key2", "at", "half.lo", "half.hi", "slice")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 200, in_memory: int = IN_MEMORY, hot: int = HOT) -> DataFrame:
    """One row per row of the input: (id_col, n_bytes, n_removed, n_spans, kept).

    A byte goes when it lies in a string of ``size`` bytes that also starts at another place of any text (UTF-8), judged on the
    input; kept holds the other bytes.  A null text is empty.  A repeated row is another text: its long
    strings are repeated.  An id may be null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"))
    kind = dict(rows.dtypes)["id"]
    left = size - SEED
    long = rows.where(F.octet_length("text") >= size)

    def gather(batches):
        for batch in cut(batches, "text", 2 << 20):
            parts = [(_tag(k, a.at), a) for k, a in ((k, Anchors(_bytes(x), size)) for k, x in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()))]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in ([a.hash for _, a in parts], [a.slice for _, a in parts], [a.slice2 for _, a in parts], [t for t, _ in parts])], names=["h", "s", "s2", "t"])

    found = long.select("text", "key").mapInArrow(gather, "h long, s long, s2 long, t long")
    # t tells an occurrence (text and place); a slice with two of them is settled.
    slices = Table(found.groupBy("h", "s", "s2").agg(F.min("t").alias("t"), (F.min("t") != F.max("t")).alias("full")), "slices")
    groups = slices.df.groupBy("h").agg(F.count("*").alias("m"), F.bool_and("full").alias("settled"))
    open_ = Table(groups.where("m > 1 and not settled").select("h", "m"), "open").df
    # What texts must know of a slice: the tag that stands for its set, whether it is settled, and whether its anchor is sorted (1) or divided (2).
    level = F.when(F.col("m").isNull(), 0).when(F.col("m") > hot, 2).otherwise(1).cast("byte")
    marks = left_join(slices.df, open_, ["h"]).where("full or m is not null").select("h", "s", "s2", F.col("t").alias("least"), "full", level.alias("level"))
    marks = Table(marks, "marks")
    slices.drop()
    n_open = marks.df.where("level > 0").count()
    wanted = spark.sparkContext.broadcast(packed(marks.df, "h"))
    many = Table(long.groupBy("key", "key2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies").df
    marked = left_join(rows.select("key", "key2", "id", "text"), many, ["key", "key2"])

    # Of equal texts each row makes the same anchors, and equal occurrences have one tag: they count once above and are merged below.
    same = touched(long.select("text", "key", "key2"), "key", many)
    once = same.where("not touched").drop("touched").unionByName(same.where("touched").groupBy("key", "key2").agg(F.first("text").alias("text")).select("text", "key", "key2"))

    def list_anchors(batches):
        """Anchors that may be marked, by a filter of fixed size."""
        filter_ = wanted.value
        names = ["h", "s", "s2", "t", "key", "key2", "nth"]
        for batch in cut(batches, "text", 2 << 20):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for x, k, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "key", "key2"))):
                a = Anchors(_bytes(x), size)
                nth = np.flatnonzero(passes(filter_, a.hash.view(np.int64)))
                for part, v in zip(parts, (a.hash[nth], a.slice[nth], a.slice2[nth], _tag(k, a.at[nth]), np.full(len(nth), k), np.full(len(nth), k2), nth)):
                    part.append(v.view(np.int64))
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)

    listed = once.mapInArrow(list_anchors, "h long, s long, s2 long, t long, key long, key2 long, nth long")
    flags = listed.join(marks.df, ["h", "s", "s2"]).select("key", "key2", F.struct(F.col("nth").cast("int").alias("nth"), "full", (F.col("least") == F.col("t")).alias("own"), "level").alias("f"))
    flags = Table(flags.groupBy("key", "key2").agg(F.collect_list("f").alias("f")), "flags").df
    # Only texts with a marked anchor are shuffled to their marks.
    flagged = touched(once, "key", flags).where("touched").drop("touched").join(flags, ["key", "key2"])

    def emit(batches):
        """Rows of settled spans (level 0), and of the slices to be sorted: of an equal set of slices only the one with the least tag is."""
        names = ["level", "g", "key", "key2", "at", "spans", "slice"]
        types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in cut(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in names]

            def add(*values, out=out):
                for o, v in zip(out, values):
                    o.append(v)

            for x, k, k2, marked_ in zip(*(batch.column(c).to_pylist() for c in ("text", "key", "key2", "f"))):
                data = _bytes(x)
                a = Anchors(data, size)
                full = np.array(sorted({m["nth"] for m in marked_ if m["full"]}), dtype=np.int64)
                s, e = _spans(a.start[full], a.end[full])
                if len(s):
                    add(0, 0, k, k2, 0, np.stack((s, e), axis=1).astype("<i8").tobytes(), None)
                for m in marked_:
                    if m["level"] and (m["own"] or not m["full"]):
                        p = m["nth"]
                        b, q, f = int(a.start[p]), int(a.at[p]), int(a.end[p])
                        add(m["level"], int(a.hash[p].view(np.int64)), k, k2, q, None, b"\xff" * (left - (q - b)) + data[b:f] + b"\xff" * (size - (f - q)))
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)

    sent = Table(flagged.select("text", "key", "key2", "f").mapInArrow(emit, "level byte, g long, key long, key2 long, at long, spans binary, slice binary"), "anchored")
    slices_of = lambda n: sent.df.where(F.col("level") == n).select("g", "key", "key2", "at", F.lit(0).alias("lo"), F.lit(left).alias("hi"), "slice")
    todo, parts = slices_of(1), sent.df.where("level = 0").select("key", "key2", "spans")
    if sent.df.where("level = 2").limit(1).count():
        small, settled = _divide(slices_of(2), size, hot)
        todo = todo.unionByName(small)

        def as_spans(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key2"), pa.array([np.array([x, x + size], dtype="<i8").tobytes() for x in batch.column("first").to_pylist()], pa.binary())], names=["key", "key2", "spans"])

        parts = parts.unionByName(settled.mapInArrow(as_spans, "key long, key2 long, spans binary"))
    ordered = todo.repartition(max(8, -(-n_open // SHARD)), "g").sortWithinPartitions("g")
    parts = parts.unionByName(ordered.select("g", "key", "key2", "at", "lo", "hi", "slice").mapInArrow(_sorter(size, in_memory, folder(spark)), "key long, key2 long, spans binary"))
    pieces = Table(parts, "spans")
    sent.drop()
    per_text = Table(pieces.df.groupBy("key", "key2").agg(F.collect_list("spans").alias("spans")), "text-spans").df
    pieces.drop()
    out = left_join(marked, per_text, ["key", "key2"])

    def remove(batch: pa.RecordBatch) -> dict:
        n, removed, count, kept = [], [], [], []
        for x, spans, copies in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("copies").to_pylist()):
            data = _bytes(x)
            n.append(len(data))
            if copies and len(data) >= size:
                s, e = np.array([0]), np.array([len(data)])
            else:
                all_ = np.frombuffer(b"".join(spans or []), dtype="<i8").reshape(-1, 2)
                s, e = _spans(all_[:, 0], all_[:, 1])
            removed.append(int((e - s).sum()))
            count.append(len(s))
            at, parts = 0, []
            for a, b in zip(s.tolist(), e.tolist()):
                parts.append(data[at:a])
                at = b
            kept.append(b"".join([*parts, data[at:]]))
        return {"id": batch.column("id"), "n_bytes": n, "n_removed": removed, "n_spans": count, "kept": kept}

    done = map_batches(out.select("id", "text", "spans", "copies"), "text", remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)
