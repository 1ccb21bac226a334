"""Language identification by prediction by partial matching.

Each language has a byte context tree of every order up to ``ORDER`` with frozen counts.  A byte that a context has
seen costs its share of count + distinct successors; one that it has not costs the context's
escape (method C) and goes to the next shorter context, below the empty one to a uniform byte.  The language
with the shortest code wins.  All costs of the contexts and bytes seen in training are tabulated
once, so scoring is look-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, release
from .grams import HashIndex, gram_buffer, grams, merge, own_positions, tally

ORDER = 4
#: Training texts of each language: those whose id's hash is least, about so many.
SAMPLE = 1000
#: Bytes of each language's training texts, about, at most.
SAMPLE_BYTES = 16 << 20

#: The answer where there is nothing to judge.
PENDING = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _pieces(texts: list[str | None], limit: int = 256 << 10):
    """The texts' bytes in groups of about ``limit`` bytes, one group at least."""
    held, size = [], 0
    for t in texts:
        held.append(_bytes(t))
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


class PPM:
    """Context trees of several languages, as tables of code lengths in bits."""

    def __init__(self, texts: dict[str, list[str | None]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        k = len(self.langs)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
            for piece in _pieces(texts[lang]):
                buf, at = gram_buffer(piece, order, False)
                keys = grams(buf, order)[own_positions(at, order)]
                for d in range(order + 1):
                    # the d nearest context bytes and the byte itself
                    short = keys & np.uint64(0xFF) if d == 0 else ((keys >> np.uint64(8 * (order + 1 - d))) << np.uint64(8)) | (keys & np.uint64(0xFF))
                    parts[d].append(tally(short))
            for d in range(order + 1):
                seen[d].append(merge(parts[d]))
        below_index, below = None, None  # costs one order shorter
        self.cost: list[tuple[HashIndex, np.ndarray]] = []
        self.escape: list[tuple[HashIndex, np.ndarray]] = []
        for d in range(order + 1):
            keys = np.unique(np.concatenate([s[0] for s in seen[d]])) if k else np.zeros(0, dtype=np.uint64)
            ctx = np.unique(keys >> np.uint64(8))
            cost, esc = np.zeros((len(keys), k)), np.zeros((len(ctx), k))
            where = np.searchsorted(ctx, keys >> np.uint64(8))
            if d == 0:
                base = np.full((len(keys), k), 8.0)
            else:
                short = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(0xFF))
                base = below[below_index.find(short)] if len(keys) else np.zeros((0, k))
            for j in range(k):
                own, n = seen[d][j]
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, own)] = n
                total = np.bincount(where, count, len(ctx))
                kinds = np.bincount(where, count > 0, len(ctx))
                with np.errstate(divide="ignore"):
                    e = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
                    esc[:, j] = e
                    cost[:, j] = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum(total + kinds, 1)[where]), base[:, j] + e[where])
            index = HashIndex(keys)
            self.cost.append((index, cost.astype(np.float32)))
            self.escape.append((HashIndex(ctx), esc.astype(np.float32)))
            below_index, below = index, cost

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language."""
        buf, at = gram_buffer([_bytes(t) for t in texts], self.order, False)
        own = own_positions(at, self.order)
        key = grams(buf, self.order)[own]
        n = np.diff(at) - self.order
        out = np.zeros((len(key), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(key))
        for d in range(self.order, -1, -1):
            if d < self.order:
                key = key & np.uint64(0xFF) if d == 0 else ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))
            index, cost = self.cost[d]
            got = index.find(key)
            hit = got >= 0
            out[open_[hit]] += cost[got[hit]]
            open_, key = open_[~hit], key[~hit]
            if not len(open_):
                break
            index, esc = self.escape[d]
            got = index.find(key >> np.uint64(8))
            known = got >= 0
            out[open_[known]] += esc[got[known]]
        else:
            out[open_] += 8.0
        total = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(out.astype(np.float64), (np.cumsum(n) - n)[some], axis=0)
        return total


def share_of(n: int, size: int, sample: int = SAMPLE) -> float:
    """The share of a language's texts that is learned: about ``sample`` of n texts, and about SAMPLE_BYTES of their ``size`` bytes at most."""
    return min(sample / n, SAMPLE_BYTES / max(size, 1))


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> PPM:
    """Trees from about ``sample`` texts (and SAMPLE_BYTES bytes at most) of each language, those with the least hashes of the id; from all
    where there are no more.  Hashes are compared in 63 bits, so a language of any size keeps its sample.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and id is not null")
    sizes = {r["lang"]: share_of(r["n"], r["size"], sample) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}  # a row a language
    part = F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 1)
    small = F.col("lang").isin([lang for lang, share in sizes.items() if share >= 1])
    for lang, share in sizes.items():
        if share < 1:
            small = small | (F.col("lang") == lang) & (part < int(share * 2**63))
    texts: dict[str, list[str | None]] = {}
    if sizes:
        for r in rows.where(small).select("lang", "text").toLocalIterator():
            texts.setdefault(r["lang"], []).append(r["text"])
    model = PPM(texts)
    texts.clear()
    release()
    return model


def identify(docs: DataFrame, model: PPM, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: (id_col, lang_pred, score), and the columns named in ``keep``.

    lang_pred is the language of the shortest code (ties: the first by name), ``und`` where the text
    is null or has no letter, or no language was learned.  score is 2**-length of the winner over the
    sum for all languages, 0 for ``und``.  Repeated rows get equal results; a null id is passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A text that is passed on anyway goes to the workers once.
    given = text_col if text_col in (keep or []) and dict(docs.dtypes)[text_col] == "string" else "_text"
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c) for c in keep or []], *([F.col(text_col).cast("string").alias(given)] if given == "_text" else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("_id", *(keep or [])).schema)

    def predict(batch: pa.RecordBatch) -> dict:
        m = shared.value
        texts = batch.column(given).to_pylist()
        pred, score = [PENDING] * len(texts), np.zeros(len(texts))
        if m.langs:
            length = m.lengths(texts)
            best = length.argmin(axis=1)
            share = 1 / np.exp2(np.minimum(0, length.min(axis=1)[:, None] - length)).sum(axis=1)
            for i, t in enumerate(texts):
                if has_letter(t):
                    pred[i], score[i] = m.langs[best[i]], share[i]
        return {c: batch.column(c) for c in batch.schema.names if c != "_text"} | {"lang_pred": pred, "score": score}

    out = map_batches(rows, given, predict, f"{kinds}, lang_pred string, score double", limit=512 << 10)
    return out.withColumnRenamed("_id", id_col)


def held_out(id_col: str, folds: int) -> Column:
    """Whether a document is held out of training: crc32 of its id as text leaves 2 modulo ``folds``; also where it has no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 2, F.lit(True))
