"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Training counts, for every context of up to ``ORDER`` bytes, the bits of the next byte: one binary tree of 255
nodes for each context.  Every node has the Krichevsky-Trofimov estimate of its own bits and the weighted
probability of the context tree below it, so all depths are mixed with weights that the whole corpus
sets.  The statistics are frozen before scoring.  A bit's probability then depends on the context and
the byte alone, and is tabulated once for every n-gram of the corpus; scoring is look-up.

Sums run in three steps: tasks tally n-grams of their texts, Spark adds the tallies, and the subtrees below three
nearest context bytes are made by themselves; shorter contexts are put together from those, level by level.
Every n-gram and every word that is looked up is in the model, so a minimal perfect hash and a 32-bit score, or a byte for a count, stand for it, and no key.
A model beyond ``BROADCAST_KEYS`` is looked up part by part, in as many passes over the texts, with the same results;
a pass looks up either n-grams of its part alone or words.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, map_batches, release
from .grams import PlacedIndex, gram_buffer, grams, merge, own_positions, place, tally
from .scratch import Table
from .text_hash import LOWER, SPACE_WORD, span_hashes, words

ORDER = 5
#: So many entries of 16 bytes are looked up at once, each worth ``GRAMS_A_KEY`` n-grams or ``WORDS_A_KEY`` words; more take several passes over the texts.
BROADCAST_KEYS = 8_000_000
GRAMS_A_KEY = 3
WORDS_A_KEY = 8
#: Counts from here on do not fit a byte.
MANY = 255
#: A row of a table of n-grams or words: what ``place`` gives, one value for each key by place, and what has no room there.
PLACED = "deal long, n long, sizes array<long>, bits binary, scores binary, rest binary"
#: About so many n-grams make a task of the trees.
DEALT = 100_000
_indexes: dict[str, dict] = {}
_HALF = 2 * math.lgamma(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma for x >= 0.5 by Stirling's series, after a shift of small x by 8."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 8
    y = np.where(small, x + 8, x)
    with np.errstate(divide="ignore"):
        s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if small.any():
        p = np.ones(small.sum())
        for j in range(8):
            p *= x[small] + j
        s[small] -= np.log(p)
    return s


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability of any order of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - _HALF


def _weigh(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return math.log(0.5) + np.logaddexp(own, below)


class _Level:
    """Nodes of one depth: sorted keys (context << 8 | bits so far), counts, and the log-odds of the node's own estimate against its children."""

    def __init__(self, keys, n0, n1, odds=None):
        self.keys, self.n0, self.n1, self.odds = keys, n0, n1, odds


def _levels(gram: np.ndarray, n: np.ndarray, order: int, least: int) -> tuple[list[_Level], np.ndarray]:
    """Levels ``order`` down to ``least`` of the trees below n-grams with counts, and the weighted log-probabilities of the last."""
    seen = n > 0
    ctx, byte, n = gram[seen] >> np.uint64(8), (gram[seen] & np.uint64(0xFF)).astype(np.int64), n[seen]
    keys, zero, one = [], [], []
    for k in range(8):
        keys.append(ctx << np.uint64(8) | ((1 << k) | (byte >> (8 - k))).astype(np.uint64))
        bit = (byte >> (7 - k)) & 1
        zero.append(n * (1 - bit))
        one.append(n * bit)
    at, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n0, n1 = (np.bincount(inverse, np.concatenate(x), len(at)).astype(np.float64) for x in (zero, one))
    out = [_Level(at, n0, n1)]
    weighted = kt(n0, n1)
    for _ in range(order, least, -1):
        up = (at >> np.uint64(16)) << np.uint64(8) | (at & np.uint64(0xFF))
        at, inverse = np.unique(up, return_inverse=True)
        n0, n1, below = (np.bincount(inverse, x, len(at)) for x in (n0, n1, weighted))
        own = kt(n0, n1)
        out.append(_Level(at, n0, n1, own - below))
        weighted = _weigh(own, below)
    return out, weighted


def _bits(gram: np.ndarray, levels: list[_Level], order: int) -> np.ndarray:
    """log10 of each n-gram's probability.  Levels run from the deepest to the empty context; a context without counts is left out."""
    ctx, byte = gram >> np.uint64(8), (gram & np.uint64(0xFF)).astype(np.int64)
    total = np.zeros(len(gram))
    for k in range(8):
        prefix, bit = ((1 << k) | (byte >> (8 - k))).astype(np.uint64), (byte >> (7 - k)) & 1
        p, known = np.full(len(gram), 0.5), np.zeros(len(gram), dtype=bool)
        for i, level in enumerate(levels):
            if not len(level.keys):
                continue
            key = (ctx >> np.uint64(8 * i)) << np.uint64(8) | prefix
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            hit = level.keys[at] == key
            n0, n1 = level.n0[at], level.n1[at]
            own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            share = 1 / (1 + np.exp(-np.clip(level.odds[at], -700, 700))) if level.odds is not None else np.ones(len(gram))
            p = np.where(hit, np.where(known, share * own + (1 - share) * p, own), p)
            known |= hit
        total += np.log10(p)
    return total


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    s, e = words(buf, SPACE_WORD)
    return span_hashes(buf, s, e), np.diff(np.searchsorted(s, at))


def tallies(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, trained, n): how often n-grams (kind 0) and words (kind 1, by hash) occur in rows with ``learn`` and in all.

    docs has (text, learn).
    """

    def count(batches):
        held: list[list[tuple[np.ndarray, ...]]] = [[], []]
        size = [0, 0]

        def rows(kind):
            keys, trained, n = merge(held[kind])
            held[kind], size[kind] = [(keys, trained, n)], 0
            return keys, trained, n

        for batch in batches:
            learn = np.array(batch.column("learn").to_pylist(), dtype=bool)
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            for flag in (True, False):
                part = [t for t, f in zip(texts, learn) if f == flag]
                if not part:
                    continue
                buf, at = gram_buffer(part, order, True)
                for kind, keys in ((0, grams(buf, order)[own_positions(at, order)]), (1, _word_hashes(part)[0])):
                    keys, n = tally(keys)
                    held[kind].append((keys, n if flag else np.zeros_like(n), n))
                    size[kind] += len(keys)
                    if size[kind] > 1_000_000:
                        rows(kind)
        for kind in (0, 1):
            if held[kind]:
                keys, trained, n = rows(kind)
                for lo in range(0, len(keys), 100_000):
                    hi = min(lo + 100_000, len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, kind, dtype=np.int8)), pa.array(keys[lo:hi].view(np.int64)), pa.array(trained[lo:hi].astype(np.int64)), pa.array(n[lo:hi].astype(np.int64))], names=["kind", "key", "trained", "n"])

    def by_bytes(batches):
        yield from count(cut(batches, "text", 1 << 20))
        release()

    return docs.select("text", "learn").mapInArrow(by_bytes, "kind byte, key long, trained long, n long").groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n"))


def deal_of(key, order: int, deals: int):
    """The deal of an n-gram, by its (at most three) nearest context bytes: of a numpy array of unsigned keys, or of a column of the same bits."""
    shift = 8 * (order - min(3, order) + 1)
    if isinstance(key, np.ndarray):
        return ((key >> np.uint64(shift)) * np.uint64(1_640_531_527) >> np.uint64(16)) % np.uint64(deals)  # below 2**55
    return F.shiftrightunsigned(F.shiftrightunsigned(key, shift) * F.lit(1_640_531_527).cast("long"), 16) % F.lit(deals)


def code_table(counts: DataFrame, deals: int, order: int = ORDER) -> DataFrame:
    """log10 of the probability of each n-gram's last byte after its context; counts has (key, trained).

    One row a deal: (deal, n, sizes, bits, scores).  sizes and bits are those of ``place``, scores its n-grams' 32-bit floats by place.
    N-grams are dealt by their three nearest context bytes, so no task holds more than those of one such context: 256**3 at order 5.
    """
    spark = counts.sparkSession
    deep = min(3, order)
    dealt = counts.select("key", "trained", deal_of(F.col("key"), order, deals).alias("deal"))

    def below(unit, t):
        gram, n = t.column("key").to_numpy().view(np.uint64), t.column("trained").to_numpy()
        levels, weighted = _levels(gram, n, order, deep)
        last = levels[-1]
        return pa.table({"key": pa.array(last.keys.view(np.int64)), "n0": pa.array(last.n0, pa.float64()), "n1": pa.array(last.n1, pa.float64()), "below": pa.array(weighted, pa.float64())})

    def weighted(batches):
        for batch in batches:
            n0, n1, sums = (batch.column(c).to_numpy() for c in ("n0", "n1", "below"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n0", "n1")), pa.array(_weigh(kt(n0, n1), sums))], names=["key", "n0", "n1", "below"])

    def shorter(nodes: DataFrame) -> DataFrame:
        """Nodes of contexts that are one byte shorter, with the weighted probabilities below them."""
        up = F.shiftleft(F.shiftrightunsigned("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(255))
        return nodes.groupBy(up.alias("key")).agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])

    kinds = "key long, n0 double, n1 double, below double"
    nodes = dealt.groupBy("deal").applyInArrow(below, kinds)
    middle = Table(shorter(nodes), "nodes").df if deep == 3 else None  # two bytes
    if deep >= 2:
        first = shorter(middle.mapInArrow(weighted, kinds) if middle is not None else nodes)
    else:
        first = nodes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    # Depth 1 has at most 257 contexts of 255 nodes each: a bounded table.
    first = first.toPandas().sort_values("key")
    keys = first["key"].to_numpy().astype(np.uint64)
    n0, n1, sums = (first[c].to_numpy(dtype=np.float64) for c in ("n0", "n1", "below"))
    own = kt(n0, n1)
    one = _Level(keys, n0, n1, own - sums)
    up = (keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(0xFF))
    at, inverse = np.unique(up, return_inverse=True)
    m0, m1, sums = (np.bincount(inverse, x, len(at)) for x in (n0, n1, _weigh(own, sums)))
    shared = spark.sparkContext.broadcast((one, _Level(at, m0, m1, kt(m0, m1) - sums)))

    def code(unit, t, two=None):
        gram, n = t.column("key").to_numpy().view(np.uint64), t.column("trained").to_numpy()
        levels = _levels(gram, n, order, deep)[0]
        if two is not None:
            order_ = np.argsort(two.column("key").to_numpy().view(np.uint64))
            at, n0, n1, sums = two.column("key").to_numpy().view(np.uint64)[order_], *(two.column(c).to_numpy()[order_] for c in ("n0", "n1", "below"))
            levels.append(_Level(at, n0, n1, kt(n0, n1) - sums))
        sizes, bits, by_place = place(gram)
        scores = _bits(gram, levels + list(shared.value), order)[by_place].astype("<f4")
        return _placed(unit, sizes, bits, scores, b"")

    if middle is None:
        return dealt.groupBy("deal").applyInArrow(lambda unit, t: code(unit, t), PLACED)
    # Each deal gets the two-byte nodes that its contexts end in.
    pair = F.shiftrightunsigned("key", 8 * (order - 1))
    wanted = dealt.select("deal", pair.alias("pair")).distinct()
    near = middle.withColumn("pair", F.shiftrightunsigned("key", 8)).join(wanted, "pair").select(F.col("deal").alias("to"), "key", "n0", "n1", "below")
    return dealt.groupBy("deal").cogroup(near.groupBy("to")).applyInArrow(code, PLACED)


def _placed(unit: tuple, sizes: list[int], bits: np.ndarray, scores: np.ndarray, rest: bytes) -> pa.Table:
    return pa.table({"deal": pa.array([unit[0].as_py()], pa.int64()), "n": pa.array([len(scores)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits.tobytes()], pa.binary()), "scores": pa.array([scores.tobytes()], pa.binary()), "rest": pa.array([rest], pa.binary())})


def word_deal(key, deals: int):
    """The deal of a word, by its hash: of a numpy array of unsigned keys, or of a column of the same bits."""
    if isinstance(key, np.ndarray):
        return (key >> np.uint64(16)) % np.uint64(deals)
    return F.shiftrightunsigned(key, 16) % F.lit(deals)


def word_table(counts: DataFrame, deals: int) -> DataFrame:
    """How often words occur in training, 0 included; counts has (key, trained).  One row a deal: scores holds a byte for each word, ``MANY`` for
    counts of that or more, which rest holds in the same order, in 64 bits."""

    def code(unit, t):
        sizes, bits, by_place = place(t.column("key").to_numpy().view(np.uint64))
        times = t.column("trained").to_numpy()[by_place]
        return _placed(unit, sizes, bits, np.minimum(times, MANY).astype(np.uint8), times[times >= MANY].astype("<i8").tobytes())

    return counts.select("key", "trained", word_deal(F.col("key"), deals).alias("deal")).groupBy("deal").applyInArrow(code, PLACED)


def score_texts(docs: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: (id_col, learn, n_bytes, n_tokens, n_known, train_tokens, base_score, score).

    score is the model's log10 probability of the lower-cased UTF-8 text with its end; -score * log2(10) / n_bytes
    is its code length per byte (n_bytes counts the end).  ``learn`` names a boolean column: the model learns
    from rows where it is true (null: false).  base_score is a unigram model's with add-one smoothing over
    words (runs of anything but ASCII white space) and one end per text.  A null text is empty: it is
    its end.  With nothing to learn from every bit has probability 1/2 and base_score is 0 (one type, the unseen).  Repeated rows are counted as often as they occur.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    counted = Table(tallies(rows, order), "tallies")
    ends = rows.where("learn").count()
    # words, distinct words and ends of the training texts
    got = counted.df.where("kind = 1 and trained > 0").agg(F.sum("trained").alias("n"), F.count("*").alias("v")).first()
    n_words, v_words = got["n"] or 0, got["v"]
    total, kinds = n_words + ends, v_words + (ends > 0)
    log_of = lambda c: np.log10((np.asarray(c, dtype=np.float64) + 1) / (total + kinds + 1))
    n_codes = counted.df.where("kind = 0").count()
    deals = max(8, -(-n_codes // DEALT))
    codes = Table(code_table(counted.df.where("kind = 0").select("key", "trained"), deals, order), "codes", "none")
    n_seen = counted.df.where("kind = 1").count()  # words of all texts
    word_deals = max(8, -(-n_seen // DEALT))
    counts = Table(word_table(counted.df.where("kind = 1").select("key", "trained"), word_deals), "words", "none")
    # What a pass looks up: (part, parts) of the deals of n-grams and of the words; None leaves them to other passes.
    limit = max(1, broadcast_keys)
    if -(-n_codes // GRAMS_A_KEY) - (-n_seen // WORDS_A_KEY) <= limit:
        passes = [((0, 1), (0, 1))]
    else:
        by_grams, by_words = max(1, min(deals, -(-n_codes // (GRAMS_A_KEY * limit)))), max(1, min(word_deals, -(-n_seen // (WORDS_A_KEY * limit))))
        passes = [((p, by_grams), None) for p in range(by_grams)] + [(None, (p, by_words)) for p in range(by_words)]

    def one_pass(texts: DataFrame, gram_part: tuple[int, int] | None, word_part: tuple[int, int] | None) -> DataFrame:
        """Sums over the n-grams and words of a part of the model: (id, learn, n_bytes, m, known, base, score), zeros for what it leaves."""
        def load(placed: Table, deals: int, part: tuple[int, int], kind: str) -> tuple:
            t = placed.df.where(F.col("deal") % part[1] == part[0]).drop("n").toArrow()
            table = np.zeros(deals, dtype=np.int32)
            table[t.column("deal").to_numpy()] = np.arange(t.num_rows)  # a deal without keys is never asked for
            whole = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in t.column(c)), dtype=kind)
            return table, t.column("sizes").to_pylist(), whole("bits", "<u8"), whole("scores", kind), whole("rest", "<i8")

        loaded: dict[str, tuple] = {}
        if gram_part:
            loaded["grams"] = load(codes, deals, gram_part, "<f4")
        if word_part:
            loaded["words"] = load(counts, word_deals, word_part, "u1")
        shared = spark.sparkContext.broadcast(loaded)
        del loaded
        mark = uuid.uuid4().hex

        def places(keys: np.ndarray, deal_at, part: tuple[int, int], index: PlacedIndex, table: np.ndarray) -> np.ndarray:
            """The place of each key of the part, -1 for others."""
            out = np.full(len(keys), -1, dtype=np.int64)
            for lo in range(0, len(keys), index.PIECE):
                piece = keys[lo : lo + index.PIECE]
                deal = deal_at(piece).astype(np.int64)
                mine = np.flatnonzero(deal % part[1] == part[0]) if part[1] > 1 else slice(None)
                out[lo : lo + index.PIECE][mine] = index.find(piece[mine], table[deal[mine]])
            return out

        def look_up(texts: list[bytes], index: PlacedIndex, table: np.ndarray, value: np.ndarray) -> np.ndarray:
            buf, at = gram_buffer(texts, order, True)
            found = places(grams(buf, order)[own_positions(at, order)], lambda k: deal_of(k, order, deals), gram_part, index, table)
            each = np.where(found >= 0, value[found], 0).astype(np.float64) if len(value) else np.zeros(len(found))
            n = np.diff(at) - order
            return np.add.reduceat(each, np.cumsum(n) - n)  # at least the end each

        def count(texts: list[bytes], index: PlacedIndex, table: np.ndarray, value: np.ndarray, many_at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
            h, m = _word_hashes(texts)
            found = places(h, lambda k: word_deal(k, word_deals), word_part, index, table)
            times = np.where(found >= 0, value[found], 0).astype(np.int64) if len(value) else np.zeros(len(h), dtype=np.int64)
            often = np.flatnonzero(times == MANY)
            times[often] = many[np.searchsorted(many_at, found[often])]
            known = times > 0
            logs = np.where(known, np.log10((times + 1) / (total + kinds + 1)), 0)
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            hits = np.concatenate(([0], np.cumsum(known)))
            upto = np.concatenate(([0], np.cumsum(m)))
            return m, hits[upto[1:]] - hits[upto[:-1]], sums[upto[1:]] - sums[upto[:-1]]

        def score(batch: pa.RecordBatch) -> dict:
            if mark not in _indexes:  # once for each worker process, which then keeps the latest model
                _indexes.clear()
                _indexes[mark] = model = {}
                if gram_part:
                    table, sizes, bits, value, _ = shared.value["grams"]
                    model["grams"] = PlacedIndex(sizes, bits), table, value
                if word_part:
                    table, sizes, bits, value, many = shared.value["words"]
                    model["words"] = PlacedIndex(sizes, bits), table, value, np.flatnonzero(value == MANY), many
            model = _indexes[mark]
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            zeros = np.zeros(len(texts), dtype=np.int64)
            by_text = look_up(texts, *model["grams"]) if gram_part else zeros.astype(np.float64)
            m, known, base = count(texts, *model["words"]) if word_part else (zeros, zeros, zeros.astype(np.float64))
            n_bytes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            return {"id": batch.column("id"), "learn": batch.column("learn"), "n_bytes": n_bytes, "m": m, "known": known, "base": base, "score": by_text}

        return map_batches(texts, "text", score, "id long, learn boolean, n_bytes long, m long, known long, base double, score double", limit=1 << 20)

    if len(passes) == 1:
        sums = one_pass(rows, *passes[0])
    else:
        kept = Table(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
        texts = kept.df.withColumn("id", F.col("row"))
        parts = [Table(one_pass(texts.select("id", "text", "learn"), *p), "pass") for p in passes]
        union = parts[0].df
        for t in parts[1:]:
            union = union.unionByName(t.df)
        added = union.groupBy("id").agg(F.max("n_bytes").alias("n_bytes"), F.max("m").alias("m"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
        sums = kept.df.select("id", "row", "learn").join(added.withColumnRenamed("id", "row"), "row")
    unseen, end = float(log_of(0)), float(log_of(ends))
    return sums.select(
        F.col("id").alias(id_col), F.col("learn").alias(learn), "n_bytes", (F.col("m") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("m") - F.col("known")) * unseen + end).alias("base_score"), "score",
    )
