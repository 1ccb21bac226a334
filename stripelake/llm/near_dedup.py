"""Near-duplicate groups by HyperMinHash signatures, banding and exact confirmation.

A document's shingle hashes are dealt to ``REGISTERS`` buckets by their top bits.  Each bucket
keeps a compressed register of its least hash: the number of leading zeros of the remaining bits
and the ``MANTISSA`` bits after the leading one.  Empty buckets borrow a register by a fixed probe
order (optimal densification), so that equality of registers keeps the Jaccard similarity as its
probability for small sets too.  Bands of compressed registers propose candidates, the share of equal
registers, corrected for chance collisions, drops hopeless ones, and the full shingle sets decide.

No group is expanded into pairs: documents with equal sets first become one class; classes that
share a band bucket are compared with the bucket's least class (a star); only classes of one area of
likeness that are still in different components of the confirmed links are then compared with each
other, in blocks that hold the sets and return links alone, and last the few pairs that share a
bucket but no area.  A link inside one component cannot change the result, so none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .components import components
from .filters import semi_join
from .scratch import Table
from .text_hash import U64, mix, shingle_sets

REGISTERS = 128
BITS = 7
MANTISSA = 10
PROBES = 48
#: Classes of one area or band bucket are compared in blocks of about this size, and of about so many shingles.
BLOCK = 1024
BLOCK_SHINGLES = 400_000
#: Classes whose estimated similarity to a bucket's least class is at least this lie in one area.
SIMILAR = 0.5


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have while a pair at the threshold is missed less than once in 10**6."""
    for rows in range(8, 0, -1):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands < 1e-6:
            return bands, rows
    return REGISTERS, 1


def _probe_order() -> np.ndarray:
    return np.random.RandomState(20).randint(0, REGISTERS, (PROBES, REGISTERS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The HyperMinHash registers (leading zeros << MANTISSA | mantissa) of each sorted set of hashes; 0xFFFF where a set is empty."""
    edges = np.arange(REGISTERS, dtype=U64) << U64(64 - BITS)
    least = np.zeros((len(sets), REGISTERS), dtype=U64)
    full = np.zeros((len(sets), REGISTERS), dtype=bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            ok = at < len(s)
            x = s[np.where(ok, at, 0)]
            full[i] = ok & ((x >> U64(64 - BITS)) == np.arange(REGISTERS, dtype=U64))
            least[i] = x
    rest = (least << U64(BITS)) >> U64(11)  # the bits below the bucket's, as 53-bit numbers: exact in a double
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 53, 53 - exponent).astype(np.int64)
    mantissa = np.where(rest == 0, 0, ((fraction * 2 - 1) * (1 << MANTISSA))).astype(np.int64)
    reg = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    done = full.copy()
    for src in _probe_order():
        rows = np.flatnonzero(~done.all(axis=1) & full.any(axis=1))
        if not len(rows):
            break
        take = ~done[rows] & full[rows][:, src]
        sub = reg[rows]
        sub[take] = reg[rows][:, src][take]
        reg[rows] = sub
        done[rows] |= take
    for i in np.flatnonzero(~done.all(axis=1)):  # very small sets: the next full bucket
        if not full[i].any():
            reg[i] = 0xFFFF
            continue
        have = np.flatnonzero(full[i])
        need = np.flatnonzero(~done[i])
        reg[i, need] = reg[i, have[np.searchsorted(have, need) % len(have)]]
    return reg


def chance() -> float:
    """The probability that registers of two unrelated minima agree: the sum over all register values of their squared probability.
    A zero count z has probability 2**-(z+1), and its mantissa is uniform."""
    return sum(4.0 ** -(z + 1) for z in range(54)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, less the equalities that chance alone brings."""
    c = chance()
    return ((a == b).mean(axis=-1) - c) / (1 - c)


def band_keys(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(reg), bands), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * U64(3) + reg[:, j : bands * rows : rows].astype(U64), j)
        return mix(out + (np.arange(bands, dtype=U64) << U64(32)))


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def sign(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(1).to_pylist(), k)
        with np.errstate(over="ignore"):
            h1 = np.array([mix(s, 1).sum(dtype=U64) for s in sets], dtype=U64).view(np.int64)
            h2 = np.array([np.bitwise_xor.reduce(mix(s, 2)) if len(s) else 0 for s in sets], dtype=U64).view(np.int64)
        reg = registers(sets)
        return {"id": batch.column(0), "n": np.array([len(s) for s in sets], dtype=np.int64), "h1": h1, "h2": h2, "reg": [r.tobytes() for r in reg]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "text", sign, "id long, n long, h1 long, h2 long, reg binary")


def floor(t: float, n: np.ndarray) -> np.ndarray:
    """The least estimate with which a pair at similarity t is looked at: four and a half standard deviations below it,
    for REGISTERS draws from sets of n shingles."""
    return t - 4.5 * np.sqrt(t * (1 - t) * (1 / REGISTERS + 1 / np.maximum(n, 1)))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes reach the threshold."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> Table:
    """(id, s): the full shingle sets of the given documents."""
    source = semi_join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), Table(ids.distinct(), "asked").df, "id")

    def shingle(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "s": [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), k)]}

    return Table(map_batches(source, "text", shingle, "id long, s binary").dropDuplicates(["id"]), "sets", "lz4")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col, k)
    joined = pairs.join(sets.df.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.df.withColumnsRenamed({"id": "b", "s": "sb"}), "b")

    def decide(batches):
        for batch in batches:
            keep = pa.array([linked(np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    links = Table(joined.select("a", "b", "sa", "sb").mapInArrow(decide, "a long, b long"), "links")
    sets.drop()
    return links.df


def _deal(rows: DataFrame, unit: str, part: str) -> DataFrame:
    """Deals the rows of each unit with two parts or more to tasks (kind, i, j) such that rows of different parts meet.

    The largest part stands against the rest (kind 0: its block i, side 0, meets block j of the rest, side 1), and the rest against
    itself (kind 1: blocks i and j), so a unit with one large part and a few strays costs little more than its rows.
    """
    sizes = rows.groupBy(unit, part).agg(F.count("*").alias("size"), F.sum("n").alias("sum")).groupBy(unit).agg(F.max(F.struct("size", part, "sum")).alias("top"), F.sum("size").alias("all"), F.sum("sum").alias("sum")).where(F.col("all") > F.col("top.size"))
    blocks = lambda size, total: F.ceil(F.greatest(size / BLOCK, total / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select(unit, F.col(f"top.{part}").alias("main"), blocks(F.col("top.size"), F.col("top.sum")).alias("na"), blocks(F.col("all") - F.col("top.size"), F.col("sum") - F.col("top.sum")).alias("nb"))
    a, b = (F.pmod(F.xxhash64("rep"), F.col(c)).cast("int") for c in ("na", "nb"))
    no, yes = F.lit(0), F.lit(1)
    task = lambda kind, i, j, side: F.struct(kind.alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    main = F.transform(F.sequence(no, F.col("nb") - 1), lambda j: task(no, a, j, no))
    rest = F.concat(F.transform(F.sequence(no, F.col("na") - 1), lambda i: task(no, i, b, yes)), F.transform(F.sequence(no, F.col("nb") - 1), lambda o: task(yes, F.least(b, o), F.greatest(b, o), b)))
    return rows.join(sizes, unit).withColumn("t", F.explode(F.when(F.col(part) == F.col("main"), main).otherwise(rest))).select("*", "t.*").drop("t", "main", "na", "nb")


def _sides(unit, side: np.ndarray, rep: np.ndarray):
    """Pairs to look at in one task of _deal: indices of the left rows, and for each a mask of right ones."""
    kind, i, j = (int(x.as_py()) for x in unit[1:4])
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if kind == 0 else (np.flatnonzero(side == i), np.flatnonzero(side == j))
    for x in left:
        yield x, right[rep[right] > rep[x]] if kind == 1 and i == j else right


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their sets of k-word
    shingles (words: runs of anything but ASCII white space, ASCII letters lower-cased; a text of
    fewer words is one shingle).  component_id is the smallest id reachable over links, kept says
    whether it is the row's own.  A null, empty or wordless text has n_shingles 0 and no links.  A
    row without an id keeps a null component_id, kept true, and links with nothing.  Repeated rows
    get equal results.  Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    sig = Table(_signatures(docs, id_col, text_col, k), "signatures").df
    classes = Table(sig.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("reg").alias("reg")), "classes").df
    bands, rows = bands_for(percent / 100)
    t = percent / 100

    def key(batches):
        for batch in batches:
            reg = np.frombuffer(b"".join(batch.column("reg").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(reg, bands, rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], names=["key", "rep"])

    keyed = classes.select("rep", "reg").mapInArrow(key, "key long, rep long")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("center")).where("m > 1")
    member = Table(keyed.join(buckets, "key"), "members")

    def compare(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            est = estimate(ra, rb)
            likely = est >= floor(t, np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            ok = pa.array(likely | (est >= min(SIMILAR, t)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(likely).filter(ok)], names=["a", "b", "likely"])

    reg = classes.select("rep", "reg", "n")
    star = member.df.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(reg.withColumnsRenamed({"rep": "b", "reg": "rb", "n": "nb"}), "b").join(reg.withColumnsRenamed({"rep": "a", "reg": "ra", "n": "na"}), "a")
    near = Table(star.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(compare, "a long, b long, likely boolean"), "pairs").df
    links = _confirm(near.where("likely").select("a", "b"), docs, id_col, text_col, k, percent)
    comp = Table(components(links), "components").df
    area = Table(components(near), "areas").df.withColumnsRenamed({"node": "rep", "component": "area"})

    # Classes of one area (a component of likeness) in different components of links are compared block by block, sets at hand.
    placed = area.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "area", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("area").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 2").select("area")
    open_ = Table(placed.join(mixed, "area").join(reg, "rep"), "open").df
    sets = _sets(docs, open_.select(F.col("rep").alias("id")), id_col, text_col, k)
    dealt = _deal(open_.join(sets.df.withColumnRenamed("id", "rep"), "rep"), "area", "comp").select("area", "kind", "i", "j", "side", "rep", "comp", "n", "reg", "s")

    def within(unit, table):
        table = table.combine_chunks()
        r = np.frombuffer(b"".join(table.column("reg").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        rep, comp_, side, n = (table.column(c).to_numpy() for c in ("rep", "comp", "side", "n"))
        found = [np.frombuffer(x, dtype=U64) for x in table.column("s").to_pylist()]
        low, high = [], []
        for x, y in _sides(unit, side, rep):
            y = y[comp_[y] != comp_[x]]
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            y = y[estimate(r[y], r[x]) >= floor(t, np.minimum(n[y], n[x]))]
            for z in y.tolist():
                if linked(found[x], found[z], percent):
                    low.append(min(rep[x], rep[z]))
                    high.append(max(rep[x], rep[z]))
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    more = Table(dealt.groupBy("area", "kind", "i", "j").applyInArrow(within, "a long, b long"), "links").df

    # What is left: classes that share a bucket by chance or by a centre that is like neither.  Each pair counts in its first band.
    placed = member.df.where("m > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(area, "rep", "left").select("key", "center", "rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("area", "rep").alias("area"))
    mixed = placed.groupBy("key").agg(F.min("area").alias("lo"), F.max("area").alias("hi")).where("lo <> hi").select("key")
    dealt = _deal(placed.join(mixed, "key").join(reg, "rep"), "key", "area").select("key", "kind", "i", "j", "side", "rep", "comp", "area", "center", "n", "reg")

    def across(unit, table):
        table = table.combine_chunks()
        r = np.frombuffer(b"".join(table.column("reg").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        rep, comp_, area_, side, n = (table.column(c).to_numpy() for c in ("rep", "comp", "area", "side", "n"))
        center = int(table.column("center")[0].as_py())
        keys = band_keys(r, bands, rows)
        here = np.array(unit[0].as_py(), dtype=np.int64).view(U64)
        low, high = [], []
        for x, y in _sides(unit, side, rep):
            if rep[x] == center:  # pairs with the centre have been decided
                continue
            y = y[(area_[y] != area_[x]) & (comp_[y] != comp_[x]) & (rep[y] != center)]
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            y = y[estimate(r[y], r[x]) >= floor(t, np.minimum(n[y], n[x]))]
            if len(y):
                y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == here]
                low += np.minimum(rep[y], rep[x]).tolist()
                high += np.maximum(rep[y], rep[x]).tolist()
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    rest = Table(dealt.groupBy("key", "kind", "i", "j").applyInArrow(across, "a long, b long"), "pairs").df
    more = more.unionByName(_confirm(rest, docs, id_col, text_col, k, percent))
    if more.limit(1).count():
        comp = Table(components(links.unionByName(more)), "components").df
    sets.drop()
    member.drop()

    by_class = classes.select("h1", "h2", "n", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    # A class of many copies is one row here; copies meet it in a join that Spark may split.
    out = sig.select("id", "n", "h1", "h2").join(by_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
