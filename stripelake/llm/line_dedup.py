"""Removal of repeated runs of lines: a suffix array over sequences of line ids, by prefix doubling (built-in functions only).

A position is a line of a document; its suffix is the rest of the document from there.  Round h ranks suffixes by their
first 2**h lines: the pair (rank of the first half, rank of the second half) is sorted over the cluster, and its place in
that order is the new rank.  Suffixes of equal rank are an interval of the suffix array whose common prefix has 2**h lines
or more.  A suffix whose rank is its own has no longer common prefix with any other, so it leaves; rounds work on ever
fewer rows and stop when no interval is left.  In every interval the earliest position is the copy that stays and all
others are later copies of 2**h lines; laid together over all rounds, these give the maximal repeated runs.

Ranks are exact: only lines themselves are compared by a digest (128 bits).  A line that is very common meets its
interval in tasks of their own, dealt by position; at most ``HOT`` such lines can exist, so that list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import touched
from .scratch import Table

#: A name with more than 1/HOT of all rows is hot; there are fewer than HOT of them, whatever the data.
HOT = 1024


def _own() -> Column:
    return F.struct("doc", "key", "pos")


def _level(named: DataFrame, name: list[str], label: str, repeats: bool = False) -> Table | None:
    """Ranks the rows by ``name`` and keeps those whose name repeats: (doc, key, pos, rank, later, *others); None without any.

    rank grows with name, later tells that an earlier position has the name.  With ``repeats`` a row may occur several times.
    """
    others = [c for c in named.columns if c not in ("doc", "key", "pos", *name)]
    groups = named.groupBy(*name).agg(F.min(_own()).alias("first"), F.count("*").alias("m")).where("m > 1")
    order = groups.repartitionByRange(*name).sortWithinPartitions(*name).withColumn("rank", F.monotonically_increasing_id())
    ranks = Table(order, f"{label}-ranks")
    rows = ranks.df.agg(F.sum("m").alias("m")).first()["m"]
    if not rows:
        ranks.drop()
        return None
    hot = ranks.df.where(F.col("m") * HOT > rows)  # fewer than HOT rows: their m sum to at most ``rows``
    cold = ranks.df.where(F.col("m") * HOT <= rows)
    wide = named.join(F.broadcast(hot.select(*name, F.col("first").alias("hot_first"), F.col("rank").alias("hot_rank"))), name, "left")
    # Rows of a hot name are done; their key for the second join is spread, and negative salts meet nothing.
    salt = F.when(F.col("hot_rank").isNotNull(), F.pmod(F.xxhash64("key", "pos"), F.lit(1 << 16)).cast("int")).otherwise(F.lit(-1))
    both = wide.withColumn("salt", salt).join(cold.select(*name, "first", "rank", F.lit(-1).alias("salt")), [*name, "salt"], "left")
    first, rank = F.coalesce("hot_first", "first"), F.coalesce("hot_rank", "rank")
    out = both.where(rank.isNotNull()).select("doc", "key", "pos", rank.alias("rank"), (_own() != first).alias("later"), *others)
    table = Table(out.distinct() if repeats else out, label)
    ranks.drop()
    return table


def _pairs(level: DataFrame, step: int) -> DataFrame:
    """(doc, key, pos, left, right): the ranks of the suffix and of the one ``step`` lines on, where both are ranked."""
    ahead = Window.partitionBy("doc", "key").orderBy("pos").rangeBetween(step, step)
    return level.select("doc", "key", "pos", F.col("rank").alias("left"), F.first("rank").over(ahead).alias("right")).where("right is not null")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 2, lone_bytes: int | None = None) -> DataFrame:
    """One row per document with a line to remove: (doc, key, runs, longest).

    (doc, key) are the id and a hash of id and text, runs the maximal removed runs as (start, end) in order of start, longest the
    largest power of two such that a run of so many lines has an earlier copy.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    there = docs.where(F.col(text_col).isNotNull())
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    long = (lambda line: F.octet_length(line) >= lone_bytes) if lone_bytes is not None else (lambda line: F.lit(False))
    ids = F.transform(F.split(text, "\n", -1), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), long(line).alias("long")))
    lines = there.select(doc.alias("doc"), F.xxhash64(doc, text).alias("key"), F.posexplode(ids).alias("pos", "line"))
    lines = lines.select("doc", "key", "pos", "line.a", "line.b", "line.long")
    level, depth = _level(lines, ["a", "b"], "lines", repeats=True), 1
    hits: list[Table] = []

    def hit(found: DataFrame, n: int) -> None:
        hits.append(Table(found.select("doc", "key", "pos", F.lit(n).alias("n"), F.lit(n if n & (n - 1) == 0 else 1 << n.bit_length() - 1).cast("long").alias("reach")), "runs"))

    if level and lone_bytes is not None:
        hit(level.df.where("later and long"), 1)
    while level:
        if depth >= min_lines:
            hit(level.df.where("later"), depth)
        elif 2 * depth > min_lines:  # min_lines is no power of two: its two halves overlap
            exact = _level(_pairs(level.df, min_lines - depth), ["left", "right"], "overlap")
            if exact:
                hit(exact.df.where("later"), min_lines)
                exact.drop()
        after = _level(_pairs(level.df, depth), ["left", "right"], "suffixes")
        level.drop()
        level, depth = after, 2 * depth
    if not hits:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return docs.where("false").select(doc.alias("doc"), F.lit(0).cast("long").alias("key"), none.alias("runs"), F.lit(0).cast("long").alias("longest"))
    found = hits[0].df
    for t in hits[1:]:
        found = found.unionByName(t.df)
    # Overlapping and adjacent hits of a document are one run.
    whole = Window.partitionBy("doc", "key").orderBy("pos", "n")
    before = F.max(F.col("pos") + F.col("n")).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.withColumn("opens", (before.isNull() | (F.col("pos") > before)).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("doc", "key", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("n")).alias("end"), F.max("reach").alias("reach"))
    out = Table(runs.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.max("reach").alias("longest")), "removed")
    for t in hits:
        t.drop()
    return out.df


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 2, lone_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the lines of later copies taken out of the text, and (n_lines, n_removed, n_runs, longest_run).

    A line goes when it lies in ``min_lines`` consecutive lines (parted by line feeds) that also start at an earlier
    position of the corpus, in order of id (nulls first), hash of the text, and line; the first copy stays, also within one document.
    With ``lone_bytes`` a line of at least so many UTF-8 bytes also goes alone, whatever stands next to it.
    n_runs counts maximal removed runs, longest_run is the largest power of two such that so many consecutive lines have an earlier
    copy that takes lines out (0: none).  A null text stays null with no lines; an empty text is one empty line; a text that loses
    all lines becomes empty.  Rows that repeat id and text are one document, and get equal results.  All other columns are
    passed on, but for those named like a result, which take its place.

    Only documents that may lose lines are shuffled with their texts.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # neutral names, so that no column can clash
    given, doc = F.col(names[text_col]), F.col(names[id_col]).cast("long")
    runs = repeated_runs(docs, id_col, text_col, min_lines=min_lines, lone_bytes=lone_bytes)
    mine = touched(docs.toDF(*names.values()).withColumn("key", F.xxhash64(doc, given.cast("string"))), "key", runs)
    found = runs.select(F.col("doc").alias("run_doc"), F.col("key").alias("run_key"), "runs", "longest")
    same = F.col("key").eqNullSafe(F.col("run_key")) & doc.eqNullSafe(F.col("run_doc"))
    apart = mine.where("touched").hint("shuffle_merge").join(found, same, "left").drop("run_doc", "run_key")
    kinds = dict(runs.dtypes)
    left_alone = mine.where("not touched").withColumn("runs", F.lit(None).cast(kinds["runs"])).withColumn("longest", F.lit(None).cast("long"))
    out = left_alone.unionByName(apart)
    lines: Column = F.split(given.cast("string"), "\n", -1)
    # The kept stretches lie between runs: from 0 or a run's end to the next run's start or the end of the text.
    kept_from = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    kept_to = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(kept_from, kept_to, lambda a, b: F.slice(lines, a + 1, b - a)))
    text = F.when(F.col("runs").isNotNull(), F.array_join(kept, "\n")).otherwise(given)
    results = {
        "n_lines": F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long")),
        "n_removed": F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]), F.lit(0).cast("long")),
        "n_runs": F.coalesce(F.size("runs").cast("long"), F.lit(0).cast("long")),
        "longest_run": F.coalesce("longest", F.lit(0).cast("long")),
    }
    results["n_lines"] = F.when(given.isNull(), F.lit(0).cast("long")).otherwise(results["n_lines"])
    results["n_runs"] = F.when(F.col("runs").isNull(), F.lit(0).cast("long")).otherwise(results["n_runs"])
    passed = [text.alias(c) if c == text_col else F.col(names[c]).alias(c) for c in docs.columns if c not in results]
    return out.select(*passed, *[v.alias(n) for n, v in results.items()])
