"""From raw documents to packed sequences, in five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet and
reads it again as the next one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripelake.llm.decontaminate import find_items
from stripelake.llm.filters import anti_join
from stripelake.llm.language import PENDING, identify, learn
from stripelake.llm.line_dedup import drop_repeated_lines
from stripelake.llm.near_dedup import near_groups
from stripelake.llm.packing import pack
from stripelake.llm.queries import LONE_BYTES, table, tokenizer
from stripelake.llm.scratch import Table, short_batches

#: A language is trusted from this score on.
TRUST = 0.5


def without(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """The documents whose ``by`` is not among ``ids``; a null is among none."""
    return anti_join(docs, Table(ids.select(by).distinct(), "taken-out").df, by)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under neutral column names, and the new name of each column: no column can clash with an operator's."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language: text that has letters and a language that is likelier than all others together."""
    short_batches(spark)
    model = learn(docs, "doc_id", "text", "lang")
    df, c = numbered(docs)
    judged = identify(df, model, c["doc_id"], c["text"], keep=[x for x in df.columns if x != c["doc_id"]])
    return judged.where((F.col("lang_pred") != PENDING) & (F.col("score") >= TRUST)).select(*[F.col(c[n]).alias(n) for n in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of runs of two or more lines, and of single lines of 200 bytes or more, out of texts.

    Documents that consist of such copies go; null and empty texts have nothing that repeats and stay; an empty table stays one.
    """
    df, c = numbered(docs)
    out = drop_repeated_lines(df, c["doc_id"], c["text"], min_lines=2, lone_bytes=LONE_BYTES).where((F.col("n_removed") == 0) | (F.trim(c["text"]) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length(c["text"]).cast("long")).otherwise(F.col(c["n_chars"]))
    return out.select(*[(n_chars if n == "n_chars" else F.col(c[n])).alias(n) for n in docs.columns])


def named_once(docs: DataFrame) -> bool:
    """Whether every document has an id that no other has."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return ids["n"] == ids["d"]


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat id and text are one document.  Documents that share an id or have none are told apart by their row, in order
    of id (nulls last) and hash of the text.
    """
    if not named_once(docs):
        docs = docs.dropDuplicates(["doc_id", "text"])
        if not named_once(docs):
            df, c = numbered(docs)
            order = [F.col(c["doc_id"]).asc_nulls_last(), F.xxhash64(c["text"])]
            rows = Table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "rows").df
            groups = near_groups(rows, "row", c["text"], k=5, percent=80)
            return without(rows, groups.where("not kept"), "row").drop("row").toDF(*docs.columns)
    groups = near_groups(docs, k=5, percent=80)
    return without(docs, groups.where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold ten consecutive words of a benchmark item; a document is an id, which may be null, and a text."""
    df, c = numbered(docs)
    rows = df.withColumn("row", F.xxhash64(c["doc_id"], c["text"]))
    found = find_items(rows, table(spark, sf_dir, "benchmark"), "row", c["text"], size=10)
    return without(rows, found.where(F.size("spans") > 0), "row").drop("row").toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 2048 token ids, with the ids."""
    short_batches(spark)
    return pack(docs, tokenizer(), max_len=2048, end_id=1)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Near duplicates and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = Table(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
