"""The registered queries of this subpackage: thin bindings of operators to the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):  # Python workers import this package by name
        sc.environment["PYTHONPATH"] = ROOT + (os.pathsep + have if have else "")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)


#: Pairs of different sets that meet in a shingle, and the components of those that reach the threshold.
OP1_SQL = """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)] END)) AS s FROM docs),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS met, any_value(a.n) AS na, any_value(b.n) AS nb FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared WHERE 100 * met >= 85 * (na + nb - met)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component, rep, doc_id) END AS component_id,
       coalesce(coalesce(component, rep, doc_id) = doc_id, true) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON rep = node
"""


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokenizer(), max_len=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import drop_repeats

    out = drop_repeats(table(spark, sf_dir, "documents"), size=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A line of so many bytes counts as a passage by itself, as a string of that length does in op3.
LONE_BYTES = 200


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(table(spark, sf_dir, "documents"), min_lines=2, lone_bytes=LONE_BYTES)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, text, pos, line, lead(line) OVER (PARTITION BY doc_id, text ORDER BY pos) AS next FROM lines),
firsts AS (SELECT *, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS copy FROM pairs WHERE next IS NOT NULL),
hit AS (SELECT doc_id, text, pos FROM firsts WHERE copy > 1),
long AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM lines WHERE strlen(line) >= {LONE_BYTES}),
gone AS (SELECT doc_id, text, pos FROM hit UNION SELECT doc_id, text, pos + 1 FROM hit UNION SELECT doc_id, text, pos FROM long WHERE copy > 1),
marked AS (SELECT l.*, g.pos IS NOT NULL AS removed FROM lines l LEFT JOIN gone g USING (doc_id, text, pos)),
runs AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id, text ORDER BY pos), false) AS opens FROM marked)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(removed AS INT)) AS BIGINT) AS n_removed, CAST(sum(CAST(opens AS INT)) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM runs GROUP BY doc_id, text
UNION ALL SELECT doc_id, 0, 0, 0, sha256('') FROM docs WHERE text IS NULL
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    out = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM starts),
places AS (SELECT row, w, unnest(generate_series(1, len(w) - size + 1)) AS p, size FROM docs, (SELECT DISTINCT len(win) AS size FROM windows) WHERE len(w) >= size),
found AS (SELECT row, p, size, item_id FROM (SELECT row, p, size, w[p:p + size - 1] AS win FROM places) JOIN windows USING (win)),
words AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(generate_series(p, p + size - 1)) AS q FROM found) GROUP BY row),
hits AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (row) LEFT JOIN hits USING (row)
"""


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import read, write

    path = write(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)
    return read(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_texts
    from .language import held_out

    docs = table(spark, sf_dir, "documents").withColumn("learn", ~held_out("doc_id", 7))
    out = score_texts(docs, "learn").withColumn("held_out", ~F.col("learn"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id", 4)), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_text": op5_html_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_file": op7_token_file,
    "op8_lm_score": op8_lm_score,
    "op9_nearest": op9_nearest,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op6_decontaminate": OP6_SQL}
