"""The stages of the pipeline against plain versions of their decisions."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp

from . import brute


def test_pipeline(spark, texts, tmp_path):
    lang = ["en", "de"]
    rows = [(i, t, lang[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(500, "12 34 !!", "en", None, 8), (501, None, None, None, None), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(0, texts[40]), (1, None)]
    for name in "touched filter_key filter_row score lang_pred n_removed n_lines _key key _id _text c0 c1 rep spans items id component_id kept".split():
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    one = cp.language_id(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    letters = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(kept) <= {r[0] for r in letters} and len(kept) >= 0.9 * len({r[0] for r in letters})

    two = cp.line_dedup(spark, one, str(tmp_path))
    assert two.columns == docs.columns
    assert {(r["score"], r["n_removed"], r["_key"]) for r in two.collect()} == {("clash",) * 3}
    gone = brute.repeated_runs(sorted(kept.items()), 2, 200)
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in kept.items()}
    left = {i: t for i, t in left.items() if not gone[i] or t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == left

    three = cp.near_dedup(spark, two, str(tmp_path))
    assert three.columns == docs.columns
    groups = brute.near(sorted(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    got = three.collect()
    assert {r["doc_id"]: r["text"] for r in got} == left and len(got) == len(left)

    four = cp.decontaminate(spark, three, str(tmp_path))
    assert four.columns == docs.columns
    left = {i: t for i, t in left.items() if not brute.hits(t, items, 10)[1]}
    assert {r["doc_id"]: r["text"] for r in four.collect()} == left

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in cp.run(spark, str(tmp_path)).orderBy(F.col("start")).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(left)
    for i, t in left.items():
        ids = np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in pieces[i]]).tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids + [1]


def test_stages_are_named():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]


def test_documents_that_share_an_id_or_have_none(spark, tmp_path):
    import random

    from .conftest import words

    rng = random.Random(5)
    a, b, c, d, item = (words(rng, 40) for _ in range(5))
    leak = f"{words(rng, 5)} {item} {words(rng, 5)}"
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y"), (2, a, "z"), (None, b, "y"), (None, c, "x"), (None, c, "w"), (3, d, "x"), (3, leak, "x"), (None, leak, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    out = cp.near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert pairs(out) == sorted([(1, a), (1, b), (None, c), (3, d), (3, leak)], key=repr)
    out = cp.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert pairs(out) == sorted(((i, t) for i, t, _ in rows if t != leak), key=repr)


def test_results_that_the_caller_writes_reach_workers_in_short_batches(spark, tmp_path, monkeypatch):
    frame, rows = type(spark.range(0)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain, before = frame.mapInArrow, spark.conf.get(rows)

    def spied(self, fn, schema, *args, **more):
        def seen(batches):
            import uuid

            def noted():
                for b in batches:
                    with open(f"{tmp_path}/{uuid.uuid4().hex}.seen", "w") as f:
                        f.write(str(b.num_rows))
                    yield b

            yield from fn(noted())

        return plain(self, seen, schema, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('some words ', id) as text", "'en' as lang", "'s' as source", "20L as n_chars")
    cp.language_id.__globals__["table"](spark, "/root/testdata/sf0.001", "region")  # workers find the package
    for name in ("language_id", "packing"):
        spark.conf.set(rows, "10000")
        try:
            dict(cp.STAGES)[name](spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        finally:
            spark.conf.set(rows, before)
        sizes = [int(p.read_text()) for p in tmp_path.glob("*.seen")]
        assert sum(sizes) == 2500 and max(sizes) <= 1000
        for p in tmp_path.glob("*.seen"):
            p.unlink()
