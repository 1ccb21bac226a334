"""Near duplicates, repeated substrings and repeated lines against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripelake.llm import induced, near_dedup
from stripelake.llm.line_dedup import drop_repeated_lines
from stripelake.llm.near_dedup import near_groups
from stripelake.llm.substring_dedup import drop_repeats

from . import brute


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups(docs, texts, k, percent):
    want = brute.near([(i * 3, t) for i, t in enumerate(texts)], k, percent)
    got = near_groups(docs, k=k, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_near_groups_of_one_area_are_compared_in_blocks(spark, monkeypatch):
    """Many variants of one text, of which few are linked: no link may be lost."""
    import random

    from .conftest import edit, words

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(i, edit(rng, base, rng.choice([0.01, 0.03, 0.06]))) for i in range(90)]
    want = brute.near(rows, 3, 85)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 90


def test_estimate_is_near_the_truth():
    rng = np.random.RandomState(3)
    for share in (0.0, 0.5, 0.85):
        x = np.unique(rng.randint(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) << np.uint64(1))
        keep = int(len(x) * 2 * share / (1 + share))
        y = np.unique(np.concatenate((rng.permutation(x)[:keep], rng.randint(0, 2**63, len(x) - keep, dtype=np.int64).astype(np.uint64) << np.uint64(1))))
        r = near_dedup.registers([x, y])
        assert abs(near_dedup.estimate(r[0], r[1]) - share) < 0.15


@pytest.mark.parametrize("size", [200, 40])
@pytest.mark.parametrize("limits", [{}, {"in_memory": 3}, {"hot": 2}, {"hot": 1}, {"hot": 10, "in_memory": 1}])
def test_drop_repeats(docs, size, limits):
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r, (data, mask) in zip(rows, brute.repeats([r["text"] for r in rows], size)):
        spans = sum(1 for i in range(len(mask)) if mask[i] and (not i or not mask[i - 1]))
        want[(r["doc_id"], r["text"])] = (len(data), sum(mask), spans, bytes(c for c, m in zip(data, mask) if not m))
    got = drop_repeats(docs, size=size, **limits).collect()
    assert len(got) == len(rows)
    by_id = {i: v for (i, _), v in want.items()}
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == by_id[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("seed", range(4))
def test_induced_sorting(seed, monkeypatch, tmp_path):
    monkeypatch.setattr(induced, "BLOCK", 7)
    rng = np.random.RandomState(seed)
    left, depth = 6, 5
    text = rng.randint(97, 99, (40, left + 2 * depth)).astype(np.uint8)
    group = np.sort(rng.randint(0, 3, 40))
    got = induced.repeated(text, group, left, depth)
    for g in range(3):
        rows = np.flatnonzero(group == g)
        assert (induced.repeated_on_disk(text[rows], left, depth, str(tmp_path)) == got[rows]).all() if len(rows) else True
        for i in rows:
            for c in range(left + 1):
                same = [j for j in rows if j != i and (text[j, c : c + depth] == text[i, c : c + depth]).all()]
                assert got[i, c] == bool(same)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_drop_repeated_lines(docs, texts, k):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute.repeated_lines(rows, k)
    got = drop_repeated_lines(docs, min_lines=k)
    assert got.columns == docs.columns + ["n_lines", "n_removed", "n_runs", "longest_run"]
    old = dict(rows)
    assert {r["_key"] for r in got.collect()} == {"7"}
    for r in got.collect():
        gone, text = want.get(r["doc_id"], set()), old[r["doc_id"]]
        lines = [] if text is None else text.split("\n")
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(gone))
        assert r["n_runs"] == sum(1 for p in gone if p - 1 not in gone)
        assert r["text"] == (None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone))
        assert (r["longest_run"] >= 1) or not gone


def test_empty_tables(none):
    assert near_groups(none).count() == 0
    assert drop_repeats(none).count() == 0
    assert drop_repeated_lines(none).count() == 0


def test_one_document(spark):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert near_groups(one).select("component_id", "kept").collect() == [(1, True)]
    assert drop_repeats(one).select("n_removed").collect() == [(0,)]
    assert drop_repeated_lines(one).select("n_removed").collect() == [(0,)]
    nothing = one.withColumn("text", F.lit(None).cast("string"))
    assert drop_repeated_lines(nothing).select("n_lines", "text").collect() == [(0, None)]


def test_lone_lines(spark):
    """A long line goes without a neighbour that repeats, also as a whole document; a short one stays."""
    long, bytes_ = "é" * 20, 40
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, f"{'é' * 19}x"), (5, "x\na"), (6, f"{'é' * 19}x\ne\n{long}"), (7, None)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), lone_bytes=bytes_)
    want = {**dict(rows), 2: "c\nd", 3: "", 6: f"{'é' * 19}x\ne"}  # 39 bytes are too few
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert {r["doc_id"]: (r["n_removed"], r["n_runs"], r["longest_run"]) for r in got.where("n_removed > 0").collect()} == {i: (1, 1, 1) for i in (2, 3, 6)}


def test_lone_lines_and_runs(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    pairs, single = brute.repeated_lines(rows, 2), brute.repeated_lines(rows, 1)
    texts = {i: t.split("\n") for i, t in rows if t is not None}
    want = {i: pairs[i] | {p for p in single[i] if len(lines[p].encode()) >= 100} for i, lines in texts.items()}
    assert any(want[i] - pairs[i] for i in want)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in drop_repeated_lines(docs, lone_bytes=100).where("text is not null").collect()}
    assert got == {i: (len(gone), "\n".join(x for p, x in enumerate(texts[i]) if p not in gone)) for i, gone in want.items()}


@pytest.mark.parametrize("name", ["op1_near_dedup", "op4_line_dedup", "op6_decontaminate"])
def test_queries_against_sql(spark, name):
    import duckdb

    from stripelake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
