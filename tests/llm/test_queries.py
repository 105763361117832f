"""The registered queries: SQL where there is some, and the pipeline against brute force."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kitmeter.llm import decontam, langid, queries

from .test_operators import brute_classes, brute_entropy, brute_secrets

TABLES = ("documents", "benchmark", "pages", "labels", "conversations", "embeddings")


def test_names():
    assert [f"op{k}_" for k in range(1, 14)] == [n.split("_")[0] + "_" for n in queries.queries()]
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    other = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    mine = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(map(repr, (tuple(r) for r in mine.select(*columns).collect()))) == sorted(map(repr, other))


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(got) > 100 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.97


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "best_two_fit":
            assert {r["doc_id"] for r in got} == set(rows)
            fill = {}
            for r in got:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 2048
            continue
        assert docs.columns == names
        after = {r["doc_id"]: r["text"] for r in got}
        assert len(after) == len(got)
        if name == "language_id":
            assert set(after) <= set(rows) and len(after) >= 0.97 * len(rows)
        elif name == "ngram_jaccard":
            assert set(after) == {c for _, c in brute_classes(list(rows.items())).values()}
        elif name == "decontamination":
            keys = list(rows)
            hit = {k for k, w in zip(keys, decontam.brute_force([rows[k] for k in keys], bench)) if w[4]}
            assert set(after) == set(rows) - hit
        else:
            assert set(after) == set(rows)
            for r in got:
                k = r["doc_id"]
                base = brute_secrets(rows[k])
                found = bool(base or brute_entropy(rows[k]))
                assert (after[k] != rows[k]) == found and r["n_chars"] == len(after[k] or "")
                assert not found or "[SECRET]" in after[k]
        if name not in ("secret_scan",):
            assert all(after[k] == rows[k] for k in after)
        rows = after
    assert zlib.crc32(b"") == 0


def test_pipeline_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
