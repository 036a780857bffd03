"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from strikeline.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_tokens": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_lines": {"doc_id": "bigint", "line_no": "int", "class_doc_id": "bigint", "class_line_no": "int", "kept": "boolean"},
    "op7_secrets": {"doc_id": "bigint", "word_no": "int", "score": "double", "is_secret": "boolean"},
    "op8_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "bigint", "start": "bigint", "end": "bigint"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op11_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def plain(v):
    """Numbers as floats, and one kind of null."""
    return None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_every_operator_has_a_query():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.toPandas()
    assert len(rows)
    if name in ("op3_quality", "op4_simhash", "op5_tokens", "op8_licenses", "op10_sharding", "op12_manifest", "op13_sentencepiece"):
        assert sorted(rows.doc_id) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(ORACLES[name]).df()
        cols = sorted(want.columns)
        a, b = ([[plain(v) for v in r] for r in x[cols].values.tolist()] for x in (rows, want))
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_pipeline_stages_match_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.count()
        assert 0 < got <= n
        docs, n = out, got
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_runs(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(got)
    for r in got.head(50).itertuples():
        assert len(np.frombuffer(r.ids, "<u4")) == r.length and zlib.crc32(r.ids) >= 0
