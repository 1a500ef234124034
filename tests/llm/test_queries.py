"""Every registered query of the operators over the smallest tables: rows, columns of its contract, and SQL where there is some."""

from __future__ import annotations

import pytest

from tallyweave.llm import queries
from tests.test_oracles import DIR, duck, plain  # noqa: F401

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_decontamination": {"doc_id", "item_id", "score"},
    "op3_sentencepiece": {"doc_id", "piece_ids", "round_trip"},
    "op4_html_text": {"page_id", "url", "text", "n_chars"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_token_counts": {"source", "lang", "tokenizer", "n_docs", "n_tokens"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op9_mpeg_audio": {
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "offsets",
        "duration_ms",
    },
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_collision_search": {"query_id", "rank", "vec_id", "score"},
    "op12_filter_audit": {
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    },
    "op13_turn_repair": {
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    },
}
#: Tables of which a query returns a row each.
WHOLE = {"op4_html_text": "pages"} | dict.fromkeys(
    COLUMNS.keys() - {
        "op2_decontamination", "op4_html_text", "op6_token_counts", "op11_collision_search", "op12_filter_audit", "op13_turn_repair",
    }, "documents",
)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_and_columns(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert set(df.columns) >= COLUMNS[name]
    rows = df.collect()
    if name in WHOLE:
        assert len(rows) == spark.read.parquet(f"{DIR}/{WHOLE[name]}.parquet").count()
    assert rows and not any(r.asDict().get("error") for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = [[plain(r[names.index(c)]) for c in cols] for r in found.fetchall()]
    assert sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{DIR}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
