"""The registered queries themselves: every row of their table, the columns that are promised, and their values."""

import hashlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagweave.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
PROMISED = {
    "op1_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3_ngram_jaccard": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op4_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
                        "base_sha256": "string", "spans": "string"},
    "op5_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
                          "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_line_dedup": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_removed": "bigint"},
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", PROMISED)
def test_registered_queries(spark, name):
    texts = {d: t or "" for d, t in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()}
    df = QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert PROMISED[name].items() <= kinds.items()
    rows = {r.doc_id: r for r in df.collect()}
    assert rows.keys() == texts.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in texts.items():
        row = rows[doc]
        if name == "op1_token_counts":
            count = len(library.encode(text, add_special_tokens=False).ids)
            assert row[:4] == (doc, len(text.encode()), count, count > 1024)
        elif name == "op5_bpe_round_trip":
            ids = library.encode(text, add_special_tokens=False).ids
            assert row[:4] == (doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        elif name == "op6_toxicity":
            assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
        elif name == "op8_quality_rules":
            assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
            assert not (row.base_failed and row.kept)
        elif name == "op10_line_dedup":
            assert row.n_lines == text.count("\n") + 1 and row.n_removed == row.n_lines - (
                row.text.count("\n") + 1 if row.text or row.n_removed < row.n_lines else 0)


@pytest.mark.parametrize("name", ["op4_secret_scan", "op7_warc_revisits"])
def test_registered_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)
