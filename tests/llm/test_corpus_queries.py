"""The registered queries of the corpus operators on whole small tables: against DuckDB, or against plain code."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievestone.llm import queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    columns = df.columns
    assert sorted(columns) == sorted(want.columns)
    plain = lambda row: tuple(round(float(x), 9) if isinstance(x, float) else x for x in row)
    assert sorted((plain(r) for r in df.select(columns).collect()), key=str) == sorted((plain(r) for r in want.select(*columns).fetchall()), key=str)


def test_token_files_hold_the_librarys_ids(spark):
    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id, text in sorted(texts(spark).items()):
        ids = np.array([*fresh.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op2_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == want


def test_pieces_hold_the_librarys_ids(spark):
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*fresh.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts(spark).items()}
    rows = queries.op7_packing(spark, SF).collect()
    covered, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: len(x) for d, x in ids.items()}
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048


def test_conversations_keep_all_limits(spark):
    rows = queries.pack_conversations(spark, SF).collect()
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda text: len(fresh.encode(text or "", add_special_tokens=False).ids)
    own = [n(r.text) + 1 + (n(turns[c, t - 1].text) if (c, t - 1) in turns else 0) for (c, t), r in turns.items() if r.role == "assistant"]
    assert sum(r.length for r in rows) == sum(own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(s) <= 8 and sum(s) <= 2048 for s in sequences.values()) and max(map(len, sequences.values())) == 8


def test_lines_and_passages_have_their_columns(spark):
    lines = queries.op5_line_dedup(spark, SF)
    assert lines.columns == ["doc_id", "line", "class_doc_id", "class_line", "kept", "text_key"]
    assert lines.count() == sum(bool(x.split()) for t in texts(spark).values() for x in t.split("\n"))
    assert queries.op8_substring_dedup(spark, SF).columns == ["doc_id", "start", "length", "n_words", "first_doc_id", "text_key"]
