"""The queries themselves, on the smallest tables: their columns and rows, and those that SQL can express against it."""

import os

import duckdb
import pytest

from strandlog.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the generated tables")

COLUMNS = {
    "op1_topk_histogram": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op2_substring_superkmer": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_toxicity_channel": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_repetition_suffix": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_shard_histogram_sort": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_pack_bounded": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_pages_consensus": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_similar_rtree": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_language_bigru": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.select(*COLUMNS[name]).collect()
    if name in registry.oracle_sql():
        want = duck.sql(f"SELECT {', '.join(COLUMNS[name])} FROM ({registry.oracle_sql()[name].strip()})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
    key = "page_id" if name == "op8_pages_consensus" else "doc_id"
    if key in types and name != "op6_pack_bounded":
        ids = duck.sql(f"SELECT {key} FROM {'pages' if key == 'page_id' else 'documents'}").fetchall()
        assert sorted(r[key] for r in rows) == sorted(i for (i,) in ids)
    if "held_out" in types:
        import zlib

        held = 2 if name.startswith("op10") else 1
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % (4 if held == 2 else 3) == held) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op3_toxicity_channel":
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op6_pack_bounded":
        tokens = {}
        used = {}
        for r in rows:
            tokens.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(a == b for a, b in tokens.values()) and len(tokens) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
        for pieces in used.values():
            ends = [0, *[sum(length for _, length in sorted(pieces)[: i + 1]) for i in range(len(pieces))]]
            assert [offset for offset, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    if name == "op5_shard_histogram_sort":
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
