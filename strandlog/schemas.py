"""Fixed schemas of the ledger's tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, L = T.StringType(), T.BooleanType(), T.LongType()
STRINGS = T.ArrayType(S)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


AUTHORS = _schema(id=S, name=S, email=S, revoked=B)
SECTIONS = _schema(section_hash=S, path=S, authors=STRINGS, contributors=STRINGS, license=S, year=S, revoked=B, sources=STRINGS)
DOCUMENTS = _schema(line_hash=S, file=S, sources=STRINGS, source_type=S, revoked=B, orphan=B)
TOKENS = _schema(pos=L, file_number=T.IntegerType(), token_count=L, sources=STRINGS, tokenizer=S, revoked=B)
EMBEDDINGS = _schema(line_hash=S, embedding=T.ArrayType(T.DoubleType()), model=S, seq=L)
EVENTS = _schema(seq=L, level=S, key=S, file=S, tokenizer=S, action=S)
LOG = _schema(seq=L, ts=S, op=S, detail=T.MapType(S, S), cmd=S)
ARCHIVE = _schema(layer=S, key=S, record=S, archived_at=S, batch_id=L)

TABLES = {
    "authors": AUTHORS,
    "sections": SECTIONS,
    "documents": DOCUMENTS,
    "tokens": TOKENS,
    "embeddings": EMBEDDINGS,
    "events": EVENTS,
    "log": LOG,
    "archive": ARCHIVE,
}
