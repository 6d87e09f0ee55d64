"""Streaming ingest: micro-batches are staged under their batch ids, so that a replayed batch is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandlog.ledger import Ledger


def track_stream(stream: DataFrame, ledger: Ledger, file: str, sources: list[str], checkpoint: str, text_column: str | None = None, token_count: str | None = None, tokenizer: str | None = None, compact_every: int = 0, available_now: bool = True) -> StreamingQuery:
    """Track every record of a stream. Positions of token entries are given by compact, which one writer runs: here
    after every ``compact_every`` batches (0: never)."""

    def write(batch: DataFrame, number: int) -> None:
        ledger.track(batch, file, sources, text_column=text_column, token_count=token_count, tokenizer=tokenizer, batch=f"{stream_name}-{number:012d}")
        if compact_every and (number + 1) % compact_every == 0:
            ledger.compact()

    import hashlib

    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
