"""Incremental linkage: new candidate records arrive as a stream and are blocked and scored against the S1 records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.config import DEFAULT, Linkage
from weftline.operators.blocking import candidates
from weftline.operators.records import build_base, finalize, prepare


def link_stream(raw: DataFrame, s1_records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, cfg: Linkage = DEFAULT, once: bool = True) -> StreamingQuery:
    """Starts a query that gives `write` the pairs (country, s1, c, mask) of each micro-batch of raw S2 / S3 rows.

    s1_records: prepared S1 records. Caps count the candidates of a batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = prepare(finalize(build_base(batch))).select(*s1_records.columns)
        write(candidates(s1_records.unionByName(fresh), cfg=cfg), number)

    out = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
