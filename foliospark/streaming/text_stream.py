"""Streaming forms: stateful text positions over arriving fragments, and windows over events with a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id string, first_position bigint, last_position bigint, text string"


def stream_text(fragments: DataFrame, min_font_size: float = 0.0, max_buffer: int = 1 << 20) -> DataFrame:
    """(doc_id, first_position, last_position, text): a document's text as it arrives, with its running position.

    State is one number per document.  Fragments of a batch are ordered by page
    and sequence; a piece larger than ``max_buffer`` characters is emitted in
    parts, nothing is dropped.
    """

    def step(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        pdf = pd.concat(list(pdfs)).sort_values(["page_idx", "seq"])
        rows = []
        text = " ".join(t for t, s in zip(pdf.text, pdf.font_size) if t and s >= min_font_size)
        for i in range(0, len(text), max_buffer):
            part = text[i : i + max_buffer]
            rows.append((key[0], at, at + len(part), part))
            at += len(part)
        state.update((at,))
        yield pd.DataFrame(rows, columns=["doc_id", "first_position", "last_position", "text"])

    return fragments.select("doc_id", "page_idx", "seq", "text", "font_size").groupBy("doc_id").applyInPandasWithState(step, OUT, "position bigint", "append", GroupStateTimeout.NoTimeout)


def stream_chunks(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """The fixed-window chunker is row-local, so it runs on a stream as it is."""
    from ..operators.chunking import fixed_windows

    return fixed_windows(documents, "doc_id", "text", size, overlap)


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")
