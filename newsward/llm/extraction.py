"""Main text of HTML pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.block_labels import Labeller, main_blocks
from newsward.llm.common import in_slices
from newsward.llm.html_blocks import blocks, features


def main_texts(model: Labeller, sources: list[str]) -> list[str]:
    """The main blocks of each page, joined by line ends; all blocks of the pages are
    labelled together, each in the context of its whole page."""
    rows = [blocks(source) for source in sources]
    every = features([block for page in rows for block in page]) if any(rows) else None
    pages, at = [], 0
    for page in rows:
        pages.append(every[at : at + len(page)] if len(page) else [])
        at += len(page)
    return ["\n".join(b.text for b, good in zip(page, mark) if good) for page, mark in zip(rows, main_blocks(model, pages))]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text, as does a page without main blocks.
    Repeated pages are extracted each; unclosed elements run on; nothing is cut short.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(model, batch.column(2).to_pylist())
        counts = pa.array([len(text) for text in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(in_slices(work, "html", 1 << 20), "page_id bigint, url string, text string, n_chars bigint")
