"""Scoring of documents as they arrive, with a frozen vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomtext.functions.text import tokens
from loomtext.operators.scoring import METHODS, hold


def score_stream(docs: DataFrame, vocab: DataFrame, dim: int, sink: Callable[[DataFrame, int], None], method: str = "unique_IDF", ident: str = "_ref", text: str = "text") -> DataStreamWriter:
    """A writer, not started yet, that scores each batch of the stream ``docs`` with the stored ``vocab`` (word, vec, n, idf)
    and hands (method, _ref, vec) to ``sink`` with the batch's number. Batches are independent of each other, so no
    state or watermark is kept; give the writer a checkpoint location for delivery once."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {sorted(METHODS)}")

    known = hold(vocab, dim) or vocab

    def each(batch: DataFrame, number: int) -> None:
        held = batch.select(F.col(ident).alias("_ref"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
        sink(METHODS[method](held, known, dim).select(F.lit(method).alias("method"), "_ref", "vec"), number)

    return docs.writeStream.foreachBatch(each)
