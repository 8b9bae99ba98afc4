"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are dealt out again by the bytes of their texts, read from the batch's own offsets, and only one such
part is copied to Python at a time. A text beyond that is cut at safe boundaries (see ``_tokens``) and encoded part
by part, so that a long text costs no more memory than a short one.

Null text: empty, with 0 bytes and 0 tokens. Null ids, repeated rows and further columns, whatever their names: one
output row for every input row. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import _tokens


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            _, offsets = _tokens.utf8(column)
            for a, b in _tokens.by_bytes(offsets):
                n = _tokens.count_tokens(tokenizer, column.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(offsets[a : b + 1])), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)
