"""Operator 10, token counts: batch encoding in an Arrow function that returns lengths only.

Each Arrow batch is cut into parts of about equal bytes; the texts of a part are split at ASCII white space, a safe
boundary (see :mod:`.words`), and a word is encoded when it first occurs. Long texts are thus no larger a unit than
short ones.

Null texts and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row; tokenizer_path: a tokenizers .json file that every executor has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = words.counts(tokenizer_path)
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            n: list[int] = []
            for part in words.by_bytes(texts):
                split, kept = library.look_up(part)
                n += [sum(map(kept.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
