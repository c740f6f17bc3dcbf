"""Encoding of a text column with a published byte-level BPE vocabulary.

The vocabulary file (about 1.5 MB, a fixed size that does not grow with the data) is read on the driver
from a path given as parameter and broadcast; each Python worker builds its automaton once and keeps it
and the cache of pre-tokens for all tasks it runs. Texts are encoded whole, batch by batch, with no shuffle.

Defined cases: null and empty texts give an empty list; text that looks like a special token is ordinary
text; blank texts are encoded like any other; duplicates of a document each give their row; other columns
are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.storage import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

_encoders: dict[str, object] = {}


def encoder(content: bytes):
    """The encoder of a vocabulary, one per Python worker."""
    from siftwell.llm.bpe import Encoder

    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def broadcast_vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>, never null) of each row."""
    content = broadcast_vocabulary(df, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(content.value).encode
        for batch in batches:
            flat: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for n, value in enumerate(batch.column(1).to_pylist()):
                if value:
                    flat += run(value)
                ends[n + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = spread(df.select(df[key].alias("key"), df[text].cast("string").alias("text"))).mapInArrow(encode, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
