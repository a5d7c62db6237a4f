"""The corpus in compressed blocks of bounded size.

Operators that ask the whole corpus about a document's parts and need the
answers beside its text read the blocks several times; a block's number and the
order of its documents are written once and stay.  Text travels compressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_for, written

BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id


def squeeze(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) for a in arrays]


def stretch(raw: bytes, kind, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b"", kind)


def make_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, docs, bytes, n_learn, learn_bytes, ids, sizes, learn, text), written; ``learn``
    marks the documents that a model may learn from (all if not given)."""
    mark = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    src = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), mark.alias("learn")).alias("key"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(rows_for(batches, block_bytes)):
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            ids, marks = keys.flatten()
            may = marks.to_numpy(zero_copy_only=False).astype(bool)
            packed = squeeze(ids.fill_null(NO_ID).to_numpy(), size, may, np.frombuffer(b"".join(texts), np.uint8))
            counts = (part | number, len(texts), int(size.sum()), int(may.sum()), int(size[may].sum()))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x], pa.int64()) for x in counts], *[pa.array([x], pa.binary()) for x in packed]],
                ["block", "docs", "bytes", "n_learn", "learn_bytes", "ids", "sizes", "learn", "text"])

    out = src.mapInArrow(run, "block long, docs long, bytes long, n_learn long, learn_bytes long, "
                              "ids binary, sizes binary, learn binary, text binary")
    return written(out, "blocks", "none")


def block_texts(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(ids, sizes, texts in one run) of a block's row."""
    n = row["docs"]
    return (stretch(row["ids"], np.int64, n), stretch(row["sizes"], np.int64, n),
            stretch(row["text"], np.uint8, row["bytes"]).tobytes())
