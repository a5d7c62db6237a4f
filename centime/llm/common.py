"""Helpers shared by the corpus operators: written tables, byte chunks of
Arrow batches, vectorised tokenising and hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_BYTES = 4 << 20  # text handled at once inside a task

UPPER = bytes(range(65, 91))
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# ASCII A-Z lowered and every white-space byte made a space
LOWER_SPACE_TABLE = bytes(32 if c == 32 or 9 <= c <= 13 else LOWER_TABLE[c] for c in range(256))


def written(df: DataFrame, name: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder and
    read back: lineage is cut, a lost executor re-reads the files, and later
    readers prune columns (which an RDD checkpoint cannot)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    w = df.write.option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null id: bucket of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as UTF-8 bytes, null as empty): only these two columns travel to Python."""
    return df.select(F.col(id_col).alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def hash_sample(df: DataFrame, h: Column, n: int, name: str) -> DataFrame:
    """The ``n`` rows with the smallest hash ``h``, whatever the partitioning.  A
    share that holds about 2 n rows is cut out first, in the tasks, so that
    what tasks send for the final choice does not grow with their number."""
    rows, top = df.count(), 1 << 30
    place = F.pmod(h, F.lit(top))
    if rows > 2 * n:
        df = df.where(place < int(top * 2 * n / rows))
    return written(df.withColumn("_place", place), name).orderBy("_place", *df.columns).limit(n).drop("_place")


def rows_for(batches, limit: int = CHUNK_BYTES):
    """(ids, texts) runs of bounded size from the record batches of ``text_bytes``."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        lens = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4))
        a = size = 0
        for i, n in enumerate(lens.tolist()):
            if size and size + n > limit:
                yield ids.slice(a, i - a), col.slice(a, i - a).to_pylist()
                a, size = i, 0
            size += n + 1
        if a < len(lens):
            yield ids.slice(a), col.slice(a).to_pylist()


def u64_view(data: bytes | np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at every byte offset (zeros after the end);
    what is such a view already stays as it is."""
    if isinstance(data, np.ndarray) and data.dtype == np.uint64:
        return data
    raw = bytes(data) + b"\0" * 8
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def words(text: bytes, table: bytes = LOWER_SPACE_TABLE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of the bytes after ``table``, which makes a space of whatever
    parts words: (the words with one space after each, start and end of each)."""
    a = np.frombuffer(text.translate(table) + b" ", np.uint8)
    keep = a != 32
    keep[1:] |= keep[:-1].copy()
    flat = a[keep]
    ends = np.flatnonzero(flat == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return flat.tobytes(), starts, ends


def doc_words(texts: list[bytes], table: bytes = LOWER_SPACE_TABLE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of several documents and the first word of each (n + 1 values)."""
    joined = b"\n".join(texts)
    flat, starts, ends = words(joined, table)
    a = np.frombuffer(joined.translate(table), np.uint8) != 32
    first = a.copy()
    first[1:] &= ~a[:-1]
    begin = np.flatnonzero(first)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    offs = np.concatenate([[0], np.cumsum(lens + 1)])
    return flat, starts, ends, np.searchsorted(begin, offs)


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K1
    return h ^ (h >> np.uint64(32))


def span_hashes(data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step, all spans together."""
    view = u64_view(data)
    h = mix64(lens.astype(np.uint64) * _K1 + np.uint64(1))
    step, at = 0, None
    while True:
        at = np.flatnonzero(lens > 8 * step) if at is None else at[lens[at] > 8 * step]
        if not len(at):
            return h
        v = view[starts[at] + 8 * step]
        rest = lens[at] - 8 * step
        short = rest < 8
        v[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[at] = mix64(h[at] * np.uint64(3) ^ v)
        step += 1


def group_equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, place of one member of each, group of every value)."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return s[new], order[new], group


class UnitMemo:
    """Encodings of distinct text units, found by 64-bit hashes: a unit that
    occurs again costs a lookup in sorted arrays.  ``encode`` turns a list of
    units into a list of id sequences.  Beyond ``limit`` units the memo begins
    anew, which costs time and changes nothing."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.first, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        ids, sizes = self.encode(units)
        begin, n = self.first[self.n], self.n
        ends = begin + np.cumsum(sizes)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while n + len(units) + 1 > len(self.first):
            self.first = np.concatenate([self.first, self.first])
        self.flat[begin:ends[-1]] = ids
        self.first[n + 1:n + 1 + len(units)] = ends
        self.n = n + len(units)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        self.keys, self.slots = keys[order], np.concatenate([self.slots, np.arange(n, self.n)])[order]

    def ids(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a run, number of ids of each unit)."""
        if not len(starts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if self.n > self.limit:
            self._forget()
        keys, where, inverse = group_equal(span_hashes(data, starts, lens))
        at = np.searchsorted(self.keys, keys)
        new = at == len(self.keys)
        new[~new] = self.keys[at[~new]] != keys[~new]
        if new.any():
            a, b = starts[where[new]], starts[where[new]] + lens[where[new]]
            self._learn(keys[new], [data[i:j] for i, j in zip(a.tolist(), b.tolist())])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][inverse]
        n = self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[slot] - (ends - n), n) + np.arange(ends[-1])], n
