"""Operator 5, token ids in binary files of patched frame-of-reference blocks.

``write`` encodes every text in ascending id order (a range partitioning, then
a sort within partitions), appends the end id, and writes shard files; ``read``
reads those files back.  A shard file is a run of segments of bounded size:

    segment := "PFR1" | part u32 | number u32 | documents u32 | tokens u64 |
               blocks u32 | block bytes u64 |
               document ids i64 each | id is null u8 each | ids of each document u32 |
               block starts u32 each | blocks (see ``pfor``) | newline

``part`` is the shard's place in the id order, ``number`` the segment's place in
the shard.  Files go through Spark's own text writer as raw bytes, so they are
committed once whatever task attempts fail, and into any store Spark writes to;
its line end is the newline after each segment.  Files hold a bounded number of
segments, so that a reader holds one small file at a time.

Texts are encoded with the tokenizers library.  For byte-level vocabularies a
text is cut where no pre-token can span: before white space that follows
anything else, and before an ASCII punctuation mark (but the apostrophe) after
an ASCII letter.  Every distinct unit is encoded once a worker (``UnitMemo``);
texts that hold an added token's string or other Unicode white space, and all
texts under other kinds of vocabulary, go to the library whole.

Defined results: null or empty text has the end id only; ids must be integers,
null ids come first; rows that repeat an id follow each other in the order of
their texts' hashes; an empty table writes no segment and reads as an empty
table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from . import pfor
from .common import UnitMemo, rows_for

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQIQ")
SEGMENT_BYTES = 2 << 20  # text of a segment
SEGMENTS_A_FILE = 10
MEMO = 2_000_000
JOINED = 2000  # units that go to the library as one text

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
OTHER_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Encoder:
    """The ids of texts under one tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        spec = json.load(open(path))  # the vocabulary file, a local path on every machine
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.lib = Tokenizer.from_file(path)
        self.separable = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                          and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
                          and all(not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"]))
        added = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        spaces = [chr(c).encode() for c in OTHER_SPACES]
        self.whole = re.compile(b"|".join(added + spaces))
        self.size = np.zeros(max(self.lib.get_vocab().values()) + 1, np.int64)
        for token, i in self.lib.get_vocab().items():  # a letter of a byte-level vocabulary is a byte
            self.size[i] = len(token)
        self.memo = UnitMemo(self._encode_units, MEMO)

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        done = self.lib.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [e.ids for e in done]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units: runs of them go to the library as one text, those
        that don't begin with white space after a newline, whose id is dropped.
        Every unit begins a pre-token there too."""
        plain = [i for i, u in enumerate(units) if not SPACE[u[-1]]]
        rest = [i for i, u in enumerate(units) if SPACE[u[-1]]]  # white space that ends a text
        n, done = np.zeros(len(units), np.int64), []
        for a in range(0, len(plain), JOINED * 8):
            runs, spans = [], []
            for b in range(a, min(a + JOINED * 8, len(plain)), JOINED):
                part = plain[b:b + JOINED]
                spaced = [SPACE[units[i][0]] for i in part]
                glued = [units[i] if s else b"\n" + units[i] for i, s in zip(part, spaced)]
                runs.append(b"".join(glued))
                spans.append((part, np.array(spaced), np.cumsum(np.fromiter(map(len, glued), np.int64, len(glued)))))
            for (part, spaced, ends), raw, ids in zip(spans, runs, self._library(runs)):
                ids = np.array(ids, np.int32)
                at = np.cumsum(self.size[ids])
                cut = np.searchsorted(at, ends) + 1
                if at[-1] != len(raw) or (at[cut - 1] != ends).any():  # not UTF-8
                    rest += part
                    continue
                keep = np.ones(len(ids), bool)
                keep[(cut - np.diff(cut, prepend=0))[~spaced]] = False
                n[part] = np.diff(cut, prepend=0) - ~spaced
                done.append((part, ids[keep]))
        for a in range(0, len(rest), JOINED):
            part = rest[a:a + JOINED]
            lists = self._library([units[i] for i in part])
            n[part] = np.fromiter(map(len, lists), np.int64, len(lists))
            done.append((part, np.fromiter(chain.from_iterable(lists), np.int32)))
        out, end = np.empty(n.sum(), np.int32), np.cumsum(n)
        for part, ids in done:
            k = n[part]
            out[np.repeat(end[part] - np.cumsum(k), k) + np.arange(len(ids))] = ids
        return out, n

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a run, number of ids of each text)."""
        apart = [not self.separable or bool(self.whole.search(t)) for t in texts]
        if any(apart):
            out: list = [None] * len(texts)
            for i, ids in zip((i for i, x in enumerate(apart) if x), self._library([t for t, x in zip(texts, apart) if x])):
                out[i] = np.array(ids, np.int32)
            rest = [i for i, x in enumerate(apart) if not x]
            flat, n = self._units([texts[i] for i in rest])
            for i, part in zip(rest, np.split(flat, np.cumsum(n)[:-1]) if rest else []):
                out[i] = part
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        return self._units(texts)

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        a = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(a) + 1, bool)
        space = SPACE[a]
        cut[1:-1] = (space[1:] & ~space[:-1]) | (MARKS[a[1:]] & LETTER[a[:-1]])
        first = np.cumsum(size) - size
        cut[first] = True
        cut[-1] = False
        start = np.flatnonzero(cut)
        ids, n = self.memo.ids(data, start, np.diff(start, append=len(a)))
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.searchsorted(start, np.append(first, len(a)))
        return ids, np.diff(total[at])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, whose memo outlives a task.  (A module's function:
    one inside ``write`` would travel with a dictionary of its own.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def segment(part: int, number: int, keys: pa.Array, ids: np.ndarray, n: np.ndarray) -> bytes:
    body, start = pfor.pack(ids.astype(np.uint32))
    null = np.asarray(keys.is_null()).astype(np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, part, number, len(n), len(ids), len(start), len(body)),
        keys.fill_null(0).to_numpy().astype("<i8").tobytes(), null.tobytes(), n.astype("<u4").tobytes(),
        start.astype("<u4").tobytes(), body])


def segments(raw: bytes):
    """(part, number, keys, id counts, ids) of every segment of a file."""
    at = 0
    while at < len(raw):
        magic, part, number, docs, tokens, blocks, size = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at += HEAD.size
        keys = np.frombuffer(raw, "<i8", docs, at)
        null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        n = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        start = np.frombuffer(raw, "<u4", blocks, at)
        at += 4 * blocks
        yield part, number, pa.array(keys, mask=null.astype(bool)), n, pfor.unpack(raw[at:at + size], start, tokens)
        at += size + 1  # the newline


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts as shard files under ``path``."""
    src = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    src = src.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        for number, (keys, texts) in enumerate(rows_for(batches, SEGMENT_BYTES)):
            ids, n = enc.encode(texts)
            out = np.full(len(ids) + len(n), end_id, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            yield pa.RecordBatch.from_arrays([pa.array([segment(part, number, keys, out, n + 1)])], ["segment"])

    (src.select("id", "text").mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
     .write.option("maxRecordsPerFile", SEGMENTS_A_FILE).text(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shard files: part, number, place, id,
    n_tokens, ids (little-endian unsigned 32-bit integers as binary)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                for part, number, keys, n, ids in segments(raw.as_py()):
                    first = np.concatenate([[0], np.cumsum(n)])
                    lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((first * 4).astype(np.int32)),
                                                                        pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(part, pa.int64()), len(n)), pa.repeat(pa.scalar(number, pa.int64()), len(n)),
                         pa.array(np.arange(len(n))), keys, pa.array(n), lists],
                        ["part", "number", "place", "id", "n_tokens", "ids"])

    return files.mapInArrow(run, "part long, number long, place long, id long, n_tokens long, ids binary")


def with_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before each document.  Totals are summed
    in three steps (documents of a segment, segments of a part, parts), so no
    task orders more than one segment, one part's segments, or the parts."""
    seg = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = seg.groupBy("part").agg(F.sum("n").alias("n"))

    def before(w, n="n"):
        return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = parts.select("part", before(Window.orderBy("part")).alias("of_part"))
    seg = seg.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("of_segment"))
    seg = seg.join(parts, "part").select("part", "number", (F.col("of_part") + F.col("of_segment")).alias("before"))
    own = before(Window.partitionBy("part", "number").orderBy("place"), "n_tokens")
    return rows.withColumn("own", own).join(seg, ["part", "number"]).withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def shard_path(spark: SparkSession) -> str:
    return scratch_path(spark, f"token-shards-{uuid.uuid4().hex}")
