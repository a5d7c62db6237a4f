"""Operator 2, benchmark decontamination over a distributed positional index.

* **Index** (``build_index``): every task tokenises its documents in segments
  of bounded size and writes, for each term of a segment, one row with the
  sorted list of its positions (delta coded), and one row per document with
  the position of its first word.  The index is parted by document, as search
  engines do it: a term's postings never meet in one place, so a word that
  holds a third of all tokens is as harmless as any other, and building needs
  no shuffle.  Neighbouring documents lie ``GAP`` positions apart, so no match
  crosses them.
* **Query** (``search``): only the postings of terms that the benchmark has are
  read back and brought together by segment, with the segment's documents.
  For each window the rarest term's list gives the candidate starts (position
  less offset); the lists of the other terms, rarest first, each drop those
  candidates that they do not hold at start + offset.  With ``slop`` = 0 that
  is the exact phrase; otherwise a proximity match: every term within ``slop``
  words of its place.

The benchmark is the stated query set.  It is cut into blocks of ``BLOCK``
words; each block is broadcast (16 MB at most) and searched against all rows.

A word is ``[0-9a-z\\x80-\\xff]+`` of the UTF-8 bytes after A-Z are lowered; terms
are 64-bit hashes of words, so a false match needs a window whose words all
agree but for one that collides (about 2^-64 a candidate).

Defined results: null or empty text has no words and is never contaminated;
an item without words matches nothing; repeated rows each get their result;
with an empty benchmark nothing is hit; an empty table gives an empty table;
other columns are ignored by ``annotate`` and kept by ``remove``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType)

from .common import LOWER_TABLE, doc_words, rows_for, span_hashes, text_bytes, written

GAP = 64  # positions between documents; more than a window and its slop
SEGMENT_BYTES = 16 << 20
BLOCK = 2_000_000  # benchmark words that are broadcast at once
TERMS = 1_000_000  # query terms up to which their set is broadcast
CANDIDATES = 1 << 20  # candidates checked at once inside a task

WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER_TABLE)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: posting rows (seg, term, positions) and document
    rows (seg, base, n_words, id) in one table; ``base`` is null on postings."""
    src = text_bytes(docs, id_col, text_col)
    schema = StructType([StructField("seg", LongType()), StructField("term", LongType()),
                         StructField("positions", BinaryType()), StructField("base", LongType()),
                         StructField("n_words", LongType()), StructField("id", src.schema["id"].dataType)])

    def run(batches):
        names = schema.fieldNames()
        part = TaskContext.get().partitionId() << 32
        for seq, (ids, texts) in enumerate(rows_for(batches, SEGMENT_BYTES)):
            flat, starts, ends, first = doc_words(texts, WORD_TABLE)
            n = np.diff(first)
            base = first[:-1] + GAP * np.arange(len(n))
            pos = np.arange(first[-1]) + GAP * np.repeat(np.arange(len(n)), n)
            h = span_hashes(flat, starts, ends - starts).view(np.int64)
            order = np.argsort(h, kind="stable")
            h, pos = h[order], pos[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            delta = np.diff(pos, prepend=0)
            delta[new] = pos[new]
            offs = np.concatenate([new, [len(h)]]) * 4
            lists = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offs.astype(np.int32)),
                                                                  pa.py_buffer(delta.astype(np.uint32))])
            seg = pa.scalar(part | seq, pa.int64())

            def rows(k, **cols):
                return pa.RecordBatch.from_arrays(
                    [cols.get(c) if c in cols else pa.nulls(k, ids.type if c == "id" else pa.binary() if c == "positions" else pa.int64())
                     for c in names], names)

            yield rows(len(ids), seg=pa.repeat(seg, len(ids)), base=pa.array(base), n_words=pa.array(n), id=ids)
            for a in range(0, len(new), 50_000):
                b = min(a + 50_000, len(new))
                yield rows(b - a, seg=pa.repeat(seg, b - a), term=pa.array(h[new[a:b]]), positions=lists.slice(a, b - a))

    return written(src.mapInArrow(run, schema), "positional-index")


class Block:
    """Benchmark items as one run of term hashes; windows are cut in the tasks."""

    def __init__(self, items: list[str], terms: list[np.ndarray], window: int):
        self.items, self.window = items, window
        self.terms = np.concatenate(terms)
        n = np.fromiter(map(len, terms), np.int64, len(terms))
        first = np.cumsum(n) - n
        k = np.maximum(n - window, 0) + 1
        self.item = np.repeat(np.arange(len(n)), k)
        self.start = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(k.sum())
        self.length = np.repeat(np.minimum(n, window), k)


def item_terms(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = text_bytes(bench, id_col, text_col)
    src = src.select(F.col("id").cast("string").alias("id"), "text")

    def run(batches):
        for ids, texts in rows_for(batches):
            flat, starts, ends, first = doc_words(texts, WORD_TABLE)
            h = span_hashes(flat, starts, ends - starts).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([ids, lists], ["id", "terms"])

    return src.mapInArrow(run, "id string, terms array<long>").where(F.size("terms") > 0)


def blocks(bench: DataFrame, id_col: str, text_col: str, window: int):
    """The query set in blocks of at most ``BLOCK`` words (or one longer item)."""
    items, terms, size = [], [], 0
    for r in written(item_terms(bench, id_col, text_col), "benchmark-terms").orderBy("id").toLocalIterator():
        if size and size + len(r.terms) > BLOCK:
            yield Block(items, terms, window)
            items, terms, size = [], [], 0
        items.append("" if r.id is None else r.id)
        terms.append(np.array(r.terms, np.int64))
        size += len(r.terms)
    if items:
        yield Block(items, terms, window)


def intersect(block: Block, terms: np.ndarray, lists: list[bytes], slop: int = 0):
    """(start position, window) of every match within one segment."""
    order = np.argsort(terms)
    terms = terms[order]
    data = [np.frombuffer(lists[i], np.uint32).astype(np.int64) for i in order]
    tf = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.cumsum(tf) - tf
    pos = np.cumsum(np.concatenate(data))
    pos -= np.repeat(pos[begin] - np.array([d[0] for d in data]), tf)  # deltas start anew in every list
    span = int(pos.max()) + GAP + 1
    keys = np.repeat(np.arange(len(tf)), tf) * span + pos

    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    local = np.where(terms[at] == block.terms, at, -1)
    absent = np.concatenate([[0], np.cumsum(local < 0)])
    wins = np.flatnonzero(absent[block.start + block.length] == absent[block.start])
    found = []
    while len(wins):
        col = np.arange(block.window)
        part = wins[: CANDIDATES // block.window]
        inside = col < block.length[part][:, None]
        t = local[np.minimum(block.start[part][:, None] + col, len(local) - 1)]
        freq = np.where(inside, tf[t], np.iinfo(np.int64).max)
        upto = max(1, int(np.searchsorted(np.cumsum(freq.min(axis=1)), CANDIDATES)))
        part, t, freq, wins = part[:upto], t[:upto], freq[:upto], wins[upto:]
        rare = np.argsort(freq, axis=1, kind="stable")
        row = np.arange(len(part))
        n = freq[row, rare[:, 0]]
        cand = np.repeat(row, n)
        start = pos[np.repeat(begin[t[row, rare[:, 0]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] - rare[cand, 0]
        for j in range(1, block.window):
            more = block.length[part][cand] > j
            off = rare[cand, j]
            want = start + off
            key = t[cand, off] * span
            hit = np.searchsorted(keys, key + np.maximum(want - slop, 0))
            ok = (want + slop >= 0) & (hit < len(keys))
            ok &= keys[np.minimum(hit, len(keys) - 1)] <= key + np.minimum(want + slop, span - 1)
            keep = ok | ~more
            cand, start = cand[keep], start[keep]
        found.append((start, part[cand]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(index: DataFrame, block: Block, work, schema: StructType) -> DataFrame:
    """``work(block, documents of a segment, start, window)`` for every segment."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)
    distinct = np.unique(block.terms)
    terms = spark.createDataFrame(pa.table({"term": distinct}))
    if len(distinct) <= TERMS:
        terms = F.broadcast(terms)
    postings = index.where("base is null").join(terms, "term", "left_semi").select("seg", "term", "positions")
    heads = index.where("base is not null").select(F.col("seg").alias("of"), "base", "n_words", "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("base")
        start = win = np.empty(0, np.int64)
        if left.num_rows:
            start, win = intersect(shared.value, left["term"].to_numpy(), left["positions"].to_pylist(), work.slop)
        return work(shared.value, right, start, win)

    return heads.groupBy("of").cogroup(postings.groupBy("seg")).applyInArrow(lambda h, p: run(p, h), schema)


class _Matches:
    def __init__(self, slop: int):
        self.slop = slop

    def __call__(self, block, docs, start, win):
        base, n = docs["base"].to_numpy(), docs["n_words"].to_numpy()
        doc = np.maximum(np.searchsorted(base, start + self.slop, side="right") - 1, 0)
        return pa.table({
            "id": docs["id"].take(pa.array(doc)),
            "item_id": pa.array([block.items[i] for i in block.item[win]], pa.string()),
            "start": pa.array(np.clip(start - base[doc], 0, np.maximum(n[doc] - 1, 0))),
            "length": pa.array(block.length[win])})


class _Coverage:
    """Per document of a segment: words inside a match and the items matched."""

    slop = 0

    def __call__(self, block, docs, start, win):
        base, n = docs["base"].to_numpy(), docs["n_words"].to_numpy()
        end = int(base[-1] + n[-1]) + 1
        edge = np.zeros(end + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + block.length[win], -1)
        hit = np.flatnonzero(np.cumsum(edge) > 0)
        cut = np.searchsorted(hit, np.concatenate([base, [end]]))
        doc = np.searchsorted(base, start, side="right") - 1
        pairs = np.unique(doc * len(block.items) + block.item[win])
        which = np.searchsorted(pairs, np.arange(len(base) + 1) * len(block.items))
        items = pa.array([block.items[i] for i in pairs % len(block.items)], pa.string())
        return pa.table({
            "seg": docs["of"], "base": docs["base"], "id": docs["id"], "n_words": docs["n_words"],
            "hit": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(hit)),
            "items": pa.ListArray.from_arrays(pa.array(which.astype(np.int32)), items)})


def matches(index: DataFrame, bench: DataFrame, window: int = 13, slop: int = 0,
            item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, length) of every window of ``bench`` found in the
    indexed documents: exact phrases, or with ``slop`` proximity matches."""
    if window + 2 * slop >= GAP:
        raise ValueError(f"window + 2 * slop must stay under {GAP}")
    schema = StructType([index.schema["id"], StructField("item_id", StringType()), StructField("start", LongType()),
                         StructField("length", LongType())])
    out = [_search(index, b, _Matches(slop), schema) for b in blocks(bench, item_col, text_col, window)]
    if not out:
        return index.sparkSession.createDataFrame([], schema)
    for o in out[1:]:
        out[0] = out[0].unionByName(o)
    return out[0]


def annotate(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted ids)."""
    index = build_index(docs, id_col, text_col)
    schema = StructType([index.schema["seg"], index.schema["base"], index.schema["id"], index.schema["n_words"],
                         StructField("hit", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])
    out = [_search(index, b, _Coverage(), schema) for b in blocks(bench, item_col, item_text_col, window)]
    if not out:
        none = index.where("base is not null").select("id", "n_words", F.lit(0).cast("long").alias("n_hit"),
                                                      F.array().cast("array<string>").alias("items"))
        return none
    if len(out) == 1:
        return out[0].select("id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    both = both.groupBy("seg", "base").agg(  # a document's own words bound these lists
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.select("id", "n_words", "n_hit", "items")


def contaminated():
    """A document is contaminated when a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged.  Rows that
    agree in id and text have one verdict, so these two name them."""
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("x"))
    found = annotate(docs.select(key.alias("id"), F.col(text_col).alias("text")), bench, window, "id", "text",
                     item_col, item_text_col)
    bad = written(found.where(contaminated()).select("id.i", "id.x").distinct(), "contaminated")
    return docs.join(bad, F.col(id_col).eqNullSafe(bad["i"]) & (F.xxhash64(docs[text_col]) == bad["x"]), "left_anti")
