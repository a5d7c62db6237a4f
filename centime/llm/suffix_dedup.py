"""Operator 9, suffix-array dedup by prefix-free parsing.

Every byte covered by an ``length``-byte string that also starts in a document
with a smaller id is removed.  The corpus is far too large to sort all its
suffixes, and most of them need no sorting:

1. **Blocks.** Texts are written once in compressed blocks of bounded size, so
   that each later step sees the same documents in the same order.
2. **Parsing** (``parse``).  A Karp-Rabin hash runs over the text; the smallest
   one inside a ``length``-byte string is its *trigger*.  Neighbouring strings
   with one trigger form a phrase.  Triggers depend on content alone, so equal
   strings have equal triggers at equal offsets, whatever surrounds them.
3. **Repeated triggers.** Each block sends 32 bits of every distinct trigger hash,
   sorted and delta coded, to one of the buckets that other bits name; the answer is a bit mask of those that occur
   again.  Only phrases of repeated triggers can hold a repeated string; in
   text without repetition nothing goes further.
4. **Dictionary.** Each block sends its distinct phrases of repeated triggers
   with the smallest id that has them.  A bucket makes the dictionary of its
   phrases.  Where a trigger has one phrase only, all its strings belong to
   that phrase's smallest document.  The phrases of the other triggers are
   suffix-sorted to ``length`` bytes by prefix doubling; suffixes of one rank are
   one string, and the smallest document of the phrases that hold it owns it.
5. **Parse.** The owners go back to the blocks, whose phrases repeat them in
   corpus order: a string is dropped where its owner's id is smaller.

Only hashes of distinct triggers, distinct phrases and masks are shuffled,
beside the compressed text (twice).  A trigger that holds a third of the corpus
enters a bucket once a block; copies of a phrase leave a block once.  Phrases
are compared byte by byte; a false match of trigger hashes costs time only.

Defined results: null or empty text has no bytes; ids must be integers, a
null id counts as larger than all others; rows that repeat an id do not remove
each other's text; strings never cross documents; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, NO_ID, block_texts, make_blocks, squeeze, stretch
from .common import group_equal, mix64, span_hashes, u64_view, written

LENGTH = 50
TRIGGER = 24  # bytes of the rolling hash
BUCKET_BYTES = 32 << 20  # text for each bucket, about 1 / 14 of it triggers
PIECE = 1 << 17  # positions hashed at once, to stay in cache
SORT_BYTES = 1 << 20  # dictionary text that is suffix-sorted at once, if no single trigger has more

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def rolling_hash(a: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of the ``width`` bytes at each position, by
    joining hashes of 1, 2, 4 ... bytes."""
    n = len(a) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, base = a.astype(np.uint64) + np.uint64(1), 1, BASE
    out, done, rest = None, 0, width
    with np.errstate(over="ignore"):
        while True:
            if rest & size:
                piece = part[done:done + n]
                out = piece.copy() if out is None else out * base + piece
                done += size
                rest -= size
            if not rest:
                return out
            part = part[:-size] * base + part[size:]
            base, size = base * base, size * 2


def parse(data: bytes, size: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """Phrases of concatenated documents: (first string start, last string
    start, trigger position, trigger hash), in text order."""
    a = np.frombuffer(data, np.uint8)
    n, reach = len(a) - length + 1, length - trigger + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    where = np.empty(n, np.int64)
    for s in range(0, n, PIECE):
        e = min(s + PIECE, n)
        h = mix64(rolling_hash(a[s:e + length - 1], trigger))
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < reach:
            key = np.minimum(key[:e - s], key[reach - span:][:e - s])
        where[s:e] = (key & np.uint64(0xFFFFFF)).astype(np.int64) + s
    ok = np.zeros(n, bool)
    begin = np.cumsum(size) - size
    room = size >= length
    edge = np.zeros(n + 1, np.int8)
    edge[begin[room]] += 1
    np.add.at(edge, (begin + size - length + 1)[room], -1)
    ok = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    start = np.flatnonzero(ok)
    at = where[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    pos = at[first]
    view = u64_view(data)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), trigger, np.uint64)
        for k in range(0, trigger, 8):
            v = view[pos + k]
            if trigger - k < 8:
                v = v & np.uint64((1 << 8 * (trigger - k)) - 1)
            h = mix64(h * np.uint64(5) ^ v)
    return start[first], start[last], pos, h


def same_spans(data: bytes, start: np.ndarray, size: np.ndarray):
    """(one member of each set of equal byte spans, set of every span)."""
    seed = 0
    while True:
        key = span_hashes(data, start, size)
        if seed:
            key = mix64(key + np.uint64(seed)) ^ span_hashes(data, start + size // 2, size - size // 2)
        _, one, group = group_equal(key)
        if _equal(data, start, start[one[group]], size, size[one[group]]):
            return one, group
        seed += 1  # two different spans had one hash


def _equal(data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray) -> bool:
    if not (size == other).all():
        return False
    view, k = u64_view(data), 0
    while len(a):
        x = view[a + k] ^ view[b + k]
        rest = size - k
        short = rest < 8
        x[short] &= (np.uint64(1) << (np.maximum(rest[short], 0).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        if x.any():
            return False
        k += 8
        more = size > k
        a, b, size = a[more], b[more], size[more]
    return True


def string_ranks(data: bytes, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes at each position among all of them, by prefix
    doubling: the suffix array of ``data`` to that depth.  Length is 8 or more."""
    words = u64_view(data)[: len(data)].byteswap()  # first byte highest: numbers sort as strings
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    size = 8
    while size < length:
        step = min(size, length - size)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1]
        size += step
    return rank


class Block:
    """A block's documents, its phrases and their place in the buckets."""

    def __init__(self, row: dict, buckets: int, length: int, trigger: int):
        self.id, self.buckets, self.length = row["block"], buckets, length
        self.ids, self.size, self.data = block_texts(row)
        self.begin = np.cumsum(self.size) - self.size
        self.lo, self.hi, _, self.hash = parse(self.data, self.size, length, trigger)
        # distinct triggers in the order of bucket and 32-bit key
        self.key = ((self.hash & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32)) | (self.hash >> np.uint64(32))
        self.keys, self.of, n = np.unique(self.key, return_inverse=True, return_counts=True)
        self.again = n > 1
        self.cut = np.searchsorted(self.keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(self.size)  # empty documents hold no position
        return full[np.searchsorted(self.begin[full], pos, side="right") - 1]

    def repeated(self, masks: dict[int, bytes]) -> None:
        """Keep phrases of repeated triggers: ``one`` of each, ``group`` of all."""
        hot = np.zeros(len(self.keys), bool)
        for b, mask in masks.items():
            a, e = self.cut[b], self.cut[b + 1]
            hot[a:e] = np.unpackbits(np.frombuffer(mask, np.uint8), count=e - a).astype(bool)
        at = np.flatnonzero(hot[self.of]) if len(self.of) else self.of
        self.lo, self.hi, key = self.lo[at], self.hi[at], self.key[at]
        self.doc = self.doc_of(self.lo) if len(at) else at
        one, self.group = same_spans(u64_view(self.data), self.lo, self.hi - self.lo + self.length)
        self.first = np.full(len(one), NO_ID)
        np.minimum.at(self.first, self.group, self.ids[self.doc])
        order = np.argsort(key[one], kind="stable")  # phrases in the order of bucket and trigger
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        self.one, self.group, self.first, self.phrase_key = one[order], place[self.group], self.first[order], key[one][order]
        self.phrase_cut = np.searchsorted(self.phrase_key >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))


def rises(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted 32-bit keys, the first key before them."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.diff(low, prepend=0).astype("<u4")


def from_rises(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(raw.astype(np.uint64))


def send_triggers(blocks: DataFrame, buckets: int, length: int, trigger: int) -> DataFrame:
    """(bucket, block, n, again, keys): the distinct triggers of each block."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, buckets, length, trigger)
                cols: list[list] = [[], [], [], [], []]
                for k in range(buckets):
                    s = slice(b.cut[k], b.cut[k + 1])
                    if b.cut[k + 1] > b.cut[k]:
                        for c, x in zip(cols, (k, b.id, int(b.cut[k + 1] - b.cut[k]), np.packbits(b.again[s]).tobytes(),
                                               *squeeze(rises(b.keys[s])))):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.binary()) for c in cols[3:]]],
                        ["bucket", "block", "n", "again", "keys"])

    return blocks.mapInArrow(run, "bucket long, block long, n long, again binary, keys binary")


def trigger_masks(sent: DataFrame) -> DataFrame:
    """(block, bucket, mask): which of a block's trigger hashes occur again."""
    def run(t: pa.Table) -> pa.Table:
        n = t["n"].to_pylist()
        keys = np.concatenate([from_rises(stretch(k, "<u4", m)) for k, m in zip(t["keys"].to_pylist(), n)])
        again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=m) for a, m in zip(t["again"].to_pylist(), n)])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        twin = np.zeros(len(s) + 1, bool)
        twin[1:-1] = s[1:] == s[:-1]
        mask = again.astype(bool)
        mask[order] |= twin[1:] | twin[:-1]
        parts = [np.packbits(m).tobytes() for m in np.split(mask, np.cumsum(n)[:-1])]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "mask": pa.array(parts, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, mask binary")


def send_phrases(blocks: DataFrame, masks: DataFrame, buckets: int, length: int, trigger: int) -> DataFrame:
    """(bucket, block, n, bytes, sizes, triggers, firsts, text) of each block's
    distinct phrases with repeated triggers."""
    names = ["bucket", "block", "n", "bytes", "sizes", "triggers", "firsts", "text"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            b = Block(left.to_pylist()[0], buckets, length, trigger)
            b.repeated(dict(zip(right["bucket"].to_pylist(), right["mask"].to_pylist())))
            a = np.frombuffer(b.data, np.uint8)
            for k in range(buckets):
                s, e = b.phrase_cut[k], b.phrase_cut[k + 1]
                if e > s:
                    at = b.one[s:e]
                    size = b.hi[at] - b.lo[at] + length
                    text = a[np.repeat(b.lo[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    packed = squeeze((size - length).astype(np.uint8), rises(b.phrase_key[s:e]), b.first[s:e], text)
                    for c, x in zip(names, (k, b.id, int(e - s), len(text), *packed)):
                        cols[c].append(x)
        return pa.table({c: pa.array(v, pa.int64() if i < 4 else pa.binary()) for i, (c, v) in enumerate(cols.items())})

    return (blocks.groupBy("block").cogroup(masks.select(F.col("block").alias("of"), "bucket", "mask").groupBy("of"))
            .applyInArrow(run, "bucket long, block long, n long, bytes long, sizes binary, triggers binary, firsts binary, text binary"))


def dictionary_owners(trigger: np.ndarray, first: np.ndarray, text: bytes, size: np.ndarray, length: int):
    """Owners of the strings of phrases, an owner being the smallest document
    that holds a string: (runs, set of every phrase, run lengths, run owners), runs
    by distinct phrase."""
    view = u64_view(text)
    begin = np.cumsum(size) - size
    one, group = same_spans(view, begin, size)
    own = np.full(len(one), NO_ID)
    np.minimum.at(own, group, first)
    runs, lens, owners = np.ones(len(one), np.int64), size[one] - length + 1, own
    # the dictionary's suffixes matter where a trigger has several phrases
    _, which, n = np.unique(trigger[one], return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[which] > 1)
    found = []  # (phrases, their numbers of runs, lengths and owners of the runs)
    several = several[np.argsort(which[several], kind="stable")]
    total, edge = np.cumsum(size[one[several]]), np.flatnonzero(np.diff(which[several], prepend=-1))
    while len(several):
        # whole triggers, as many as sort together in bounded memory
        done = total[0] - size[one[several[0]]]
        upto = edge[np.searchsorted(total[edge[1:] - 1] - done, SORT_BYTES)] if len(edge) > 1 else len(several)
        upto = int(upto) if upto else int(edge[1])
        part, several, total = several[:upto], several[upto:], total[upto:]
        edge = edge[edge >= upto] - upto
        at, ln, k = begin[one[part]], size[one[part]], lens[part]
        shift = np.cumsum(ln) - ln
        a = np.frombuffer(text, np.uint8)
        dictionary = a[np.repeat(at - shift, ln) + np.arange(ln.sum())].tobytes()
        phrase = np.repeat(np.arange(len(part)), k)
        rank = string_ranks(dictionary, length)[np.repeat(shift - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        best = np.full(int(rank.max()) + 1, NO_ID)
        np.minimum.at(best, rank, np.repeat(own[part], k))
        flat = best[rank]
        new = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (phrase[1:] != phrase[:-1])]))
        found.append((part, np.bincount(phrase[new], minlength=len(part)), np.diff(new, append=len(flat)), flat[new]))
    for part, n, _, _ in found:
        runs[part] = n
    ends = np.cumsum(runs)
    lens, owners = np.repeat(lens, runs), np.repeat(own, runs)
    for part, n, run_lens, run_owners in found:
        into = np.repeat((ends - runs)[part] - (np.cumsum(n) - n), n) + np.arange(len(run_lens))
        lens[into], owners[into] = run_lens, run_owners
    return runs, group, lens, owners


def phrase_owners(sent: DataFrame, length: int) -> DataFrame:
    """(block, bucket, owners): for each phrase that a block sent, runs of
    strings with one owner; no run where the block's own first document owns all."""
    def run(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()

        def column(name, kind, sizes=n):
            return [stretch(x.as_py(), kind, int(m)) for x, m in zip(t[name], sizes)]

        size = np.concatenate(column("sizes", np.uint8)).astype(np.int64) + length
        trigger = np.concatenate([from_rises(x) for x in column("triggers", "<u4")])
        first = np.concatenate(column("firsts", np.int64))
        text = b"".join(x.tobytes() for x in column("text", np.uint8, t["bytes"].to_numpy()))
        runs, group, lens, owners = dictionary_owners(trigger, first, text, size, length)
        begin = np.cumsum(runs) - runs
        k = runs[group]
        k[(k == 1) & (owners[begin[group]] == first)] = 0
        at = np.repeat(begin[group] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        lens, owners = lens[at], owners[at]
        cut = np.concatenate([[0], np.cumsum(n)])
        rcut = np.concatenate([[0], np.cumsum(k)])[cut]
        out = []
        for i in range(len(n)):
            s, e = slice(cut[i], cut[i + 1]), slice(rcut[i], rcut[i + 1])
            raw = k[s].astype(np.uint8).tobytes() + lens[e].astype(np.uint8).tobytes() + owners[e].astype("<i8").tobytes()
            out.append(pa.compress(raw, codec="zstd", asbytes=True))
        return pa.table({"block": t["block"], "bucket": t["bucket"], "n": t["n"], "size": pa.array(n + 9 * np.diff(rcut)),
                         "owners": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, n long, size long, owners binary")


def keep_rest(b: Block, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(covered byte mask, phrases' answers applied) of a block."""
    runs = np.zeros(len(b.one), np.int64)
    lens, owns, order = [], [], []
    for r in answers:
        raw = pa.decompress(r["owners"], r["size"], codec="zstd", asbytes=True)
        n, k = r["n"], (r["size"] - r["n"]) // 9
        runs[b.phrase_cut[r["bucket"]]:b.phrase_cut[r["bucket"] + 1]] = np.frombuffer(raw, np.uint8, n)
        order.append(r["bucket"])
        lens.append(np.frombuffer(raw, np.uint8, k, n).astype(np.int64))
        owns.append(np.frombuffer(raw, "<i8", k, n + k))
    by = np.argsort(order)
    lens = np.concatenate([lens[i] for i in by]) if answers else np.empty(0, np.int64)
    owns = np.concatenate([owns[i] for i in by]) if answers else np.empty(0, np.int64)
    at = np.cumsum(runs) - runs
    within = np.cumsum(lens) - lens  # start of a run within its phrase
    has = np.flatnonzero(runs)
    within -= np.repeat(within[at[has]], runs[has]) if len(has) else 0
    # phrases in text order; one owner (the block's first document) or runs
    k = np.maximum(runs, 1)[b.group]
    each = np.repeat(np.arange(len(b.group)), k)
    inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    g = b.group[each]
    plain = runs[g] == 0
    j = np.minimum(at[g] + inner, max(len(lens) - 1, 0))
    own = np.where(plain, b.first[g], owns[j] if len(owns) else 0)
    frm = b.lo[each] + np.where(plain, 0, within[j] if len(lens) else 0)
    num = np.where(plain, (b.hi - b.lo + 1)[each], lens[j] if len(lens) else 0)
    drop = own < b.ids[b.doc[each]]
    edge = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(edge, frm[drop], 1)
    np.add.at(edge, frm[drop] + num[drop] - 1 + b.length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (runs of
    removed bytes), kept (the remaining bytes)."""
    if not 16 <= length <= 250:
        raise ValueError("length is 16 to 250")
    trigger = min(TRIGGER, length // 2)
    blocks = make_blocks(docs, id_col, text_col, block_bytes=block_bytes)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    masks = written(trigger_masks(send_triggers(blocks, buckets, length, trigger)), "suffix-masks")
    owners = phrase_owners(send_phrases(blocks, masks, buckets, length, trigger), length)
    none = {"long": F.lit(None).cast("long"), "binary": F.lit(None).cast("binary")}
    back = masks.select(F.col("block").alias("of"), "bucket", "mask", none["long"].alias("n"), none["long"].alias("size"),
                        none["binary"].alias("owners")).unionByName(
        owners.select(F.col("block").alias("of"), "bucket", none["binary"].alias("mask"), "n", "size", "owners"))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.binary() if c == "kept" else pa.int64()) for c in names})
        b = Block(left.to_pylist()[0], buckets, length, trigger)
        rows = right.to_pylist()
        b.repeated({r["bucket"]: r["mask"] for r in rows if r["mask"] is not None})
        gone = keep_rest(b, [r for r in rows if r["owners"] is not None])
        a = np.frombuffer(b.data, np.uint8)
        ends = np.concatenate([[0], np.cumsum(gone)])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = b.begin[b.size > 0]
        head[inner] = gone[inner]  # a run ends with its document
        heads = np.concatenate([[0], np.cumsum(head)])
        e = b.begin + b.size
        removed, spans = ends[e] - ends[b.begin], heads[e] - heads[b.begin]
        left_over = np.concatenate([[0], np.cumsum(b.size - removed)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(b.ids), [None, pa.py_buffer(left_over), pa.py_buffer(a[~gone])])
        return pa.table({"id": pa.array(b.ids, mask=b.ids == NO_ID), "n_bytes": pa.array(b.size),
                         "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": kept})

    return blocks.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
