"""Operator 7, SimHash near-dedup by a segment-popcount embedding.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes
of its word shingles.  Fingerprints within ``max_bits`` bits are linked:

* **Embedding**: a fingerprint becomes the vector of set-bit counts of its 16
  four-bit segments.  Flipping one bit moves one coordinate by one, so the
  Manhattan distance of two vectors never exceeds the Hamming distance.
* **Grid range-join**: vectors at Manhattan distance <= 2r have a common grid
  cell within r of both.  Every *distinct* fingerprint enters the cells within
  r = ``max_bits`` / 2 of its own (33 for r = 1); candidates share a cell.
* **Exact check**: a cell of up to ``CELL`` fingerprints compares its members
  by ``bit_count(a ^ b)``.  A fuller cell never forms pairs: its members enter
  all 64-bit words within r bits, and any two in the ball of one word are
  within 2r bits, so each word links its members to their smallest, a star
  with the same components.  Every link of a full cell has such a word.
* **Components**: star contractions over the links, labels joined back.

Work grows with the number of distinct fingerprints (33 small rows each, plus
65 for those in full cells); copies collapse by a partial aggregate first.

Defined results: null or wordless text has fingerprint zero and links like
any other; fewer words than a shingle make one shingle; repeated rows share a
component; a null id is never the smallest; an empty table gives an empty
table; other columns are ignored by ``components_of`` and kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import doc_words, rows_for, text_bytes, u64_view, written
from .components import components

SEGMENT = 4  # bits of a segment
CELL = 24  # fingerprints that a cell compares directly
SEED = 42

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (  # fixed values of XXH64
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, v):
    return _rotl(acc + v * P2, 31) * P1


def xxh64(data: bytes, starts: np.ndarray, lens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans at once; spans of 32 bytes and more run their
    stripes together, longest first."""
    view, seed = u64_view(data + b"\0" * 8), np.uint64(seed)
    starts, lens = starts.astype(np.int64), lens.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + P5, np.uint64)
        big = np.flatnonzero(lens >= 32)
        if len(big):
            big = big[np.argsort(-lens[big], kind="stable")]
            stripes, at = lens[big] // 32, starts[big]
            v = [np.full(len(big), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            n = len(big)
            for k in range(int(stripes[0])):
                while n and stripes[n - 1] <= k:
                    n -= 1
                for j in range(4):
                    v[j][:n] = _round(v[j][:n], view[at[:n] + 32 * k + 8 * j])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.uint64(0), x)) * P1 + P4
            h[big] = acc
        h += lens.astype(np.uint64)
        pos, rest = starts + (lens & ~31), lens & 31
        for _ in range(3):
            at = np.flatnonzero(rest >= 8)
            if not len(at):
                break
            h[at] = _rotl(h[at] ^ _round(np.uint64(0), view[pos[at]]), 27) * P1 + P4
            pos[at] += 8
            rest[at] -= 8
        at = np.flatnonzero(rest >= 4)
        h[at] = _rotl(h[at] ^ ((view[pos[at]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        pos[at] += 4
        rest[at] -= 4
        for _ in range(3):
            at = np.flatnonzero(rest > 0)
            if not len(at):
                break
            h[at] = _rotl(h[at] ^ ((view[pos[at]] & np.uint64(0xFF)) * P5), 11) * P1
            pos[at] += 1
            rest[at] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def majority_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitwise majority of the hashes of each group [first[i], first[i + 1]).

    Eight bit counters share a 64-bit word, a byte each, for up to 255 hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(first[full], parts) + 255 * at
    group = np.cumsum(parts) - parts
    for k in range(8):
        lanes = (h >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(sums, group, axis=0)
        bits = (2 * sums > n[full][:, None]).astype(np.uint64)
        for j in range(8):
            out[full] |= bits[:, j] << np.uint64(8 * j + k)
    return out


def fingerprint_texts(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    flat, starts, ends, first = doc_words(texts)
    n = np.diff(first)
    grams = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(grams)])
    word = np.arange(begin[-1]) - np.repeat(begin[:-1], grams) + np.repeat(first[:-1], grams)
    last = word + np.repeat(np.minimum(n, shingle), grams) - 1
    return majority_bits(xxh64(flat, starts[word], ends[last] - starts[word]), begin)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    src = text_bytes(docs, id_col, text_col)

    def run(batches):
        for ids, texts in rows_for(batches):
            fp = fingerprint_texts(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], ["id", "fp"])

    return src.mapInArrow(run, StructType([src.schema["id"], StructField("fp", LongType())]))


def _near(key, steps):
    """The word or cell itself and its direct neighbours."""
    return F.array(key, *[s(key) for s in steps])


def _balls(df: DataFrame, key, steps, radius: int) -> DataFrame:
    """(fp, key) for all keys within ``radius`` steps of ``key``."""
    out = df.select("fp", key.alias("key"))
    for _ in range(radius):
        out = out.select("fp", F.explode(_near(F.col("key"), steps)).alias("key"))
    return out.distinct() if radius > 1 else out


def links(distinct_fp: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) with the components of "at most ``max_bits`` bits differ"."""
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits is 0, 2 or 4")
    radius, segments = max_bits // 2, 64 // SEGMENT
    counts = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT * i).bitwiseAND(2 ** SEGMENT - 1)) for i in range(segments)]
    # three bits a coordinate, raised by one so that a step below zero stays in its place
    cell = sum(((c.cast("long") + 1) * (8 ** i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    cell_steps = [lambda k, s=s * 8 ** i: k + F.lit(s).cast("long") for i in range(segments) for s in (1, -1)]
    cells = _balls(distinct_fp, cell, cell_steps, radius)
    sizes = written(cells.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
                    .where("n > 1"), "simhash-cells")
    several = written(cells.join(sizes.where("n > 2").select("key", "n"), "key"), "simhash-members")
    few = several.where(F.col("n") <= CELL).groupBy("key").agg(F.collect_list("fp").alias("a"))
    pairs = (few.select("a", F.explode("a").alias("u")).select("u", F.explode("a").alias("v")).where("u < v")
             .unionByName(sizes.where("n = 2").select("u", "v"))
             .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    flips = [lambda k, b=(1 << i) - ((1 << 64) if i == 63 else 0): k.bitwiseXOR(F.lit(b).cast("long")) for i in range(64)]
    full = several.where(F.col("n") > CELL).select("fp").distinct()
    balls = _balls(full, F.col("fp"), flips, radius)
    low = written(balls.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v"),
                  "simhash-balls")
    stars = balls.join(low, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 2, fps: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fp, component (a label), component_id
    (smallest id of the component)."""
    fps = fps if fps is not None else written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    groups = written(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-groups")
    comp = components(links(groups.select("fp"), max_bits), "simhash-components")
    label = F.coalesce("label", "fp")
    named = groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", label.alias("component"))
    named = written(named, "simhash-labels")
    best = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-best")
    named = written(named.join(best, "component").select("fp", "component", "component_id"), "simhash-named")
    return fps.join(named, "fp")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The document with the smallest id of every component, columns unchanged."""
    tagged = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "simhash-rows")
    flat = tagged.select(F.struct("row", F.col("doc")[id_col].alias("id")).alias("key"), F.col("doc")[text_col].alias("text"))
    fps = written(fingerprints(flat, "key", "text", shingle)
                  .select(F.struct(F.col("id.id").isNull().alias("no_id"), "id.id", "id.row").alias("id"), "fp"), "simhash-fp")
    keep = components_of(docs, fps=fps, max_bits=max_bits).where("id = component_id").select(F.col("id.row").alias("row"))
    return tagged.join(keep, "row", "left_semi").select("doc.*")
