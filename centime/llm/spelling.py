"""Operator 13, spelling variant grouping by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  Common prefix plus common suffix then reach the longer length
minus one, which padded code-point matrices show for whole blocks of words at
once, one column a step.  Which blocks meet:

* near words have lengths L and L or L + 1.  Of a near pair either the first
  L // 2 code points agree or the last L - L // 2 do, so every word goes to the
  group of its prefix and of its suffix in the band of its own length and in
  that of the next shorter one, and every near pair meets; a pair that meets
  twice is reported where the prefix agrees;
* a group of more than ``BLOCK`` words is split into blocks by hash, and its
  block pairs are tiles of their own, in tasks of their own: the work of a hot
  prefix spreads, no task holds more than two blocks;
* only near pairs leave a tile.

``forms`` names each word's form: of its near words the most frequent one
(ties: the smallest in code-point order), if it occurs ``ratio`` times as often
as the word itself.  Counts grow along a chain of forms, so chains end, after
log(largest count) / log(ratio) steps at most; roots are found by pointer
doubling over written tables.

Defined results: null text has no words, a null id counts as the empty string
where a caller puts ids into a hash; words shorter than ``least`` or rarer than
``least_n`` don't exist; repeated rows count again; an empty table gives an
empty table; other columns are ignored.  A word of any length takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024  # words of a block
BLOCK_POINTS = 1 << 20  # code points of a block
CELLS = 1 << 20  # word pairs compared at once
TASK_CELLS = 1 << 28  # word pairs of a task, about
LETTERS = r"[A-Za-zÀ-ÿ]"

_GROUP = ["band", "by_suffix", "half", "i", "j"]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """(id, run): every maximal run of letters with ``least`` of them or more, A-Z lower-cased."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))


def vocabulary(words: Column, df: DataFrame, least: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n), written: the distinct values of ``words`` that are long and frequent enough."""
    w = df.select(words.alias("word")).where(F.length("word") >= least)
    return written(w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n), "spelling-words")


def _groups(vocab: DataFrame) -> DataFrame:
    """Each word once for every group it belongs to."""
    n = F.length("word")
    w = vocab.select("word", "n", F.explode(F.array(n, n - 1)).alias("band")).where("band > 0")
    half = (F.col("band") / 2).cast("int")
    w = w.select("word", "n", "band", F.explode(F.array(F.lit(False), F.lit(True))).alias("by_suffix"))
    key = F.when(F.col("by_suffix"), F.expr("right(word, band - cast(band / 2 as int))")).otherwise(F.expr("left(word, cast(band / 2 as int))"))
    return w.withColumn("half", F.when(F.col("by_suffix") | (half > 0), key).otherwise(F.lit("")))


def _tiles(vocab: DataFrame) -> tuple[DataFrame, int]:
    """(rows of tiles, tasks to deal them to)."""
    words = written(_groups(vocab), "spelling-groups")
    key = ["band", "by_suffix", "half"]
    size = words.groupBy(key).agg(F.count("*").alias("m"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("m") * (F.col("band") + 1) / BLOCK_POINTS)).cast("int")
    size = written(size.where("m > 1").withColumn("parts", parts), "spelling-sizes")
    cells = size.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0.0
    big = size.where("parts > 1").select(*key, "parts")
    w = words.join(big, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    w = w.withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    w = w.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = w.select("word", "n", *key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    spark = vocab.sparkSession
    return tiles, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(cells / TASK_CELLS))


class _Side:
    """Words of one length as matrices of code points, read forward and backward."""

    def __init__(self, words: list[str], at: np.ndarray):
        self.at = at
        if words:
            flat = np.array(words), np.array([w[::-1] for w in words])
            self.grids = [x.view(np.uint32).reshape(len(words), -1) for x in flat]
            if self.grids[0].max() < 256:
                self.grids = [g.astype(np.uint8) for g in self.grids]


def _agree(x: np.ndarray, y: np.ndarray, skip: int, upto: int) -> np.ndarray:
    """Length of the common prefix of every row of x with every row of y, of
    which the first ``skip`` columns are known to agree."""
    total = np.full((len(x), len(y)), skip, np.int16 if upto < 30000 else np.int32)
    same = np.ones(total.shape, bool)
    for c in range(skip, upto):
        same &= x[:, c, None] == y[None, :, c]
        if c % 8 == 7 and not same.any():
            break
        total += same
    return total


def single_edits(x: _Side, y: _Side, band: int, by_suffix: bool, longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of x and of y that are one edit apart."""
    if not len(x.at) or not len(y.at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    half, step, found = band // 2, max(1, CELLS // len(y.at)), []
    for a in range(0, len(x.at), step):
        rows = slice(a, a + step)
        prefix = _agree(x.grids[0][rows], y.grids[0], 0 if by_suffix else half, band)
        suffix = _agree(x.grids[1][rows], y.grids[1], band - half if by_suffix else 0, band)
        near = prefix + suffix >= longer - 1
        if by_suffix:
            near &= prefix < half
        i, j = np.nonzero(near)
        found.append((x.at[i + a], y.at[j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def tile_pairs(words: list[str], block: np.ndarray, band: int, by_suffix: bool, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a tile: of its two blocks with each other, or of its only block."""
    size = np.fromiter(map(len, words), np.int64, len(words))

    def side(k: int, n: int) -> _Side:
        at = np.flatnonzero((block == k) & (size == n))
        return _Side([words[p] for p in at.tolist()], at)

    short, long = side(i, band), side(i, band + 1)
    if i == j:
        a, b = single_edits(short, short, band, by_suffix, band)
        out = [(a[a < b], b[a < b]), single_edits(short, long, band, by_suffix, band + 1)]
    else:
        short_j, long_j = side(j, band), side(j, band + 1)
        out = [single_edits(short, short_j, band, by_suffix, band), single_edits(short, long_j, band, by_suffix, band + 1),
               single_edits(short_j, long, band, by_suffix, band + 1)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _compare(batches):
    """Tiles arrive sorted; a tile may span batches, so its rows wait for its end."""
    names = ["a", "a_n", "b", "b_n"]

    def near(t: pa.Table):
        first = {c: t.column(c)[0].as_py() for c in _GROUP}
        word = t.column("word").combine_chunks()
        a, b = tile_pairs(word.to_pylist(), t.column("block").to_numpy(), first["band"], first["by_suffix"], first["i"], first["j"])
        n = t.column("n").combine_chunks()
        return [word.take(pa.array(a)), n.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))]

    def flush(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[c] for o in out]) for c in range(4)], names)

    rest = None
    out, held = [], 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        new = np.zeros(t.num_rows, bool)
        for c in _GROUP:
            col = t.column(c).combine_chunks()
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new)])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > 1:
                out.append(near(t.slice(a, b - a)))
                held += len(out[-1][0])
                if held > 50_000:
                    yield from flush(out)
                    out, held = [], 0
        rest = t.slice(int(starts[-1]))
    if rest is not None and rest.num_rows > 1:
        out.append(near(rest))
    yield from flush(out)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n), once."""
    tiles, tasks = _tiles(vocab)
    dealt = tiles.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(_compare, "a string, a_n long, b string, b_n long")


def forms(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n)."""
    pairs = written(near_pairs(vocab), "spelling-pairs")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("top"))
    taken = -F.col("top.k") >= ratio * F.col("n")
    of = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("top.near")).alias("form"),
        F.when(taken, -F.col("top.k")).alias("form_n"))
    of = written(of, "spelling-forms")
    at = of.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        nxt = at.join(up, "root", "left")
        nxt = written(nxt.select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        at = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            break
    return of.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))
