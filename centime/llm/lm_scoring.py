"""Operator 10, language-model scores by a probabilistic suffix tree over words.

The model's symbols are tokens: lowered words, then one end.  A context is the
run of tokens before a token, back to the text's begin mark at most.

* **Root.** The unigram model: a token's training count over the corpus, plus 0.1.
* **Tree.** Contexts grow a token a level.  At a level each block sends its distinct
  (context, next token) pairs with their training counts and the probability that
  is in force for them; buckets of contexts sum the corpus's counts.  A context
  stays when it occurs ``LEAST`` times and its smoothed next-token distribution
  diverges from the one in force by ``GAIN`` bits over all its occurrences.  It is
  smoothed by the distribution in force, weighted by the number of its different
  next tokens.  The longest context that stays gives a token's probability.
* **Growth** ends by itself.  A longer context occurs at places of the shorter one,
  so its divergence is at most the bits that those places cost now, and at most what
  the best choice of them could gain (``worth``); a context that occurs less than
  ``LEAST`` times or could gain less than ``GAIN`` bits is not extended, as none of
  its extensions could stay.  A string that occurs less than ``LEAST`` times is in no
  context that stays: a place asks only for contexts that begin after it.
* **Several levels a round.** From ``TAIL`` tokens on few places still ask, mostly in
  near copies, which can agree for thousands of tokens.  They send the pairs of
  several levels at once, as a trie that goes to the bucket of its shortest context, so depth
  doubles a round.  A longer context is named by the pair above it and the word before, 32 bits of
  its hash, and only the pairs that are some place's longest are answered.  From ``CARVE`` tokens on only the places that ask and the tokens
  before them that a context may hold travel, as numbers of the block's words.
  How many levels a round takes is bounded by the pairs that a block makes and
  has no influence on the result.

A text is split into words once; blocks hold its words as numbers of their 64-bit hashes.
The unigram counts come from the same exchange: each block sends its distinct words with its training counts to buckets, which answer with the corpus's counts, in the same order.  A word, or a context, that holds a third of all
tokens is one entry a block.

Defined results: null or empty text has the end only; ids must be integers;
without training documents every token is the unknown one and both scores are 0;
contexts are named by 64-bit hashes; log10 probabilities that travel are rounded to 16 bits of
fraction; repeated rows each get their result; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import BLOCK_BYTES, NO_ID, squeeze, stretch
from .common import doc_words, group_equal, mix64, rows_for, span_hashes

LEAST = 16  # training occurrences that a context needs
GAIN = 32.0  # bits by which its distribution must shorten the training text
TAIL = 4  # context length from which a round takes several levels
CARVE = 3  # context length from which only what still asks travels
PAIRS = 4 << 20  # pairs that a block may make in such a round
BUCKET_BYTES = 256 << 20
LEVEL_BYTES = 16 << 20  # text for each bucket of a level
LEVEL_PAIRS = 2 << 20  # pairs for each bucket of a later level
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # hashes of the two marks
BASE = 0x9E3779B97F4A7C17  # of the polynomial that names contexts; 3 modulo 4
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)

ROWS = "bucket long, block long, asked long, kept long, held double, parts array<binary>"


TOKENS = ("block long, docs long, words long, kinds long, bytes long, n_learn long, ids binary, learn binary, "
          "sizes binary, keys list, counts binary, codes list").replace("list", "array<binary>")


def token_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """The corpus in blocks: words of each document as numbers (``codes``) of the block's
    distinct words (``keys``: hashes, frequent words first), with their training counts."""
    src = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn")).alias("key"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(rows_for(batches, BLOCK_BYTES)):
            ids, marks = keys.flatten()
            may = marks.to_numpy(zero_copy_only=False).astype(bool)
            flat, starts, ends, first = doc_words(texts)
            key, _, of = group_equal(span_hashes(flat, starts, ends - starts))
            order = np.argsort(-np.frexp(np.bincount(of, minlength=len(key)))[1], kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            sizes, of = np.diff(first), place[of]
            count = np.bincount(of[np.repeat(may, sizes)], minlength=len(key))
            packed = squeeze(ids.fill_null(NO_ID).to_numpy(), may, sizes, count.astype(np.uint32))
            row = (part | number, len(texts), len(of), len(key), sum(map(len, texts)), int(may.sum()), *packed[:3],
                   pack(steps(key[order])), packed[3], pack(of.astype(np.uint32)))
            names = [c.split()[0] for c in TOKENS.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.binary()] * 3 + [pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return src.mapInArrow(run, TOKENS)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, modulo the type's range: small where ``x`` ascends; ``np.cumsum`` undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


def block_keys(row: dict) -> np.ndarray:
    """Hashes of a block's words; they ascend among words about as frequent."""
    return np.cumsum(unpack(row["keys"], np.uint64)[0], dtype=np.uint64)


def block_tokens(row: dict):
    """(ids, learn, words of each document, number of each word, hashes of the numbers)."""
    return (stretch(row["ids"], np.int64, row["docs"]), stretch(row["learn"], bool, row["docs"]), stretch(row["sizes"], np.int64, row["docs"]),
            unpack(row["codes"], np.uint32)[0], block_keys(row))


def token_stream(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each document of ``n`` words as begin mark, its word hashes, end; size of each)."""
    size = n + 2
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, np.uint64)
    out[at] = BEGIN
    out[np.arange(len(words)) + 1 + 2 * np.repeat(np.arange(len(n)), n)] = words
    return out, size


def pack(*arrays: np.ndarray) -> list[bytes]:
    """Arrays as one list of byte strings; numbers travel as planes of their bytes, which pack better."""
    out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += squeeze(a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a)
    return out


def unpack(parts: list[bytes], *kinds) -> list[np.ndarray]:
    out = []
    for raw, kind, n in zip(parts[1:], kinds, np.frombuffer(parts[0], np.int64).tolist()):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(stretch(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel())
    return out


def rounded(log: np.ndarray) -> np.ndarray:
    """log10 probabilities as they travel: 32-bit floats without their last byte."""
    bits = log.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)


class ContextNames:
    """Hash of the ``n`` tokens before any place of a stream, at constant cost."""

    def __init__(self, stream: np.ndarray):
        def powers(b):
            p = np.full(len(stream) + 1, b, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(stream * powers(BASE)[:-1], dtype=np.uint64)])
        self.back = powers(pow(BASE, -1, 1 << 64))

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix64((self.sums[at] - self.sums[at - n]) * self.back[at])


class Block:
    """A block's documents between two rounds.  ``sums`` holds the settled places of all its
    documents; ``stream`` tokens in pieces of the documents ``docs``, of which the places
    ``asking`` wait for contexts of ``depth`` tokens; ``start`` is where the longest string that
    ends at a place and may occur ``LEAST`` times begins, as far as known (it never goes back)."""

    OWN = (np.int64, np.bool_, np.int64, np.int64, np.float64, np.float64, np.uint8, np.uint8, np.uint32, np.int64, np.int64, np.uint64, np.uint32, np.uint32)

    def place(self, stream, size, docs):
        self.stream, self.size, self.docs = stream, size, docs
        self.begin = np.cumsum(size) - size
        self.of = np.repeat(np.arange(len(size)), size)

    @classmethod
    def first(cls, row: dict, count: np.ndarray, floor: float, n_learn: int) -> "Block":
        """Before the first round: unigram probabilities; places after frequent tokens ask.
        ``count``: the corpus's training counts of the block's words."""
        b = cls()
        b.number = row["block"]
        b.ids, b.learn, words, code, key = block_tokens(row)
        c = count[code]
        b.place(*token_stream(key[code], words), np.arange(len(b.ids)))
        log, seen = np.zeros(len(b.stream)), np.zeros(len(b.stream), np.int64)
        ends = b.begin + b.size - 1
        inner = np.ones(len(b.stream), bool)
        inner[b.begin] = inner[ends] = False
        seen[inner], seen[b.begin], seen[ends] = c, n_learn, n_learn
        log[inner], log[ends] = np.log10((c + 0.1) / floor), np.log10((n_learn + 0.1) / floor)
        b.tokens = b.size - 1
        n = len(b.ids)
        b.known = np.bincount(b.of[seen > 0], minlength=n) - (n_learn > 0)  # the begin mark is no token
        b.base = np.bincount(b.of, weights=log, minlength=n)
        b.start = b.begin[b.of]
        b.rare(np.flatnonzero(seen < LEAST), 0)
        b.ask_after_frequent()
        b.sums = np.bincount(b.of[~b.asking], weights=log[~b.asking], minlength=n)
        b.log = rounded(log[b.asking])
        return b

    def ask_after_frequent(self) -> None:
        """What asks in the first round, which no state needs to hold."""
        self.asking = np.zeros(len(self.stream), bool)
        self.asking[1:] = self.start[:-1] < np.arange(1, len(self.stream))
        self.asking[self.begin] = False

    def rare(self, at: np.ndarray, n) -> None:
        """The strings of ``n`` tokens and one at the places ``at`` occur less than ``LEAST`` times."""
        self.start[at] = np.maximum(self.start[at], at - n + 1)
        self.start = np.maximum.accumulate(self.start)

    @classmethod
    def again(cls, rows: list[dict], depth: int, levels: int, tokens: dict | None) -> "Block":
        """From a block's state and the answers of the round that ended before ``depth``."""
        b = cls()
        own = next(r for r in rows if r["bucket"] < 0)
        b.number = -1 - own["bucket"]
        b.ids, b.learn, b.tokens, b.known, b.base, b.sums, asking, moved, moves, docs, size, key, code, leaf = unpack(own["parts"], *cls.OWN)
        if tokens is not None:
            _, _, words, code, key = block_tokens(tokens)
            b.place(*token_stream(key[code], words), np.arange(len(b.ids)))
        else:
            b.place(np.cumsum(key, dtype=np.uint64)[code], size, docs)
        n = len(b.stream)
        b.start = np.zeros(n, np.int64)
        b.start[np.unpackbits(moved, count=n).astype(bool)] = moves
        b.start = np.cumsum(b.start)
        if depth - levels > 1:
            b.asking = np.unpackbits(asking, count=n).astype(bool)
        else:
            b.ask_after_frequent()
        rows = sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"])
        got = [unpack(r["parts"], np.float32, np.uint8, np.uint8) for r in rows]
        log, on, often = ([np.empty(0, np.float32)], [np.empty(0, bool)], [np.empty(0, bool)])
        for values, *bits in got:
            log.append(values)
            for to, x in zip((on, often), bits):
                to.append(np.unpackbits(x, count=len(values)).astype(bool))
        log, on, often = (np.concatenate(x) for x in (log, on, often))
        at = np.flatnonzero(b.asking)
        if depth - levels < TAIL:  # one level: the order of its pairs is that of their keys
            leaf = group_equal(b.pair_keys(ContextNames(b.stream), at, depth - 1)[0])[2]
        longest = np.minimum(at - b.start[at - 1], depth - 1)
        few = ~often[leaf]
        b.rare(at[few], longest[few])
        go = on[leaf] & (at - b.start[at - 1] >= depth)
        log = log[leaf]
        b.sums = b.sums + np.bincount(b.docs[b.of[at[~go]]], weights=log[~go], minlength=len(b.ids))
        b.asking = np.zeros(n, bool)
        b.asking[at[go]] = True
        b.log = log[go]
        return b

    def carve(self) -> None:
        """Keeps the places that ask and the tokens before them that a context may hold."""
        at, n = np.flatnonzero(self.asking), len(self.stream)
        cover = np.bincount(self.start[at - 1], minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        keep = np.flatnonzero(np.cumsum(cover)[:n] > 0)
        of = self.of[keep]
        new = np.ones(len(keep), bool)
        new[1:] = (np.diff(keep) > 1) | (of[1:] != of[:-1])
        piece = np.cumsum(new) - 1
        start = np.maximum(self.start[keep], keep[new][piece])
        self.start = np.arange(len(keep)) - (keep - start)
        self.asking = self.asking[keep]
        self.place(self.stream[keep], np.bincount(piece), self.docs[of[new]])

    def totals(self) -> np.ndarray:
        return self.sums + np.bincount(self.docs[self.of[self.asking]], weights=self.log, minlength=len(self.ids))

    def pair_keys(self, names: ContextNames, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(half of the context's hash and half of the pair's, the context's hash) of each place."""
        ctx = names(at, depth)
        return (ctx & ~LOW) | (mix64(ctx ^ (self.stream[at] * np.uint64(BASE))) >> HALF), ctx

    def ask(self, depth: int, levels: int, buckets: int) -> pa.Table:
        """Rows for the buckets: the pairs of ``levels`` levels from ``depth`` on, with the
        probability in force (first level) or the pair of the level before; and the block's state."""
        carved, tail = depth >= CARVE, depth >= TAIL
        if carved:
            self.carve()
        at = np.flatnonzero(self.asking)
        room = at - self.start[at - 1]
        levels = max(1, min(levels, int(room.max(initial=0)) - depth + 1))  # none longer is asked for
        learn = self.learn[self.docs][self.of[at]]
        sent, cuts = [], []
        leaf_level, leaf = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        bucket = group = low = None
        for j in range(levels):
            sel = np.flatnonzero(room >= depth + j)
            if j == 0:
                key, ctx = self.pair_keys(ContextNames(self.stream), at, depth)
                bucket = (((ctx >> HALF) * np.uint64(buckets)) >> HALF).astype(np.int64)
            else:  # ascends with the pair above, so with its bucket
                key = (group[sel].astype(np.uint64) << HALF) | (self.stream[at[sel] - depth - j] >> HALF)
            keys, one, of = group_equal(key)
            to = bucket[sel][one]
            count = np.bincount(of, weights=learn[sel], minlength=len(keys)).astype(np.uint32)
            if j == 0:
                sent.append(((keys >> HALF).astype(np.uint32), count, self.log[one].view(np.uint32)))
                low = (ctx[one] & LOW).astype(np.uint32), (keys & LOW).astype(np.uint32)
            else:
                sent.append(((keys & LOW).astype(np.uint32), count, (group[sel][one] - cuts[-1][to]).astype(np.uint32)))
            cuts.append(np.searchsorted(to, np.arange(buckets + 1)))
            group = np.zeros(len(at), np.int64)
            group[sel] = of
            leaf_level[sel], leaf[sel] = j, of
        sizes = np.array([np.diff(c) for c in cuts])
        total = sizes.sum(axis=0)
        where = (np.cumsum(total) - total)[None, :] + np.cumsum(sizes, axis=0) - sizes - np.array([c[:-1] for c in cuts])
        ends = [np.zeros(len(x[0]), bool) for x in sent]
        for j, end in enumerate(ends):
            end[leaf[leaf_level == j]] = True
        if tail and len(at):
            leaf = leaf + where[leaf_level, bucket]
        moves = steps(self.start)
        own = [self.ids, self.learn, self.tokens, self.known, self.base, self.sums, np.packbits(self.asking[:0] if depth == 1 else self.asking)]
        own += [np.packbits(moves > 0), moves[moves > 0].astype(np.uint32)]
        if carved:
            key, _, code = group_equal(self.stream)
            own += [self.docs, self.size, steps(key), code.astype(np.uint32)]
        else:
            own += [np.empty(0, k) for k in self.OWN[9:13]]
        own.append(leaf.astype(np.uint32) if tail else np.empty(0, np.uint32))
        out = [(-1 - self.number, self.number, len(at), 0, float(self.totals()[~self.learn].sum()), pack(*own))]
        for b in np.flatnonzero(total).tolist():
            cols = [[x[c[b]:c[b + 1]] for x in s] for s, c in zip(sent, cuts)]
            lo, pair = (x[cuts[0][b]:cuts[0][b + 1]] for x in low)
            cols[0][0], pair = steps(cols[0][0]), steps(pair)  # pairs ascend within a context
            lo = lo ^ np.concatenate([lo[:1] * 0, lo[:-1]])  # zero within a context
            for x in cols[1:]:
                x[2] = steps(x[2])
            name, count, up = (np.concatenate([x[k] for x in cols]) for k in range(3))
            end = np.packbits(np.concatenate([x[c[b]:c[b + 1]] for x, c in zip(ends, cuts)])) if levels > 1 else np.empty(0, np.uint8)
            out.append((b, self.number, 0, 0, 0.0, pack(sizes[:, b], name, lo, pair, count, up, end)))
        return table(out)


def table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.binary())]
    return pa.table({name.split()[0]: pa.array(c, k) for name, c, k in zip(ROWS.split(", "), zip(*rows), kinds)})


def judge(ctx: np.ndarray, count: np.ndarray, q: np.ndarray, alive: np.ndarray):
    """Of distinct pairs with contexts numbered ``ctx``, training counts and probabilities ``q`` in
    force: (log10 of their probabilities in force now, contexts that stay, contexts to extend)."""
    def total(x):
        return np.bincount(ctx, weights=x)

    n, kinds, alive = total(count), total(count > 0), total(alive) > 0
    p = (count + kinds[ctx] * q) / np.maximum(n + kinds, 1)[ctx]
    seen = count > 0
    gain = total(np.where(seen, count * np.log2(np.where(seen, p, 1) / np.where(seen, q, 1)), 0))
    stays = alive & (n >= LEAST) & (gain >= GAIN)
    log = rounded(np.log10(np.where(stays[ctx], p, q)))
    bits = total(-count * log.astype(np.float64)) / np.log10(2)
    return log, stays, alive & (n >= LEAST) & (bits >= GAIN)


def worth(ctx: np.ndarray, count: np.ndarray, log: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The contexts ``on`` without those of which no longer one could gain ``GAIN`` bits.

    A longer context holds m of the n occurrences of each next token, M in all, and gains at
    most sum(m log2(m / (M q))) bits.  With r = log2(n / q) that is, for any c, at most
    sum(m (r - c)) + c M - M log2(M), so at most sum(n max(0, r - c)) + 2^c / (e ln 2)."""
    if not on.any():
        return on
    here = np.flatnonzero(on[ctx] & (count > 0))
    at, n = ctx[here], count[here].astype(np.float64)
    r = np.log2(n) - log[here].astype(np.float64) / np.log10(2)

    def total(x):
        return np.bincount(at, weights=x, minlength=len(on))

    mean = total(n * r) / np.maximum(total(n), 1)
    top = np.full(len(on), -np.inf)
    np.maximum.at(top, at, r)
    bits = np.full(len(on), np.inf)
    for c in (mean - 1, mean, mean + 1, (mean + np.where(on, top, 0)) / 2, np.where(on, top, 0)):
        bits = np.minimum(bits, total(n * np.maximum(0, r - c[at])) + 2.0 ** c / (np.e * np.log(2)))
    return on & (bits + 1e-3 * np.bincount(at, minlength=len(on)) >= GAIN)  # probabilities are rounded


def answers(sent: DataFrame) -> DataFrame:
    """For each pair sent that is a place's longest: its probability in force, whether its context
    is to be extended, whether the pair occurs ``LEAST`` times; zeros for the others.  States of blocks pass."""
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if rows[0]["bucket"] < 0:
            return t
        got = [unpack(r["parts"], np.int64, *[np.uint32] * 5, np.uint8) for r in rows]
        sizes = np.zeros((len(got), max(len(g[0]) for g in got)), np.int64)  # rows x levels
        for to, g in zip(sizes, got):
            to[:len(g[0])] = g[0]
        n_levels = sizes.shape[1]

        def sums(x, runs, add=np.add, back=np.subtract):
            """Running sums of each run: a row's pairs of a level."""
            before = np.repeat(np.cumsum(runs) - runs, runs) - 1
            x = add.accumulate(x, dtype=np.uint32)
            return np.where(before < 0, x, back(x, x[before]))

        word, lo, pair, count, up = (np.concatenate([g[k] for g in got]) for k in range(1, 6))
        ends = np.concatenate([np.unpackbits(g[6], count=len(g[1])).astype(bool) if len(g[6]) else np.ones(len(g[1]), bool) for g in got])
        hi = sums(np.concatenate([g[1][:n] for g, n in zip(got, sizes[:, 0])]), sizes[:, 0]).astype(np.uint64)
        names = (hi << HALF) | sums(lo, sizes[:, 0], np.bitwise_xor, np.bitwise_xor)
        pair, above_it = sums(pair, sizes[:, 0]).astype(np.uint64), sums(up, sizes.ravel())
        order = np.argsort(np.repeat(np.tile(np.arange(n_levels), len(got)), sizes.ravel()), kind="stable")
        cut = np.concatenate([[0], np.cumsum(sizes.sum(axis=0))])
        row = np.repeat(np.arange(len(got)), sizes.sum(axis=1))
        above = np.cumsum(sizes, axis=0) - sizes  # where a row's pairs begin in the order of a level
        logs, ons, oftens = np.zeros(len(word), np.float32), np.zeros(len(word), bool), np.zeros(len(word), bool)
        kept, log, on = 0, None, None
        for j in range(n_levels):
            at = order[cut[j]:cut[j + 1]]
            if j == 0:
                q, alive = 10.0 ** up[at].view(np.float32).astype(np.float64), np.ones(len(at), bool)
            else:
                to = above_it[at].astype(np.int64) + above[row[at], j - 1]
                q, alive = 10.0 ** log[to].astype(np.float64), on[to]
                names, pair = mix64(names[to] * np.uint64(BASE) + word[at]), pair[to]
            ctx = group_equal(names)[2]
            _, one, of = group_equal((ctx.astype(np.uint64) << HALF) | pair)
            total = np.bincount(of, weights=count[at], minlength=len(one))
            log, stays, ahead = judge(ctx[one], total, q[one], alive[one])
            ahead = worth(ctx[one], total, log, ahead)
            kept += int(stays.sum())
            log, on = log[of], ahead[ctx]
            end = ends[at]
            logs[at], ons[at], oftens[at] = np.where(end, log, 0), on & end, (total >= LEAST)[of] & end
        out = []
        last = np.cumsum(sizes.sum(axis=1))
        for i, (r, b, e) in enumerate(zip(rows, (last - sizes.sum(axis=1)).tolist(), last.tolist())):
            out.append((r["bucket"], r["block"], 0, kept if i == 0 else 0, 0.0,
                        pack(logs[b:e], np.packbits(ons[b:e]), np.packbits(oftens[b:e]))))
        return table(out)

    return sent.groupBy("bucket").applyInArrow(run, ROWS)


def send_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, keys, counts): distinct words of each block."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key, count = block_keys(row), stretch(row["counts"], np.uint32, row["kinds"])
                to = key % np.uint64(buckets)
                cols = [[], [], [], [], []]
                for b in range(buckets):
                    at = to == b
                    if at.any():
                        for c, x in zip(cols, (b, row["block"], int(at.sum()), *squeeze(key[at], count[at]))):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(cols)],
                        ["bucket", "block", "n", "keys", "counts"])

    return blocks.select("block", "kinds", "keys", "counts").mapInArrow(run, "bucket long, block long, n long, keys binary, counts binary")


def word_counts(sent: DataFrame) -> DataFrame:
    """(block, bucket, counts, types, tokens): the corpus's training count of each
    word sent; a bucket's numbers of words stand on its first row."""
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sizes = np.array([r["n"] for r in rows])
        key = np.concatenate([stretch(r["keys"], np.uint64, r["n"]) for r in rows])
        count = np.concatenate([stretch(r["counts"], np.uint32, r["n"]) for r in rows])
        of = group_equal(key)[2]
        total = np.bincount(of, weights=count).astype(np.int64)
        back = [squeeze(x)[0] for x in np.split(total[of], np.cumsum(sizes)[:-1])]
        heads = np.zeros((2, len(rows)), np.int64)
        heads[:, 0] = (total > 0).sum(), total.sum()
        return pa.table({"block": t["block"], "bucket": t["bucket"], "n": t["n"], "counts": pa.array(back, pa.binary()),
                         "types": pa.array(heads[0]), "tokens": pa.array(heads[1])})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, n long, counts binary, types long, tokens long")


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that this module wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files go when the query that made them ends: what a round leaves is its written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          report: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.
    The model learns from the rows where ``learn`` holds.  ``report`` receives of each round
    (first depth, levels, contexts that stay, score of the other rows before it)."""
    with shuffles_removed(docs.sparkSession):
        return _score(docs, learn, id_col, text_col, report)


def _score(docs: DataFrame, learn: Column, id_col: str, text_col: str, report: list | None) -> DataFrame:
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "none").parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    text, blocks = kept(token_blocks(docs, id_col, text_col, learn), "lm-tokens")
    total, n_learn = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "n_learn")]).first()
    buckets, spread = max(16, -(-total // BUCKET_BYTES)), max(16, -(-total // LEVEL_BYTES))
    spent, counts = kept(word_counts(send_words(blocks, buckets)), "lm-words")
    types, tokens = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens")]).first()
    types, tokens = types + (n_learn > 0), tokens + n_learn  # the end is a token
    floor = tokens + 0.1 * (types + 1)

    def begin(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        key = block_keys(row)
        count, to = np.zeros(len(key), np.int64), key % np.uint64(buckets)
        for r in right.to_pylist():
            count[to == r["bucket"]] = stretch(r["counts"], np.int64, r["n"])
        return Block.first(row, count, floor, n_learn).ask(1, 1, spread)

    def next_round(last: DataFrame, depth: int, levels: int, then, schema: str) -> DataFrame:
        """``then`` of each block, read from its tokens until it was carved, afterwards from its state."""
        if depth - levels < CARVE:
            def run(left: pa.Table, right: pa.Table) -> pa.Table:
                return then(Block.again(right.to_pylist(), depth, levels, left.to_pylist()[0]))

            return blocks.groupBy("block").cogroup(last.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(run, schema)

        def alone(t: pa.Table) -> pa.Table:
            return then(Block.again(t.to_pylist(), depth, levels, None))

        return last.groupBy("block").applyInArrow(alone, schema)

    blocks = blocks.select("block", "docs", "ids", "learn", "sizes", "keys", "codes")
    sent = blocks.groupBy("block").cogroup(counts.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(begin, ROWS)
    depth, levels = 1, 1
    while True:
        path, last = kept(answers(sent), f"lm-level-{depth}")
        drop_table(spark, spent)  # the round before is answered in full
        spent = path
        if text and depth >= CARVE:  # states hold what still asks
            drop_table(spark, text)
            text = None
        asked, most, stay, held = last.agg(*[F.coalesce(x, F.lit(0)) for x in (
            F.sum("asked"), F.max("asked"), F.sum("kept"), F.sum("held"))]).first()
        if report is not None:
            report.append((depth, levels, stay, held))
        depth += levels
        if not asked:
            break
        before, levels = levels, max(1, min(depth, PAIRS // most)) if depth >= TAIL else 1
        parts = min(spread, max(16, -(-asked * levels // LEVEL_PAIRS)))
        sent = next_round(last, depth, before, lambda b, d=depth, n=levels, k=parts: b.ask(d, n, k), ROWS)

    def results(b: Block) -> pa.Table:
        return pa.table({"id": pa.array(b.ids, mask=b.ids == NO_ID), "n_tokens": b.tokens, "n_known": b.known,
                         "base_score": b.base, "score": b.totals()})

    scores = next_round(last, depth, levels, results, "id long, n_tokens long, n_known long, base_score double, score double")
    return scores.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
