"""Operator 8, toxicity by noisy-channel deobfuscation.

A writer's word reaches the page through a channel that writes letters as
look-alikes, repeats them, or spaces them out.  Each token is a lattice: a
character may stand for itself or for what ``LOOKALIKES`` says, a repetition may
stand for nothing.  Viterbi decoding finds the most probable word under a
character bigram model (all documents' letter pairs, mixed with those of the
words that mark toxic training texts) and the channel's costs; all tokens of a
chunk decode together, position by position.  Single characters in a row are
joined to one lattice first.  The restored words are then scored.

The classifier is a logistic regression on the presence of words and word
beginnings.  Which of them count is decided by a likelihood-ratio test whose
threshold grows with the number of candidates.  It learns from at most
``SAMPLE`` labelled documents (those with the smallest hash of their id); the
sample is the only bounded part: letter pairs are counted over all documents
and every document is scored from its whole text.

Defined results: null or empty text has the score of a text without marks;
without labels of both kinds every score is the share of label 1 (0 without
labels); null labels are not learnt from; repeated rows each get their score;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, UnitMemo, hash_sample, mix64, rows_for, span_hashes, text_bytes, written

SAMPLE = 20_000
BEGINNINGS = (4, 5, 6)  # lengths in bytes of the word beginnings that may count
LEAST = 3  # toxic documents that a feature must mark
RIDGE = 0.02
MEMO = 1_500_000
SPACED = 4  # single characters in a row that make a spaced word

LOOKALIKES = {  # what a character may stand for in a word
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiou"}
OPTIONS = 1 + max(map(len, LOOKALIKES.values()))
LOOK_COST, REPEAT_COST = np.log(0.3), np.log(0.05)
LEXICON = 0.8  # weight of the marked words in the character model
LETTERS = 64  # classes of the character model: edge, a-z, others by code point
SIGN = re.compile(r"[0-9@$!|+*]|(.)\1", re.S)
LETTER = re.compile(r"[^\W\d_]")

WORD = np.zeros(256, bool)  # bytes of words
WORD[48:58] = WORD[97:123] = WORD[128:] = True
INNER = np.zeros(256, bool)  # look-alikes that count inside a word
INNER[[ord(c) for c in "@$!|+*"]] = True
OPENING = np.zeros(256, bool)  # those that may open one
OPENING[[ord(c) for c in "@$!"]] = True
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = 27 + np.arange(128) % (LETTERS - 27)


def tokens(texts: list[bytes]):
    """(bytes, start and size of every token, document of each token) of lowered
    texts; spaced words stand behind the others as tokens of their own."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = b"".join(t.translate(LOWER_TABLE) + b" " for t in texts)
    a = np.frombuffer(data, np.uint8)
    word = WORD[a]
    if len(a) > 2:
        after = np.append(word[1:], False)
        before = np.concatenate([[False], word[:-1]])
        word = word | (INNER[a] & before & after) | (OPENING[a] & after & ~before)
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum(size + 1) - (size + 1)
    doc = np.searchsorted(first, start, side="right") - 1
    n = end - start
    # a single character: one byte, or one non-ASCII character of two or three
    one = (n == 1) | ((n <= 3) & (a[start] >= 0xC0) & (a[np.maximum(end - 1, 0)] >= 0x80) & (n == _char_size(a[start])))
    near = np.concatenate([[False], (start[1:] - end[:-1] <= 2) & (doc[1:] == doc[:-1])])
    chain = one & np.concatenate([[False], one[:-1]]) & near
    edge = np.diff(np.concatenate([[0], chain.view(np.int8), [0]]))
    runs = np.stack([np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)], axis=1)
    runs = runs[runs[:, 1] - runs[:, 0] >= SPACED]
    extra, extra_doc = [], []
    for s, e in runs.tolist():
        chars = [data[i:j] for i, j in zip(start[s:e].tolist(), end[s:e].tolist())]
        if len(set(chars)) > 1:
            for k in range(len(chars) - SPACED + 1):  # a word may begin at any of them
                extra.append(b"".join(chars[k:k + 24]))
                extra_doc.append(doc[s])
    if extra:
        lens = np.fromiter(map(len, extra), np.int64, len(extra))
        start = np.concatenate([start, len(data) + np.cumsum(lens) - lens])
        n, doc, data = np.concatenate([n, lens]), np.concatenate([doc, extra_doc]), data + b"".join(extra)
    return data, start, n, doc


def _char_size(lead: np.ndarray) -> np.ndarray:
    return np.where(lead >= 0xE0, 3, 2)


def feature_hashes(data: bytes, start: np.ndarray, size: np.ndarray):
    """(token, hash) of each token's features: its beginnings and itself."""
    at, out = [np.arange(len(start))], [mix64(span_hashes(data, start, size) + np.uint64(99))]
    for k in BEGINNINGS:
        long = np.flatnonzero(size >= k)
        at.append(long)
        out.append(mix64(span_hashes(data, start[long], np.full(len(long), k)) + np.uint64(k)))
    return np.concatenate(at), np.concatenate(out)


@dataclass
class Model:
    pairs: np.ndarray  # log probability of the next character class
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -np.inf

    def restore(self, words: list[str]) -> list[str]:
        """The most probable written form of each word (Viterbi).

        A state is a position's choice; its letter is the last one emitted, as a
        position may only be skipped as a repetition of that letter."""
        if not words:
            return []
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max())
        code = np.full((len(words), width), 32, np.int64)
        code[np.arange(width) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        known = np.unique(code)
        choice = np.zeros((len(known), OPTIONS), np.int64)
        cost = np.full((len(known), OPTIONS), -np.inf)
        for i, c in enumerate(known.tolist()):
            letters = LOOKALIKES.get(chr(c), "")
            own = not letters or chr(c).isalnum()  # a symbol inside a word stands for a letter
            options = ([c] if own else []) + [ord(x) for x in letters]
            choice[i, :len(options)] = options
            cost[i, :len(options)] = [0.0 if x == c and not letters else np.log(0.05) if x == c else LOOK_COST - np.log(len(letters))
                                      for x in options]
        at = np.searchsorted(known, code)
        letter, gain = choice[at], cost[at]
        kind = np.where(letter < 128, CLASS[np.minimum(letter, 127)], 27 + letter % (LETTERS - 27))
        best = self.pairs[0, kind[:, 0]] + gain[:, 0]
        back = np.zeros((len(words), width, OPTIONS), np.int8)
        skip = np.zeros((len(words), width, OPTIONS), bool)
        final = best.copy()
        for t in range(1, width):
            emit = best[:, :, None] + self.pairs[kind[:, t - 1][:, :, None], kind[:, t][:, None, :]] + gain[:, t][:, None, :]
            same = letter[:, t - 1][:, :, None] == letter[:, t][:, None, :]
            drop = np.where(same & np.isfinite(gain[:, t])[:, None, :], best[:, :, None] + REPEAT_COST, -np.inf)
            both = np.maximum(emit, drop)
            back[:, t] = both.argmax(axis=1)
            best = both.max(axis=1)
            skip[:, t] = np.take_along_axis(drop, back[:, t][:, None, :].astype(np.int64), axis=1)[:, 0] >= best
            last = n == t + 1
            final[last] = best[last]
        state = (final + self.pairs[np.take_along_axis(kind, (n - 1)[:, None, None], axis=1)[:, 0], 0]).argmax(axis=1)
        row = np.arange(len(words))
        out = np.zeros((len(words), width), np.int64)
        for t in range(width - 1, -1, -1):
            on = t < n
            out[on, t] = np.where(skip[row, t, state], 0, letter[row, t, state])[on]
            state = np.where(on & (t > 0), back[row, t, state], state)
        kept = out > 0
        flat = out[kept].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
        cut = np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut)]

    def restored(self, units: list[bytes]) -> list[bytes]:
        """Tokens with their obfuscated ones restored."""
        words = [u.decode("utf-8", "replace") for u in units]
        odd = [i for i, w in enumerate(words) if SIGN.search(w) and LETTER.search(w)]
        odd.sort(key=lambda i: len(words[i]))
        out = list(units)
        for a in range(0, len(odd), 4096):
            part = odd[a:a + 4096]
            for i, w in zip(part, self.restore([words[i] for i in part])):
                out[i] = w.encode()
        return out

    def marks(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's features that the tokens have, and how many each has."""
        done = self.restored(units)
        size = np.fromiter(map(len, done), np.int64, len(done))
        token, h = feature_hashes(b"".join(done), np.cumsum(size) - size, size)
        at = np.searchsorted(self.features, h)
        hit = at < len(self.features)
        hit[hit] = self.features[at[hit]] == h[hit]
        token, at = token[hit], at[hit]
        return at[np.argsort(token, kind="stable")], np.bincount(token, minlength=len(units))


def document_marks(memo: UnitMemo, texts: list[bytes], features: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) of the texts."""
    data, start, size, doc = tokens(texts)
    found, n = memo.ids(data, start, size)
    pair = np.unique(np.repeat(doc, n) * max(features, 1) + found)
    return pair // max(features, 1), pair % max(features, 1)


def pair_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of neighbouring character classes over all documents."""
    src = docs.select(F.lit(0).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for _, texts in rows_for(batches):
            a = CLASS[np.frombuffer(b" ".join(t.translate(LOWER_TABLE) for t in texts) + b" ", np.uint8)]
            total += np.bincount(np.concatenate([[0], a[:-1]]).astype(np.int64) * LETTERS + a, minlength=LETTERS * LETTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["pair", "n"])

    rows = src.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 64 * 64 at most
    out = np.zeros(LETTERS * LETTERS)
    for r in rows:
        out[r.pair] = r.n
    return out.reshape(LETTERS, LETTERS)


def _log(counts: np.ndarray) -> np.ndarray:
    p = counts + 0.01 * max(counts.sum(), 1) / counts.size + 1e-3
    return p / p.sum(axis=1, keepdims=True)


def _token_pairs(words: dict[bytes, int]) -> np.ndarray:
    out = np.zeros((LETTERS, LETTERS))
    for w, n in words.items():
        text = w.decode("utf-8", "replace")
        k = [0] + [int(CLASS[ord(c)]) if ord(c) < 128 else 27 + ord(c) % (LETTERS - 27) for c in text] + [0]
        np.add.at(out, (k[:-1], k[1:]), n)
    return out


def label_counts(sample: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(h, pos, neg): documents of each kind with a feature; of toxic documents
    only, or of all documents but ``wanted`` features only."""
    src = sample if wanted is not None else sample.where("toxic = 1")
    src = src.select(F.col("toxic").cast("long").alias("id"), "text")

    def run(batches):
        for marks, texts in rows_for(batches):
            data, start, size, doc = tokens(texts)
            token, h = feature_hashes(data, start, size)
            doc = doc[token]
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                doc, h = doc[wanted[at] == h], h[wanted[at] == h]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
            h, doc = h[new], doc[new]
            pos = marks.to_numpy()[doc]
            one, of = np.unique(h, return_inverse=True)
            p, n = np.bincount(of, weights=pos, minlength=len(one)), np.bincount(of, minlength=len(one))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(p.astype(np.int64)),
                                              pa.array((n - p).astype(np.int64))], ["h", "pos", "neg"])

    return (src.mapInArrow(run, "h long, pos long, neg long").groupBy("h")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST))


def _test(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood ratio statistic of "more frequent in toxic texts"; 0 if less."""
    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    a, b, all_ = pos / n_pos, neg / n_neg, (pos + neg) / (n_pos + n_neg)
    g = 2 * (part(pos, n_pos, a) + part(neg, n_neg, b) - part(pos, n_pos, all_) - part(neg, n_neg, all_))
    return np.where(a > b, g, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model learnt from ``labels`` (id, 0 or 1) of ``docs``."""
    some = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
            .groupBy("label_id").agg(F.max("toxic").alias("toxic")))  # a document labelled both ways is toxic
    some = written(hash_sample(some, F.xxhash64("label_id"), SAMPLE, "toxic-hashed"), "toxic-labels")
    sample = written(docs.join(F.broadcast(some), F.col(id_col) == F.col("label_id"))  # at most SAMPLE rows
                     .select("toxic", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "toxic-sample")
    pairs = pair_counts(docs, text_col)
    count = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = count.get(1, 0), count.get(0, 0)
    model = Model(np.log(_log(pairs)))
    if not n_pos or not n_neg:
        model.bias = np.inf if n_pos else -np.inf
        return model
    cand = label_counts(sample, None).toArrow()["h"].to_numpy().view(np.uint64)  # bounded by the sample
    cand = np.sort(cand)
    if len(cand):
        t = label_counts(sample, cand).toArrow()
        h = t["h"].to_numpy().view(np.uint64)
        g = _test(t["pos"].to_numpy(), t["neg"].to_numpy(), n_pos, n_neg)
        good = np.flatnonzero(g > 2 * np.log(len(cand)) - 4)
        model.features = np.sort(h[good])
    features = model.features

    def marked(batches):  # the words that carry a feature
        for _, texts in rows_for(batches):
            data, start, size, _ = tokens(texts)
            token, h = feature_hashes(data, start, size)
            at = np.searchsorted(features, h)
            hit = at < len(features)
            hit[hit] = features[at[hit]] == h[hit]
            which = np.unique(token[hit])
            words = [data[i:i + j] for i, j in zip(start[which].tolist(), size[which].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])

    toxic = sample.where("toxic = 1").select(F.lit(0).alias("id"), "text")
    lexicon = {bytes(r.word): r.n for r in toxic.mapInArrow(marked, "word binary").groupBy("word")
               .agg(F.count("*").alias("n")).collect()}
    model.pairs = np.log((1 - LEXICON) * _log(pairs) + LEXICON * _log(_token_pairs(lexicon)))

    def rows(batches):
        memo = UnitMemo(model.marks, MEMO)
        for marks, texts in rows_for(batches):
            doc, f = document_marks(memo, texts, len(features))
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([marks, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(f))],
                                             ["toxic", "f"])

    data = (sample.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(rows, "toxic long, f array<long>")
            .groupBy("toxic", "f").agg(F.count("*").alias("n")).orderBy("toxic", "f").collect())  # patterns of the sample
    model.weights, model.bias = regress([r.f for r in data], np.array([r.toxic for r in data], float),
                                        np.array([r.n for r in data], float), len(features))
    return model


def regress(rows: list[list[int]], y: np.ndarray, n: np.ndarray, features: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on feature presence, by Adam."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f = np.array([x for r in rows for x in r], np.int64)
    p = np.zeros(features + 1)
    p[-1] = np.log(max((y * n).sum(), 0.5) / max(((1 - y) * n).sum(), 0.5))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        z = np.bincount(of, weights=p[f], minlength=len(rows)) + p[-1]
        err = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(f, weights=err[of], minlength=features) + RIDGE * p[:-1], err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p -= 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return p[:-1], float(p[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_marks: features found) for every row."""
    src = text_bytes(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights that passed the test and the pair table

    def run(batches):
        model = shared.value
        memo = UnitMemo(model.marks, MEMO)
        for ids, texts in rows_for(batches):
            doc, f = document_marks(memo, texts, len(model.features))
            z = np.full(len(texts), model.bias)
            if len(doc):
                z += np.bincount(doc, weights=model.weights[f], minlength=len(texts))
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array(np.bincount(doc, minlength=len(texts)))],
                                             ["id", "score", "n_marks"])

    return src.mapInArrow(run, src.select("id").schema.add("score", "double").add("n_marks", "long"))


def restore_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored): every text's tokens after deobfuscation, space-joined."""
    src = text_bytes(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, texts in rows_for(batches):
            data, start, size, doc = tokens(texts)
            units = shared.value.restored([data[i:i + j] for i, j in zip(start.tolist(), size.tolist())])
            out: list[list[bytes]] = [[] for _ in texts]
            for d, u in zip(doc.tolist(), units):
                out[d].append(u)
            yield pa.RecordBatch.from_arrays([ids, pa.array([b" ".join(x).decode("utf-8", "replace") for x in out], pa.string())],
                                             ["id", "restored"])

    return src.mapInArrow(run, src.select("id").schema.add("restored", "string"))
