"""Operator 1, language identification by a bidirectional gated recurrent
network over bytes.

Two gated recurrent layers read a text's bytes, one forwards, one backwards;
their states at a position give that position's language probabilities, and a
document's probabilities are the mean over all positions of its whole text.
A text is read in segments of ``SEGMENT`` bytes, each from a zero state, so
that the segments of many documents advance together as one matrix, a long
document costs what its bytes cost, and memory is bounded.

Training (``fit``) is backpropagation through time in numpy with Adam, on at
most ``TRAIN_DOCS`` labelled documents (those with the smallest hash of their
text, so any partitioning draws the same ones) and ``WINDOWS`` segments of each.
That bound holds for the labelled sample only; every document is predicted
from all its bytes.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any labelled document all are ``und``; ties go to the label that sorts
first; null labels are not learnt from; repeated rows each get their result;
an empty table gives an empty table; other columns are untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import rows_for, written

SEGMENT = 128
HIDDEN = 8
TRAIN_DOCS = 4000
WINDOWS = 3
STEPS = 400
BATCH = 192
LANES = 4096  # segments that advance together
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]


def _layer(w: dict, d: str, codes: np.ndarray, live: np.ndarray, keep: bool = False):
    """States (time, lane, unit) of direction ``d`` over ``codes`` (time, lane).

    Lanes come longest first; ``live[t]`` of them have a byte at time t, and only
    those move, so that a lane's states don't depend on its neighbours.  z and r
    are sigmoid gates, n the new content: h' = n + z (h - n)."""
    steps, lanes = codes.shape
    x = {g: w[f"{d}x{g}"] for g in "zrn"}
    u = {g: w[f"{d}u{g}"] for g in "zrn"}
    bias = w[f"{d}bn"]
    half = bias.dtype.type(0.5)
    state = np.zeros((lanes, HIDDEN), bias.dtype)
    out = np.zeros((steps, lanes, HIDDEN), bias.dtype)
    cache = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        m = live[t]
        c, h = codes[t, :m], state[:m]
        z = h @ u["z"]
        z += x["z"][c]
        r = h @ u["r"]
        r += x["r"][c]
        for gate in (z, r):  # sigmoid by tanh
            gate *= half
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        q = h @ u["n"]
        q += bias
        n = r * q
        n += x["n"][c]
        np.tanh(n, out=n)
        if keep:
            cache.append((t, c, h.copy(), z, r, q, n))
        h -= n
        h *= z
        h += n
        out[t, :m] = h
    return out, cache


def _layer_back(w: dict, d: str, cache: list, dout: np.ndarray, grad: dict) -> None:
    """Backpropagation through time: adds the layer's gradients to ``grad``."""
    back = np.zeros_like(dout[0])
    for t, c, h, z, r, q, n in reversed(cache):
        m = len(c)
        dh = back[:m] + dout[t, :m]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        dq = dn * r
        for g, dg in (("z", dz), ("r", dr), ("n", dn)):
            np.add.at(grad[f"{d}x{g}"], c, dg)
        grad[f"{d}uz"] += h.T @ dz
        grad[f"{d}ur"] += h.T @ dr
        grad[f"{d}un"] += h.T @ dq
        grad[f"{d}bn"] += dq.sum(axis=0)
        back[:m] = dh * z + dz @ w[f"{d}uz"].T + dr @ w[f"{d}ur"].T + dq @ w[f"{d}un"].T


def _live(length: np.ndarray) -> np.ndarray:
    """Number of lanes with a byte at each time; ``length`` falls."""
    return np.searchsorted(-length, -np.arange(length[0]), side="left")


def _softmax(p: np.ndarray) -> np.ndarray:
    p -= p.max(axis=2, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=2, keepdims=True)
    return p


def position_probabilities(w: dict, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(time, lane, language) probabilities; ``codes`` is (time, lane) bytes,
    lanes of falling ``length``."""
    live = _live(length)
    p = _layer(w, "f", codes, live)[0] @ w["of"]
    p += _layer(w, "b", codes, live)[0] @ w["ob"]
    p += w["o"]
    return _softmax(p)


def _step(w: dict, codes: np.ndarray, label: np.ndarray, length: np.ndarray) -> tuple[dict, float]:
    """Gradients and mean loss of a batch, every position labelled."""
    live = _live(length)
    fwd, fc = _layer(w, "f", codes, live, keep=True)
    bwd, bc = _layer(w, "b", codes, live, keep=True)
    p = _softmax(fwd @ w["of"] + bwd @ w["ob"] + w["o"])
    mask = (np.arange(len(codes))[:, None] < length).astype(p.dtype)
    lane = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, lane, label] + 1e-9) * mask).sum() / mask.sum())
    p[:, lane, label] -= 1
    p *= (mask / mask.sum())[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    flat = p.reshape(-1, p.shape[2])
    grad["of"] = fwd.reshape(-1, HIDDEN).T @ flat
    grad["ob"] = bwd.reshape(-1, HIDDEN).T @ flat
    grad["o"] = flat.sum(axis=0)
    _layer_back(w, "f", fc, p @ w["of"].T, grad)
    _layer_back(w, "b", bc, p @ w["ob"].T, grad)
    return grad, loss


def train(segments: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Network fitted to labelled byte segments of at most ``SEGMENT`` bytes."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    w = {"o": np.zeros(len(langs), np.float32)}
    for d in "fb":
        for g in "zrn":
            w[f"{d}x{g}"] = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
            w[f"{d}u{g}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)).astype(np.float32)
        w[f"{d}bn"] = np.zeros(HIDDEN, np.float32)
        w[f"{d}xz"] += 1  # gates begin by keeping the state
        w[f"o{d}"] = rng.normal(0, 0.3, (HIDDEN, len(langs))).astype(np.float32)
    y = np.array([langs.index(x) for x in labels])
    n = np.fromiter(map(len, segments), np.int64, len(segments))
    codes = np.zeros((len(segments), SEGMENT), np.uint8)
    for i, s in enumerate(segments):
        codes[i, : len(s)] = np.frombuffer(s, np.uint8)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    order = np.concatenate([rng.permutation(len(segments)) for _ in range(-(-steps * BATCH // len(segments)))])
    for k in range(1, steps + 1):
        b = order[(k - 1) * BATCH:k * BATCH]
        b = b[np.argsort(-n[b], kind="stable")]
        grad, _ = _step(w, np.ascontiguousarray(codes[b, :n[b[0]]].T), y[b], n[b])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * (1 - (k - 1) / steps) + 0.001
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * g
            v2[name] = 0.999 * v2[name] + 0.001 * g * g
            w[name] -= (rate * (m[name] / (1 - 0.9 ** k)) / (np.sqrt(v2[name] / (1 - 0.999 ** k)) + 1e-8)).astype(np.float32)
    return Network(langs, w)


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """Of (lang, h, ...) the rows of about ``n`` distinct texts, alike many of every language: those of
    smallest hash, one row a text.  The hash range read is cut by the count of distinct texts, and
    widened until every language has its share or all it has, so copies of a text neither fill the
    sample nor empty it."""
    place = F.pmod("h", F.lit(1 << 30))
    texts = written(rows.select("lang", place.alias("place"), "h").distinct(), "language-texts")
    size = texts.groupBy("lang").agg(F.count("*").alias("size"))
    quota = max(1, n // max(1, size.count()))
    size = written(size.withColumn("want", F.least("size", F.lit(quota))), "language-sizes")
    share = 2.0
    while True:
        near = texts.join(size, "lang").where(F.col("place") < F.lit(float(1 << 30)) * share * quota / F.col("size"))
        got = near.groupBy("lang").count()
        if size.join(got, "lang", "left").where(F.coalesce("count", F.lit(0)) < F.col("want")).isEmpty():
            break
        share *= 4
    w = Window.partitionBy("lang").orderBy("place", "h")  # some quotas
    chosen = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota).select("lang", "h")
    chosen = written(chosen, "language-chosen")
    return rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # n rows, or one a language


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network:
    """Network trained on segments, drawn over the whole text, of ``TRAIN_DOCS`` distinct
    texts of ``labelled`` (one a language if there are more languages)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    windows = F.array(*[F.expr(f"substring(t, cast(pmod(xxhash64(h, {k}), ceil(octet_length(t) / {SEGMENT})) as int) * {SEGMENT} + 1, {SEGMENT})")
                        for k in range(WINDOWS)])
    rows = (labelled.where(F.col(lang_col).isNotNull()).select(text.alias("t"), F.col(lang_col).cast("string").alias("lang"))
            .where(F.octet_length("t") > 0).withColumn("h", F.xxhash64("t")).select("lang", "h", windows.alias("w")))
    rows = _sample(rows, TRAIN_DOCS).orderBy("lang", "h").collect()
    segments, labels = [], []
    for r in rows:
        for s in dict.fromkeys(bytes(x) for x in r.w):
            if s:
                segments.append(s)
                labels.append(r.lang)
    return train(segments, labels) if segments else Network([], {})


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(document, language) mean probabilities over all bytes of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), len(net.langs)))
    flat = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
    n = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(size) - size, n) + k * SEGMENT
    length = np.minimum(SEGMENT, size[doc] - k * SEGMENT)
    by_length = np.argsort(-length, kind="stable")
    for a in range(0, len(doc), LANES):
        s = by_length[a:a + LANES]
        steps = np.arange(length[s[0]])[:, None]
        inside = steps < length[s]
        codes = np.where(inside, flat[begin[s] + steps], 0).astype(np.uint8)
        p = position_probabilities(net.weights, codes, length[s])
        p *= inside[:, :, None]
        np.add.at(out, doc[s], p.sum(axis=0, dtype=np.float64))
    return out / np.maximum(size, 1)[:, None]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def predict(docs: DataFrame, net: Network, key: Column, text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; ``id`` is ``key``, which may be a
    struct of all columns."""
    src = docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = StructType([src.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for ids, texts in rows_for(batches):
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)] if net.langs else []
            if known:
                p = document_probabilities(net, [texts[i] for i in known])
                score[known] = np.minimum(p.max(axis=1), 1.0)
                for i, j in zip(known, p.argmax(axis=1)):
                    lang[i] = net.langs[j]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return src.mapInArrow(run, schema)
