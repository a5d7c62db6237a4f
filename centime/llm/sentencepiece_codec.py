"""Operator 6, SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a
piece: the pair with the best score is merged first, of equal scores the
leftmost, until no pair is left; characters without a piece become byte
pieces.  Two forms of the agenda:

* for units of up to ``SHORT`` characters, many units together: a matrix with
  a row of pair scores per unit, whose maximum is the head of that agenda;
* for longer ones (a text without spaces is one unit) a heap and linked
  symbols, n log n in the length.

A *unit* is a run of the space mark and the characters up to the next mark.
When no piece has a mark after another character (tested as the vocabulary
is loaded), merges never cross units, so equal units share one encoding and
a worker encodes each distinct unit once; the memo is emptied at ``MEMO``
units, which costs time and changes nothing.  Otherwise the whole text is
one unit.

Every unit encoded and every text decoded is checked against the
sentencepiece library within its Arrow batch; a difference ends the job.

Defined results: null or empty text has no ids and decodes to the empty
text; invalid UTF-8 is read as U+FFFD; repeated rows each get their result;
an empty table gives an empty table; other columns are ignored by ``encode``.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import rows_for, text_bytes

MARK = "▁"
SHORT = 24
MEMO = 800_000
UNKNOWN = " ⁇ "  # what the unknown id decodes to, a fixed value

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        normal = {p: i for i, p in enumerate(pieces) if i not in special}
        self.score = np.array([lib.get_score(i) for i in range(size)], np.float32)
        self.normal = normal
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 21) | b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged, self.pairs = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order], pairs
        self.separable = not any(b == MARK and a != MARK for p in normal for a, b in zip(p, p[1:]))
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.separable else re.compile("(?s).+")
        self.prefix = lib.normalize("a").startswith(MARK)
        self.surface = [b"" if lib.is_control(i) else UNKNOWN.encode() if lib.is_unknown(i)
                        else bytes([int(p[1:-1], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.marked = {i for p, i in normal.items() if p.startswith(MARK)}
        self.controls = {i for i in range(size) if lib.is_control(i)}
        self._forget()

    def _forget(self) -> None:
        """The memo: unit -> number, and the ids of each number in one run."""
        self.memo: dict[str, int] = {}
        self.flat, self.first = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def symbol(self, s: str) -> int | None:
        """A piece's id; a single character without piece has one beyond the vocabulary."""
        return self.normal.get(s, self.size + ord(s) if len(s) == 1 else None)

    def _ids(self, symbols) -> tuple[int, ...]:
        """Symbols beyond the vocabulary become byte pieces."""
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(s - self.size).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of unknown characters is one id
        return tuple(out)

    def encode_long(self, unit: str) -> tuple[int, ...]:
        sym = [self.symbol(c) for c in unit]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def add(i):
            j = after[i]
            if j < n and (m := self.pairs.get((sym[i] << 21) | sym[j])) is not None:
                heapq.heappush(agenda, (-self.score[m], i, sym[i], sym[j], m))

        for i in range(n):
            add(i)
        while agenda:
            _, i, a, b, m = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            add(i)
            if before[i] >= 0:
                add(before[i])
        return self._ids(s for s in sym if s >= 0)

    def encode_short(self, units: list[str]) -> list[tuple[int, ...]]:
        n = np.fromiter(map(len, units), np.int64, len(units))
        width = int(n.max())
        flat = "".join(units)
        chars, inverse = np.unique(np.frombuffer(flat.encode("utf-32-le"), np.uint32), return_inverse=True)
        sym = np.full((len(units), width + 1), -1, np.int64)
        sym[:, :width][np.arange(width) < n[:, None]] = np.array([self.symbol(chr(c)) for c in chars], np.int64)[inverse]
        rows, live = np.arange(len(units)), sym.copy()
        into = self.lookup(live[:, :-1], live[:, 1:])
        while len(rows):
            gain = np.where(into >= 0, self.score[into], -np.inf)
            at = gain.argmax(axis=1)
            k = np.arange(len(rows))
            more = into[k, at] >= 0
            done = ~more
            sym[rows[done]] = live[done]
            rows, live, into, at = rows[more], live[more], into[more], at[more]
            k = np.arange(len(rows))
            live[k, at] = into[k, at]
            col = np.arange(width)
            shift = col + (col > at[:, None])
            live[:, :width] = np.take_along_axis(live, shift, axis=1)
            live[:, width] = -1
            into = np.take_along_axis(into, np.minimum(shift, width - 1), axis=1)
            into[:, -1] = -1
            into[k, at] = self.lookup(live[k, at], live[k, at + 1])
            left = np.maximum(at - 1, 0)
            into[k, left] = np.where(at > 0, self.lookup(live[k, left], live[k, at]), into[k, left])
        return [self._ids(r[: r.index(-1)]) for r in sym.tolist()]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, or -1."""
        key = (a << 21) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def _learn(self, units: list[str]) -> None:
        units.sort(key=len)
        ids: list[tuple[int, ...]] = []
        short = bisect.bisect_right(units, SHORT, key=len)
        for a in range(0, short, 8192):
            ids += self.encode_short(units[a:min(a + 8192, short)])
        ids += [self.encode_long(u) for u in units[short:]]
        plain = [(u[1:] if self.prefix else u).replace(MARK, " ") for u in units]
        for u, ours, theirs in zip(units, ids, self.lib.encode(plain, num_threads=1)):
            if tuple(theirs) != ours and self.lib.normalize((u[1:] if self.prefix else u).replace(MARK, " ")) == u:
                raise ValueError(f"the library encodes {u!r} otherwise: {theirs}, not {ours}")
        n = len(self.memo)
        begin = self.first[n]
        ends = begin + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while n + len(ids) + 1 > len(self.first):
            self.first = np.concatenate([self.first, self.first])
        self.flat[begin:ends[-1]] = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1] - begin))
        self.first[n + 1:n + 1 + len(ids)] = ends
        self.memo.update(zip(units, range(n, n + len(ids))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one run, and where each text begins in it."""
        units = [self.unit.findall(t) for t in self.lib.normalize(texts)]
        if len(self.memo) > MEMO:
            self._forget()
        new = set().union(*units).difference(self.memo)
        if new:
            self._learn(list(new))
        per_text = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(units)), np.int64, int(per_text[-1]))
        n = self.first[at + 1] - self.first[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.first[at] - ends[:-1], n) + np.arange(ends[-1])], ends[per_text]

    def decode(self, ids: list[int]) -> str:
        runs = [ids]
        if not self.controls.isdisjoint(ids):  # a control id parts the bytes of a character
            cut = [i for i, x in enumerate(ids) if x in self.controls]
            runs = [ids[a + 1:b] for a, b in zip([-1, *cut], [*cut, len(ids)])]
        out = "".join(b"".join(map(self.surface.__getitem__, r)).decode("utf-8", "each_byte") for r in runs)
        head = next((i for i in ids if self.surface[i]), -1)  # a mark that begins the text is the encoder's own
        return out[1:] if self.prefix and head in self.marked else out


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), decoded (text)."""
    src = text_bytes(docs, id_col, text_col)
    schema = StructType([src.schema["id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches):
        c = codec(model)
        for keys, texts in rows_for(batches):
            texts = [t.decode("utf-8", "replace") for t in texts]
            flat, first = c.encode(texts)
            lists = [flat[a:b].tolist() for a, b in zip(first, first[1:])]
            decoded = [c.decode(x) for x in lists]
            if decoded != c.lib.decode(lists, num_threads=1):
                raise ValueError("the library decodes a text of this batch otherwise")
            yield pa.RecordBatch.from_arrays(
                [keys, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat)), pa.array(decoded, pa.string())],
                ["id", "ids", "decoded"])

    return src.mapInArrow(run, schema)
