"""Operator 4, token counts by a linear longest-match automaton.

A word's pieces are those of greedy longest match: again and again the longest
vocabulary entry that begins the rest of the word.  The automaton is a trie of
the vocabulary with failure links.  Where a state has no edge for the next
byte, greedy matching has fixed its next pieces; the link leads to the state of
the bytes that remain, and how many pieces were fixed ("popped") on the way is
stored beside it.  A word costs at most two steps a byte, and its number of
pieces is the sum of the popped counts; no piece is built.

All distinct words of a chunk walk the automaton together, byte by byte, and a
worker counts a distinct word once (``UnitMemo``).

Words are the runs of bytes between white space after A-Z are lowered, with
every ASCII punctuation mark as a word of its own.  Vocabularies are given as
token -> id in a tokenizer file; entries that end in the end-of-word suffix match
at a word's end only.  A word that greedy matching cannot finish is one unknown
token.

Defined results: null or empty text has no words and no tokens; repeated rows
each get their result; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER_SPACE_TABLE, UnitMemo, rows_for, text_bytes

END = 256  # the symbol after a word's last byte
SYMBOLS = 257
MEMO = 1_500_000

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable
    Latin-1 characters are themselves, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Entries of a byte-level BPE file as symbols."""
    spec = json.load(open(path))  # the vocabulary file, a local path on every machine
    suffix, letters = spec["model"].get("end_of_word_suffix") or "", byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    out = []
    for token in spec["model"]["vocab"]:
        if token in special:
            continue
        end = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if end else token
        out.append((*[letters[c] for c in body], *([END] if end else [])))
    return out


class Automaton:
    """Trie edges (sorted state * SYMBOLS + symbol -> state), failure links (-1:
    none) and the number of pieces popped on each link."""

    def __init__(self, entries: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for entry in entries:
            v = 0
            for s in entry:
                u = children[v].get(s)
                if u is None:
                    u = children[v][s] = len(children)
                    children.append({})
                    final.append(False)
                v = u
            final[v] = True
        link, popped = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for v in level:
                for s, u in children[v].items():
                    below.append(u)
                    if final[u]:
                        link[u], popped[u] = 0, 1  # the entry itself is popped
                        continue
                    z, n = link[v], popped[v]
                    while z >= 0 and s not in children[z]:
                        n += popped[z]
                        z = link[z]
                    if z >= 0:
                        link[u], popped[u] = children[z][s], n
            level = below
        edges = [(v * SYMBOLS + s, u) for v, c in enumerate(children) for s, u in c.items()]
        keys = np.array([e[0] for e in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([e[1] for e in edges], np.int64)[order]
        self.link, self.popped = np.array(link), np.array(popped)

    def edge(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of every word; a word without a full match has one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        start = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - size[np.argsort(order)])[order]
        state, n, lost = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for t in range(int(size[0]) + 1 if len(size) else 0):
            live = np.searchsorted(-size, -t, side="right")  # words with t bytes or more
            at = np.flatnonzero(~lost[:live])
            symbol = np.where(size[at] == t, END, data[start[at] + np.minimum(t, size[at] - 1)])
            while len(at):
                to = self.edge(state[at], symbol)
                ok = to >= 0
                state[at[ok]] = to[ok]
                at, symbol = at[~ok], symbol[~ok]
                # a symbol that no entry begins with: nothing to pop at the root; END needs no edge there
                done = (state[at] == 0) & (symbol == END)
                at, symbol = at[~done], symbol[~done]
                n[at] += self.popped[state[at]]
                state[at] = self.link[state[at]]
                stuck = state[at] < 0
                lost[at[stuck]] = True
                at, symbol = at[~stuck], symbol[~stuck]
        at = np.flatnonzero(~lost & (state > 0))
        while len(at):  # what remains after the end
            n[at] += self.popped[state[at]]
            state[at] = self.link[state[at]]
            lost[at[state[at] < 0]] = True
            at = at[state[at] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost, 1, n)
        return out


def split_words(texts: list[bytes]):
    """(bytes, start and size of every word, first word of each text)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = b"".join(t.translate(LOWER_SPACE_TABLE) + b" " for t in texts)
    a = np.frombuffer(data, np.uint8)
    mark = PUNCTUATION[a]
    plain = (a != 32) & ~mark
    before = np.concatenate([[False], plain[:-1]])
    begin = mark | (plain & ~before)
    start = np.flatnonzero(begin)
    end = np.flatnonzero(mark | (plain & ~np.append(plain[1:], False))) + 1
    return data, start, end - start, np.searchsorted(start, np.concatenate([[0], np.cumsum(size + 1)]))


_MEMOS: dict[str, UnitMemo] = {}


def memo_of(path: str) -> UnitMemo:
    """The worker's memo of word counts over the vocabulary's automaton."""
    if path not in _MEMOS:
        auto = Automaton(vocabulary(path))
        _MEMOS[path] = UnitMemo(lambda units: (auto.count(units), np.ones(len(units), np.int64)), MEMO)
    return _MEMOS[path]


def count(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, most (tokens of the
    word that has most)."""
    src = text_bytes(docs, id_col, text_col)

    def run(batches):
        memo = memo_of(tokenizer)
        for ids, texts in rows_for(batches):
            data, start, size, first = split_words(texts)
            n, _ = memo.ids(data, start, size)
            total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            most = np.zeros(len(texts), np.int64)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                most[full] = np.maximum.reduceat(n, first[full])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array(most)],
                ["id", "n_words", "n_tokens", "most"])

    return src.mapInArrow(run, src.select("id").schema.add("n_words", "long").add("n_tokens", "long").add("most", "long"))
