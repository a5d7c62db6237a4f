"""Operators 4, 5 and 6 against the libraries, brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from centime.llm import pfor, queries, sentencepiece_codec, token_counts, token_ids

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 32])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    v = rng.integers(0, top, n).astype(np.uint32)
    v[rng.random(n) < 0.05] = rng.integers(0, 1 << 32)
    raw, start = pfor.pack(v)
    assert (pfor.unpack(raw, start, n) == v).all() and len(start) == -(-n // pfor.BLOCK)


def test_outliers_become_exceptions():
    v = np.full(256, 7, np.uint32)
    v[[3, 200]] = 1 << 30
    raw, _ = pfor.pack(v)
    assert len(raw) == 8 + 2 * 5  # width 0, two exceptions


def test_unit_encoder_is_the_librarys():
    e, rng = token_ids.Encoder(BYTES), random.Random(2)
    parts = ["a", "b", " ", "\n", "\t", "'", "s", "'s", "1", "é", "漢", "\xa0", "　", "😀", ".", ",", "<|endoftext|>", "Z", " the",
             "\x1c", "\x85", "\r\n", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    flat, n = e.encode([t.encode() for t in texts])
    got = np.split(flat, np.cumsum(n)[:-1])
    assert all(g.tolist() == e.lib.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


def shards(spark, df, tmp_path):
    path = str(tmp_path / "shards")
    token_ids.write(df, path, BYTES)
    return token_ids.with_start(token_ids.read(spark, path)).collect()


def test_shards_odd_rows(spark, odd, odd_rows, tmp_path):
    lib = Tokenizer.from_file(BYTES)
    rows = shards(spark, odd, tmp_path)
    want = sorted(((r[0] is not None, r[0] or 0), lib.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in odd_rows)
    got = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.id for r in got if r.id is not None] == sorted(r[0] for r in odd_rows if r[0] is not None)
    ids = sorted(((r.id is not None, r.id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert ids == want


def test_shards_of_nothing(spark, empty, tmp_path):
    assert shards(spark, empty, tmp_path) == []


def test_token_ids_query_whole_table(spark, small_rows):
    lib, start = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in queries.op5_token_ids(spark, SMALL).collect()}
    for i, t in small_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_piece_agenda_is_the_librarys():
    c, rng = sentencepiece_codec.Codec(PIECES), random.Random(1)
    letters = "ab ▁\n\té漢😀  the \x00xyzeeee1234<s></s>"
    for k in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = c.encode([t])[0].tolist()
        assert ids == c.lib.encode(t) and c.decode(ids) == c.lib.decode(ids)
    long = "abcde" * 3000
    assert c.encode([long])[0].tolist() == c.lib.encode(long)


def test_any_ids_decode_as_in_the_library():
    c, rng = sentencepiece_codec.Codec(PIECES), random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(12))]
        assert c.decode(ids) == c.lib.decode(ids)


def test_long_and_short_agendas_agree():
    c = sentencepiece_codec.Codec(PIECES)
    units = ["▁" + w for w in "internationalization hello aaaaaaaa the 12345678 éèê zzzzzzzzzzzzzz".split()]
    assert c.encode_short(units) == [c.encode_long(u) for u in units]


def piece_digests(rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in rows:
        ids = lib.encode(t or "")
        yield (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_sentencepiece_query_whole_table(spark, small_rows):
    got = queries.op6_sentencepiece(spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(piece_digests(small_rows))


def test_sentencepiece_odd_rows(odd, odd_rows, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode(odd, PIECES).collect()
    want = [(r[0], lib.encode(r[1] or "")) for r in odd_rows]
    assert sorted(((str(r.id), list(r.ids), r.decoded) for r in got)) == sorted((str(i), x, lib.decode(x)) for i, x in want)
    assert sentencepiece_codec.encode(empty, PIECES).count() == 0


def greedy(word, entries, longest):
    symbols, i, n = (*word, token_counts.END), 0, 0
    while i < len(symbols):
        if symbols[i] == token_counts.END and (token_counts.END,) not in entries:
            break
        for j in range(min(len(symbols), i + longest), i, -1):
            if symbols[i:j] in entries:
                break
        else:
            return 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(40))
def test_automaton_is_greedy_longest_match(seed):
    rng = random.Random(seed)
    entries = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) + ((token_counts.END,) if rng.random() < 0.4 else ())
               for _ in range(rng.randint(1, 12))}
    auto = token_counts.Automaton(sorted(entries))
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    assert auto.count(words).tolist() == [greedy(w, entries, 6) for w in words]


def brute_counts(texts):
    entries = set(token_counts.vocabulary(WORDS))
    longest = max(map(len, entries))
    for t in texts:
        data, start, size, _ = token_counts.split_words([(t or "").encode()])
        n = [greedy(data[a:a + k], entries, longest) for a, k in zip(start, size)]
        yield len(n), sum(n), max(n, default=0)


def test_token_counts_query_whole_table(spark, small_rows):
    got = {r.doc_id: (r.n_words, r.n_tokens, r.max_tokens_of_word) for r in queries.op4_token_counts(spark, SMALL).collect()}
    assert [got[i] for i, _ in small_rows] == list(brute_counts(t for _, t in small_rows))


def test_token_counts_odd_rows(odd, odd_rows, empty):
    got = token_counts.count(odd, WORDS).collect()
    want = [(str(r[0]), *c) for r, c in zip(odd_rows, brute_counts(r[1] for r in odd_rows))]
    assert sorted((str(r.id), r.n_words, r.n_tokens, r.most) for r in got) == sorted(want)
    assert token_counts.count(empty, WORDS).count() == 0
