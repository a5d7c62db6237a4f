"""Operators 3, 7 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from centime.llm import components, exact_dedup, queries, simhash, suffix_dedup

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_odd_rows(odd, odd_rows):
    rows = [(r[0], normal(r[1])) for r in odd_rows]
    got = exact_dedup.annotate(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert r.group_size == len(same) and r.keep_id == (min(ids) if ids else None)
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    kept = exact_dedup.dedup(odd).collect()
    assert sorted(normal(r.text) for r in kept) == sorted({t for _, t in rows})
    assert kept[0].__fields__ == odd.columns


def test_exact_dedup_hot_group(spark):
    """A group with a third of all rows, beyond the sketch's other entries."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in exact_dedup.annotate(df).collect()}
    first, size = {}, {}
    for i, t in rows:
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + 1
    assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (first[t], size[t], first[t] == i) for i, t in rows)


def test_empty_tables(empty):
    assert exact_dedup.annotate(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    assert simhash.components_of(empty).count() == 0 and simhash.dedup(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [0, 42])
def test_xxh64_is_the_librarys(seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(256) for _ in range(2000))
    spans = [(rng.randrange(0, 1500), rng.randrange(0, 200)) for _ in range(400)] + [(0, n) for n in range(0, 70)]
    start, size = map(np.array, zip(*spans))
    got = simhash.xxh64(data, start, size, seed)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:a + n], seed=seed) for a, n in spans]


def fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def component_ids(ids, fps, bits=2):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_odd_rows(odd, odd_rows):
    fps = [fingerprint(r[1]) for r in odd_rows]
    want = component_ids([r[0] for r in odd_rows], fps)
    got = simhash.components_of(odd).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order([(r.id, r.fp & (1 << 64) - 1, r.component_id) for r in got]) == \
        order([(r[0], f, c) for r, f, c in zip(odd_rows, fps, want)])
    kept = simhash.dedup(odd).collect()
    assert len(kept) == len(set(component_ids(list(range(len(fps))), fps)))


@pytest.mark.parametrize("full", [False, True])
def test_links_of_dense_neighbourhoods(spark, monkeypatch, full):
    """Many fingerprints a few bits apart: full cells take the other way."""
    if full:
        monkeypatch.setattr(simhash, "CELL", 3)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(250):
        f = centre
        for _ in range(rng.choice([1, 1, 2, 3, 4, 7])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    for _ in range(20):
        centre ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)  # a chain
        fps.add(centre)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    comp = {r.node: r.label for r in components.components(simhash.links(df, 2)).collect()}
    want = component_ids(list(range(len(fps))), fps)
    ours = [comp.get(s, s) for s in signed]
    assert [ours.index(x) for x in ours] == [want.index(x) for x in want]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_simhash_query_whole_table(spark, small_rows):
    got = {r.doc_id: r for r in queries.op7_simhash_near_dedup(spark, SMALL).collect()}
    fps = [fingerprint(t) for _, t in small_rows]
    want = component_ids([i for i, _ in small_rows], fps)
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == c for (i, _), f, c in zip(small_rows, fps, want))


def without_repeats(docs, length=50):
    docs = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    own = {}
    for i, t in docs:
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            own[s] = min(own.get(s, i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if own[t[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_query_whole_table(spark, small_rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, SMALL).collect()}
    want = without_repeats(small_rows)
    assert [got[i] for i, _ in small_rows] == want and sum(w[1] for w in want) > 0


def test_suffix_odd_rows(odd, odd_rows):
    rows = suffix_dedup.dedup(odd, block_bytes=5000).collect()
    got = sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    want = sorted((str(r[0]), *w) for r, w in zip(odd_rows, without_repeats([(r[0], r[1]) for r in odd_rows])))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_suffix_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(rng.choice([30, 60, 120]))) for _ in range(12)]
    docs = [(i * 7 % 101, "".join(rng.choice(base)[rng.randrange(9):] for _ in range(rng.randrange(6)))) for i in range(60)]
    docs[5], docs[9] = (docs[5][0], "a" * 300), (docs[9][0], "a" * 200 + "b")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.dedup(df, block_bytes=700).collect()}
    assert [got[i] for i, _ in docs] == without_repeats(docs)


def test_string_ranks_order():
    data = b"abracadabra-abracadabra-banana"
    rank = suffix_dedup.string_ranks(data, 11)
    at = range(len(data) - 11 + 1)
    assert sorted(at, key=lambda p: (data[p:p + 11], p)) == sorted(at, key=lambda p: (rank[p], p))
    assert all((rank[p] == rank[q]) == (data[p:p + 11] == data[q:q + 11]) for p in at for q in at)
