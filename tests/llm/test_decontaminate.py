"""Operator 2 against brute force."""

import hashlib
import re

import pytest

from centime.llm import decontaminate, queries

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        yield i, len(w), len(hit), sorted(found)


def test_query_whole_table(spark, small_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.op2_decontamination(spark, SMALL).collect()}
    want = list(brute(small_rows, items))
    for i, n, hit, found in want:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert any(hit for _, _, hit, _ in want)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"), (2, "two words"), (3, None),
         (4, ""), (5, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"), (None, "one"),
         (2, "five words")]


@pytest.mark.parametrize("block", [None, 5])
def test_odd_rows(spark, odd, odd_rows, monkeypatch, block):
    """With and without a benchmark that takes several blocks."""
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.annotate(odd, bench).collect()
    want = brute([(r[0], r[1]) for r in odd_rows], [("" if i is None else i, t) for i, t in ITEMS])
    assert sorted((str(r.id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)


def test_remove_keeps_clean_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = [w[2] > 0 and 20 * w[2] >= w[1] for w in brute([(r[0], r[1]) for r in odd_rows],
                                                          [("" if i is None else i, t) for i, t in ITEMS])]
    got = decontaminate.remove(odd, bench)
    assert got.columns == odd.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r, b in zip(odd_rows, bad) if not b)
    assert decontaminate.remove(empty, bench).count() == 0
    none = bench.where("false")
    assert decontaminate.remove(odd, none).count() == len(odd_rows)
    assert {r.n_hit for r in decontaminate.annotate(odd, none).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "delta gamma beta alpha"),
                                  (4, "alpha x x x x beta gamma delta"), (5, "gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "alpha beta gamma delta")], "item_id string, text string")
    index = decontaminate.build_index(docs)
    assert {(r.id, r.start, r.length) for r in decontaminate.matches(index, bench).collect()} == {(1, 0, 4)}
    near = {r.id for r in decontaminate.matches(index, bench, slop=1).collect()}
    assert near == {1, 2}
    with pytest.raises(ValueError):
        decontaminate.matches(index, bench, slop=40)
