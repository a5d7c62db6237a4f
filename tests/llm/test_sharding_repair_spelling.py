"""Operators 11, 12 and 13 against brute force."""

import hashlib
import heapq
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from centime.llm import conversation_repair as repair
from centime.llm import queries, sharding, spelling

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401


# --- 11, sharding ----------------------------------------------------------------------------

def chained(*values):
    """Spark's xxhash64 of longs (q), ints (i) and strings."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def shards_of(rows, shards, seed=sharding.SEED):
    """(id, text, source) -> sorted (id, text, shard, slot)."""
    pinned = struct.pack("<i", seed)
    strata = {}
    for i, t, s in rows:
        strata.setdefault(s, []).append((chained(pinned, i, None if t is None else t.encode()), i, t))
    ranked = []
    for s, members in strata.items():
        key = "{}" if s is None else '{"s":"%s"}' % s
        u = (chained(pinned, key.encode()) % (1 << 20)) / (1 << 20)
        for r, (h, i, t) in enumerate(sorted(members, key=lambda m: m[0])):
            ranked.append(((r + u) / len(members), key, i, t))
    ranked.sort(key=lambda m: m[:2])
    n, out = len(ranked), []
    for at, (_, _, i, t) in enumerate(ranked):
        k = at * shards // n
        out.append((i, t, k, at - -(-k * n // shards)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_shards_are_the_interleaved_cut(small):
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    got = [(r.doc.doc_id, r.doc.text, r.shard, r.slot) for r in sharding.assign(small.repartition(5), 24).collect()]
    assert sorted(got, key=key) == sorted(shards_of(rows, 24), key=key)


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 40}") for i in range(4800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.assign(df, 24).groupBy("shard", "doc.source").count().collect()
    size, of = Counter(), Counter(s for _, _, s in rows)
    for r in got:
        size[r.shard] += r["count"]
        # 41 strata round by less than one row each, in all directions
        assert abs(r["count"] - of[r.source] / 24) <= (2 if r.source != "hot" else 10)
    assert set(size.values()) == {200} and len(size) == 24
    small_strata = spark.createDataFrame([(i, "x", f"only{i}") for i in range(480)], "doc_id long, text string, source string")
    got = sharding.assign(small_strata, 24).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [20] * 24


def test_sharding_query(spark):
    got = queries.QUERIES["op11_sharding"](spark, SMALL).collect()
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = queries.QUERIES["op11_sharding"](spark, SMALL).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharding_odd_rows(odd, odd_rows, empty, spark):
    got = sharding.write(odd, sharding.shard_path(spark), 7).collect()
    assert sorted(map(repr, (tuple(r.doc) for r in got))) == sorted(map(repr, odd_rows))
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n.values()) <= 1
    few = sharding.assign(odd.limit(3), 24).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert sharding.assign(empty, 24).count() == 0 and sharding.write(empty, sharding.shard_path(spark), 24).count() == 0


# --- 12, conversation repair -----------------------------------------------------------------

def well_formed(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def search(rows):
    """Cheapest edits, ASCII-least, by Dijkstra over (row, initials seen so far): rows are (role, text, gone, cut)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in step[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, out + ((name, ""),)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if not gone:
                if role[:1] in step[last]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], out + ((role, text),)))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in step[last]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, c, out + ((name, text),)))


def repaired(rows):
    """(turn, role, text) in order -> the columns of the contract."""
    seen, marked, counts = set(), [], Counter()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:]))
    cost, audit, out = search(marked)
    assert well_formed("".join(r[:1] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def damaged(rows):
    """(conv_id, turn, role, text) -> {conv_id: [(turn, role, text)] in order}."""
    def as_text(x):
        return " " if x is None else str(x)
    out = {}
    for c, t, role, text in rows:
        kept = out.setdefault(c, [])
        k = zlib.crc32(f"{as_text(c)}:{as_text(t)}".encode()) % 20
        role, text = as_text(role), as_text(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        kept.extend([(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def check(got, conversations):
    assert len(got) == len(conversations)
    for r in got:
        assert tuple(r)[1:] == repaired(conversations[r.conv_id]), r.conv_id


def test_walk_is_the_cheapest_least():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool"]
    for _ in range(400):
        n = rng.randrange(0, 12)
        rows = [(rng.choice(roles), "t", rng.random() < 0.2, 0) for _ in range(n)]
        rows = [(r, t, g, int(not g and rng.random() < 0.3)) for r, t, g, _ in rows]
        codes = bytes("suat".index(r[0]) + 4 * g + 8 * c for r, _, g, c in rows)
        cost, audit, _ = search(rows)
        assert (repair.vector(codes, repair.END)[0], repair.walk(codes, repair.END, [0], True)[0][0]) == (cost, audit)
        cut = rng.randrange(0, n + 1)
        a, b = codes[:cut], codes[cut:]
        v, m = repair.vector(b, repair.END), repair.matrix(a)
        assert min(m[0][e] + v[e] for e in range(4)) == cost
        head, s = repair.walk(a, v, [0, 1, 2, 3], False)[0]
        assert head + repair.walk(b, repair.END, [s], True)[0][0] == audit


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_repair"](spark, SMALL).collect()
    check(got, damaged(rows))


ODD = [(1, None, "user", "hello."), (1, 0, None, None), (1, 1, "assistant", "  \n"), (1, 5, "bot", "x" * 50000),
       (2, 3, "system", "s."), (2, 4, "system", "s."), (2, 9, "user", "q? \t"), (None, 1, "user", "a b."), (None, 2, None, "c"),
       (3, None, None, None), (4, None, "user", "é ünï."), (5, 1, "", "leer."), (5, 2, "assistant", "")]


def test_repair_odd_rows_and_spanning_conversations(spark):
    rng = random.Random(5)
    rows = list(ODD)
    # one conversation with most of the rows spans all partitions
    for t in range(3000):
        rows.append((77, t * 2, rng.choice(["user", "assistant", "assistant", "user", "system", "x"]), rng.choice(["ok.", "fine!", "cut", "", f"line {t}.", f"q {t}?"])))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, key string, strand long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = repair._marked(queries.damaged(df))
        assert marked.where(F.col("key").contains("77")).select("strand").distinct().count() > 2
        got = repair.repair(queries.damaged(df), df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(got, damaged(rows))
    turns = repair.repaired(queries.damaged(df)).where(F.col("key").contains("77")).orderBy("strand", "seq").collect()
    assert well_formed("".join(r.role[0] for r in turns))


def test_repair_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(queries.damaged(none), none).count() == 0 and repair.repaired(none).count() == 0


# --- 13, spelling variants -------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(count, ratio=10):
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root))
    return out


def word_counts(docs, every=31):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_query(spark, small_rows):
    rows = small_rows[:]
    got = queries.QUERIES["op13_spelling_variants"](spark, SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    count = word_counts(rows)
    found = rows_of(got)
    assert found == variants(count) and len(found) == got.count()
    assert sum(r[3] is not None for r in found) > 5


@pytest.mark.parametrize("block", [4, 1024])
def test_spelling_random_words(spark, monkeypatch, block):
    """Many near words, splits into blocks, chains of forms."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    count = {}
    for _ in range(60):
        base = "".join(rng.choice("abÿé") for _ in range(rng.choice([7, 8, 9, 12])))
        count[base] = rng.choice([2, 3, 5000, 100000])
        for _ in range(6):
            p = rng.randrange(len(base))
            v = rng.choice([base[:p] + base[p + 1:], base[:p] + "a" + base[p:], base[:p] + "b" + base[p + 1:]])
            if len(v) >= 7:
                count.setdefault(v, rng.choice([2, 3, 30, 400]))
    for w in ("aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababa", "bababab"):
        count[w] = 7
    vocab = spark.createDataFrame(sorted(count.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.forms(vocab)) == variants(count)
    pairs = spelling.near_pairs(vocab).collect()
    assert len({frozenset((r.a, r.b)) for r in pairs}) == len(pairs)


def test_spelling_odd_rows(spark, odd, odd_rows, empty):
    words = spelling.vocabulary(queries.mistyped(), spelling.runs(odd))
    assert rows_of(spelling.forms(words)) == variants(word_counts([(r[0], r[1]) for r in odd_rows]))
    assert spelling.forms(spelling.vocabulary(queries.mistyped(), spelling.runs(empty))).count() == 0
    long = "x" * 30000
    vocab = spark.createDataFrame([(long, 100), (long + "y", 5), (long[:-1] + "yx", 3), ("kürzere", 2)], "word string, n long")
    assert rows_of(spelling.forms(vocab)) == variants({long: 100, long + "y": 5, long[:-1] + "yx": 3, "kürzere": 2})
