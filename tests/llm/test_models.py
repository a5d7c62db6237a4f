"""Operators 1, 8 and 10: held-out accuracy, gradients, brute-force counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from centime.llm import language_id, lm_scoring, queries, toxicity
from pyspark.sql import functions as F

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401

SF = "/root/testdata/sf0.01"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language_id.train([b"abc", b"xyz"] * 3, ["p", "q"] * 3, steps=2)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes, label, length = rng.integers(0, 256, (7, 3)).astype(np.uint8), np.array([0, 1, 0]), np.array([7, 4, 2])
    grad, _ = language_id._step(w, codes, label, length)
    for k in ("fuz", "bur", "fun", "bbn", "of", "o"):
        at = tuple(0 for _ in w[k].shape)
        loss = []
        for d in (1e-3, -1e-3):
            w[k][at] += d
            loss.append(language_id._step(w, codes, label, length)[1])
            w[k][at] -= d
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[k][at]) < 1e-3


def test_language_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_odd_rows(spark, odd, odd_rows, empty):
    net = language_id.fit(odd)
    got = language_id.predict(odd, net, F.struct("*")).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.id.text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, none, F.col("doc_id")).collect()} == {"und"}
    assert language_id.predict(empty, net, F.col("doc_id")).count() == 0


def test_prediction_of_a_text_is_that_of_its_segments():
    net = language_id.train([b"hello there", b"bonjour madame"] * 8, ["en", "fr"] * 8, steps=5)
    text = b"hello there bonjour " * 40
    p = language_id.document_probabilities(net, [b"", text, b"x"])
    parts = [text[a:a + language_id.SEGMENT] for a in range(0, len(text), language_id.SEGMENT)]
    each = sum(language_id.position_probabilities(net.weights, np.frombuffer(s, np.uint8)[:, None], np.array([len(s)]))[:, 0].sum(axis=0) for s in parts)
    assert np.allclose(p[1], each / len(text), atol=1e-5) and (p[0] == 0).all()


def test_toxicity_query_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    pos = [r.score for r in held if truth[r.doc_id] == 1]
    neg = [r.score for r in held if truth[r.doc_id] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.93 and np.mean([n >= 0.5 for n in neg]) < 0.02 and np.mean([p >= 0.5 for p in pos]) > 0.8


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


@pytest.mark.parametrize("written,word", [("1d10t", "idiot"), ("idioooot", "idiot"), ("l0ser", "loser"), ("5tup1d", "stupid"),
                                          ("p4th3t1c", "pathetic"), ("tra$h", "trash"), ("worthless", "worthless"), ("the", "the")])
def test_restoring(toxic_model, written, word):
    assert toxic_model.restored([written.encode()]) == [word.encode()]


def test_viterbi_is_the_best_of_all_paths(toxic_model):
    """Every choice of letters and repetitions, scored one by one."""
    def best(word):
        def kind(c):
            return int(toxicity.CLASS[ord(c)]) if ord(c) < 128 else 27 + ord(c) % (toxicity.LETTERS - 27)

        found = []

        def walk(i, out, last, s):
            if i == len(word):
                found.append((s + toxic_model.pairs[kind(last), 0], out))
                return
            c = word[i]
            look = toxicity.LOOKALIKES.get(c, "")
            options = [(c, 0.0 if not look else np.log(0.05))] if not look or c.isalnum() else []
            for x, g in options + [(x, toxicity.LOOK_COST - np.log(len(look))) for x in look]:
                walk(i + 1, out + x, x, s + g + toxic_model.pairs[kind(last) if last else 0, kind(x)])
                if x == last:
                    walk(i + 1, out, x, s + toxicity.REPEAT_COST)

        walk(0, "", "", 0.0)
        return max(found)

    for w in ["1d10t", "aab", "l00se", "h3llo", "ss1", "a1b1", "eéé"]:
        top = best(w)
        got = toxic_model.restore([w])[0]
        assert got == top[1] or any(abs(top[0] - s) < 1e-9 for s, o in [best(w)] if o == got)


def test_obfuscated_texts_score_like_plain_ones(spark, toxic_model):
    texts = ["and the stupid idiot was", "and the 5tup1d 1d10t was", "and the s t u p i d i d i o t was", "and the stuuupid idioooot was",
             "and the s.t.u.p.i.d idiot was", "and the other one was", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(df, toxic_model).orderBy("id").collect()]
    assert all(s > 0.5 for s in got[:5]) and all(s < 0.2 for s in got[5:])


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(odd, labels.where("false"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels).bias == -np.inf


def unigram(rows):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for (i, _), ws in zip(rows, words):
        yield i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)


def test_lm_query_whole_table(spark, small_rows):
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, SMALL).collect()}
    for i, n, known, total, base in unigram(small_rows):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_lm_beats_the_unigrams_on_held_out_texts(spark):
    got = [r for r in queries.op10_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in got) > 0.88 * sum(r.base_score for r in got)


def test_lm_odd_rows(odd, odd_rows, empty):
    learn = queries.seen(F.col("doc_id"), 10, 0)
    got = lm_scoring.score(odd, learn).collect()
    want = list(unigram([(r[0], r[1]) for r in odd_rows]))
    key = lambda x: (str(x[0]), x[1], x[2])
    for g, w in zip(sorted(((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4])
    assert lm_scoring.score(empty, learn).count() == 0
    assert all(r.score == r.base_score == 0 for r in lm_scoring.score(odd, F.lit(False)).collect())


def suffix_tree_scores(rows, learn):
    """The model by plain dictionaries: every context that occurs often enough is judged, none is left out by a bound."""
    docs = [["<"] + re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) + [">"] for _, t in rows]
    uni = Counter(w for d, m in zip(docs, learn) if m for w in d[1:])
    n, v = sum(uni.values()), len(uni)
    force = {(k, t): (uni[d[t]] + 0.1) / (n + 0.1 * (v + 1)) for k, d in enumerate(docs) for t in range(1, len(d))}
    ask, depth = list(force), 1
    while ask:
        ask = [(k, t) for k, t in ask if t >= depth]
        where, next_to = {}, {}
        for k, t in ask:
            c = tuple(docs[k][t - depth:t])
            where[k, t] = c
            next_to.setdefault(c, Counter())[docs[k][t]] += learn[k]
        known = {(where[at], docs[at[0]][at[1]]): force[at] for at in ask}
        own = {}
        for c, follow in next_to.items():
            total, kinds = sum(follow.values()), sum(x > 0 for x in follow.values())
            p = {w: (x + kinds * known[c, w]) / max(total + kinds, 1) for w, x in follow.items()}
            gain = sum(x * math.log2(p[w] / known[c, w]) for w, x in follow.items() if x)
            if total >= lm_scoring.LEAST and gain >= lm_scoring.GAIN:
                own[c] = p
        for at in ask:
            if where[at] in own:
                force[at] = own[where[at]][docs[at[0]][at[1]]]
        ask = [at for at in ask if sum(next_to[where[at]].values()) >= lm_scoring.LEAST]
        depth += 1
    out = [0.0] * len(docs)
    for (k, _), p in force.items():
        out[k] += math.log10(p)
    return out, depth


def check_tree(rows, learn, got):
    want, depth = suffix_tree_scores(rows, learn)
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want):
        assert got[i] == pytest.approx(w, rel=2e-4)
    return depth


def test_lm_score_is_that_of_a_plain_suffix_tree(spark, small_rows):
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in small_rows]
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, SMALL).collect()}
    check_tree(small_rows, learn, {i: r.score for i, r in got.items()})
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_near_copies_and_long_contexts(spark):
    """Near copies with one changed word each, and an end that depends on a word eight words back:
    the contexts between do not diverge."""
    body = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(body[:i % 40] + [f"x{i % 7}"] + body[i % 40 + 1:])) for i in range(120)]
    rows += [(200 + i, f"{'red' if i % 2 else 'blue'} one two three four five six seven {'stop' if i % 2 else 'go'}") for i in range(200)]
    rows += [(1000, "red one two three four five six seven stop"), (1001, "red one two three four five six seven go"), (1002, "new words")]
    learn = [i < 1000 for i, _ in rows]
    report = []
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.score for r in lm_scoring.score(df, F.col("doc_id") < 1000, report=report).collect()}
    assert check_tree(rows, learn, got) > 30
    assert got[1000] > got[1001] + 1
    assert [r[1] for r in report[:5]] == [1, 1, 1, 4, 8] and sum(r[2] for r in report if r[0] >= 8) > 0


def test_lm_levels_a_round_do_not_change_the_score(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c"], p=[0.8, 0.15, 0.05], size=60)) for _ in range(40)]
    rows = list(enumerate(texts + texts[:5] + ["", None]))
    learn = [i % 9 != 0 for i, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.score for r in lm_scoring.score(df, F.col("doc_id") % 9 != 0).collect()}
    check_tree(rows, learn, got)


def test_context_names_depend_on_the_tokens_alone():
    rng = np.random.default_rng(2)
    stream = rng.integers(1, 6, 4000).astype(np.uint64) * np.uint64(0x1234567890ABCDEF)
    names, seen = lm_scoring.ContextNames(stream), {}
    for n in (1, 2, 3, 7):
        at = np.arange(n, len(stream) + 1)
        for i, h in zip(at.tolist(), names(at, n).tolist()):
            assert seen.setdefault(h, tuple(stream[i - n:i].tolist())) == tuple(stream[i - n:i].tolist())
    assert len({v for v in seen.values()}) == len(seen)


def test_lm_judges_a_context_by_its_whole_distribution():
    rng = np.random.default_rng(1)
    q, count = rng.dirichlet(np.ones(256))[[3, 7, 9, 200]], np.array([20, 5, 0, 1])
    log, stays, on = lm_scoring.judge(np.zeros(4, np.int64), count, q, np.ones(4, bool))
    p = (count + 3 * q) / (26 + 3)
    gain = sum(c * math.log2(a / b) for c, a, b in zip(count, p, q) if c)
    left = -sum(c * math.log2(a) for c, a in zip(count, p))
    assert stays[0] and gain >= lm_scoring.GAIN and on[0] == (left >= lm_scoring.GAIN) and np.allclose(10.0 ** log, p, rtol=1e-4)
    assert lm_scoring.judge(np.zeros(4, np.int64), 4 * count, q, np.ones(4, bool))[2][0]
    log, stays, on = lm_scoring.judge(np.zeros(4, np.int64), count // 4, q, np.ones(4, bool))  # too rare
    assert not stays[0] and not on[0] and np.allclose(10.0 ** log, q, rtol=1e-4)
    assert not lm_scoring.judge(np.zeros(1, np.int64), np.array([10 ** 6]), np.ones(1), np.ones(1, bool))[1][0]  # nothing new


def test_lm_ends_where_no_longer_context_could_gain():
    """No context is left out of which a longer one could stay; one that costs much and can't be told apart is."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        kinds = int(rng.integers(1, 6))
        count = rng.integers(1, 60, kinds)
        q = np.log10(rng.dirichlet(np.ones(kinds + 1))[:kinds] + 1e-9)
        on = lm_scoring.worth(np.zeros(kinds, np.int64), count, q, np.ones(1, bool))[0]
        for _ in range(30):
            m = rng.integers(0, count + 1) * (rng.random(kinds) < 0.6)
            seen = m > 0
            p = (m + seen.sum() * 10.0 ** q) / max(1, m.sum() + seen.sum())
            gain = float((m[seen] * (np.log2(p[seen]) - q[seen] / np.log10(2))).sum())
            assert on or m.sum() < lm_scoring.LEAST or gain < lm_scoring.GAIN
    count, q = np.full(8, 4), np.log10(np.full(8, 1 / 8))  # 96 bits, of which 32 occurrences tell none apart
    assert (-count * q).sum() / np.log10(2) > lm_scoring.GAIN
    assert not lm_scoring.worth(np.zeros(8, np.int64), count, q, np.ones(1, bool))[0]


def test_lm_asks_for_no_context_around_a_rare_string():
    """Levels end with the longest context that may be frequent, and only its tokens travel."""
    b = lm_scoring.Block()
    b.number, b.ids, b.learn = 0, np.array([1, 2]), np.array([True, True])
    b.place(*lm_scoring.token_stream(np.arange(10, 30, dtype=np.uint64), np.array([12, 8])), np.arange(2))
    b.start = b.begin[b.of]
    b.rare(np.array([5]), 1)  # the token before it and itself: no context holds both
    assert b.start[4] == 0 and b.start[5] == b.start[9] == 5 and b.start[14] == 14
    b.asking = np.zeros(len(b.stream), bool)
    b.asking[[9, 20]] = True
    b.tokens = b.known = np.zeros(2, np.int64)
    b.base, b.sums, b.log = np.zeros(2), np.zeros(2), np.zeros(2, np.float32)
    stream = b.stream.copy()
    rows = b.ask(4, 4096, 1).to_pylist()
    assert b.stream.tolist() == [*stream[5:10], *stream[14:21]] and b.docs.tolist() == [0, 1] and b.start.tolist() == [0] * 5 + [5] * 7
    sizes, *_, count, _ = lm_scoring.unpack(rows[1]["parts"], np.int64, *[np.uint32] * 5)
    assert sizes.tolist() == [2, 1, 1] and count.tolist() == [1] * 4


def test_lm_rounds_of_several_levels_send_and_answer_what_is_needed(spark):
    """Below a trie's first level a pair is the one above it and a word, and only a place's longest pair is answered."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text if i % 2 else "x " + text) for i in range(60)]
    b = lm_scoring.Block()
    b.number, b.ids, b.learn = 0, np.arange(60), np.ones(60, bool)
    words = {w: k for k, w in enumerate(["x", *text.split()])}
    codes = [np.array([words[w] for w in t.split()]) for _, t in rows]
    key = lm_scoring.mix64(np.arange(1, 32, dtype=np.uint64))
    b.place(*lm_scoring.token_stream(key[np.concatenate(codes)], np.array([len(c) for c in codes])), np.arange(60))
    b.start = b.begin[b.of]
    b.asking = np.zeros(len(b.stream), bool)
    b.asking[b.begin + 20] = True
    b.tokens = b.known = np.zeros(60, np.int64)
    b.base, b.sums, b.log = np.zeros(60), np.zeros(60), np.full(60, -1, np.float32)
    sent = b.ask(4, 8, 1)
    sizes, name, lo, pair, count, up, end = lm_scoring.unpack(sent.to_pylist()[1]["parts"], np.int64, *[np.uint32] * 5, np.uint8)
    assert sizes.tolist() == [2] * 8 and len(name) == len(count) == len(up) == 16 and len(lo) == len(pair) == 2
    assert count.tolist() == [30] * 16 and np.unpackbits(end, count=16).tolist() == [0] * 14 + [1] * 2
    got = lm_scoring.answers(spark.createDataFrame(sent.to_pandas(), lm_scoring.ROWS)).where("bucket >= 0").collect()[0]
    log, _, often = lm_scoring.unpack(got.parts, np.float32, np.uint8, np.uint8)
    assert (log[:14] == 0).all() and (log[14:] < 0).all() and np.unpackbits(often, count=16).tolist() == [0] * 14 + [1] * 2


def test_lm_hashes_travel_as_steps():
    """The high bytes of ascending hashes take no room."""
    key = np.sort(lm_scoring.mix64(np.arange(100000, dtype=np.uint64)))
    assert (np.cumsum(lm_scoring.steps(key), dtype=np.uint64) == key).all()
    packed = lm_scoring.pack(lm_scoring.steps(key))
    assert sum(map(len, packed)) < 0.85 * key.nbytes and (lm_scoring.block_keys({"keys": packed}) == key).all()
