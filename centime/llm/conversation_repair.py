"""Operator 12, conversation structure repair by a square-root checkpointed DP.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn, or nothing at all.
Edits per row: Keep 0, Rerole to user or assistant 2, Delete 3, and before any
row or at the end Insert of an empty user or assistant turn 2.  Blank rows and
repeats of an earlier (role, text) must go; a truncated row that stays costs 1
more.  Of the cheapest edit sequences the one whose initials (D, I, K, R) are
ASCII-least is taken; initials and rows fix the repaired conversation.

A conversation may hold a third of all rows, so it is never gathered.  All rows
are sorted together by conversation and turn over range partitions; the rows
of a conversation in one partition are a *strand*, and one byte of each row
(role initial, must go, truncated) is all that the edit search reads.

1. Strands of conversations that span partitions give their min-plus matrix
   (cost from each entry state to each exit state); the matrices of one
   conversation, at most one a partition, give the cost vector at the end of
   every strand: these are the outer checkpoints.
2. Inside a strand cost vectors are computed backward and kept only at every
   sqrt(n)-th row.  Walking forward, one block of vectors at a time is computed
   anew and the least tight edit is emitted, from each entry state.
3. Entry states are chained over a conversation's strands, and each strand's
   walk from its entry state is taken.

Rows then meet their strand's edits in a stream, and the digest of a repaired
conversation is fed row by row, so a task holds one strand's edits and one
batch of rows.  (The audit of a conversation is one cell by contract, and its
digest is read by one task, row after row, since SHA-256 has no other way.)

Defined results: null role or text counts as one space, a null conversation id
is a conversation like any other, null turns come first; rows of one turn are
ordered by a digest of role and text, equal rows stay adjacent; a role whose
initial is none of s, u, a is legal nowhere and is reroled or deleted;
conversations without rows (see ``ids``) get zeros, an empty audit and the
digest of nothing; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\x0b\x0c\r"
ROLE, GONE, CUT = 3, 4, 8  # bits of a row's byte: initial (s, u, a, other), must go, truncated
INITIALS = "sua"
NEXT = (2, 2, 3, 2)  # what an inserted or reroled turn leads to: start, after s, after u, after a
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)  # by initial and state
NAMES = {2: "user", 3: "assistant"}
END = (0, 4, 2, 0)  # cost of coming to an end
REROLE, DELETE, INSERT = 2, 3, 2


# --- the edit search on one strand's bytes --------------------------------------------------

def _least(code: int, after: tuple, s: int):
    cost = DELETE + after[s]
    if not code & GONE:
        more = 1 if code & CUT else 0
        kept = KEEP[code & ROLE][s]
        if kept is not None:
            cost = min(cost, after[kept] + more)
        cost = min(cost, REROLE + after[NEXT[s]] + more)
    return cost


@lru_cache(1 << 14)
def _back(code: int, after: tuple) -> tuple:
    """Cost vector before a row from the one behind it; insertions before the row count."""
    w = [_least(code, after, s) for s in range(4)]
    return tuple(min(w[s], INSERT + w[NEXT[s]], 2 * INSERT + w[NEXT[NEXT[s]]]) for s in range(4))


def _before(code: int, base: int, after: tuple) -> tuple[int, tuple]:
    """``_back`` on vectors as (least value, rest): few different ones occur."""
    v = _back(code, after)
    low = min(v)
    return base + low, tuple(x - low for x in v)


def vector(codes: bytes, end: tuple) -> tuple:
    """Cost vector at the start of a strand."""
    base, v = 0, end
    for code in reversed(codes):
        base, v = _before(code, base, v)
    return tuple(x + base for x in v)


def matrix(codes: bytes) -> list[list[float]]:
    """[entry state][exit state]: least cost through a strand."""
    columns = [vector(codes, tuple(0 if s == e else math.inf for s in range(4))) for e in range(4)]
    return [list(row) for row in zip(*columns)]


@lru_cache(1 << 14)
def _edit(code: int, here: tuple, after: tuple, lift: int, s: int) -> tuple[str, int]:
    """The ASCII-least tight edits of a row from a state, and the state behind them."""
    done = ""
    while True:
        if here[s] == DELETE + after[s] + lift:
            return done + "D", s
        if here[s] == INSERT + here[NEXT[s]]:
            done, s = done + "I", NEXT[s]
            continue
        more = lift + (1 if code & CUT else 0)
        kept = KEEP[code & ROLE][s]
        if kept is not None and here[s] == after[kept] + more:
            return done + "K", kept
        return done + "R", NEXT[s]


def walk(codes: bytes, end: tuple, starts: list[int], last: bool) -> list[tuple[str, int]]:
    """(edits, exit state) from each entry state.  Vectors are kept at every
    sqrt(n)-th row and computed anew a block at a time."""
    n = len(codes)
    step = math.isqrt(n) + 1
    marks, base, v = {}, 0, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i // step] = base, v
        base, v = _before(codes[i], base, v)
    out, states = [[] for _ in starts], list(starts)
    for block in range(0, (n + step - 1) // step):
        rows = range(block * step, min(n, (block + 1) * step))
        behind = [marks[block]]
        for i in reversed(rows):
            behind.append(_before(codes[i], *behind[-1]))
        behind.reverse()
        for k, i in enumerate(rows):
            (b0, here), (b1, after) = behind[k], behind[k + 1]
            for t in range(len(states)):
                done, states[t] = _edit(codes[i], here, after, b1 - b0, states[t])
                out[t].append(done)
    if last:
        for t, s in enumerate(states):
            while s not in (0, 3):
                out[t].append("I")
                s = NEXT[s]
            states[t] = s
    return [("".join(x), s) for x, s in zip(out, states)]


def illegal_pairs(codes: bytes) -> int:
    c = np.frombuffer(codes, np.uint8) & ROLE
    a, b = c[:-1], c[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


# --- rows, strands, chains -------------------------------------------------------------------

def _key(*cols: str):
    """Equal for equal values, nulls included, never null."""
    return F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)]))


def _marked(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, strand, place, blank, duplicate, truncated, code), written in order."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"))
    r = r.select(_key("conv_id").alias("key"), "turn", "role", "text", F.monotonically_increasing_id().alias("uid"),
                 F.unhex(F.sha2(_key("conv_id", "role", "text"), 256)).alias("said"))
    r = written(r, "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    again = r.groupBy("said").agg(F.count("*").alias("times"), F.min(at).alias("first")).where("times > 1").select("said", "first.uid")
    again = written(again.withColumnRenamed("uid", "first_uid"), "repair-repeats")
    body = F.rtrim("text", F.lit(SPACE))
    blank = body == ""
    again = r.join(again, "said", "left")
    repeat = ~blank & (F.col("first_uid") != F.col("uid"))
    cut = ~F.right(body, F.lit(1)).isin(".", "!", "?")
    faults = again.select("key", "turn", "role", "text", "said", "uid", blank.alias("blank"), F.coalesce(repeat, F.lit(False)).alias("duplicate"), cut.alias("cut"))
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    gone = F.col("blank") | F.col("duplicate")
    coded = faults.withColumn("truncated", ~gone & F.col("cut")).drop("cut").withColumn(
        "code", (role + F.when(gone, GONE).otherwise(0) + F.when(F.col("truncated"), CUT).otherwise(0)).cast("tinyint"))
    order = ["key", "turn", "said", "uid"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(dealt.drop("said", "uid").withColumn("strand", F.shiftright("place", 33)), "repair-sorted")


def _arrow(fn, names):
    """mapInArrow over rows as dictionaries."""
    def run(batches):
        for batch in batches:
            out = [fn(row) for row in batch.to_pylist()]
            if out:
                yield pa.RecordBatch.from_pydict({n: [o[k] for o in out] for k, n in enumerate(names)})
    return run


def _codes(row: dict) -> bytes:
    return bytes(row["codes"])


def _strand_matrix(row):
    codes = _codes(row)
    flat = [x for line in matrix(codes) for x in line]
    return row["key"], row["strand"], [float(x) for x in flat], codes[0] & ROLE, codes[-1] & ROLE


def _chain_costs(df: pd.DataFrame) -> pd.DataFrame:
    """Cost vectors at the end of each strand of one conversation, and illegal seams before it."""
    df = df.sort_values("strand")
    v, ends = END, []
    for m in reversed(df["matrix"].tolist()):
        ends.append([float(x) for x in v])
        v = tuple(min(m[4 * s + e] + v[e] for e in range(4)) for s in range(4))
    seams, tail = [], None
    for a, b in zip(df["head"], df["tail"]):
        seams.append(0 if tail is None or (tail, a) in ((0, 1), (1, 2), (2, 1)) else 1)
        tail = b
    return pd.DataFrame({"key": df["key"], "strand": df["strand"], "ends": ends[::-1], "seam": seams,
                         "last": [False] * (len(df) - 1) + [True]})


def _strand_walk(row):
    codes, whole = _codes(row), row["ends"] is None
    end = END if whole else tuple(math.inf if math.isinf(x) else int(x) for x in row["ends"])
    walks = walk(codes, end, [0] if whole else [0, 1, 2, 3], whole or row["last"])
    cost = vector(codes, end)
    return (row["key"], row["strand"], [a for a, _ in walks], [s for _, s in walks], int(cost[0]),
            illegal_pairs(codes) + (0 if whole else row["seam"]))


def _chain_states(df: pd.DataFrame) -> pd.DataFrame:
    df, s, entry = df.sort_values("strand"), 0, []
    for exits in df["exits"].tolist():
        entry.append(s)
        s = int(exits[s])
    return pd.DataFrame({"key": df["key"], "strand": df["strand"], "entry": entry})


def _edits(marked: DataFrame) -> DataFrame:
    """(key, strand, entry, audit, cost, illegal), written: the edits of every strand; cost is that from the first row on."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "code")))
    strands = marked.groupBy("key", "strand").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))
    strands = written(strands, "repair-strands")
    spanning = strands.groupBy("key").count().where("count > 1").select("key")
    parts = strands.join(spanning, "key", "left_semi").mapInArrow(
        _arrow(_strand_matrix, ["key", "strand", "matrix", "head", "tail"]),
        "key string, strand long, matrix array<double>, head long, tail long")
    ends = written(parts.groupBy("key").applyInPandas(
        _chain_costs, "key string, strand long, ends array<double>, seam long, last boolean"), "repair-ends")
    walked = strands.join(ends, ["key", "strand"], "left").select("key", "strand", "codes", "ends", "seam", "last").mapInArrow(
        _arrow(_strand_walk, ["key", "strand", "audits", "exits", "cost", "illegal"]),
        "key string, strand long, audits array<string>, exits array<long>, cost long, illegal long")
    walked = written(walked, "repair-walks")
    entries = walked.where("size(exits) > 1").select("key", "strand", "exits").groupBy("key").applyInPandas(
        _chain_states, "key string, strand long, entry long")
    e = walked.join(entries, ["key", "strand"], "left").withColumn("entry", F.coalesce(F.col("entry").cast("int"), F.lit(0)))
    return written(e.select("key", "strand", "entry", F.expr("audits[entry]").alias("audit"), "cost", "illegal"), "repair-edits")


def _apply(batches):
    """Rows of strands in order, each strand led by a row with its edits; yields the repaired turns."""
    names = ["key", "strand", "seq", "role", "text", "edit"]
    key = audit = None
    at = state = seq = 0
    for batch in batches:
        out = []

        def inserted(key, strand):
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out.append((key, strand, seq, NAMES[state], "", "I"))
                at, seq = at + 1, seq + 1

        for r in batch.to_pylist():
            if r["edits"] is not None:
                key, audit, state, at, seq = (r["key"], r["strand"]), r["edits"], r["entry"], 0, 0
                continue
            inserted(*key)
            edit, at = audit[at], at + 1
            if edit == "D":
                pass
            elif edit == "K":
                state = KEEP[r["code"] & ROLE][state]
                out.append((*key, seq, r["role"], r["text"], "K"))
            else:
                state = NEXT[state]
                out.append((*key, seq, NAMES[state], r["text"], "R"))
            seq += 1
            if len(audit) - at <= 2 and not audit[at:].strip("I"):  # what follows the last row
                inserted(*key)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names)


def _turns(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, strand, seq, role, text, edit): the repaired turns in order of strand and seq."""
    none = F.lit(None)
    rows = marked.select("key", "strand", "place", "role", "text", F.col("code").cast("int").alias("code"),
                         none.cast("string").alias("edits"), none.cast("int").alias("entry"))
    lead = edits.select("key", "strand", F.lit(-1).cast("long").alias("place"), none.cast("string").alias("role"),
                        none.cast("string").alias("text"), none.cast("int").alias("code"), F.col("audit").alias("edits"), "entry")
    both = rows.unionByName(lead).repartition("key", "strand").sortWithinPartitions("key", "strand", "place")
    return both.mapInArrow(_apply, "key string, strand long, seq long, role string, text string, edit string")


def _digests(batches):
    key = h = None
    for batch in batches:
        out = []
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
            if k != key:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(role.encode())
            h.update(b":")
            h.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "digest"])


def repaired(rows: DataFrame) -> DataFrame:
    """(conversation key as JSON, strand, seq, role, text, edit): the turns of the
    repaired conversations, in order of (strand, seq); edit is K, R or I."""
    marked = _marked(rows)
    return _turns(marked, _edits(marked))


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    marked = _marked(rows)
    edits = _edits(marked)
    counts = marked.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    lists = F.array_sort(F.collect_list(F.struct("strand", "audit", "cost")))
    audits = edits.groupBy("key").agg(F.sum("illegal").alias("illegal"), lists.alias("parts")).select(
        "key", "illegal", F.col("parts")[0]["cost"].alias("cost"), F.array_join(F.col("parts.audit"), "").alias("audit"))
    turns = _turns(marked, edits).select("key", "strand", "seq", "role", "text")
    digests = turns.repartition("key").sortWithinPartitions("key", "strand", "seq").mapInArrow(_digests, "key string, digest string")
    names = rows.select("conv_id") if ids is None else ids.select("conv_id")
    all_ids = names.distinct().withColumn("key", _key("conv_id"))
    out = all_ids.join(counts, "key", "left").join(audits, "key", "left").join(digests, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("digest"))
