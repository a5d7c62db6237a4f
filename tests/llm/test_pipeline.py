"""The pipeline against its stages' brute-force versions, and its registration."""

import hashlib

import public_tokenizers
import sentencepiece

import __spark_entry__
import corpus_pipeline

from llm_fixtures import SMALL, empty, odd, odd_rows, small, small_rows  # noqa: F401
from test_decontaminate import brute
from test_dedup import component_ids, fingerprint, normal


def test_registered():
    names = __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert "op3_exact_dedup" in __spark_entry__.oracle_sql()


def test_whole_pipeline(spark):
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SMALL).collect()
    # language ID keeps every document with letters here
    rows = [(d.doc_id, d.text) for d in docs if any(c.isalpha() for c in d.text or "")]
    first = {}
    for i, t in rows:
        first.setdefault(normal(t), i)
    rows = [(i, t) for i, t in rows if first[normal(t)] == i]
    comp = component_ids([i for i, _ in rows], [fingerprint(t) for _, t in rows])
    rows = [(i, t) for (i, t), c in zip(rows, comp) if c == i]
    bad = {i for i, n, hit, _ in brute(rows, items) if hit and 20 * hit >= n}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: lib.encode(t) for i, t in rows if i not in bad}
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
               for r in got)


def test_stages_on_odd_rows(spark, odd, odd_rows, tmp_path):
    """Each stage takes what its predecessor wrote; all but the last keep the columns."""
    df = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, SMALL).write.parquet(path := str(tmp_path / str(k)))
        df = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert df.columns == odd.columns
    assert 0 < df.count() < len(odd_rows)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SMALL).count() == 0
