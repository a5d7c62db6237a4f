"""What the language and toxicity models learn from."""

import random

import numpy as np

from centime.llm import language_id, toxicity


def test_copies_do_not_fill_the_language_sample(spark):
    """100,000 rows of three texts in three languages, six times."""
    for k in range(6):
        rng = random.Random(k)
        texts = [(lang, "".join(rng.choice("abcdefgh äöüéè") for _ in range(400))) for lang in ("de", "en", "fr")]
        df = spark.range(100_000).selectExpr("id % 3 as i").join(
            spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, lang string, text string"), "i")
        rows = language_id._sample(df.selectExpr("lang", "xxhash64(text) as h", "text"), 4000).collect()
        assert sorted((r.lang, r.text) for r in rows) == sorted(texts)


def test_language_sample_is_alike_many_of_each(spark):
    df = spark.range(20_000).selectExpr("if(id % 100 = 0, 'few', 'many') as lang", "xxhash64(id) as h", "id")
    n = {r["lang"]: r["count"] for r in language_id._sample(df, 100).groupBy("lang").count().collect()}
    assert n == {"few": 50, "many": 50}
    assert language_id._sample(df.where("false"), 100).count() == 0


def test_labels_in_two_ways_do_not_depend_on_the_order(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with words") for i in range(60)], "doc_id long, text string")
    both = [(i, k) for i in range(60) for k in (0, 1)]
    biases = set()
    for rows in (both, both[::-1]):
        m = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int").coalesce(1))
        biases.add(float(m.bias))
    assert biases == {np.inf}  # all count as toxic
