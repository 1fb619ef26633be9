"""Co-training takes part in all unlabelled documents."""

import random

from pyspark.sql import functions as F

from quillstone.llm import cotrain

R = random.Random(3)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_words_of_a_few_unlabelled_documents_reach_the_text_view(spark):
    word = lambda: f"w{R.randint(0, 60)}"
    rows, labels = [], []
    for i in range(3000):  # labelled: the source tells
        poor = i % 5 == 0
        rows.append((i, " ".join(word() for _ in range(8)), "en", "bad" if poor else "good", 100))
        labels.append((i, int(not poor), 0))
    # Unlabelled: a word of its own in 120 of 9,000, those with the greatest hashes, all from the poor source.
    order = [r[0] for r in spark.range(3000, 12_000).orderBy(F.xxhash64("id")).collect()]
    rare = set(order[-120:])
    for i in order:
        rows.append((i, " ".join([word() for _ in range(8)] + ["zyx"] * (i in rare)), "en", "bad" if i in rare or i % 5 == 1 else "good", 100))
    docs = spark.createDataFrame([*rows, (-1, "w1 zyx", None, None, None), (-2, "w1 w2", None, None, None)], SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in cotrain.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id < 0").collect()}
    assert got[-1]["poor_text"] > got[-2]["poor_text"] + 1
