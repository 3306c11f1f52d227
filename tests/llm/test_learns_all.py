"""A fit learns from every labelled document, not from those of its sample alone."""

import numpy as np
import pyarrow as pa

from loamgrid.llm import _common as c
from loamgrid.llm import toxicity


def test_words_beyond_the_sample_are_learnt(spark):
    rows = [(k, "en", f"plain talk of day {k % 7} and weather " + ("vile rude words here" if k % 2 else "calm kind words here")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    sample = {r["doc_id"] for r in c.labelled_sample(docs, labels, "toxic", 30)[0].collect()}
    assert len(sample) == 60
    # a word that no document of the sample has
    rows = [(k, lang, text + (" zorgle zorgle" if k % 2 and k not in sample else "")) for k, lang, text in rows]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert c.labelled(docs, labels, "toxic").count() == 400
    net = toxicity.fit(docs, labels, per_class=30)
    slot = toxicity.word_slots(pa.array(["zorgle"]))[0][0]
    assert np.abs(net.tables[0][slot[0]]).max() > 0
    low, high = net.score(pa.array(["plain talk of day 1 and weather", "plain talk of day 1 and weather zorgle zorgle"]))
    assert high > low
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    assert min(s for k, s in got.items() if k % 2) > max(s for k, s in got.items() if not k % 2)


def test_a_document_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None), (None, "x"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 2), (None, 1)], "doc_id long, toxic int")
    got = c.labelled(docs, labels, "toxic").collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 0), (2, 1)]
