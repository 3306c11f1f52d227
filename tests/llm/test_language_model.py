"""The class language model against counts, classes and scores worked out one by one."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import _common as c
from loamgrid.llm import language_model as lm


def fold(doc_id):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


@pytest.fixture(scope="module")
def found(docs):
    rows, model = lm.scored(docs, c.crc_mod(F.col("doc_id"), 7) != 2, seed_words=20, classes=4, lookup_words=60)
    return rows.collect(), model, {r["word"]: r for r in model.rare.collect()}


def classes_of(model, rare):
    known = dict(zip(model.words, model.group.tolist())) | {w: r["class"] for w, r in rare.items()}
    return lambda w: known.get(w, model.classes + lm.shape(w) if w != lm.END else None)


def test_every_training_word_has_a_class(docs, found):
    _, model, rare = found
    seen = collections.Counter(w for r in docs.collect() if fold(r["doc_id"]) != 2 for w in lm.tokens(r["text"]))
    assert model.train_tokens == sum(seen.values()) and model.vocabulary == len(seen)
    assert {w: r["n"] for w, r in rare.items()} | dict(zip(model.words, model.seen.tolist())) == dict(seen)
    of = classes_of(model, rare)
    for w, n in seen.items():
        shaped = model.classes <= of(w) < model.classes + lm.SHAPES
        assert w == lm.END or shaped == (n < lm.MIN_COUNT)
    assert len({of(w) for w, n in seen.items() if n > 1}) > 2


def test_scores_equal_brute_force(docs, found):
    rows, model, rare = found
    of, end = classes_of(model, rare), model.classes + lm.SHAPES
    listed = [(r["doc_id"], lm.tokens(r["text"])) for r in docs.collect()]
    seen, pairs, size, kinds = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for doc_id, words in listed:
        if fold(doc_id) != 2:
            seen.update(words)
            at = [end, *(of(w) if w != lm.END else end for w in words)]
            pairs.update(zip(at, at[1:]))
            size.update(at[1:])
    kinds.update(of(w) if w != lm.END else end for w in seen)
    total, out = sum(pairs.values()), collections.Counter()
    for (a, _), n in pairs.items():
        out[a] += n

    def brute(words):
        score, before = 0.0, end
        for w in words:
            cls = of(w) if w != lm.END else end
            rate = (size[cls] + 1) / (total + end + 1)
            score += math.log10((pairs[before, cls] + lm.CARRY * rate) / (out[before] + lm.CARRY))
            shaped = model.classes <= cls < end
            score += math.log10((seen[w] + lm.EMIT) / (size[cls] + lm.EMIT * (kinds[cls] + 1)) if shaped else seen[w] / size[cls])
            before = cls
        return score

    n_all, kinds_all = sum(seen.values()), len(seen)
    want = sorted((str(d), len(t), sum(seen[w] > 0 for w in t), round(sum(math.log10((seen[w] + 1) / (n_all + kinds_all + 1)) for w in t), 6), round(brute(t), 6)) for d, t in listed)
    got = sorted((str(r["row"]["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in want], atol=1e-5)


def test_placing_takes_the_largest_gain(spark):
    rng = np.random.default_rng(3)
    size, classes = 7, 4
    table = rng.integers(5, 400, (size, size)).astype(float)
    rows = [(int(k), int(rng.integers(size * size)), int(rng.integers(1, 40))) for k in rng.integers(0, 30, 900)]
    own = rng.integers(-1, classes, 30)
    got = {r["key"]: r for r in lm.place(spark.createDataFrame(rows, "key int, code int, n long").repartition(3), table, classes, own).collect()}
    f = lambda x: x * math.log(max(x, 1e-9))
    for key in {r[0] for r in rows}:
        after, before = np.zeros(size), np.zeros(size)
        for k, code, n in rows:
            if k == key:
                before[code // size] += n
                after[code % size] += n
        gain = []
        for b in range(classes):
            held = b == own[key]
            cell = lambda old, n: f(old) - f(max(0, old - n)) if held else f(old + n) - f(old)  # noqa: B023, E731
            gain.append(sum(cell(table[b, x], after[x]) for x in range(size)) + sum(cell(table[x, b], before[x]) for x in range(size)) - cell(table[b].sum(), after.sum()) - cell(table[:, b].sum(), before.sum()))
        assert got[key]["n"] == after.sum()
        assert gain[got[key]["class"]] >= max(gain) - 0.05  # gains of small counts are kept in single precision


def test_rare_contexts_are_added_up(spark):
    texts = ["rare a rare a", "a rare", None, "", "RARE a odd", "a " * 5 + "rare a", "rare"] * 3
    docs = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "row long, train boolean, text string").coalesce(1)
    group = np.array([0, 1, 2])  # of "a", END and the rest
    got = [(r["key"], r["code"], r["n"]) for r in lm.rare_contexts(lm.numbered(docs, [b"a", lm.END]), group).collect()]
    want = collections.Counter()
    for t in texts:
        at = [1, *({b"a": 0, lm.END: 1}.get(w, 2) for w in lm.tokens(t))]
        for i, w in enumerate(lm.tokens(t)):
            if w not in (b"a", lm.END):
                want[bytes(w), at[i] * 3 + at[i + 2]] += 1
    assert {(bytes(k), code): n for k, code, n in got} == want and len(got) == len(want)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    truth = np.arange(24) % 3
    table = rng.poisson(np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])[truth][:, truth])
    group = lm.exchange(np.pad(table, (0, 1)), 24, 3)
    assert all(len(set(group[:24][truth == t])) == 1 for t in range(3))


def test_nothing_to_learn_from(docs, no_docs):
    rows, model = lm.scored(docs, F.lit(False))
    assert model.train_tokens == 0 and all(r["n_known"] == 0 and r["score"] < 0 for r in rows.collect())
    assert lm.scored(no_docs, F.lit(True))[0].count() == 0
