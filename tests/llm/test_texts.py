"""Window removal, shingle links, rules and line features against brute force; edge cases of every text operator."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import _common as c
from loamgrid.llm import jaccard, quality, rules, substrings, toxicity
from loamgrid.llm.components import components

SF = "/root/testdata/sf0.001"


def test_word_spans_and_hashes():
    texts = ["a bc\n", None, "", "bc a\tbc", "éé x"]
    data, ends = c.text_bytes(pa.array(texts))
    at, to, row = c.word_spans(data, ends)
    found = [bytes(data[i:j]) for i, j in zip(at, to)]
    assert found == b"a bc bc a bc".split() + ["éé".encode(), b"x"]
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    h = c.span_hashes(data, at, to)
    assert h[1] == h[2] == h[4] and h[0] == h[3] and len(set(h.tolist())) == 4


def brute_windows(rows, width):
    """Kept words by (doc_id, text), ids ascending, equal rows once."""
    order = {}
    for doc_id, text in rows:
        order[(c.NULL_ID if doc_id is None else doc_id, text or "")] = None
    out = {}
    windows = collections.defaultdict(list)
    for key in order:
        w = key[1].encode().split()
        for i in range(len(w) - width + 1):
            windows[tuple(w[i : i + width])].append((key[0], i, key))
    for key in order:
        w = key[1].encode().split()
        drop = set()
        for i in range(len(w) - width + 1):
            if any((d, s) < (key[0], i) for d, s, _ in windows[tuple(w[i : i + width])]):
                drop.update(range(i, i + width))
        out[key] = b" ".join(x for i, x in enumerate(w) if i not in drop).decode()
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 500])
def test_substrings_edges(docs, bucket_bytes):
    got = substrings.remove_repeats(docs, 20, bucket_bytes).select("doc_id", "text", "kept_text", "n_words", "n_removed").collect()
    want = brute_windows([(r["doc_id"], r["text"]) for r in docs.collect()], 20)
    assert len(got) == docs.count()
    for r in got:
        assert r["kept_text"] == want[(c.NULL_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "")]
        assert r["n_words"] == len((r["text"] or "").encode().split())
    assert sum(r["n_removed"] for r in got) > 200


def test_hash_clash_falls_back_to_bytes():
    blob = np.frombuffer(b"ab cd ab", np.uint8)
    members, classes = substrings.repeated(np.zeros(3, np.uint64), blob, np.array([0, 3, 6]), np.array([2, 5, 8]))
    by = dict(zip(members.tolist(), classes.tolist()))
    assert by[0] == by[2] != by[1]


def brute_links(rows):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(sets, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((d, len(s), least.get(g)) for (d, s), g in zip(sets, group)), key=str)


def test_shingle_components_edges(docs):
    got = jaccard.shingle_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_links([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shingle_components_of_edited_families(spark):
    r = random.Random(9)
    rows = []
    for family in range(4):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400]))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_groups_of_many_blocks_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_tree_traversal_keeps_every_link():
    r = np.random.default_rng(3)
    base = [r.integers(0, 2**63, 200).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.where(r.random(200) < r.choice([0.02, 0.3]), r.integers(0, 2**63, 200), base[i % 3]).astype(np.uint64)) for i in range(90)]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    width = min(len(jaccard._bitmap(s)) for s in sets)
    bits = []
    for i in order:
        b = np.frombuffer(jaccard._bitmap(sets[i]), np.uint64)
        while len(b) * 8 > width:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
        bits.append(b)
    tree = jaccard.SignatureTree(n[order], np.stack(bits), np.arange(90))
    a, b = jaccard.traverse(tree, tree)
    found = {frozenset((order[i], order[j])) for i, j in zip(a, b) if i != j}
    links = {frozenset((i, j)) for i in range(90) for j in range(i) if jaccard.enough(len(np.intersect1d(sets[i], sets[j])), n[i], n[j])}
    assert links and links <= found and len(found) < 90 * 89 / 4


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain.unionByName(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))).collect()
    assert {r["id"]: r["component"] for r in got} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    cover = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_rule_statistics_edges(docs, spark):
    more = spark.createDataFrame([(90, "a b c d e a b c d e f\n" * 3), (91, "x " * 50)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = rules.statistics(both).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r["doc_id"], *brute_statistics(r["text"])) for r in both.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decision_list_learns_a_conjunction(spark):
    rows = spark.range(2000).select(*[F.rand(i).alias(n) for i, n in enumerate(["u", "v"])], (F.col("id") % 3 != 0).alias("grow"))
    rows = rows.withColumn("bad", ((F.col("u") > 0.8) & (F.col("v") < 0.5)).cast("int"))
    found = rules.learn(rows, ["u", "v"])
    wrong = rows.filter(found.keep() == (F.col("bad") == 1)).count()
    assert found.rules and wrong < 40 and "u >" in str(found)


def test_line_features_and_marginals():
    texts = pa.array(["Good line.\n###\n###\n", None, "", "AB cd cd cd"])
    x, counts = quality.line_features(texts)
    assert counts.tolist() == [4, 1, 1, 1]
    k = quality.FEATURES.index
    assert x[1, k("symbols")] == 1 and x[:4, k("copy")].tolist() == [0, 0, 1, 0] and x[0, k("ended")] == 1
    assert x[6, k("echo")] == 0.5
    field = quality.LineField(step=np.array([[0.7, -0.3], [-0.2, 0.5]]))
    score, counts = np.array([0.4, -1.0, 2.0, 0.3, -0.2]), np.array([3, 2])
    good, pairs = field.marginals(score, counts)
    at, total = 0, np.zeros((2, 2))
    for n in counts:
        z, one = 0.0, np.zeros(n)
        pair = np.zeros((2, 2))
        for labels in np.ndindex(*[2] * n):
            e = np.exp(sum(score[at + i] * y for i, y in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:])))
            z += e
            one += e * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                pair[a, b] += e
        assert np.allclose(good[at : at + n], one / z)
        total += pair / z
        at += n
    assert np.allclose(pairs, total)


def test_convolution_equals_its_definition():
    net = toxicity.ConvNet.fresh()
    texts = pa.array(["Hello there, hello!", "", None, "one", "a b c d e f"])
    slots, counts = toxicity.word_slots(texts)
    assert counts.tolist() == [3, 0, 0, 1, 6] and (slots[0] == slots[2]).all()
    want, at = [], 0
    for n in counts:
        x = np.zeros((n + 3, toxicity.DIM))
        for i in range(n):
            x[i] = sum(net.tables[k][slots[at + i, k]] for k in range(3))
        pooled = []
        for w, f, b in zip(toxicity.WIDTHS, net.filters, net.shifts):
            pooled.append(np.maximum(np.max([x[i : i + w].ravel() @ f + b for i in range(n + 4 - w)], axis=0), 0))
        want.append(np.concatenate(pooled) @ net.out + net.bias)
        at += n
    assert np.allclose(net.logits(slots, counts), want, atol=1e-5)


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_edges(docs, no_docs, labels, module, column):
    model = module.fit(docs, labels)
    got = module.score(docs, model).select("doc_id", "score").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(no_docs, model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert {r["score"] for r in module.score(docs, none).select("score").collect()} <= {0.0, 1.0}
    assert module.fit(no_docs, labels) is not None


def test_empty_tables(no_docs, labels):
    assert substrings.remove_repeats(no_docs).count() == 0
    assert jaccard.shingle_components(no_docs).count() == 0
    assert rules.judged(no_docs, labels)[0].count() == 0


@pytest.mark.parametrize("module,column,fold,held", [(toxicity, "toxic", 3, 1), (quality, "quality", 5, 0)])
def test_held_out_ranking(spark, module, column, fold, held):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, known = c.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    remainder = c.crc_mod(F.col("doc_id"), fold)
    model = module.fit(docs, known.filter(remainder != held))
    test = docs.join(known.filter(remainder == held).select("doc_id", F.col(column).alias("y")), "doc_id")
    pdf = module.score(test, model).select("score", "y").toPandas()
    rank = pdf.score.rank()
    good = (pdf.y == 1).sum()
    auc = (rank[pdf.y == 1].sum() - good * (good + 1) / 2) / (good * (len(pdf) - good))
    assert auc > 0.95


def test_substring_query_hash(spark):
    got = substrings.op5_superkmer_substrings(spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in c.documents(spark, SF).collect()]
    want = brute_windows(rows, 20)
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {k[0]: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
