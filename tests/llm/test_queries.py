"""Every registered text query over the whole of a small folder, against plain Python."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loamgrid.llm import _common as c
from loamgrid.llm import packing, quality, token_files, tokens, toxicity
from loamgrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def remainder(doc_id, n):
    return crc(str(doc_id).encode()) % n


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in c.documents(spark, SF).collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_vocabulary())
    return {d: model.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name,fold,held,cut", [("op1_conv_toxicity", 3, 1, 0.7), ("op4_crf_line_quality", 5, 0, 0.3)])
def test_classifier_queries(spark, texts, name, fold, held, cut):
    rows = run(spark, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], fold) == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_pieces_query(spark, texts):
    rows = run(spark, "op2_sentencepiece_dropout")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and all(r["lossless"] for r in rows)


def test_token_file_query(spark, ids):
    rows, start = {r["doc_id"]: r for r in run(spark, "op7_orc_token_ids")}, 0
    for d in sorted(ids):
        own = np.array([*ids[d], 2], "<u4")
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(own), crc(own.tobytes()))
        start += len(own)
    assert len(rows) == len(ids)


def test_token_files_keep_their_order_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 7, "w " * (i % 5)) for i in range(60)] + [(None, "x y"), (None, None)], "doc_id long, text string").repartition(5)
    path = c.shared_path(spark, "tokens")
    token_files.write_token_files(token_files.encode_documents(docs), path)
    read = token_files.read_token_files(spark, path)
    rows = sorted(token_files.digest(read).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    listed = [list(r["ids"]) for r in sorted(read.collect(), key=lambda r: (r["part"], r["nth"]))]
    assert [len(x) for x in listed] == [r["n_tokens"] for r in rows]
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d))


def test_token_files_prune_by_id(spark):
    path = c.shared_path(spark, "tokens")
    docs = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_token_files(token_files.encode_documents(docs).coalesce(1), path, row_index_stride=1000)
    found = token_files.read_token_files(spark, path).filter("doc_id = 12345")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12345)]" in plan.toString()
    found._jdf.queryExecution().executedPlan().executeCollect()
    scan = plan
    while scan.children().nonEmpty():
        scan = scan.children().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read <= 2000  # one or two groups of the row index, not 40,000 rows


def test_language_model_query(spark, texts):
    seen = collections.Counter()
    listed = {d: [*(w for w in WORD.findall(lower(t))), "\n"] for d, t in texts.items()}
    for d, words in listed.items():
        if remainder(d, 7) != 2:
            seen.update(words)
    total, kinds = sum(seen.values()), len(seen)
    for r in run(spark, "op8_brown_class_lm"):
        words = listed[r["doc_id"]]
        assert r["held_out"] == (remainder(r["doc_id"], 7) == 2) and r["train_tokens"] == total
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(seen[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in words), abs=1e-6)
        assert r["score"] < 0


def test_rule_query(spark, texts):
    for r in run(spark, "op9_decision_list_rules"):
        text = texts[r["doc_id"]]
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(windows)
        repeated = len({j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def check_packed(rows, ids, window=packing.WINDOW):
    placed, cut = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = np.array([*ids[r["doc_id"]], 1], "<u4")
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and len(part) == r["length"] > 0 and r["ids_crc32"] == crc(part.tobytes())
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        cut[r["doc_id"]].append((r["start"], r["length"]))
    for spans in (*placed.values(), *cut.values()):
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert all(sum(n for _, n in spans) <= window for spans in placed.values())
    assert {d: sum(n for _, n in spans) for d, spans in cut.items()} == {d: len(x) + 1 for d, x in ids.items()}


def test_packing_query(spark, ids):
    rows = run(spark, "op10_nnls_packing")
    check_packed(rows, ids)
    used = sum(r["length"] for r in rows) / (packing.WINDOW * len({r["sequence_id"] for r in rows}))
    assert used > 0.97


def brute_components(texts):
    """Smallest key of each document's group; keys order as (id, text)."""
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def brute_cut(rows, width=20):
    """Texts without repeated windows; rows are (id, text) in order."""
    seen, drop = {}, [set() for _ in rows]
    for k, (_, text) in enumerate(rows):
        w = WORD.findall(text)
        for i in range(len(w) - width + 1):
            if tuple(w[i : i + width]) in seen:
                drop[k] |= set(range(i, i + width))
            else:
                seen[tuple(w[i : i + width])] = k
    out = []
    for (d, text), gone in zip(rows, drop):
        parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
        out.append((d, "".join(p for i, p in enumerate(parts) if i not in gone) if gone else text))
    return out


def test_pipeline_equals_brute_force(spark, texts):
    docs = c.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    import pyarrow as pa

    score = lambda m, rows: m.score(pa.array([t for _, t in rows], pa.string()))
    rows = sorted(texts.items())
    kept = [r for r, s in zip(rows, score(model, rows)) if s >= quality.THRESHOLD]
    stage = {}
    for name, f in P.STAGES:
        docs = c.materialize(f(spark, docs, SF), "stage")
        stage[name] = docs.collect()
        if name == "quality":
            net = toxicity.fit(docs, labels)
    assert sorted((r["doc_id"], r["text"] or "") for r in stage["quality"]) == kept and kept
    lang = {r["doc_id"]: r["lang"] for r in stage["quality"]}
    kept = [r for r, s in zip(kept, score(net, kept)) if s < net.thresholds.get(lang[r[0]], toxicity.DEFAULT_THRESHOLD)]
    assert sorted((r["doc_id"], r["text"] or "") for r in stage["toxicity"]) == kept
    group = brute_components([t for _, t in kept])
    kept = [r for k, r in enumerate(kept) if group[k] == k]
    assert sorted((r["doc_id"], r["text"] or "") for r in stage["near duplicates"]) == kept
    kept = brute_cut(kept)
    assert sorted((r["doc_id"], r["text"] or "") for r in stage["repeated passages"]) == kept
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    check_packed(stage["packing"], {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in kept})


def test_stages_on_odd_rows(spark, docs, no_docs):
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, no_docs, SF).count() == 0
    assert P.packing_stage(spark, docs, SF).count() >= docs.count()
    assert P.packing_stage(spark, no_docs, SF).count() == 0
    for stage in (P.quality_stage, P.toxicity_stage):
        assert stage(spark, docs.select("doc_id", "text"), SF).columns == ["doc_id", "text"]


def test_near_duplicate_stage_loses_no_document(spark):
    long = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(5, long("a")), (5, long("b")), (6, long("c")), (7, long("a")), (5, long("a")), (8, None), (9, ""), (None, long("d")), (None, long("d") + " e"), (None, long("f"))]
    got = P.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    have = collections.Counter((r["doc_id"], (r["text"] or "")[:2]) for r in got)
    assert have == collections.Counter({(5, "a0"): 1, (5, "b0"): 1, (6, "c0"): 1, (8, ""): 1, (9, ""): 1, (None, "d0"): 1, (None, "f0"): 1})


def test_labels_are_joined_before_they_are_sampled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 2000, 10)] + [(0, "other")], "doc_id long, text string")
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.floor(F.col("id") / 10) % 2).alias("toxic"))
    sample, rates = c.labelled_sample(docs, labels, "toxic", 60)
    rows = sample.collect()
    assert collections.Counter(r["y"] for r in rows) == {0: 60, 1: 60} and rates == {0: 100, 1: 100}
    assert len({r["doc_id"] for r in rows}) == 120 and all(r["lang"] is None for r in rows)


def test_span_hashes_do_not_depend_on_place():
    r = np.random.default_rng(1)
    word = r.integers(0, 256, 200_000).astype(np.uint8)
    text = np.concatenate([[1, 2, 3], word, [9], word, word[:5]]).astype(np.uint8)
    n = len(word)
    starts, ends = np.array([3, 4 + n, 4 + 2 * n, 7, 7]), np.array([3 + n, 4 + 2 * n, 9 + 2 * n, 7, 8])
    got = c.span_hashes(text, starts, ends)
    assert got[0] == got[1] != got[2] and got[3] != got[4]
    assert (c.window_hashes(text, 5) == c.span_hashes(text, np.arange(len(text) - 4), np.arange(len(text) - 4) + 5)).all()
