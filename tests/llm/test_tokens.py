"""Tokens, files, packing, pieces and vectors: round trips, brute force and edge cases."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import _common as c
from loamgrid.llm import embeddings, packing, pieces, token_files, tokens

ODD = ["a<|endoftext|>b  c\x1cd é ́x ΑΣ Σ İ it's\tDon'T ٣ 中文 x", "", "x" * 3000, "WE'LL we'LL ²³ \xa0\x85 ß µ"]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(docs):
    texts = [r["text"] for r in docs.limit(25).collect()] + ODD
    for text, ids in zip(texts, tokens.WordEncoder(tokens.default_vocabulary()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)


def test_token_files_round_trip(spark, docs, no_docs):
    path = c.shared_path(spark, "orc")
    token_files.write_token_files(token_files.encode_documents(docs), path)
    got = token_files.digest(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x))
    ids = lambda t: np.array([*library_ids(t), 2], "<u4").tobytes()
    want = collections.Counter((r["doc_id"], zlib.crc32(ids(r["text"]))) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert spark.read.orc(path).filter("doc_id = 7").count() == 1
    none = c.shared_path(spark, "orc")
    token_files.write_token_files(token_files.encode_documents(no_docs), none)
    assert token_files.digest(token_files.read_token_files(spark, none)).count() == 0


def test_packing_places_every_id_once(docs, no_docs):
    got = packing.pack(packing.pieces(docs, window=64), window=64).toPandas()
    assert (got.length <= 64).all() and got.length.sum() == sum(len(library_ids(r["text"])) + 1 for r in docs.collect())
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.offset == by.groupby("sequence_id").length.cumsum() - by.length).all()
    assert by.groupby("sequence_id").length.sum().max() <= 64
    assert got.length.sum() / (64 * got.sequence_id.nunique()) > 0.9
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 2048), minlength=2049)
    plan = packing.make_plan(histogram)
    length = np.repeat(np.arange(2049), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    assert (np.where(np.append(True, s[1:] != s[:-1]), 0, np.append(0, o[:-1] + n[:-1])) == o).all()
    assert length.sum() / (2048 * plan.sequences) > 0.99
    assert plan.sequences == len(np.unique(sequence))


def test_least_squares_recovers_counts():
    table = np.array([[1500, 500, 48], [1000, 1000, 48], [2000, 48, 0]])
    want = np.array([30.0, 12.0, 7.0])
    histogram = np.zeros(2049)
    np.add.at(histogram, table.ravel(), np.repeat(want, 3))
    histogram[0] = 0
    assert np.allclose(packing.repeat_counts(table, histogram, 3000), want, atol=0.05)


def brute_pieces(codec, segment):
    bounds = list(range(len(segment) + 1))
    key = pieces.xxhash.xxh32_intdigest(segment, codec.seed)
    while True:
        best = min(((codec._candidate(key, segment, bounds[i], bounds[i + 2]), bounds[i], i) for i in range(len(bounds) - 2)), default=(math.inf,))
        if best[0] == math.inf:
            return bounds[1:]
        del bounds[best[2] + 1]


def test_pieces_agenda_equals_brute_force():
    codec = pieces.PieceCodec(pieces.default_model(), 0.3, 5)
    for segment in ["▁hello", "▁internationalisation", "▁ananananananananananananananananan", "x", "▁▁▁the"]:
        assert codec.merges(segment) == brute_pieces(codec, segment)
        assert codec._long(segment, len(segment), pieces.xxhash.xxh32_intdigest(segment, 5)) == brute_pieces(codec, segment)


def test_pieces_are_the_models_own_without_dropout():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.default_model())
    codec = pieces.PieceCodec(pieces.default_model(), 0.0)
    for text in ["Hello  world\n ok ½", "x", " ", "\n\n a", "The quick brown fox.\nJumps"]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == model.encode(text)


def test_pieces_lossless_and_varied(docs, no_docs, spark):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["▁", "a▁ b", " ▁▁x ", "\n\n", " lead", "tail ", "a" * 3000])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    runs = []
    for seed in (1, 2):
        got = pieces.decode(pieces.encode(both, 0.2, seed)).collect()
        assert all(r["decoded"] == (r["text"] or "") for r in got)
        runs.append([bytes(r["ids"]) for r in got])
    assert runs[0] != runs[1]
    assert pieces.decode(pieces.encode(no_docs)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows, base = [], r.normal(size=(6, 32))
    for i in range(300):
        v = base[i % 6] + r.normal(size=32) * r.choice([0.02, 0.15, 0.25, 1.5])
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(300 + i, rows[4][1], 0) for i in range(4)]
    rows += [(310, None, 0), (311, [0.0] * 32, 0), (312, [float("nan")] * 32, 0), (313, [1.0] * 31 + [None], 0), (314, [1.0, 2.0], 0), (315, rows[2][1], None), (None, rows[2][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [1024, 20])
def test_vectors_against_brute_force(vectors, block):
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors, block=block).collect()}
    rows = [r for r in vectors.collect() if r["vec_id"] is not None and r["vec_id"] < 310]
    x = np.array([r["embedding"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = ((x @ x.T) >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    found = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum() > 0
    assert len({got[i]["component_id"] for i in (4, 300, 301, 302, 303)}) == 1
    for i in (310, 311, 312, 313, 314, 315):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[None]["n_links"] == 0 and len(got) == vectors.count()
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_crc_mod(spark):
    got = spark.createDataFrame([(7,), (None,)], "doc_id long").select(c.crc_mod(F.col("doc_id"), 3)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"7") % 3, -1]


@pytest.mark.parametrize("dims", [16, 32, 64])
def test_vectors_just_above_the_threshold_are_found(spark, dims):
    r = np.random.default_rng(dims)
    x = r.normal(size=(1500, dims)) * np.linspace(2, 0.5, dims) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    t = r.uniform(0.931, 0.95, (1500, 1))
    y = t * x + np.sqrt(1 - t**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in z], 0) for i, z in enumerate(np.concatenate([x, y]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    z = np.concatenate([x, y])
    near = (z @ z.T) >= 0.93
    np.fill_diagonal(near, False)
    found = np.array([r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()


def test_what_is_compared_grows_slower_than_a_label():
    share = [embeddings.tables(0.12, embeddings.substring_bits(n)) / 2 ** embeddings.substring_bits(n) for n in (10**3, 10**5, 10**7)]
    assert share[0] > 8 * share[1] > 64 * share[2]


def test_vectors_of_every_length_link(spark):
    rows = [(i, [1.0, float(i)] + [0.5] * 6, 1) for i in range(40)] + [(100 + i, [2.0, 1.0 + i / 1e4, 3.0], 1) for i in range(3)] + [(200, [5.0], 1), (201, [7.0], 1), (202, [-5.0], 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[i]["n_links"] for i in (100, 101, 102)] == [2, 2, 2] and got[102]["component_id"] == 100
    assert got[200]["n_links"] == 1 and got[201]["component_id"] == 200 and got[202]["n_links"] == 0 and got[202]["kept"]


def test_a_large_family_is_dealt_into_blocks(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=24)
    rows = [(i, [float(v) for v in base + 0.02 * r.normal(size=24)], 0) for i in range(900)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=64).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["n_links"] for r in got) == 900 * 899
