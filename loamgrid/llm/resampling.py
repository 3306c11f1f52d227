"""Importance resampling towards a target text, by hashed word n-grams.

A document's weight is the sum of its features' gains: by how much the feature's
bucket is commoner in the target than in the corpus. The documents drawn are those
of the highest weight plus seeded Gumbel noise, which is a draw without
replacement in proportion to exp(weight).

A feature's bucket is its crc32. The distinct features of a block of words are
grouped by their length into matrices of bytes, one row each; a matrix's CRCs are
carried on together, column by column, and scattered back to where the features
stand. A feature of more than ``WIDE`` bytes would be a matrix of many columns and
a row or two, and takes the library's loop over its bytes instead.

Corpus counts leave a task as one row for each bucket. They, the gains and the
totals are ``BUCKETS`` rows whatever the input; documents are ranked within
ranges, so no task sees all of them.

Edge cases: a null or wordless text has no features and weight 0; a null doc_id is
the empty text in the seed and comes after all other ids among equal scores; rows
that repeat an id and a text have the same score and take places of their own;
other columns are ignored; an empty corpus gives an empty result, and an empty
target leaves gains that only reflect how rare a bucket is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import numbered
from . import _common as c

BUCKETS, ORDERS, SEED = 10_000, 3, 42
#: Words that a document must have to be drawn, and the percentage of those that are.
LEAST_WORDS, PERCENT = 20, 5
#: Words of one block, and bytes of the longest feature that is a row of a matrix.
BLOCK, WIDE = 1 << 17, 192
#: Bytes of one matrix.
_STEP = 1 << 20

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def crc_matrix(columns: np.ndarray) -> np.ndarray:
    """crc32 of every row of a matrix given as its columns (length, rows)."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for every span, by matrices of spans of one length."""
    out, size = np.zeros(len(starts), np.uint32), np.minimum(ends - starts, WIDE + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[order], np.arange(WIDE + 2))
    for n in range(WIDE + 1):
        for at in range(edges[n], edges[n + 1], max(1, _STEP // max(1, n))):
            rows = order[at : min(edges[n + 1], at + max(1, _STEP // max(1, n)))]
            out[rows] = crc_matrix(data[starts[rows] + np.arange(n)[:, None]])
    for i in order[edges[WIDE + 1] :].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each code stands first."""
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def blocks(data: np.ndarray, row_ends: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For blocks of words: the row of each word, and for each order the places whose feature is whole and their buckets."""
    data = _LOWER[data]
    starts, ends, row = c.word_spans(data, row_ends, _OUTSIDE)
    for at in range(0, len(starts), BLOCK):
        stop = min(len(starts), at + BLOCK + ORDERS - 1)  # features may end in the next block
        s, size, r = starts[at:stop], (ends - starts)[at:stop], row[at:stop]
        own = min(BLOCK, len(s))
        # words in a row, each followed by a space: a feature is a span of this, whatever stood between its words
        begin = np.append(0, np.cumsum(size + 1))
        text = np.full(begin[-1], 0x20, np.uint8)
        text[c.ragged(begin[:-1], size)] = data[c.ragged(s, size)]
        words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(text)])
        word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = int(word.max(initial=-1)) + 1
        code, found, spans = word, [], []
        for k in range(ORDERS):
            if k:
                code, names = pd.factorize(code[: len(s) - k] * kinds + word[k:])
                n = len(names)
            else:
                n = kinds
            first = _first(code, n)
            spans.append((begin[first], begin[first + k + 1] - 1))
            here = min(own, len(code))
            found.append((np.flatnonzero(r[:here] == r[k : k + here]), code))
            if len(s) <= k + 1:
                break
        crc = span_crcs(text, *(np.concatenate(x) for x in zip(*spans))) % np.uint32(BUCKETS)
        at_kind = np.append(0, np.cumsum([len(x) for x, _ in spans]))
        yield r[:own], [(whole, crc[a:b][code[whole]]) for (whole, code), a, b in zip(found, at_kind, at_kind[1:])]


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts; a task sends out its own sums."""
    c.small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in c.chunks(batch):
                for _, features in blocks(*c.text_bytes(part.column("text"))):
                    for _, bucket in features:
                        total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in bucket_counts(docs).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much commoner each bucket is in the target, each count raised by one."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    spark = docs.sparkSession
    c.small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        gain = shared.value.astype(np.float64)  # whole numbers far below 2**53: their sums are exact
        for batch in batches:
            for part in c.chunks(batch):
                n = len(part)
                words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
                for row, found in blocks(*c.text_bytes(part.column("text"))):
                    words += np.bincount(row, minlength=n)
                    for whole, bucket in found:
                        features += np.bincount(row[whole], minlength=n)
                        weight += np.bincount(row[whole], gain[bucket], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variable, the same for an id on every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn."""
    gain = gains(_counted(docs), _counted(target))
    scored = c.materialize(weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    placed = numbered(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"], "rank").withColumn("rank", F.col("rank") + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_crc_resampling": op13_crc_resampling}
#: The same by another engine: crc32 byte by byte over distinct features.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
_GRAMS = "unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])))) AS f"
_SQL = f"""WITH RECURSIVE steps AS (SELECT cast(range AS BIGINT) AS b, cast(range AS BIGINT) AS v, 0 AS k FROM range(256)
 UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} FROM documents),
goal AS (SELECT row_number() OVER () AS r, {_WORDS} FROM benchmark),
grams AS (SELECT r, {_GRAMS} FROM docs),
aims AS (SELECT {_GRAMS} FROM goal),
kinds AS (SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: cast('0x' || hex(f)[2*i+1:2*i+2] AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM grams UNION ALL SELECT f FROM aims)), tab),
s AS (SELECT bucket, count(*) AS n FROM grams JOIN kinds USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN kinds USING (f) GROUP BY bucket),
gain AS (SELECT b.bucket, cast(floor(1000*ln((coalesce(t.n, 0)+1.0::DOUBLE)*(SELECT coalesce(sum(n), 0)+10000 FROM s)/((coalesce(s.n, 0)+1.0::DOUBLE)*(SELECT coalesce(sum(n), 0)+10000 FROM t)))) AS BIGINT) AS g FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, count(*) AS n_features, cast(sum(g) AS BIGINT) AS weight FROM grams JOIN kinds USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + cast(floor(-1000*ln(-ln((cast('0x' || sha256('42:' || coalesce(cast(doc_id AS VARCHAR), ''))[1:8] AS BIGINT)+0.5::DOUBLE)/4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS rn, (SELECT 5*count(*)//100 FROM scored WHERE n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN rn <= n THEN rn END AS rank FROM ranked"""

ORACLES = {"op13_crc_resampling": _SQL}
