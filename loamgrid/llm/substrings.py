"""Exact removal of repeated word windows by super-k-mer partitioning.

Every window of ``width`` words has a minimiser: the smallest hash among its
three-word sequences. Consecutive windows sharing it travel as one packed
string to the minimiser's bucket, so equal windows meet; there they are sorted
and compared byte by byte. Before that, a task drops the windows that a chunk of
its texts holds more than once, so a passage with a million copies reaches its
bucket once per chunk and not once per copy.

Buckets are sized from a first pass that counts packed bytes per minimiser
slot over all rows: light slots share a bucket, and a heavy slot is split by a
second minimiser, again equal for equal windows.

Edge cases: a null text has no words; a null doc_id sorts before all others;
rows equal in doc_id and text count as one document and get the same result;
rows that share a doc_id with different texts are ordered by a hash of the
text; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WIDTH, PART = 20, 3
#: Slots of the size count, and packed bytes that one bucket aims at.
SLOTS, BUCKET_BYTES = 8192, 8 << 20
CHUNK = 4 << 20
_KEY = "doc_key long, text_hash long"


class _Words:
    """Words of a chunk as one blob joined by single spaces, in document order."""

    def __init__(self, data: np.ndarray, row_ends: np.ndarray, width: int):
        starts, ends, self.row = c.word_spans(data, row_ends)
        sizes = ends - starts + 1
        self.at = np.cumsum(sizes) - sizes  # of each word in the blob
        self.to = self.at + sizes - 1
        blob = np.append(data, np.uint8(32))[c.ragged(starts, sizes)]
        blob[self.to] = 32
        self.blob = blob
        self.hashes = c.span_hashes(blob, self.at, self.to)
        n = max(0, len(starts) - width + 1)
        self.valid = self.row[:n] == self.row[width - 1 :] if n else np.zeros(0, bool)
        first = np.searchsorted(self.row, np.arange(len(row_ends)))
        self.nth = np.arange(len(starts)) - first[self.row]

    def minimisers(self, width: int, seed: int) -> np.ndarray:
        """Smallest mixed hash of the PART-word sequences of each window."""
        h = self.hashes
        if len(h) < width:
            return np.zeros(0, np.uint64)
        mers = c.mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:], seed)
        span, low = 1, mers
        count = width - PART + 1
        while 2 * span <= count:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        return np.minimum(low[: len(h) - width + 1], low[count - span : count - span + len(h) - width + 1])


def _runs(keep: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of kept neighbours that agree in all of ``same``."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = keep[1:] & keep[:-1]
    for x in same:
        joined &= x[1:] == x[:-1]
    first = np.flatnonzero(keep & np.append(True, ~joined))
    last = np.flatnonzero(keep & np.append(~joined, True))
    return first, last - first + 1


def _equal_bytes(blob: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether blob[a:a+size] equals blob[b:b+size] for every row."""
    if not len(a):
        return True
    padded = np.append(blob, np.zeros(8, np.uint8))
    eight = np.ndarray((len(blob),), "<u8", padded, 0, (1,))
    for at in range(0, int(size.max()), 8):
        on = size > at
        a, b, size = a[on], b[on], size[on]
        unused = np.minimum(8, at + 8 - size).clip(0).astype(np.uint64) * np.uint64(8)
        if ((eight[a + at] ^ eight[b + at]) << unused).any():
            return False
    return True


def repeated(hashes: np.ndarray, blob: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose bytes occur twice or more, and their class; equal class exactly if equal bytes."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    shared = np.append(False, same) | np.append(same, False)
    members = order[shared]
    if not len(members):
        return members, members
    h = hashes[members]
    fresh = np.append(True, h[1:] != h[:-1])
    pairs = np.flatnonzero(~fresh)
    a, b = members[pairs - 1], members[pairs]
    size = hi[a] - lo[a]
    if (size == hi[b] - lo[b]).all() and _equal_bytes(blob, lo[a], lo[b], size):
        return members, np.cumsum(fresh)
    text, known = blob.tobytes(), {}  # two texts with one hash: compare the bytes themselves
    return members, np.array([known.setdefault(text[lo[i] : hi[i]], len(known)) for i in members])


def _chunks(batches, width):
    """(doc_key, text_hash, words) of each chunk, in key order, without rows repeated in it."""
    for batch in batches:
        for part in c.chunks(batch, limit=CHUNK):
            keys = np.stack([part.column(k).to_numpy() for k in ("doc_key", "text_hash")], 1)
            keys, rows = np.unique(keys, axis=0, return_index=True)
            words = _Words(*c.text_bytes(part.column("text").take(pa.array(rows))), width)
            yield keys[:, 0], keys[:, 1], words


def _sizes(source: DataFrame, width: int) -> np.ndarray:
    """Packed bytes of each slot, over all rows."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for _, _, words in _chunks(batches, width):
            low = words.minimisers(width, 0)
            first, count = _runs(words.valid, low)
            size = words.to[first + count + width - 2] - words.at[first] if len(first) else first
            total += np.bincount((low[first] % np.uint64(SLOTS)).astype(np.int64), size, SLOTS).astype(np.int64)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "bytes"])

    total = np.zeros(SLOTS, np.int64)
    for slot, size in source.mapInArrow(run, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes")).collect():
        total[slot] = size
    return total


def _buckets(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each slot."""
    split = np.maximum(1, -(-sizes // target))
    base, at, room = np.zeros(SLOTS, np.int64), 0, target
    for i, n in enumerate(sizes):
        if split[i] > 1 or n > room:
            at, room = at + 1, target
        base[i] = at
        room -= n
        if split[i] > 1:
            at, room = at + split[i] - 1, 0
    return base, split


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _cover(doc: np.ndarray, text: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Rows (doc_key, text_hash, first word, word after the last) that the windows cover, overlapping ones joined."""
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + width))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return np.stack([doc[first], text[first], start[first], start[last] + width], 1) if len(doc) else np.zeros((0, 4), np.int64)


def repeated_ranges(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_key, text_hash, ranges): word ranges covered by windows that start earlier elsewhere.

    A range is first * 2**32 + after-last. ``docs`` has doc_key, text_hash and text.
    """
    source = docs.select("doc_key", "text_hash", "text")
    base, split = _buckets(_sizes(source, width), bucket_bytes)

    def scatter(batches):
        for doc, text_hash, words in _chunks(batches, width):
            n = len(words.valid)
            if not n:
                continue
            at, to = words.at[:n], words.to[width - 1 :]
            windows = np.flatnonzero(words.valid)
            members, classes = repeated(c.window_hashes(words.hashes, width)[windows], words.blob, at[windows], to[windows])
            again = windows[members[np.append(False, classes[1:] == classes[:-1])]] if len(members) else members
            if len(members) and (np.diff(classes) < 0).any():
                order = np.argsort(classes, kind="stable")
                again = windows[members[order][np.append(False, classes[order][1:] == classes[order][:-1])]]
            keep = words.valid.copy()
            keep[again] = False
            low = words.minimisers(width, 0)
            slot = (low % np.uint64(SLOTS)).astype(np.int64)
            bucket = base[slot]
            heavy = np.flatnonzero(split[slot] > 1)
            if len(heavy):
                bucket[heavy] += (words.minimisers(width, 1)[heavy] % split[slot[heavy]].astype(np.uint64)).astype(np.int64)
            first, count = _runs(keep, low, bucket)
            order = np.argsort(bucket[first], kind="stable")
            first, count = first[order], count[order]
            lo, hi, blob = words.at[first], words.to[first + count + width - 2], words.blob.tobytes()
            packed = [blob[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
            meta = np.stack([doc[words.row[first]], text_hash[words.row[first]], words.nth[first]], 1)
            buckets, starts = np.unique(bucket[first], return_index=True)
            rows = [
                (int(b), _squeeze(meta[i:j].tobytes() + b"\n".join(packed[i:j])), j - i)
                for b, i, j in zip(buckets, starts, np.append(starts[1:], len(first)).tolist())
            ]
            if len(again):  # settled here: these ranges only pass through
                own = _cover(doc[words.row[again]], text_hash[words.row[again]], words.nth[again], width)
                rows.append((-1 - int(doc[0] & 0xFFFFF), _squeeze(own.tobytes()), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], ["bucket", "packed", "n"])

    def settle(key, table):
        names = ["doc_key", "text_hash", "first", "after"]
        blobs = [(_expand(b.as_py()), n.as_py()) for b, n in zip(table.column("packed"), table.column("n"))]
        if key[0].as_py() < 0:
            found = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b, _ in blobs])
        else:
            meta = np.concatenate([np.frombuffer(b, np.int64, 3 * n).reshape(-1, 3) for b, n in blobs])
            data = np.frombuffer(b"\n".join(b[24 * n :] for b, n in blobs), np.uint8)
            words = _Words(data, np.append(np.flatnonzero(data == 10), len(data)), width)
            windows = np.flatnonzero(words.valid)
            members, classes = repeated(c.window_hashes(words.hashes, width)[windows], words.blob, words.at[windows], words.to[windows + width - 1])
            at = windows[members]
            doc, text = meta[words.row[at], 0], meta[words.row[at], 1]
            start = meta[words.row[at], 2] + words.nth[at]
            order = np.lexsort((start, text, doc, classes))
            doc, text, start, classes = doc[order], text[order], start[order], classes[order]
            lead = np.searchsorted(classes, classes)
            later = (doc != doc[lead]) | (text != text[lead]) | (start != start[lead])
            found = _cover(doc[later], text[later], start[later], width)
        c.give_back()
        return pa.Table.from_arrays([pa.array(x) for x in found.T.copy()], names)

    ranges = source.mapInArrow(scatter, "bucket long, packed binary, n long").groupBy("bucket").applyInArrow(settle, f"{_KEY}, first long, after long")
    packed = F.shiftleft("first", 32) + F.col("after")
    return ranges.groupBy("doc_key", "text_hash").agg(F.collect_list(packed).alias("ranges"))


_WITH_SPACE = re.compile(rb"[ \t-\r]*[^ \t-\r]+")


def remove_repeats(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, spaces: bool = False) -> DataFrame:
    """The columns of ``docs`` and kept_text, n_words, n_removed.

    Kept words are joined by one space, or with ``spaces`` by the white space
    that stood before each of them.
    """
    c.small_batches(docs.sparkSession)
    names = [n for n in docs.columns if n not in ("kept_text", "n_words", "n_removed")]
    keyed = docs.select(
        F.struct(*[docs[n] for n in names]).alias("doc"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(c.NULL_ID)).alias("doc_key"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"),
    )
    kind = pa.struct([("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    @F.arrow_udf("kept_text string, n_words long, n_removed long")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts, ranges):
            data = (text.as_py() or "").encode()
            words = _WITH_SPACE.findall(data) if spaces else data.split()
            n, gone = len(words), gone.as_py()
            if gone:
                drop = np.zeros(n + 1, np.int64)
                gone = np.array(gone)
                np.add.at(drop, gone >> 32, 1)
                np.add.at(drop, gone & 0xFFFFFFFF, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            out.append(((b"" if spaces else b" ").join(words).decode(), n, n - len(words)))
        kept, n_words, n_removed = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], fields=list(kind))

    found = repeated_ranges(keyed.withColumn("text", F.col("doc.text")), width, bucket_bytes)
    joined = keyed.join(found, ["doc_key", "text_hash"], "left")
    return joined.select("doc", cut("doc.text", "ranges").alias("cut")).select("doc.*", "cut.*")


def op5_superkmer_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(c.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_superkmer_substrings": op5_superkmer_substrings}
ORACLES = {
    "op5_superkmer_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 18))) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM again, (SELECT unnest(range(0, 20)) AS o)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS text FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""
}
