"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of three hashed embeddings (two of the word, one of
its first bytes), so a clash in one table alone does not make two words alike.
Filters of several widths slide over the words, each keeps its largest response
in the whole text, and a logistic layer reads these. Training begins in numpy on
a balanced sample of labelled documents; where there are more, all of them are
then learnt from by executors, a partition each, whose steps are averaged. Scores
are calibrated to the labels' rates, and a decision threshold is chosen for each
language.

Scoring multiplies every embedding with every filter once, after which a text
costs one table row per word and table.

Edge cases: a null or empty text is scored as one without words; a null,
unknown or missing language gets the default threshold; without usable labels of both
kinds every score is the observed rate (0 where there is none); rows that
repeat a doc_id are scored each by its own text, and the one with the smallest
hash is learnt from; input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Labelled documents of each class that training begins with, at most, and that are calibrated by; more are learnt from by executors.
PER_CLASS = 2500
SLOTS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIX_BYTES = 4
#: Training documents that a word must stand in to be learnt, and training steps in all, about.
MIN_DOCUMENTS, STEPS = 3, 16_000
DEFAULT_THRESHOLD = 0.7
#: Held-back documents of each label that a language needs for a threshold of its own.
CALIBRATE = 10
_CHUNK = 1 << 19
#: Words scored at once while calibrating.
_BLOCK = 1 << 16
_PAD = max(WIDTHS)

_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots (words x 3) of the lower-cased words of all texts, and each text's number of words."""
    data, ends = c.text_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    first, last, row = c.word_spans(data, ends, _BREAK)
    whole = c.span_hashes(data, first, last)
    head = c.span_hashes(data, first, np.minimum(last, first + PREFIX_BYTES))
    slots = np.stack([whole % np.uint64(SLOTS), (whole >> np.uint64(32)) % np.uint64(SLOTS), head % np.uint64(SLOTS)], 1)
    return slots.astype(np.int32), np.bincount(row, minlength=len(ends))


@dataclass
class ConvNet:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    _ready: list[np.ndarray] | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> ConvNet:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32) for _ in range(3)]
        filters = [rng.normal(0, 0.6, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))

    def products(self) -> list[np.ndarray]:
        """Each table's rows times every filter row block: slots x (width, place, filter)."""
        if self._ready is None:
            blocks = np.concatenate([f[j * DIM : (j + 1) * DIM] for f, w in zip(self.filters, WIDTHS) for j in range(w)], 1)
            self._ready = [t @ blocks for t in self.tables]
        return self._ready

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        ends = np.cumsum(counts + _PAD)
        begins = ends - counts - _PAD
        at = c.ragged(begins, counts)
        parts = self.products()
        rows = np.zeros((int(ends[-1]), parts[0].shape[1]), np.float32)
        rows[at] = parts[0][slots[:, 0]]
        for k in (1, 2):
            rows[at] += parts[k][slots[:, k]]
        pooled, block = [], 0
        for w, shift in zip(WIDTHS, self.shifts):
            held = rows[:, block * FILTERS : (block + 1) * FILTERS].copy()
            for j in range(1, w):
                held[:-j] += rows[j:, (block + j) * FILTERS : (block + j + 1) * FILTERS]
                held[ends - j] = -np.inf  # a window that would leave its text
            pooled.append(np.maximum(np.maximum.reduceat(held, begins, axis=0) + shift, 0))
            block += w
        return np.concatenate(pooled, 1) @ self.out + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return c.sigmoid(self.slope * self.logits(*word_slots(texts)).astype(float) + self.shift)


def _seen(docs: list[np.ndarray]) -> np.ndarray:
    """In how many documents each word stands."""
    seen = np.zeros(SLOTS, np.int64)
    for d in docs:
        seen[np.unique(d[:, 0])] += 1
    return seen


def _fresh_squares(net: ConvNet) -> list[np.ndarray]:
    return [np.full_like(x, 0.01) for x in (*net.tables, *net.filters, *net.shifts, net.out)] + [np.full(1, 0.01)]


def _train(net: ConvNet, docs: list[np.ndarray], y: np.ndarray, epochs: int, seen: np.ndarray, squares: list[np.ndarray], weight: tuple = (1.0, 1.0), rate: float = 0.1, seed: int = 3) -> None:
    """Steps over ``docs``, with the squares of earlier steps carried on in ``squares``; an error counts by its label's ``weight``."""
    rng = np.random.default_rng(seed)
    # a word of fewer documents than this cannot carry over to others: it stays a blank
    docs = [np.where(seen[d[:, :1]] >= MIN_DOCUMENTS, d, -1) for d in docs]
    *squares, bias_square = squares
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            slots = np.concatenate([docs[i], np.full((_PAD, 3), -1, np.int32)])
            real = slots[:, 0] >= 0
            x = np.zeros((len(slots), DIM), np.float32)
            for k in range(3):
                x[real] += net.tables[k][slots[real, k]]
            best, peaks = [], []
            for w, f, b in zip(WIDTHS, net.filters, net.shifts):
                windows = np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(-1, w * DIM)
                response = windows @ f + b
                peak = response.argmax(0)
                best.append(response[peak, np.arange(FILTERS)])
                peaks.append((peak, windows[peak]))
            pooled = np.concatenate(best)
            hidden = np.maximum(pooled, 0)
            error = float(c.sigmoid(np.array(hidden @ net.out + net.bias)) - y[i]) * weight[int(y[i])]
            back = (error * net.out * (pooled > 0)).astype(np.float32)
            grads = [error * hidden]
            moved: dict[int, np.ndarray] = {}
            for n, (w, (peak, seen)) in enumerate(zip(WIDTHS, peaks)):
                g = back[n * FILTERS : (n + 1) * FILTERS]
                inward = (net.filters[n] * g).T.reshape(FILTERS, w, DIM)
                for q in np.flatnonzero(g):
                    for j in range(w):
                        p = int(peak[q]) + j
                        if real[p]:
                            moved[p] = moved.get(p, 0) + inward[q, j]
                for target, square, grad in ((net.filters[n], squares[3 + n], seen.T * g), (net.shifts[n], squares[3 + len(WIDTHS) + n], g)):
                    square += grad**2
                    target -= rate * grad / np.sqrt(square)
            squares[-1] += grads[0] ** 2
            net.out -= rate * grads[0] / np.sqrt(squares[-1])
            bias_square += error**2
            net.bias -= float(rate * error / np.sqrt(bias_square[0]))
            for p, grad in moved.items():
                for k in range(3):
                    s = slots[p, k]
                    squares[k][s] += grad**2
                    net.tables[k][s] -= rate * grad / np.sqrt(squares[k][s])
    for table, square in zip(net.tables, squares):
        table[(square <= 0.01).all(1)] = 0  # never learnt


def _dense(net: ConvNet) -> np.ndarray:
    """All weights but the tables, in rows of DIM."""
    flat = np.concatenate([*(f.ravel() for f in net.filters), *net.shifts, net.out, [net.bias]]).astype(float)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _learn_all(net: ConvNet, squares: list[np.ndarray], labelled: DataFrame, held: np.ndarray, weight: tuple) -> None:
    """One pass over all ``labelled`` (doc_id, text, y) but those held back: each partition goes on from ``net``, and the steps are averaged.

    What comes back is a row for each slot that moved, added up by Spark: as many as the tables have, however many documents there are.
    """
    spark = labelled.sparkSession
    held = set(held.tolist())

    def texts(batches):
        for batch in batches:
            for part in c.chunks(batch, limit=_CHUNK):
                ids, counts = word_slots(part.column("text"))
                own = np.array([d not in held for d in part.column("doc_id").to_pylist()], bool)
                docs = np.split(ids, np.cumsum(counts)[:-1])
                yield [d for d, k in zip(docs, own) if k], part.column("y").to_numpy().astype(float)[own]

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for docs, _ in texts(batches):
            seen += _seen(docs)
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(seen[on])], ["slot", "n"])

    found = labelled.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    seen = np.zeros(SLOTS, np.int64)
    seen[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((net, squares, seen))

    def learn(batches):
        first, sums, known = shared.value
        own = ConvNet([t.copy() for t in first.tables], [f.copy() for f in first.filters], [b.copy() for b in first.shifts], first.out.copy(), first.bias)
        sums, some = [q.copy() for q in sums], False
        for docs, y in texts(batches):
            _train(own, docs, y, 1, known, sums, weight)
            some = some or len(docs) > 0
        if not some:
            return
        for kind, (new, old) in enumerate([*zip(own.tables, first.tables), (_dense(own), _dense(first))]):
            step = (new - old).astype(float)
            on = np.flatnonzero(step.any(1)) if kind < 3 else np.arange(len(step))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), kind)), pa.array(on), *map(pa.array, step[on].T.copy())], ["kind", "slot", *(f"d{k}" for k in range(DIM))])

    steps = labelled.mapInArrow(learn, "kind long, slot long, " + ", ".join(f"d{k} double" for k in range(DIM)))
    mean = steps.groupBy("kind", "slot").agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in range(DIM)]).toArrow()  # a row of each table's slot at most
    kind, slot = mean.column("kind").to_numpy(), mean.column("slot").to_numpy()
    step = np.stack([mean.column(f"d{k}").to_numpy() for k in range(DIM)], 1)
    for k in range(3):
        net.tables[k][slot[kind == k]] += step[kind == k].astype(np.float32)
    dense = _dense(net)
    dense[slot[kind == 3]] += step[kind == 3]
    flat, at = dense.ravel(), 0
    for x in (*net.filters, *net.shifts, net.out):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    net.bias, net._ready = float(flat[at]), None
    shared.unpersist()


def _thresholds(score: np.ndarray, y: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """For each language with enough of both labels the cut with the best weighted F0.5, nearest the default among ties."""
    found = {}
    for name in np.unique(lang):
        on = lang == name
        if min(y[on].sum(), (1 - y[on]).sum()) < CALIBRATE:
            continue
        cuts = np.linspace(0.3, 0.9, 13)
        value = []
        for cut in cuts:
            chosen = score[on] >= cut
            hit, all_chosen, all_true = (weight[on] * chosen * y[on]).sum(), (weight[on] * chosen).sum(), (weight[on] * y[on]).sum()
            value.append(1.25 * hit / max(1e-9, all_chosen + 0.25 * all_true))
        found[str(name)] = float(max(zip(np.round(value, 3), -np.abs(cuts - DEFAULT_THRESHOLD), cuts))[2])
    return found


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS) -> ConvNet:
    """Learn from all labelled documents: first at most ``per_class`` of each class, one in five of them held back to calibrate, then, if there are more, all."""
    c.small_batches(docs.sparkSession)
    sample, rates = c.labelled_sample(docs, labels, "toxic", per_class)
    net = ConvNet.fresh()
    if len(rates) < 2:
        net.constant = float(1 in rates)
        return net

    def slots(batches):
        for batch in batches:
            for part in c.chunks(batch, limit=_CHUNK):
                ids, counts = word_slots(part.column("text"))
                ends = np.append(0, np.cumsum(counts) * 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("y"), pa.ListArray.from_arrays(ends, pa.array(ids.ravel()))], ["doc_id", "lang", "y", "slots"])

    sample = sample.withColumn("y", F.col("y").cast("int")).mapInArrow(slots, "doc_id long, lang string, y int, slots array<int>")
    table = sample.toArrow().sort_by("doc_id")
    if not len(table):
        net.constant = rates[1] / sum(rates.values())
        return net
    y = table.column("y").to_numpy().astype(float)
    lang = np.array([x or "" for x in table.column("lang").to_pylist()])
    flat = table.column("slots").combine_chunks()
    texts = [flat[i].values.to_numpy().reshape(-1, 3) for i in range(len(y))]
    held = np.arange(len(y)) % 5 == 0
    learnt, squares = [t for t, h in zip(texts, held) if not h], _fresh_squares(net)
    _train(net, learnt, y[~held], int(np.clip(steps / max(1, (~held).sum()), 2, 40)), _seen(learnt), squares)
    if sum(rates.values()) > len(y):
        fewer = min(rates.values())
        _learn_all(net, squares, c.labelled(docs, labels, "toxic"), table.column("doc_id").to_numpy()[held], (fewer / rates[0], fewer / rates[1]))
    del learnt, squares
    kept_back = [t for t, h in zip(texts, held) if h]
    z = np.zeros(len(kept_back))
    ends = np.cumsum([len(t) for t in kept_back])
    for k in np.unique(ends // _BLOCK):  # so many words at once, or one longer text
        on = np.flatnonzero(ends // _BLOCK == k)
        z[on] = net.logits(np.concatenate([kept_back[i] for i in on]), np.array([len(kept_back[i]) for i in on]))
    weight = np.where(y[held] > 0, rates[1] / max(1, y[held].sum()), rates[0] / max(1, (1 - y[held]).sum()))
    weight *= held.sum() / weight.sum()
    net.slope, net.shift = c.platt(z, y[held], weight)
    net.thresholds = _thresholds(c.sigmoid(net.slope * z + net.shift), y[held], lang[held], weight)
    net._ready = None
    del table, flat, texts, kept_back
    c.give_back()  # the driver lives on
    return net


def score(docs: DataFrame, net: ConvNet) -> DataFrame:
    """The columns of ``docs`` and score, threshold (that of the language) and toxic."""
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by SLOTS and DIM

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = c.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), limit=_CHUNK)
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(p.column("text")) for p in parts)]), pa.float64())

    cuts = F.create_map(*[F.lit(x) for kv in net.thresholds.items() for x in kv]) if net.thresholds else None
    threshold = F.lit(DEFAULT_THRESHOLD) if cuts is None or "lang" not in docs.columns else F.coalesce(cuts[F.col("lang")], F.lit(DEFAULT_THRESHOLD))
    return docs.withColumn("score", run("text")).withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def op1_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = c.crc_mod(F.col("doc_id"), 3)
    scored = score(docs.select("doc_id", "lang", "text"), fit(docs, labels.filter(fold != 1)))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", F.col("toxic").alias("flagged"))


QUERIES = {"op1_conv_toxicity": op1_conv_toxicity}
ORACLES: dict[str, str] = {}
