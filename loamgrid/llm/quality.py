"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its evidence is a set of binned surface
statistics of the line itself and of the lines before and after it; a
transition weight ties neighbouring labels together. Forward-backward gives
each line's marginal probability of being good, and their mean weighted by line
length is the document's quality. The field is trained in numpy by maximum
likelihood on a bounded sample of labelled documents, whose lines all carry the
document's label; a logistic fit on held-back documents calibrates the mean to
the labels' rates.

Edge cases: a null or empty text is one empty line; without usable labels of
both kinds every score is the observed rate (1 where there is none); rows that
repeat a doc_id are scored each by its own text, and the one with the smallest
hash is learnt from; input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Labelled documents of each class that are learnt from, at most.
PER_CLASS = 2000
BINS = 10
THRESHOLD = 0.3
FEATURES = ["bytes", "words", "mean_word", "symbols", "upper", "marks", "digits", "stops", "beyond_ascii", "echo", "copy", "ended"]
_CHUNK = 1 << 20


def _member(characters: str | range) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[[ord(x) for x in characters] if isinstance(characters, str) else list(characters)] = 1
    return table


_CLASSES = {
    "symbols": _member("#*$%&|<>"),
    "upper": _member(range(0x41, 0x5B)),
    "marks": _member("!?"),
    "digits": _member(range(0x30, 0x3A)),
    "stops": _member(".,;:"),
    "beyond_ascii": _member(range(0x80, 0x100)),
}


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of every line of all texts (lines x FEATURES) and each text's number of lines."""
    data, row_ends = c.text_bytes(texts)
    begins = np.append(0, row_ends[:-1])
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, row_ends]), kind="stable")
    row = np.sort(np.concatenate([np.searchsorted(row_ends, breaks, side="right"), np.arange(len(row_ends))]))
    counts = np.bincount(row, minlength=len(row_ends))
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    first = np.cumsum(counts) - counts
    starts[first] = begins
    size = ends - starts
    total = lambda x: (s := np.append(0, np.cumsum(x)))[ends] - s[starts]
    share = lambda x: total(x) / np.maximum(1, size)
    at, to, _ = c.word_spans(data, row_ends)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=len(ends))
    letters = np.bincount(line, to - at, len(ends))
    hashes = c.span_hashes(data, at, to)
    echo = np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])) if len(at) else np.zeros(0, bool)
    whole = c.mix(c.span_hashes(data, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    copy = np.ones(len(ends), bool)
    copy[np.unique(whole, return_index=True)[1]] = False
    final = data[np.maximum(0, ends - 1)] if len(data) else np.zeros(len(ends), np.uint8)
    columns = {name: share(table[data]) for name, table in _CLASSES.items()} | {
        "bytes": np.log1p(size),
        "words": np.log1p(words),
        "mean_word": letters / np.maximum(1, words),
        "echo": np.bincount(line, echo, len(ends)) / np.maximum(1, words),
        "copy": copy & (words > 0),
        "ended": np.isin(final, np.frombuffer(b".!?", np.uint8)) & (size > 0),
    }
    return np.stack([np.asarray(columns[n], np.float32) for n in FEATURES], 1), counts


@dataclass
class LineField:
    """Weights of the field: ``emit[place, feature, bin]`` for good against bad, place -1, 0, +1 and beyond the text."""

    cuts: list[np.ndarray] = field(default_factory=list)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((3, len(FEATURES), BINS + 1)))
    edge: np.ndarray = field(default_factory=lambda: np.zeros(2))
    bias: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, features[:, k], side="left") for k, cut in enumerate(self.cuts)], 1)

    def evidence(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of good for every line, from itself and its neighbours."""
        which = np.arange(len(FEATURES))
        own = [self.emit[p][which, bins].sum(1) for p in range(3)]
        ends = np.cumsum(counts)
        score = own[1] + self.bias
        score[1:] += own[0][:-1]
        score[:-1] += own[2][1:]
        first, last = ends - counts, ends - 1
        inner = first[first > 0]
        score[inner] -= own[0][inner - 1]
        score[inner - 1] -= own[2][inner]
        score[first] += self.edge[0]
        score[last] += self.edge[1]
        return score

    def marginals(self, score: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the summed pair probabilities, by forward-backward over all texts at once."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        size = counts[order]
        longest = int(size[0]) if len(size) else 0
        unary = np.stack([np.zeros_like(score), score], 1)
        forward, backward = unary.copy(), np.zeros_like(unary)
        alive = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # texts with more than t lines
        join = lambda m: np.logaddexp(m[:, 0], m[:, 1])
        for t in range(1, longest):
            at = first[: alive[t]] + t
            forward[at] += join(forward[at - 1][:, :, None] + self.step)
        for t in range(longest - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            backward[at] = join((self.step.T[None] + (unary[at + 1] + backward[at + 1])[:, :, None]))
        both = forward + backward
        good = c.sigmoid(both[:, 1] - both[:, 0])
        tail = np.zeros(len(score), bool)
        tail[np.cumsum(counts) - 1] = True
        at = np.flatnonzero(~tail)
        pair = forward[at][:, :, None] + self.step + (unary[at + 1] + backward[at + 1])[:, None, :]
        pair -= np.logaddexp.reduce(pair.reshape(len(at), 4), axis=1)[:, None, None] if len(at) else 0
        return good, np.exp(pair).sum(0)

    def raw(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each text."""
        if not len(counts):
            return np.zeros(0)
        good, _ = self.marginals(self.evidence(self.bins(features), counts), counts)
        weight = np.maximum(1.0, np.expm1(features[:, 0].astype(float)))
        first = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return c.sigmoid(self.slope * self.raw(*line_features(texts)) + self.shift)


def _train(model: LineField, features: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.05) -> None:
    rng = np.random.default_rng(5)
    bins, first = model.bins(features), np.cumsum(counts) - counts
    state = [np.zeros_like(x) for x in (model.emit, model.edge, model.step, np.zeros(1))]
    which = np.arange(len(FEATURES))
    by_size = np.argsort(counts, kind="stable")
    groups = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            docs = groups[g]
            n = counts[docs]
            at = c.ragged(first[docs], n)
            label, w = np.repeat(y[docs], n), np.repeat(weight[docs], n)
            score = model.evidence(bins[at], n)
            good, _ = model.marginals(score, n)
            error = (label - good) * w / len(docs)
            emit = np.zeros_like(model.emit)
            ends = np.cumsum(n)
            head, tail = np.zeros(len(at), bool), np.zeros(len(at), bool)
            head[ends - n], tail[ends - 1] = True, True
            own = bins[at]
            np.add.at(emit[1], (which, own), error[:, None])
            np.add.at(emit[0], (which, own[:-1]), (error[1:] * ~head[1:])[:, None])
            np.add.at(emit[2], (which, own[1:]), (error[:-1] * ~tail[:-1])[:, None])
            step = np.zeros((2, 2))
            for cls in (0, 1):
                on = y[docs] == cls
                if on.any():
                    _, pairs = model.marginals(model.evidence(bins[c.ragged(first[docs[on]], n[on])], n[on]), n[on])
                    step[cls, cls] += (n[on] - 1).sum()
                    step -= pairs
            grads = [emit, np.array([error[head].sum(), error[tail].sum()]), step / len(docs), np.array([error.sum()])]
            for target, square, grad, decay in zip((model.emit, model.edge, model.step), state, grads, (1e-4, 0, 1e-3)):
                grad = grad - decay * target
                square += grad**2
                target += rate * grad / np.sqrt(square + 1e-8)
            state[3] += grads[3] ** 2
            model.bias += float(rate * grads[3][0] / np.sqrt(state[3][0] + 1e-8))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 12) -> LineField:
    """Learn from at most ``per_class`` labelled documents of each class, one in four of them held back to calibrate."""
    c.small_batches(docs.sparkSession)
    sample, rates = c.labelled_sample(docs, labels, "quality", per_class)
    model = LineField()
    if len(rates) < 2:
        model.constant = float(0 not in rates)
        return model

    def extract(batches):
        for batch in batches:
            for part in c.chunks(batch, limit=_CHUNK):
                x, counts = line_features(part.column("text"))
                ends = np.append(0, np.cumsum(counts) * x.shape[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "y", "x"])

    sample = sample.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(extract, "doc_id long, y int, x array<float>")
    table = sample.toArrow().sort_by("doc_id")
    if not len(table):
        model.constant = rates[1] / sum(rates.values())
        return model
    y = table.column("y").to_numpy().astype(int)
    column = table.column("x").combine_chunks()
    counts = column.value_lengths().to_numpy() // len(FEATURES)
    features = column.flatten().to_numpy().reshape(-1, len(FEATURES))
    first = np.cumsum(counts) - counts
    weight = np.where(y > 0, rates[1] / max(1, y.sum()), rates[0] / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    held = np.arange(len(y)) % 4 == 0
    rows = c.ragged(first[~held], counts[~held])
    model.cuts = [np.unique(np.quantile(features[rows, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(len(FEATURES))]
    _train(model, features[rows], counts[~held], y[~held], np.ones(int((~held).sum())), epochs)
    z = model.raw(features[c.ragged(first[held], counts[held])], counts[held])
    model.slope, model.shift = c.platt(z, y[held], weight[held])
    del table, column, features
    c.give_back()  # the driver lives on
    return model


def score(docs: DataFrame, model: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` and score and good (score at least ``threshold``)."""
    c.small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = c.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), limit=_CHUNK)
        return pa.array(np.concatenate([np.zeros(0), *(model.score(p.column("text")) for p in parts)]), pa.float64())

    return docs.withColumn("score", run("text")).withColumn("good", F.col("score") >= threshold)


def op4_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = c.crc_mod(F.col("doc_id"), 5)
    scored = score(docs.select("doc_id", "text"), fit(docs, labels.filter(fold != 0)))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_crf_line_quality": op4_crf_line_quality}
ORACLES: dict[str, str] = {}
