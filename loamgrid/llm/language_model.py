"""A Brown class-based bigram model of the corpus and its scores.

Every word that the training documents hold ``min_count`` times or more gets a
class by exchange; a word that occurs once has no company to be known by, so it
stands for the unknown words and shares a class with those of its shape (length
and last character). Texts are first turned into numbers of the ``lookup_words`` most frequent words; the rest of a
text's words, which no single task could hold, stay beside them. Then

1. the ``seed_words`` most frequent words are moved one by one, on the driver,
   to whichever class raises the likelihood of their full bigram counts most;
2. all further frequent words are placed in rounds on executors: a word's
   neighbours' classes are gathered over all training texts, and it moves to the
   class with the largest gain, with the class counts as they were before the
   round (words are independent of one another given these);
3. every rarer word is placed in the same way, once the classes of the frequent
   ones are final; this table has no bound but the input.

A neighbour that is not among the frequent words counts as one class of its own
while words are placed. The model itself counts the classes of all words: a
text's probability is the product of class transitions and word emissions, both
smoothed.

What is gathered grows with the input (word counts, neighbour classes, the table
of rarer words); the parameters bound only what one task or the driver holds.

Edge cases: a null or empty text is the end token alone; a null doc_id counts as
training; rows that repeat a doc_id are scored each on its own; with no training
text every count is 0; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Words placed on the driver, classes (at most 220), and words that every task knows.
SEED_WORDS, CLASSES, LOOKUP_WORDS = 2048, 64, 200_000
#: Occurrences from which a word is placed by exchange.
MIN_COUNT = 2
#: Rounds over the frequent words after the seed.
ROUNDS = 2
SHAPES = 32
#: Emission smoothing of shape classes, and weight of a class's own rate in transitions.
EMIT, CARRY = 0.5, 20.0
#: The end of a document: no word contains a line break.
END = b"\n"
_FLUSH = 300_000
#: Tokens of one vectorised pass.
_TOKENS = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def shape(word: bytes) -> int:
    return min(len(word), 16) - 1 + 16 * (word[-1] < 0x30)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): counts over all of ``docs``; tasks add up before the shuffle."""
    c.small_batches(docs.sparkSession)

    def count(batches):
        seen: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
                if len(seen) > _FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- texts as numbers ---------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from -1 to 2**24 - 2, the low bytes of all first: most high bytes are 0 and compress to nothing."""
    return np.ascontiguousarray((x + 1).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return (low | middle << 8 | high << 16) - 1


def numbered(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(nth, row, train, ids, rest, shapes, which) for ``docs`` (row, train, text).

    ``ids`` holds for each token its place in ``words``, which end with END, or
    -1. ``rest`` lists the text's other words, each once, ``shapes`` the shapes of
    these, and ``which`` says for every -1, in order, which of them stands there.
    """
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # lookup_words of them at most

    def run(batches):
        find = {w: i for i, w in enumerate(shared.value)}.get
        for batch in batches:
            ids, rests, shapes, which = [], [], [], []
            for text in batch.column("text"):
                listed = tokens(text.as_py())
                row = np.fromiter(map(find, listed, repeat(-1)), "<i4", len(listed))
                rest: dict[bytes, int] = {}
                which.append(_planes(np.array([rest.setdefault(listed[i], len(rest)) for i in np.flatnonzero(row < 0)], np.int32)))
                ids.append(_planes(row))
                rests.append(list(rest))
                shapes.append(bytes(map(shape, rest)))
            columns = [batch.column("nth"), batch.column("row"), batch.column("train"), pa.array(ids, pa.binary()), pa.array(rests, pa.list_(pa.binary())), *(pa.array(x, pa.binary()) for x in (shapes, which))]
            yield pa.RecordBatch.from_arrays(columns, ["nth", "row", "train", "ids", "rest", "shapes", "which"])

    source = docs.withColumn("nth", F.monotonically_increasing_id()).select("nth", "row", "train", "text")
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"nth long, row {kind}, train boolean, ids binary, rest array<binary>, shapes binary, which binary")


def _lines(batches, *columns: str) -> Iterator[tuple]:
    """Per pass: neighbouring ids of all its texts as one array, and the batch's other columns with it.

    Every text is preceded by END (-2 here), so that no pair crosses texts.
    """
    for batch in batches:
        held = [x.as_py() for x in batch.column("ids")]
        at = 0
        while at < len(held):
            stop, size = at, 0
            while stop < len(held) and (stop == at or size + len(held[stop]) <= 3 * _TOKENS):
                size += len(held[stop])
                stop += 1
            texts = [_numbers(x) for x in held[at:stop]]
            flat = np.full(size // 3 + len(texts), -2, np.int32)
            ends = np.cumsum([len(t) + 1 for t in texts])
            for t, e in zip(texts, ends.tolist()):
                flat[e - len(t) : e] = t
            yield (flat, *(batch.column(k).slice(at, stop - at) for k in columns))
            at = stop


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def pair_counts(ids: DataFrame, group: np.ndarray) -> np.ndarray:
    """Counts of neighbouring groups over ``ids``; group[i] is that of word i, the last but one that of END, the last that of the rest."""
    size = int(group.max()) + 1
    shared = ids.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        table = np.append(shared.value, shared.value[-2])  # index -2 is the rest's, -1 that of the END before a text
        for (flat,) in _lines(batches):
            at = table[np.where(flat == -1, len(table) - 2, np.where(flat == -2, len(table) - 1, flat))].astype(np.int64)
            keys = (at[:-1] * size + at[1:])[flat[1:] != -2]
            cell, n = _sums(keys)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    found = ids.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


# --- exchange -----------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def exchange(bigrams: np.ndarray, movable: int, classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each id: the first ``movable`` move to whichever class raises the bigram likelihood most, the others keep one of their own."""
    size = len(bigrams)
    group = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    total = classes + size - movable
    table = np.zeros((total, total))
    np.add.at(table, (group[:, None], group[None, :]), bigrams)
    f = _xlogx
    right = np.stack([np.bincount(group, row, total) for row in bigrams[:movable]]) if movable else np.zeros((0, total))
    left = np.stack([np.bincount(group, row, total) for row in bigrams[:, :movable].T]) if movable else np.zeros((0, total))
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moves = 0
        for w in range(movable):
            a, same = group[w], float(bigrams[w, w])
            r, q = right[w].copy(), left[w].copy()
            r[a] -= same
            q[a] -= same
            table[a] -= r
            table[:, a] -= q
            table[a, a] -= same
            rows, columns = table[:classes], table[:, :classes].T
            gain_r, gain_q = f(rows + r) - f(rows), f(columns + q) - f(columns)
            own = table[diagonal, diagonal]
            gain = gain_r.sum(1) + gain_q.sum(1) - gain_r[diagonal, diagonal] - gain_q[diagonal, diagonal]
            gain += f(own + r[:classes] + q[:classes] + same) - f(own)
            out, into = rows.sum(1), columns.sum(1)
            gain -= f(out + r.sum() + same) - f(out) + f(into + q.sum() + same) - f(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            table[b] += r
            table[:, b] += q
            table[b, b] += same
            if b != a:
                moves += 1
                group[w] = b
                n = bigrams[:movable, w]
                right[:, a] -= n
                right[:, b] += n
                n = bigrams[w, :movable]
                left[:, a] -= n
                left[:, b] += n
        if not moves:
            break
    return group


class Gains:
    """What each class would gain from a word, by the word's neighbours' classes and fixed class counts."""

    def __init__(self, table: np.ndarray, classes: int, small: int = 16):
        self.table, self.classes, self.small = table, classes, small
        sides = np.stack([table[:classes].T, table[:, :classes]])  # side, neighbour, class
        self.sides = sides
        n = np.arange(1, small + 1)[:, None, None, None]
        self.gain = (_xlogx(sides[None] + n) - _xlogx(sides[None])).astype(np.float32)
        self.out, self.into = table[:classes].sum(1), table[:, :classes].sum(0)

    def entries(self, side: np.ndarray, near: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Gain of every class (columns) from each entry; ``own`` is the class that the counts now hold it in, or -1."""
        few = n <= self.small
        out = np.empty((len(n), self.classes), np.float32)
        out[few] = self.gain[n[few] - 1, side[few], near[few]]
        base = self.sides[side[~few], near[~few]]
        out[~few] = _xlogx(base + n[~few, None]) - _xlogx(base)
        held = np.flatnonzero(own >= 0)
        base = self.sides[side[held], near[held], own[held]]
        out[held, own[held]] = _xlogx(base) - _xlogx(np.maximum(0, base - n[held]))
        return out

    def best(self, word: np.ndarray, side: np.ndarray, near: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class of each word; entries are sorted by word, and ``own`` is by word."""
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
        size = np.diff(np.append(first, len(word)))
        total = np.add.reduceat(self.entries(side, near, n, np.repeat(own, size)), first, axis=0) if len(word) else np.zeros((0, self.classes))
        for s, held in enumerate((self.out, self.into)):
            m = np.add.reduceat(n * (side == s), first)[:, None] if len(word) else np.zeros((0, 1))
            without = np.broadcast_to(held, total.shape).copy()
            rows = np.flatnonzero(own >= 0)
            without[rows, own[rows]] = np.maximum(0, without[rows, own[rows]] - m[rows, 0])
            total = total - (_xlogx(without + m) - _xlogx(without))
        return total.argmax(1)


def frequent_contexts(ids: DataFrame, group: np.ndarray, first: int, stop: int) -> DataFrame:
    """(key int, code int, n long): before * size + after, the neighbours' groups of words ``first`` to ``stop``; added up within a pass."""
    size = int(group.max()) + 1
    shared = ids.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        end, rest = shared.value[-2], shared.value[-1]
        for (flat,) in _lines(batches):
            near = np.where(flat == -1, rest, np.where(flat == -2, end, shared.value[np.maximum(flat, 0)])).astype(np.int64)
            at = np.flatnonzero((flat >= first) & (flat < stop))
            keys, n = _sums(flat[at] * np.int64(size * size) + near[at - 1] * size + near[at + 1])
            word, code = np.divmod(keys, size * size)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "code", "n"])

    return ids.select("ids").mapInArrow(run, "key int, code int, n long")


def rare_contexts(ids: DataFrame, group: np.ndarray) -> DataFrame:
    """(key binary, code int, n long) of every token that is not among the frequent words; added up within a pass."""
    size = int(group.max()) + 1
    shared = ids.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        end, rest = shared.value[-2], shared.value[-1]
        for flat, words, which in _lines(batches, "rest", "which"):
            near = np.where(flat == -1, rest, np.where(flat == -2, end, shared.value[np.maximum(flat, 0)])).astype(np.int64)
            at = np.flatnonzero(flat == -1)
            base = np.cumsum([0, *pc.list_value_length(words).to_pylist()])
            place = np.concatenate([np.zeros(0, np.int64), *(_numbers(x.as_py()) + b for x, b in zip(which, base.tolist()))])
            known = words.flatten().dictionary_encode()  # a text lists a word once, a pass may hold it in many texts
            number = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n = _sums(number[place] * (size * size) + near[at - 1] * size + near[at + 1])
            word, code = np.divmod(keys, size * size)
            yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(word)), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "code", "n"])

    return ids.select("ids", "rest", "which").mapInArrow(run, "key binary, code int, n long")


def place(contexts: DataFrame, table: np.ndarray, classes: int, own: np.ndarray | None = None) -> DataFrame:
    """(key, n, class): the class with the largest gain for each key of ``contexts``.

    One shuffle by key; a task reads its keys in order and holds one word's
    counts over an end of a batch, at most one for each side and class.
    """
    size, kind = len(table), contexts.schema["key"].dataType.simpleString()
    shared = contexts.sparkSession.sparkContext.broadcast((Gains(table, classes), own))

    def run(batches):
        gains, held = shared.value
        last, carry = None, None  # the key that the batch before ended with, and its counts by side and class

        def settled(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Counts by word, side and neighbour: side 0 is what stands after a word, side 1 what stands before."""
            before, after = np.divmod(code, size)
            whole = np.concatenate([word * 2 * size + size + before, word * 2 * size + after])
            cell, back = np.unique(whole, return_inverse=True)
            count = np.bincount(back, np.concatenate([n, n]), len(cell)).astype(np.int64)
            return cell, count

        def decide(keys: pa.Array, cell: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            word, part = np.divmod(cell, 2 * size)
            mine = np.full(len(keys), -1) if held is None else held[keys.to_numpy()]
            side = part // size
            chosen = gains.best(word, side, part % size, count, mine)
            total = np.bincount(word, count * (side == 0), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([keys, pa.array(total), pa.array(chosen.astype(np.int32))], ["key", "n", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            fresh = np.append(True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))
            keys = key.take(pa.array(np.flatnonzero(fresh)))
            cell, count = settled(np.cumsum(fresh) - 1, batch.column("code").to_numpy(), batch.column("n").to_numpy())
            if carry is not None:
                if keys[0].as_py() == last.as_py():
                    cell, back = np.unique(np.concatenate([carry[0], cell]), return_inverse=True)
                    count = np.bincount(back, np.concatenate([carry[1], count]), len(cell)).astype(np.int64)
                else:
                    yield decide(pa.array([last.as_py()], key.type), *carry)
            done = int(np.searchsorted(cell, (len(keys) - 1) * 2 * size))
            if len(keys) > 1:
                yield decide(keys.slice(0, len(keys) - 1), cell[:done], count[:done])
            last, carry = keys[len(keys) - 1], (cell[done:] - (len(keys) - 1) * 2 * size, count[done:])
        if carry is not None:
            yield decide(pa.array([last.as_py()], last.type), *carry)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key {kind}, n long, class int")


# --- the model ----------------------------------------------------------------


@dataclass
class ClassModel:
    """Classes by exchange come first, then those of the shapes, then END's.

    ``words`` are the frequent ones with END last; ``seen`` their counts and
    ``group`` their classes; ``rare`` has word, n and class of all others.
    """

    words: list[bytes]
    seen: np.ndarray
    group: np.ndarray
    rare: DataFrame
    classes: int
    train_tokens: int
    vocabulary: int
    #: Distinct words of each shape's class.
    distinct: np.ndarray


def lookup(counts: DataFrame, limit: int = LOOKUP_WORDS) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, most frequent first, and their counts; END is always there, as the last."""
    table = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(limit).toArrow()
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [*table.column("word").to_pylist(), END], np.append(table.column("n").to_numpy(), end).astype(np.int64)


def fit(ids: DataFrame, counts: DataFrame, words: list[bytes], seen: np.ndarray, seed_words: int = SEED_WORDS, classes: int = CLASSES, rounds: int = ROUNDS, min_count: int = MIN_COUNT) -> ClassModel:
    """``ids``: numbered training texts; ``counts``: their word_counts; ``words`` and ``seen``: lookup of these."""
    frequent = len(words) - 1
    movable = int((seen[:frequent] >= min_count).sum())  # the most frequent come first
    seeds = min(seed_words, movable)
    classes = min(classes, max(1, seeds))
    number = np.arange(frequent)
    # while the seed is placed every word of it is a group, then END is one, then the rest
    alone = np.append(np.minimum(number, seeds + 1), [seeds, seeds + 1])
    alone[seeds:frequent] = seeds + 1
    placed = exchange(pair_counts(ids, alone), seeds, classes)
    end, rest = classes + SHAPES, classes + SHAPES + 1
    group = np.full(frequent + 2, rest, np.int64)
    group[:seeds] = placed[:seeds]
    group[movable:frequent] = classes + np.array([shape(w) for w in words[movable:frequent]], np.int64)
    group[frequent] = end
    for turn in range(rounds if movable > seeds else 0):
        own = None if turn == 0 else group[:frequent]
        found = place(frequent_contexts(ids, group, seeds, movable), pair_counts(ids, group), classes, own).toArrow()
        group = group.copy()
        group[found.column("key").to_numpy()] = found.column("class").to_numpy()
    rare = place(rare_contexts(ids, group), pair_counts(ids, group), classes).withColumnRenamed("key", "word")
    shape_of = F.least(F.octet_length("word"), F.lit(16)) - 1 + 16 * (F.substring("word", -1, 1) < F.lit(b"\x30")).cast("int")
    rare = c.materialize(rare.withColumn("class", F.when(F.col("n") >= min_count, F.col("class")).otherwise(classes + shape_of)), "rare-words")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    distinct = np.bincount(group[movable:frequent] - classes, minlength=SHAPES).astype(float)
    for row in rare.filter(F.col("class") >= classes).groupBy("class").agg(F.count("*").alias("n")).collect():
        distinct[row["class"] - classes] += row["n"]
    return ClassModel(words, seen, group[: frequent + 1], rare, classes, whole[0], whole[1], distinct)


def coded(ids: DataFrame, model: ClassModel) -> DataFrame:
    """(row, train, n_tokens, n_known, base_score, emit, classes): every token's class as a byte, and what does not depend on the class."""
    rest = ids.select("nth", F.posexplode("rest").alias("k", "word")).join(model.rare, "word")
    known = rest.groupBy("nth").agg(F.collect_list(F.struct("k", "n", "class")).alias("known"))
    source = ids.drop("rest").join(known, "nth", "left").select("row", "train", "ids", "shapes", "which", "known")
    shared = ids.sparkSession.sparkContext.broadcast((model.seen, model.group, model.classes, model.train_tokens, model.vocabulary))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches):
        seen, group, shapes, total, vocabulary = shared.value
        zero = np.log10(total + vocabulary + 1)
        log_base = np.log10(seen + 1.0)
        room = lambda cls: np.where((cls >= shapes) & (cls < shapes + SHAPES), EMIT, 0)
        log_emit = np.log10(np.maximum(1e-9, seen + room(group)))
        for batch in batches:
            out, flat = [], batch.column("known").flatten()
            k_, n_, cls_ = (flat.field(x).to_numpy() for x in ("k", "n", "class"))
            stop = np.cumsum(pc.list_value_length(batch.column("known")).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            for ids_, shaped, which, first, last in zip(batch.column("ids"), batch.column("shapes"), batch.column("which"), [0, *stop], stop):
                at, where = _numbers(ids_.as_py()), _numbers(which.as_py())
                cls = np.frombuffer(shaped.as_py(), np.uint8).astype(np.int64) + shapes  # of words that no training text holds
                n = np.zeros(len(cls), np.int64)
                n[k_[first:last]], cls[k_[first:last]] = n_[first:last], cls_[first:last]
                classes = group[np.maximum(at, 0)]
                classes[at < 0] = cls[where]
                inside = at[at >= 0]
                known_here = int((seen[inside] > 0).sum() + (n[where] > 0).sum())
                base = log_base[inside].sum() + np.log10(n[where] + 1).sum() - zero * len(at)
                emit = log_emit[inside].sum() + np.log10(n + room(cls))[where].sum()
                out.append((len(at), known_here, float(base), float(emit), classes.astype(np.uint8).tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("train"), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["row", "train", "n_tokens", "n_known", "base_score", "emit", "classes"])

    return source.mapInArrow(run, f"row {kind}, train boolean, n_tokens long, n_known long, base_score double, emit double, classes binary")


def _neighbours(classes: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x in classes:
        at = np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
        yield np.append(end, at[:-1]), at


def transitions(codes: DataFrame, classes: int) -> np.ndarray:
    """Counts of neighbouring classes over ``codes``, END's last."""
    size = classes + SHAPES + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for a, b in _neighbours(batch.column("classes"), size - 1):
                total += np.bincount(a * size + b, minlength=size * size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    out = np.zeros(size * size)
    for cell, n in codes.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(size, size)


def score(codes: DataFrame, pairs: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """The columns of ``codes`` but its classes, and score: log10 probability by class transitions and word emissions."""
    rate = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    step = np.log10((pairs + CARRY * rate) / (pairs.sum(1, keepdims=True) + CARRY))
    norm = pairs.sum(0)
    norm[-1 - SHAPES : -1] += EMIT * (distinct + 1)  # a shape's class keeps room for one unknown word
    step = step - np.log10(np.maximum(norm, 1e-9))
    end = len(pairs) - 1

    @F.arrow_udf("double")
    def run(classes: pa.Array, emit: pa.Array) -> pa.Array:
        return pa.array([float(step[a, b].sum()) + e for (a, b), e in zip(_neighbours(classes, end), emit.to_pylist())], pa.float64())

    return codes.withColumn("score", run("classes", "emit")).drop("classes", "emit")


def scored(docs: DataFrame, train, seed_words: int = SEED_WORDS, classes: int = CLASSES, lookup_words: int = LOOKUP_WORDS) -> tuple[DataFrame, ClassModel]:
    """row (doc_id, text_hash), train, n_tokens, n_known, base_score and score of every row of ``docs``, learnt from those where ``train`` holds."""
    c.small_batches(docs.sparkSession)
    rows = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("row"), train.alias("train"), "text")
    counts = c.materialize(word_counts(rows.filter("train")), "word-counts")
    words, seen = lookup(counts, lookup_words)
    ids = c.materialize(numbered(rows, words), "numbered")
    model = fit(ids.filter("train"), counts, words, seen, seed_words, classes)
    codes = c.materialize(coded(ids, model), "class-codes")
    return score(codes, transitions(codes.filter("train"), model.classes), model.distinct), model


def op8_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    found, model = scored(docs, c.crc_mod(F.col("doc_id"), 7) != 2)
    return found.select("row.doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op8_brown_class_lm": op8_brown_class_lm}
ORACLES: dict[str, str] = {}
