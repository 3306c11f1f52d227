"""SentencePiece encoding with seeded merge-dropout, and its exact inverse.

Merges come from an agenda ordered by the model's scores. Each candidate, that
is a start within its segment and the piece that would result, is skipped for
good if a hash keyed by the seed, the document (doc_id and text) and the
segment's place in the text falls below ``dropout``; so one word is cut in
several ways within one run, another seed gives another segmentation of the same
text, and ``dropout`` 0 gives the model's own.
Spaces are carried as the model's mark, characters without a piece as their
UTF-8 bytes, and a mark that stands in the text as its bytes too, so every
encoding decodes to the text it came from.

A text is cut before its spaces and around its line breaks, which no piece
crosses. All segments of a few hundred KB of texts run their agendas side by side,
one merge of each in a pass over NumPy columns, with all draws of a pass taken at
once; nothing is kept from one to the next, so rare words cost what frequent ones
do. Segments beyond ``WIDE`` characters run theirs alone.

Edge cases: a null or empty text has no pieces and decodes to an empty text; a
null doc_id is kept; rows equal in doc_id and text are encoded alike; other columns
are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

MARK = "▁"
DROPOUT, SEED = 0.1, 1
#: Bytes of texts that are taken at once.
_CHUNK = 1 << 19
#: Longest segments that run side by side, in classes of these widths.
_WIDTHS = (4, 6, 8, 12, 16, 24, 40, 64)
WIDE = _WIDTHS[-1]
_IDLE = np.int32(2**31 - 1)
#: Stands for a mark in the text itself: valid UTF-8 cannot hold it.
_OWN_MARK = "\ud800"
#: Segments up to this length keep their agenda as a list, longer ones as a heap.
SHORT = 24
_NEVER = float("inf")
_CUT = re.compile(f"{MARK}*[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_P1, _P2, _P3, _P4, _P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << bits) | (x >> (32 - bits))


def _digests(n: int, word: Callable[[int], np.ndarray], h: np.ndarray) -> np.ndarray:
    """32-bit xxHash of strings of ``n`` bytes under seeds h; word(k) gives their bytes from 4 * k on as numbers."""
    at = n // 16 * 4
    if at:
        lanes = [h + (_P1 + _P2) % 2**32, h + _P2, h, h - _P1]
        for k in range(at):
            lanes[k % 4] = _rotated(lanes[k % 4] + word(k) * _P2, 13) * _P1
        h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18) + n
    else:
        h = h + (_P5 + n)
    for k in range(at, n // 4):
        h = _rotated(h + word(k) * _P3, 17) * _P4
    last = word(n // 4) if n % 4 else None
    for i in range(n % 4):
        h = _rotated(h + ((last >> (8 * i)) & 0xFF) * _P5, 11) * _P1
    h = (h ^ (h >> 15)) * _P2
    h = (h ^ (h >> 13)) * _P3
    return h ^ (h >> 16)


def _by_size(sizes: np.ndarray, seeds: np.ndarray, word: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """32-bit xxHash of strings of these sizes; word(which, k) as for ``_digests``."""
    order = np.argsort(sizes, kind="stable")
    seeds, out, to = seeds[order], np.empty(len(order), np.uint32), 0
    for n, many in enumerate(np.bincount(sizes).tolist()):
        if many:
            on = order[to : to + many]
            out[on] = _digests(n, lambda k, on=on: word(on, k), seeds[to : to + many])
            to += many
    return out


class _Merges:
    """The model's pieces as columns by symbol: a piece's id, or a number for another single character."""

    def __init__(self, rank: dict[str, float], ids: dict[str, int], size: int):
        chars = {x for piece in rank for x in piece}
        symbols = ids | {x: size + i for i, x in enumerate(sorted(chars - ids.keys()))}
        #: Below ``size`` a symbol is a piece; ``other`` is any character that no piece holds, and no character.
        self.size, self.other = size, size + len(chars)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for x in chars:
            self.of_char[ord(x)] = symbols[x]
        self.order = np.zeros(size, np.int32)
        self.order[list(ids.values())] = np.unique([rank[p] for p in ids], return_inverse=True)[1]
        raw = {ids[p]: p.encode() for p in ids}
        self.sizes = np.zeros(size, np.uint16)
        self.words = np.zeros((max(map(len, raw.values()), default=0) // 4 + 1, size), np.uint32)
        for i, x in raw.items():
            self.sizes[i] = len(x)
            self.words[: len(x) // 4 + 1, i] = np.frombuffer(x.ljust(len(x) // 4 * 4 + 4, b"\0"), "<u4")
        pairs = {}
        for piece, made in ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = made
        # an open table: a pair stands at its slot or in the next free one
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.pair, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.array(list(pairs), np.int64)
        for key, slot, made in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.pair[slot] >= 0:
                slot = (slot + 1) % (1 << self.bits)
            self.pair[slot], self.made[slot] = key, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make; -1 if none."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found = self.pair[slot]
        out = np.where(found == key, self.made[slot], -1)
        rest = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.pair[slot]
            on = found == key[rest]
            out[rest[on]] = self.made[slot[on]]
            more = ~on & (found >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def candidates(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """For each two symbols their place in the agenda (order, then start; _IDLE: none, or skipped) and the piece."""
        made = self.merged(a, b)
        on = np.flatnonzero(made >= 0)
        if limit:
            found = made[on]
            drawn = _by_size(self.sizes[found], key[on] + start[on].astype(np.uint32), lambda which, k: self.words[k][found[which]])
            on = on[drawn >= limit]
        agenda = np.full(len(made), _IDLE)
        agenda[on] = self.order[made[on]] * 128 + start[on]
        return agenda, made

    def run(self, symbols: np.ndarray, length: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
        """Merges the columns of ``symbols`` (place x segment), each by its own agenda; what is merged away becomes -1."""
        width, n = symbols.shape
        out = np.empty((width, n), np.int32)
        here = np.arange(n)
        # one row more, of no character, stands before the first and after the last
        sym = np.concatenate([symbols, np.full((1, n), self.other, np.int32)])
        after = np.repeat(np.arange(1, width + 2, dtype=np.int16)[:, None], n, 1)
        before = np.repeat(np.arange(-1, width, dtype=np.int16)[:, None], n, 1)
        before[0] = width
        agenda, made = np.full((width + 1, n), _IDLE), np.full((width + 1, n), -1, np.int32)
        at, on = np.nonzero(np.arange(1, width)[:, None] < length)
        agenda[at, on], made[at, on] = self.candidates(sym[at, on], sym[at + 1, on], at, key[on], limit)
        while True:
            best = agenda[:width].min(0)
            on = np.flatnonzero(best != _IDLE)
            if len(on) < 0.8 * len(here):
                out[:, here] = sym[:width]
                sym, after, before, agenda, made = (x.take(on, 1) for x in (sym, after, before, agenda, made))
                here, key, best, on = here[on], key[on], best[on], np.arange(len(on))
            if not len(on):
                break
            m = len(here)
            s, f, p, g, t = (x.reshape(-1) for x in (sym, after, before, agenda, made))
            i = (best[on] & 127).astype(np.int64)
            ai = i * m + on
            aj = f[ai].astype(np.int64) * m + on
            k, b, new = f[aj].astype(np.int64), p[ai].astype(np.int64), t[ai]
            ak, ab = k * m + on, b * m + on
            s[ai], s[aj], g[aj] = new, -1, _IDLE
            f[ai], p[ak] = k, i
            place, piece = self.candidates(np.append(new, s[ab]), np.append(s[ak], new), np.append(i, b), np.append(key[on], key[on]), limit)
            g[ai], t[ai] = place[: len(on)], piece[: len(on)]
            g[ab], t[ab] = place[len(on) :], piece[len(on) :]
            p[width * m + on] = width
        out[:, here] = sym[:width]
        return out


class PieceCodec:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of, self.rank, self.id, self.byte_id = [b""] * size, {}, {}, [model.unk_id()] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece], self.id[piece] = -model.get_score(i), i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        #: No piece holds a line break: segments end there as well.
        self.breaks = not any("\n" in piece for piece in self.rank)
        if any(b == model.unk_id() for b in self.byte_id):
            raise ValueError("the model lacks byte pieces, without which texts would be lost")
        self.limit, self.seed = int(dropout * 2**32), seed
        self.table, self.byte_ids = _Merges(self.rank, self.id, size), np.array(self.byte_id, np.uint32)

    def _candidate(self, key: int, segment: str, start: int, end: int) -> float:
        """Rank of the merge that would make segment[start:end]; infinite if there is none or it is skipped."""
        piece = segment[start:end]
        rank = self.rank.get(piece)
        return _NEVER if rank is None or (self.limit and xxhash.xxh32_intdigest(piece, key + start) < self.limit) else rank

    def merges(self, segment: str, place: int | None = None) -> list[int]:
        """Ends of the pieces of one segment, by agenda: best rank first, then leftmost; ``place`` stands for the seed."""
        n = len(segment)
        key = xxhash.xxh32_intdigest(segment, self.seed if place is None else place) if self.limit else 0
        return self._short(segment, n, key) if n <= SHORT else self._long(segment, n, key)

    def _short(self, segment: str, n: int, key: int) -> list[int]:
        rank, limit, digest, never = self.rank.get, self.limit, xxhash.xxh32_intdigest, _NEVER
        bounds = list(range(n + 1))
        agenda = []
        for i in range(n - 1):
            piece = segment[i : i + 2]
            r = rank(piece)
            agenda.append(never if r is None or (limit and digest(piece, key + i) < limit) else r)
        while agenda and (best := min(agenda)) != never:
            k = agenda.index(best)
            del bounds[k + 1], agenda[k]
            if k < len(agenda):
                i = bounds[k]
                piece = segment[i : bounds[k + 2]]
                r = rank(piece)
                agenda[k] = never if r is None or (limit and digest(piece, key + i) < limit) else r
            if k:
                i = bounds[k - 1]
                piece = segment[i : bounds[k + 1]]
                r = rank(piece)
                agenda[k - 1] = never if r is None or (limit and digest(piece, key + i) < limit) else r
        return bounds[1:]

    def _long(self, segment: str, n: int, key: int) -> list[int]:
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 2) for i in range(n - 1) if (r := self._candidate(key, segment, i, i + 2)) != _NEVER]
        heapq.heapify(agenda)
        while agenda:
            _, i, end = heapq.heappop(agenda)
            if not stop[i] or (j := after[i]) >= n or stop[j] != end:
                continue  # one of the two has been merged meanwhile
            stop[i], stop[j] = end, 0
            after[i] = after[j]
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self._candidate(key, segment, a, stop[b])) != _NEVER:
                    heapq.heappush(agenda, (r, a, stop[b]))
            if after[i] < n:
                before[after[i]] = i
        return [x for x in stop if x]

    def _node(self, segment: str) -> str:
        return segment

    def _at(self, segment: str, place: int) -> bytes:
        """Ids of a segment at one place."""
        first = np.zeros(1, np.int64)
        return self._drawn(segment, first, np.array([place], np.uint32), np.array([len(segment)]))[0].tobytes()

    def _drawn(self, text: str, first: np.ndarray, place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of ``text`` that begin at ``first``, and how many there are up to each of ``ends``."""
        table = self.table
        char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\0\0\0\0", np.uint8).copy()
        wide = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        byte = np.append(0, np.cumsum(wide))
        own = byte[:-1][char == ord(_OWN_MARK)]
        data[own[:, None] + np.arange(3)] = np.frombuffer(MARK.encode(), np.uint8)
        symbol = table.of_char[char]
        length = np.diff(first, append=len(char))
        key = np.zeros(len(first), np.uint32)
        if self.limit:
            words = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
            some = np.flatnonzero((length > 1) & (length <= WIDE))
            start = byte[first[some]]
            key[some] = _by_size((byte[first[some] + length[some]] - start).astype(np.uint16), place[some], lambda which, k: words[start[which] + 4 * k])
        low = 1
        for width in _WIDTHS:
            on = np.flatnonzero((length > low) & (length <= width))
            low = width
            if len(on):
                at = first[on] + np.arange(width)[:, None]
                inside = np.arange(width)[:, None] < length[on]
                found = table.run(np.where(inside, symbol[np.minimum(at, len(char) - 1)], table.other), length[on], key[on], self.limit)
                symbol[at[inside]] = found[inside]
        for i in np.flatnonzero(length > WIDE).tolist():
            segment = text[first[i] : first[i] + length[i]]
            last = self.merges(segment, int(place[i]))
            part = np.full(length[i], -1, np.int32)
            part[[0, *last[:-1]]] = [self.id.get(segment[a:b], table.other) for a, b in zip([0, *last], last)]
            symbol[first[i] : first[i] + length[i]] = part
        # a symbol that is no piece is a character: its bytes
        plain = symbol >= table.size
        count = np.where(plain, wide, symbol >= 0)
        to = np.append(0, np.cumsum(count))
        out = np.empty(int(to[-1]), np.uint32)
        one = np.flatnonzero((symbol >= 0) & ~plain)
        out[to[one]] = symbol[one]
        many = np.flatnonzero(plain)
        out[c.ragged(to[many], wide[many])] = self.byte_ids[data[c.ragged(byte[many], wide[many])]]
        return out, to[ends]

    def _ids(self, segment: str, ends: list[int]) -> bytes:
        ids: list[int] = []
        start = 0
        for end in ends:
            found = self.id.get(segment[start:end])
            if found is None:
                ids += [self.byte_id[b] for b in segment[start:end].encode()]
            else:
                ids.append(found)
            start = end
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None, doc: str | None = None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return self.encode_all([text], [doc])[0]

    def encode_all(self, texts: Sequence[str | None], docs: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts, sizes, cuts, bases = [], [], [], []
        for text, doc in zip(texts, docs):
            if text and MARK in text:
                segments = self._marked(text)
                parts += segments
                cuts.append((sum(sizes), np.cumsum([0, *map(len, segments)])))
                sizes.append(int(cuts[-1][1][-1]))
            else:
                parts.append(MARK + text.replace(" ", MARK) if text else "")
                sizes.append(len(parts[-1]))
            bases.append(xxhash.xxh32_intdigest(text, xxhash.xxh32_intdigest("" if doc is None else f"={doc}", self.seed)) if text and self.limit else 0)
        whole, ends = "".join(parts), np.cumsum(sizes)
        char = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(char):
            return [b""] * len(sizes)
        mark, begins = char == ord(MARK), ends - sizes
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        if self.breaks:
            line = char == 10
            start |= line
            start[1:] |= line[:-1]
        for at, cut in cuts:
            start[at : at + cut[-1]] = False
            start[at + cut[:-1]] = True
        start[begins[np.array(sizes) > 0]] = True
        first = np.flatnonzero(start)
        many = np.diff(np.searchsorted(first, ends), prepend=0)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        place = (np.repeat(np.array(bases, np.int64), many) + nth).astype(np.uint32)
        ids, to = self._drawn(whole, first, place, ends)
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *to.tolist()], to.tolist())]

    def _marked(self, text: str) -> list[str]:
        """The segments of a text that itself holds the mark: the mark travels as its bytes."""
        out: list[str] = []
        for k, part in enumerate(re.split(f"([{MARK}])", text)):
            if part == MARK:
                out.append(_OWN_MARK)
            elif part or k == 0:
                lead = MARK if k == 0 else ""
                for s in _CUT.findall(lead + part.replace(" ", MARK)):
                    out += [x for x in (re.split("(\n)", s) if self.breaks and s[:1] == MARK else [s]) if x]
        return out

    def decode(self, ids: bytes) -> str:
        """The text that ``encode`` was given."""
        table = self.bytes_of
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


_codecs: dict[tuple, PieceCodec] = {}


def codec(path: str, dropout: float, seed: int) -> PieceCodec:
    """One codec per worker process and setting."""
    key = (path, dropout, seed)
    if key not in _codecs:
        _codecs[key] = PieceCodec(*key)
    return _codecs[key]


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """(doc_id, text, ids): ids as little-endian unsigned 32-bit bytes."""
    model = model or default_model()
    c.small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def run(texts: pa.Array, ids: pa.Array) -> pa.Array:
        take = codec(model, dropout, seed).encode_all
        parts = c.chunks(pa.RecordBatch.from_arrays([texts, ids], ["text", "doc"]), limit=_CHUNK)
        return pa.array([x for p in parts for x in take(p.column("text").to_pylist(), p.column("doc").to_pylist())], pa.binary())

    return docs.select("doc_id", "text").withColumn("ids", run("text", F.col("doc_id").cast("string")))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded, the text of ``ids``."""
    model = model or default_model()

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        take = codec(model, 0.0, 0).decode
        return pa.array([take(x.as_py() or b"") for x in ids], pa.string())

    return encoded.withColumn("decoded", run("ids"))


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and lossless of every document at the default dropout and seed."""
    docs = decode(encode(c.documents(spark, sf_dir)))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), lossless.alias("lossless"))


QUERIES = {"op2_sentencepiece_dropout": op2_sentencepiece_dropout}
ORACLES: dict[str, str] = {}
