"""Secrets in texts: rules found through an inverted index of trigrams.

Every rule is a regular expression. From it comes a Boolean query of trigrams that
any match must contain. A block of texts gets an index, for each trigram that some
query names the rows that hold it; the query's postings are intersected and
joined, and only the rows left are searched with the expression itself. A rule
from which no trigram follows is searched for in every row. The index is of bytes
with A-Z lowered and never passes over a match: what it leaves too many, the
expression throws out.

Texts are indexed block by block where they lie: nothing is shuffled or written,
and memory follows the block.

Edge cases: a null or empty text has no spans; ids do not matter and may be null or
repeated; spans are in code points, of the leftmost matches of a rule that do not
overlap one another (those of different rules may); a match whose measured part is
too short is dropped and what it covered is not searched again; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


#: Searched for first and listed first. A run of hex digits is one match, so its length may stand in the expression.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("host_token", r"gh[oprsu]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[aboprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{30,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", r"[a-z]{3,10}://[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{3,64}@"),
)

# --- from an expression to a query of trigrams --------------------------------

#: A query: ANY, a trigram, or ("and" | "or", parts).
ANY = True
#: Strings that a set may hold, and members of a class that are told apart.
STRINGS, MEMBERS = 48, 8


def _join(op: str, parts: Iterable):
    parts = set(parts)
    if op == "and":
        parts.discard(ANY)
        if not parts:
            return ANY
    elif ANY in parts:
        return ANY
    flat = {p for q in parts for p in (q[1] if isinstance(q, tuple) and q[0] == op else [q])}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _holds(strings: set[bytes]):
    """What a text with one of ``strings`` in it must hold."""
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass
class Part:
    """All strings that a part of an expression matches: the strings themselves if they are few, else how they begin and end, and what they must hold."""

    exact: set[bytes] | None
    first: set[bytes]
    last: set[bytes]
    query: object = ANY

    @classmethod
    def of(cls, strings: set[bytes]) -> Part:
        return cls(strings, strings, strings).bounded()

    @classmethod
    def open(cls) -> Part:
        return cls(None, {b""}, {b""})

    def bounded(self) -> Part:
        """With sets that stay small: what they say goes to the query before they are cut."""
        if self.exact is not None and len(self.exact) <= STRINGS:
            return self
        query = _join("and", [self.query, _holds(self.first), _holds(self.last)])
        first, last, n = self.first, self.last, 3
        while n and (len(first) > STRINGS or n == 3):
            n -= 1
            first = {s[:n] for s in first}
        n = 3
        while n and (len(last) > STRINGS or n == 3):
            n -= 1
            last = {s[len(s) - min(n, len(s)) :] for s in last}
        return Part(None, first, last, query)

    def opened(self) -> Part:
        return self if self.exact is None else Part(None, self.exact, self.exact, self.query).bounded()

    def then(self, other: Part) -> Part:
        cross = lambda a, b: {x + y for x in a for y in b}
        if self.exact is not None and other.exact is not None:
            both = cross(self.exact, other.exact)
            return Part(both, both, both, _join("and", [self.query, other.query])).bounded()
        first = cross(self.exact, other.first) if self.exact is not None else self.first
        last = cross(self.last, other.exact) if other.exact is not None else other.last
        return Part(None, first, last, _join("and", [self.query, other.query, _holds(cross(self.last, other.first))])).bounded()

    def either(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None:
            return Part.of(self.exact | other.exact)
        a, b = self.opened(), other.opened()
        return Part(None, a.first | b.first, a.last | b.last, _join("or", [a.query, b.query])).bounded()

    def needs(self):
        return _join("and", [self.query, _holds(self.exact if self.exact is not None else self.first), ANY if self.exact is not None else _holds(self.last)])


def _character(code: int, flags: int) -> bytes | None:
    """A character as it is indexed; None if it may stand for ones beyond its own two cases."""
    x = chr(code)
    if flags & re.IGNORECASE and (not x.isascii() or not flags & re.ASCII):
        return None
    return x.lower().encode() if x.isascii() else x.encode("utf-8", "surrogatepass")


def _class(items, flags: int) -> Part:
    codes: set[int] = set()
    for op, value in items:
        if op is K.LITERAL:
            codes.add(value)
        elif op is K.RANGE and value[1] - value[0] < 4 * MEMBERS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return Part.open()
    found = {_character(x, flags) for x in codes}
    return Part.open() if None in found or len(found) > MEMBERS else Part.of(found)


def _part(items, flags: int) -> Part:
    out = Part.of({b""})
    for op, value in items:
        if op is K.LITERAL:
            x = _character(value, flags)
            next_ = Part.open() if x is None else Part.of({x})
        elif op is K.IN:
            next_ = _class(value, flags)
        elif op is K.BRANCH:
            next_ = reduce(Part.either, (_part(x, flags) for x in value[1]))
        elif op is K.SUBPATTERN:
            next_ = _part(value[3], (flags | value[1]) & ~value[2])
        elif op is K.ATOMIC_GROUP:
            next_ = _part(value, flags)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _part(inner, flags)
            next_ = reduce(Part.then, [one] * min(least, 4), Part.of({b""}))
            if (least, most) == (0, 1):
                next_ = one.either(next_)
            elif most > least or least > 4:
                next_ = Part.open() if not least else next_.opened()
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue  # takes no room
        else:
            next_ = Part.open()
        out = out.then(next_)
    return out


def trigram_query(rule: Rule):
    """What every match of a rule holds, as a query of trigrams; ANY if nothing follows."""
    parsed = _parser.parse(rule.pattern, rule.flags)
    return _part(parsed, parsed.state.flags).needs()


def trigrams(query) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


# --- index and search ---------------------------------------------------------

#: Bytes that are indexed in one step.
_STEP = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Index:
    """Postings of some trigrams over the rows of a block."""

    def __init__(self, data: np.ndarray, row_ends: np.ndarray, wanted: list[bytes]):
        self.rows = len(row_ends)
        codes = np.array([int.from_bytes(t) for t in wanted], np.int64)
        opens = np.zeros(1 << 16, bool)
        opens[codes >> 8] = True
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(data), _STEP):
            x = _LOWER[data[at : at + _STEP + 2]].astype(np.int32)
            x = x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else x[:0]
            some = np.flatnonzero(opens[x >> 8])
            which = np.searchsorted(codes, x[some])
            on = codes[np.minimum(which, len(codes) - 1)] == x[some]
            place = some[on] + at
            row = np.searchsorted(row_ends, place, side="right")
            within = place + 2 < row_ends[row]
            found.append(np.unique(which[on][within] * self.rows + row[within]))
        pairs = np.unique(np.concatenate(found))
        self.postings = {t: pairs[a:b] - k * self.rows for k, (t, a, b) in enumerate(zip(wanted, *(np.searchsorted(pairs, (np.arange(len(wanted)) + i) * self.rows) for i in (0, 1))))}

    def find(self, query) -> np.ndarray:
        """Rows that may hold a match, in order."""
        if query is ANY:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted(map(self.find, query[1]), key=len)
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, lists)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and ``found``: the spans of all rules in a text, by start and then in the order of ``rules``."""
    c.small_batches(docs.sparkSession)
    queries = [trigram_query(rule) for rule in rules]
    wanted = sorted(set().union(*map(trigrams, queries))) or [b"\0\0\0"]

    def run(batches):
        searches = [re.compile(rule.pattern, rule.flags) for rule in rules]
        kinds = pa.array([rule.kind for rule in rules])
        for batch in batches:
            for part in c.chunks(batch):
                texts = part.column("text").to_pylist()
                index = Index(*c.text_bytes(part.column("text")), wanted)
                row, kind, start, end = [], [], [], []
                for k, (rule, query, search) in enumerate(zip(rules, queries, searches)):
                    for i in index.find(query).tolist():
                        for m in search.finditer(texts[i] or ""):
                            low, high = m.span(rule.group)
                            if high - low >= rule.least:
                                row.append(i)
                                kind.append(k)
                                start.append(m.start())
                                end.append(m.end())
                row, kind, start, end = (np.array(x, np.int32) for x in (row, kind, start, end))
                order = np.lexsort((kind, start, row))
                offsets = pa.array(np.searchsorted(row[order], np.arange(len(part) + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays([kinds.take(pa.array(kind[order])), pa.array(start[order]), pa.array(end[order])], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, spans)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(c.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


QUERIES = {"op11_trigram_secrets": op11_trigram_secrets}


def _sql() -> str:
    """Each rule by another engine's expressions: matches, and where they stand by the lengths of what is between them."""
    either = lambda p: re.sub(r"[a-z]{3,}", lambda m: "".join(f"[{x.upper()}{x}]" for x in m[0]), p)
    parts = []
    for k, rule in enumerate(BASE + MORE):
        pattern = (either(rule.pattern) if rule.any_case else rule.pattern).replace("'", "''")
        parts.append(f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, i, cast(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS s, len(hits[i]) AS n
 FROM (SELECT r, hits, gaps, parts, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts, string_split_regex(text, '{pattern}') AS gaps FROM docs)) WHERE len(parts[i]) >= {rule.least}""")
    count = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}')"
    text = "kind || ':' || s || ':' || (s + n)"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
by_doc AS (SELECT r, {', '.join(f'{count(x.kind)} AS n_{x.kind}' for x in BASE)}, string_agg({text}, ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})) AS base, string_agg({text}, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{x.kind}, 0) AS n_{x.kind}' for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN by_doc USING (r)"""


ORACLES = {"op11_trigram_secrets": _sql()}
