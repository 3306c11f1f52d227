"""Quality rules learned as a decision list, in DataFrame operations only.

Text statistics come from built-in array functions. Sequential covering then
learns rules from labelled statistics: a conjunction of thresholds grows by
information gain on one part of the rows, is pruned on another, and the rows it
covers are set aside before the next one grows. Each step is one grouped count,
of which the driver sees at most features x (cuts + 1) rows. The rules come out
as one ordered Spark conditional expression.

Edge cases: a null text has no words; a null doc_id never meets a label; rows
that repeat a doc_id are judged each on its own; of several labels of one
document the lowest counts; without usable labels the list is empty and every
document passes; other input columns are ignored. Windows of five words are
compared by a 64-bit hash within their own text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "digit_share"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in ``words``."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def places(s: Column) -> Column:
        at = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: at(k - 1, x) | at(k + 1, x)), lambda x: x["i"]))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    return F.when(F.size(words) < 5, F.lit(0).cast("long")).otherwise(let(windows(words), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; nothing is shuffled."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE) != "")
    length = F.length(text).cast("long")
    stats = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        docs["doc_id"],
        stats.alias("s"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (length - F.length(_without(text, SYMBOLS))).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        (length - F.length(_without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        (length - F.length(_without(text, "!?"))).alias("n_marks"),
        (length - F.length(_without(text, "0123456789"))).alias("n_digits"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
    ).select("*", "s.*").drop("s")


def features(stats: DataFrame) -> DataFrame:
    """The statistics and the shares that rules compare with thresholds."""
    of = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return stats.withColumns(
        {
            "mean_word": of("word_chars", "n_words"),
            "symbol_share": of("n_symbols", "word_chars"),
            "dup_line_share": of("n_dup_lines", "n_lines"),
            "repeat_share": of("n_repeat_words", "n_words"),
            "upper_share": of("n_upper", "word_chars"),
            "mark_share": of("n_marks", "word_chars"),
            "distinct_share": of("n_distinct", "n_words"),
            "digit_share": of("n_digits", "word_chars"),
        }
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects the document."""

    rules: list[list[Test]] = field(default_factory=list)

    def keep(self) -> Column:
        out = None
        for rule in self.rules:
            holds = _all(rule)
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) or "keep all"


def _all(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def learn(rows: DataFrame, names: list[str] = FEATURES, cuts: int = 40, depth: int = 3, rules: int = 8, precision: float = 0.9, support: float = 0.002) -> DecisionList:
    """A decision list for rows with the columns ``names``, ``bad`` (0 or 1) and ``grow`` (else used to prune)."""
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).collect()
    table = {n: sorted({float(x) for r in found for x in (r[n] or [])}) for n in names}
    if len({r["bad"] for r in found}) < 2:
        return DecisionList()
    below = lambda n: F.size(F.filter(F.array(*map(F.lit, table[n])), lambda cut: cut < F.col(n)))
    bins = F.array(*[F.struct(F.lit(n).alias("feature"), below(n).alias("bin")) for n in names])
    rows = c.materialize(rows.select(*names, "bad", "grow", bins.alias("bins")), "rule-rows")
    total = rows.agg(F.sum("bad"), F.count("*")).first()
    out = DecisionList()

    def counts(left: DataFrame) -> dict[Test, tuple[int, int]]:
        """Bad and good rows that each possible test would cover."""
        grouped = left.select("bad", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
        result = {}
        for name in names:
            at = {r["bin"]: (r["p"], r["n"] - r["p"]) for r in grouped if r["feature"] == name}
            whole = [sum(v[i] for v in at.values()) for i in (0, 1)]
            low = [0, 0]
            for i, cut in enumerate(table[name]):
                low = [low[j] + at.get(i, (0, 0))[j] for j in (0, 1)]
                result[Test(name, False, cut)] = tuple(low)
                result[Test(name, True, cut)] = (whole[0] - low[0], whole[1] - low[1])
        return result

    for _ in range(rules):
        left = rows.filter(out.keep())
        rule: list[Test] = []
        while len(rule) < depth:
            part = left.filter(F.col("grow") & _all(rule))
            base = part.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
            if not base[0] or base[0] == base[1]:
                break
            gain = lambda p, n, base=base: p * (log2(p / (p + n)) - log2(base[0] / base[1])) if p else 0.0
            best, (p, n) = max(counts(part).items(), key=lambda x: (gain(*x[1]), str(x[0])))
            if gain(p, n) <= 0:
                break
            rule.append(best)
            if p / (p + n) > 0.995:
                break
        if not rule:
            break
        steps = [F.struct(F.coalesce(F.sum(F.when(_all(rule[:k]), F.col("bad"))), F.lit(0)).alias("p"), F.count(F.when(_all(rule[:k]), 1)).alias("n")).alias(str(k)) for k in range(1, len(rule) + 1)]
        held = left.filter(~F.col("grow")).agg(*steps).first()
        scored = [((2 * held[str(k)]["p"] - held[str(k)]["n"]) / max(1, held[str(k)]["n"]), -k) for k in range(1, len(rule) + 1)]
        k = -max(scored)[1]
        p, n = held[str(k)]["p"], held[str(k)]["n"]
        if not n or p / n < precision or p < support * total[0]:
            break
        out.rules.append(rule[:k])
    return out


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Statistics with base_failed and kept for every document, and the list that judged them."""
    rows = features(c.materialize(statistics(docs), "rule-statistics"))
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(F.col("quality").isin(0, 1))
    grow = F.coalesce(c.crc_mod(F.col("doc_id"), 3) != 0, F.lit(True))
    found = learn(rows.join(known, "doc_id").select(*FEATURES, (1 - F.col("quality")).alias("bad"), grow.alias("grow")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & found.keep()), found


def op9_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = judged(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_decision_list_rules": op9_decision_list_rules}
ORACLES: dict[str, str] = {}
