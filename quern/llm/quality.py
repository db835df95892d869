"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

:func:`with_statistics` counts words, symbols, repeated lines and repeated word windows inside
each row, without a shuffle. :func:`learn` covers the low-quality examples rule after rule: a
rule is grown on two thirds of the examples by the threshold condition of highest information
gain until it covers no good example, pruned on the other third, and kept if it is precise
there; what it covers leaves the examples. :meth:`DecisionList.verdict` is the list as one
ordered conditional expression: the first rule that holds rejects, no rule keeps.

The examples are a bounded sample of labelled rows (``cap`` a class) of which only the
statistics come to the driver. A repeated window is found by 64-bit hashes of its words.

Defined results: null and empty texts have no words and zero counts and fail the base rules;
ratios over nothing are 0. Without examples of both classes the list is empty and keeps all.
Repeated rows get equal results; of conditions of equal gain the first in order of features and
thresholds is taken, and a value at a threshold is not over it. A very long text is counted whole,
inside its row. An empty table gives an empty one. Other columns pass through; those named like a
statistic, base_failed, kept or a working column (``__words``, ``__lines``,
``__windows``) are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stratified, words

#: The symbols that count as markup debris.
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_marks (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    out = df.withColumns({"__words": words(F.col(text)), "__lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": left(SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_upper": left(r"[^\p{Lu}]+").cast("long"),
            "n_marks": left(r"[^!?]+").cast("long"),
        }
    )

    def windows(hs: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)]))
        return F.when(F.size(hs) < WINDOW, F.array().cast("array<bigint>")).otherwise(each)

    # bound in an array of one, so that the hashes are made once, also where a later filter is pushed below
    hashes = F.array(F.transform("__words", lambda w: F.xxhash64(w)))
    out = out.withColumn("__windows", F.get(F.transform(hashes, windows), F.lit(0))).drop("__words", "__lines")
    return out.withColumn("n_repeat_words", _covered("__windows").cast("long")).drop("__windows")


def _covered(windows: str) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # of the windows in order of their hash, those whose neighbour has the same hash
    def twice(ws: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        marked = F.transform(ws, lambda x, j: F.when(same(x, F.get(ws, j - 1)) | same(x, F.get(ws, j + 1)), x["i"]))
        return F.array_sort(F.array_compact(marked))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
    bound = F.transform(F.array(ordered), lambda ws: F.aggregate(twice(ws), start, step, lambda s: s["n"]))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.get(bound, F.lit(0)))


def features() -> dict[str, Column]:
    """What the rules look at, each between statistics of a row."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "upper_share": over("n_upper", "word_chars"),
        "mark_share": over("n_marks", "n_words"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "word_length": over("word_chars", "n_words"),
    }


@dataclass
class DecisionList:
    """Ordered rules; a rule is a conjunction of (feature, '>' or '<=', threshold)."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def verdict(self) -> Column:
        """False where a rule rejects, true elsewhere."""
        what, out = features(), None
        for rule in self.rules:
            holds = F.lit(True)
            for name, sign, limit in rule:
                holds = holds & (what[name] > limit if sign == ">" else what[name] <= limit)
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)


Row = dict[str, float]


def _holds(rule: list[tuple[str, str, float]], x: Row) -> bool:
    return all(x[n] > t if s == ">" else x[n] <= t for n, s, t in rule)


def _grow(bad: list[Row], good: list[Row], names: list[str], steps: int = 24, longest: int = 4) -> list[tuple[str, str, float]]:
    """Add the condition of highest gain until no good example is covered."""
    rule: list[tuple[str, str, float]] = []
    while good and bad and len(rule) < longest:
        p0, n0 = len(bad), len(good)
        best, gain = None, 1e-9
        for name in names:
            values = sorted({x[name] for x in bad} | {x[name] for x in good})
            stride = max(1, (len(values) - 1) // steps)
            for a, b in zip(values[:-1:stride], values[1::stride], strict=False):
                limit = (a + b) / 2
                for sign in (">", "<="):
                    cond = [(name, sign, limit)]
                    p = sum(_holds(cond, x) for x in bad)
                    n = sum(_holds(cond, x) for x in good)
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                    if g > gain:
                        best, gain = cond[0], g
        if best is None:
            break
        rule.append(best)
        bad, good = [x for x in bad if _holds([best], x)], [x for x in good if _holds([best], x)]
    return rule


def _prune(rule: list[tuple[str, str, float]], bad: list[Row], good: list[Row]) -> list[tuple[str, str, float]]:
    """Drop last conditions as long as (bad - good) / covered does not fall."""

    def worth(r: list[tuple[str, str, float]]) -> float:
        p, n = sum(_holds(r, x) for x in bad), sum(_holds(r, x) for x in good)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def cover(examples: list[tuple[Row, bool]], precision: float = 0.95, most: int = 12) -> DecisionList:
    """Sequential covering of the bad examples (True) by rules that spare the good ones."""
    grow = [e for i, e in enumerate(examples) if i % 3]
    prune = [e for i, e in enumerate(examples) if i % 3 == 0]
    names = list(examples[0][0]) if examples else []
    found = DecisionList()
    split = lambda es: ([x for x, b in es if b], [x for x, b in es if not b])
    (bad, good), (bad_p, good_p) = split(grow), split(prune)
    while bad and good and len(found.rules) < most:
        rule = _prune(_grow(bad, good, names), bad_p, good_p)
        if not rule:
            break
        p, n = sum(_holds(rule, x) for x in bad + bad_p), sum(_holds(rule, x) for x in good + good_p)
        if p < 5 or p < precision * (p + n):
            break
        found.rules.append(rule)
        bad, bad_p = [x for x in bad if not _holds(rule, x)], [x for x in bad_p if not _holds(rule, x)]
    return found


#: Labelled rows that the rules are learned from, at most.
EXAMPLES = 20_000


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", cap: int = 700) -> DecisionList:
    """The decision list of the labelled rows: about ``cap`` examples of each class, label 0 is bad.

    However often a key is repeated among the rows, no more than ``EXAMPLES`` come to the driver.
    """
    sample = stratified(labels.where(F.col(label).isNotNull()).select(key, label), key, label, cap)
    rows = with_statistics(docs.select(key, text).join(F.broadcast(sample), key), text)
    rows = rows.select(F.col(key), (F.col(label) == 0).alias("__bad"), *[c.alias(n) for n, c in features().items()])
    rows = rows.orderBy(F.xxhash64(key), key, *features()).limit(EXAMPLES).collect()
    rows.sort(key=lambda r: str(r[0]))
    names = list(features())
    return cover([({n: r[n] for n in names}, r["__bad"]) for r in rows])


def judge(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Add the statistics, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_statistics(df, text).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict())
