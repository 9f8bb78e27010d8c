"""Quality verdicts from a learned decision list over text statistics, DataFrame operations only.

Sequential covering: a rule, a conjunction of thresholds, grows by the condition of highest information
gain on two thirds of the labelled rows and is cut back where that is better on the last third; rows
that it covers leave the search, and the next rule follows. The driver only sees counts of a fixed number
of threshold cells. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurevote.llm.common import written

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Parameters of the search.
THRESHOLDS = 64  # for each measure, at quantiles of the labelled rows
MAX_CONDITIONS = 4
MAX_RULES = 16
MIN_PRECISION = 0.9  # smoothed, on all labelled rows that a rule covers
MIN_COVERED = 3

#: What rules may ask about, as parts: shares, so that they mean the same in short and long texts.
MEASURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times_more(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs more than once; `windows` holds a hash for each first word."""

    def of_repeated(hashes: Column) -> Column:
        # Sorted by hash, equal windows are neighbours.
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(placed, of_sorted)

    def of_sorted(s: Column) -> Column:
        as_before = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: a["h"] == b["h"])
        return _let(as_before, lambda same: of_marked(s, same))

    def of_marked(s: Column, same: Column) -> Column:
        edge = F.array(F.lit(False))
        either = F.zip_with(F.concat(edge, same), F.concat(same, edge), lambda x, y: x | y)
        at = F.zip_with(s, either, lambda place, twice: F.when(twice, place["i"]))
        return _let(F.array_sort(F.filter(at, lambda i: i.isNotNull())), of_places)

    def of_places(at: Column) -> Column:
        following = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + WINDOW))
        width = F.zip_with(at, following, lambda i, j: F.least(j - i, F.lit(WINDOW)))
        return F.aggregate(width, F.lit(0), lambda total, w: total + w)

    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, of_repeated(windows)).otherwise(0)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, one row per document, without a shuffle.

    id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words, n_lines,
    n_capitals and n_exclamations (long). Words are runs without white space; lines are what stands
    between line feeds and holds a word, duplicates those equal to an earlier one; repeated words lie in
    an 8-word window that occurs twice or more in the text. Windows are compared by 64-bit hashes of
    their words. Missing and empty texts have counts of 0. Every row of the table gives one, repeated
    ones too; other columns, whatever their names, are left behind.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_t"))
    words = F.array_remove(F.split("_t", rf"[{SPACE}]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def joined(step: int):
        """Hashes of what begins at each place and goes on `step` places later."""
        return lambda h: F.zip_with(
            F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)
        )

    def window_hashes(h: Column) -> Column:
        # Of 2, then 4, then 8 words in a row.
        return _let(_let(_let(h, joined(1)), joined(2)), joined(4))

    def counts(h: Column) -> Column:
        enough = F.size(h) >= WINDOW
        repeated = F.when(enough, _let(window_hashes(h), _covered)).otherwise(0)
        return F.struct(
            F.size(h).alias("n_words"),
            F.size(F.array_distinct(h)).alias("n_distinct_words"),
            repeated.alias("n_repeat_words"),
        )

    def line_counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")
        )

    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    found = rows.select(
        id_col,
        _let(hashes, counts).alias("_w"),
        _let(lines, line_counts).alias("_l"),
        F.length(F.translate("_t", BLANKS, "")).alias("word_chars"),
        _times_more(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("n_capitals"),
        _times_more(F.col("_t"), "!").alias("n_exclamations"),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_capitals"]
    flat = found.select(id_col, "_w.*", "_l.*", "word_chars", "n_symbols", "n_capitals", "n_exclamations")
    return flat.select(id_col, *[F.col(n).cast("long").alias(n) for n in [*names, "n_exclamations"]])


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def measure(name: str) -> Column:
    """A measure as a double, 0 for a text without words."""
    part, whole = MEASURES[name]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float
    cell: int  # number of the threshold among those of its measure

    def expression(self) -> Column:
        value = measure(self.measure)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _both(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _in_cells(rule: Rule) -> Column:
    """The rule over the column `cells`: for each measure, how many thresholds lie below the value."""
    order = list(MEASURES)
    place = [F.get("cells", F.lit(order.index(c.measure))) for c in rule]
    return _both([(p > c.cell) if c.above else (p <= c.cell) for p, c in zip(place, rule)])


def _gain(hit: float, miss: float, all_hit: float, all_miss: float) -> float:
    """Information gained about the rejected rows that are kept in."""
    if hit <= 0:
        return 0.0
    return hit * (math.log2(hit / (hit + miss)) - math.log2(all_hit / (all_hit + all_miss)))


def _best_condition(grow: DataFrame, rule: Rule, thresholds: dict[str, list[float]]) -> Condition | None:
    """The condition with the highest gain among all measures, thresholds and both sides: one job, which
    brings one row for each measure and cell with rows."""
    cells = grow.where(_in_cells(rule)).select("bad", F.posexplode("cells").alias("of", "cell"))
    counted = cells.groupBy("of", "cell").agg(F.sum("bad").alias("hit"), F.sum(1 - F.col("bad")).alias("miss")).collect()
    best, best_gain = None, 0.0
    for of, (name, cuts) in enumerate(thresholds.items()):
        by_cell = {r["cell"]: (r["hit"], r["miss"]) for r in counted if r["of"] == of}
        all_hit, all_miss = (sum(c[side] for c in by_cell.values()) for side in (0, 1))
        if not all_hit or not all_miss:
            return None
        hit = miss = 0
        for cell, cut in enumerate(cuts):
            hit, miss = hit + by_cell.get(cell, (0, 0))[0], miss + by_cell.get(cell, (0, 0))[1]
            for above in (False, True):
                inside = (all_hit - hit, all_miss - miss) if above else (hit, miss)
                gain = _gain(*inside, all_hit, all_miss)
                if gain > best_gain + 1e-12:
                    best, best_gain = Condition(name, above, cut, cell), gain
    return best


def _counts(rows: DataFrame, rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """Rejected and accepted labelled rows that each rule covers, in one job."""
    sums = [
        F.coalesce(F.sum(F.when(_in_cells(rule), value)), F.lit(0))
        for rule in rules
        for value in (F.col("bad"), 1 - F.col("bad"))
    ]
    found = rows.agg(*sums).first()
    return [(found[2 * i], found[2 * i + 1]) for i in range(len(rules))]


def learn_rules(
    statistics: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    n_thresholds: int = THRESHOLDS,
    max_conditions: int = MAX_CONDITIONS,
    max_rules: int = MAX_RULES,
    min_precision: float = MIN_PRECISION,
    min_covered: int = MIN_COVERED,
) -> list[Rule]:
    """Rules, first to last, that tell rejected (label 0) from accepted documents.

    Learns from all labelled rows that the base rules let through. Labels that are missing, or of a
    missing id, do not count; of several labels of an id the least does. Rows go to the growing or to
    the pruning part by a hash of their id. A rule is taken if at least `min_covered` rejected rows
    are covered and their smoothed share is `min_precision` or more; the first that is not ends the
    list. Without labels, or with those of one kind only, there are no rules.

    All thresholds of all measures are tried in one grouped count for each condition; a rule takes
    `max_conditions` + 2 small jobs at most over the labelled rows, which hold a short array each.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col(label_col) != 0).cast("int")).alias("_good"))
    rows = statistics.join(known, statistics[id_col] == known["_id"]).where(~base_failed())
    of_id = F.crc32(F.col("_id").cast("string").cast("binary")) % 3
    values = F.array(*[measure(m) for m in MEASURES])
    labelled = written(rows.select((1 - F.col("_good")).alias("bad"), (of_id != 0).alias("grows"), values.alias("v")))
    shares = [(i + 1) / (n_thresholds + 1) for i in range(n_thresholds)]
    quantiles = [
        F.percentile_approx(F.get("v", F.lit(i)), shares, 10_000).alias(m) for i, m in enumerate(MEASURES)
    ]
    found = labelled.agg(*quantiles).first()
    thresholds = {m: sorted(set(found[m] or [])) for m in MEASURES}
    cells = F.array(
        *[
            reduce(lambda a, b: a + b, [(F.get("v", F.lit(i)) > t).cast("int") for t in cuts], F.lit(0))
            for i, cuts in enumerate(thresholds.values())
        ]
    )
    labelled = written(labelled.select("bad", "grows", cells.alias("cells")))

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = labelled.where(~reduce(lambda a, b: a | b, map(_in_cells, rules), F.lit(False)))
        grow = rest.where("grows")
        rule: Rule = ()
        while len(rule) < max_conditions and (best := _best_condition(grow, rule, thresholds)):
            rule += (best,)
        if not rule:
            break
        # Cut back to the beginning of the rule that is best on the rows it did not see.
        starts = [rule[: i + 1] for i in range(len(rule))]
        unseen, whole = _counts(rest.where("NOT grows"), starts), _counts(rest, starts)
        worth = [((hit - miss) / (hit + miss) if hit + miss else -1.0) for hit, miss in unseen]
        best_start = max(range(len(starts)), key=lambda i: (worth[i], whole[i][0] - whole[i][1], -i))
        hit, miss = whole[best_start]
        if hit < min_covered or (hit + 1) / (hit + miss + 2) < min_precision:
            break
        rules.append(starts[best_start])
    return rules


def first_rule(rules: Sequence[Rule]) -> Column:
    """The number of the first rule, from 1, that covers a row of statistics; missing if none does."""
    chain = None
    for number, rule in enumerate(rules, 1):
        covers = _both([c.expression() for c in rule])
        chain = F.when(covers, number) if chain is None else chain.when(covers, number)
    return F.lit(None).cast("int") if chain is None else chain.cast("int")


def judged(statistics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The statistics with base_failed, rule (number of the first that covers the row) and kept."""
    failed = base_failed()
    rows = statistics.withColumn("base_failed", failed)
    rows = rows.withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
