"""Quality rules: base statistics, and a decision list learned from labelled statistics.

Sequential covering learns rules for the rejected class: a rule grows by the threshold test of the most information gain
until it covers no kept document of the growing part, is pruned on the other part, and the documents that it covers are
removed. The ordered rules become one Spark conditional expression over the statistics' columns.

Defined cases: a null or empty text has no words; ratios of nothing are 0; without labelled rows the list is empty and only
the base rules decide; an empty table gives an empty result; labels of repeated documents are all used, null ones none;
texts of any length are counted whole; of tests with equal gain the first in the order of ``STATISTICS``, below before
above, is taken, and the first rule that holds decides; only the id, text and label columns are read, so further ones
cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_rows
from .words import _BLANK, OWN_KEY, runs_of, spans, word_values

WINDOW = 5
#: Labelled documents that the list is learned from at most.
SAMPLE = 20_000
#: Thresholds tried per statistic and step.
CUTS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks")
#: Ratios that rules test: name, numerator, denominator.
RATIOS = (
    ("mean_word", "word_chars", "n_words"), ("symbol_ratio", "n_symbols", "word_chars"), ("dup_line_ratio", "n_dup_lines", "n_lines"), ("repeat_ratio", "n_repeat_words", "n_words"),
    ("distinct_ratio", "n_distinct", "n_words"), ("upper_ratio", "n_upper", "n_letters"), ("digit_ratio", "n_digits", "word_chars"), ("mark_ratio", "n_marks", "n_words"),
)
STATISTICS = ("n_words", *(r[0] for r in RATIOS))

_KIND = np.zeros(256, dtype=np.int64)  # 1 symbol, 2 upper, 3 lower, 4 digit, 5 mark, 6 inside a longer character
_KIND[list(b"#*$%&|<>")] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[list(b"!?")] = 5
_KIND[0x80:0xC0] = 6


def _found_twice(word: np.ndarray) -> np.ndarray:
    """The windows whose words some other window has too, by their first word."""
    value = runs_of(word, WINDOW, OWN_KEY)
    order = np.sort(value)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.isin(value, twice))
    at = at[np.argsort(value[at], kind="stable")]
    equal = value[at[1:]] == value[at[:-1]]
    if all(np.array_equal(word[at[1:] + k][equal], word[at[:-1] + k][equal]) for k in range(WINDOW)):
        return at
    windows = list(zip(*(word[k : len(word) - WINDOW + 1 + k].tolist() for k in range(WINDOW)), strict=True))
    often = Counter(windows)
    return np.array([i for i, x in enumerate(windows) if often[x] > 1], dtype=np.int64)


def counts(view: memoryview) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text's UTF-8 bytes."""
    data = np.frombuffer(view, dtype=np.uint8)
    starts, ends = spans(data)
    n = len(starts)
    if not n:
        kinds = np.bincount(_KIND[data], minlength=7)
        return (0, 0, int(kinds[1]), 0, 0, 0, 0, 0, 0, 0, 0)
    kinds = np.bincount(_KIND[data], minlength=7)
    blanks = int(_BLANK[data].sum())
    word = word_values(data, starts, ends, OWN_KEY)
    repeated = 0
    if n >= WINDOW:
        at = _found_twice(word)
        if len(at):
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover[:-1])))
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([[0], breaks + 1])
    stop = np.concatenate([breaks, [len(data)]])
    worded = np.searchsorted(starts, stop, side="left") > np.searchsorted(starts, begin, side="left")
    raw = bytes(view)
    lines = [raw[a:b] for a, b in zip(begin[worded].tolist(), stop[worded].tolist(), strict=True)]
    return (
        n, len(data) - blanks - int(kinds[6]), int(kinds[1]), len(lines) - len(set(lines)), repeated, len(lines),
        len(np.unique(word)), int(kinds[2]), int(kinds[2] + kinds[3]), int(kinds[4]), int(kinds[5]),
    )


def statistics(docs: DataFrame, *columns: str, text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with the counts (long) and ratios (double) of each text."""
    picked = docs.select(*columns, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [counts(v) for v in utf8_rows(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[*columns, *COUNTS])

    schema = picked.drop("_text").select("*", *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema
    counted = picked.mapInArrow(run, schema)
    return counted.select("*", *(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias(name) for name, a, b in RATIOS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``statistic <= cut`` or ``statistic > cut``."""

    statistic: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.cut) == self.above

    def column(self) -> Column:
        value = F.col(STATISTICS[self.statistic])
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[float, Test | None]:
    """The test of the most gain: rejected documents it covers times the growth of their share's logarithm."""
    before = np.log2(bad.mean())
    best: tuple[float, Test | None] = (0.0, None)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > CUTS:
            middles = middles[np.linspace(0, len(middles) - 1, CUTS).astype(int)]
        order = np.argsort(x[:, k], kind="stable")
        upto = np.concatenate([[0], np.cumsum(bad[order])])
        at = np.searchsorted(x[order, k], middles, side="right")
        for above in (False, True):
            p = (upto[-1] - upto[at]) if above else upto[at]
            n = (len(x) - at) if above else at
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - before), 0.0)
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Test(k, above, float(middles[i])))
    return best


def learn(x: np.ndarray, bad: np.ndarray, least_share: float = 0.9, most_rules: int = 20, most_tests: int = 4, least_cover: int = 3) -> list[Rule]:
    """Ordered rules for rejection. A rule stays if at least ``least_share`` of what it covers in the pruning part is rejected."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    grow_part = np.arange(len(x)) % 3 != 2
    while len(rules) < most_rules and bad[left].sum() >= least_cover:
        g, p = left & grow_part, left & ~grow_part
        rule: list[Test] = []
        inside = g.copy()
        while len(rule) < most_tests and bad[inside].any() and not bad[inside].all():
            _, test = _best_test(x[inside], bad[inside])
            if test is None:
                break
            rule.append(test)
            inside &= test.holds(x)
        if not rule:
            break

        def worth(tests: list[Test], p: np.ndarray = p) -> tuple[float, int]:
            c = _covers(tuple(tests), x) & p
            good, wrong = int(bad[c].sum()), int((~bad[c]).sum())
            return ((good - wrong) / (good + wrong) if good + wrong else -1.0, good)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = _covers(tuple(rule), x) & left
        seen = covered & p
        if covered.sum() < least_cover or bad[covered].mean() < least_share or (seen.any() and bad[seen].mean() < least_share):
            break
        rules.append(tuple(rule))
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the first rule that holds rejects; otherwise the document stays."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{STATISTICS[t.statistic]} {'>' if t.above else '<='} {t.cut:g}" for t in rule) + " -> reject" for rule in rules] + ["otherwise -> keep"]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learns the list from at most ``sample`` labelled documents, those of least hash."""
    marked = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = marked.withColumn("h", F.xxhash64("doc_id", F.lit(31))).orderBy("h", "quality").limit(sample)
    # The chosen labels are at most ``sample`` rows, so they can be sent to all executors.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    got = statistics(rows, "h", "quality").select("h", "quality", *STATISTICS).orderBy("h", "quality", *STATISTICS).limit(sample).toArrow()
    if not got.num_rows:
        return []
    x = np.column_stack([got.column(c).to_numpy().astype(np.float64) for c in STATISTICS])
    return learn(x, got.column("quality").to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) and the ratios that the rules read."""
    rules = train(docs, labels)
    found = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    failed = base_failed()
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), *(r[0] for r in RATIOS))
