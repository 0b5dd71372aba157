"""Quality rules as a learned decision list.

Statistics of a text are thresholds' raw material. From labelled documents, sequential covering learns an ordered list
of conjunctions "statistic above or below a value, and ...": a rule grows on two thirds of the rows by the condition
with the largest information gain, is pruned on the other third as long as that raises its accuracy there, is kept
only if it is right often enough, and the rows it covers are removed before the next rule is sought. The list becomes one
Spark CASE expression, which anybody can read and which runs without Python.

Defined cases: null and empty texts have zero statistics (and fail the base rule); an empty label table, or one without
bad rows, gives an empty list that keeps everything; repeated rows give repeated results; doc_ids in several labels
count by their worst one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .tasks import map_rows, ship, texts

WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# shares of the text that the learned rules may test
SHARES = ("mean_word", "symbols_per_word", "bars_per_word", "marks_per_word", "upper_share", "digit_share", "dup_line_share",
          "repeat_share", "distinct_share")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in SHARES)
# labelled rows that a list is learned from, picked by a hash of the id; documented bound of the driver's work
SAMPLE_ROWS = 20_000


def _repeat_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of five words found at least twice in the text."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)
    order = np.lexsort(windows.T[::-1])
    ordered = windows[order]
    equal = (ordered[1:] == ordered[:-1]).all(axis=1)
    repeated = np.zeros(n, bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    covered = np.zeros(len(numbers) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str) -> tuple:
    """The values of ``STATS`` after doc_id. Words are runs of characters other than blank and U+0009 to U+000D."""
    words = text.encode().split()
    joined = b"".join(words).decode()
    n, chars = len(words), len(joined)
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    dup_lines = len(lines) - len(set(lines))
    numbers: dict[bytes, int] = {}
    coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeats = _repeat_words(coded) if len(numbers) < n else 0
    marks = text.count("!") + text.count("?")
    shares = (
        chars / max(n, 1), symbols / max(n, 1), text.count("|") / max(n, 1), marks / max(n, 1),
        sum(1 for w in words if w[:2].isupper()) / max(n, 1), sum(map(joined.count, "0123456789")) / max(chars, 1),
        dup_lines / max(len(lines), 1), repeats / max(n, 1), len(numbers) / max(n, 1),
    )
    return (n, chars, symbols, dup_lines, repeats, *map(float, shares))


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row of ``STATS`` per document."""

    def make():
        names = ["doc_id", *BASE, *SHARES]

        def work(columns):
            rows = [(d, *statistics(t)) for d, t in zip(columns["doc_id"], columns["text"], strict=True)]
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

        return work

    return map_rows(texts(docs), STATS, make)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.value if self.above else table[self.name] <= self.value

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.name)
        return value > self.value if self.above else value <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    covered = np.ones(n, bool)
    for condition in rule:
        covered &= condition.holds(table)
    return covered


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the largest gain p1 * (log precision after - log precision before)."""
    before = np.log2(bad.mean())
    best, found = 1e-9, None
    for name, values in table.items():
        order = np.argsort(values, kind="stable")
        ranked, hits = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
        for above in (True, False):
            hit = (hits[-1] - hits[cuts]) if above else hits[cuts]
            size = (len(bad) - 1 - cuts) if above else cuts + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit > 0, hit * (np.log2(hit / size) - before), 0)
            if len(gain) and gain.max() > best:
                at = cuts[int(gain.argmax())]
                best, found = float(gain.max()), Condition(name, above, float((ranked[at] + ranked[at + 1]) / 2))
    return found


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = _covers(rule, table, len(bad))
    hit = int((covered & bad).sum())
    return (2 * hit - int(covered.sum())) / max(int(covered.sum()), 1)


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules that each mark rows as bad. A rule must be right for a share ``precision`` of the rows it covers,
    ``least`` of them at least."""
    rules: list[Rule] = []
    bad = np.asarray(bad, bool)
    table = {name: np.asarray(values, float) for name, values in table.items()}
    while bad.any() and not bad.all():
        grow = np.arange(len(bad)) % 3 != 2
        if not bad[grow].any() or not bad[~grow].any():
            break
        rows, left, rule = {n: v[grow] for n, v in table.items()}, bad[grow], ()
        while not left.all() and (condition := _best_condition(rows, left)):
            rule = (*rule, condition)
            inside = condition.holds(rows)
            rows, left = {n: v[inside] for n, v in rows.items()}, left[inside]
        held = {n: v[~grow] for n, v in table.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[~grow]) >= _worth(rule, held, bad[~grow]):
            rule = rule[:-1]
        covered = _covers(rule, table, len(bad))
        if not rule or (covered & bad).sum() < max(least, precision * covered.sum()):
            break
        rules.append(rule)
        table, bad = {n: v[~covered] for n, v in table.items()}, bad[~covered]
    return rules


def emit(rules: list[Rule], prefix: str = "") -> Column:
    """The first rule that covers a row rejects it; no rule, no rejection. True keeps. ``prefix``: of the statistics."""
    verdict = None
    for rule in rules:
        condition = rule[0].column(prefix)
        for more in rule[1:]:
            condition = condition & more.column(prefix)
        verdict = F.when(condition, False) if verdict is None else verdict.when(condition, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents; rows that fail the base rule teach nothing new."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    chosen = texts(docs).join(F.broadcast(sample), "doc_id")  # bounded by the sample
    stats = text_statistics(chosen.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").where(~base_failed())
    # an order of its own, so that the same rows teach the same list however Spark returns them
    rows = stats.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).toPandas()
    table = {name: rows[name].to_numpy(float) for name in SHARES}
    return learn(table, (rows["quality"] == 0).to_numpy(bool))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` per document."""
    stats = text_statistics(docs).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & emit(rules))


def drop_poor(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, in one pass without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    own = next(name for name in (f"stats_{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    fields = STATS.removeprefix("doc_id long, ")
    schema = spark.createDataFrame([], docs.schema).selectExpr("*", f"cast(null AS struct<{_typed(fields)}>) AS {own}").schema
    arrow = to_arrow_schema(schema)
    names = [*BASE, *SHARES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, statistics(t.as_py() or ""), strict=True)) for t in batch.column("text")]
            columns = [batch.column(f.name).cast(f.type) for f in list(arrow)[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow[-1].type)], schema=arrow)

    judged = docs.mapInArrow(run, schema)
    kept = judged.where(~base_failed(f"{own}.") & emit(rules, f"{own}."))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _typed(fields: str) -> str:
    return ", ".join(field.replace(" ", ": ", 1) for field in fields.split(", "))
