"""Learned decision lists: sequential covering over labelled statistics, emitted as ordered Spark conditions.

``statistics`` counts words, lines and characters of every text. ``learn`` grows and prunes conjunctions of
thresholds on rates of those counts, one rule after the other, each over the rows that the rules before it leave.
``DecisionList.when`` is the list as one ``CASE WHEN`` column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, label_sample, one_each, packed, quoted, texts, unpacked
from inboxlake.llm.statistics import COUNTS, counts

#: Labelled rows that a list is learned from, at most about.
TRAIN_ROWS = 20_000

#: The rates that rules compare with thresholds, as SQL over the counts. Without words every rate is zero.
RATES = {
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "same_share": "try_divide(n_same_words, n_words)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "upper_share": "try_divide(n_upper, word_chars)",
    "digit_share": "try_divide(n_digits, word_chars)",
    "word_length": "try_divide(word_chars, n_words)",
}


def rates() -> list[Column]:
    return [F.coalesce(F.expr(sql), F.lit(0.0)).cast("double").alias(name) for name, sql in RATES.items()]


def failed(fewest: int = 10, percent: int = 20) -> Column:
    """The base rule: fewer than ``fewest`` words, or over ``percent`` percent of the words in repeated windows."""
    return (F.col("n_words") < fewest) | (F.col("n_repeat_words") * 100 > F.col("n_words") * percent)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        found = np.array([counts(x) for x in texts(block)], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*block.columns, *map(pa.array, found.T)], names=[*block.schema.names, *COUNTS])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``rest`` (a struct of all columns but the text), ``text`` and the counts of the whole text.

    A null text counts as empty. Columns of the documents cannot clash with the counts, as they stay inside ``rest``.
    """
    rows = packed(docs, text)
    return rows.mapInArrow(_statistics, extended(rows, ", ".join(f"{name} long" for name in COUNTS)))


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.rate] >= self.threshold if self.above else x[self.rate] < self.threshold

    def column(self) -> Column:
        return F.col(self.rate) >= self.threshold if self.above else F.col(self.rate) < self.threshold

    def __str__(self) -> str:
        return f"{self.rate} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects a row, and a row without one is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def when(self) -> Column:
        """The place of the first rule that holds, from 1, or null: one ordered conditional expression."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            both = rule[0].column()
            for c in rule[1:]:
                both = both & c.column()
            out = F.when(both, k) if out is None else out.when(both, k)
        return (F.lit(None) if out is None else out).cast("int")

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 16, conditions: int = 4, precision: float = 0.95, support: int = 5) -> DecisionList:
    """A decision list for the rows marked ``bad``, by sequential covering.

    Two thirds of the rows still uncovered grow a rule, condition by condition, by FOIL's information gain over at most
    64 thresholds of each rate; the rest prune its last conditions. A rule enters the list if at least ``support`` rows
    hold it and at least the share ``precision`` of them are bad; the first that doesn't ends the list. Ties go to the
    first rate by name and the lower threshold. Without bad rows, or without rows, the list is empty.
    """
    n = len(bad)
    open_ = np.ones(n, dtype=bool)
    third = np.arange(n) % 3 == 0
    out: list[tuple[Condition, ...]] = []
    while len(out) < rules and (open_ & bad).sum() >= support:
        grow, prune = open_ & ~third, open_ & third
        rule: list[Condition] = []
        inside = grow.copy()
        while len(rule) < conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best: tuple[float, Condition] | None = None
            for name in sorted(x):
                v = x[name][inside]
                cuts = np.unique(np.quantile(v, np.linspace(0, 1, 64), method="nearest")) if v.size else v
                order = np.argsort(v, kind="stable")
                good_first = np.concatenate([[0], np.cumsum(bad[inside][order])])
                at = np.searchsorted(v[order], cuts, side="left")
                below_p, below_n = good_first[at], at - good_first[at]
                for above, p, q in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))), 0.0)
                    k = int(np.argmax(gain)) if gain.size else 0
                    if gain.size and gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                        best = (float(gain[k]), Condition(name, above, float(cuts[k])))
            if best is None:
                break
            rule.append(best[1])
            inside &= best[1].holds(x)

        def worth(size: int) -> float:
            hit = _covered(rule[:size], x, n) & prune
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        if rule and prune.any():
            size = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
            rule = rule[:size]
        hit = _covered(rule, x, n) & open_
        if not rule or hit.sum() < support or (hit & bad).sum() < precision * hit.sum():
            break
        out.append(tuple(rule))
        open_ &= ~hit
    return DecisionList(tuple(out))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAIN_ROWS) -> DecisionList:
    """The list learned from at most about ``limit`` labelled documents; label 0 is bad.

    The sample is chosen by a hash of the label's key, so neither the broadcast nor what reaches the driver (seven rates
    a row) grows with the data. Labels without a document, documents without a label and null keys take no part; no
    labels give an empty list. Of repeated keys one document counts. Documents that the base rule rejects teach nothing.
    """
    sample = F.broadcast(label_sample(labels, key, label, limit))
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).join(sample, "key")
    found = statistics(one_each(rows)).where(~failed()).select("rest.key", "rest.y", *rates()).toPandas()
    found = found.sort_values("key", kind="stable")
    return learn({name: found[name].to_numpy(dtype=float) for name in RATES}, (found["y"] == 0).to_numpy())


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (the place of the first learned rule that holds, else null) and kept."""
    out = stats.select("*", *rates()).select("*", failed().alias("base_failed"), rules.when().alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's counts, rates and verdict, with the list learned from ``labels``.

    A null or empty text fails the base rule; a null id is judged like any other; repeated rows are judged each.
    """
    rules = fit(docs, labels, key, text)
    rows = judged(statistics(docs.select(quoted(key), quoted(text)), text), rules)
    return rows.select(F.col("rest")[key].alias(key), *COUNTS, *RATES, "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they came."""
    rules = fit(docs, labels, key, text)
    return unpacked(judged(statistics(docs, text), rules).where("kept"), docs.columns, text)
