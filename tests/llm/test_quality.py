"""Quality rules and the factorisation machine."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inboxlake.llm import factorisation, quality_rules
from inboxlake.llm.quality_rules import Condition, DecisionList, learn
from inboxlake.llm.queries import QUERIES
from inboxlake.llm.statistics import COUNTS, counts, repeated_words

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts of the contract, counted the slow way."""
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", "a a a a a a a", "a b c d e f a b c d e", "x\ny\nx\n \n \n", "é|<>\x0b#\x1c$ ü", "日本 語\u2028x", "a b c d e " * 50])
def test_counts(text):
    assert counts(text.encode())[:5] == plain(text)


def test_repeated_words_need_equal_words():
    assert repeated_words([b"ab", b"c", b"d", b"e", b"f", b"a", b"bc", b"d", b"e", b"f"]) == 0


def test_rules_by_hand():
    x = {"a": np.array([0.1, 0.2, 0.9, 0.95, 0.3, 0.92] * 30), "b": np.array([1.0, 0, 0, 1, 0, 1] * 30)}
    bad = np.array([False, False, False, True, False, True] * 30)
    rules = learn(x, bad)
    hit = np.zeros(len(bad), dtype=bool)
    for rule in rules.rules:
        hit |= np.all([c.holds(x) for c in rule], axis=0)
    assert (hit == bad).all() and all(len(rule) <= 2 for rule in rules.rules)


def test_no_rules_without_labels_or_bad_rows(spark, awkward, nothing):
    assert learn({"a": np.zeros(0)}, np.zeros(0, dtype=bool)) == DecisionList()
    assert learn({"a": np.arange(50.0)}, np.zeros(50, dtype=bool)) == DecisionList()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(awkward, none) == DecisionList()
    assert quality_rules.fit(nothing, none) == DecisionList()


def test_first_rule_in_order(spark):
    rules = DecisionList(((Condition("a", True, 2.0),), (Condition("a", True, 1.0), Condition("b", False, 5.0))))
    rows = spark.createDataFrame([(3.0, 1.0), (1.5, 1.0), (1.5, 9.0)], "a double, b double")
    assert [r[0] for r in rows.select(rules.when()).collect()] == [1, 2, None]


def test_rules_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeats = want = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_rules_learned_separate_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels.where("doc_id % 3 <> 0"))
    found = quality_rules.judged(quality_rules.statistics(docs.join(labels.where("doc_id % 3 = 0"), "doc_id")), rules).where("not base_failed")
    rows = found.groupBy(F.col("rest.quality").alias("y"), "kept").count().collect()
    n = {(r.y, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.15 * n[0, False]


def test_rules_on_awkward_rows(awkward, labels, nothing):
    rows = quality_rules.quality_rules(awkward, labels).collect()
    assert len(rows) == awkward.count()
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)
    kept = quality_rules.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.where("doc_id = 4").count() == 3
    assert quality_rules.quality_rules(nothing, labels).count() == 0


def test_pairs_in_linear_time():
    draw = np.random.default_rng(1)
    m = factorisation.Machine(0.3, draw.normal(size=9), draw.normal(size=(9, 4)))
    rows = [(np.array([1, 4, 7]), np.array([0.5, 1.0, -2.0])), (np.array([2]), np.array([3.0]))]
    slow = [m.b + sum(m.w[i] * a for i, a in zip(at, x)) + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i)) for at, x in rows]
    assert np.allclose(m.score(rows), 1 / (1 + np.exp(-np.array(slow))))


def test_machine_learns_an_interaction():
    """Exclusive or has no linear part."""
    rows = [(np.array([a, 2 + b]), np.ones(2)) for a in (0, 1) for b in (0, 1)] * 50
    y = np.array([a ^ b for a in (0, 1) for b in (0, 1)] * 50, dtype=float)
    m = factorisation.train(rows, y, slots=4, rounds=200, batch=20)
    assert ((m.score(rows) > 0.5) == (y > 0)).all()


def test_classifier_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_factorisation_machine"](spark, folder).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_classifier_takes_no_held_out_label(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    out = [i for i in (4, 5, 7, 8, 9) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(out), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (factorisation.fit(awkward, x) for x in (labels, turned))
    assert (one.v == two.v).all() and one.b == two.b


def test_classifier_on_awkward_rows(spark, awkward, labels, nothing):
    rows = factorisation.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    kept = factorisation.keep_likely(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert factorisation.quality_scores(nothing, labels).count() == 0


def test_names_of_counts_are_columns(awkward):
    assert set(COUNTS) <= set(quality_rules.statistics(awkward).columns)


def test_a_label_of_very_many_rows_reaches_the_driver_once(spark):
    from inboxlake.llm.common import label_sample, one_each

    rows = spark.createDataFrame([(1, f"text {i % 7}", 1) for i in range(2000)] + [(2, None, 0)], "key long, text string, y int").repartition(5)
    once = sorted(map(tuple, one_each(rows).collect()), key=str)
    assert [r[0] for r in once] == [1, 2] and once == sorted(map(tuple, one_each(rows.repartition(3)).collect()), key=str)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, label_sample(labels, "doc_id", "quality", 10).collect())) == [(1, 0), (2, 1)]
