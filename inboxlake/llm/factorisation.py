"""A factorisation machine for text quality.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over hashed words, binned structure statistics and
optional metadata. The pairwise part is computed in linear time as (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, label_sample, one_each, packed, quoted, texts, unpacked
from inboxlake.llm.statistics import COUNTS, counts

#: Labelled documents that a machine is fitted on, at most about.
TRAIN_ROWS = 8_000

#: Slots of hashed features and rank of their interactions.
SLOTS, RANK = 1 << 14, 8

#: Distinct words whose slots a Python worker remembers.
MEMORY = 200_000


class Features:
    """Sparse features of texts: words as unit-length square roots of counts, statistics and metadata as indicators."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.seen = slots, {}

    def word(self, x: bytes) -> int:
        at = self.seen.get(x)
        if at is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            at = self.seen[x] = zlib.crc32(x) % self.slots
        return at

    def of(self, text: bytes, metadata: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of one whole text. Of an empty text only the indicators are left."""
        words = Counter(text.split())
        at = np.fromiter(map(self.word, words), dtype=np.int64, count=len(words))
        x = np.sqrt(np.fromiter(words.values(), dtype=np.float64, count=len(words)))
        x /= np.sqrt((x * x).sum()) or 1.0
        marks = [zlib.crc32(m.encode()) % self.slots for m in (*bins(text), *metadata)]
        return np.concatenate([at, np.array(marks, dtype=np.int64)]), np.concatenate([x, np.ones(len(marks))])


def bins(text: bytes) -> list[str]:
    """Structure statistics as names of bins of fixed width: an eighth of a power of two for sizes, a twentieth for shares."""
    c = dict(zip(COUNTS, counts(text)))
    share = lambda a, b: int(20 * min(1.0, c[a] / max(1, c[b])))
    return [
        f"words {int(np.log2(c['n_words'] + 1))}",
        f"symbols {share('n_symbols', 'n_words')}",
        f"repeats {share('n_repeat_words', 'n_words')}",
        f"lines {share('n_dup_lines', 'n_lines')}",
        f"capitals {share('n_upper', 'word_chars')}",
        f"digits {share('n_digits', 'word_chars')}",
        f"same {share('n_same_words', 'n_words')}",
        f"length {int(c['word_chars'] / max(1, c['n_words']))}",
    ]


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row starts of rows that each have a feature or more."""
    starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])[:-1]]).astype(np.int64)
    return np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), starts


@dataclass
class Machine:
    b: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return self.b + np.add.reduceat(self.w[at] * x, starts) + pairs, s, vx

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*stacked(rows))[0], -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, slots: int = SLOTS, rank: int = RANK, rounds: int = 8, batch: int = 256, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """A machine fitted by AdaGrad on the logistic loss, the same for the same rows in the same order.

    Without rows every score is one half; with one label only, the machine learns that share.
    """
    draw = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(slots), draw.normal(0, 0.05, (slots, rank)))
    gw, gv, gb = np.full(slots, 1e-6), np.full((slots, rank), 1e-6), 1e-6
    for _ in range(rounds if rows else 0):
        order = draw.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = order[lo : lo + batch]
            at, x, starts = stacked([rows[i] for i in some])
            score, s, vx = m.raw(at, x, starts)
            d = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[some]) / len(some)
            each = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(at))))
            dx = d[each] * x
            slots_here, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, dx) + decay * m.w[slots_here]
            full = dx[:, None] * (s[each] - vx)
            dv = np.stack([np.bincount(inverse, full[:, k]) for k in range(rank)], axis=1) + decay * m.v[slots_here]
            gw[slots_here] += dw * dw
            gv[slots_here] += dv * dv
            gb += d.sum() ** 2
            m.w[slots_here] -= rate * dw / np.sqrt(gw[slots_here])
            m.v[slots_here] -= rate * dv / np.sqrt(gv[slots_here])
            m.b -= rate * d.sum() / np.sqrt(gb)
    return m


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from: one in five, by the CRC-32 of the key as text. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), limit: int = TRAIN_ROWS) -> Machine:
    """A machine for ``label``, fitted on at most about ``limit`` labelled documents that are not held out.

    The sample is chosen by a hash of the label's key. The executors turn its texts into features; the driver collects
    those, some hundred numbers a document and never more than one for each slot, and fits. Labels, key, language and source
    are no inputs of a score unless ``metadata`` names a column.
    """
    sample = F.broadcast(label_sample(labels.where(~held_out(F.col(quoted(key)))), key, label, limit))
    named = [F.col(quoted(c)).cast("string").alias(f"m{k}") for k, c in enumerate(metadata)]
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), *named).join(sample, "key")
    rows = one_each(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for block in blocks(batches):
            marks = _marks(block, metadata)
            sparse = []
            for x, m in zip(texts(block), marks):
                at, value = features.of(x, m)
                slots, inverse = np.unique(at, return_inverse=True)
                sparse.append((slots, np.bincount(inverse, value)))
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), block.column("y"), pa.array([a.astype(np.int32) for a, _ in sparse], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in sparse], pa.list_(pa.float32()))],
                names=["key", "y", "at", "x"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, y int, at array<int>, x array<float>").toPandas()
    found = found.sort_values("key", kind="stable")
    return train([(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=np.float64)) for a, x in zip(found["at"], found["x"])], found["y"].to_numpy(dtype=float))


def _marks(block: pa.RecordBatch, metadata: tuple[str, ...]) -> list[tuple[str, ...]]:
    columns = [block.column(f"m{k}").to_pylist() for k in range(len(metadata))]
    return [tuple(f"{name}={value}" for name, value in zip(metadata, row)) for row in zip(*columns)] if columns else [()] * block.num_rows


def scored(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``rest``, ``text`` and ``score``, 0 to 1. A null text scores as an empty one."""
    rows = packed(docs, text)
    named = [F.col("rest")[c].cast("string").alias(f"m{k}") for k, c in enumerate(metadata)]
    schema = extended(rows, "score double")
    # about a megabyte for every task, whatever the data's size
    model = docs.sparkSession.sparkContext.broadcast((machine.b, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w, v = model.value
        machine, features = Machine(b, w, v), Features(len(w))
        for block in blocks(batches):
            scores = machine.score([features.of(x, m) for x, m in zip(texts(block), _marks(block, metadata))])
            yield pa.RecordBatch.from_arrays([block.column("rest"), block.column("text"), pa.array(scores, pa.float64())], names=["rest", "text", "score"])

    return rows.select("*", *named).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score and predicted (1 from ``threshold`` on) of every document, empty texts too."""
    machine = fit(docs, labels, key, text)
    rows = scored(docs.select(quoted(key), quoted(text)), machine, text)
    return rows.select(
        F.col("rest")[key].alias(key), held_out(F.col("rest")[key]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_likely(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns as they came."""
    machine = fit(docs, labels, key, text)
    return unpacked(scored(docs, machine, text).where(F.col("score") >= threshold), docs.columns, text)
