"""URL verdicts: rules on host and path, else logistic regression on hashed character n-grams of both."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import extended, quoted

#: Slots of hashed n-grams, and the lengths of n-grams.
SLOTS, GRAMS = 1 << 15, (3, 4, 5)

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of unwanted and of ordinary hosts, and the addresses that both are put into.
UNWANTED = (
    "ads", "adserver", "adult", "banner", "bet", "bets", "bonus", "casino", "cheap", "click", "coupon", "dating", "escort", "free",
    "gamble", "jackpot", "loan", "lottery", "payday", "pharma", "pills", "poker", "popup", "porn", "promo", "replica",
    "slots", "spam", "spamlist", "tracker", "track", "viagra", "warez", "win", "xxx",
)
ORDINARY = (
    "archive", "art", "atlas", "bible", "biology", "books", "city", "college", "culture", "garden", "health", "history",
    "journal", "kitchen", "law", "letters", "library", "maps", "math", "museum", "music", "mountain", "nature", "news", "paper", "poems", "recipes",
    "school", "science", "stories", "theatre", "travel", "university", "weather", "wiki",
)
ADDRESSES = (
    "https://{0}.example.com/en/1204", "http://www.{0}.example.org/fr/88.html", "https://m.{0}-{1}.example.net/de/7/",
    "https://{1}-{0}.example.com/es/311?page=2", "http://blog.{0}{1}.example.org/en/45#top", "https://{0}-{1}.example.org/it/5120",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if unwanted), every word in every address, with a neighbour of its kind."""
    return [
        (address.format(word, words[(k + 1) % len(words)]), label)
        for label, words in ((1, UNWANTED), (0, ORDINARY))
        for k, word in enumerate(words)
        for address in ADDRESSES
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Both are empty for null and for a url without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _CAPITALS, _SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule_column(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as text like ``net/es/``, or null; of equal lengths the first given."""
    longest = sorted(rules, key=lambda r: -len(str(r)))
    return F.coalesce(*[F.when(r.fits(host, path), F.lit(str(r))) for r in longest], F.lit(None).cast("string"))


def slots(host: str, path: str) -> np.ndarray:
    """Distinct slots of the n-grams of a host (with its ends marked) and of a path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", path)):
        for n in GRAMS:
            found.update(zlib.crc32((kind + text[i : i + n]).encode("utf-8", "replace")) % SLOTS for i in range(len(text) - n + 1))
    return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class Model:
    b: float
    w: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Chance of being unwanted; without any n-gram only the intercept counts."""
        raw = np.array([self.b + self.w[x].sum() / np.sqrt(max(1, len(x))) for x in rows], dtype=float)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: list[np.ndarray], y: np.ndarray, rounds: int = 300, rate: float = 0.2, ridge: float = 1e-2, prior: float = 0.05) -> Model:
    """Logistic regression by gradient descent with AdaGrad steps and a ridge; without rows every score is one half.

    Rows are weighted so that unwanted ones make up the share ``prior``: a url without known n-grams then is an ordinary one.
    """
    m = Model(0.0, np.zeros(SLOTS))
    if not rows:
        return m
    at = np.concatenate(rows)
    each = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    x = (1 / np.sqrt(np.maximum(1, list(map(len, rows)))))[each]
    gw, gb = np.full(SLOTS, 1e-8), 1e-8
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    for _ in range(rounds):
        d = (m.scores(rows) - y) * weight
        dw, db = np.bincount(at, d[each] * x, SLOTS) + ridge * m.w / len(rows), d.sum()
        gw, gb = gw + dw * dw, gb + db * db
        m.w -= rate * dw / np.sqrt(gw)
        m.b -= rate * db / np.sqrt(gb)
    return m


def trained(table: Sequence[tuple[str, int]]) -> Model:
    """A model of a small labelled table, split like ``host_and_path`` does."""
    rows, y = [], []
    for url, label in table:
        rest = url.partition("://")[2]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        tail = rest[end:]
        stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
        rows.append(slots(rest[:end].translate(str.maketrans(_CAPITALS, _SMALL)), tail[:stop]))
        y.append(label)
    return train(rows, np.array(y, dtype=float))


def judged(pages: DataFrame, rules: Sequence[Rule], table: Sequence[tuple[str, int]] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score of every page.

    A rule's verdict goes before the model's, which blocks from a score of one half on. Null urls and urls without a host are
    judged by the model's intercept alone. Repeated rows are judged each; nothing is shuffled.
    """
    model = trained(labelled_urls() if table is None else table)
    host, path = host_and_path(F.col(quoted(url)))
    rows = pages.select(F.col(quoted(key)).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_column(rules, F.col("host"), F.col("path")).alias("rule"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [slots(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(some), pa.float64())], names=[*batch.schema.names, "score"])

    out = rows.mapInArrow(run, extended(rows, "score double"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    said = F.coalesce(*[F.when(F.col("rule") == str(r), F.lit(r.verdict)) for r in rules], own)
    return out.select(F.col("id").alias(key), "host", "path", "rule", said.alias("verdict"), "score")
