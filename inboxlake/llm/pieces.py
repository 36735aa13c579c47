"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words are held as one flat array of symbols. In each round every word finds its best pair (least rank, then leftmost) by a
segmented minimum, all words merge theirs at once, and the array is compacted; words without a pair leave. Rounds go on until no word is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, packed

#: What stands for a space in pieces, and the text of the unknown id (fixed values).
SPACE, UNKNOWN = "▁", " ⁇ "

#: Words whose ids a Python worker remembers, and the longest that it does.
MEMORY, LONGEST = 600_000, 64

_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NONE = np.int64(1) << 62


class Pieces:
    """The vocabulary of a BPE model file with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        name = [model.id_to_piece(i) for i in range(n)]
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte = {int(name[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        own = {x: i for i, x in enumerate(name) if not odd[i]}
        #: ids of characters; those that only longer pieces have get numbers beyond the vocabulary
        self.char = {x: i for x, i in own.items() if len(x) == 1}
        for x in own:
            for c in x:
                self.char.setdefault(c, n + len(self.char))
        self.spelled = {i: c for c, i in self.char.items() if i >= n}
        self.size = n
        symbol = own | self.char
        pairs: dict[tuple[int, int], int] = {}
        for x, i in own.items():
            for cut in range(1, len(x)):
                a, b = symbol.get(x[:cut]), symbol.get(x[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        score = {i: model.get_score(i) for i in pairs.values()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        made = np.array(list(pairs.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.rank = np.array([place[score[i]] for i in self.made.tolist()], dtype=np.int64)
        self.of_point = np.full(0x110000, -1, dtype=np.int64)
        for c, i in self.char.items():
            self.of_point[ord(c)] = i
        #: whether words can be cut before every space that follows another character
        self.cuts = not any(SPACE in x.lstrip(SPACE) for x in own)
        self.bytes = [name[i].replace(SPACE, " ").encode() if not odd[i] else b"" for i in range(n)]
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        self.bytes[self.unknown] = UNKNOWN.encode()
        self.prefixed = [x.startswith(SPACE) and not o for x, o in zip(name, odd)]
        self.known: dict[str, bytes] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols; no pair has the greatest rank."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.made[at], -1)

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of words that are encoded on their own; none is empty."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        symbol = self.of_point[points]
        # an unknown character is a negative symbol that remembers what it is
        symbol = np.where(symbol < 0, -1 - points.astype(np.int64), symbol)
        word = np.repeat(np.arange(len(words)), list(map(len, words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._ranked(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            many = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), many)
            over = best == _NONE
            if over.any():
                done.append((word[over], symbol[over]))
                keep = ~over
                symbol, word, rank, made, best = symbol[keep], word[keep], rank[keep], made[keep], best[keep]
                if not len(symbol):
                    break
            at = self._together(np.flatnonzero(rank == best), symbol, word, rank, made)
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            for near in (now, np.maximum(now - 1, 0)):
                rank[near], made[near] = self._ranked(symbol, word, near)
        where, symbols = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(where, kind="stable")
        where, symbols = where[order], symbols[order]
        begin = np.searchsorted(where, np.arange(len(words)))
        odd = np.logical_or.reduceat((symbols < 0) | (symbols >= self.size), begin).tolist()
        flat, ends = symbols.astype("<i4").tobytes(), [*begin[1:].tolist(), len(symbols)]
        return [
            np.array([i for s in symbols[lo:hi].tolist() for i in self._ids(s)], dtype="<i4").tobytes() if strange else flat[4 * lo : 4 * hi]
            for lo, hi, strange in zip(begin.tolist(), ends, odd)
        ]

    def _together(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the places of every word's best pair, those that are merged next, one after the other from the left.

        The first, and after it every other of those that overlap, up to the first whose new neighbours form a pair that is as good or better.
        """
        leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        if leftmost.all():
            return at
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | leftmost[1:]]))
        since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        at = at[since % 2 == 0]
        result, last = made[at], len(symbol) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        merged_before = np.concatenate([[False], at[1:] == at[:-1] + 2])
        left = np.where((at > 0) & (word[before] == word[at]), np.where(merged_before, result, symbol[before]), -1)
        right = np.where((at + 2 <= last) & (word[after] == word[at]), symbol[after], -1)
        turns = (self._pairs(left, result)[0] <= rank[at]) | (self._pairs(result, right)[0] <= rank[at])
        earlier = np.cumsum(turns) - turns
        first = np.flatnonzero(np.concatenate([[True], word[at[1:]] != word[at[:-1]]]))
        return at[earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))]

    def _ranked(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at the places given."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, made = self._pairs(symbol[at], symbol[after])
        alone = (after == at) | (word[after] != word[at])
        return np.where(alone, _NONE, rank), np.where(alone, -1, made)

    def _ids(self, symbol: int) -> list[int]:
        if 0 <= symbol < self.size:
            return [symbol]
        c = self.spelled[symbol] if symbol >= 0 else chr(-1 - symbol)
        return [self.byte[b] for b in c.encode()] if len(self.byte) == 256 else [self.unknown]

    def words(self, text: str) -> list[str]:
        """A text's parts that no piece reaches across; together they spell it with the dummy prefix."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if not self.cuts:
            return [SPACE + text]
        if SPACE + SPACE in text or text[0] == SPACE or text[-1] == SPACE:
            return _RUNS.findall(SPACE + text)
        return [SPACE + x for x in text.split(SPACE)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without begin or end; an empty text has none."""
        split = [self.words(x) for x in texts]
        new = list({x for parts in split for x in parts}.difference(self.known))
        here = dict(zip(new, self.merged(new)))
        if len(self.known) + len(here) > MEMORY:
            old = {x for parts in split for x in parts}.difference(here)
            self.known = {x: self.known[x] for x in old}
        self.known.update(here)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype="<i4") for parts in split]
        for x in here:
            if len(x) > LONGEST:
                del self.known[x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, byte pieces as UTF-8, without the space that the dummy prefix added."""
        text = b"".join(map(self.bytes.__getitem__, ids))
        if len(ids) and self.prefixed[ids[0]]:
            text = text[1:]
        return text.decode("utf-8", "replace")


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row per document: ``rest`` (a struct of its other columns), ids (array of int) and decoded (string).

    Whole texts; a null or empty one has no ids and decodes to the empty string. ``model`` is a file that every executor
    can read. Nothing is shuffled.
    """
    rows = packed(docs, text)
    schema = extended(rows.select("rest"), "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for block in blocks(batches, limit=1 << 20):
            ids = pieces.encode([x or "" for x in block.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [block.column("rest"), lists, pa.array([pieces.decode(x.tolist()) for x in ids], pa.string())],
                names=["rest", "ids", "decoded"],
            )

    return rows.mapInArrow(run, schema)
