"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

A level array holds how many partially filled windows there are of each fill. Each document's last piece goes to the
fill whose choice leaves the least sum of squared counts, or to a new window; pieces of a whole window stand alone. What is
partially filled at the end of a task is cut anew into full windows, and the last few tokens into windows of powers of two, which
need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, quoted
from inboxlake.llm.memo import Memo

#: Tokens of a window, and the id that ends a document.
WINDOW, END = 2048, 1

#: Partially filled windows that a task holds before it cuts them anew.
OPEN = 4096

#: Marks that end words.
MARKS = ".,;:!?|#*$%&"

#: Words whose ids a Python worker remembers, and the longest that it does; words that are encoded in one call.
MEMORY, LONGEST, TOGETHER = 400_000, 64, 10_000


#: Letters of byte-level vocabularies: these code points stand for themselves, the other bytes for 256, 257, ... in order (fixed values).
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    other = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers; ids of words are remembered.

    Byte-level pre-tokenisation starts a token at every space and line feed between characters that are not white, so a text can be
    cut there and its parts, each with the space or line feed before it, encoded on their own. A text with other spaces is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their names in a text are ordinary text
        names = self.model.get_vocab()
        #: of a space and a line feed: the ids that begin with it, which byte-level vocabularies write as these letters
        self.first = {}
        for space, letter in ((" ", "\u0120"), ("\n", "\u010a")):
            self.first[space] = np.zeros(max(names.values()) + 1, dtype=bool)
            self.first[space][[i for x, i in names.items() if x.startswith(letter)]] = True
        self.marks = {x: self.raw(x).tolist() for x in MARKS}
        self.single = self._single(names)
        self.memo = Memo(["<u4"], apart=True, memory=MEMORY, longest=LONGEST)

    def _single(self, names: dict[str, int]):
        """A faster encoder of one pre-token, from the ranks of this vocabulary; None if its ids do not ascend with its merges."""
        import json

        import tiktoken

        letter = byte_letters()
        merges = json.loads(self.model.to_str())["model"]["merges"]
        made = [names.get("".join(x if isinstance(x, list) else x.split(" ")), -1) for x in merges]
        ranks = {bytes(letter[c] for c in x): i for x, i in names.items() if all(c in letter for c in x)}
        if any(a >= b for a, b in zip(made, made[1:])) or not made or made[0] < 0 or any(bytes([b]) not in ranks or ranks[bytes([b])] > made[0] for b in range(256)):
            return None
        kept = set(made)
        own = {x: i for x, i in ranks.items() if len(x) == 1 or i in kept}
        return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=own, special_tokens={})._core_bpe.encode_single_piece

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def words(self, space: str, parts: list[str]) -> list[bytes]:
        """Ids of parts without ``space``, each after one: all in one call, cut where an id begins with it."""
        if len(parts) > TOGETHER:
            return [x for lo in range(0, len(parts), TOGETHER) for x in self.words(space, parts[lo : lo + TOGETHER])]
        if not parts:
            return []
        ids = self.raw(space + space.join(parts))
        starts = np.flatnonzero(self.first[space][ids])
        if len(starts) != len(parts):
            return [self.raw(space + x).tobytes() for x in parts]
        flat, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
        return [flat[a:b] for a, b in zip((4 * starts).tolist(), ends)]

    def parts(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of parts of texts, each after a space or beginning with its line feed: all ids in a row, how many each has, and which can't be encoded on their own.

        A part that begins with a space is encoded without it.
        """
        found, odd, marks, single = [], [], self.marks, self.single
        for i, x in enumerate(new):
            if single and x.isalpha():
                found.append(single(b" " + x.encode()))
            # a mark after letters is an id of its own
            elif single and x[-1:] in marks and x[:-1].isalpha():
                found.append([*single(b" " + x[:-1].encode()), *marks[x[-1]]])
            else:
                found.append(())
                odd.append(i)
        bad = np.zeros(len(new), dtype=bool)
        lines = [i for i in odd if new[i][:1] == "\n"]
        plain = [i for i in odd if not new[i][:1].isspace()]
        for space, some, own in (("\n", lines, [new[i][1:] for i in lines]), (" ", plain, [new[i] for i in plain])):
            # other white space can't be cut off
            some = [(i, x) for i, x in zip(some, own) if x and not x[0].isspace()]
            for (i, _), ids in zip(some, self.words(space, [x for _, x in some])):
                found[i] = np.frombuffer(ids, dtype="<u4").tolist()
        for i in odd:
            if new[i][:1] == " ":
                found[i] = self.raw(new[i][1:]).tolist()
            elif not found[i]:
                bad[i] = True
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes.sum())), sizes, bad

    def _made(self, new: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        ids, sizes, bad = self.parts(new)
        return [(ids, sizes)], bad

    def of(self, texts: pa.Array | list[str], end: int | None = None) -> list[memoryview]:
        """The ids of each text as bytes, with the id ``end`` after them if one is given; a null text counts as empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        number, ends, bad = self.memo.numbered(texts, self._made)
        size, mark = self.memo.sizes(0, number), int(end is not None)
        many = np.add.reduceat(size, np.concatenate([[0], ends[:-1]])) + mark
        if mark:
            ids = np.full(int(many.sum()), end, dtype="<u4")
            own = np.ones(len(ids), dtype=bool)
            own[np.cumsum(many) - 1] = False
            ids[own] = self.memo.results(0, number)
        else:
            ids = self.memo.results(0, number)
        flat, to = memoryview(ids.tobytes()), 4 * np.cumsum(many)
        out = [flat[a:b] for a, b in zip((to - 4 * many).tolist(), to.tolist())]
        for i in np.flatnonzero(bad).tolist():
            whole = self.raw(texts[i].as_py())
            out[i] = memoryview((np.append(whole, np.uint32(end)) if mark else whole).astype("<u4").tobytes())
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """The tokens of a vocabulary file, kept by a Python worker from task to task."""
    return Tokens(path)


class Packer:
    """Windows of one task. ``place`` takes a document's ids and yields finished pieces; ``close`` yields the rest.

    A piece is (document, start, ids, sequence, offset), ids as bytes of four for each.
    """

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.sequence = window, first
        self.level = np.zeros(window + 1, dtype=np.int64)  # N(h): windows filled to h, 0 < h < window
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # their pieces
        self.held = 0

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def choose(self, size: int) -> int:
        """The fill to place a piece of ``size`` on: the least sum of squares, then the fullest; 0 is a new window."""
        fill = np.flatnonzero(self.level[: self.window - size + 1])
        if not len(fill):
            return 0
        n = self.level[fill]
        change = 2 * (self.level[fill + size] - n) + 2
        if fill[-1] + size == self.window:
            change[-1] = 1 - 2 * n[-1]  # a window that becomes full is counted no more
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(fill[best]) if change[best] <= 2 * self.level[size] + 1 else 0

    def place(self, document, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            # bytes, as Arrow never lets go of a memoryview that it made a binary value of
            yield document, at, bytes(ids[4 * at : 4 * (at + self.window)]), self._next(), 0
            at += self.window
        size = total - at
        if not size:
            return
        h = self.choose(size)
        pieces = [(document, at, bytes(ids[4 * at :]))]  # a copy, as the ids of a whole block stand behind ``ids``
        if h:
            pieces = self.open[h].pop() + pieces
            self.level[h] -= 1
            self.held -= 1
        if h + size == self.window:
            yield from self._whole(pieces)
        else:
            self.open[h + size].append(pieces)
            self.level[h + size] += 1
            self.held += 1
            if self.held > OPEN:
                yield from self.close()

    def _whole(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._next(), 0
        for document, start, ids in pieces:
            yield document, start, ids, sequence, offset
            offset += len(ids) // 4

    def close(self) -> Iterator[tuple]:
        """Cuts what is partially filled into full windows, and the rest into windows of powers of two."""
        waiting = [p for stack in self.open[::-1] for pieces in stack for p in pieces]
        left = sum(len(ids) // 4 for _, _, ids in waiting)
        self.open = [[] for _ in range(self.window + 1)]
        self.level[:] = 0
        self.held = 0
        waiting.reverse()
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= size
            pieces = []
            while size:
                document, start, ids = waiting.pop()
                n = min(size, len(ids) // 4)
                pieces.append((document, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    waiting.append((document, start + n, ids[4 * n :]))
                size -= n
            yield from self._whole(pieces)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end``; a null or empty text is ``end`` alone. Every id is in exactly one
    piece. Tasks pack on their own, so no document moves; a sequence lies in one task and its id begins with the task's
    number. ``tokenizer`` is a file that every executor can read. Null ids and repeated rows are documents like any other.
    """
    rows = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        id_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            docs_, starts, ids, sequences, offsets = zip(*pieces)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in docs_], id_type),
                    pa.array(starts, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([n for _, n in docs_], pa.int64()),
                    pa.array(sequences, pa.int64()),
                    pa.array(offsets, pa.int64()),
                ],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for block in blocks(batches, limit=1 << 21):
            id_type = block.schema.field("id").type
            pieces = []
            for document, ids in zip(block.column("id").to_pylist(), known.of(block.column("text"), end)):
                pieces += packer.place((document, len(ids) // 4), ids)
            if pieces:
                yield batch_of(pieces)
            pa.default_memory_pool().release_unused()  # Arrow keeps what the parts of a block took
        pieces = list(packer.close())
        for lo in range(0, len(pieces), 4096):
            yield batch_of(pieces[lo : lo + 4096])

    out = rows.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key) if key != "id" else out
