"""Packing of tokenized documents into sequences by the online sum-of-squares rule.

Whole windows are cut off a long document first. What is left of it goes to the fill level that minimises the sum of
squared counts of partially filled windows; the counts are a level array, so a choice is one vector operation. Windows
that fill up leave at once. When a task ends, or too many windows are open, the open ones are filled from each other by
cutting, fullest first, until one at most is partly filled; the last one of a task is cut into sequences whose lengths
are powers of two, which need no padding.

Scale: one pass without a shuffle; a task holds its open windows (`OPEN` at most) and a bounded table of words. As the
tokenizer folds case, drops white space and never joins across it, a text is the concatenation of its words' ids, and each different
word is tokenized once while it stays in the table. A lost task is computed again with the same result: sequence ids are
the partition and a number within it.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties between levels go to the
fullest; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

CAPACITY, END_ID = 4096, 2
OPEN, HOT, WORDS = 2048, 20_000, 250_000
VOCABULARY = "word_bpe_49k.json"
MARK = "\u00a7"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids (little-endian unsigned 32-bit) of texts, by words: some common ones and two generations of about `limit` are kept."""

    def __init__(self, path: str | None, limit: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path or vocabulary_path()), limit
        self.tables: list[dict[bytes, bytes]] = [{}, {}, {}]  # common, younger, older
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a piece
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _grouped(self, words: list[str], joint: str, ends) -> list[bytes]:
        """Many words are encoded as one text and cut where `ends` says; if that does not fit, one by one."""
        groups = [words[i:i + 500] for i in range(0, len(words), 500)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch([joint.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts, stops = ends(ids)
            if len(stops) != len(group):
                out += self._each(group)
                continue
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip((4 * starts).tolist(), (4 * stops).tolist())]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters are one piece each, so there are as many ends of pieces as words."""
        def ends(ids):
            stops = np.flatnonzero(self.closing[ids]) + 1
            return np.concatenate(([0], stops[:-1])), stops

        return self._grouped(words, " ", ends)

    def _others(self, words: list[str]) -> list[bytes]:
        """Other words are set apart by a mark of one id; a word that holds the mark makes the count differ."""
        def ends(ids):
            marks = np.flatnonzero(ids == self.mark)
            return np.concatenate(([0], marks + 1)), np.append(marks, len(ids))

        return self._grouped(words, f" {MARK} ", ends) if self.mark is not None else self._each(words)

    def _learn(self, fresh: set[bytes], words: dict, older: dict) -> None:
        # a full stop or comma after a letter is always a piece of its own
        ends = [w for w in fresh if w[-1] in b".," and 97 <= w[-2:][0] <= 122]
        fresh.difference_update(ends)
        fresh.update(w for e in ends for w in (e[:-1], e[-1:]) if w not in words)
        letters, others = [], []
        for w in fresh:
            text = w.decode("utf-8", "replace")
            (letters if text.isalpha() else others).append((w, text))
        for kind, encode in ((letters, self._letters), (others, self._others)):
            words.update(zip((w for w, _ in kind), encode([text for _, text in kind])))
        for w in ends:
            words[w] = words[w[:-1]] + words[w[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.tables[1]) > self.limit:
            self.tables[1:] = {}, self.tables[1]
        hot, words, older = self.tables
        fresh: set[bytes] = set()
        rows = []
        for text in texts:
            # bytes split at ASCII white space and fold A-Z only; a special token is matched as it is written
            split = (text if b"<|" in text else text.lower()).split()
            row = list(map(hot.get, split))
            rare = [w for w, ids in zip(split, row) if ids is None]
            for w in set(rare):
                if w not in words:
                    if w in older:
                        words[w] = older[w]
                    else:
                        fresh.add(w)
            rows.append((row, rare))
        learned = set(fresh)
        self._learn(fresh, words, older)
        out = []
        for row, rare in rows:
            ids_of = map(words.__getitem__, rare)
            out.append(b"".join([next(ids_of) if ids is None else ids for ids in row]))
        if len(hot) < HOT:  # the words met first are mostly the common ones; this table stays in the processor's cache
            hot.update((w, words[w]) for w in learned)
        return out


@lru_cache(maxsize=1)
def word_ids(path: str | None) -> WordIds:
    """The worker's own: tokenizer and words serve its later tasks too."""
    return WordIds(path)


class Packer:
    """Sum-of-squares packing. A piece is (row, start, ids); closed sequences are lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, open_limit: int = OPEN):
        self.capacity, self.open_limit = capacity, open_limit
        self.counts = np.zeros(capacity + 1, np.int64)  # the level array: open windows by fill
        self.at: dict[int, list[list]] = {}
        self.open = 0
        self.closed: list[list] = []

    def add(self, row, ids: bytes) -> None:
        n, full = len(ids) // 4, self.capacity
        whole = n - n % full
        for start in range(0, whole, full):
            self.closed.append([(row, start, ids[4 * start:4 * (start + full)])])
        if whole < n:
            self._place((row, whole, ids[4 * whole:]), n - whole)

    def level(self, size: int) -> int:
        """Fill of the window to take, 0 for a new one: the least change of the sum of squared counts."""
        full, counts = self.capacity, self.counts
        last = full - size
        change = 2 * (counts[1 + size:full + 1] - counts[1:last + 1]) + 2  # at levels 1 to last
        if last:
            change[-1] = 1 - 2 * counts[last]  # the window is full and leaves
            change[counts[1:last + 1] == 0] = np.iinfo(np.int64).max
            best = last - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * counts[size] + 1:
                return best + 1
        return 0

    def _place(self, piece, size: int) -> None:
        fill = self.level(size)
        if fill:
            window = self.at[fill].pop()
            self.counts[fill] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        if fill + size == self.capacity:
            self.closed.append(window)
            self.open -= 1
            return
        self.counts[fill + size] += 1
        self.at.setdefault(fill + size, []).append(window)
        if self.open > self.open_limit:
            self.settle()

    def settle(self) -> None:
        """Fill the open windows, fullest first, with pieces of the emptiest."""
        fills = [f for f in sorted(self.at, reverse=True) for _ in self.at[f]]
        windows = [w for f in sorted(self.at, reverse=True) for w in self.at[f]]
        self.at, self.open = {}, 0
        self.counts[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            gap = self.capacity - fills[i]
            while gap and windows[j]:
                row, start, ids = windows[j].pop()
                take = min(gap, len(ids) // 4)
                keep = len(ids) // 4 - take  # the end of the piece moves
                windows[i].append((row, start + keep, ids[4 * keep:]))
                if keep:
                    windows[j].append((row, start, ids[:4 * keep]))
                gap -= take
                fills[i] += take
                fills[j] -= take
            if not gap:
                self.closed.append(windows[i])
                i += 1
            if not windows[j]:
                j -= 1
        if i == j and windows[i]:
            self.at, self.open = {fills[i]: [windows[i]]}, 1
            self.counts[fills[i]] = 1

    def finish(self) -> None:
        self.settle()
        for fill, windows in list(self.at.items()):
            pieces = windows[0][::-1]
            for bit in reversed(range(fill.bit_length())):
                if fill >> bit & 1:
                    left, part = 1 << bit, []
                    while left:
                        row, start, ids = pieces.pop()
                        take = min(left, len(ids) // 4)
                        part.append((row, start, ids[:4 * take]))
                        if 4 * take < len(ids):
                            pieces.append((row, start + take, ids[4 * take:]))
                        left -= take
                    self.closed.append(part)
        self.at, self.open = {}, 0
        self.counts[:] = 0

    def take(self) -> list[list]:
        closed, self.closed = self.closed, []
        return closed


def _pack(kind: pa.DataType, path: str | None, capacity: int, end_id: int, open_limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = word_ids(path), Packer(capacity, open_limit)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in packer.take():
                offset = 0
                for (key, total), start, ids in window:
                    rows.append((key, start, len(ids) // 4, total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds)],
                                              ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for lo, hi, buf, off in c.blocks(batch.column(1)):
                data, at = buf.tobytes(), off.tolist()
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                for key, ids in zip(keys, coder.encode([data[a:b] for a, b in zip(at, at[1:])])):
                    ids += end
                    packer.add((key, len(ids) // 4), ids)
                yield out()
        packer.finish()
        yield out()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, open_limit: int = OPEN) -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    `vocabulary` is the path of a tokenizer file that every worker can open; by default the installed package's file.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    c.ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    got = source.mapInArrow(_pack(to_arrow_type(kind), vocabulary, capacity, end_id, open_limit),
                            f"id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return got.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the digest of `pack` over whole documents."""
    got = pack(c.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
