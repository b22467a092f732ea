"""Packing token sequences by the dot-product heuristic of vector bin packing.

A sequence has three limits: tokens, segments and loss-bearing tokens.  Of the waiting examples that fit as a whole, the
next one is that with the largest dot product of its needs and the room left, both in shares of the limits.  If none
fits, the one with the largest product is cut to fill the room; what is left of it waits on.  Examples longer than a
sequence give full sequences first.  A sequence that a limit on segments or loss closes early, or the end of a
partition, is cut into lengths that are powers of two, so that nothing is padded.

Each partition packs its own rows and keeps at most ``wait`` examples waiting, each shorter than a sequence, so nothing is
shuffled and memory is bounded; ``sequence_id`` holds the partition's number in its upper bits.  A repeated task
reads the same rows in the same order and packs them in the same way.

Tokenizing: texts are cut at ASCII white space, which the tokenizer drops, so a word's ids don't depend on its
neighbours (``plain`` adds blanks where it cuts); distinct words of a batch are encoded once and kept for the next batches of the task.

Edge cases: a NULL or empty text is the end id alone; repeated rows are packed as often as they come; an empty
table gives no sequence.  Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import in_arrow, pieces, table, words

#: Text that a task holds as words at once.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class Packer:
    """Packs examples that come one by one; ``out`` collects (key, start, ids, total, sequence, offset)."""

    def __init__(self, limits: Limits, first: int, wait: int = 1024):
        self.limits, self.sequence, self.wait, self.out = limits, first, wait, []
        self.waiting: list[tuple] = []  # key, start, ids, loss flags, tokens of the example
        self.needs = np.zeros((2 * wait, 3))
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float) ** 2

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> None:
        start, size, total = 0, self.limits.tokens, len(ids)
        while total - start >= size and int(loss[start:start + size].sum()) <= self.limits.loss:
            self._emit([(key, start, ids[start:start + size], None, total)])
            start += size
        while start < total:  # shorter than a sequence, or bearing more loss than one may
            stop = min(total, start + size)
            self._await(key, start, ids[start:stop], loss[start:stop], total)
            start = stop
        if len(self.waiting) >= self.wait:
            self.pack(self.wait // 2)

    def _await(self, key, start: int, ids: np.ndarray, loss: np.ndarray, total: int) -> None:
        i = len(self.waiting)
        if i == len(self.needs):
            self.needs = np.concatenate([self.needs, np.zeros_like(self.needs)])
        self.waiting.append((key, start, ids, loss, total))
        self.needs[i] = len(ids), 1, loss.sum()

    def _take(self, i: int) -> tuple:
        item, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i], self.needs[i] = self.waiting[last], self.needs[last]
        self.waiting.pop()
        return item

    def _emit(self, segments: list[tuple]) -> None:
        offset = 0
        for key, start, ids, _, total in segments:
            self.out.append((key, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _close(self, segments: list[tuple]) -> None:
        """A sequence that isn't full: in lengths of powers of two, the largest first."""
        left = sum(len(s[2]) for s in segments)
        while left:
            size = 1 << (left.bit_length() - 1)
            head, taken = [], 0
            while taken < size:
                key, start, ids, loss, total = segments[0]
                n = min(len(ids), size - taken)
                head.append((key, start, ids[:n], None, total))
                taken += n
                segments = segments[1:] if n == len(ids) else [(key, start + n, ids[n:], None, total), *segments[1:]]
            self._emit(head)
            left -= size

    def pack(self, down_to: int) -> None:
        """Closes sequences until at most ``down_to`` examples wait."""
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while len(self.waiting) > down_to:
            room, segments = limit.copy(), []
            while self.waiting and room[0] >= 1 and room[1] >= 1:
                needs = self.needs[:len(self.waiting)]
                product = needs @ (room * self.scale)
                fits = (needs <= room).all(1)
                if fits.any():
                    item = self._take(int(np.where(fits, product, -1).argmax()))
                else:
                    key, start, ids, loss, total = self._take(int(product.argmax()))
                    n = min(int(room[0]), int(np.searchsorted(np.cumsum(loss), room[2], "right")))
                    if n < len(ids):
                        self._await(key, start + n, ids[n:], loss[n:], total)
                    if not n:
                        break
                    item = (key, start, ids[:n], loss[:n], total)
                segments.append(item)
                room -= (len(item[2]), 1, item[3].sum())
            if room[0] == 0:
                self._emit(segments)
            else:
                self._close(segments)


def plain(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct words: a blank between an ASCII letter and the mark after it, where
    the tokenizer cuts anyway, and ASCII letters in lower case, as it reads them.  Where a text of the
    batch may hold a special token or marks that compose with letters, the case stays."""
    if not pc.any(pc.match_substring_regex(texts, r"<\||\p{M}")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2")


class Words:
    """Ids of words by a tokenizer file, each distinct word encoded once while it is kept; of more than ``most`` the older
    half goes."""

    def __init__(self, path: str, end: int, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.end = Tokenizer.from_file(path), most, end
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 1
        self.ids[0] = self.end
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.sizes[0], self.count = 1, 1  # entry 0 is the end id

    def _drop_older(self) -> None:
        """Keeps the newer half of the words; entry 0 stays."""
        first, count = self.count // 2, self.count - self.count // 2 + 1
        low, used = int(self.starts[first]), self.used - int(self.starts[first]) + 1
        self.known = {w: i - first + 1 for w, i in self.known.items() if i >= first}
        self.ids[1:used] = self.ids[low:self.used].copy()
        self.starts[1:count] = self.starts[first:self.count] - low + 1
        self.sizes[1:count] = self.sizes[first:self.count].copy()
        self.used, self.count = used, count

    def _encoded(self, new: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word).  Words of letters only, of which each ends with the one id that the
        vocabulary marks as a word's end, are encoded many in a line."""
        lines = [" ".join(new[i:i + 128]) for i in range(0, len(new), 128)] if letters else new
        found = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        if letters:
            sizes = np.diff(np.flatnonzero(self.closes[flat]) + 1, prepend=0)
        return flat, sizes

    def _learn(self, words_: pa.Array) -> None:
        simple = pc.match_substring_regex(words_, r"^\p{L}+$")
        for letters, new in ((True, words_.filter(simple)), (False, words_.filter(pc.invert(simple)))):
            part = new.to_pylist()
            if not part:
                continue
            flat, sizes = self._encoded(part, letters)
            if len(sizes) != len(part):  # a letter that the tokenizer reads otherwise
                flat, sizes = self._encoded(part, False)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.count + len(part) > len(self.sizes):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            here = slice(self.count, self.count + len(part))
            self.ids[self.used:self.used + len(flat)] = flat
            self.starts[here] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.sizes[here] = sizes
            self.known.update(zip(part, range(self.count, self.count + len(part))))
            self.used, self.count = self.used + len(flat), self.count + len(part)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of text i, the end id last, are ids[starts[i]:starts[i + 1]]."""
        starts, codes, distinct = words(plain(texts), lower=False)
        if self.count > self.most:
            self._drop_older()
        names = distinct.to_pylist()
        self._learn(distinct.filter(pa.array([w not in self.known for w in names], pa.bool_())))
        entry = np.fromiter(map(self.known.get, names, [0] * len(names)), np.int64, len(names))
        entries = np.insert(entry[codes], starts[1:], 0)
        sizes = self.sizes[entries]
        ends = np.cumsum(sizes)
        shift = (self.starts[entries] - ends + sizes).astype(np.int32)
        ids = self.ids[np.repeat(shift, sizes) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        last = starts[1:] + np.arange(len(texts))
        return ids, np.concatenate([[0], ends[last]]) if len(texts) else np.zeros(1, np.int64)


_KEPT: dict[tuple, Words] = {}  # of this Python worker


def encoder_of(path: str, end: int) -> Words:
    """Read once for all tasks of a worker."""
    if (path, end) not in _KEPT:
        _KEPT[path, end] = Words(path, end)
    return _KEPT[path, end]


def packed(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), end: int = 1,
           wait: int = 1024) -> DataFrame:
    """Rows of (key, start, ids, doc_tokens, sequence_id, offset), one for each piece; ``ids`` are little-endian
    unsigned 32-bit numbers.  Every token but a document's first bears loss."""
    slim = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(tokenizer, end), Packer(limits, TaskContext.get().partitionId() << 33, wait)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.out))
            packer.out = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), pa.array(columns[1], pa.int64()),
                 pa.array([x.astype("<u4").tobytes() for x in columns[2]], pa.binary()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                [key, "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            key_type = batch.column(key).type
            for piece in pieces(batch, text, PIECE_BYTES):
                ids, starts = encoder.encode(piece.column(text))
                for k, low, high in zip(piece.column(key).to_pylist(), starts[:-1], starts[1:]):
                    loss = np.ones(high - low, bool)
                    loss[0] = False
                    packer.add(k, ids[low:high].copy(), loss)
                if packer.out:
                    yield out()
        packer.pack(0)
        if packer.out:
            yield out()

    return in_arrow(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, start long, ids binary, "
                               "doc_tokens long, sequence_id long, offset long")


def pieces_of(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
                     F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces_of(packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
