"""Scores of texts under an interpolated trigram model, held in Elias-Fano tries.

Tokens are the words of a text in lower case (ASCII), then one end.  The probability of w after (u, v) is the
discounted share of w after (u, v), and the mass left over times the probability after v, which in turn falls back
to (count of w + 1) / (all tokens + distinct tokens + 1).  Discounts for counts 1, 2 and more come from the counts of
counts of each order.

The corpus is dealt to shards by v, about ``shard_tokens`` tokens each; a word with more than half of that as v is split
further by u, and stands then for as many contexts (v, class of u); its pairs (v, w) are counted over all shards, and the counts
of counts behind the discounts are sums over all shards, so neither the size of a shard nor their number changes a score.  The
number of shards follows the input.  Each shard
holds its part of the model as a trie: contexts v; under each v its successors w and its contexts u; under each
(v, u) the successors, named by their rank among the successors of v.  The levels and the pointers between them are
Elias-Fano sequences; log probabilities and the masses left over are 16-bit steps.  The levels lie in a file that is mapped
into memory.  A text's trigrams go to the shards, are looked up there by successor search, and the steps of each
document come back.

The most frequent ``COMMON`` words have codes, which all tasks know together with their counts; other words, and pairs of a
split word, are named by hash, and their counts go only to the shards that ask for them.  So what a token costs to move does not
grow with the number of shards.  Which words have codes changes sizes, never results.

Jobs: (1) words that are frequent in a piece of text, of which the driver gets ``COMMON`` at most; (2) counts of all words, and of
the words after split words, sent to the shards that need them; (3) counts of counts of the trigrams that came to each shard;
(4) trigrams to the shards, steps to the documents.  What is shuffled are compressed arrays, a row for each piece of text and
shard.  Counts are exact but for equal 56-bit hashes of different words or pairs.  A pair (u, v) isn't split, so one pair that
makes up most of a corpus is one task.

Edge cases: a NULL or empty text is one end; a NULL id trains and isn't held out; repeated rows count each time; without
training rows every token has the probability 1 (N and V are 0); an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import batches_of, crc32_of, mix, pieces, table, tidy, word_hashes, words, written
from tabloom.llm.elias_fano import EliasFano

MASK = np.uint64((1 << 56) - 1)
BEGIN, END = np.uint64(0x297A4D3F84D5B5), np.uint64(0xE31DA4C2B2AE35)
STEP = 1 / 2048  # of a stored log10
PIECE = 32 << 20
COMMON = 1 << 16
LEAST_SHARE = 1 << 20  # a word with a code makes up one in so many tokens
BLOCK = 1 << 12  # codes whose counts are summed together
_CODEC = "zstd"


def packed(head: list[int], *arrays: np.ndarray) -> bytes:
    """The numbers of the head, then the arrays, each as planes of bytes, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return np.array([len(raw), *head], np.int64).tobytes() + pa.compress(raw, _CODEC, asbytes=True)


def unpacked(data: bytes, head: int, *kinds: tuple) -> list[np.ndarray]:
    """Arrays of the (type, length) pairs, after a head of so many numbers."""
    raw = pa.decompress(data[8 * (head + 1):], heads(data, 1, 0)[0], _CODEC, asbytes=True)
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def heads(data: bytes, n: int, at: int = 8) -> list[int]:
    return np.frombuffer(data, np.int64, n, at).tolist()


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32)


def steps_of(a: np.ndarray) -> np.ndarray:
    """Differences, wrapping around; the running sum in the same type gives them back."""
    return np.diff(a, prepend=a.dtype.type(0))


def order_of(key: np.ndarray) -> np.ndarray:
    """The places of the keys (not negative) in order, equal ones as they come."""
    bits = max(1, len(key).bit_length())
    if int(key.max(initial=0)).bit_length() + bits > 62:
        return np.argsort(key, kind="stable")
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def begins(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in values in order."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def pair_hashes(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Names of the pairs (split word, w)."""
    return mix(hashes ^ mix(number.astype(np.uint64) + np.uint64(1))) & MASK


class Deal:
    """Which shard a context goes to, and the codes of common words, by falling frequency.  Words that are split are common ones and
    have a number; their contexts are classes of u (for BEGIN, of the row)."""

    def __init__(self, shards: int, common: np.ndarray, split: dict[int, int]):
        self.shards, self.common = shards, common
        self.by_hash = np.argsort(common)
        order = sorted(split)
        self.hot, self.ways = np.array(order, np.uint64), np.array([split[h] for h in order], np.uint64)
        self.number = np.full(len(common) + 1, -1, np.int32)  # the last is that of any other word
        self.number[self.codes(self.hot)] = np.arange(len(self.hot))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of the words, -1 for words that have none."""
        if not len(self.common):
            return np.full(len(hashes), -1, np.int64)
        code = self.by_hash[np.minimum(np.searchsorted(self.common, hashes, sorter=self.by_hash), len(self.common) - 1)]
        return np.where(self.common[code] == hashes, code, -1)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % np.uint64(self.shards)).astype(np.int32)

    def kind(self, hashes: np.ndarray, at: np.ndarray, number: np.ndarray, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The class of the split contexts."""
        of = np.where(self.hot[number] == BEGIN, row[at].astype(np.uint64), hashes[u[at]])
        return (mix(of) % self.ways[number]).astype(np.int64)

    def shards_of(self, hashes: np.ndarray, numbers: np.ndarray, v: np.ndarray, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Shards of the contexts; ``numbers`` are those of the words, -1 for words that are whole."""
        out = self.shard(hashes)[v]
        at = np.flatnonzero(numbers[v] >= 0)
        number = numbers[v[at]]
        out[at] = self.shard(self.hot[number] + np.uint64(1) + self.kind(hashes, at, number, u, row).astype(np.uint64))
        return out

    def firsts(self, n_words: int) -> np.ndarray:
        """Number of the first context of each split word, above all words."""
        return n_words + np.cumsum(self.ways.astype(np.int64)) - self.ways.astype(np.int64)

    def contexts(self, hashes: np.ndarray, v: np.ndarray, u: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, int]:
        """(number of the context, how many there may be): v itself, or a number above all words.  Words are codes, or numbers above."""
        out = v.astype(np.int64)
        numbers = self.number[np.minimum(v, len(self.common))]
        at = np.flatnonzero(numbers >= 0)
        number = numbers[at]
        out[at] = self.firsts(len(hashes))[number] + self.kind(hashes, at, number, u, row)
        return out, len(hashes) + int(self.ways.sum())

    def numbers(self, contexts: np.ndarray, n_words: int) -> np.ndarray:
        """The split words of the contexts."""
        return np.searchsorted(self.firsts(n_words), contexts, "right") - 1


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens in order, codes of w, starts of the texts, row of each token)."""
    starts, codes, distinct = words(texts)
    hashes = np.concatenate([np.array([BEGIN, END]), word_hashes(distinct) & MASK])
    hashes, place = np.unique(hashes, return_inverse=True)
    place = place.astype(np.int32)
    w = np.insert(place[2:][codes], starts[1:], place[1])
    starts = starts + np.arange(len(starts))
    return hashes, w, starts, np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))


def before(hashes: np.ndarray, w: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    begin = np.searchsorted(hashes, BEGIN)
    out = np.full_like(w, begin)
    out[steps:] = w[:max(0, len(w) - steps)]
    for s in range(steps):
        at = starts[:-1] + s
        out[at[at < starts[1:]]] = begin
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            yield number, piece
            number += 1


def _learns(piece: pa.RecordBatch) -> np.ndarray:
    return ~piece.column("held").to_numpy(zero_copy_only=False)


def frequent(docs: DataFrame, share: int = 1 << 18) -> DataFrame:
    """(h, n, learnt): tokens in all and in training rows (h NULL), and words that make up 1/share of a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece in _numbered(batches):
            starts, codes, distinct = words(piece.column("text"))
            sizes = np.diff(starts) + 1
            total, learnt = int(sizes.sum()), int(sizes[_learns(piece)].sum())
            counts = np.bincount(codes, minlength=len(distinct))
            often = np.flatnonzero(counts * share >= total)
            names = [BEGIN, END, *(word_hashes(distinct.take(pa.array(often))) & MASK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *map(int, names)], pa.int64()), pa.array([total, *[piece.num_rows] * 2, *counts[often].tolist()]),
                 pa.array([learnt, *[0] * len(names)])], ["h", "n", "learnt"])

    return docs.mapInArrow(tidy(run), "h long, n long, learnt long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt"))


class Tokens:
    """The tokens of a piece: (u, v, w) as places in ``hashes``, its distinct words in order; rows and shards."""

    def __init__(self, deal: Deal, piece: pa.RecordBatch):
        self.hashes, self.w, self.starts, self.row = trigrams(piece.column("text"))
        self.v, self.u = (before(self.hashes, self.w, self.starts, k) for k in (1, 2))
        self.code = deal.codes(self.hashes)
        self.number = deal.number[self.code]
        self.shard = deal.shards_of(self.hashes, self.number, self.v, self.u, self.row)


def word_needs(docs: DataFrame, deal: Deal) -> DataFrame:
    """(bucket, data): words of a piece that have no code, and pairs of split words, with their training counts and the shards that
    predict them; for a bucket below 0, training counts of a block of common words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece in _numbered(batches):
            t = Tokens(deal, piece)
            n, learns = len(t.hashes), _learns(piece)[t.row]
            counts = np.bincount(t.w[learns], minlength=n)
            common, of = np.zeros(len(deal.common), np.uint32), np.flatnonzero(t.code >= 0)
            common[t.code[of]] = counts[of]
            blocks = [common[i:i + BLOCK] for i in range(0, len(common), BLOCK)]
            names, data = [-1 - b for b in range(len(blocks))], [packed([len(x)], x) for x in blocks]
            rare, after = np.flatnonzero(t.code[t.w] < 0), np.flatnonzero(t.number[t.v] >= 0)
            of = np.concatenate([t.w[rare].astype(np.int64), (t.number[t.v[after]] + np.int64(1)) * n + t.w[after]])
            at = np.concatenate([rare, after])
            pair = of * deal.shards + t.shard[at] << 1 | learns[at]
            pair.sort()
            new = begins(pair >> 1)
            to = pair[new] >> 1
            learnt = np.add.reduceat(pair & 1, new) if len(new) else new
            of, to = to // deal.shards, to % deal.shards
            first = begins(of)
            lists = np.diff(np.append(first, len(of)))
            counts = np.add.reduceat(learnt, first) if len(first) else first
            number, word = of[first] // n, of[first] % n
            key = np.where(number > 0, pair_hashes(number, t.hashes[word]), t.hashes[word])
            order = order_of(key.view(np.int64))
            key = key[order]
            bucket = ((key >> np.uint64(24)) * np.uint64(deal.shards) >> np.uint64(32)).astype(np.int64)
            edges = np.append(begins(bucket), len(bucket))
            for a, b in zip(edges[:-1], edges[1:]):
                part = order[a:b]
                sizes = lists[part]
                at = np.repeat(first[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                names.append(int(bucket[a]))
                data.append(packed([len(part), len(at)], steps_of(key[a:b]), counts[part].astype(np.uint32),
                                   number[part].astype(np.uint32), sizes.astype(np.uint32), to[at].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(tidy(run), "bucket int, data binary")


def word_counts(needs: DataFrame) -> DataFrame:
    """(shard, distinct, data, split): for each shard the words and pairs of a bucket that it predicts, with their counts;
    ``distinct`` is the number of training words of the bucket, in its row for shard -1, and ``split`` there holds all tokens and the
    counts of counts after each split word.  Shards below -1 hold the counts of a block of common words."""
    def run(group: pa.Table) -> pa.Table:
        bucket, rows = group.column("bucket")[0].as_py(), group.column("data").to_pylist()
        kind = pa.list_(pa.struct([("number", pa.int32()), ("sums", pa.list_(pa.int64()))]))
        if bucket < 0:
            c = sum(unpacked(data, 1, (np.uint32, heads(data, 1)[0]))[0].astype(np.int64) for data in rows)
            return pa.table({"shard": pa.array([bucket - 1], pa.int32()), "distinct": pa.array([int((c > 0).sum())], pa.int64()),
                             "data": pa.array([c.tobytes()], pa.binary()), "split": pa.array([[]], kind)})
        words_, counts, numbers, sizes, to = [], [], [], [], []
        for data in rows:
            n, m = heads(data, 2)
            h, c, k, s, t = unpacked(data, 2, (np.uint64, n), *[(np.uint32, n)] * 3, (np.uint32, m))
            words_.append(np.cumsum(h, dtype=np.uint64)), counts.append(c), numbers.append(k), sizes.append(s), to.append(t)
        h, of = np.unique(np.concatenate(words_), return_inverse=True)
        c = np.bincount(of, np.concatenate(counts), len(h)).astype(np.int64)
        number = np.zeros(len(h), np.int64)
        number[of] = np.concatenate(numbers)
        pair = np.concatenate(to).astype(np.int64) * len(h) + np.repeat(of, np.concatenate(sizes))
        pair.sort()
        pair = pair[begins(pair)]
        shard, word = pair // len(h), pair % len(h)
        edges = begins(shard)
        names, edges = shard[edges], np.append(edges, len(shard))
        data = [packed([len(p)], steps_of(h[p]), c[p])
                for p in (word[a:b] for a, b in zip(edges[:-1], edges[1:]))]
        sums = np.bincount(number * 6 + np.minimum(c, 5), minlength=6 * (int(number.max()) + 1)).reshape(-1, 6)
        totals = np.bincount(number, c)
        split = [{"number": int(i) - 1, "sums": [int(totals[i]), *sums[i].tolist()]} for i in np.unique(number[number > 0])]
        return pa.table({"shard": pa.array([-1, *names.tolist()], pa.int32()),
                         "distinct": pa.array([int(((c > 0) & (number == 0)).sum()), *[0] * len(names)], pa.int64()),
                         "data": pa.array([b"", *data], pa.binary()), "split": pa.array([split, *[[]] * len(names)], kind)})

    return needs.groupBy("bucket").applyInArrow(
        tidy(run), "shard int, distinct long, data binary, split array<struct<number: int, sums: array<long>>>")


_HEAD = pa.list_(pa.struct([("id", pa.string()), ("held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64())]))
_HEAD_SQL = "array<struct<id: string, held: boolean, n: long, known: long, base: double>>"


def to_shards(docs: DataFrame, deal: Deal, common: np.ndarray, floor: float) -> DataFrame:
    """(shard, piece, data, head): the trigrams of a piece for each shard; one of the rows also has the piece's rows, with what their
    common words, of so many in the training rows, add to the base score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p1 = np.log10(np.append(common, 0) + 1.0) - floor
        for number, piece in _numbered(batches):
            t = Tokens(deal, piece)
            held = ~_learns(piece)
            n = len(deal.common)
            code = np.where(t.code >= 0, t.code, n + np.arange(len(t.hashes)))  # in order of hash above the common ones
            order = order_of(t.shard * np.int64(n + len(t.hashes)) + code[t.v])
            edges = np.searchsorted(t.shard[order], np.arange(deal.shards + 1))
            names, data = [], []
            place = np.arange(n + len(t.hashes))
            for s in np.flatnonzero(np.diff(edges)):
                part = order[edges[s]:edges[s + 1]]
                own = code[np.concatenate([t.u[part], t.v[part], t.w[part]])]
                rare = own[own >= n]
                rare.sort()
                rare = rare[begins(rare)]
                place[rare] = n + np.arange(len(rare))
                kind = np.uint16 if n + len(rare) < 1 << 16 else np.uint32
                u, v, w = place[own].astype(kind).reshape(3, -1)
                rows = small(t.row[part] * 2 + held[t.row[part]])
                head = [len(part), len(rare), u.itemsize, rows.itemsize]
                names.append(int(s))
                data.append(packed(head, steps_of(t.hashes[rare - n]), u, steps_of(v), w, steps_of(rows)))
            known = np.append(common > 0, False)[t.code] & (t.code >= 0)
            base = np.where(t.code >= 0, log_p1[t.code], 0.0)
            columns = [piece.column("doc_id").cast(pa.string()).to_pylist(), held.tolist(), np.diff(t.starts).tolist(),
                       *(np.bincount(t.row, x[t.w], piece.num_rows).astype(kind).tolist() for x, kind in ((known, int), (base, float)))]
            first = [[dict(zip(("id", "held", "n", "known", "base"), x)) for x in zip(*columns)]] + [None] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([number] * len(names), pa.int64()), pa.array(data, pa.binary()),
                 pa.array(first[:len(names)], _HEAD)], ["shard", "piece", "data", "head"])

    return docs.mapInArrow(tidy(run), f"shard int, piece long, data binary, head {_HEAD_SQL}")


def spectrum(counts: np.ndarray) -> np.ndarray:
    """How many counts are 0, 1, 2, 3, 4, and more."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the counts of counts."""
    n = np.asarray(n, float)
    y = n[1] / max(n[1] + 2 * n[2], 1)
    d = [0.0]
    for k, (least, most) in enumerate(((0.3, 0.98), (0.5, 1.95), (0.7, 2.9)), 1):
        d.append(min(most, max(least, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else least)))
    return np.array(d)


def steps(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-31)) / STEP), 0, 65535).astype(np.uint16)


def distinct_pairs(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct a * width + b in order, and the place of each pair among them."""
    return np.unique(a * width + b, return_inverse=True)


class Split:
    """Pairs (v, w) of the split words v that have contexts in a shard, counted over all shards.  By pair that is met here: context,
    word and count; by context in order: all tokens, and the successors with counts 0, 1, 2 and more."""

    def __init__(self, deal: Deal, held: "Dealt", counted: "Counted", sums: np.ndarray):
        n = len(held.names)
        split = held.context >= n
        pair = held.context[split] * n + held.w3[split]
        pair.sort()
        pair = pair[begins(pair)]
        context, word = pair // n, pair % n
        self.contexts = context[begins(context)]
        number = deal.numbers(self.contexts, n)
        self.begin, self.begin_word = self.contexts[deal.hot[number] == BEGIN], held.begin_word
        self.total = sums[number, 0]
        self.classes = np.concatenate([sums[number, 1:4], sums[number, 4:].sum(1, keepdims=True)], 1).astype(float)
        count = counted.of(pair_hashes(deal.numbers(context, n) + 1, held.names[word]))
        known = count > 0
        self.context, self.word, self.count = context[known], word[known], count[known]


class Counted:
    """Counts by hash."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        h, c = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *parts))
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.c[at], 0)


class Trie:
    """The model of the contexts of a shard, from its distinct trigrams in order of (v, u, w) and their counts; tokens and
    contexts are numbers of the shard."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, times: np.ndarray, n_contexts: int, n_words: int,
                 p1: np.ndarray, d2: np.ndarray, d3: np.ndarray, split: "Split"):
        self.words = n_words
        if len(split.begin):  # of split beginnings all trigrams are known from their pairs
            mine = ~np.isin(v, split.begin)
            of = np.isin(split.context, split.begin)
            v, u, w, times = (np.concatenate([x[mine], y]) for x, y in (
                (v, split.context[of]), (u, np.full(int(of.sum()), split.begin_word)), (w, split.word[of]), (times, split.count[of])))
            order = np.lexsort((w, u, v))
            v, u, w, times = v[order], u[order], w[order], times[order]
        known = split.context * n_words + split.word
        pair = np.union1d(v * n_words + w, known)
        at = np.searchsorted(pair, v * n_words + w)
        counts = np.bincount(at, times, len(pair)).astype(np.int64)
        counts[np.searchsorted(pair, known)] = split.count
        of = pair // n_words
        total = np.bincount(of, counts, n_contexts)
        total[split.contexts] = split.total
        d = d2[np.minimum(counts, 3)]
        kept = np.bincount(of, d, n_contexts)
        kept[split.contexts] = split.classes @ d2
        left = kept / np.maximum(total, 1)
        p2 = (counts - d) / total[of] + left[of] * p1[pair % n_words] if len(pair) else np.zeros(0)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_contexts))])
        rank = at - pointers[v]  # of w among the successors of v

        outer, node = distinct_pairs(v, u, n_words)
        width = int(np.diff(pointers).max(initial=0)) + 1
        triple = node * width + rank  # in order: the rank grows with w
        of3 = node
        total3 = np.bincount(of3, times, len(outer))
        d = d3[np.minimum(times, 3)]
        kept3 = np.bincount(of3, d, len(outer))
        begins = np.flatnonzero(np.isin(outer // n_words, split.begin))
        place = np.searchsorted(split.contexts, outer[begins] // n_words)
        total3[begins], kept3[begins] = split.total[place], (split.classes @ d3)[place]
        left3 = kept3 / np.maximum(total3, 1)
        lower = p2[pointers[outer[of3] // n_words] + triple % width] if len(triple) else np.zeros(0)
        p3 = (times - d) / total3[of3] + left3[of3] * lower if len(triple) else np.zeros(0)

        self.width, self.known = width, total > 0
        self.next = EliasFano(pair, n_contexts * n_words + 1)          # successors of v
        self.start = EliasFano(pointers, len(pair) + 1)                # where those of v begin
        self.outer = EliasFano(outer, n_contexts * n_words + 1)        # contexts u of v
        self.last = EliasFano(triple, len(outer) * width + 1)          # ranks of the successors of (v, u)
        self.levels = [self.next, self.start, self.outer, self.last]
        self.values = [steps(p2), steps(left), steps(p3), steps(left3)]

    def mapped(self) -> None:
        """Moves all levels to a file that is mapped into memory; the file has no name and goes with the task."""
        arrays = [a for level in self.levels for a in level.arrays()] + self.values
        with tempfile.TemporaryFile() as file:
            places = []
            for a in arrays:
                file.write(b"\0" * (-file.tell() % 64))
                places.append(file.tell())
                file.write(a.tobytes())
            file.write(b"\0" * 64)
            file.flush()
            back = [np.memmap(file, a.dtype, "r", at, a.shape) if a.size else a for a, at in zip(arrays, places)]
        for i, level in enumerate(self.levels):
            level.replace([np.asarray(x) for x in back[3 * i:3 * i + 3]])
        self.values = [np.asarray(x) for x in back[12:]]

    def find(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, alone): minus the log probability in steps; of words that are ``alone``, what is added to that of the word itself."""
        p2, left, p3, left3 = self.values
        out = np.where(self.known[v], left[v], 0).astype(np.int64)
        pair = self.next.find(v * self.words + w)
        seen = pair >= 0
        out[seen] = p2[pair[seen]]
        node = self.outer.find(v * self.words + u)
        inner = np.flatnonzero(node >= 0)
        triple = np.full(len(inner), -1)
        both = seen[inner]
        rank = pair[inner[both]] - self.start.get(v[inner[both]])
        triple[both] = self.last.find(node[inner[both]] * self.width + rank)
        out[inner] += left3[node[inner]]
        out[inner[triple >= 0]] = p3[triple[triple >= 0]]
        return out, ~seen


class Dealt:
    """The trigrams that came to a shard: (context, u, w) in numbers of the shard, codes first, and the pieces and rows they are of."""

    def __init__(self, deal: Deal, dealt: pa.Table, inverse: bool = True):
        parts, dictionaries, rows = [], [], []
        for data in dealt.column("data").to_pylist():
            n, rare, size, row_size = heads(data, 4)
            kinds = {2: np.uint16, 4: np.uint32}
            h, u, v, w, row = unpacked(data, 4, (np.uint64, rare), *[(kinds[size], n)] * 3, (kinds[row_size], n))
            dictionaries.append(np.cumsum(h, dtype=np.uint64))
            parts.append((u, np.cumsum(v, dtype=v.dtype), w))
            rows.append(np.cumsum(row, dtype=row.dtype).astype(np.int64))
        rare = np.unique(np.concatenate(dictionaries))
        n = len(deal.common)
        self.names = np.concatenate([deal.common, rare])
        self.begin_word = int(np.flatnonzero(self.names == BEGIN)[0]) if (self.names == BEGIN).any() else 0
        places = [np.concatenate([np.arange(n, dtype=np.int32), n + np.searchsorted(rare, d).astype(np.int32)]) for d in dictionaries]
        u, v, w = (np.concatenate([c[p[i]] for c, p in zip(places, parts)]) for i in range(3))
        self.sizes = np.array([len(r) for r in rows])
        row = np.concatenate(rows)
        del parts, dictionaries, places, rows
        trains = row & 1 == 0
        row >>= 1
        context, self.n_contexts = deal.contexts(self.names, v, u, row)
        del v
        words_ = len(self.names)
        if self.n_contexts * words_ * words_ >= 1 << 62:  # (context, u) by number
            outer, context = distinct_pairs(context, u, words_)
        else:
            outer, context = None, context * words_ + u
        key = context * words_ + w
        del context, u
        if inverse:  # of each token: word, row, and place of its trigram
            self.w, self.row = w, row
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            self.at = np.empty(len(key), np.int32)
            self.at[order] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            self.times = np.add.reduceat(trains[order].astype(np.int64), first)
        else:
            key = key[trains]
            key.sort()
            first = begins(key)
            self.times = np.diff(np.append(first, len(key)))
        #: By distinct trigram: context, u and w, and how often it was learnt.
        pair, self.w3 = np.divmod(key[first], words_)
        self.context, self.u3 = np.divmod(pair if outer is None else outer[pair], words_)


def shard_spectra(deal: Deal):
    """The grouped function that gives the counts of counts of a shard's pairs and trigrams; pairs of split words, and trigrams of
    split beginnings, are in more shards and left to ``word_counts``."""
    def run(group: pa.Table) -> pa.Table:
        held = Dealt(deal, group, inverse=False)
        n = len(held.names)
        whole = held.context < n
        pair = held.context[whole] * n + held.w3[whole]
        order = order_of(pair)
        first = begins(pair[order])
        pairs = spectrum(np.add.reduceat(held.times[whole][order], first) if len(first) else first)
        split = np.flatnonzero(~whole)
        begin = split[deal.hot[deal.numbers(held.context[split], n)] == BEGIN] if len(split) else split
        triples = spectrum(held.times) - spectrum(held.times[begin])
        return pa.table({f"{k}{i}": [int(x)] for k, all_ in (("p", pairs), ("t", triples)) for i, x in enumerate(all_)})

    return run


SPECTRA = [f"{k}{i}" for k in "pt" for i in range(6)]


def shard_sums(deal: Deal, common: np.ndarray, sums: np.ndarray, floor: float):
    """The grouped function of the shards: builds the trie of a shard and finds all its trigrams.  ``common`` are the counts of the
    common words; ``sums`` has all tokens and the counts of counts after each split word."""
    def run(dealt: pa.Table, counted: pa.Table) -> pa.Table:
        numbers = dealt.column("piece").to_pylist()
        if not numbers:
            return pa.table({"piece": pa.array([], pa.int64()), "data": pa.array([], pa.binary()),
                             "head": pa.array([], dealt.schema.field("head").type)})
        parts, spectra = [], np.zeros(12)
        for data, of in zip(*(counted.column(c).to_pylist() for c in ("data", "spectra"))):
            if of is not None:
                spectra += of
                continue
            n, = heads(data, 1)
            h, c = unpacked(data, 1, (np.uint64, n), (np.int64, n))
            parts.append((np.cumsum(h, dtype=np.uint64), c))
        counts = Counted(parts)
        held = Dealt(deal, dealt)
        context, u3, w3, at, times = held.context, held.u3, held.w3, held.at, held.times
        names, codes = held.names, len(deal.common)
        count = np.concatenate([common, counts.of(names[codes:])])  # right for the words that are predicted here
        log_p1 = np.log10(count + 1.0) - floor
        known = np.flatnonzero(times)
        trie = Trie(context[known], u3[known], w3[known], times[known], held.n_contexts, len(names),
                    10 ** log_p1, discounts(spectra[:6]), discounts(spectra[6:]), Split(deal, held, counts, sums))
        del parts, counts, log_p1
        trie.mapped()
        found, alone = np.empty(len(w3), np.int32), np.empty(len(w3), bool)
        for i in range(0, len(w3), 1 << 18):
            now = slice(i, i + (1 << 18))
            found[now], alone[now] = trie.find(context[now], u3[now], w3[now])
        del trie
        found, alone, rare = found[at], alone[at], held.w >= codes
        out, stop = [], np.cumsum(held.sizes)
        for low, high in zip(stop - held.sizes, stop):
            order = low + order_of(held.row[low:high])
            row = held.row[order]
            first = begins(row)
            told = order[alone[order] | rare[order]]  # words whose own probability counts
            out.append(packed([len(first), len(told)], steps_of(row[first].astype(np.uint32)),
                              np.add.reduceat(found[order], first).astype(np.uint32), steps_of(held.row[told].astype(np.uint32)),
                              count[held.w[told]], (alone[told] * 2 + rare[told]).astype(np.uint8)))
        return pa.table({"piece": pa.array(numbers, pa.int64()), "data": pa.array(out, pa.binary()), "head": dealt.column("head")})

    return run


def scored(docs: DataFrame, held: Column, shard_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    batches_of(docs.sparkSession, 2 * PIECE)  # whole pieces: a row for each piece and shard is shuffled
    often = written(frequent(docs), "frequent-words")
    tokens, learnt = often.filter("h is null").select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0))).first()
    # The share bounds what the driver gets, however many partitions send their most frequent words.
    common = often.filter(F.col("h").isNotNull() & (F.col("n") * LEAST_SHARE >= tokens)).orderBy(F.col("n").desc(), "h").limit(COMMON).collect()
    limit = shard_tokens // 2
    split = {h: -(-n // limit) for h, n, _ in common if n > limit}
    deal = Deal(max(1, -(-tokens // shard_tokens)), np.array([r[0] for r in common], np.uint64), split)
    counts = written(word_counts(word_needs(docs, deal)), "word-counts")
    distinct = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    blocks = counts.filter("shard < -1").orderBy(F.col("shard").desc()).select("data").collect()
    number = np.frombuffer(b"".join(r[0] for r in blocks), np.int64)
    after = (counts.select(F.explode("split").alias("x")).groupBy("x.number")
             .agg(*(F.sum(F.col("x.sums")[i]) for i in range(7))).collect()) if split else []
    sums = np.zeros((len(split), 7), np.int64)
    for at, *of in after:
        sums[at] = of
    floor = float(np.log10(learnt + distinct + 1))
    dealt = to_shards(docs, deal, number, floor)
    spark, nothing = docs.sparkSession, F.lit(None).cast("binary")
    spectra = dealt.groupBy("shard").applyInArrow(tidy(shard_spectra(deal)), ", ".join(f"{c} long" for c in SPECTRA))
    known = np.concatenate([sums[:, 1:].sum(0), sums[deal.hot == BEGIN, 1:].sum(0)]).tolist()  # pairs and beginnings that are split
    spectra = spectra.agg(F.array(*(F.coalesce(F.sum(c), F.lit(0)) + F.lit(int(k)) for c, k in zip(SPECTRA, known))).alias("spectra"))
    sent = counts.filter("shard >= 0").select("shard", "data", F.lit(None).cast("array<long>").alias("spectra"))
    everywhere = spark.range(deal.shards).select(F.col("id").cast("int").alias("shard"))
    sent = sent.unionByName(everywhere.crossJoin(F.broadcast(spectra)).select("shard", nothing.alias("data"), "spectra"))
    found = (dealt.groupBy("shard").cogroup(sent.groupBy("shard"))
             .applyInArrow(tidy(shard_sums(deal, number, sums, floor)), f"piece long, data binary, head {_HEAD_SQL}"))

    def finish(group: pa.Table) -> pa.Table:
        head = next(h for h in group.column("head").to_pylist() if h is not None)
        known, base = np.array([x["known"] for x in head]), np.array([x["base"] for x in head])
        taken, score = np.zeros(len(head), np.int64), np.zeros(len(head))
        for data in sorted(group.column("data").to_pylist()):
            n, m = heads(data, 2)
            at, steps_, row, count, flags = unpacked(data, 2, (np.uint32, n), (np.uint32, n), (np.uint32, m), (np.int64, m), (np.uint8, m))
            taken[np.cumsum(at, dtype=np.uint32)] += steps_
            row = np.cumsum(row, dtype=np.uint32)
            log_p1, rare, alone = np.log10(count + 1.0) - floor, flags & 1 > 0, flags & 2 > 0
            score += np.bincount(row[alone], log_p1[alone], len(head))
            base += np.bincount(row[rare], log_p1[rare], len(head))
            known += np.bincount(row[rare & (count > 0)], minlength=len(head))
        return pa.table({"doc_id": pa.array([x["id"] for x in head], pa.string()), "held_out": [x["held"] for x in head],
                         "n_tokens": pa.array([x["n"] for x in head], pa.int64()), "n_known": known,
                         "base_score": base, "score": score - taken * STEP})

    out = found.groupBy("piece").applyInArrow(
        tidy(finish), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known",
                      F.lit(learnt).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), crc32_of("doc_id") % 7 == 2)
