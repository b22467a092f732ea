r"""Line deduplication by pairs of documents: common blocks of lines, and of words.

Lines that aren't blank are compared by 128 bits of hash, blanks at their ends apart.  Two documents are a pair if they share
something rare: a run of neighbouring shared lines that has just ``least_words`` words, from a line on or back from a
line.  (One long line is such a run; common short lines make no pairs by themselves.)  Of all documents with a run, the one with
the smallest id is the partner of every other, so a run gives one pair for each later document.  The lines of each pair's runs are
aligned by patience diff, and aligned blocks of ``least_words`` words or more, neighbours in both documents, are deleted from the
later one.  Lines that came out of the alignment are aligned again, against all lines of the partner, so that moved and repeated
blocks go too; a run that four alignments have left is aligned with its occurrence in the partner alone.  As every common block is
made of such runs, no block is lost, whatever documents own its lines, and a pair carries no more than the lines that made it.

Shorter lines that are frequent are deleted from all documents but their owner, the document with the smallest id that has
them: the more words a line has, the fewer documents it takes (``frequent``).  Lines of one or two words go in blocks only.  The
first occurrence of a line is never deleted, since the owner of a line has no earlier document to share it with.

Passages that begin or end inside a line are found by words, whatever the line breaks: every run of ``passage`` words that
an earlier document has too is deleted, word for word.  A run has a fingerprint, the least hash of the half as long runs
in it, which is the same for most neighbouring runs; only runs whose fingerprint is in two documents are compared, by 128 bits.
Neighbouring runs of one fingerprint are a stretch.  Stretches are compared run by run in groups of fingerprints.  For fingerprints
of more than ``MOST_STRETCHES`` stretches (a passage that many documents have), equal stretches are compared as one row; the runs of
such a stretch are compared one by one only for the first document that has it, and only if another document is the first to have
another stretch of that fingerprint.

Only hashes and positions of lines and runs are shuffled, and texts only of documents that have shared fingerprints or that lose
lines or words: filters of their ids keep the others where they are.  Lines and runs that hold more than one ten-thousandth of all rows are joined by broadcast (there are
at most ten thousand of them), so their rows never meet in one task.

Edge cases: NULL and empty texts have no lines and stay as they are; rows of one doc_id are one document and don't
deduplicate each other; NULL ids take no part and stay as they are; texts without deletions stay as they are, byte for byte; in
others the lines left are joined by line feeds, and what is left around words taken out of a line by a blank; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import in_arrow, mix, pieces, raw_bytes, span_hashes, table, tidy, word_spans, written

#: Odd bases of the two hashes of a run of words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: A key with more than one in so many rows is hot.
HOT_SHARE = 10_000
#: Bits of a filter of documents for each of them, and at most; bits of a block of it.
BITS_EACH, MOST_BITS, BLOCK_BITS = 16, 1 << 27, 1 << 18
#: Stretches of one fingerprint that are compared in a group at most, and in a group about.
MOST_STRETCHES, GROUP_STRETCHES = 1_000, 4_000


def n_lines_of(text: str) -> Column:
    """How many lines of a text aren't blank: from the first sign of a word to the end of the line is one match."""
    return F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D][^\n]*"))


class Few:
    """A filter of document ids: ``may_hold`` is true for all that are in ``ids`` and for few others, so that the texts of the others
    need not be shuffled.  It takes 16 MB at most; for more than some ten million ids it lets more of the others pass."""

    def __init__(self, ids: DataFrame):
        self.bits = min(MOST_BITS, max(BLOCK_BITS, 1 << (BITS_EACH * ids.count()).bit_length()))

        def block(group: pa.Table) -> pa.Table:
            held = np.zeros(BLOCK_BITS, bool)
            bit = group.column("bit").to_numpy()
            held[bit % BLOCK_BITS] = True
            return pa.table({"block": [int(bit[0] // BLOCK_BITS)], "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

        rows = (ids.select(self._bit("doc_id").alias("bit")).groupBy(F.expr(f"bit div {BLOCK_BITS}")).applyInArrow(
            tidy(block), "block long, held binary").collect())
        blocks = {r[0]: bytes(r[1]) for r in rows}
        empty = bytes(BLOCK_BITS // 8)
        held = b"".join(blocks.get(i, empty) for i in range(self.bits // BLOCK_BITS))
        sent = ids.sparkSession.sparkContext.broadcast(held)

        @F.arrow_udf("boolean")
        def test(bit: pa.Array) -> pa.Array:
            at = bit.to_numpy(zero_copy_only=False)
            found = np.frombuffer(sent.value, np.uint8)[at >> 3]
            return pa.array((found >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

        self._test = test

    def _bit(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), F.col(column)), F.lit(self.bits))

    def may_hold(self, column: str) -> Column:
        return self._test(self._bit(column))


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence."""
    ends, places, before = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(ends, v)
        ends[at:at + 1], places[at:at + 1] = [v], [i]
        before.append(places[at - 1] if at else -1)
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal entries in order, by patience diff."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:  # repeated lines only: the first common one of both is the anchor
            at = next((i for i in range(a0, a1) if a[i] in in_b), None)
            if at is None:
                continue
            anchors = [(at, b.index(a[at], b0, b1))]
        low_a, low_b = a0, b0
        for i, j in anchors:
            found.append((i, j))
            todo.append((low_a, i, low_b, j))
            low_a, low_b = i + 1, j + 1
        todo.append((low_a, a1, low_b, b1))
    return sorted(found)


def deleted_lines(first: list[tuple], later: list[tuple], least_words: int, rounds: int = 4) -> list[int]:
    """Places of the later document's lines in aligned blocks of one pair, by ``rounds`` of patience diff.  Entries are
    (place, line, words) in order of place."""
    gone = []
    for _ in range(rounds):
        aligned = patience([x[1] for x in first], [x[1] for x in later])
        found, block = set(), []
        for i, j in [*aligned, (None, None)]:
            if block and (i is None or first[i][0] != first[block[-1][0]][0] + 1 or later[j][0] != later[block[-1][1]][0] + 1):
                if sum(later[y][2] for _, y in block) >= least_words:
                    found.update(y for _, y in block)
                block = []
            block.append((i, j))
        if not found:
            break
        # Blocks that moved or come again are aligned in the next round, against all lines of the first document.
        gone += [later[j][0] for j in found]
        later = [x for j, x in enumerate(later) if j not in found]
    return gone


def aligned(runs: list[tuple[int, int, np.ndarray]], least_words: int) -> list[int]:
    """Places of the later document's lines that go, of one pair, whose runs are (place, place in the partner, entries of lines:
    two hashes and words)."""
    if len({at - owner_at for at, owner_at, _ in runs}) == 1:  # the same lines in the same order align as they stand
        return sorted({p for at, _, names in runs for p in range(at, at + len(names))})
    first, later, seen = {}, {}, []
    for at, owner_at, names in runs:
        lines = [((h, g), w) for h, g, w in names.tolist()]
        later.update(enumerate(lines, at))
        first.update(enumerate(lines, owner_at))
        seen.append((at, owner_at, lines))
    entries = lambda places: [(p, *x) for p, x in sorted(places)]
    gone = set(deleted_lines(entries(first.items()), entries(later.items()), least_words))
    for at, owner_at, lines in seen:
        if not gone.issuperset(range(at, at + len(lines))):
            gone.update(deleted_lines(entries(enumerate(lines, owner_at)), entries(enumerate(lines, at)), least_words))
    return sorted(gone)


def runs_of(starts: np.ndarray, at: np.ndarray, words_: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of the least runs of neighbouring lines that have ``least_words`` words, from each line on and back from
    each line: a common block of so many words is made of such runs.  The lines of document i are ``starts[i]`` to
    ``starts[i + 1]``, in order of their places ``at``."""
    n = len(at)
    new = np.ones(n, bool)
    new[1:] = np.diff(at) != 1
    new[starts[:-1][np.diff(starts) > 0]] = True
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, n))
    low, high = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
    before = np.concatenate([[0], np.cumsum(words_)])
    place = np.arange(n)
    after = np.searchsorted(before, before[:-1] + least_words)
    first = np.searchsorted(before, before[1:] - least_words, "right") - 1
    on, back = after <= high, first >= low
    found = np.unique(np.stack([np.append(place[on], first[back]), np.append(after[on], place[back] + 1)], 1), axis=0)
    return found[:, 0], found[:, 1]


def frequent(words: Column, documents: Column) -> Column:
    """Whether a line goes by itself: of three words or more, in more documents the shorter it is (34 for three words, 20 for
    five, 12 for nine)."""
    return (words >= 3) & (words * documents >= 100)


def met(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """``rows`` joined by (h, g) to ``keys``, one row for each, whose ``n_rows`` says how many of all ``total`` rows have it."""
    hot = F.broadcast(keys.filter(F.col("n_rows") > total / HOT_SHARE).drop("n_rows"))
    cold = keys.filter(F.col("n_rows") <= total / HOT_SHARE).drop("n_rows")
    return (rows.join(hot, ["h", "g"])
            .unionByName(rows.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(cold, ["h", "g"])))


def lines_of(raw: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ends, low, high, words): the bytes of the lines that aren't blank and how many words they have; those of text i are
    ``ends[i]`` to ``ends[i + 1]``.  ``begin`` says where words begin."""
    cuts = np.flatnonzero(raw == 10)
    of = np.searchsorted(cuts, offsets)  # line feeds before each text
    # A line begins with its text or after a line feed, and ends before the next line feed or with its text.
    low = np.insert(cuts + 1, of[:-1], offsets[:-1])
    high = np.insert(cuts, of[1:], offsets[1:])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(of) + 1)
    counts = np.searchsorted(begin, high) - np.searchsorted(begin, low)
    full = np.flatnonzero(counts)
    return np.searchsorted(owner[full], np.arange(len(offsets))), low[full], high[full], counts[full]


def line_digests(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """128 bits of hash of each line, without the blanks at its ends."""
    data, digest = raw.tobytes(), xxhash.xxh3_128_digest
    return [digest(data[a:b].strip(b" ")) for a, b in zip(low.tolist(), high.tolist())]


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(ends, digests, words): of the lines that aren't blank, 128 bits of hash and how many words; those of text i are
    ``digests[ends[i]:ends[i + 1]]``."""
    raw, offsets = raw_bytes(texts)
    ends, low, high, counts = lines_of(raw, offsets, word_spans(raw, offsets)[0])
    return ends, line_digests(raw, low, high), counts


def scanned(docs: DataFrame, passage: int) -> DataFrame:
    """doc_id, version, the lines of each text that aren't blank as lists h, g (hashes) and w (words), and ``prints``, its distinct
    fingerprints of runs of ``passage`` words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                raw, offsets = raw_bytes(piece.column("text"))
                begin, end, starts = word_spans(raw, offsets)
                ends, low, high, sizes = lines_of(raw, offsets, begin)
                hashes = np.frombuffer(b"".join(line_digests(raw, low, high)), ">i8").astype(np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                         for x in (hashes[:, 0], hashes[:, 1], sizes.astype(np.int32))]
                counts, prints = fingerprints(starts, span_hashes(raw, begin, end), passage)
                # One for each stretch of neighbours; a print that comes back later in a text stands twice.
                own = prints[within(starts, counts)]
                new = changes(own, counts)
                ends = np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], np.cumsum(counts)])]
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[new])))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("version"), *lists],
                                                 ["doc_id", "version", "h", "g", "w", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(in_arrow(docs, scan, f"doc_id {kind}, version long, h array<long>, g array<long>, w array<int>, "
                                        "prints array<long>"), "scan")


def deletions(scan: DataFrame, least_words: int) -> DataFrame:
    """doc_id, version and ``gone``, the sorted places of its deleted lines, of scanned documents that lose any."""
    lines = scan.select("doc_id", "version", F.posexplode(F.arrays_zip("h", "g", "w")).alias("at", "x")).select(
        "doc_id", "version", "at", "x.h", "x.g", "x.w")
    shared = written(lines.groupBy("h", "g")
                     .agg(F.min("doc_id").alias("owner"), F.count_distinct("doc_id").alias("n"), F.count(F.lit(1)).alias("n_rows"))
                     .filter("n > 1"), "shared")
    total = scan.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    marked = written(met(lines, shared, total), "shared-lines")
    sequences = marked.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("at", "h", "g", "w"))).alias("seq"))
    kind = scan.schema["doc_id"].dataType.simpleString()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = batch.column("seq")
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(seq).to_numpy(zero_copy_only=False))]).astype(np.int64)
            lines = seq.flatten()
            at, *entries = (pc.struct_field(lines, x).to_numpy(zero_copy_only=False) for x in ("at", "h", "g", "w"))
            first, after = runs_of(starts, at, entries[2], least_words)
            data = np.stack(entries, 1).astype(np.int64).tobytes()  # 24 bytes a line
            names = [data[24 * a:24 * b] for a, b in zip(first.tolist(), after.tolist())]
            rows = pa.array(np.searchsorted(starts, first, "right") - 1, pa.int32())
            h, g = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), ">i8").astype(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(at[first], pa.int32()),
                 pa.array(h), pa.array(g), pa.array(names, pa.binary())],
                ["doc_id", "version", "at", "h", "g", "names"])

    found = written(in_arrow(sequences, rare, f"doc_id {kind}, version long, at int, h long, g long, names binary"), "runs-of-lines")
    first = (found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.max("doc_id").alias("last"),
                                         F.count(F.lit(1)).alias("n_rows"))
             .filter("first.doc_id <> last")
             .select("h", "g", "n_rows", F.col("first.doc_id").alias("owner"), F.col("first.version").alias("owner_version"),
                     F.col("first.at").alias("owner_at")))
    pairs = (met(found, written(first, "partners"), found.count()).filter("doc_id <> owner")
             .groupBy("doc_id", "version", "owner", "owner_version")
             .agg(F.collect_list(F.struct("at", "owner_at", "names")).alias("runs")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            stops = np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False)).tolist()
            at, owner_at, names = (pc.struct_field(runs.flatten(), x).to_pylist() for x in ("at", "owner_at", "names"))
            every = list(zip(at, owner_at, (np.frombuffer(x, np.int64).reshape(-1, 3) for x in names)))
            gone = [aligned(every[a:b], least_words) for a, b in zip([0, *stops], stops)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(gone, pa.list_(pa.int32()))],
                                             ["doc_id", "version", "gone"])

    later = in_arrow(pairs, align, f"doc_id {kind}, version long, gone array<int>")
    alone = (marked.filter((F.col("doc_id") != F.col("owner")) & frequent(F.col("w"), F.col("n")))
             .groupBy("doc_id", "version").agg(F.collect_list("at").alias("gone")))
    return (later.unionByName(alone).groupBy("doc_id", "version")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))


def grams(h: np.ndarray, base: int, n: int) -> np.ndarray:
    """Hashes of the runs of n words, at each word that begins one; by doubling."""
    def longer(a: np.ndarray, m: int, b: np.ndarray, k: int) -> np.ndarray:
        size = max(0, len(h) - m - k + 1)
        return a[:size] * np.uint64(pow(base, k, 1 << 64)) + b[m:m + size]

    out, m, power, k = h, 0, h, 1
    while n:
        if n & 1:
            out, m = (longer(out, m, power, k), m + k) if m else (power, k)
        n >>= 1
        power, k = longer(power, k, power, k), 2 * k
    return out


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    k = 1
    while 2 * k <= n:
        h, k = np.minimum(h[:max(0, len(h) - k)], h[k:]), 2 * k
    return np.minimum(h[:max(0, len(h) - n + k)], h[n - k:])


def fingerprints(starts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, prints): ``prints[i]`` names the run of n words at i by the least hash of the runs of n / 2 words in it, so equal
    runs have equal prints and neighbouring runs mostly the same; those of text i that lie within it are at
    ``first[i]`` and on."""
    prints = least(mix(grams(hashes, BASES[0], n // 2)), n - n // 2 + 1).view(np.int64)
    return np.minimum(np.maximum(np.diff(starts) - n + 1, 0), len(prints)), prints


def within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + counts[i]`` of all texts, one after the other."""
    return np.repeat(starts[:-1] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def changes(prints: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before it in its text; text i has the next ``counts[i]``."""
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    return new


def stretches(wanted: np.ndarray, prints: np.ndarray, longest: int = 64, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of the neighbouring wanted runs of one fingerprint, in parts of at most ``longest``.  ``new`` says where
    fingerprints change, if it is known."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at
    if new is None:
        new = changes(prints, np.array([len(prints)]))
    new = new[at]
    new[0] = True
    new[1:] |= np.diff(at) > 1
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % longest == 0)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] + 1


def passages(docs: DataFrame, scan: DataFrame, gone: DataFrame, passage: int) -> DataFrame:
    """doc_id, version and ``runs``: (at, n) where n runs of ``passage`` words begin, at word ``at`` and on, that an earlier
    document has too.

    Exact: a run is compared by 128 bits of hash once its fingerprint is known to be in two documents.  Equal runs have one
    fingerprint, so all of them meet in its group, or among the rows of fingerprints of many stretches."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = scan.select("doc_id", "version", F.explode("prints").alias("print")).repartition("print")
    shared = (prints.groupBy("print").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
              .filter("owner <> last").select("print"))
    hits = written(prints.join(shared.hint("shuffle_hash"), "print").groupBy("doc_id", "version").agg(F.collect_set("print").alias("prints")), "hits")
    asked = docs.filter(Few(hits).may_hold("doc_id")).join(hits.hint("shuffle_hash"), ["doc_id", "version"]).join(
        gone.hint("shuffle_hash"), ["doc_id", "version"], "left").select(
        "doc_id", "version", "text", "prints", "gone")

    longest = min(64, passage)  # the first and the last run of a stretch have all its words

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                raw, offsets = raw_bytes(piece.column("text"))
                begin, end, starts = word_spans(raw, offsets)
                hashes = span_hashes(raw, begin, end)
                counts, prints = fingerprints(starts, hashes, passage)
                place = within(starts, counts)
                own = prints[place]
                new = changes(own, counts)
                # Prints that another text of the piece asks for are in two documents, so this one asks for them too.
                sought = np.unique(piece.column("prints").flatten().to_numpy(zero_copy_only=False))
                wanted = np.isin(own[new], sought)[np.cumsum(new) - 1] if len(own) else np.zeros(0, bool)
                # Runs of deleted lines alone are settled.
                lost = np.concatenate([[0], np.cumsum(words_gone(lines_of(raw, offsets, begin), piece.column("gone")))])
                wanted &= lost[place + passage] - lost[place] < passage
                first, after = stretches(wanted, own, longest, new)
                row = np.searchsorted(np.cumsum(counts), first, "right")
                rows = pa.array(row, pa.int32())
                keys = [grams(hashes, base, passage).view(np.int64) for base in BASES]
                sizes = after - first
                names = [(mix(k[place[first]].view(np.uint64) ^ mix(k[place[after - 1]].view(np.uint64) + sizes.astype(np.uint64)))
                          .view(np.int64)) for k in keys]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                held = place[wanted]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(rows), piece.column("version").take(rows), pa.array(place[first] - starts[row], pa.int32()),
                     *(pa.array(x) for x in (*names, own[first])), *(pa.ListArray.from_arrays(ends, pa.array(k[held])) for k in keys)],
                    ["doc_id", "version", "at", "h", "g", "print", "hs", "gs"])

    found = written(in_arrow(asked, candidates, f"doc_id {kind}, version long, at int, h long, g long, print long, "
                                                "hs array<long>, gs array<long>"), "stretches")
    many = written(found.groupBy("print").count().filter(F.col("count") > MOST_STRETCHES).select("print"), "prints-of-many")
    if many.isEmpty():
        lost = in_groups(found)
    else:
        lost = in_groups(found.join(many, "print", "left_anti")).unionByName(by_rows(found.join(many, "print", "left_semi")))
    return lost.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def in_groups(found: DataFrame) -> DataFrame:
    """doc_id, version, at, n: neighbouring runs of the stretches that an earlier document has too, compared in groups of
    fingerprints, each of few stretches."""
    def compared(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        coded = rows.column("doc_id").combine_chunks().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        hs, gs = (rows.column(c).combine_chunks() for c in ("hs", "gs"))
        sizes = pc.list_value_length(hs).to_numpy(zero_copy_only=False)
        hs, gs = (x.flatten().to_numpy(zero_copy_only=False) for x in (hs, gs))
        row = np.repeat(np.arange(len(sizes)), sizes)
        documents = rank[coded.indices.to_numpy(zero_copy_only=False)][row]
        order = np.lexsort((gs, hs))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hs[order]) != 0) | (np.diff(gs[order]) != 0)
        owners = np.minimum.reduceat(documents[order], np.flatnonzero(new)) if len(order) else documents
        lost = np.zeros(len(order), bool)
        lost[order] = documents[order] != owners[np.cumsum(new) - 1]
        at = np.flatnonzero(lost)
        begins = np.ones(len(at), bool)
        begins[1:] = (np.diff(at) > 1) | (np.diff(row[at]) != 0)
        first = at[begins]
        n = np.diff(np.append(np.flatnonzero(begins), len(at)))
        of = row[first]
        place = rows.column("at").to_numpy()[of] + first - (np.cumsum(sizes) - sizes)[of]
        return pa.table({"doc_id": rows.column("doc_id").take(pa.array(of)), "version": rows.column("version").take(pa.array(of)),
                         "at": pa.array(place, pa.int32()), "n": pa.array(n, pa.int32())})

    groups = found.count() // GROUP_STRETCHES + 1
    kind = found.schema["doc_id"].dataType.simpleString()
    return (found.select("doc_id", "version", "at", "hs", "gs", F.pmod(F.xxhash64("print"), F.lit(groups)).alias("part"))
            .groupBy("part").applyInArrow(tidy(compared), f"doc_id {kind}, version long, at int, n int"))


def by_rows(found: DataFrame) -> DataFrame:
    """As ``in_groups`` for fingerprints of many stretches: equal stretches and then runs are compared as rows.  The first document
    that has a stretch has all its runs, so other documents lose them at once, and only its own runs are compared with other
    stretches, where those of one fingerprint have different first documents."""
    first = written(found.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"),
                                                F.min("print").alias("print"), F.count(F.lit(1)).alias("n_rows")), "first-stretches")
    total = first.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    settled = (met(found.select("doc_id", "version", "at", F.size("hs").alias("n"), "h", "g"),
                   first.filter("owner <> last").select("h", "g", "owner", "n_rows"), total)
               .filter("doc_id <> owner").select("doc_id", "version", "at", "n"))
    several = (first.groupBy("print").agg(F.min("owner").alias("one"), F.max("owner").alias("other")).filter("one <> other")
               .select("print"))
    compared = written(first.join(several, "print", "left_semi").select("h", "g", "owner", "n_rows"), "compared")
    runs = written(met(found.drop("print"), compared, total).filter("doc_id = owner")
                   .select("doc_id", "version", "at", F.posexplode(F.arrays_zip("hs", "gs")).alias("i", "x"))
                   .select("doc_id", "version", (F.col("at") + F.col("i")).alias("at"), F.col("x.hs").alias("h"), F.col("x.gs").alias("g")),
                   "runs-of-words")
    again = (runs.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_rows"))
             .filter("owner <> last").drop("last"))
    later = (met(runs, written(again, "first-runs"), runs.count()).filter("doc_id <> owner")
             .select("doc_id", "version", "at", F.lit(1).alias("n")))
    return settled.unionByName(later)


def words_gone(lines: tuple[np.ndarray, ...], gone: pa.Array) -> np.ndarray:
    """For each word of the texts whether it stands in a deleted line; ``gone`` has the places of a text's deleted lines or NULL."""
    ends, _, _, counts = lines
    sizes = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
    lost = np.zeros(len(counts), bool)
    lost[np.repeat(ends[:-1], sizes) + gone.flatten().to_numpy(zero_copy_only=False)] = True
    return np.repeat(lost, counts)


def without(texts: pa.Array, edits: pa.Array, passage: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, lines, dropped): the texts without the deleted lines and the words of the deleted runs, how many lines that aren't
    blank there were, and how many of them are left out as a whole.  A text whose ``edits`` are NULL stays."""
    raw, offsets = raw_bytes(texts)
    begin, end, starts = word_spans(raw, offsets)
    lines = ends, low, high, counts = lines_of(raw, offsets, begin)
    edited = edits.is_valid().to_numpy(zero_copy_only=False)
    field = lambda name: pc.struct_field(edits, name)
    lost = words_gone(lines, field("gone"))
    runs = field("runs")
    of = np.repeat(starts[:-1], pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
    runs = runs.flatten()
    at, n = (pc.struct_field(runs, x).to_numpy(zero_copy_only=False) for x in ("at", "n"))
    depth = np.zeros(len(begin) + 1, np.int64)
    np.add.at(depth, of + at, 1)
    np.add.at(depth, of + at + n + passage - 1, -1)
    lost |= np.cumsum(depth[:-1]) > 0
    first = np.cumsum(counts) - counts  # word of each line
    gaps = np.concatenate([[0], np.cumsum(lost)])
    gaps = gaps[first + counts] - gaps[first]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    whole = edited[owner] & (gaps == 0)
    part = edited[owner] & (gaps > 0) & (gaps < counts)
    # Words left of lines that lose some: from one that follows a gap or begins its line to one before a gap or at the end.
    left = ~lost & np.repeat(part, counts)
    heads, tails = left.copy(), left.copy()
    heads[1:] &= ~left[:-1]
    tails[:-1] &= ~left[1:]
    edge = first[part]
    heads[edge] = left[edge]
    edge = (first + counts - 1)[part]
    tails[edge] = left[edge]
    line = np.repeat(np.arange(len(counts)), counts)[heads]
    # What is left, as spans of bytes with their line; of a text that stays, all.
    stays = np.flatnonzero(~edited)
    lows = np.concatenate([low[whole], begin[heads], offsets[:-1][stays]])
    highs = np.concatenate([high[whole], end[tails], offsets[1:][stays]])
    in_text = np.concatenate([owner[whole], owner[line], stays])
    in_line = np.concatenate([np.flatnonzero(whole), line, np.full(len(stays), -1)])
    order = np.lexsort((lows, in_text))
    lows, highs, in_text, in_line = lows[order], highs[order], in_text[order], in_line[order]
    same = np.zeros(len(order), np.int64)  # 0: begins a text, 1: a line, 2: goes on
    same[1:] = (in_text[1:] == in_text[:-1]) * (1 + (in_line[1:] == in_line[:-1]))
    data, signs = raw.tobytes(), (b"", b"\n", b" ")
    out = b"".join(chain.from_iterable((signs[k], data[a:b]) for k, a, b in zip(same.tolist(), lows.tolist(), highs.tolist())))
    sizes = np.bincount(in_text, weights=highs - lows + (same > 0), minlength=len(texts)).astype(np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    new = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(kind)),
                                                         pa.py_buffer(out)])
    dropped = np.bincount(owner[edited[owner] & (gaps == counts)], minlength=len(texts))
    return new, np.diff(ends), dropped


def deduplicated(docs: DataFrame, least_words: int = 10, passage: int = 50) -> DataFrame:
    """``docs`` (doc_id, text and any others) with text without the deleted lines and passages, n_lines before and
    n_deleted, the lines of which nothing is left."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    scan = scanned(keyed, passage)
    gone = written(deletions(scan, least_words), "gone-lines")
    runs = passages(keyed, scan, gone, passage)
    edits = written(gone.join(runs, ["doc_id", "version"], "full").select(
        "doc_id", "version", F.struct(F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
                                      F.coalesce("runs", F.array().cast("array<struct<at:int,n:int>>")).alias("runs")).alias("_edits")),
        "edits")
    docs = docs.select(*own)
    may_change = F.coalesce(Few(edits).may_hold("doc_id") & F.col("text").isNotNull(), F.lit(False))
    edits = edits.withColumnsRenamed({"doc_id": "_id", "version": "_version"}).hint("shuffle_hash")
    joined = docs.filter(may_change).join(
        edits, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left").drop("_id", "_version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text, lines, dropped = without(piece.column("text"), piece.column("_edits"), passage)
                columns = {c: piece.column(c) for c in own} | {"text": text} | {
                    c: pa.array(x, pa.int32()) for c, x in (("n_lines", lines), ("n_deleted", dropped))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.withColumns({"n_lines": F.lit(0), "n_deleted": F.lit(0)}).schema
    same = docs.filter(~may_change).select(*own, F.coalesce(n_lines_of("text"), F.lit(0)).alias("n_lines"), F.lit(0).alias("n_deleted"))
    return in_arrow(joined, run, schema).unionByName(same)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
