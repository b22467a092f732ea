"""MinHash near-deduplication: universal hash minima, banding, verification, star components.

1. Every text becomes its set of word shingles, the minima of ``bands * rows`` multiply-add hashes over the set, and
   one number for each band of minima.  Texts with equal sets are one node (the smallest doc_id), so copies
   never meet in a bucket.
2. Nodes that share a band's number share a bucket.  Buckets never emit all their pairs.  First every member is tested
   against the bucket's smallest node.  In buckets whose other members still lie in several components, the pairs
   between components are tested in blocks of bounded size, each pair in the first band that it shares, and only
   links come out.  So no candidate is lost and pairs inside a component cost nothing.
3. A test compares the minima first (five standard deviations of tolerance), then the full sets, exactly.
4. Components by alternating large-star and small-star until the edges stay the same.

With 26 bands of 5 rows a pair at similarity 0.85 misses all bands with probability 3e-7, at 0.8 with 3e-5.
Tables between the steps are written to the shared folder.  Only counts come to the driver.

Edge cases: texts without words (NULL, empty) have an empty set and are linked with nothing; texts with fewer words than
a shingle are one shingle; a NULL doc_id takes no part (component NULL, kept); rows of one doc_id are one
document; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import in_arrow, mix, pieces, table, word_hashes, words, written

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SHORT = np.uint64(0x1D8E4E27C47D124F)
BLOCK = 1024  # members of a bucket that are compared in one task


@dataclass(frozen=True)
class Rule:
    words: int = 5            # in a shingle, at most 8
    percent: int = 80         # smallest similarity
    bands: int = 26
    rows: int = 5
    seed: int = 11

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
                rng.integers(0, 1 << 32, n, dtype=np.uint32))

    def numbers(self, minima: np.ndarray) -> np.ndarray:
        """The bands' numbers of rows of minima."""
        m = minima.astype(np.uint64).reshape(-1, self.bands, self.rows)
        return mix((m * ODD[:self.rows]).sum(2) + np.arange(self.bands, dtype=np.uint64) * SHORT)

    def least_equal(self) -> float:
        """Share of equal minima below which a pair is not tested further."""
        p = self.percent / 100
        return p - 5 * (p * (1 - p) / (self.bands * self.rows)) ** 0.5


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    starts, codes, distinct = words(texts)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = sum((h[j:len(h) - k + 1 + j] * ODD[j] for j in range(k)), np.zeros(max(0, len(h) - k + 1), np.uint64))
    whole, sets = mix(whole), []
    for low, high in zip(starts[:-1], starts[1:]):
        if high - low >= k:
            sets.append(np.unique(whole[low:high - k + 1]))
        elif high > low:
            sets.append(mix((h[low:high] * ODD[:high - low]).sum(keepdims=True) + SHORT * np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash over a set, which isn't empty."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (a[:, None] * low[None, i:i + 4096] + b[:, None]).min(1), out=out)
    return out


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (NULL if empty), band numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = rule.hashes()
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"), rule.words)
                prints, bands = [], []
                for s in sets:
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        bands.append(rule.numbers(minima(s, a, b))[0])
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                lists = np.concatenate([[0], np.cumsum((sizes > 0) * rule.bands)]).astype(np.int32)
                flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes), pa.array(prints, pa.binary()),
                     pa.ListArray.from_arrays(lists, pa.array(flat))], ["doc_id", "n_shingles", "print", "bands"])

    return in_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {_kind(docs)}, n_shingles long, print binary, bands array<long>")


def full_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """node, n, minima and set, both as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = rule.hashes()
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"), rule.words)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([minima(s, a, b).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "minima", "members"])

    return in_arrow(docs.select("doc_id", "text"), run, f"node {_kind(docs)}, n long, minima binary, members binary")


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    kind = sets.schema["node"].dataType.simpleString()
    side = lambda column, *more: sets.select(F.col("node").alias(column), *[F.col(c).alias(c + column) for c in more])
    likely = pairs.join(side("a", "n", "minima"), "a").join(side("b", "n", "minima"), "b").filter(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * rule.percent)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = rule.least_equal() * rule.bands * rule.rows
        for batch in batches:
            good = [bool((np.frombuffer(x.as_buffer(), np.uint32) == np.frombuffer(y.as_buffer(), np.uint32)).sum() >= least)
                    for x, y in zip(batch.column("minimaa"), batch.column("minimab"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("membersa"), batch.column("membersb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= rule.percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    schema = f"a {kind}, b {kind}"
    likely = in_arrow(likely.select("a", "b", "minimaa", "minimab"), first, schema)
    full = likely.join(side("a", "members"), "a").join(side("b", "members"), "b")
    return in_arrow(full.select("a", "b", "membersa", "membersb"), exact, schema)


def crossing(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) between different components in the buckets of ``members`` (bucket, node, root, blocks).

    A bucket is dealt out in blocks of about ``BLOCK`` members, and each pair of blocks is a group of its own.  A pair
    of members is tested in the first band that it shares, unless links of the group already connect it.
    """
    kind = members.schema["node"].dataType.simpleString()
    rows = (members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", "node", "root", "block", F.least("block", "k").alias("low"), F.greatest("block", "k").alias("high"))
            .join(sets, "node"))

    def run(group: pa.Table) -> pa.Table:
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        root, block = group.column("root").to_numpy(), group.column("block").to_numpy()
        low = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("minima")])
        bands = rule.numbers(low)
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("members")]
        here = np.uint64(group.column("bucket")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
        least = rule.least_equal() * low.shape[1]
        up, found = {}, []

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        inner = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        for i in range(len(node)):
            js = np.arange(i + 1, len(node))
            if not inner:
                js = js[block[js] != block[i]]
            js = js[(root[js] != root[i]) & (100 * np.minimum(n[js], n[i]) >= rule.percent * np.maximum(n[js], n[i]))]
            js = js[(low[js] == low[i]).sum(1) >= least] if len(js) else js
            if len(js):
                same = bands[js] == bands[i]
                js = js[same.any(1) & (bands[i][same.argmax(1)] == here)]
            for j in js:
                a, b = top(root[i]), top(root[j])
                if a != b:
                    common = len(np.intersect1d(full[i], full[j], assume_unique=True))
                    if 100 * common >= rule.percent * (n[i] + n[j] - common):
                        up[max(a, b)] = min(a, b)
                        found.append((node[i], node[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, group.schema.field("node").type), "b": pa.array(b, group.schema.field("node").type)})

    return rows.groupBy("bucket", "low", "high").applyInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: root is the smallest node of its component."""
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        # Large star: the larger neighbours of a node go to the smallest of the node and its neighbours.
        large = both.join(smallest(both), "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = smallest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    all_ = written(sketches(docs, rule), "sketches")
    full = all_.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    nodes = full.groupBy("print").agg(F.min("doc_id").alias("node"))
    chosen = full.select("doc_id", "print", "bands").join(
        nodes.select("print", F.col("node").alias("doc_id")), ["print", "doc_id"], "left_semi")
    placed = chosen.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = (placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
              .filter("hub <> last").drop("last"))
    members = written(placed.join(shared, "bucket"), "buckets")
    some = members.select("node").distinct()
    sets = written(full_sets(docs.join(some.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), rule), "sets")

    tested = written(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(),
                     "tested")
    links = written(linked(tested, sets, rule), "links")
    roots = components(links)

    # What the hubs left open: pairs of other members of a bucket, in different components.
    others = members.filter("node <> hub").select("bucket", "node").distinct().join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    several = (others.groupBy("bucket").agg(F.min("root").alias("_l"), F.max("root").alias("_h"),
                                            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
               .filter("_l <> _h").select("bucket", "blocks"))
    links = written(crossing(others.join(several, "bucket"), sets, rule), "links")
    if not links.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    named = nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("root"))
    out = all_.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    component = F.least(F.col("doc_id"), F.col("root"))
    return out.join(named, "print", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Rule(words=3, percent=85))
