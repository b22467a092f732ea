"""Resampling against plain Python, and the selection on ties and copies."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import resampling as r


def plain(rows, target, draw):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        runs = [" ".join(w[i:i + n]) for n in range(1, draw.longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % draw.buckets for f in runs]

    here, there = [0] * draw.buckets, [0] * draw.buckets
    for texts, counts in (([t for _, t in rows], here), (target, there)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    size_here, size_there = sum(here) + draw.buckets, sum(there) + draw.buckets
    gain = [math.floor(1000 * math.log((t + 1) * size_here / ((s + 1) * size_there))) for s, t in zip(here, there)]
    out = []
    for i, text in rows:
        n_words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    may = sorted((o for o in out if o[1] >= draw.least), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[2]))
    for rank, o in enumerate(may[:len(may) * draw.percent // 100], 1):
        o[5] = rank
    return sorted(map(tuple, out), key=repr)


TEXTS = ["The cat-sat on THE mat Ärger 12x", None, "", "...", "mat mat mat", "a b c d e f g h", "漢字 a\u0000b\x7fc", "w " * 3000]


@pytest.mark.parametrize("draw", [r.Draw(40, 2), r.Draw(50, 1, longest=3, buckets=101), r.Draw(0, 2), r.Draw(100, 0, buckets=7)])
def test_against_plain_python(spark, monkeypatch, draw):
    monkeypatch.setattr(r, "PIVOTS", 3)
    monkeypatch.setattr(r, "CHUNK", 4)
    rows = [(i % 37, f"{TEXTS[i % len(TEXTS)] or ''} t{i % 5}" if i % 3 else TEXTS[i % len(TEXTS)]) for i in range(200)]
    rows += [(500, "the same row many times over")] * 90 + [(None, "no id cat mat")] * 3
    target = ["cat on a mat", None, "a b c the same"]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, score string, weight int, part int").repartition(5)
    got = r.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), draw)
    got = [tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain(rows, target, draw)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert r.resampled(docs.limit(0), docs).count() == 0
    assert r.resampled(docs, docs.limit(0), r.Draw(100, 1)).select("rank").collect() == [(1,)]


def test_kth_key_of_random_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("doc_id"), F.lit(1).cast("long").alias("n_features"),
                                    (F.xxhash64("id") % 20).cast("long").alias("score"))
    want = sorted((-x["score"], False, x["doc_id"], 1) for x in rows.collect())
    for k in (1, 2, 777, 2500, 4999, 5000):
        assert r.kth_key(rows, k) == want[k - 1]


def test_words_of_slices():
    texts = pa.array(["zz", "A b", None, "é-C"]).slice(1)
    starts, codes, distinct = r.word_lists(texts)
    assert starts.tolist() == [0, 2, 2, 4] and [distinct[c].as_py() for c in codes] == ["a", "b", "é", "c"]
