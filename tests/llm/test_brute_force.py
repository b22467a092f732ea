"""Language model, near duplicates, nearest neighbours and both classifiers against plain models and brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabloom.llm import ann, language, language_model, near_duplicates, quality

SF = "/root/testdata/sf0.01"


def folded(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text: str | None, k: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def components(sets: dict[int, set], percent: int) -> dict[int, int]:
    """The smallest id that each one reaches, by comparing all pairs."""
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}


class Plain:
    """The interpolated trigram model with dictionaries of counts."""

    def __init__(self, texts: list[list[str]]):
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for t in texts:
            for u, v, w in self.runs(t):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
        self.n, self.size = sum(self.one.values()), len(self.one)
        self.d2, self.d3 = self.cut(self.two), self.cut(self.three)
        self.after, self.after2 = defaultdict(list), defaultdict(list)
        for (v, _), c in self.two.items():
            self.after[v].append(c)
        for (u, v, _), c in self.three.items():
            self.after2[u, v].append(c)

    @staticmethod
    def runs(tokens: list[str]):
        said = ["<begin>", "<begin>", *tokens, "<end>"]
        return zip(said, said[1:], said[2:])

    @staticmethod
    def cut(counts: Counter) -> list[float]:
        n = Counter(counts.values())
        more = [0, n[1], n[2], n[3], n[4]]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        bounds = [(0.3, 0.98), (0.5, 1.95), (0.7, 2.9)]
        return [0.0, *(min(hi, max(lo, k - (k + 1) * y * more[k + 1] / more[k] if more[k] else lo))
                       for k, (lo, hi) in enumerate(bounds, 1))]

    @staticmethod
    def mixed(count: int, all_: list[int], d: list[float], lower: float) -> float:
        if not all_:
            return lower
        kept = sum(d[min(c, 3)] for c in all_)
        return (count - d[min(count, 3)] + kept * lower) / sum(all_)

    def base(self, w: str) -> float:
        return (self.one[w] + 1) / (self.n + self.size + 1)

    def score(self, tokens: list[str]) -> float:
        total = 0.0
        for u, v, w in self.runs(tokens):
            p = self.mixed(self.two[v, w], self.after.get(v, []), self.d2, self.base(w))
            total += log10(self.mixed(self.three[u, v, w], self.after2.get((u, v), []), self.d3, p))
        return total


def test_language_model_is_the_plain_one(spark):
    rng = np.random.default_rng(12)
    names = np.array(["the", "of", *(f"n{i}" for i in range(80))])
    share = np.r_[0.25, 0.15, np.full(80, 0.6 / 80)]
    texts = {i: list(rng.choice(names, int(rng.integers(0, 50)), p=share)) for i in range(250)}
    texts[9] = ["unseen", "the", "Words", "of"] * 3
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    texts[9] = [w.lower() for w in texts[9]]
    held = {i for i in texts if i % 5 == 4}
    plain = Plain([t for i, t in texts.items() if i not in held])
    for shard_tokens in (1_000_000, 400):  # one shard; several, with split words
        rows = language_model.scored(docs, F.col("doc_id") % 5 == 4, shard_tokens).collect()
        assert len(rows) == len(texts)
        for r in rows:
            tokens = [*texts[r["doc_id"]], "<end>"]
            assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(tokens), plain.n, r["doc_id"] in held)
            assert r["n_known"] == sum(plain.one[w] > 0 for w in tokens)
            assert abs(r["base_score"] - sum(log10(plain.base(w)) for w in tokens)) < 1e-8
            # Logarithms are kept in steps of 1/2048: a token has at most three of them.
            assert abs(r["score"] - plain.score(texts[r["doc_id"]])) < 1.5 / 2048 * len(tokens) ** 0.5 + 1e-4 * len(tokens)


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts: dict[int, str | None] = {}
    for i in range(240):
        if i % 4 and rng.random() < 0.8:  # a copy of an earlier text with some words changed
            words = (texts[int(rng.integers(i))] or "").split()
            for at in rng.integers(0, max(1, len(words)), int(rng.integers(0, 4))):
                words[at:at + 1] = [f"x{rng.integers(10)}"]
        else:
            words = [f"W{rng.integers(300)}" for _ in range(int(rng.integers(0, 90)))]
        texts[i] = " ".join(words) if i != 17 else None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for rule in (near_duplicates.Rule(words=3, percent=85), near_duplicates.Rule()):
        sets = {i: shingles(t, rule.words) for i, t in texts.items()}
        want = components(sets, rule.percent)
        assert len(set(want.values())) < len(want) - 20
        got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs, rule).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert all(r["kept"] == (want[i] == i) for i, r in got.items())


def test_nearest_neighbours_recall(spark):
    rows = [(r[0], np.array(r[1], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", "embedding").collect() if r[1] is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    size = np.sqrt((x * x).sum(1))
    got = defaultdict(list)
    for r in ann.op5_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    hits = wanted = 0
    assert set(got) == {ids[q] for q in asked}
    for q in asked:
        cosine = (x * x[q]).sum(1) / (size * size[q])
        cosine[ids == ids[q]] = -2
        best = np.lexsort((ids, -cosine))[:5]
        found = got[ids[q]]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        place = {i: n for n, i in enumerate(ids)}
        assert all(abs(r["score"] - cosine[place[r["vec_id"]]]) < 1e-12 for r in found)
        hits += len({r["vec_id"] for r in found} & set(ids[best]))
        wanted += len(best)
    assert hits >= 0.9 * wanted


def test_equally_near_rows_go_by_id(spark):
    rows = [(i, [1.0, 0.5, 0.0]) for i in (9, 3, 7, 0, 5)] + [(2, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn(
        "cell", F.lit(1))
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [3, 5, 7]


def fitted(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 1e-4):
    """Log-odds of class 1 under Gaussians with the shrunken covariances, from the data at once."""
    d = x.shape[1]
    within = [np.cov(x[y == k].T) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    pooled = sum((n[k] - 1) * within[k] for k in (0, 1)) / (sum(n) - 2)
    parts = []
    for k in (0, 1):
        cov = (1 - shrink) * within[k] + shrink * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + (ridge * np.trace(cov) / d + 1e-9) * np.eye(d)
        parts.append((x[y == k].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log(n[k] / sum(n))))

    def odds(z: np.ndarray) -> np.ndarray:
        one, two = (-0.5 * np.einsum("ij,jk,ik->i", z - m, inv, z - m) - 0.5 * det + share for m, inv, det, share in parts)
        return two - one

    return odds


def test_quality_is_the_dense_discriminant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()
              if r[1] is not None}
    x = quality.statistics(pa.array([r["text"] for r in docs], pa.string()))
    ids = [r["doc_id"] for r in docs]
    learnt = np.array([i in labels and folded(i, 3) != 1 for i in ids])
    y = np.array([labels.get(i, -1) for i in ids])
    odds = dict(zip(ids, fitted(x[learnt], y[learnt])(x)))
    out = quality.op7_quality_classifier(spark, SF).collect()
    assert len(out) == len(ids)
    for r in out:
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(odds[r["doc_id"]], -700, 700)))) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (folded(r["doc_id"], 3) == 1)
    right = [r["predicted"] == labels[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_kernel_counts_shared_n_grams():
    texts = ["Straße und Haus", "the house and", "", "12 the", "日本語 text"]
    x = language.normed(language.presence(pa.array(texts)))
    kernel = x @ x.T
    grams = [[{bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in t.lower().encode())[i:i + n]
               for i in range(len(t.lower().encode()) - n + 1)} for n in (1, 2, 3)] for t in texts]
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            want = sum(len(p & q) / (3 * max(1, len(p) * len(q)) ** 0.5) for p, q in zip(a, b))
            assert abs(kernel[i, j] - want) < 0.05  # hashes of few n-grams may meet


def test_language_of_held_out_documents(spark):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = language.op10_language_id(spark, SF).collect()
    assert len(out) == len(lang) and all(0 <= r["score"] <= 1 for r in out)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in out
             if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_language_ties_and_unlabelled_texts(spark):
    rows = [(1, "same words", "aa"), (2, "same words", "bb"), (3, "same words", None), (4, None, "aa"), (None, "same words", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predicted(docs, language.train(docs)).collect()
    named = {r["lang_pred"] for r in out if r["doc_id"] != 4}
    assert len(named) == 1 and named <= {"aa", "bb"} and {r["lang_pred"] for r in out if r["doc_id"] == 4} == {"und"}
