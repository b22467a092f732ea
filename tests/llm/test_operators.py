"""The operators on odd rows: NULLs, empty texts, copies, repeated rows, other columns of clashing names; and empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ann, chat, language, language_model, line_dedup, mixing, near_duplicates, packing, quality, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string"
WORDS = " ".join(f"word{i}" for i in range(40))
PASSAGE = "this very line of many words stands in several documents here"
ROWS = [
    (1, f"{PASSAGE}\n{WORDS}", "en", "a", 1, 7, "x"),
    (2, f"{WORDS} tail\nother words\n{PASSAGE}", "en", None, 1, 7, "x"),
    (3, WORDS.replace("word7", "changed"), "de", "a", 1, 7, None),
    (3, WORDS.replace("word7", "changed"), "de", "a", 1, 7, None),
    (4, None, None, "b", None, None, None),
    (5, "", "de", "b", 0, 0, ""),
    (None, "12 $$", "en", "b", 5, 1, "y"),
    (6, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "b", 1, 7, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in out)
    sizes = {}
    for r in out:
        sizes.setdefault(r["target"], [r["source_size"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= 64 for target, (_, taken) in sizes.items())
    assert mixing.mixed(none).count() == 0
    copies = mixing.copies(mixing.mixed(docs)).select(mixing.token_count("text").alias("n")).agg(F.sum("n")).first()[0]
    assert copies == sum(r["taken"] for r in out)


def test_near_duplicates(docs, none):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(
        docs, near_duplicates.Rule(words=3, percent=70)).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True)} == got
    assert near_duplicates.near_duplicates(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (95, 100)], "a long, b long")
    roots = {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_line_dedup(docs, none):
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.deduplicated(docs).collect()}
    assert got[1] == (ROWS[0][1], 0) and got[2] == (f"{WORDS} tail\nother words", 1)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[3][1] == 0 and got[None][1] == 0
    assert line_dedup.deduplicated(none).count() == 0


def test_line_dedup_finds_blocks_whatever_owns_their_lines(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{a}\nfirst"), (2, f"second\n{b}"), (3, f"{a}\n{b}\nthird"), (4, f"fourth\n{a}\n{b}"), (4, f"fourth\n{a}\n{b}"),
            (5, f"{b}\n{a}\nfifth")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [*rows[:3], (4, "fourth"), (4, "fourth"), rows[5]]


def test_line_dedup_takes_every_copy_of_a_block(spark):
    rows = [(1, f"{PASSAGE}\ny"), (2, f"{PASSAGE}\nx\n{PASSAGE}")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_deleted"]) for r in out} == {1: (rows[0][1], 0), 2: ("x", 2)}
    lines = lambda text: [(i, c, 12) for i, c in enumerate(text)]
    assert sorted(line_dedup.deleted_lines(lines("Py"), lines("PxP"), 10)) == [0, 2]


def test_line_dedup_takes_frequent_short_lines(spark):
    rows = [(i, f"all rights are reserved here\nstory {i} of its own\nthe\nseldom said in five" + "!" * (i // 3)) for i in range(25)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: t if i == 0 else t.split("\n", 1)[1] for i, t in rows}


def test_line_dedup_finds_passages_inside_lines(spark):
    said = [f"said{i}" for i in range(60)]
    rows = [(1, "head " + " ".join(said) + " tail"), (2, "x y " + " ".join(said[:25]) + "\n" + " ".join(said[25:]) + " z"),
            (3, "q\n" + " ".join(said[:49]) + "\nr"), (3, "another text")]
    got = {(r["doc_id"], r["text"]): r["n_deleted"] for r in line_dedup.deduplicated(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0]: 0, (2, "x y\nz"): 0, rows[2]: 0, rows[3]: 0}


def test_line_dedup_keeps_texts_without_edits_where_they_are(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    may_hold = line_dedup.Few(ids).may_hold("doc_id")
    told = spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", may_hold.alias("may")).collect()
    assert all(r["may"] for r in told if r["doc_id"] % 3 == 0) and sum(r["may"] for r in told) < 1100
    rows = [(i, f"{PASSAGE}\n" * (i < 2) + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(50)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and sorted(map(tuple, out.select("doc_id", "text").collect())) == [rows[0], (1, rows[1][1].split("\n")[1]), *rows[2:]]


def test_line_hashes_are_those_of_split_lines():
    import pyarrow as pa
    import xxhash

    texts = ["", "a b\n\n  c \td\r\n", "x", "\n", " \x0b\ny\nz z z", "", "é\u00a0q\n \u2003"]
    ends, digests, sizes = line_dedup.line_hashes(pa.array(["dropped", *texts])[1:])
    lines = [[x for x in t.encode().split(b"\n") if x.split()] for t in texts]
    assert np.diff(ends).tolist() == [len(x) for x in lines]
    assert digests == [xxhash.xxh3_128_digest(x.strip(b" ")) for t in lines for x in t]
    assert sizes.tolist() == [len(x.split()) for t in lines for x in t]


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (5, None), (77, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(docs)
    out = quality.scored(stats, quality.learned(stats, labels, fold=1, held=5)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    empty = quality.with_statistics(none)
    assert quality.scored(empty, quality.learned(empty, labels)).count() == 0
    names = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, language.train(docs)).collect()}
    assert names[4] == names[5] == names[None] == "und" and names[1] == "en"
    assert {r["lang_pred"] for r in language.predicted(docs, language.train(none)).collect()} == {"und"}
    assert language.predicted(none, language.train(docs)).count() == 0


def test_language_model(docs, none):
    held = F.col("doc_id") == 2
    whole, split = (language_model.scored(docs, held, n).collect() for n in (4_000_000, 2_000))
    for out in (whole, split):  # one shard, and many with words split by the word before
        by = {r["doc_id"]: r for r in out}
        assert len(out) == len(ROWS) and by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[2]["held_out"]
        assert by[2]["score"] > by[2]["base_score"]
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6))
    assert sorted(map(key, whole)) == sorted(map(key, split))
    assert language_model.scored(none, held).count() == 0


def test_language_model_does_not_depend_on_shards(spark):
    rng = np.random.default_rng(4)
    names = np.array(["the", "of", *(f"n{i}" for i in range(60))])
    share = np.r_[0.3, 0.1, np.full(60, 0.01)]
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(1, 60)), p=share))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, few, many = ({r["doc_id"]: r["score"] for r in language_model.scored(docs, F.col("doc_id") % 7 == 2, n).collect()}
                      for n in (4_000_000, 3_000, 200))
    for got in (few, many):  # scores are sums of steps of 1/2048
        assert max(abs(got[i] - one[i]) for i in one) < 0.02


def test_language_model_sends_a_token_at_one_price_however_many_shards(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, 300), 5000)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, held boolean").coalesce(1)
    language_model.batches_of(spark, 2 * language_model.PIECE)
    common = [r[0] for r in language_model.frequent(docs).filter("h is not null").orderBy(F.col("n").desc()).collect()]

    def sent(shards):
        # A word is split into as many classes as shards hold it, as in a corpus that needs them.
        deal = language_model.Deal(shards, np.array(common, np.uint64), {common[0]: shards // 4})
        parts = language_model.to_shards(docs, deal, np.ones(len(common), np.int64), 6.0).agg(F.sum(F.octet_length("data"))).first()[0]
        counts = language_model.word_counts(language_model.word_needs(docs, deal))
        return parts, counts.filter("shard >= 0").agg(F.sum(F.octet_length("data"))).first()[0]

    few, many = sent(8), sent(128)
    # With lists of all words for each shard, trigrams took 1.21 times as much and counts 6.0 times.
    assert many[0] < 1.1 * few[0] and sum(many) < 1.4 * sum(few)


def test_packing(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pieces_of(packing.packed(docs, path)).collect()
    length: dict = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == length.get(r["sequence_id"], 0)
        length[r["sequence_id"]] = r["offset"] + r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in out}[4] == 1 and max(length.values()) <= 2048
    assert packing.packed(none, path).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a<b"), (1, 1, "assistant", "x\\y"), (1, 1, "assistant", "x\\y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.formatted(df)).collect()}
    assert got == {1: (3, 6), None: (1, 0)}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_searches(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (None, [1.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 64 * 57), (0, 2, 1, 64 * 57), (0, 3, 5, 0)]
    near = ann.nearest(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in near] == [(0, 1), (0, 1)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 3).count() == ann.nearest(df.limit(0), F.col("vec_id") == 0, 2).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e5, 3.0]), (1, [7e4, 0.0]), (2, [8e4, 0.0]), (3, [9e6, 1.0]), (4, [9e6, 2.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4)
           .orderBy("rank").collect()]
    score = lambda x: sum(int(64 * a) * int(64 * b) for a, b in zip(rows[0][1], x))
    assert got == [(0, rank, i, score(rows[i][1])) for rank, i in enumerate((4, 3, 2, 1), 1)]


def test_top_k_over_several_blocks_is_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 0.2, (400, 12)), 3)
    x[100:120] = x[0]  # copies tie
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist()), (40, (x[40] + 1).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7, row_block=64).collect()}
    ints = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = set()
    for key in range(0, 400, 20):
        q = np.floor(64 * np.array(min(v for i, v in rows if i == key))).astype(int)
        best = sorted((-int(q @ v), i) for i, v in ints if i != key)[:7]
        want |= {(key, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want
