"""Packed ids against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tabloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a.b,c d!", "<|endoftext|> x<|startoftext|>", "é́ ﬁ Ǆ", "漢字\U0001f600 x̀y", "can't WON'T 12x34", "İ ſ",
       "\x00 \x85 　", "w" * 3000]


def test_ids_of_odd_texts_while_words_come_and_go():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ODD + [" ".join("".join(rng.choice("abcdéß.,'1 ") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(200)]
    for most in (400_000, 50, 3):
        encoder = packing.Words(PATH, 1, most)
        for low in range(0, len(texts), 7):
            part = texts[low:low + 7]
            ids, starts = encoder.encode(pa.array(part, pa.string()))
            want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in part]
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want


def test_query_holds_every_id_once(spark):
    from pyspark.sql import functions as F

    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed(docs, PATH).collect()
    whole, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(whole.setdefault(r["doc_id"], [])) == r["start"]
        whole[r["doc_id"]] += ids
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    want = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids + [1]
            for d in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    assert whole == want
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048 and (at & (at - 1)) == 0


def test_words_that_are_kept_are_few_enough_for_every_worker_of_an_executor():
    encoder = packing.Words(PATH, 1)
    text = ""
    for k in range(8):
        text = " ".join(f"w{k}x{i}" for i in range(50_000))
        ids, _ = encoder.encode(pa.array([text]))
        assert len(encoder.known) <= 250_000
    plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*plain, 1]
