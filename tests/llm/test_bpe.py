"""Encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "aaaa" * 700, " " * 999 + "x", "=" * 501, "don't we'll 'sTOP 's", "x<|endoftext|>y <|endoftext|>", "<|endoftext|",
       "é́ é", "漢字 \U0001f600‍\U0001f600", "\x00\x1c\x85　tab\t\n\r\n  end  ", "12 345x6 ٣½", "İſ",
       "the theory of\n\n\nthe  thing " * 40]


@pytest.fixture(scope="module")
def coder():
    vocabulary = bpe.Vocabulary(PATH)
    return bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def same(coder, library, text: str) -> bool:
    ids = np.frombuffer(coder[0].encode(text), "<u4")
    want = library.encode(text, add_special_tokens=False).ids
    return ids.tolist() == want and coder[1].decode(ids) == library.decode(want, skip_special_tokens=False)


def texts(n: int) -> list[str]:
    rng = random.Random(7)
    kinds = ["ab", "aaaa ", "theing ", "'stm'll", "012 \n\t", "éüß漢́\U0001f600", ".,!- ", "=-_"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(coder, library):
    assert [t for t in ODD + texts(2000) if not same(coder, library, t)] == []


def test_spans_of_all_kinds_of_characters(coder, library):
    points = [*range(0x0, 0x3100), *range(0xA000, 0xAC00, 5), *range(0x10000, 0x12000, 7), *range(0x1F000, 0x1FB00, 3)]
    around = [f"a{c}b 1{c}2 {c}{c} .{c} " for c in map(chr, points)]
    lines = ["".join(around[i:i + 64]) for i in range(0, len(around), 64)]
    assert [t for t in lines if not same(coder, library, t)] == []


def test_parts_and_a_small_store_change_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 40)
    small = bpe.Encoder(bpe.Vocabulary(PATH), most=8)
    assert [t for t in ODD + texts(200) if not same((small, coder[1]), library, t)] == []


def test_pairs_against_merging(coder, library):
    """Neighbours are compatible exactly where merging their joint bytes gives them back."""
    rng, raw = random.Random(3), bpe.Vocabulary(PATH).bytes
    lower = [i for i, b in raw.items() if b.isalpha() and b.isascii()]
    for _ in range(3000):
        a, b = rng.choice(lower), rng.choice(lower)
        want = library.encode((raw[a] + raw[b]).decode(), add_special_tokens=False).ids == [a, b]
        assert coder[0].compatible(a, b) == want


def test_bytes_that_are_no_text(coder, library):
    ids = [t for t in range(128, 256)]
    assert coder[1].decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", None), (3, None, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.decoded(bpe.encoded(df, PATH), PATH).collect()
    key = lambda k, ids, text: (k is None, k or 0, hashlib.sha256(bytes(ids)).hexdigest(), text)
    want = [key(k, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for k, t, _ in rows]
    assert sorted(key(r["doc_id"], r["ids"], r["text"]) for r in found) == sorted(want)
    assert bpe.encoded(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in bpe.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len({d["doc_id"] for d in docs})
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
