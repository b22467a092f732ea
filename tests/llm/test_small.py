"""Pure parts of the operators, without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm.chat import assemble, turns
from tabloom.llm.common import words
from tabloom.llm.elias_fano import EliasFano
from tabloom.llm.line_dedup import deleted_lines, patience
from tabloom.llm.packing import Limits, Packer
from tabloom.llm.topk import ImpactIndex


def test_words_are_ascii_split():
    texts = ["A b\tc\n", "", None, " x y  Z "]
    starts, codes, distinct = words(pa.array(texts))
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        assert [names[c].encode() for c in codes[starts[i]:starts[i + 1]]] == (t or "").encode().lower().split()


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (1000, 1000), (1000, 10**6), (70000, 10**12), (300, 2**61)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)) if n else np.zeros(0, np.int64)
    held = EliasFano(values, universe)
    asked = np.concatenate([values, rng.integers(0, universe, 200)])
    if n:
        assert (held.get(np.arange(n)) == values).all()
        assert (held.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((held.find(asked) >= 0) == np.isin(asked, values)).all()


def test_turns_come_back():
    roles = ["user", None, "a: b#<\\", "assistant"]
    texts = ["\\### Assistant: </turn> ok", "", None, "x</turn>\n### user: y\\c"]
    buffer, ends, at, length = assemble(pa.array(roles), pa.array(texts))
    assert list(turns(buffer.tobytes())) == [((r or "").encode(), (t or "").encode()) for r, t in zip(roles, texts)]


def test_patience_and_blocks():
    assert patience(list("abcde"), list("xabyde")) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    line = lambda text: [(i, c, 5) for i, c in enumerate(text)]
    assert sorted(deleted_lines(line("abcd"), line("xaby"), 10)) == [1, 2]
    assert deleted_lines(line("abcd"), line("xayb"), 10) == []
    assert sorted(deleted_lines(line("abcd"), line("cdab"), 10)) == [0, 1, 2, 3]  # moved blocks


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64), Limits(64, 8, 20)])
def test_packer_keeps_every_token(limits):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 3 * limits.tokens, 60)
    packer = Packer(limits, 0, wait=16)
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype=np.uint32), np.r_[0, np.ones(n - 1, np.int64)])
    packer.pack(0)
    held: dict = {}
    length: dict = {}
    for key, start, ids, total, sequence, offset in packer.out:
        assert offset == length.get(sequence, 0) and (ids == np.arange(start, start + len(ids))).all()
        length[sequence] = offset + len(ids)
        held[key] = held.get(key, 0) + len(ids)
    assert [held[k] for k in range(60)] == sizes.tolist()
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in length.values())


def test_impact_index_proves_its_members():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (600, 16)).astype(float)
    index = ImpactIndex(x)
    for q in rng.integers(-20, 20, (20, 16)).astype(float):
        scores = x @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(index.members(q, 5, few=20).tolist())


def test_impacts_prove_most_rows_away_on_real_vectors():
    import pyarrow.parquet as pq

    x = np.floor(64 * np.array([v for v in pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()
                                if v and all(c is not None and np.isfinite(c) for c in v)][:4000], float))
    index = ImpactIndex(x)
    asked, scored = x[::40], 0
    for q in asked:
        scores = x @ q
        members = index.members(q, 20, few=40)
        assert set(np.flatnonzero(scores >= np.sort(scores)[-20])) <= set(members.tolist())
        scored += len(members)
    assert index.read < 0.85 * len(asked) * sum(int(p.sum()) for p in index.postings)
    assert scored < 0.05 * len(asked) * len(x)
