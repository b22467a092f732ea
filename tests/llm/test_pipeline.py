"""Each stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_brute_force import components, fitted, folded, shingles
from test_line_pairs import kept

import corpus_pipeline
from tabloom.llm import quality
from tabloom.llm.common import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def rows_of(df) -> list:
    return sorted(df.collect(), key=str)


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_stage(spark, stages):
    docs = stages["documents"].collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()
              if r[1] is not None}
    x = quality.statistics(pa.array([r["text"] for r in docs], pa.string()))
    y = np.array([labels.get(r["doc_id"], -1) for r in docs])
    learnt = np.array([r["doc_id"] in labels and folded(r["doc_id"], 3) != 1 for r in docs])
    odds = fitted(x[learnt], y[learnt])(x)
    assert rows_of(stages["quality"]) == sorted((r for r, o in zip(docs, odds) if o >= 0), key=str)


def test_lines_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages["quality"].collect()}
    tidy = {i: "\n".join(line.strip() for line in (t or "").split("\n") if line.strip()) for i, t in before.items()}
    want = kept([(i, t) for i, t in tidy.items()])
    got = {r["doc_id"]: r for r in stages["lines"].collect()}
    for i, words in want.items():
        if i not in got:
            assert not words and tidy[i]  # every line went
        else:
            assert got[i]["text"].split() == words
            assert got[i]["n_chars"] == len(got[i]["text"])


def test_near_duplicates_stage(stages):
    before = stages["lines"].collect()
    want = components({r["doc_id"]: shingles(r["text"], 5) for r in before}, 80)
    assert rows_of(stages["near_duplicates"]) == sorted((r for r in before if want[r["doc_id"]] == r["doc_id"]), key=str)


def test_mixing_stage(stages):
    before = {r["doc_id"]: r for r in stages["near_duplicates"].collect()}
    taken, sizes = Counter(), Counter()
    for r in before.values():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    of = Counter()
    for r in stages["mixing"].collect():
        whole, part = WORD.findall(before[r["doc_id"]]["text"] or ""), WORD.findall(r["text"] or "")
        # A run of words, or one around the end of the document, in order of the text.
        assert any(whole[i:i + len(part)] == part or whole[:i] + whole[len(whole) - len(part) + i:] == part
                   for i in range(len(whole) + 1))
        taken[r["source"]] += len(part)
        of[r["doc_id"]] += len(part)
    assert all(n <= 2 * len(WORD.findall(before[i]["text"] or "")) for i, n in of.items())
    # Targets by filling the sources that their weight would take above twice their size.
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert all(abs(taken[s] - target[s]) <= 64 for s in order)


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in stages["mixing"].collect():
        want[r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1] += 1
    pieces, sequences = defaultdict(int), defaultdict(list)
    for r in stages["packing"].collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(pieces) == {key: key[1] * n for key, n in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
