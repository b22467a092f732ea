"""Line deduplication against brute force over all pairs of documents."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from tabloom.llm import line_dedup
from tabloom.llm.common import raw_bytes, span_hashes, word_spans

LEAST, PASSAGE = 10, 50


def kept(rows: list[tuple[int, str]]) -> dict[int, list[str]]:
    """The words that each document keeps, line by line, by comparing every line and run of words of every pair."""
    lines = {i: text.split("\n") for i, text in rows}
    owners = defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            owners[x].add(i)
    out = {}
    for d, b in lines.items():
        gone = {y for y, x in enumerate(b) if d != min(owners[x]) and len(owners[x]) > 1 and len(x.split()) >= 3
                and len(x.split()) * len(owners[x]) >= 100}
        for o in (o for o in lines if o < d):
            a = lines[o]
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if sum(len(line.split()) for line in b[y:y + n]) >= LEAST:
                        gone.update(range(y, y + n))
        said = " ".join(b).split()
        lost = np.repeat([y in gone for y in range(len(b))], [len(x.split()) for x in b])
        earlier = {tuple(w[i:i + PASSAGE]) for o in lines if o < d for w in [" ".join(lines[o]).split()]
                   for i in range(len(w) - PASSAGE + 1)}
        for i in range(len(said) - PASSAGE + 1):
            if tuple(said[i:i + PASSAGE]) in earlier:
                lost[i:i + PASSAGE] = True
        out[d] = [w for w, x in zip(said, lost) if not x]
    return out


def test_all_pairs(spark):
    rng = np.random.default_rng(9)
    pool = [" ".join(f"p{rng.integers(40)}" for _ in range(rng.integers(1, 14))) for _ in range(60)]
    story = [" ".join(f"s{k}x{i}" for i in range(120)).split() for k in range(4)]
    rows = []
    for d in range(60):
        lines = [pool[i] for i in rng.integers(0, 60, rng.integers(0, 14))]
        if d % 3 == 0:  # a passage whose lines break anywhere, some with a changed word
            said, at = list(story[rng.integers(4)][rng.integers(30):]), int(rng.integers(1, 60))
            if d % 2:
                said[60] = f"changed{d}"
            lines.insert(int(rng.integers(0, len(lines) + 1)), "own " + " ".join(said[:at]))
            lines.append(" ".join(said[at:]) + f" end{d}")
        rows.append((d, "\n".join([f"title {d}", *lines])))
    rows += [(60, rows[7][1]), (61, "\n".join(rows[5][1].split("\n")[::-1])), (62, rows[4][1] + "\n" + rows[4][1])]
    got = {r["doc_id"]: r["text"].split() for r in line_dedup.deduplicated(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == kept(rows)
    assert sum(len(t.split()) for _, t in rows) > sum(map(len, got.values()))


def test_stretches():
    first, after = line_dedup.stretches(np.array([1, 1, 0, 1, 1, 1, 1], bool), np.array([5, 5, 5, 5, 5, 6, 6]), longest=1)
    assert list(zip(first, after)) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (6, 7)]
    first, after = line_dedup.stretches(np.array([1, 1, 0, 1, 1, 1, 1], bool), np.array([5, 5, 5, 5, 5, 6, 6]))
    assert list(zip(first, after)) == [(0, 2), (3, 5), (5, 7)]


def test_broken_alignments_lose_no_run():
    line = {c: (ord(c), 0, 6) for c in "abc"}
    run = lambda at, owner_at, text: (at, owner_at, np.array([line[c] for c in text]))
    assert line_dedup.aligned([run(0, 5, "ab"), run(4, 2, "ba"), run(8, 5, "ab")], 10) == [0, 1, 4, 5, 8, 9]


def test_many_stretches_of_a_fingerprint_are_compared_by_rows(spark, monkeypatch):
    said = " ".join(f"s{i}" for i in range(90)).split()
    rows = [(d, f"own{d} " + " ".join([*said[d % 7:40 + d], f"new{d}", *said[3 * d:]])) for d in range(20)]
    rows += [(20, rows[4][1]), (21, "x " + rows[5][1] + " " + rows[5][1])]
    got, names = [], []
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: names.append(name) or write(df, name))
    for most in (1_000, 3, 0):
        monkeypatch.setattr(line_dedup, "MOST_STRETCHES", most)
        out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        got.append({r["doc_id"]: r["text"].split() for r in out.collect()})
        assert ("runs-of-words" in names) == (most < 1_000)  # few stretches need no row for each run
    assert got == [kept(rows)] * 3


def test_word_hashes_tell_words_apart():
    said = ["a", "b", "ab", "ba", "a\0", "\0a", "é", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 300, "x" * 301]
    texts = pa.array(["\x0b a\tb  ab\r\nba ", "", " \n", " ".join(said), "tail", "a"])
    raw, offsets = raw_bytes(texts)
    begin, end, starts = word_spans(raw, offsets)
    words = [raw[a:b].tobytes().decode() for a, b in zip(begin, end)]
    assert words == [w for t in texts.to_pylist() for w in t.encode().split() for w in [w.decode()]]
    assert list(np.diff(starts)) == [len(t.encode().split()) for t in texts.to_pylist()]
    hashes = span_hashes(raw, begin, end).tolist()
    assert len(set(hashes)) == len(set(words)) == len(dict(zip(words, hashes))) == len(set(zip(words, hashes)))


def test_texts_without_lines_and_runs():
    texts = pa.array(["dropped", "a b\n\n c d \ne", "k  l\tm n o", "stays\n\n as it is ", "gone", ""])[1:]
    edits = pa.array([{"gone": [1], "runs": []}, {"gone": [], "runs": [{"at": 2, "n": 1}]}, None, {"gone": [0], "runs": []},
                      {"gone": [], "runs": []}],
                     pa.struct({"gone": pa.list_(pa.int32()), "runs": pa.list_(pa.struct({"at": pa.int32(), "n": pa.int32()}))}))
    new, lines, dropped = line_dedup.without(texts, edits, 2)
    assert new.to_pylist() == ["a b\ne", "k  l o", "stays\n\n as it is ", "", ""]
    assert lines.tolist() == [3, 1, 2, 1, 0] and dropped.tolist() == [1, 0, 0, 1, 0]
