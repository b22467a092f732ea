"""Byte-level BPE encoding by backtracking over an Aho-Corasick automaton, and decoding by an offset table.

Texts are cut as byte-level tokenizers cut them: at special tokens, then into short spans (letters, digits, marks, blanks),
over whose ends no merge goes.  In a span the automaton finds, in one pass, the longest token that starts at each byte.
The encoder takes the longest token that is compatible with the one before it, else the next shorter prefix of it that is a token;
if none is left, the place is marked dead and the token before is shortened.  Each place dies at most once, so the
work is linear.  A row of tokens is the result of the merges exactly if all neighbours are compatible.

Two tokens are compatible if merging their joint bytes gives back the two: then no merge over their border comes before
the merges that build them.  The table of pairs holds the answers that were asked for.

Decoding copies bytes by a table of offsets into the joint bytes of all tokens; bytes that are no UTF-8 become U+FFFD.

Edge cases: a NULL or empty text has no tokens and decodes to an empty text; long texts are cut into parts at
blanks, where a span begins in any case, and a span without blanks is encoded whole; rows that repeat are encoded as
often as they come; an empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import in_arrow, pieces, table

# Fixed value: the spans of byte-level tokenizers.
SPANS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = 1 << 20
NEVER = 1 << 40


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the others in order
    from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, cut = stored["model"], stored["pre_tokenizer"]
        plain = (model["type"] == "BPE" and stored["normalizer"] is None and cut["type"] == "ByteLevel" and not cut["add_prefix_space"]
                 and not (model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")))
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE")
        names, ids = byte_names(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stored["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings")
        self.bytes = {i: bytes(names[c] for c in token) for token, i in ids.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.size = max([*self.bytes, *self.special.values()]) + 1


class Encoder:
    """Token ids of texts; spans that were encoded are kept, up to ``most``."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        import ahocorasick

        self.most, self.special = most, vocabulary.special
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for r, (a, b, whole) in enumerate(vocabulary.merges):
            self.rank[a, b] = r
            self.made.setdefault(whole, (r, a, b))
        self.length = [0] * vocabulary.size
        self.automaton = ahocorasick.Automaton()
        by_text = {}
        for i, raw in vocabulary.bytes.items():
            self.length[i] = len(raw)
            by_text[raw.decode("latin-1")] = i
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of a token; -1 if there is none.
        self.shorter = [-1] * vocabulary.size
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
        self.span = regex.compile(SPANS)
        self.cut = regex.compile(r"(?<=\S)(?= )")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sides: tuple[dict, dict] = ({}, {})

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at its right (1) or left (0) end, from a byte up to itself, each with the rank of the
        merge that ends it."""
        found = self.sides[side].get(token)
        if found is None:
            part, ends, found = token, NEVER, []
            while part in self.made:
                found.append((part, ends))
                ends, part = self.made[part][0], self.made[part][2 if side else 1]
            found = [*found, (part, ends)][::-1]
            self.sides[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joint bytes end in these two tokens."""
        answer = self.pairs.get((left, right))
        if answer is None:
            if len(self.pairs) > 2 * self.most:
                self.pairs.clear()
            answer = self.pairs[left, right] = self._meets_no_merge(self._edge(left, 1), self._edge(right, 0))
        return answer

    def _meets_no_merge(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        """Follows the merges on both sides by rank.  Of equal ranks the leftmost goes first."""
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            over = self.rank.get((a, b), NEVER)
            if over < a_ends and over <= b_ends and over < NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def tokens(self, span: bytes) -> list[int]:
        """The tokens of one span."""
        text, length = span.decode("latin-1"), self.length
        longest = [-1] * len(text)
        for end, token in self.automaton.iter(text):  # by rising end, so that the longest stays
            longest[end + 1 - length[token]] = token
        dead, out, at, token = bytearray(len(text) + 1), [], 0, longest[0]
        while at < len(text):
            while token >= 0 and (dead[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < len(text) else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"no token for byte {span[0]}")
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts that can be cut into spans by themselves."""
        start = 0
        while len(text) - start > PART:
            found = self.cut.search(text, start + PART)
            stop = found.start() if found else len(text)
            yield text[start:stop]
            start = stop
        yield text[start:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, stretch in enumerate(self.marks.split(text) if self.special else [text]):
            if i % 2:
                out.append(self.special[stretch].to_bytes(4, "little"))
                continue
            for part in self._parts(stretch):
                spans = self.span.findall(part)
                for span in set(spans):
                    if span not in self.known:
                        ids = self.tokens(span.encode())
                        self.known[span] = pack(f"<{len(ids)}I", *ids)
                out.extend(map(self.known.__getitem__, spans))
                if len(self.known) > self.most:  # the older half goes
                    for span in list(islice(self.known, len(self.known) // 2)):
                        del self.known[span]
        return b"".join(out)


class Decoder:
    """Texts of token ids."""

    def __init__(self, vocabulary: Vocabulary):
        names = byte_names()
        raw = dict(vocabulary.bytes)
        for token, i in vocabulary.special.items():
            raw[i] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
        self.sizes = np.zeros(vocabulary.size, np.int64)
        for i, token in raw.items():
            self.sizes[i] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joint = np.frombuffer(b"".join(raw.get(i, b"") for i in range(vocabulary.size)), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for low in range(0, len(ids), PART):
            part = ids[low:low + PART]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(int(ends[-1]))
            out.append(self.joint[places].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_KEPT: dict[tuple, object] = {}  # of this Python worker


def _kept(kind: type, path: str):
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(Vocabulary(path))
    return _KEPT[kind, path]


def encoded(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, ids): ids as little-endian unsigned 32-bit integers."""
    slim = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(Encoder, tokenizer)
        for batch in batches:
            for piece in pieces(batch, text):
                ids = [encoder.encode(t or "") for t in piece.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    return in_arrow(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, ids binary")


def decoded(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows of (key, ids, text)."""
    slim = df.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _kept(Decoder, tokenizer)
        for batch in batches:
            for piece in pieces(batch, ids):
                texts = [decoder.decode(np.frombuffer(raw or b"", "<u4")) for raw in piece.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(key), piece.column(ids), pa.array(texts, pa.string())],
                                                 [key, ids, "text"])

    return in_arrow(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, `{ids}` binary, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
