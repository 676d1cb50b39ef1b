"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Per-prefix dynamic programming. For every prefix of a piece of text there is
exactly one token that ends it in the tokenizer's own encoding. An automaton
over the vocabulary gives the tokens that end at a position: an Aho-Corasick
automaton, whose suffix links lead from the longest such token to all shorter
ones, which are the matches a suffix automaton would give. The right one is the
one that is compatible with the last token of the prefix before it. Two tokens are compatible if the merge rules, applied to their
joined bytes, would keep the boundary between them: unmerging both sides step
by step, no merge across the boundary may come before the merges that built the
two tokens. The last tokens of all prefixes are kept; following them back from
the end gives the ids. The work is linear in the text, however long a piece is.

Texts are first split by the tokenizer's own pattern; the encodings of short
pieces are kept for reuse, in a table of bounded size.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KEPT_PIECES, KEPT_LENGTH = 400_000, 48
TOKENIZERS = "/opt/tokenizers"


def _classes(kind: str) -> str:
    """The ranges of all characters of a general category, as a character class."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    runs = []
    for _, g in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        g = list(g)
        runs.append(f"\\U{g[0][1]:08x}-\\U{g[-1][1]:08x}")
    return "".join(runs)


def piece_pattern() -> re.Pattern:
    """The split of byte_bpe_50k: contractions, letters, numbers, others, blanks."""
    letter, number = _classes("L"), _classes("N")
    blank = r"\t-\r \x85\xa0  -     　"
    # The published order has the contractions first; only the class of the others can begin like them.
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def _byte_of_char() -> dict[str, int]:
    """How the vocabulary file writes bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        shown[chr(256 + i)] = b
    return shown


class Encoder:
    """Exact ids of texts. Strings of special tokens in a text are ordinary text."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        import ahocorasick

        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = _byte_of_char()
        as_bytes = {t: "".join(chr(shown[c]) for c in t) for t in vocab if all(c in shown for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> (rank of its merge, id)
        self.halves: dict[int, tuple[int, int, int]] = {}  # id -> (rank, left id, right id)
        for rank, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged.setdefault(pair, (rank, whole))
            self.halves.setdefault(whole, (rank, *pair))
        self.automaton = ahocorasick.Automaton()
        for t, s in as_bytes.items():
            if len(s) == 1 or vocab[t] in self.halves:
                self.automaton.add_word(s, (vocab[t], len(s)))
        self.automaton.make_automaton()
        self.known = {s: [vocab[t]] for t, s in as_bytes.items() if len(s) == 1}
        self.joints: dict[tuple[int, int], bool] = {}
        self.find = piece_pattern().findall
        self.pieces: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together keeps the boundary between them."""
        key = (a, b)
        got = self.joints.get(key)
        if got is None:
            if len(self.joints) > 2_000_000:
                self.joints.clear()
            got = self.joints[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Walk back in time: undo, of the two tokens beside the boundary, the later merge first.
        # A merge across the boundary wins if its rank is lower than that of the merge undone last
        # (or equal, where the left side would still have to merge).
        limit, strict = float("inf"), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across[0] < limit or (not strict and across[0] == limit)):
                return False
            ra, rb = self.halves.get(a), self.halves.get(b)
            if ra is None and rb is None:
                return True
            if rb is None or (ra is not None and ra[0] > rb[0]):
                limit, strict, a = ra[0], True, ra[2]
            else:
                # the same merge at the left comes first: equal ranks across the boundary win
                limit, strict, b = rb[0], False, rb[1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, by the last token of every prefix."""
        s = piece.encode("utf-8").decode("latin-1")
        n = len(s)
        last = [-1] * n
        size = [0] * n
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            start = end - length
            if start < 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end], size[end] = token, length
        ids, at = [], n - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no token that ends at byte {at} of {piece!r}")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> list[int]:
        ids = self.encode_piece(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        pieces, get, out = self.find(text), self.pieces.get, []
        for p in pieces:
            ids = get(p)
            out += self._piece(p) if ids is None else ids
        return out

    def count(self, text: str) -> int:
        get, n = self.pieces.get, 0
        for p in self.find(text):
            ids = get(p)
            n += len(self._piece(p) if ids is None else ids)
        return n


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    """One encoder for each Python worker."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = Encoder(folder, name)
    return _ENCODERS[folder, name]


def encode_documents(documents, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """(doc_id, ids array<int>): the ids of every document, an empty list for null and empty texts.

    Blank texts have the ids of their blanks; a null doc_id stays null. No shuffle: each
    input partition is encoded where it is read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            texts = b.column("text")
            lists, sizes = [], np.zeros(b.num_rows, np.int64)
            flat: list[np.ndarray] = []
            for i, t in enumerate(texts.to_pylist()):
                if t:
                    ids = enc.encode(t)
                    sizes[i] = len(ids)
                    flat.append(np.array(ids, dtype=np.int32))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents, keep: list[str], folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The columns `keep` and n_tokens of every document; 0 for null and empty texts."""
    kept = documents.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            counts = pa.array([enc.count(t) if t else 0 for t in b.column("__text").to_pylist()], pa.int64())
            cols = {c: b.column(c) for c in keep} | {"n_tokens": counts}
            yield pa.RecordBatch.from_pydict(cols)

    return documents.selectExpr(*keep, "text as __text").mapInArrow(run, schema)
