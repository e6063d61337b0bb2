"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to machines. ``Normaliser``: states "start" and
"body"; the start writes the dummy prefix, and arcs of the body rewrite spaces.
``Pieces``: a trie whose states are prefixes of pieces, with arcs for their
characters and, at the end of a piece, an arc back to the root that writes its
id; the fallback has an arc from the root for every character that is no piece,
writing its UTF-8 bytes as byte pieces (<unk> without them). ``weight``: a
machine whose states are the last piece. For unigram models a piece's arc
weighs its negative score, whatever came before. For byte-pair models the
weight sits on pairs of neighbours: 0 where merging leaves the two pieces as
they are when they stand side by side, infinite where it would merge across or
inside them. Composition with an input is made as the path is searched: a
state is a position and the last piece, and the path of least weight in the
tropical semiring (sums along a path, minimum over paths) is the encoding.

Why this is exact for byte pairs. Merging always takes the best pair, leftmost among equals,
and what it does inside two neighbouring pieces doesn't depend on the text
around them until something merges across their edges. So a sequence of pieces
is the result of merging if, and only if, each two neighbours are the result
of merging their own text. Only one path has a finite weight, for each prefix
too, so a position has one state of finite weight at most.

The lattice falls apart wherever no piece can span a position. The compiler
reads from the vocabulary which two characters stand side by side in a piece;
texts are cut between all others (so before the space marks of words, and
mostly before punctuation), and the paths of these segments are kept in
bounded tables of each Python worker.

Decoding concatenates the pieces' bytes, unescapes the space mark and takes
off the dummy prefix.

Scale. One narrow pass, no shuffle. Time is linear in the text, memory bounded
by the longest document and tables of ``CACHE`` words, ``CACHE`` segments and
``PAIRS`` weights (the former two in two generations).

Edge cases. Null and empty texts have no ids and decode to the empty text.
A text's own U+2581 is read as a space mark (so it decodes to a space, as with
the sentencepiece library); ``round_trip`` says whether the text came back.
Repeated rows and null doc_ids give a row each. Other columns are not read by
the query and pass through ``encode_documents``, which replaces an input's own
ids, decoded and round_trip.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import operator
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, per_document, raw, schema_of, table

SPACE = "▁"
CACHE = 150_000
#: Pair weights kept; about 70 bytes each.
PAIRS = 600_000
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = 4 if wire == 5 else 8
            yield number, data[at : at + size]
            at += size


class Normaliser:
    """Two states: the start, which writes ``prefix`` before any text, and the body, whose arcs rewrite characters (others as they are)."""

    def __init__(self, prefix: str, arcs: dict[str, str]):
        self.prefix, self.table = prefix, str.maketrans(arcs)

    def __call__(self, text: str) -> str:
        """What the one path of the text writes."""
        return (self.prefix + text).translate(self.table) if text else ""


class Pieces:
    """The trie of the pieces: ``arcs[state]`` by character, ``final[state]`` the id of the piece that ends there (-1: none)."""

    def __init__(self, ids: dict[str, int]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [-1]
        for piece, k in ids.items():
            state = 0
            for c in piece:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = self.arcs[state][c]
            self.final[state] = k


class Transducer:
    """A byte-pair or unigram model compiled for encoding and decoding."""

    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    x = dict(fields(value))
                    pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(fields(value))
                elif number == 3:
                    rules = dict(fields(value))
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and byte-pair-encoding models are supported")
        self.unigram = trainer.get(3, 1) == 1
        if rules.get(2):
            raise ValueError("models with a character map in their normaliser are not supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.trim or not self.escape:
            raise ValueError("only models that keep and escape white space are supported")
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.normalised = Normaliser(" " if self.dummy_prefix else "", {" ": SPACE})
        self.pieces = Pieces(self.id)
        #: What arcs weigh: of a unigram model's pieces, and of a character that is none.
        self.cost = [-s for _, s, _ in pieces] if self.unigram else None
        self.unknown_cost = 10 - min(self.score.values(), default=0.0)
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        #: Byte pairs, and each character of a piece is a piece: then a position has one state of finite weight.
        self.single = not self.unigram and all(c in self.id for c in set().union(*self.id))
        #: What each id writes when decoded: control pieces nothing, the unknown piece its usual mark.
        self.text = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.free: dict[int, bool] = {}
        self.size, self.names = len(pieces), [p for p, _, _ in pieces]
        self.spines: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        #: Pairs of characters within pieces. Without byte fallback runs of unknown characters must stay together.
        self.spanned = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)} if self.bytes else _Any()
        self.stems = Memo(CACHE)
        #: Whether words and lines can be looked up alone; ids by word, for words behind one space mark or line feed.
        self.wordwise = self.separable and bool(self.bytes) and not any("\n" in p for p in self.id)
        self.words = Memo(CACHE)

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union has the best score, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def spine(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """The parts of a piece that lie at its left (side 0) or right edge as it is merged, smallest first.

        Each with the score of the merge that ends it; the piece itself with
        -inf. None if scores don't fall from merge to merge, as among runs of
        space marks, which all have one score.
        """
        found = self.spines.get((piece, side), 0)
        if found == 0:
            parts, merges = list(piece), []
            while len(parts) > 1:
                best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                merges.append((best[0], k + 1 == len(parts) - 1 if side else k == 0, parts[k + side]))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1 or any(x[0] <= y[0] for x, y in itertools.pairwise(merges)):
                found = None
            else:
                found = [(part, score) for score, edge, part in merges if edge] + [(piece, -math.inf)]
            self.spines[piece, side] = found
        return found

    def weight(self, a: str, b: str) -> bool:
        """Whether the pair's weight is 0 and not infinite; with b empty, that of a at the start.

        The two pieces are merged side by side, looking at their touching
        edges only: whichever is best of the merge across and the next merges
        at the two edges comes first.
        """
        left, right = self.spine(a, 1), self.spine(b, 0) if b else None
        if left is None or right is None:
            got = self.merged(a + b) == ([a, b] if b else [a])
        else:
            i = j = 0
            while True:
                (x, s), (y, t) = left[i], right[j]
                across = self.score.get(x + y)
                if across is not None and across > s and across >= t:
                    got = False
                    break
                if s == t == -math.inf:
                    got = True
                    break
                if s >= t:
                    i += 1
                else:
                    j += 1
        return got

    def step(self, before: int, piece: int) -> float:
        """The weight of the arc of a piece after the piece ``before`` (ids); -1: nothing, or a character that is no piece."""
        if self.cost is not None:
            return self.cost[piece] if piece >= 0 else self.unknown_cost
        if piece < 0:  # no merge takes such a character, and whatever follows it starts afresh
            return 0.0
        key = (before + 1) * self.size + piece
        got = self.free.get(key)
        if got is None:
            if len(self.free) >= PAIRS:
                self.free.clear()
            stays = self.weight(self.names[before], self.names[piece]) if before >= 0 else self.weight(self.names[piece], "")
            got = self.free[key] = 0.0 if stays else math.inf
        return got

    def path(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id or -1) of the arcs of the least-weight path through the composition with ``text``.

        best[j]: by last piece, the least weight of a path to (j, last), and where it came from. With
        byte pairs a position that has a state is done, as it has no other of finite weight.
        """
        if self.single:
            return self.only_path(text)
        step, arcs, final, root = self.step, self.pieces.arcs, self.pieces.final, self.pieces.arcs[0]
        pairs, free, size, n = self.cost is None, self.free, self.size, len(text)
        best: list[dict[int, tuple[float, int, int, int]]] = [{-1: (0.0, -1, -1, -1)}, *({} for _ in range(n))]
        for i in range(n):
            here = best[i]
            if not here:
                continue
            state, j = root.get(text[i]), i + 1
            if state is None or final[state] < 0:  # the fallback's arc
                for before, (weight, *_) in here.items():
                    total = weight + step(before, -1)
                    if -1 not in best[j] or total < best[j][-1][0]:
                        best[j][-1] = (total, i, before, -1)
            while state is not None:
                piece = final[state]
                if piece >= 0 and not (pairs and best[j]):
                    for before, (weight, *_) in here.items():
                        if pairs:
                            got = free.get((before + 1) * size + piece)
                            if got is None:
                                got = step(before, piece)
                            if got == 0.0:
                                best[j][piece] = (weight, i, before, piece)
                        else:  # these weights don't ask what came before
                            total = weight + step(before, piece)
                            if -1 not in best[j] or total < best[j][-1][0]:
                                best[j][-1] = (total, i, before, piece)
                if j == n:
                    break
                state = arcs[state].get(text[j])
                j += 1
        out, at = [], n
        last = min(best[at], key=lambda k: (best[at][k][0], k), default=-1)
        while at:
            _, start, before, piece = best[at][last]
            out.append((start, at, piece))
            at, last = start, before
        return out[::-1]

    def only_path(self, text: str) -> list[tuple[int, int, int]]:
        """``path`` where all finite weights are 0 and a position has one state at most.

        All states reached have the least weight, so they may be followed in any order: here the newest
        first, by its longest arc. A path that meets the end is the least one, and the search is over.
        """
        step, arcs, final, root, free, size, n = self.step, self.pieces.arcs, self.pieces.final, self.pieces.arcs[0], self.free, self.size, len(text)
        start, last = [-1] * (n + 1), [-2] * (n + 1)
        at, arrivals = 0, []
        last[0] = -1
        while at < n:
            j, state = at + 1, root.get(text[at])
            if state is None:  # the fallback's arc; no piece spans such a character
                arrivals.append((at, j, -1))
            while state is not None:
                if final[state] >= 0 and last[j] == -2:
                    arrivals.append((at, j, final[state]))
                if j == n:
                    break
                state = arcs[state].get(text[j])
                j += 1
            while True:
                i, at, piece = arrivals.pop()
                if last[at] != -2:
                    continue
                before = last[i]
                got = 0.0 if piece < 0 else free.get((before + 1) * size + piece)
                if got is None:
                    got = step(before, piece)
                if got == 0.0:
                    start[at], last[at] = i, piece
                    break
        out = []
        while at:
            out.append((start[at], at, last[at]))
            at = start[at]
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        """Ids of one normalised segment, with byte fallback."""
        out: list[int] = []
        for start, end, piece in self.path(text):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in text[start:end].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segment(self, text: str) -> bytes:
        """Ids of a piece of normalised text, cut further wherever no piece of the vocabulary spans two characters."""
        spanned, stems, out, at = self.spanned, self.stems, [], 0
        for k in [*(k for k, pair in enumerate(map(operator.add, text, text[1:]), 1) if pair not in spanned), len(text)]:
            stem = text[at:k]
            got = stems.find(stem)
            if got is None:
                ids = self.ids(stem)
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(stem) < 64:
                    stems.put(stem, got)
            out.append(got)
            at = k
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        if self.dummy_prefix and self.wordwise and text and text[0] != " " and "  " not in text and SPACE not in text:
            words, spaced = self.words, text.replace("\n", " \n").split(" ")
            got = list(map(words.young.get, spaced))
            if None in got:
                for k, (word, x) in enumerate(zip(spaced, got, strict=True)):
                    if x is None and (x := words.find(word)) is None:
                        x = self.segment(word if word[:1] == "\n" else SPACE + word)
                        if len(word) < 64:
                            words.put(word, x)
                    got[k] = x
            return np.frombuffer(b"".join(got), "<u4")
        parts = self.normalised(text)
        return np.frombuffer(b"".join(map(self.segment, segments(parts) if self.separable else [parts] if parts else [])), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def segments(text: str) -> list[str]:
    """Cuts before each run of space marks that follows another character."""
    words = text.split(SPACE)
    if "" not in words[1:]:
        return [*words[:1], *(SPACE + w for w in words[1:])] if words[0] else [SPACE + w for w in words[1:]]
    out, marks = [words[0]] if words[0] else [], 0
    for w in words[1:]:
        marks += 1
        if w:
            out.append(SPACE * marks + w)
            marks = 0
    return [*out, SPACE * marks] if marks else out


class _Any(frozenset):
    def __contains__(self, x: object) -> bool:
        return True


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The model at ``path``, compiled once in each Python worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int), decoded (text) and round_trip."""
    path = path or model_path()
    docs = docs.drop("ids", "decoded", "round_trip")
    names = docs.columns
    at = names.index("text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        model = transducer(path)
        texts = [t.decode("utf-8", "replace") for t in raw(b.column(at))]
        ids = [model.encode(t) for t in texts]
        back = [model.decode(x) for x in ids]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.record_batch([*b.columns, lists, pa.array(back), pa.array([x == y for x, y in zip(texts, back, strict=True)])], [*names, "ids", "decoded", "round_trip"])

    return per_document(docs, names, schema_of(docs, "ids array<int>, decoded string, round_trip boolean"), work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip."""
    path = model_path()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        model = transducer(path)
        n, crc, sha, same = [], [], [], []
        for t in raw(b.column(1)):
            text = t.decode("utf-8", "replace")
            got = model.encode(text)
            back = model.decode(got)
            n.append(len(got))
            crc.append(zlib.crc32(got))
            sha.append(hashlib.sha256(back.encode()).hexdigest())
            same.append(back == text)
        return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    docs = table(spark, sf_dir, "documents")
    return per_document(docs, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean", work)
