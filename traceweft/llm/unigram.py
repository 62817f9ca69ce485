"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The pieces come from a model file that is read, never trained. Where its scores are merge ranks (a BPE
vocabulary), each is read as a log probability by Zipf's law: -log(rank + 1) less the log of the sum of all
1 / (rank + 1). Text is encoded as the library does: every space becomes the marker U+2581 and one marker is
put in front. Characters that no piece covers cost the least score minus 10 and come out as byte pieces; a
marker that stands in the text itself is always spelled in bytes, so that decoding gives back every text.

No piece has a marker after another character, and characters that are in no longer piece stand alone. Text
is cut at both, and between characters that no piece has in a row, which cannot change the best path; each
distinct part is solved once per worker while it remembers it.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweft.llm.words import pieces

MARK = "▁"
#: The library's penalty for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Distinct parts that a worker keeps solved.
SOLVED = 500_000


class DoubleArray:
    """Trie in two arrays: from state s byte c leads to t = base[s] + c + 1 if check[t] == s; value[t] is a piece or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        self.keys, self.ids = [keys[i] for i in order], [values[i] for i in order]
        size = 4 * sum(map(len, keys)) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.used, self.free = np.zeros(size, bool), 1
        self.used[0] = True
        todo = [(0, 0, len(self.keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(self.keys[lo]) == depth:
                self.value[state] = self.ids[lo]
                lo += 1
            children = []
            while lo < hi:
                c, at = self.keys[lo][depth], lo
                while lo < hi and self.keys[lo][depth] == c:
                    lo += 1
                children.append((c, at, lo))
            if children:
                base = self._place(np.array([c for c, _, _ in children]) + 1)
                self.base[state] = base
                for c, a, b in children:
                    self.check[base + c + 1] = state
                    todo.append((base + c + 1, a, b, depth + 1))
        last = int(np.flatnonzero(self.used)[-1]) + 258
        self.base, self.check, self.value = self.base[:last].copy(), self.check[:last].copy(), self.value[:last].copy()
        del self.keys, self.ids, self.used

    def _place(self, slots: np.ndarray) -> int:
        """The first base from the first free cell on where no child's cell is taken, 256 bases at a time."""
        while self.used[self.free]:
            self.free += 1
        base = max(1, self.free - int(slots[0]))
        while True:
            fits = ~self.used[base + np.arange(256)[:, None] + slots].any(axis=1)
            if fits.any():
                base += int(np.argmax(fits))
                self.used[base + slots] = True
                if len(slots) > 1 and base > self.free + 4096:  # cells far behind stay for later single children
                    self.free += 1024
                return base
            base += 256


@dataclass
class Model:
    """Pieces with log scores; byte_ids[b] is the piece of byte b."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray

    @staticmethod
    def load(path: str, ranks: bool = True) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][1:-1], 16)] = i
        normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        scores = np.array([sp.get_score(i) for i in range(n)])
        if ranks:
            place = np.zeros(n)
            place[normal] = np.argsort(np.argsort(-scores[normal], kind="stable"), kind="stable")
            scores = -np.log(place + 1) - math.log((1 / np.arange(1, normal.sum() + 1)).sum())
        if (byte_ids < 0).any():
            raise ValueError("the model has no piece for some byte, so it cannot spell every text")
        return Model(pieces, scores, byte_ids, normal)


class Codec:
    def __init__(self, model: Model):
        ids = [i for i in np.flatnonzero(model.normal) if model.pieces[i]]
        self.trie = DoubleArray([model.pieces[i].encode() for i in ids], [int(i) for i in ids])
        self.scores, self.unknown = model.scores.tolist(), float(model.scores[model.normal].min() - UNKNOWN_PENALTY)
        self.bytes = model.byte_ids.tolist()
        self.base, self.check, self.value = (x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
        inner = {c for i in ids if len(model.pieces[i]) > 1 for c in model.pieces[i]}
        late = any(re.search(f"[^{MARK}]{MARK}", model.pieces[i]) for i in ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        self.parts = re.compile("(?s).+" if late else f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bigrams = {model.pieces[i][k : k + 2] for i in ids for k in range(len(model.pieces[i]) - 1)}
        self.spell = np.full(len(model.pieces), -1, np.int64)
        self.spell[model.byte_ids] = np.arange(256)
        self.out = [bytes([self.spell[i]]) if self.spell[i] >= 0 else p.replace(MARK, " ").encode() if model.normal[i] else b"" for i, p in enumerate(model.pieces)]
        self.solved: dict[str, bytes] = {}

    def solve(self, part: str) -> bytes:
        """Ids of a part, put together from runs that no piece can cross: between them stand two characters that no piece has in a row."""
        a, out, bigrams, solved = 0, [], self.bigrams, self.solved
        for b in range(1, len(part) + 1):
            if b == len(part) or part[b - 1 : b + 1] not in bigrams:
                run = part[a:b]
                found = solved.get(run)
                if found is None:
                    found = np.array(self.best(run), np.int32).tobytes()
                    self.keep(run, found)
                out.append(found)
                a = b
        return b"".join(out)

    def keep(self, part: str, found: bytes) -> None:
        if len(part) <= 64:
            if len(self.solved) >= SOLVED:
                self.solved.clear()
            self.solved[part] = found

    def best(self, part: str) -> list[int]:
        """Viterbi: the path of highest score; of equal paths the one found first, longer last pieces first."""
        b = part.encode()
        n, base, check, value, scores = len(b), self.base, self.check, self.value, self.scores
        low = -1e300
        score, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        i = 0
        while i < n:
            width = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            here, single, s, j = score[i], False, 0, i
            while j < n:
                t = base[s] + b[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                if value[s] >= 0:
                    single = single or j == i + width
                    if here + scores[value[s]] > score[j]:
                        score[j], back[j], piece[j] = here + scores[value[s]], i, value[s]
            if not single and here + self.unknown > score[i + width]:
                score[i + width], back[i + width], piece[i + width] = here + self.unknown, i, -1
            i += width
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out.extend(self.bytes[x] for x in reversed(b[i:j]))
            j = i
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Piece ids; none for an empty text."""
        if not text:
            return np.zeros(0, np.int32)
        literal = MARK in text
        solved, out = self.solved, []
        for k, plain in enumerate(text.split(MARK)) if literal else ((0, text),):
            if k:
                out.append(np.array([self.bytes[x] for x in MARK.encode()], np.int32).tobytes())
            marked = plain.replace(" ", MARK)
            for part in self.parts.findall(marked if k else MARK + marked):
                found = solved.get(part)
                if found is None:
                    found = self.solve(part)
                    self.keep(part, found)
                out.append(found)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """Text of piece ids; the marker in front is dropped again."""
        out = b"".join([self.out[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def _coded(model: Model, digest: bool):
    def run(batches):
        codec = Codec(model)
        for b in pieces(batches):
            ids = [codec.encode(x or "") for x in b.column("text").to_pylist()]
            back = [codec.decode(x.tolist()) for x in ids]
            counts = pa.array([len(x) for x in ids], pa.int64())
            byte = pa.array([int((codec.spell[x] >= 0).sum()) for x in ids], pa.int64())
            if digest:
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                more = [sha(x.astype("<i4").tobytes() for x in ids), sha(x.encode() for x in back)]
            else:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                more = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))), pa.array(back, pa.string())]
            same = pa.array([(x or "") == y for x, y in zip(b.column("text").to_pylist(), back)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, byte, *more, same], names=["doc_id", "n_pieces", "n_bytes", "a", "b", "round_trip"])

    return run


def encoded(docs: DataFrame, model: Model, digest: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns doc_id, n_pieces, n_bytes (pieces that spell single bytes), round_trip, and either pieces (ids)
    with decoded, or with ``digest`` pieces_sha256 (of the ids as little-endian 32-bit integers) with
    decoded_sha256 (of the text in UTF-8). A null text counts as empty and has no pieces. Every row stands for
    itself, so repeated rows, null ids and other columns need no rule; an empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    a, b = ("pieces_sha256", "decoded_sha256") if digest else ("pieces", "decoded")
    out = base.mapInArrow(_coded(model, digest), f"doc_id {kind}, n_pieces long, n_bytes long, a {'string' if digest else 'array<int>'}, b string, round_trip boolean")
    return out.select("doc_id", "n_pieces", "n_bytes", F.col("a").alias(a), F.col("b").alias(b), "round_trip")
