"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 6 bytes of the word with a boundary on
either side, hashed into buckets) and of the word itself; a span of words is the mean of its words; and one
linear softmax over two classes reads the span. Spans of eight words, four apart, cover the whole document.
A document's log odds are the soft maximum over its spans, so a few words stand out of a long text; the
gradient reaches vectors and softmax through it alike. Unseen misspellings share n-grams with seen words.

As the model is linear in the vectors, scoring needs one number for each bucket, and sums them by word and
by span over whole batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.llm.samples import CHARS, LONGEST, ROWS, labelled
from traceweft.llm.words import PIECE, U, buffer_of, mix, odd_powers, pieces

GRAMS = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 8
SPAN, STEP = 8, 4
PREDICTED = 0.7
#: Share of toxic documents that a score assumes; classes are sampled apart, so their numbers say nothing.
PRIOR = 0.5
#: Sharpness of the soft maximum.
SHARP = 1.0
#: Vectors start from the log odds that the training documents suggest: DRIFT for each deviation above CLEAR between
#: how many documents with an n-gram are toxic and how many would be by chance. N-grams of fewer than LEAST documents say nothing.
DRIFT, CLEAR, LEAST = 2.0, 2.5, 2

#: ASCII marks that end a word; others stay, as misspellings use them.
_ENDS = b" \t\n\v\f\r.,;:?!\"()[]{}<>|/"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(_ENDS)] = 32
_POWERS = odd_powers(77, 8)


def _grams(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and of the whole of each word, and the word that each belongs to.

    x is folded text with a space before every word and behind it.
    """
    code = mix(x.astype(U) + U(3))
    buckets, owners = [], []
    for n in GRAMS:
        count = np.maximum(end - start + 2 - n + 1, 0)
        owner = np.repeat(np.arange(len(start)), count)
        at = np.repeat(start - 1 - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h = np.zeros(len(at), U)
        for k in range(n):
            h += code[at + k] * _POWERS[k]
        buckets.append((mix(h + U(n)) >> U(64 - 18)).astype(np.int64))
        owners.append(owner)
    length = end - start
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    spread = odd_powers(79, int(length.max()) if len(length) else 1)
    whole = np.add.reduceat(code[np.repeat(start, length) + inside] * spread[inside], np.cumsum(length) - length) if len(length) else np.zeros(0, U)
    buckets.append((mix(whole) >> U(64 - 18)).astype(np.int64))
    owners.append(np.arange(len(start)))
    return np.concatenate(buckets), np.concatenate(owners)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded text with a space between texts; start and end of its words; the first word of each text."""
    n = len(off) - 1
    x = np.full(len(buf) + n + 1, 32, np.uint8)
    x[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = _FOLD[buf]
    word = x != 32
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return x, start, end, np.searchsorted(start, off + np.arange(n + 1))


def _spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end word of each span and the first span of each text; a text without words has one empty span."""
    words = np.diff(first)
    count = np.maximum((np.maximum(words - SPAN, 0) + STEP - 1) // STEP + 1, 1)
    to = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(first[:-1], count) + (np.arange(to[-1]) - np.repeat(to[:-1], count)) * STEP
    return a, np.minimum(a + SPAN, np.repeat(first[1:], count)), to


def _soft_max(z: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's spans, and the weight of each span in it."""
    count = np.diff(to)
    top = np.maximum.reduceat(z, to[:-1])
    e = np.exp(SHARP * (z - np.repeat(top, count)))
    total = np.add.reduceat(e, to[:-1])
    share = e / np.repeat(total, count)
    return np.add.reduceat(share * z, to[:-1]), share


class SubwordBag:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = np.zeros((BUCKETS, DIM), np.float32)
        self.softmax = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.3, seed: int = 13, least_steps: int = 300) -> SubwordBag:
        """Joint training by AdaGrad, in more epochs for a small sample; a word's n-grams are found once for all of it."""
        epochs = max(epochs, -(-least_steps // max(1, len(texts) // batch)))
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        x, start, end, first = _words(np.frombuffer(b"".join(texts), np.uint8), off)
        seen: dict[bytes, int] = {}
        raw = x.tobytes()
        ids = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        each = np.full(sum(map(len, seen)) + len(seen) + 1, 32, np.uint8)
        size = np.array([len(w) for w in seen], np.int64)
        s = np.cumsum(size + 1) - size
        each[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(seen) + 1), size)] = np.frombuffer(b"".join(seen), np.uint8)
        buckets, owners = _grams(each, s, s + size)
        order = np.argsort(owners, kind="stable")
        buckets, grams = buckets[order], np.bincount(owners, minlength=len(seen))
        begin = np.cumsum(grams) - grams
        known = self._start(labels, [self._buckets(np.unique(ids[a:b]), begin, grams, buckets)[0] for a, b in zip(first[:-1], first[1:])])
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, PRIOR / max(labels.mean(), 1e-9), (1 - PRIOR) / max(1 - labels.mean(), 1e-9))
        past, past_softmax, past_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
        for epoch in range(epochs):
            for pick in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
                counts = first[pick + 1] - first[pick]
                mine = np.concatenate([[0], np.cumsum(counts)])
                tokens, word = np.unique(np.concatenate([ids[first[d] : first[d + 1]] for d in pick]), return_inverse=True)
                used, g = self._buckets(tokens, begin, grams, buckets)
                vec = np.add.reduceat(self.vectors[used], np.cumsum(g) - g) / g[:, None] if len(tokens) else np.zeros((0, DIM), np.float32)
                a, b, to = _spans(mine)
                n = np.maximum(b - a, 1)
                sums = np.concatenate([np.zeros((1, DIM)), np.cumsum(vec[word], axis=0)]) if len(word) else np.zeros((1, DIM))
                mean = (sums[b] - sums[a]) / n[:, None]
                logit = mean @ self.softmax + self.bias
                z, share = _soft_max(logit[:, 1] - logit[:, 0], to)
                err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) * weight[pick] / len(pick)
                dz = np.repeat(err, np.diff(to)) * share
                d = self.softmax[:, 1] - self.softmax[:, 0]
                gs = mean.T @ dz
                gsoft, gbias = np.stack([-gs, gs], axis=1), np.array([-dz.sum(), dz.sum()])
                # a span's gradient goes to its words in equal parts, a word's to its n-grams
                edge = np.zeros(len(word) + 1)
                np.add.at(edge, a, dz / n)
                np.add.at(edge, b, -dz / n)
                own = np.bincount(word, weights=np.cumsum(edge)[:-1], minlength=len(tokens)) / np.maximum(g, 1)
                gram = np.bincount(used, weights=np.repeat(own, g), minlength=BUCKETS)
                hit = np.flatnonzero((gram != 0) & known)
                step = gram[hit, None] * d[None, :]
                past[hit] += (step * step).mean(axis=1)
                self.vectors[hit] -= rate * (1 - epoch / epochs) * step / np.sqrt(past[hit])[:, None]
                past_softmax += gsoft * gsoft
                past_bias += gbias * gbias
                self.softmax -= (0.3 * rate * gsoft / np.sqrt(past_softmax)).astype(np.float32)
                self.bias -= (0.3 * rate * gbias / np.sqrt(past_bias)).astype(np.float32)
        return self

    @staticmethod
    def _buckets(tokens: np.ndarray, begin: np.ndarray, grams: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, one word's after another's, and how many each has."""
        g = grams[tokens]
        return buckets[np.repeat(begin[tokens] - (np.cumsum(g) - g), g) + np.arange(int(g.sum()))], g

    def _start(self, labels: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
        """Sets the vectors to what the documents' buckets say by themselves; which buckets are known well enough to learn."""
        seen, toxic, share = np.zeros(BUCKETS), np.zeros(BUCKETS), labels.mean()
        for buckets, y in zip(map(np.unique, of), labels):
            seen[buckets] += 1
            toxic[buckets] += y
        known = seen >= LEAST
        z = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        odds = np.where(known, DRIFT * np.sign(z) * np.maximum(np.abs(z) - CLEAR, 0), 0) if 0 < share < 1 else np.zeros(BUCKETS)
        d = self.softmax[:, 1] - self.softmax[:, 0]
        self.vectors += (odds[:, None] * d[None, :] / (d @ d)).astype(np.float32)
        return known

    def folded(self) -> tuple[np.ndarray, float]:
        """The log odds that each bucket adds, and those of an empty span."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score(table: np.ndarray, bias: float, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of each text."""
    if len(off) < 2:
        return np.zeros(0)
    x, start, end, first = _words(buf, off)
    odds = np.zeros(len(start))
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE // 4)))
        a = start[lo]
        buckets, owner = _grams(x[a - 1 : end[hi - 1] + 1], start[lo:hi] - a + 1, end[lo:hi] - a + 1)
        n = np.bincount(owner, minlength=hi - lo)
        odds[lo:hi] = np.bincount(owner, weights=table[buckets], minlength=hi - lo) / n
        lo = hi
    sums = np.concatenate([[0], np.cumsum(odds)])
    a, b, to = _spans(first)
    z, _ = _soft_max((sums[b] - sums[a]) / np.maximum(b - a, 1) + bias, to)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scores(table: np.ndarray, bias: float):
    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(table, bias, *buffer_of(b.column("text"))))], names=["doc_id", "score"])

    return run


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", sample_rows: int = ROWS, sample_longest: int = LONGEST, sample_chars: int = CHARS
) -> DataFrame:
    """Scores every whole text with a model fitted on a bounded sample of labelled rows that are not held out.

    The sample holds about ``sample_rows`` rows of ids that carry one label alone, no text of more than
    ``sample_longest`` characters, and ``sample_chars`` characters in all; see ``samples.labelled``.
    ``held_out`` is an expression over ``labels``' doc_id. Returns doc_id, held_out, score, predicted (1 if the
    score is 0.7 or more). A null, empty or wordless text gets the score of an empty span; rows without a doc_id
    are not held out. If no row, or rows of one class only, can be learned from, scores carry no meaning but
    stay within 0 and 1. Rows stand for themselves; an empty table gives an empty result; other columns are ignored.
    """
    texts, y = labelled(docs, labels.withColumnRenamed(doc_id, "doc_id"), label, F.coalesce(held_out, F.lit(False)), sample_rows, sample_longest, sample_chars, text, doc_id)
    model = SubwordBag().fit([x.encode() for x in texts], np.array(y, np.float64)) if texts else SubwordBag()
    table, bias = model.folded()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = base.mapInArrow(_scores(table, bias), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
