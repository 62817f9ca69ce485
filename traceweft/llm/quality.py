"""Quality classifier: a byte-level convolutional network in numpy.

Sixteen learned filters over six bytes are laid at every second byte of a text. A chunk is 512 bytes and
chunks overlap by half, so that they cover the whole document; each filter keeps its greatest response in a
chunk. The chunks' responses are combined by their mean and by their maximum into one probability. A filter
is a table of its weights for each byte at each place, so a response is a sum of six table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.llm.samples import CHARS, LONGEST, ROWS, labelled
from traceweft.llm.words import buffer_of, pieces

FILTERS, WIDTH, STRIDE = 16, 6, 2
HALF = 256
#: Bytes convolved at a time.
PIECE = 1 << 17
PREDICTED = 0.7
#: Share of good documents that a score assumes; classes are sampled apart, so their numbers say nothing.
PRIOR = 0.6


class ByteConv:
    """tables[j, byte] are the filters' weights for a byte at place j; byte 0 pads and weighs nothing."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.tables[:, 0] = 0

    def padded(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts each filled up with zeros to whole half chunks, with room for a filter; and the halves' bounds."""
        length = np.diff(off)
        halves = (length + 8 + HALF - 1) // HALF
        first = np.concatenate([[0], np.cumsum(halves)])
        x = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
        for d in range(len(length)):
            x[first[d] * HALF : first[d] * HALF + length[d]] = buf[off[d] : off[d + 1]]
        return x, first

    def responses(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of every filter at every place in the halves from lo to hi: (halves, places, filters)."""
        a, n = lo * HALF, (hi - lo) * HALF
        r = self.tables[0][x[a : a + n : STRIDE]]
        for j in range(1, WIDTH):
            r += self.tables[j][x[a + j : a + j + n : STRIDE]]
        return r.reshape(hi - lo, HALF // STRIDE, FILTERS)

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right half of each chunk, and the first chunk of each text; a lone half is a chunk."""
        halves = np.diff(first)
        count = np.maximum(halves - 1, 1)
        start = np.concatenate([[0], np.cumsum(count)])
        left = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], count)
        right = np.minimum(left + 1, np.repeat(first[1:] - 1, count))
        return left, right, start

    def combined(self, pooled: np.ndarray, first: np.ndarray):
        left, right, start = self.chunks(first)
        m = np.maximum(np.maximum(pooled[left], pooled[right]) + self.bias, 0)
        mean = np.add.reduceat(m, start[:-1]) / np.diff(start)[:, None]
        most = np.maximum.reduceat(m, start[:-1])
        return np.concatenate([mean, most], axis=1), m, left, right, start

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros(0)
        x, first = self.padded(buf, off)
        n, step = int(first[-1]), PIECE // HALF
        pooled = np.concatenate([self.responses(x, lo, min(n, lo + step)).max(axis=1) for lo in range(0, n, step)])
        z = self.combined(pooled, first)[0].astype(np.float64) @ self.out + float(self.shift[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 11, least_steps: int = 600) -> ByteConv:
        """Training by Adam, in more epochs for a small sample. Some good texts also stand in cut short, as short ones are rare."""
        rng = np.random.default_rng(seed)
        short = [(x[a : a + int(2 ** rng.uniform(4, 8))], y) for x, y in zip(texts, labels) if y == 1 and len(x) > 64 and rng.random() < 0.3 for a in [int(rng.integers(0, len(x) - 32))]]
        texts, labels = [*texts, *(x for x, _ in short)], np.concatenate([labels, np.array([y for _, y in short], np.float32)])
        epochs = max(epochs, -(-least_steps * batch // max(1, len(texts))))
        params = [self.tables, self.bias, self.out, self.shift]
        moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
        weight = np.where(labels == 1, PRIOR / max(labels.mean(), 1e-9), (1 - PRIOR) / max(1 - labels.mean(), 1e-9))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
                x, first = self.padded(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), off)
                r = self.responses(x, 0, int(first[-1]))
                at = r.argmax(axis=1)
                pooled = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
                feats, m, left, right, start = self.combined(pooled, first)
                z = feats @ self.out + self.shift[0]
                g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = [None, None, feats.T @ g + 1e-4 * self.out, np.array([g.sum()], np.float32)]
                # back through the means and the maxima to chunks, then to the half that held each greatest response
                of = np.repeat(np.arange(len(pick)), np.diff(start))
                back = (g / np.diff(start))[of, None] * self.out[:FILTERS] + np.where(m == feats[of, FILTERS:], g[of, None] * self.out[FILTERS:], 0)
                back = np.where(m > 0, back, 0)
                grads[1] = back.sum(axis=0)
                half = np.where(pooled[left] >= pooled[right], left[:, None], right[:, None])
                f = np.broadcast_to(np.arange(FILTERS), half.shape)
                place = half * HALF + at[half, f] * STRIDE
                table = np.zeros((WIDTH, 256, FILTERS), np.float32)
                for j in range(WIDTH):
                    table[j] = np.bincount((x[place + j].astype(np.int64) * FILTERS + f).ravel(), weights=back.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                table[:, 0] = 0
                grads[0] = table
                step += 1
                now = rate * (1 - epoch / epochs)
                for p, grad, (one, two) in zip(params, grads, moments):
                    one += 0.1 * (grad - one)
                    two += 0.01 * (grad * grad - two)
                    p -= now * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        return self


def _scores(model: ByteConv):
    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(*buffer_of(b.column("text"))))], names=["doc_id", "score"])

    return run


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample_rows: int = ROWS, sample_longest: int = LONGEST, sample_chars: int = CHARS
) -> DataFrame:
    """Scores every whole text with a network fitted on a bounded sample of labelled rows that are not held out.

    The sample holds about ``sample_rows`` rows of ids that carry one label alone, no text of more than
    ``sample_longest`` characters, and ``sample_chars`` characters in all; see ``samples.labelled``.
    ``held_out`` is an expression over ``labels``' doc_id. Returns doc_id, held_out, score, predicted (1 if the
    score is 0.7 or more). A null text scores like an empty one; rows without a doc_id are not held out. If no
    row, or rows of one class only, can be learned from, the score is the same for all. Rows stand for
    themselves; an empty table gives an empty result; other columns are ignored.
    """
    texts, y = labelled(docs, labels.withColumnRenamed(doc_id, "doc_id"), label, F.coalesce(held_out, F.lit(False)), sample_rows, sample_longest, sample_chars, text, doc_id)
    model = ByteConv().fit([x.encode() for x in texts], np.array(y, np.float32)) if texts else ByteConv()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = base.mapInArrow(_scores(model), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
