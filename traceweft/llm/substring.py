"""Substring de-duplication: passages of 50 words or more that an earlier document holds are removed.

A difference cover D modulo a period v has, for any two positions i and j, a shift s < v with both i + s
and j + s in D modulo v. So it is enough to hash the windows that start at cover positions: two equal runs
of 50 words share such an aligned anchor of 50 - v + 1 words, wherever they stand. Anchors that occur in
more than one document then extend: every 50-word window around one is hashed in full (96 bits), and a
window goes if it also starts in a document with a smaller doc_id.

Documents with the same words form one class whose copies go whole, without anchors of their own. All
counting is by key with map-side combining. Positions meet their counts in joins of two kept tables, the one
shape in which Spark splits the rows of a hot key over several tasks, and only positions of one document are
ever gathered together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweft.llm.beside import split
from traceweft.llm.durable import Tables
from traceweft.llm.words import U, Words, pieces, sequence_hash, windows, words_of

LENGTH = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = LENGTH - PERIOD + 1


def _anchors(batches):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for b in pieces(batches):
        w = words_of(b.column("text"), hashes=2)
        every = windows(w.h[0], ANCHOR, 7).view(np.int64)
        counts, seqs, shas, lists = [], [], [], []
        for d in range(len(w.first) - 1):
            a, z = int(w.first[d]), int(w.first[d + 1])
            counts.append(z - a)
            seqs.append(sequence_hash([h[a:z] for h in w.h]))
            shas.append(hashlib.sha256(_joined(w, np.arange(a, z))).hexdigest())
            at = np.arange(max(0, z - a - ANCHOR + 1)) if z - a >= LENGTH else np.arange(0)
            lists.append(every[a + at[cover[at % PERIOD]]])
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        rest = [b.column(i) for i, name in enumerate(b.schema.names) if name in ("row", "text") and "row" in b.schema.names]
        yield pa.RecordBatch.from_arrays(
            [*rest, b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(seqs, pa.binary()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(ends, pa.array(flat))],
            names=[*(["row", "text"] if rest else []), "doc_id", "n_words", "seq", "sha", "anchors"],
        )


def _joined(w: Words, keep: np.ndarray) -> bytes:
    """The given words joined by single spaces."""
    if not len(keep):
        return b""
    start, length = w.start[keep], w.end[keep] - w.start[keep]
    to = np.cumsum(length + 1) - length - 1
    out = np.full(int(to[-1] + length[-1]), 32, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + inside] = w.buf[np.repeat(start, length) + inside]
    return out.tobytes()


def _positions(of: list[int]) -> np.ndarray:
    """Word positions of the anchors with these places in a document's list of anchors."""
    k = np.asarray(of, np.int64)
    return k // len(COVER) * PERIOD + np.array(COVER)[k % len(COVER)]


def _windows(batches):
    """Full windows around each shared anchor of a document."""
    for b in pieces(batches):
        w = words_of(b.column("text"), hashes=2)
        one, two = windows(w.h[0], LENGTH, 13).view(np.int64), (windows(w.h[1], LENGTH, 17) >> U(32)).astype(np.uint32).view(np.int32)
        seqs, places = b.column("seq").to_pylist(), b.column("places").to_pylist()
        rows, starts = [], []
        for d in range(len(w.first) - 1):
            a, z = int(w.first[d]), int(w.first[d + 1])
            if sequence_hash([h[a:z] for h in w.h]) != seqs[d]:
                continue
            p = _positions(places[d])
            mark = np.zeros(z - a + 1, np.int64)
            np.add.at(mark, np.maximum(p + ANCHOR - LENGTH, 0), 1)
            np.add.at(mark, p + 1, -1)
            at = np.flatnonzero(np.cumsum(mark)[: max(0, z - a - LENGTH + 1)] > 0)
            rows.append(np.full(len(at), d))
            starts.append(at)
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        for lo in range(0, len(r), 1 << 16):
            i, p = r[lo : lo + (1 << 16)].astype(np.int64), s[lo : lo + (1 << 16)]
            at = w.first[i] + p
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[at]), pa.array(two[at]), b.column("doc_id").take(pa.array(i)), b.column("uid").take(pa.array(i)), pa.array(p.astype(np.int32))],
                names=["h", "g", "doc_id", "uid", "start"],
            )


def _cut(batches):
    """Words left of each document, once as their digest and once as text with the white space behind each kept word."""
    for b in pieces(batches):
        w = words_of(b.column("text"), hashes=2)
        seqs, starts = b.column("seq").to_pylist(), b.column("starts").to_pylist()
        rows, removed, shas, texts = [], [], [], []
        for d in range(len(w.first) - 1):
            a, z = int(w.first[d]), int(w.first[d + 1])
            if sequence_hash([h[a:z] for h in w.h]) != seqs[d]:
                continue
            s = np.asarray(starts[d], np.int64)
            mark = np.zeros(z - a + 1, np.int64)
            np.add.at(mark, s, 1)
            np.add.at(mark, s + LENGTH, -1)
            left = np.flatnonzero(np.cumsum(mark)[:-1] == 0) + a
            rows.append(d)
            removed.append(z - a - len(left))
            shas.append(hashlib.sha256(_joined(w, left)).hexdigest())
            upto = np.append(w.start[a + 1 : z], w.end[z - 1] if z > a else 0)
            runs = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1) if len(left) else []
            texts.append(b"".join(w.buf[w.start[r[0]] : upto[r[-1] - a]].tobytes() for r in runs).decode())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(take), b.column("seq").take(take), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "seq", "n_removed", "kept_sha256", "kept_text"],
        )


EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows_too: bool = False) -> DataFrame:
    """Removes each word in a 50-word window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 for each input row, and with ``rows_too`` also row (the
    input row) and kept_text: the text without the removed words and the white space behind them, null where
    nothing was removed. Windows are judged on the input. A null text has no words. Rows that repeat a doc_id
    never remove each other's words; a row without a doc_id neither removes nor loses words. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    t = Tables(spark, "substring")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scan = "doc_id long, n_words long, seq binary, sha string, anchors array<long>"
    scanned = base.mapInArrow(_anchors, scan)
    if rows_too:
        rest, again = split(docs, text, "text")
        whole = docs.select(rest, F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
        seen = whole.mapInArrow(_anchors, f"row {whole.schema['row'].dataType.simpleString()}, text string, {scan}")
        seen = seen.select(again, "doc_id", "n_words", "seq", "sha")
    else:
        seen = scanned.select("doc_id", "n_words", "seq", "sha")
    # one row for each sequence of words: that of its least doc_id
    first = scanned.where(f"doc_id is not null and n_words >= {LENGTH}").groupBy("seq").agg(F.min_by("anchors", "doc_id").alias("anchors"), F.min("doc_id").alias("doc_id"))
    first = t.keep("first", first.withColumn("uid", F.monotonically_increasing_id()))
    anchor = first.select("doc_id", "uid", F.posexplode("anchors").alias("place", "h"))
    shared = t.keep("shared", anchor.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
    t.settle()
    places = t.keep("places", anchor.select("uid", "place", "h").join(shared, "h").groupBy("uid").agg(F.collect_list("place").alias("places")))
    t.drop("shared")
    t.settle()
    hit = first.select("uid", "doc_id", "seq").join(places, "uid")
    met = t.keep("met", base.join(hit, "doc_id"))
    t.settle()
    window = t.keep("windows", met.mapInArrow(_windows, "h long, g int, doc_id long, uid long, start int"))
    earlier = t.keep("earlier", window.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h", "g", "a"))
    t.settle()
    starts = t.keep("starts", window.join(earlier, ["h", "g"]).where("a < doc_id").groupBy("uid").agg(F.collect_list("start").alias("starts")))
    t.drop("windows", "earlier")
    t.settle()
    cut = met.select("doc_id", "seq", "uid", "text").join(starts, "uid").mapInArrow(_cut, "doc_id long, seq binary, n_removed long, kept_sha256 string, kept_text string")
    cut = t.keep("cut", cut.dropDuplicates(["seq"]))
    found = t.keep("found", first.select("seq", F.col("doc_id").alias("least")).join(cut.drop("doc_id"), "seq", "left"))
    t.drop("met", "starts", "places", "first", "cut")
    t.settle()
    done = seen.join(found, "seq", "left")  # the texts are read once more for this
    copy, own = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)), F.coalesce(F.col("least") == F.col("doc_id"), F.lit(False))
    cols = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.when(own, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha"))).alias("kept_sha256"),
    ]
    return done.select(*cols, *([F.when(copy, F.lit("")).when(own, F.col("kept_text")).alias("kept_text"), "row"] if rows_too else []))
