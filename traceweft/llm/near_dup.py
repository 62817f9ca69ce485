"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

Every text becomes the set of its distinct 5-word shingles. Texts with the same set form one class, so
copies cost one row each and never meet in pairs. The sets of classes are sketched by one hash of each
shingle: its high bits choose one of ``bands * rows`` bins, the least value stays, and an empty bin
borrows from a donor that depends on the bin alone (optimal densification). Classes that agree in all
rows of a band share a bucket. In a bucket a star links its first member with all others, and each
candidate edge is confirmed on the full sets; stars bound the pairs where copies abound.

Members that the stars leave in different components are compared with each other in a second round, so no
link is lost: in small buckets all of them, in crowded ones those pairs that a prefix filter cannot rule
out. For that the shingles of crowded classes are ordered from rare to common; two sets as similar as asked
share one of their first few, and the place of the first shared one bounds what they have in common. Under
each key only members outside its largest component look for partners, so a large group that is one component
already costs nothing. Classes whose shingles are the least their own stand nearest to what a group copies,
and are the centres of its stars.

A link between sets of more than 64 shingles is missed by chance of the sketch alone, at a rate of about 1e-6
at the threshold and less above it; between smaller sets none is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceweft.llm.beside import split
from traceweft.llm.components import components
from traceweft.llm.durable import Tables
from traceweft.llm.words import U, mix, pieces, set_hash, windows, words_of

WIDTH = 5
#: Buckets of this many classes or more are crowded.
CROWD = 16
#: Bytes of texts that Python takes at a time.
TEXTS = 1 << 20
#: Sets of at most this many shingles also stand in buckets of their least hashes, where no link of theirs can be missed:
#: densified bins of few shingles are no independent draws.
SMALL = 80


def shape(percent: int, bins: int = 252, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): most rows such that a pair at the threshold is missed at most this often."""
    for rows in range(12, 0, -1):
        if (1 - (percent / 100) ** rows) ** (bins // rows) <= miss:
            return bins // rows, rows
    return bins, 1


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes; fewer words than a shingle: the whole sequence as one."""
    w = words_of(column, lower=True)
    h = w.h[0]
    every = windows(h, WIDTH, 5)
    out = []
    for d in range(len(w.first) - 1):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b - a >= WIDTH:
            out.append(np.unique(every[a : b - WIDTH + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a, 5) + U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


class Sketch:
    """One-permutation sketch with optimal densification, and the keys of its bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        k = np.arange(self.bins, dtype=U)
        tries = np.arange(1, 257, dtype=U)
        self.donors = (mix(k[None, :] * U(0x9E3779B97F4A7C15) + mix(tries)[:, None]) % U(self.bins)).astype(np.int64)
        self.multipliers = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
        self.salts = mix(np.arange(1001, 1001 + bands, dtype=U))

    def signature(self, values: np.ndarray) -> np.ndarray:
        none = U(0xFFFFFFFFFFFFFFFF)
        sig = np.full(self.bins, none, U)
        if len(values) == 1:
            sig[:] = values[0]
            return sig
        at = ((values >> U(32)) * U(self.bins) >> U(32)).astype(np.int64)
        np.minimum.at(sig, at, mix(values))
        full = np.zeros(self.bins, bool)
        full[at] = True
        empty = np.flatnonzero(~full)
        for donors in self.donors:
            if not len(empty):
                return sig
            d = donors[empty]
            has = full[d]
            sig[empty[has]] = sig[d[has]]
            empty = empty[~has]
        if len(empty):  # so few full bins that no donor was met: the full bin next in a fixed cycle
            filled = np.flatnonzero(full)
            sig[empty] = sig[filled[np.searchsorted(filled, empty) % len(filled)]]
        return sig

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        x = signatures.reshape(len(signatures), self.bands, self.rows) * self.multipliers
        return mix(x.sum(axis=2, dtype=U) + self.salts).view(np.int64)


def prefix(values: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set: of two sets as similar as asked each shares one of the other's."""
    n = len(values)
    return np.sort(mix(values))[: n - -(-percent * n // 100) + 1]


def _sketcher(bands: int, rows: int, percent: int):
    def run(batches):
        sketch = Sketch(bands, rows)
        for b in pieces(batches, TEXTS):
            sets = shingle_sets(b.column("text"))
            sig = np.zeros((len(sets), sketch.bins), U)
            for i, s in enumerate(sets):
                if len(s):
                    sig[i] = sketch.signature(s)
            keys = sketch.keys(sig)
            each = [np.concatenate([k, prefix(s, percent).view(np.int64)]) if 0 < len(s) <= SMALL else k for k, s in zip(keys, sets)]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    b.column("body"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*each, np.zeros(0, np.int64)]))),
                ],
                names=["doc_id", "body", "n_shingles", "cls", "keys"],
            )

    return run


def _classes(batches):
    """The class of each row, beside the text and the rest of the row."""
    for b in pieces(batches, TEXTS):
        sets = shingle_sets(b.column("text"))
        cls = pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), cls, b.column("text"), b.column("row")], names=["doc_id", "n_shingles", "cls", "text", "row"])


def _sets(batches):
    for b in pieces(batches, TEXTS):
        sets, cls = shingle_sets(b.column("text")), b.column("cls").to_pylist()
        same = [i for i, s in enumerate(sets) if set_hash(s) == cls[i]]
        flat = np.concatenate([sets[i] for i in same] or [np.zeros(0, U)]).view(np.int64)
        ends = np.cumsum([0, *(len(sets[i]) for i in same)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in same], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["cls", "shingles"])


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Groups documents linked by chains of pairs with 100 * |A & B| >= percent * |A | B|.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id),
    one row for each input row. A null or wordless text has an empty set and stands alone. Rows that repeat
    a doc_id are compared as they are; rows without a doc_id take part, but have the id null and aren't kept
    unless their text is empty. Other columns of the input are ignored, whatever their names. An empty table
    gives an empty result.
    """
    seen, least = _grouped(docs, percent, text, doc_id)
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.col("cls").isNull(), F.lit(False))
    return seen.drop("keys", "body").join(least, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input rows that stay when each group of near duplicates keeps one: a row of the least doc_id.

    Groups are those of ``near_duplicates``. A group none of whose rows has a doc_id keeps one of them; where
    the row that stays is repeated, one copy does. Rows with an empty set all stay. Columns are the input's.
    """
    _, least = _grouped(docs, percent, text, doc_id)
    known = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]  # plain keys: the join's partitions serve the grouping
    leads = least.where("cls = lead").withColumnRenamed("component_id", "doc_id").select("cls", *known)
    # rows meet their class again from the texts themselves; a table of whole texts would take the disk of the input
    body = F.col(text).cast("string")
    worded = F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest, again = split(docs, text, "text")
    whole = docs.where(worded).select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), rest)
    found = whole.mapInArrow(_classes, f"doc_id long, n_shingles long, cls binary, text string, row {whole.schema['row'].dataType.simpleString()}")
    # the id is part of the key, so that copies of one hot text spread
    met = found.select("cls", again, *known).join(leads, ["cls", "none", "id"])
    one = met.groupBy("cls", "none", "id").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(docs.where(~worded))


def _grouped(docs: DataFrame, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, cls, keys), and for each class its component_id and the class that leads its group."""
    spark = docs.sparkSession
    t = Tables(spark, "near-dup")
    bands, rows = shape(percent)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("body", F.xxhash64("text"))
    seen = t.keep("sketches", base.mapInArrow(_sketcher(bands, rows, percent), "doc_id long, body long, n_shingles long, cls binary, keys array<long>"))
    front = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")  # of the rows that stand for a class the first one
    classes = seen.where("cls is not null").groupBy("cls").agg(F.min(front).alias("front"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = t.keep("classes", classes)
    ranked = classes.select("cls", "n", F.explode("keys").alias("bucket"))
    # sizes are a table of their own, so that Spark may split the rows of a hot bucket where they meet it
    sizes = t.keep("sizes", ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = t.keep("buckets", ranked.join(sizes, "bucket"))
    wanted = members.select("cls").distinct().join(classes.select("cls", "front"), "cls").select("cls", F.col("front.doc_id").alias("least"), F.col("front.body").alias("body"))
    wanted = t.keep("wanted", wanted)
    # one row stands for a class: that of its least id, and of rows without an id the one of the least text
    stands = base.doc_id.eqNullSafe(wanted.least) & (base.body == wanted.body)
    # merged at any size: both sides grow with the input, so a broadcast that small tables allow is no plan to rely on
    pool = base.join(wanted.hint("merge"), stands).select("cls", "text").mapInArrow(_sets, "cls binary, shingles array<long>").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    pool = t.keep("pool", pool)
    crowd = pool.join(members.where(F.col("size") >= CROWD).select("cls").distinct(), "cls", "left_semi")
    crowd = t.keep("crowd", crowd.withColumn("id", F.monotonically_increasing_id()))
    usage = crowd.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    usage = t.keep("usage", usage)
    lone = crowd.select("cls", "id").join(usage.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone")), "id").select("cls", "lone")
    shared = F.col("n") - F.when(F.col("size") >= CROWD, F.coalesce("lone", F.lit(0))).otherwise(0)
    members = members.join(lone, "cls", "left").select("bucket", "cls", "size", "n", shared.alias("shared")).where(100 * F.col("shared") >= percent * F.col("n"))
    members = t.keep("members", members)
    labels = _linked(t, members, pool, crowd, usage, percent)
    least = classes.select("cls", "front")
    if labels is not None:
        own = least.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        first = own.groupBy("label").agg(F.min(F.struct("front", "cls")).alias("first"))
        least = own.join(first, "label").select("cls", "first.front.doc_id", F.col("first.cls").alias("lead"))
    else:
        least = least.select("cls", "front.doc_id", F.col("cls").alias("lead"))
    least = t.keep("least", least.withColumnRenamed("doc_id", "component_id"))
    t.drop(*[name for name in t.at if name not in ("least", "sketches")])
    t.settle()
    return seen, least


def _pairs(left: DataFrame, right: DataFrame, on: str, columns: tuple[str, ...], might) -> DataFrame:
    """Pairs (a < b, both_n) of rows that meet on a column where ``might`` holds."""
    side = lambda x: [F.col(c).alias(f"{x}{c}") for c in columns]
    met = left.select(on, *side("a")).join(right.select(on, *side("b")), on).where((F.col("acls") != F.col("bcls")) & might)
    return met.select(F.least("acls", "bcls").alias("a"), F.greatest("acls", "bcls").alias("b"), (F.col("an") + F.col("bn")).alias("both_n"))


def _confirmed(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    one = pool.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    two = pool.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("both", both)
    return met.where(100 * F.col("both") >= percent * (F.col("both_n") - F.col("both"))).select("a", "b")


def _linked(t: Tables, members: DataFrame, pool: DataFrame, crowd: DataFrame, usage: DataFrame, percent: int) -> DataFrame | None:
    """Component label of every class that has a link; None if there is no link at all."""
    # at most the lesser count of shared shingles can be common; where even that falls short there is no link
    most, n = F.least("ashared", "bshared"), F.col("an") + F.col("bn")
    might = 100 * most >= percent * (n - most)
    centre = F.struct((F.col("n") - F.col("shared")).alias("own"), "cls", "n", "shared")
    centres = t.keep("centres", members.groupBy("bucket").agg(F.min(centre).alias("c")).select("bucket", "c.cls", "c.n", "c.shared"))
    stars = t.keep("stars", _pairs(members, centres, "bucket", ("cls", "n", "shared"), might).distinct())
    links = t.keep("links", _confirmed(stars, pool, percent))
    labels = None if links.isEmpty() else t.keep("labels", components(t, links, "a"))

    def across(df: DataFrame, by: str, name: str, columns: tuple[str, ...], when) -> DataFrame:
        """Pairs across the components that meet under a key: who is not of the key's largest component, with all there."""
        if labels is None:
            df = df.withColumn("label", F.col("cls"))
        else:
            df = df.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        df = t.keep(name, df)
        count = df.groupBy(by, "label").agg(F.count(F.lit(1)).alias("count")).groupBy(by).agg(F.max(F.struct("count", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"))
        still = t.keep(f"{name}-open", count.where("labels > 1").select(by, F.col("largest.label").alias("largest")))
        df = t.keep(f"{name}-left", df.join(still, by))
        return _pairs(df.where("label <> largest"), df, by, (*columns, "label"), (F.col("alabel") != F.col("blabel")) & when)

    rest = across(members.where(F.col("size").between(3, CROWD - 1)).select("bucket", "cls", "n", "shared"), "bucket", "small", ("cls", "n", "shared"), might)
    # prefix filter over crowded classes: shingles from rare to common, the first few of each class
    place = F.row_number().over(Window.partitionBy("cls").orderBy("c", "s"))
    flat = crowd.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(usage.select("s", "c"), "s")
    first = flat.withColumn("place", place).where((100 * (F.col("place") - 1) <= (100 - percent) * F.col("n")) & (F.col("c") > 1))
    upto = 1 + F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace"))
    rest = rest.unionByName(across(first.select("s", "cls", "n", "place"), "s", "first", ("cls", "n", "place"), (100 + percent) * upto >= percent * n))
    rest = t.keep("rest", rest.distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    more = t.keep("more", _confirmed(rest, pool, percent))
    if more.isEmpty():
        return labels
    edges = more if labels is None else more.unionByName(labels.select(F.col("cls").alias("a"), F.col("label").alias("b")))
    return t.keep("all", components(t, edges, "b"))
