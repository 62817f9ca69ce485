"""Benchmark decontamination with SimHash windows, in DataFrame and SQL functions only.

Words are maximal runs of letters and digits, lower-cased. A document's windows have the size of an item and
start wherever the window can be as similar as asked: at similarity t it holds at least t times as many places
of the item's 5-word shingles as the item has shingles, so all starts whose window spans so many consecutive
places are taken, and no other start can do. Each window and each item gets a 64-bit
SimHash of its shingles. Fingerprints are cut in 8 blocks of 8 bits and indexed under every key within 2
flipped bits of each block of an item; two fingerprints up to 23 bits apart differ in at most 2 bits of some
block, so the index returns all of them. Candidates within the radius are verified by the exact similarity
of the two bags of shingles: the sum of least counts over the sum of greatest counts.

The benchmark is broadcast only while its counted shingles are few, and the starts to look at only while they
take few bytes; beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.llm.durable import Tables

WIDTH = 5
BLOCKS = 8
BITS = 64 // BLOCKS
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Most benchmark shingles, or index keys, that are broadcast; and most bytes of the starts to look at.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the runs of ``width`` words, in order; no shorter run."""
    count = F.size(w) - (width - 1)
    run = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), run)).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bag(hashes: Column) -> Column:
    """The same hashes, sorted, with repeats told apart by their ordinal, so that set operations count like bags."""
    begins = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
    run = lambda x, a, z: F.transform(F.sequence(F.lit(1), z - a), lambda o: F.xxhash64(F.get(x, a), o))
    runs = lambda x, at: F.flatten(F.transform(at, lambda a, k: run(x, a, F.coalesce(F.get(at, k + 1), F.size(x)))))
    counted = let(F.sort_array(hashes), lambda x: let(begins(x), lambda at: runs(x, at)))
    return F.when(F.size(hashes) > 0, counted).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b of the result is set if bit b is set in more than half of the hashes; bits b and b + 32 are counted together."""
    shift = lambda x, b: F.call_function("shiftrightunsigned", x, b)
    lanes = F.transform(F.array(*[F.lit(b) for b in range(32)]), lambda b: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, x: acc + shift(x, b).bitwiseAND(F.lit((1 << 32) + 1))))
    bit = lambda count, b: F.when(2 * count > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    bits = F.transform(lanes, lambda c, b: bit(c.bitwiseAND(F.lit((1 << 32) - 1)), b).bitwiseOR(bit(shift(c, F.lit(32)), b + 32)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _near_keys() -> list[int]:
    """All masks of up to FLIPS of a block's bits."""
    out = {0}
    for _ in range(FLIPS):
        out |= {m ^ (1 << b) for m in out for b in range(BITS)}
    return sorted(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Pairs (doc_id, item_id) where a window of the document is as similar to the whole item as asked, or more.

    Returns doc_id, item_id, similarity (of the best window), start (its first word, the least on ties) and
    n_words (its size: the item's, or less at the end of the text). Items of fewer than 5 words are met as one
    shingle of all their words, and only exactly. Null or wordless texts and items match nothing. Every row is
    judged by itself; of rows that share a doc_id, or have none, each pair with an item is given once, with the
    best of their windows, and so are pairs of items that share an item_id. Empty tables give an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    t = Tables(spark, "decontam")
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where("size(w) > 0").distinct()
    width = F.least(F.size("w"), F.lit(WIDTH))
    short = F.xxhash64("w", F.lit(-1))
    items = items.withColumn("size", F.size("w")).withColumn("sh", F.when(width < WIDTH, F.array(short)).otherwise(shingles(F.col("w"))))
    items = t.keep("items", items.select("item_id", "size", "sh", bag(F.col("sh")).alias("bag"), simhash(F.col("sh")).alias("g")).withColumn("n", F.monotonically_increasing_id()))
    state = items.agg(F.sum(F.size("sh")), F.collect_set(F.when(F.col("size") < WIDTH, F.col("size")))).first()
    hint = F.broadcast if (state[0] or 0) * BLOCKS * len(_near_keys()) // WIDTH <= BROADCAST_ROWS else (lambda df: df)

    # a row is known by its id and its text, for ids may repeat or be missing
    body = F.col(text).cast("string")
    base = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), F.hash(body).alias("g")).alias("key"), body.alias("text"))
    # which windows: every start whose window has enough places of the item's shingles
    known = hint(items.select("n", "size", F.size("sh").alias("m"), F.explode(F.array_distinct("sh")).alias("h")))
    w = base.select("key", words(F.col("text")).alias("w"))
    places = w.select("key", F.posexplode(shingles(F.col("w"))).alias("at", "h"))
    for n in sorted(state[1]):  # at most four sizes
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n), F.lit(-1)))  # noqa: B023
        places = places.unionByName(w.where(F.size("w") >= n).select("key", F.posexplode(runs).alias("at", "h")))
    need = F.greatest(F.ceil(F.col("m") * similarity - 1e-9).cast("int"), F.lit(1))
    hits = places.join(known, "h").groupBy("key", "n", "size", "m").agg(F.array_sort(F.collect_set("at")).alias("at")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    last = lambda i: F.get("at", i + F.col("need") - 1)
    starts = lambda i: F.when(last(i) - F.get("at", i) < F.col("m"), F.sequence(F.greatest(last(i) - F.col("m") + 1, F.lit(0)), F.get("at", i))).otherwise(F.array().cast("array<int>"))
    spans = hits.select("key", "size", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), starts)))).alias("start")).distinct()
    spans = t.keep("spans", spans.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans")))

    # the windows themselves, each with its own slice of the document's shingles
    # few starts go to the texts where they lie; many meet them in a join, for which the texts move
    much = spans.agg(F.sum(F.size("spans") * 8 + 64)).first()[0] or 0
    full = base.join(F.broadcast(spans) if much <= BROADCAST_BYTES else spans, "key").select("key", words(F.col("text")).alias("w"), "spans")
    part = lambda sh, s: F.when(s["size"] < WIDTH, F.array(F.xxhash64(F.slice("w", s["start"] + 1, s["size"]), F.lit(-1)))).otherwise(F.slice(sh, s["start"] + 1, s["size"] - (WIDTH - 1)))
    parts = let(shingles(F.col("w")), lambda sh: F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), part(sh, s).alias("sh"))))
    window = full.select("key", F.size("w").alias("total"), F.explode(parts).alias("s")).select("key", "total", "s.*").where("size(sh) > 0")
    window = t.keep("windows", window.select("key", "start", "size", F.least("size", F.col("total") - F.col("start")).alias("n_words"), bag(F.col("sh")).alias("bag"), simhash(F.col("sh")).alias("f")))

    # multi-index: every pair of fingerprints within the radius meets under at least one block
    masks = F.array(*[F.lit(m) for m in _near_keys()])
    keys = items.select("n", "g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("g"), k).alias("b")) for k in range(BLOCKS)])).alias("e"))
    keys = hint(keys.select("n", "g", (F.col("e.k") * (1 << BITS)).alias("base"), F.col("e.b").alias("b"), F.explode(masks).alias("m")).select("n", "g", (F.col("base") + F.col("b").bitwiseXOR(F.col("m"))).alias("slot")))
    probes = window.select("key", "start", "size", "f", F.explode(F.array(*[_block(F.col("f"), k) + k * (1 << BITS) for k in range(BLOCKS)])).alias("slot"))
    near = probes.join(keys, "slot").where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).select("key", "start", "size", "n").distinct()

    both, a, b = F.size(F.array_intersect("bag", "item_bag")), F.size("bag"), F.size("item_bag")
    met = near.join(window, ["key", "start", "size"]).join(hint(items.select("n", "item_id", F.col("bag").alias("item_bag"))), "n")
    scored = met.select("key.doc_id", "item_id", "start", "n_words", (both / (a + b - both)).alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"), "n_words"))
    scored = scored.groupBy("doc_id", "item_id").agg(best.alias("v")).select("doc_id", "item_id", "v.similarity", F.col("v.start").cast("long").alias("start"), F.col("v.n_words").cast("long").alias("n_words"))
    scored = t.keep("found", scored)
    t.drop("items", "spans", "windows")
    return scored
