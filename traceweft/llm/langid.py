"""Language identification by Bayesian fusion of evidence.

Four independent sources of evidence multiply: the text (byte trigrams under one multinomial model for each
language, tempered, since trigrams overlap and a text's are not independent), a language declared in its
mark-up, the suffix of its address, and its host. The host's prior is smoothed hierarchically: the language
shares of a host, from a first pass over all texts and summed by grouped aggregation, lean on those of its
registered domain, these on the whole corpus, each as strongly as a set number of documents.

A class for all other texts competes with the languages. Its likelihood is the least that texts of the best
language have: scored without their own counts, the training rows of each language give the mean score and how
its variance falls with length, and the floor lies FLOOR deviations below the mean.

A document is rejected where no language reaches the asked probability, where its text has no letters, or
where the best language is not wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweft.llm.beside import split
from traceweft.llm.durable import Tables
from traceweft.llm.samples import CHARS, LONGEST, ROWS, bounded, some
from traceweft.llm.words import buffer_of, pieces

BINS = 1 << 16
#: Independent observations that a text counts as at most: more trigrams only sharpen their mean.
TEMPER = 24.0
#: Deviations below a language's mean score at which another language or junk is as likely.
FLOOR = 5.0
#: Documents that a parent's shares weigh as in a host's prior.
LEAN = 20.0
#: Chance that declared mark-up, or an address suffix, tells the true language.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Most hosts whose priors are broadcast.
BROADCAST_HOSTS = 100_000
#: Country suffixes with one main language.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def trigram_bins(buf: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at each byte, A-Z lower-cased, digits alike, white space alike."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    x = fold[buf]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64)


def _bins_of(text: str) -> np.ndarray:
    return trigram_bins(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))


def _spread(scores: np.ndarray) -> np.ndarray:
    """Of (mean log probability, its variance over the trigrams, number of trigrams) rows: the mean, the variance between rows, and that of a trigram's part."""
    if not len(scores):
        return np.array([-np.log(BINS), 0.0, 0.0])
    score, each, count = scores.T
    mean = np.average(score, weights=np.minimum(count, TEMPER))
    # trigrams overlap by three, so a third of them are independent
    within = 3 * np.average(each, weights=count)
    return np.array([mean, max(0.0, np.average((score - mean) ** 2 - within / count, weights=np.minimum(count, TEMPER))), within])


class TextModel:
    """Log probability of each trigram bin under each language, and the scores that its texts have at least."""

    def __init__(self, languages: list[str], counts: np.ndarray, spread: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)
        self.spread = spread

    @staticmethod
    def fit(texts: list[str], langs: list[str]) -> TextModel:
        languages = sorted(set(langs))
        if not languages:
            return TextModel([], np.zeros((0, BINS)), np.zeros((0, 3)))
        counts = np.zeros((len(languages), BINS))
        for text, lang in zip(texts, langs):
            counts[languages.index(lang)] += np.bincount(_bins_of(text), minlength=BINS)
        scores = [[] for _ in languages]
        for text, lang in zip(texts, langs):
            bins, k = _bins_of(text), languages.index(lang)
            if len(bins):
                own = np.bincount(bins, minlength=BINS)
                rest = counts[k].sum() - len(bins) + 0.5 * BINS
                logs = np.log((counts[k][bins] - own[bins] + 0.5) / rest)
                scores[k].append((logs.mean(), logs.var(), len(bins)))
        return TextModel(languages, counts, np.array([_spread(np.array(x).reshape(-1, 3)) for x in scores]).reshape(-1, 3))

    def floor(self, k: int, count: int) -> float:
        mean, between, within = self.spread[k]
        return mean - FLOOR * np.sqrt(between + within / count)

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods of each text, last that of all other texts, and whether it has any letter."""
        buf, off = buffer_of(column)
        n = len(off) - 1
        letter = ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 0x80)
        total = np.concatenate([[0], np.cumsum(letter)])
        letters = total[off[1:]] - total[off[:-1]]
        out = np.zeros((n, len(self.languages) + 1))
        for d in range(n):
            sums, count = np.zeros(len(self.languages)), 0
            for lo in range(int(off[d]), int(off[d + 1]), 1 << 20):
                bins = trigram_bins(buf[lo : min(int(off[d + 1]), lo + (1 << 20) + 2)])
                sums += [g[bins].sum(dtype=np.float64) for g in self.logs]
                count += len(bins)
            if count:
                out[d, :-1] = sums / count
                out[d, -1] = self.floor(int(sums.argmax()), count)
                out[d] *= min(count, TEMPER)
        return out, letters > 0


def _scored(model: TextModel, whole: str):
    def run(batches):
        for b in pieces(batches, column=whole):
            logs, letters = model.likelihoods(pc.coalesce(b.column("text"), b.column(whole)))
            rest = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
            flat = pa.array(logs.ravel())
            ends = np.arange(0, flat.__len__() + 1, len(model.languages) + 1, dtype=np.int32)
            names = [name for name in b.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, flat), pa.array(letters)], names=[*names, "logs", "letters"])

    return run


def identify(
    docs: DataFrame, wanted: list[str] | None = None, least: float = 0.5, text: str = "text", doc_id: str = "doc_id", host: str | None = "source", label: str | None = "lang",
    training: DataFrame | None = None, rows_too: bool = False, sample_rows: int = ROWS, sample_longest: int = LONGEST, sample_chars: int = CHARS,
) -> DataFrame:
    """Language of every whole text.

    The text model is fitted on about ``sample_rows`` rows of ``training`` (by default ``docs``) that carry a
    ``label``, in the order of a hash, of at most ``sample_longest`` characters each and ``sample_chars`` in
    all; labels are no evidence afterwards. ``host`` names a column with a host, an address or any name of
    a source. Returns doc_id, lang (null where rejected for want of evidence), probability, declared (by the
    text's mark-up), accepted. A text whose trigrams are as rare as no training text's of its best language is
    rejected as another language or junk. Tags of a text that declares its language are no evidence. A null,
    empty or letterless text is rejected whatever its host; null hosts share the corpus prior, and a host without
    a dot is its own domain; with no labelled row at all nothing is accepted. Equal probabilities go to the language
    that sorts first. Rows stand for themselves, repeated or not; an empty table gives an empty result; other
    columns are ignored. With ``rows_too`` the input row comes along as ``row``.
    """
    spark = docs.sparkSession
    t = Tables(spark, "langid")
    source = training if training is not None else docs
    known = source.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang"), F.xxhash64(doc_id, text, F.lit(29)).alias("k"))
    drawn = bounded(some(known.where(F.col("lang").isNotNull() & (F.length("text") <= sample_longest)), F.col("k"), sample_rows), sample_chars)
    model = TextModel.fit([r.text for r in drawn], [r.lang for r in drawn])
    langs = model.languages
    address = F.lower(F.coalesce(F.col(host).cast("string"), F.lit(""))) if host else F.lit("")
    name = F.regexp_extract(F.regexp_replace(address, r"^[a-z][a-z0-9+.-]*://", ""), r"^([^/?#:]*)", 1)
    rest, again = split(docs, text, "kept")
    named = docs.select(
        rest,
        F.col(doc_id).alias("doc_id"),
        F.nullif(name, F.lit("")).alias("host"),
        F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("suffix"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(text).cast("string"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit("")).alias("declared"),
        F.col(text).cast("string").alias("kept"),
    ).withColumn("text", F.when(F.col("declared").isNotNull(), F.regexp_replace("kept", r"<[^<>]*>", " ")))  # null: as it is
    more = [again] if rows_too else []
    base = named.withColumn("text", F.coalesce("text", "kept")).drop("row", "kept")
    whole = named if rows_too else base
    if not langs:
        return whole.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), "declared", F.lit(False).alias("accepted"), *more)
    score = lambda df: df.mapInArrow(_scored(model, "kept" if "kept" in df.columns else "text"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "text") + ", logs array<double>, letters boolean")
    # with rows the texts are scored again in the end, which takes no disk; a table of whole texts would
    first = score(base) if rows_too else t.keep("first", score(base))
    final = score(whole) if rows_too else first
    n = len(langs) + 1  # the last class is for all other texts
    each = range(n)
    tell = lambda c, right: [F.when(c.isin(langs), F.when(c == x, right).otherwise((1 - right) / (n - 1))).otherwise(F.lit(1.0)) for x in [*langs, ""]]
    suffix = F.lit(None).cast("string")
    for s, lang in SUFFIXES.items():
        suffix = F.when(F.col("suffix") == s, lang).otherwise(suffix)
    said, sited = tell(F.col("declared"), DECLARED_RIGHT), tell(suffix, SUFFIX_RIGHT)
    weighed = lambda df: df.withColumn("logs", F.array(*[F.get("logs", k) + F.log(said[k]) + F.log(sited[k]) for k in each]))

    def posterior(logs):
        top = F.array_max(logs)
        exps = F.transform(logs, lambda x: F.exp(x - top))
        return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))

    share = weighed(first).where("letters").withColumn("p", posterior(F.col("logs")))
    # the registered domain: two labels, or three under a country's own second level, as in co.uk
    two = F.regexp_extract("host", r"([^.]+\.(?:(?:ac|co|com|edu|gob|gov|go|gv|net|ne|org|or)\.[a-z]{2}|[^.]+))\.?$", 1)
    parent = F.when(two != "", two).otherwise(F.col("host"))
    hosts = share.groupBy("host").agg(*[F.sum(F.get("p", k)).alias(f"s{k}") for k in each], F.count(F.lit(1)).alias("c")).withColumn("domain", parent)
    hosts = t.keep("hosts", hosts)
    world = hosts.agg(*[((F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("c"), F.lit(0)) + n)).alias(f"w{k}") for k in each])
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{k}").alias(f"d{k}") for k in each], F.sum("c").alias("dc"))
    up = domains.join(F.broadcast(world)).select("domain", *[((F.col(f"d{k}") + LEAN * F.col(f"w{k}")) / (F.col("dc") + LEAN)).alias(f"m{k}") for k in each])
    prior = hosts.join(up, "domain").select("host", F.array(*[F.log((F.col(f"s{k}") + LEAN * F.col(f"m{k}")) / (F.col("c") + LEAN)) for k in each]).alias("prior"))
    # few hosts reach every task whole; many meet the documents in a join, whose hot keys Spark splits
    hint = F.broadcast if hosts.count() <= BROADCAST_HOSTS else (lambda df: df)
    fused = weighed(final).join(hint(prior.where("host is not null")), "host", "left").join(F.broadcast(world.select(F.array(*[F.log(f"w{k}") for k in each]).alias("anywhere"))))
    fused = fused.withColumn("p", posterior(F.zip_with("logs", F.coalesce("prior", "anywhere"), lambda a, b: a + b)))
    best = F.array_max(F.slice("p", 1, n - 1))
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(F.slice("p", 1, n - 1), best).cast("int"))
    sure = F.col("letters") & (F.col("probability") >= least)
    out = fused.select("doc_id", "declared", "letters", *more, best.alias("probability"), lang.alias("lang"))
    ok = sure & F.col("lang").isin(wanted) if wanted is not None else sure
    return out.select("doc_id", F.when(sure, F.col("lang")).alias("lang"), "probability", "declared", ok.alias("accepted"), *(["row"] if rows_too else []))
