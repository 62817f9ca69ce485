"""URL filter: rules first, then words of the address under multinomial naive Bayes.

Host names run words together. A unigram model splits each label of a host by Viterbi into its likeliest words.
Its vocabulary are the words of paths and titles and the substrings that two distinct labels have in common; its
weights are learned by expectation maximisation over the distinct labels: each round splits all labels by the
weights of the last one and counts the words that came out, beside the words that texts show whole. A run of n
letters that is no word costs as much as a word seen once, and a factor of ten for every letter. The model meets
the labels in joins and is never broadcast.

The classifier learns from the pages that the rules, or marks of the caller, decide: their verdicts are its labels.
A page's score is the log odds of block over allow of its host and path words, with add-one smoothing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweft.llm.durable import Tables

#: Longest word inside a label: the bound that the domain name system sets to a label. Longer labels are split as well.
LONGEST = 63
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Log probability that each letter of a run outside the vocabulary costs.
LETTER = -math.log(10.0)
Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for a null or where there is no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (host and path together), or null.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"[.\-_:]+"), lambda x: x != "")


def _path_words(path: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of digits alone stands as 0, for its value says nothing."""
    return F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "0").otherwise(x))


def split(label: str, found: list[tuple[int, int, float]], total: float) -> list[str]:
    """The words of the likeliest split; found holds (start, length, log probability) of the vocabulary's words in the label.

    Of equal splits the one whose last word begins first is taken.
    """
    n, start = len(label), -math.log(total)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, k, logp in sorted(found):
        by_end.setdefault(i + k, []).append((i, logp))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run, begun = -math.inf, 0  # the best split that ends in an open run outside the vocabulary, and where that began
    for j in range(1, n + 1):
        if best[j - 1] + start > run:
            run, begun = best[j - 1] + start, j - 1
        run += LETTER
        best[j], back[j] = run, begun
        for i, logp in by_end.get(j, ()):
            if best[i] + logp > best[j]:
                best[j], back[j] = best[i] + logp, i
    words, j = [], n
    while j:
        words.append(label[back[j] : j])
        j = back[j]
    return words[::-1]


def _splits(batches):
    for b in batches:
        words = [split(label, [(int(f["i"]), int(f["n"]), float(f["logp"])) for f in found], float(total)) for label, found, total in zip(b["label"], b["found"], b["total"])]
        yield pd.DataFrame({"label": b["label"], "words": words})


def segmented_labels(pages: DataFrame, rounds: int = ROUNDS, longest: int = LONGEST) -> DataFrame:
    """(label, words): each distinct host label of ``pages`` (host, path, title) split into its likeliest words.

    Words inside labels have 2 to ``longest`` characters; a label of any length is split.
    """
    t = Tables(pages.sparkSession, "labels")
    seen = pages.select(F.explode(F.concat(_path_words(F.col("path")), _path_words(F.coalesce("title", F.lit(""))))).alias("word"))
    shown = t.keep("shown", seen.where(F.length("word").between(2, longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    labels = t.keep("labels", pages.select(F.explode(_labels(F.col("host"))).alias("label")).distinct())
    spans = labels.select("label", F.posexplode(F.sequence(F.lit(1), F.length("label"))).alias("i", "at")).where(F.length("label") - F.col("i") >= 2)
    spans = spans.select("label", "i", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.length("label") - F.col("i")))).alias("n"))
    spans = spans.withColumn("word", F.substr(F.col("label"), F.col("i") + 1, F.col("n")))
    inside = spans.groupBy("word").agg(F.count_distinct("label").alias("inside"))
    words = inside.join(shown, "word", "left").where("inside >= 2 or n is not null")
    weight = t.keep("words", words.select("word", (F.col("inside") + F.coalesce("n", F.lit(0))).alias("weight"), F.coalesce("n", F.lit(0)).alias("shown")))
    spots = t.keep("spots", spans.join(weight.select("word"), "word"))
    for k in range(rounds + 1):
        total = weight.agg(F.sum("weight")).first()[0] or 1
        found = spots.join(weight.where("weight > 0").select("word", F.log(F.col("weight") / total).alias("logp")), "word")
        found = found.groupBy("label").agg(F.collect_list(F.struct("i", "n", "logp")).alias("found"))
        found = labels.join(found, "label", "left").select("label", F.coalesce("found", F.array().cast("array<struct<i: int, n: int, logp: double>>")).alias("found"), F.lit(float(total)).alias("total"))
        out = t.keep(f"split{k}", found.mapInPandas(_splits, "label string, words array<string>"))
        if k < rounds:
            used = out.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("used"))
            weight = t.keep(f"weight{k}", weight.select("word", "shown").join(used, "word", "left").select("word", (F.coalesce("used", F.lit(0)) + F.col("shown")).alias("weight"), "shown"))
    t.drop(*[name for name in t.at if name != f"split{rounds}"])
    return out


def judge(
    pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str | None = "html", marked: Column | None = None, learn: Column | None = None
) -> DataFrame:
    """Verdict on each address.

    ``marked`` is an expression over ``pages`` with the verdict (allow or block) of pages that were judged by hand,
    else null: they teach the classifier beside the pages that a rule decides. ``learn`` says which pages may
    teach it (by default all).
    Returns page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict (allow
    or block: the rule's, else block where the score is over 0) and score (log odds of block). Host and path
    are empty for a null url or one without ``://``; such pages have no words and score at the prior. Words that
    no teaching page has say nothing, and where none teaches all scores are 0, so the verdict is allow. Every
    row is judged by itself, so repeated rows repeat; an empty table gives an empty result; other columns are
    ignored. Labels may have any length; words inside them have at most 63 characters.
    """
    t = Tables(pages.sparkSession, "urls")
    host, path = split_url(F.col(url))
    title = F.regexp_extract(F.coalesce(F.col(html).cast("string"), F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1) if html else F.lit("")
    by_hand = F.lit(None).cast("string") if marked is None else marked
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), title.alias("title"), by_hand.alias("marked"), F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"))
    base = base.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    words = segmented_labels(base)
    # words of each distinct host; all sides are kept tables, so that Spark splits a hot label, host or word
    hosts = t.keep("hosts", base.select("host").distinct().withColumn("labels", _labels(F.col("host"))))
    at = hosts.select("host", F.posexplode("labels").alias("at", "label")).join(words, "label")
    host_words = t.keep("host-words", at.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words")))
    # tokens of each address: host words are kept apart from path words
    said = lambda verdict: F.count_if(F.col("learn") & (F.coalesce("m.verdict", "marked") == verdict))
    address = t.keep("addresses", base.groupBy("host", "path").agg(said("block").alias("b"), said("allow").alias("a")))
    tokens = F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), F.transform(_path_words(F.col("path")), lambda x: F.concat(F.lit("p:"), x)))
    parts = t.keep("tokens", address.join(host_words, "host", "left").select("host", "path", "b", "a", F.explode(tokens).alias("token")))
    table = t.keep("counts", parts.where("a + b > 0").groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    sums = table.agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"), F.count(F.lit(1)).alias("v"))
    odds = t.keep("odds", table.join(F.broadcast(sums)).select("token", (F.log((F.col("b") + 1) / (F.col("tb") + F.col("v"))) - F.log((F.col("a") + 1) / (F.col("ta") + F.col("v")))).alias("odds")))
    prior = address.agg((F.log(F.coalesce(F.sum("b"), F.lit(0)) + 1) - F.log(F.coalesce(F.sum("a"), F.lit(0)) + 1)).alias("prior"))
    scored = t.keep("scores", parts.select("host", "path", "token").join(odds, "token").groupBy("host", "path").agg(F.sum("odds").alias("odds")))
    out = base.select("page_id", "host", "path", "m").join(scored, ["host", "path"], "left").join(F.broadcast(prior))
    out = out.withColumn("score", F.coalesce("odds", F.lit(0.0)) + F.coalesce("prior", F.lit(0.0)))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
