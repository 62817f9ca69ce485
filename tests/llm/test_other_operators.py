"""Classifiers, search, chat formatting, URL filter and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceweft.llm import ann, chat, quality, samples, toxicity, urls

NEAT = ["river", "garden", "quiet", "morning", "letter", "window", "market", "simple"]


def labelled(spark, marker, n=240):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(NEAT) for _ in range(rng.randint(8, 120))]
        hit = i % 3 == 0
        rows.append((i, marker(w, rng) if hit else " ".join(w)))
        labels.append((i, int(hit), int(hit)))
    rows += [(n, None), (n + 1, ""), (n + 2, "z" * 50_000), (n + 3, "river " * 9_000), (None, "quiet garden"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "y", "score", "predicted", "toxic", "quality")})
    return docs, spark.createDataFrame([*labels, (n, 1, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def split(k):
    return F.crc32(F.col("doc_id").cast("string")) % k


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda w, rng: " ".join(x + "$$$" for x in w))
    flipped = labels.withColumn("quality", 1 - F.col("quality"))
    got = quality.classify(docs, flipped, split(4) == 2).collect()
    assert len(got) == 246 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 40 and sum((r.doc_id % 3 != 0) == bool(r.predicted) for r in held) >= 0.95 * len(held)


def test_chunks_cover_the_whole_document():
    """A mark anywhere in a long text moves the score."""
    rng = np.random.default_rng(0)
    net = quality.ByteConv()
    net.tables[:] = 0
    for j, c in enumerate(b"@@@@@@"):
        net.tables[j, c] = 1
    net.out[:] = 1
    plain = rng.integers(97, 120, 5_000).astype(np.uint8)
    score = lambda x: net.score(x, np.array([0, len(x)]))[0]
    for at in (0, 255, 511, 512, 2_499, 4_990):
        marked = plain.copy()
        marked[at : at + 7] = 64
        assert score(marked) > score(plain)


def test_toxicity_knows_unseen_misspellings(spark):
    bad = ["vilewort", "grubbish", "snarkle"]
    docs, labels = labelled(spark, lambda w, rng: " ".join([*w[: len(w) // 2], rng.choice(bad), *w[len(w) // 2 :]]))
    extra = spark.createDataFrame([(5000, "quiet garden vilewortt river"), (5001, "quiet garden river letter"), (5002, "a " * 3_000 + "grubbishh" + " a" * 3_000)], "doc_id long, text string")
    got = toxicity.classify(docs.select("doc_id", "text").unionByName(extra), labels, split(3) == 1).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 249 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 60 and sum((r.doc_id % 3 == 0) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    assert by[5000].score > 0.7 > by[5001].score
    assert by[5002].score > 0.7  # one misspelt word in 6,000
    assert by[241].score < 0.7  # an empty text


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_samples_are_bounded(spark, module, label):
    """One text for each id, none of an id that carries both labels, none too long, and no more characters than asked."""
    docs = spark.createDataFrame([(i, f"t{i} " * (i + 1)) for i in range(40)] + [(7, "a second text")] * 30 + [(50, "x" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (5, 1), (5, 1)], f"doc_id long, {label} int")
    none = F.lit(False)
    texts, y = samples.labelled(docs, labels, label, none, longest=400)
    assert len(texts) == len(y) == 39 and "a second text" in texts and not any(x.startswith("t3 ") or x.startswith("xxx") for x in texts)
    fewer, _ = samples.labelled(docs, labels, label, none, longest=400, chars=900)
    assert fewer == texts[: len(fewer)] and sum(map(len, fewer)) <= 900 < sum(map(len, texts[: len(fewer) + 1]))
    assert samples.labelled(docs, labels, label, none, chars=0) == ([], [])
    got = module.classify(docs, labels, none, sample_chars=200)
    assert got.count() == docs.count()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_rows(spark, module):
    docs, labels = labelled(spark, lambda w, rng: "x", 6)
    assert module.classify(docs, labels.limit(0), split(4) == 2).count() == docs.count()
    assert module.classify(docs.limit(0), labels, split(4) == 2).collect() == []


def vectors(spark, n=1500, d=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(n, None), (n + 20, [0.0] * d), (n + 40, [float("nan")] * d), (n + 60, [float("inf")] + [1.0] * (d - 1)), (n + 80, [None] + [1.0] * (d - 1)), (n + 100, [1.0] * 3), (None, [1.0] * d)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("v", "code", "r", "q", "rank")}), x.astype(np.float64)


def recall_of(df, x, asked, **options):
    """Share of the true neighbours found; scores, order and ties are checked on the way."""
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, **options).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(asked)
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s.round(12)))[:20]
        hits += len({v for v, _ in found[q]} & set(want.tolist()))
        assert len(found[q]) == 20 and q not in {v for v, _ in found[q]}
        assert all(abs(score - x[v] @ x[q]) < 1e-9 for v, score in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
    return hits / (20 * len(asked))


def test_neighbours_recall_and_exact_scores(spark):
    df, x = vectors(spark)
    assert recall_of(df, x, range(0, len(x), 20), row_block=400, query_block=30) >= 0.95


def test_neighbours_in_clusters_scan_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = 4 * rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float64)
    assert recall_of(df, x, range(0, 3000, 20), row_block=256) >= 0.95
    cells = ann.Cells.fit(x, 54, 20, 0.98)
    assert 1 <= cells.probes <= 18
    assert (np.sort(cells.of(x)) >= 0).all() and cells.nearest(x[:7]).shape == (7, cells.probes)


def test_one_vector_in_most_rows(spark):
    """Of equal vectors the least ids are the nearest; a repeated row counts as often as it stands."""
    one, two = [1.0, 2.0, 0.5], [0.1, 0.1, 0.1]
    rows = [(i, one) for i in range(400)] + [(1000 + i, two) for i in range(10)] + [(3, one), (3, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.neighbours(df, F.col("vec_id") % 200 == 3, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {3: [0, 1, 2, 4, 5], 203: [0, 1, 2, 3, 3], 1003: [0, 1, 2, 3, 3]}


def test_neighbours_of_repeated_ids(spark):
    """Each row under an id counts; a query with two vectors is asked for both, and its answers are ranked together."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.5, 0.5])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2.0), (1, 1.0), (2, 0.5), (2, 0.5)]


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_anisotropic_codes_lower_the_parallel_error():
    x = np.random.default_rng(3).standard_normal((2_000, 16))
    q = ann.Quantiser.fit(x)
    codes = q.pack(x)
    assert codes.shape == (2_000, 4) and codes.dtype == np.uint8
    t = q.tables(x[:5])
    rough = np.stack([t[i][np.arange(4), codes].sum(axis=1) for i in range(5)])
    assert np.corrcoef(rough.ravel(), (x[:5] @ x.T).ravel())[0, 1] > 0.9


TALKS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "good day"),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"), (4, 0, "user", None), (4, 1, "assistant", ""), (5, 0, None, "who?"), (6, None, "user", "no turn"), (6, 1, "assistant", "### user: x</turn>\n\\"),
    (7, 0, "user", "same"), (7, 0, "user", "same"), (8, 0, "a:b", "<\\/turn></turn>#"), (None, 0, "assistant", "no id"), (9, 0, "assistant", "é" * 5_000), (10, 0, "system", "be kind"), (10, 1, "user", "hi"), (10, 2, "assistant", "hello"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("turns", "path", "segment", "node")})
    tree = chat.formatted_tree(df).cache()
    got = {r.conv_id: r for r in chat.read_back(tree).collect()}
    by: dict = {}
    for c, t, r, x in TALKS:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, said in by.items():
        said = [(r, x) for *_, r, x in sorted(said)]
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.turn(a, b)[0]) for a, b in said)


def test_shared_turns_are_emitted_once_with_their_masks(spark):
    df = spark.createDataFrame([t for t in TALKS if t[0] in (1, 2, 3, 10)], "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        nodes = chat.formatted_tree(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(n.formatted for n in nodes) == sorted(["### system: be kind</turn>\n", "### user: hi</turn>\n", "### assistant: hello</turn>\n", "### assistant: good day</turn>\n"])
    at = {n.node: n for n in nodes}
    for n in nodes:
        seen, up = set(), n.parent
        while up >= 0:
            seen |= set(range(at[up].start, at[up].start + at[up].n_tokens))
            up = at[up].parent
        assert {k for a in n.attends for k in range(a["from"], a["to"])} == seen
        assert n.position == len(seen)
    assert sorted(c for n in nodes for c in n.conv_ids) == [1, 2, 3, 10]


def test_a_hot_first_turn_over_many_segments(spark):
    """3,000 conversations with one first turn: segments stay bounded, repeated context is marked; whole trees repeat nothing."""
    talks = [(i, k, "user" if k % 2 == 0 else "assistant", "hot" if k == 0 else f"answer {i % 40}" if k == 1 else f"t{i}") for i in range(3_000) for k in range(3)]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    tree = chat.formatted_tree(df, 20_000, 64).cache()
    assert tree.groupBy("segment").agg(F.sum(F.size("conv_ids")).alias("n"), F.sum("n_tokens").alias("c")).where("n > 64 or c > 21000").count() == 0
    fresh = Counter(r.formatted for r in tree.where("not repeated").collect())
    tasks = len({r.segment.split("-")[0] for r in tree.select("segment").collect()})
    assert fresh["### user: hot</turn>\n"] <= tasks and all(n <= 2 for x, n in fresh.items() if "answer" in x and tasks <= 4)
    whole = chat.formatted_tree(df, None, None).cache()
    count = Counter(r.formatted for r in whole.collect())
    assert count["### user: hot</turn>\n"] == 1 and all(count[f"### assistant: answer {i}</turn>\n"] == 1 for i in range(40)) and whole.where("repeated").count() == 0
    read = lambda t: sorted(map(tuple, chat.read_back(t).collect()))
    assert read(tree) == read(whole) and len(read(tree)) == 3_000
    assert chat.formatted_tree(df.limit(0)).collect() == [] and chat.read_back(chat.formatted_tree(df.limit(0), None, None)).collect() == []


def test_escapes_hold_any_text():
    rng = random.Random(6)
    parts = ["\\", "#", "### ", "</turn>", "<", "/turn>", ":", " ", "\n", "user", "é", "<\\/turn>"]
    for _ in range(500):
        said = [("".join(rng.choice(parts) for _ in range(rng.randrange(5))), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(1, 4))]
        text = "".join(chat.turn(*s)[0] for s in said)
        assert chat.parse(text) == said
        assert all("### " not in chat.escape(x) and "</turn>" not in chat.escape(x) for s in said for x in s)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.COM/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"), (2, "https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (3, "http://x.com/de/", "x.com", "/de/", "com/", "allow"), (4, "http://x.com", "x.com", "", None, "allow"), (5, "ftp://b.net/es/1://y", "b.net", "/es/1://y", "net/es/", "block"),
        (6, None, "", "", None, "allow"), (7, "no scheme/en/", "", "", None, "allow"), (8, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (9, "://net/fr/?x", "net", "/fr/", "net/fr/", "block"),
        (10, "http://h.org?a/b://c", "h.org", "", None, "allow"), (11, "http://É.com/é#", "É.com", "/é", "com/", "allow"), (12, "", "", "", None, "allow"), (1, "http://A.Example.COM/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "page_id long, url string").withColumns({c: F.lit("x") for c in ("html", "host", "path", "word", "token", "label", "score")})
    got = sorted(tuple(r)[:5] for r in urls.judge(df, RULES).collect() if r.page_id)
    assert sorted((a, h, p, str(r), v) for a, h, p, r, v in got) == sorted((a, h, p, str(r), v) for a, _, h, p, r, v in rows)


def test_words_of_joined_names_are_blocked(spark):
    """Marked pages teach words, which are then known inside names that no marked page has."""
    good = [(i, f"http://{a}{b}.org/{b}/{i}", f"<title>{a} {b} news</title>") for i, (a, b) in enumerate((a, b) for a in NEAT for b in NEAT for _ in range(3))]
    bad = [(1000 + i, f"http://{w}{x}.org/win/{i}", f"<title>{w} {x}</title>") for i, (w, x) in enumerate((w, x) for w in ("casino", "poker", "spam") for x in NEAT[:6])]
    new = [(2000, "http://casinoposter.org/", ""), (2001, "http://posterriver.org/", ""), (2002, "http://" + "river" * 40 + "poker.org/", "")]
    df = spark.createDataFrame(good + bad + new, "page_id long, url string, html string")
    marked = F.when(F.col("page_id") >= 2000, None).when(F.col("page_id") >= 1000, "block").otherwise("allow")
    got = {r.page_id: r.verdict for r in urls.judge(df, [], marked=marked).collect()}
    assert sum(got[i] == "block" for i, *_ in bad) >= 0.9 * len(bad)
    assert sum(got[i] == "allow" for i, *_ in good) >= 0.95 * len(good)
    assert got[2000] == "block" and got[2001] == "allow"
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    assert urls.judge(df.limit(0), RULES).collect() == []


def every_split(label):
    for bits in range(1 << max(0, len(label) - 1)):
        cut = [0, *(i + 1 for i in range(len(label) - 1) if bits >> i & 1), len(label)]
        yield [label[a:b] for a, b in zip(cut, cut[1:])]


def test_splits_are_the_likeliest_of_all():
    rng = random.Random(3)
    for _ in range(150):
        label = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        words = {label[i:j] for i in range(len(label)) for j in range(i + 2, len(label) + 1) if rng.random() < 0.4}
        weight = {w: rng.randint(1, 40) for w in words}
        total = float(sum(weight.values()) + 50)
        found = [(i, len(w), math.log(weight[w] / total)) for w in words for i in range(len(label)) if label.startswith(w, i)]
        cost = lambda ws: sum(math.log(weight[w] / total) if w in weight else -math.log(total) + len(w) * urls.LETTER for w in ws)  # noqa: E731, B023
        got = urls.split(label, found, total)
        assert "".join(got) == label
        assert math.isclose(cost(got), max(map(cost, every_split(label))) if label else 0.0, abs_tol=1e-9)


def plain_verdicts(rows, rules, rounds=urls.ROUNDS):
    """The scores of ``judge`` in plain Python, from the definition."""
    tokens = lambda x: ["0" if re.fullmatch("[0-9]+", w) else w for w in re.split(r"[\W_]+", x.lower()) if w]
    out = []
    for page, url, html in rows:
        _, ok, rest = (url or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest if ok else "").groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        title = re.search(r"(?is)<title[^>]*>([^<]*)", html or "")
        fit = [(len(h) + len(p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((page, host, path, tokens(title[1] if title else ""), max(fit)[1] if fit else None))
    parts = lambda host: [x for x in re.split(r"[.\-_:]+", host) if x]
    shown = Counter(w for _, _, path, title, _ in out for w in tokens(path) + title if 2 <= len(w) <= 63)
    labels = {x for _, host, *_ in out for x in parts(host)}
    inside = Counter(w for x in labels for w in {x[i:j] for i in range(len(x)) for j in range(i + 2, min(len(x), i + 63) + 1)})
    weight = {w: n + shown[w] for w, n in inside.items() if n >= 2 or w in shown}
    for k in range(rounds + 1):
        total = float(sum(weight.values()) or 1)
        cut = {x: urls.split(x, [(i, j - i, math.log(weight[x[i:j]] / total)) for i in range(len(x)) for j in range(i + 2, len(x) + 1) if weight.get(x[i:j])], total) for x in labels}
        used = Counter(w for ws in cut.values() for w in ws)
        if k < rounds:
            weight = {w: used[w] + shown[w] for w in weight}
    said = [([f"h:{w}" for x in parts(host) for w in cut[x]] + [f"p:{w}" for w in tokens(path)], verdict) for _, host, path, _, verdict in out]
    count = {v: Counter(w for ws, verdict in said if verdict == v for w in ws) for v in ("block", "allow")}
    pages = Counter(verdict for _, verdict in said)
    v = len(count["block"] | count["allow"])
    odds = lambda w: math.log((count["block"][w] + 1) / (count["block"].total() + v)) - math.log((count["allow"][w] + 1) / (count["allow"].total() + v))
    prior = math.log(pages["block"] + 1) - math.log(pages["allow"] + 1)
    known = count["block"] | count["allow"]
    return {page: prior + sum(odds(w) for w in ws if w in known) for (page, *_), (ws, _) in zip(out, said)}, cut


def test_scores_match_a_plain_version(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        host = f"{rng.choice(['www.', 'm.', ''])}{rng.choice(NEAT)}{rng.choice(NEAT)}.{rng.choice(['example.com', 'shop.net', 'org', 'co.uk'])}"
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(NEAT)}/{i}?q", f"<title>The {rng.choice(NEAT)}</title>"))
    rows += [(900, None, None), (901, "http:///x", ""), (902, "http://" + "quietriver" * 30 + ".net/es/1", None), (903, "http://a..b--c.net/fr/", "<title></title>"), (904, "http://x.org/" + "p" * 3000, "")]
    want, cut = plain_verdicts(rows, RULES)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(df, RULES).collect()
    assert {r.page_id for r in got} == set(want) and len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.page_id]) < 1e-6, r
        if r.rule is None:
            assert r.verdict == ("block" if r.score > 0 else "allow")
    assert cut["riverletter"] == ["river", "letter"] and set(cut["quietriver" * 30]) <= {"quiet", "river", "quietriver"}


def test_held_out_pages_agree_with_the_rules(spark):
    """Learned from half of the pages that rules decide, the classifier gives most of the other half the rule's verdict."""
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice(NEAT)}{rng.choice(NEAT)}.{rng.choice(['example.com', 'www.example.com', 'shop.com', 'farm.net'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i}", "") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    half = F.crc32(F.col("page_id").cast("string")) % 2 == 0
    got = [r for r in urls.judge(df, RULES, learn=half).collect() if r.rule and zlib.crc32(str(r.page_id).encode()) % 2]
    assert len(got) > 150 and sum((r.score > 0) == (r.verdict == "block") for r in got) >= 0.85 * len(got)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import leaks, removed, shingles

    rng = random.Random(12)
    words = {"en": ["the", "river", "and", "house", "was", "green", "they"], "fr": ["leç", "maiso", "étai", "vert", "dans", "oùi", "quand"]}
    text = lambda lang, n: " ".join(f"{rng.choice(words[lang])}{rng.randrange(90)}" for _ in range(n))
    item, passage = text("en", 30), text("en", 60)
    rows = [(i, text("en" if i % 2 else "fr", rng.randint(40, 90)), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, rows[1][1], "en"), (101, rows[1][1] + " tail", "en"), (102, f"{text('en', 9)} {item} {text('en', 9)}", "en"), (103, f"{text('en', 20)} {passage} {text('en', 5)}", "en"), (104, f"{text('fr', 70)} {passage}", "en"), (105, "", "en"), (106, None, "fr"), (107, "12 34", None), (108, text("en", 20_000), "en"), (3, rows[3][1], "en")]
    df = spark.createDataFrame([(i, t, g, f"src{i % 3}", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left, kept = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)], []
    for i, t in sorted(left):
        s = shingles(t)
        if not any(100 * len(s & shingles(u)) >= 80 * len(s | shingles(u)) for _, u in kept):
            kept.append((i, t))
    _, after = removed(kept)
    final = {i: t.split(" ") if len(t.split(" ")) == len(w) else w for (i, t), w in zip(kept, after)}
    bad = {d for d, _ in leaks([(i, " ".join(w)) for i, w in final.items() if i < 108], [(0, item)])}
    assert bad == {102}
    assert {i: t.split() for i, t in got.items()} == {i: w for i, w in final.items() if i not in bad}
    assert len(got[104].split()) == 70


def test_pipeline_on_empty_and_clashing_tables(spark, tmp_path):
    """No rows at all; and rows with missing ids, texts and extra columns named like those inside."""
    import corpus_pipeline
    from tests.llm.test_text_operators import CLASHES

    names = "doc_id long, text string, lang string, source string, n_chars long"
    item = " ".join(f"k{i}" for i in range(30))
    rows = [(i, f"the river and the house number w{i} was very green in the late summer of year {i} they said", "en", "a", 9) for i in range(30)]
    rows += [(None, f"the green house {item} and the river", "en", "a", 9), (5, f"the house and {item} of the river", "en", "b", 9), (None, None, "en", None, None), (7, "", "en", None, 0)]
    for where, some_rows in (("none", []), ("few", rows)):
        df = spark.createDataFrame(some_rows, names).withColumns({c: F.lit("x") for c in CLASHES})
        df.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    got = corpus_pipeline.run(spark, f"{tmp_path}/few").collect()
    assert sorted(r.doc_id for r in got) == list(range(30))
    docs = spark.read.parquet(f"{tmp_path}/few/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/few").columns == docs.columns


def test_working_tables_go(spark):
    from pathlib import Path

    from traceweft.llm import durable

    since = durable.mark()
    t = durable.Tables(spark, "trial")
    t.keep("a", spark.range(3))
    t.keep("b", spark.range(3))
    base = Path(t.base.removeprefix("file://"))
    t.drop("a")
    assert sorted(p.name for p in base.iterdir() if not p.name.startswith(".")) == ["b"]
    durable.release(since)
    assert not base.exists()


def test_working_tables_make_no_files_but_their_parts(spark):
    """In a plain folder each file costs a process."""
    from pathlib import Path

    from traceweft.llm import durable

    since = durable.mark()
    t = durable.Tables(spark, "parts")
    df = t.keep("a", spark.range(1000, numPartitions=3))
    base = Path(t.base.removeprefix("file://")) / "a"
    assert len(list(base.iterdir())) == 3 and all(p.name.startswith("part-") for p in base.iterdir())
    assert df.count() == 1000 and df.agg({"id": "sum"}).first()[0] == 499_500
    durable.release(since)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from traceweft.llm import durable

    unset = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError, match="checkpoint"):
        durable.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    kept = SimpleNamespace(get=lambda key, default=None: "hdfs://a/b/")
    assert durable.shared_folder(SimpleNamespace(conf=kept, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://a/b"
