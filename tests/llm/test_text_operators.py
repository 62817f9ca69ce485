"""Operators on texts against plain versions on small tables that hold the awkward cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from traceweft.llm import decontam, langid, near_dup, substring, unigram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; a table may have them too.
CLASHES = ["cls", "keys", "row", "uid", "seq", "h", "places", "label", "rank", "n", "bag", "f", "logs", "host", "w", "sh", "letters", "front"]


def docs(spark, rows):
    """(doc_id, text) with clashing columns beside them."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])


def corpus(seed=1):
    """Copies, near copies, shared passages, short, empty, null, repeated and long texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "a\u00a0b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(90), text(70)
    rows = [(i, text(rng.randint(5, 120))) for i in range(40)]
    rows += [(100 + i, base) for i in range(5)]
    for i in range(30):
        w = base.split(" ")
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{text(20)}\n{passage}\t{text(8)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "one"), (405, "a b c d"), (406, "A  b\nC d"), (407, "x " * 20_000), (408, "y" * 9_000), (409, passage)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, base), (None, "a lone one without an id here")]
    return rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        first = min(ids) if ids and sets[i] else doc
        want[(doc, len(sets[i]), first, doc == first if doc is not None else not sets[i])] += 1
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs(spark, rows), percent).collect())
    assert got == want


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    df = docs(spark, rows)
    groups = near_dup.near_duplicates(df).select("component_id", "n_shingles").collect()
    want = Counter(r.component_id for r in groups if r.n_shingles)
    got = near_dup.one_of_each(df, 85)
    assert got.columns == df.columns
    left = [r for r in got.collect() if shingles(r.text)]
    assert Counter(r.doc_id for r in left) == Counter(dict.fromkeys(want, 1))
    assert len([r for r in got.collect() if not shingles(r.text)]) == sum(not r.n_shingles for r in groups)


def test_crowded_buckets_lose_no_link(spark):
    """Many near copies of one text, some too far from it but near to each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    far = list(base)
    for k in range(6):
        far[10 + 20 * k] = f"z{k}"
    for i in range(1, 160):
        w = list(far if i % 3 == 0 else base)
        for _ in range(i % 5):
            w[rng.randrange(150)] = f"e{i}-{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in range(len(rows))}


def removed(rows):
    """Which words go, by the definition."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if doc is not None and (key not in least or doc < least[key]):
                least[key] = doc
    out = []
    for (doc, _), w in zip(rows, words):
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if doc is not None and least[tuple(w[k : k + 50])] < doc:
                keep[k : k + 50] = [False] * 50
        out.append([x for x, k in zip(w, keep) if k])
    return words, out


def test_substrings_match_brute_force(spark):
    rows = corpus()
    words, left = removed(rows)
    want = Counter((doc, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (doc, _), w, k in zip(rows, words, left))
    out = substring.remove_repeats(docs(spark, rows), rows_too=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 500
    for r in out:
        assert (r.kept_text is None) == (r.n_removed == 0)
        if r.kept_text is not None:
            assert hashlib.sha256(" ".join(WORD.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_cover_meets_every_pair_of_offsets():
    from traceweft.llm.substring import COVER, PERIOD

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def leaks(rows, items, least=0.8):
    """Best similarity of all item-sized windows, by the definition."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for item, text in items:
        it = tokens(text)
        if not it:
            continue
        for doc, body in rows:
            w = tokens(body)
            if len(it) < 5:
                if any(w[k : k + len(it)] == it for k in range(len(w))):
                    out[(doc, item)] = 1.0
                continue
            a = Counter(tuple(it[k : k + 5]) for k in range(len(it) - 4))
            best = 0
            for s in range(len(w)):
                b = Counter(tuple(x) for k in range(len(it) - 4) if len(x := w[s + k : s + k + 5]) == 5)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= least:
                out[(doc, item)] = best
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"q{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(6)] + [(6, "zig zag zog"), (7, None), (8, ""), (9, "one two one two one two one two one two")]
    rows = [(i, text(rng.randint(1, 200))) for i in range(25)]
    for i in range(12):
        w = items[i % 6][1].split(" ")
        if i >= 6:
            w[len(w) // 2 if i < 9 else -1] = "edited"
        rows.append((100 + i, f"{text(20)}. {' '.join(w).upper()}! {text(9)}"))
    rows += [(200, "he said zig, zag, zog then"), (201, None), (202, ""), (203, items[0][1]), (204, "one two one two one two one two one two one two"), (205, "zig zag")]
    rows += [(203, items[0][1]), (203, f"{text(9)} {items[2][1]}"), (None, items[1][1]), (None, f"{text(5)} {items[3][1]}"), (None, text(30))]
    bench = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("size"), F.lit(2).alias("g"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    want = leaks(rows, items)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) > 12


def test_one_hot_passage_and_ids_that_say_nothing(spark):
    """One benchmark passage in very many rows, most of which share an id or have none."""
    item = " ".join(f"k{i}" for i in range(40))
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 7, f"x{i % 50} {item} y{i % 70}") for i in range(3_000)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert got == {(d, 0): 1.0 for d in {d for d, _ in rows}}


def test_bags_count_repeats(spark):
    row = spark.createDataFrame([([5, 3, 5, 5, 9, 3],), ([],)], "h array<bigint>").select(decontam.bag(F.col("h")).alias("b")).collect()
    assert len(row[0].b) == len(set(row[0].b)) == 6 and row[1].b == []
    other = spark.createDataFrame([([5, 5, 3, 8], [3, 5, 5, 5, 3, 9])], "x array<bigint>, y array<bigint>")
    assert other.select(F.size(F.array_intersect(decontam.bag(F.col("x")), decontam.bag(F.col("y")))).alias("n")).first().n == 3


def test_no_near_fingerprint_escapes_the_index(spark):
    """Every fingerprint within the radius shares a key with the item's."""
    rng = random.Random(2)
    masks = decontam._near_keys()
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        block = lambda x, k: (x >> (8 * k)) & 255
        assert any(block(a, k) ^ block(b, k) in masks for k in range(8))
    h = [rng.getrandbits(63) for _ in range(9)]
    got = spark.range(1).select(decontam.simhash(F.array(*[F.lit(x) for x in h])).alias("f")).first().f
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert got % (1 << 64) == want


@pytest.fixture(scope="module")
def model():
    return unigram.Model.load("/opt/tokenizers/piece_bpe_32k.model")


def test_codec_gives_back_every_text(model):
    codec = unigram.Codec(model)
    rng = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "▁", "é", "漢", "😀", "\x00", "\t", "Zürich", ".", "$$", "\u2028", "\u00a0"]
    for _ in range(400):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert codec.decode(codec.encode(x).tolist()) == x
    assert codec.encode("").size == 0


def test_codec_takes_the_best_path(model):
    """No path has a higher score than the one found, by the plain recursion over all pieces."""
    codec = unigram.Codec(model)
    scores = {model.pieces[i].encode(): float(model.scores[i]) for i in range(len(model.pieces)) if model.normal[i]}
    least = min(scores.values()) - unigram.UNKNOWN_PENALTY
    longest = max(map(len, scores))
    for x in ["the theory of everything", "Donaudampfschifffahrt  und\nmehr", "漢字 and 😀😀 ok", "aaaaaaaaaaaaaaaa", "$$$### %%%"]:
        b = ("▁" + x.replace(" ", "▁")).encode()
        edge = [0, *[len(("▁" + x.replace(" ", "▁"))[: k + 1].encode()) for k in range(len(x) + 1)]]
        best = {0: 0.0}
        for a, z in zip(edge, edge[1:]):
            options = [best[s] + scores[b[s:z]] for s in edge if s < z and z - s <= longest and b[s:z] in scores]
            best[z] = max([*options, *([best[a] + least] if b[a:z] not in scores else [])])
        total, k, ids = 0.0, 0, codec.encode(x).tolist()
        while k < len(ids):
            if codec.spell[ids[k]] >= 0:
                first = codec.spell[ids[k]]
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += least
            else:
                total += float(model.scores[ids[k]])
                k += 1
        assert abs(total - best[len(b)]) < 1e-6, x


def test_trie_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    t = unigram.DoubleArray(keys, list(range(len(keys))))

    def find(key):
        s = 0
        for c in key:
            n = t.base[s] + c + 1
            if t.check[n] != s:
                return -1
            s = n
        return t.value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"z") == -1 and find(b"c") == -1 and find(b"abcd") == -1


def test_encoded_table(spark, model):
    rows = [r for r in corpus() if r[0] != 407]
    out = unigram.encoded(docs(spark, rows), model).collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == Counter((d, t or "") for d, t in rows)
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in out)


def test_languages(spark):
    rng = random.Random(4)
    parts = {"xx": ["bal", "kor", "tun", "mek"], "yy": ["ée", "oui", "lle", "nça"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [Row(doc_id=i, text=text("xx" if i % 2 else "yy", 30), lang="xx" if i % 2 else "yy", source="one.host.xx" if i % 2 else "two.host.yy") for i in range(120)]
    rows += [Row(doc_id=200, text=None, lang="xx", source="one.host.xx"), Row(doc_id=201, text="", lang=None, source=None), Row(doc_id=202, text="12 34 !", lang=None, source="one.host.xx")]
    rows += [Row(doc_id=203, text='<html lang="yy"> ok', lang=None, source=None), Row(doc_id=204, text=text("yy", 4000), lang=None, source=None), Row(doc_id=None, text=text("xx", 9), lang=None, source=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASHES})
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang == ("xx" if i % 2 else "yy") and got[i].accepted for i in range(120))
    assert not any(got[i].accepted or got[i].lang for i in (200, 201, 202))
    assert got[203].declared == "yy" and got[203].lang == "yy" and got[204].lang == "yy" and got[None].lang == "xx"
    assert not any(r.accepted for r in langid.identify(df, wanted=["zz"]).collect())


def test_host_prior_decides_what_the_text_leaves_open(spark):
    rows = [(i, "ab ba ab", "p" if i % 2 else "q", "h1" if i % 2 else "h2") for i in range(200)]
    rows += [(1000, "ab", None, "h1"), (1001, "ab", None, "h2")]
    same = [(i + 5000, t.replace("ab", "abp" if g == "p" else "abq"), g, h) for i, t, g, h in rows[:200]]
    df = spark.createDataFrame(rows[200:] + same, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in langid.identify(df).where("doc_id < 5000").collect()}
    assert got == {1000: "p", 1001: "q"}


def test_empty_tables(spark, model):
    none = docs(spark, []).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (near_dup.near_duplicates(none), near_dup.one_of_each(none), substring.remove_repeats(none), substring.remove_repeats(none, rows_too=True), decontam.contaminated(none, bench), decontam.contaminated(docs(spark, [(1, "a b")]), bench), unigram.encoded(none, model), langid.identify(none)):
        assert df.collect() == []


def test_texts_of_no_trained_language_are_rejected(spark):
    rng = random.Random(8)
    parts = {"xx": ["bal", "kor", "tun", "mek"], "yy": ["ée", "oui", "lle", "nça"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text("yy" if i % 20 == 0 else "xx", rng.randint(3, 60)), "yy" if i % 20 == 0 else "xx") for i in range(200)]
    new = [(1000 + i, text("xx" if i % 2 else "yy", 20), None) for i in range(20)]
    strange = ["今天天气很好，我们去公园散步，然后回家吃饭。", "Сегодня хорошая погода, и мы идём гулять в парк.", "Dzisiaj jest ładna pogoda, więc idziemy na spacer.", "Tänään on kaunis ilma ja menemme puistoon."]
    strange += ["".join(rng.choice("ABCDEFGHabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200)) for _ in range(3)]
    df = spark.createDataFrame(rows + new + [(2000 + i, t, None) for i, t in enumerate(strange)], "doc_id long, text string, lang string").withColumn("source", F.lit("one.host"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].accepted and got[i].lang == lang for i, _, lang in rows)
    assert all(got[i].accepted and got[i].lang == ("xx" if i % 2 else "yy") for i, _, _ in new)
    assert not any(got[2000 + i].accepted or got[2000 + i].lang for i in range(len(strange)))


def test_decontamination_tries_every_start(spark):
    """Edits at both ends and an insertion between them: the best window starts at no shared shingle's place."""
    item = [f"k{i}" for i in range(100)]
    body = ["x1", "x2", "x3", *item[3:50], *[f"n{i}" for i in range(6)], *item[50:97], "y1", "y2", "y3"]
    rng = random.Random(5)
    rows = [(0, " ".join(body)), (1, " ".join(body[20:80])), (2, " ".join(["a"] * 300)), (3, " ".join(["b", *item[:90]]))]
    for i in range(40):
        w = list(item)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w))
            w[k:k] = [f"z{rng.randrange(10**6)}" for _ in range(rng.randint(0, 8))]
        rows.append((10 + i, " ".join([f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 30))] + w[rng.randint(0, 8) : len(w) - rng.randint(0, 8)])))
    half = [f"u{i}" for i in range(7)]
    rows += [(100, " ".join([*half, *item[50:], *item[:50], *half])), (101, " ".join([*item[:30], "n1", *item[30:60], "n3", *item[60:]])), (102, " ".join([*half, *item[:92]])), (103, " ".join([*half, *item[9:]]))]
    items = [(0, " ".join(item)), (1, "a a a a a a a a a a a a")]
    out = decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    size = {r.doc_id: (r.start, r.n_words) for r in out if r.item_id == 0}
    assert size[102] == (7, 92) and size[100] == (7, 100) and {100, 101, 102, 103} <= set(size)
    got = {(r.doc_id, r.item_id): r.similarity for r in out}
    want = leaks(rows, items)
    assert (0, 0) in want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def evidence_rows(rng):
    """Pages with addresses: half German-like, half French-like, all with one common word; no host or domain is one-sided but two."""
    parts = {"de": ["bal", "kor", "tun", "mek"], "fr": ["ée", "oui", "lle", "nça"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(20)) + " omni" * 6
    rows = [(i, text("fr" if i % 2 else "de"), "fr" if i % 2 else "de", f"http://n{i // 2 % 7}.mixed.org/{i}") for i in range(200)]
    rows += [(300 + i, text("fr"), "fr", "https://a.site.com:80/x") for i in range(40)]
    return rows + [(400 + i, text("de"), "de", "a.ort.com") for i in range(40)]


def test_each_kind_of_evidence_speaks(spark):
    """A text that says nothing is decided by its mark-up, its suffix, or the other hosts of its domain."""
    rows, same = evidence_rows(random.Random(6)), "omni omni omni omni"
    rows += [(1000, same, None, "http://neu.de/a"), (1001, same, None, "http://neuf.fr"), (1002, f'<html lang="fr"><p>{same}</p>', None, "x.mixed.org"), (1003, f"<html lang='de-AT'><p>{same}</p>", None, "x.mixed.org")]
    rows += [(1004, same, None, "b.site.com"), (1005, same, None, "http://b.ort.com/?q"), (1006, same, None, "a.site.com"), (1007, same, None, "a.ort.com")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: got[i].lang for i in range(1000, 1008)} == {1000: "de", 1001: "fr", 1002: "fr", 1003: "de", 1004: "fr", 1005: "de", 1006: "fr", 1007: "de"}
    assert got[1002].declared == "fr" and got[1004].declared is None


def test_rows_that_no_model_has_seen(spark):
    """Fitted on one half by hash, the model tells the language of the other half."""
    df = spark.createDataFrame(evidence_rows(random.Random(16)), "doc_id long, text string, lang string, source string")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = langid.identify(df.where(~half), training=df.where(half), host=None).join(df.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert len(got) > 100 and sum(r.lang == r.true for r in got) >= 0.97 * len(got)


def test_many_rows_without_an_id(spark):
    """Near copies with missing ids cost what others cost, and one of each group stays."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(None, " ".join([*base, f"e{i}"])) for i in range(500)] + [(None, " ".join(f"c{rng.randrange(10**6)}" for _ in range(30))) for _ in range(20)]
    left = near_dup.one_of_each(docs(spark, rows)).collect()
    assert len(left) == 21 and sum("b0" in r.text for r in left) == 1


def test_small_sets_lose_no_link(spark):
    """Pairs of few shingles right at the threshold."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        n = rng.randint(9, 30)
        a = [f"w{i}-{k}" for k in range(n)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join([*a, *[f"x{i}-{k}" for k in range(int((n - 4) * 0.25))]]))]
    sets = [shingles(t) for _, t in rows]
    near = {2 * i for i in range(300) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert len(near) > 200 and {i for i in range(0, 600, 2) if got[i + 1] == i} == near


def test_one_passage_in_very_many_documents(spark):
    """A hot passage is taken out of all but the first document that has it."""
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.range(20_000).select((F.col("id") + 5).alias("doc_id"), F.concat(F.lit("own"), F.col("id").cast("string"), F.lit(" " + passage)).alias("text"))
    got = substring.remove_repeats(df).groupBy("n_words", "n_removed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).collect()
    assert sorted(map(tuple, got)) == [(61, 0, 1, 5), (61, 60, 19_999, 6)]


def test_rows_meet_python_with_their_text_once(spark, monkeypatch):
    """A row that comes along doesn't repeat its text in the batches, and comes out as it went in."""
    rng = random.Random(9)
    long = [" ".join(rng.choice(["the", "of", "and", "house", "water", "then", "where"]) + str(rng.randrange(50)) for _ in range(400)) for _ in range(40)]
    texts = [*long, "<html lang='en'><p>the house of the water and the trees</p>", "", None, " \t"]
    df = spark.createDataFrame([(i, t, "en", f"src {i}", -i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {tuple(r) for r in df.collect()}
    sent, whole = spark.sparkContext.accumulator(0), sum(len(t) for t in long)

    def counting(f):
        def run(batches):
            def seen():
                for b in batches:
                    if "row" in b.schema.names:
                        sent.add(b.nbytes)
                    yield b

            return f(seen())

        return run

    scored = langid._scored
    monkeypatch.setattr(langid, "_scored", lambda *a: counting(scored(*a)))
    monkeypatch.setattr(near_dup, "_classes", counting(near_dup._classes))
    monkeypatch.setattr(substring, "_anchors", counting(substring._anchors))
    for run, n in ((lambda d: langid.identify(d, rows_too=True).select("row.*"), len(texts)), (near_dup.one_of_each, len(texts)), (lambda d: substring.remove_repeats(d, rows_too=True).select("row.*"), len(texts))):
        sent.value = 0
        out = run(df)
        assert out.dtypes == df.dtypes
        got = [tuple(r) for r in out.collect()]
        assert len(got) == n and set(got) == rows
        assert whole < sent.value < 1.5 * whole
    odd = spark.createDataFrame([(1, 12, "x"), (2, 12, "y"), (3, None, "z")], "doc_id long, text int, other string")
    assert {tuple(r) for r in near_dup.one_of_each(odd).collect()} == {(1, 12, "x"), (3, None, "z")}


def test_no_table_of_scores_that_are_read_once(spark, monkeypatch):
    kept = []
    keep = langid.Tables.keep
    monkeypatch.setattr(langid.Tables, "keep", lambda self, name, df: kept.append(name) or keep(self, name, df))
    rows = [(i, "the house of the water and the trees" if i % 2 else "das Haus und der Baum an dem Wasser", "en" if i % 2 else "de", f"s{i % 3}.org") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain = {tuple(r) for r in langid.identify(df).select("doc_id", "lang", F.round("probability", 9), "accepted").collect()}
    assert "first" in kept
    kept.clear()
    assert {tuple(r) for r in langid.identify(df, rows_too=True).select("doc_id", "lang", F.round("probability", 9), "accepted").collect()} == plain
    assert "first" not in kept
