"""Each operator against brute force on a small table with nulls, empties, ties, copies and long texts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquelake.llm import (
    common,
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    repeats,
    sharding,
    substring_dedup,
    suffix_dedup,
)
from torquelake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, key string"
R = random.Random(7)
SYLLABLES = {"en": "the ing er on th an".split(), "fr": "eau eux ai oi re le".split()}


def sentence(n: int, lang: str = "en") -> str:
    return " ".join("".join(R.choice(SYLLABLES[lang]) for _ in range(R.randint(1, 4))) + R.choice(["", "", ".", ","]) for _ in range(n))


def corpus() -> list[tuple]:
    passage = sentence(90)
    texts: list = [None, "", " \n\t", "one", "one two three", "ONE two three", "12 34", "!!!"]
    base = sentence(200)
    texts += [base] * 12  # copies
    for i in range(12):  # near copies
        w = base.split()
        w[5 * i] = f"x{i}"
        texts.append(" ".join(w))
    texts += [sentence(60) + " " + passage + "\n" + sentence(60) for _ in range(10)]
    texts += [sentence(R.randint(1, 150), R.choice(["en", "fr"])) for _ in range(60)]
    texts += ["\n".join(["same line of words again"] * 80), sentence(6000), "é́ 日本 don't <|endoftext|> ﬁ"]
    rows = [(i, t, "en" if i % 2 else "fr", "src0", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, "a text without an id and with some words in it", "en", None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def count_of(rows):
    return collections.Counter(rows)


def test_base_counts_and_verdicts(docs):
    got = quality_rules.divergence_rules(docs).collect()
    expected = []
    for row in ROWS:
        t = row[1] or ""
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        expected.append((row[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cov), failed))
    assert count_of(tuple(r)[:7] for r in got) == count_of(expected)
    assert not any(r.kept and r.base_failed for r in got)


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0]


@pytest.mark.parametrize("hot", [1, 4096])
@pytest.mark.parametrize("keep_first", [False, True])
def test_substring_dedup(docs, hot, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    c = collections.Counter()
    w = [words(r[1]) for r in ROWS]
    for x in w:
        c.update(tuple(x[i : i + 35]) for i in range(len(x) - 34))
    got = substring_dedup.remove_repeated_windows(docs, keep_first).collect()
    first: dict = {}
    if keep_first:  # identical rows are one place
        for row, x in zip(ROWS, w, strict=True):
            for i in range(len(x) - 34):
                k = tuple(x[i : i + 35])
                first[k] = min(first.get(k, (10**9, 0)), (row[0] or 0, i))
    expected = []
    for row, x in zip(ROWS, w, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 34):
            k = tuple(x[i : i + 35])
            if c[k] > 1 and first.get(k) != (row[0] or 0, i):
                gone[i : i + 35] = True
        kept = " ".join(v for v, g in zip(x, gone, strict=True) if not g)
        expected.append((row[0], len(x), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert count_of((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == count_of(expected)


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    raws = [(r[1] or "").encode() for r in ROWS]
    c = collections.Counter(x[i : i + 400] for x in raws for i in range(len(x) - 399))
    expected = []
    for row, x in zip(ROWS, raws, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 399):
            if c[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        expected.append((row[0], len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert count_of((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == count_of(expected)


def test_previous_factors():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    size, factor = suffix_dedup.previous_factors(np.arange(9), data, 99, 9 - np.arange(9))
    assert size.tolist() == [0, 0, 0, 6, 5, 4, 3, 2, 1]
    assert factor.tolist()[:4] == [-1, -1, -1, 0]


@pytest.mark.parametrize("cap", [3, 8, 20, 400])
def test_previous_factors_against_all_pairs(cap):
    r = np.random.default_rng(cap)
    for n in (1, 2, 50, 300):
        raw = r.integers(97, 99 + n % 3, n).astype(np.uint8)
        raw[n // 2 :] = raw[: n - n // 2]
        room = n - np.arange(n)
        size, factor = suffix_dedup.previous_factors(np.arange(n), raw, cap, room)
        text = raw.tobytes()
        lcp = lambda i, j: next((k for k in range(min(cap, n - max(i, j))) if text[i + k] != text[j + k]), min(cap, n - max(i, j)))  # noqa: E731, B023
        assert size.tolist() == [max((lcp(i, j) for j in range(i)), default=0) for i in range(n)]
        assert all(f < i and lcp(i, f) == z for i, (z, f) in enumerate(zip(size.tolist(), factor.tolist(), strict=True)) if z)


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_keeps_the_first_copy(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    raws = [(r[1] or "").encode() for r in ROWS]
    first: dict = {}
    for row, x in zip(ROWS, raws, strict=True):
        for i in range(len(x) - 399):
            first[x[i : i + 400]] = min(first.get(x[i : i + 400], (10**9, 0)), (row[0] or 0, i))
    expected = []
    for row, x in zip(ROWS, raws, strict=True):  # identical rows are one place
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 399):
            if first[x[i : i + 400]] != (row[0] or 0, i):
                gone[i : i + 400] = True
        expected.append((row[0], np.frombuffer(x, np.uint8)[~gone].tobytes()))
    got = suffix_dedup.remove_repeated_bytes(docs, keep_first=True).collect()
    assert count_of((r.doc_id, bytes(r.kept)) for r in got) == count_of(expected)


def expected_groups(rows):
    """(doc_id, set size, component) of all rows, by comparing all pairs."""
    sets = []
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r[1])]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            i = len(sets[a] & sets[b])
            if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r[0])
    low = {k: min((v for v in g if v is not None), default=None) for k, g in groups.items()}
    return count_of((r[0], len(sets[k]), low[find(k)] if sets[k] else r[0]) for k, r in enumerate(rows))


def test_jaccard_join(docs):
    got = jaccard_join.near_duplicates(docs).collect()
    assert count_of((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_groups(ROWS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_groups_around_the_threshold(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(r.choice([40, 80, 160]))]
        variants = [base]
        for _ in range(60):
            w = list(r.choice(variants[-8:]) if r.random() < 0.3 else base)
            for _ in range(r.randint(0, max(3, len(w) // 14))):  # about as many changes as a link allows, and more
                w[r.randrange(len(w))] = f"new{r.randrange(12) if r.random() < 0.3 else r.random()}"
            w = w[: len(w) - r.choice([0, 0, 0, 5])] + [f"tail{r.random()}"] * r.choice([0, 0, 2])
            variants.append(w)
        rows += [(len(rows) + i, " ".join(v)) for i, v in enumerate(variants)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.near_duplicates(df).collect()
    want = expected_groups(rows)
    assert len({k[2] for k in want}) > 10
    assert count_of((x.doc_id, x.n_shingles, x.component_id) for x in got) == want


def test_prefixes_share_enough():
    rng = np.random.default_rng(3)
    classes = (rng.random(1 << jaccard_join.MIN_BITS) < 0.3).astype(np.int8)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            (pa, _, ma), (pb, _, mb) = jaccard_join.prefix(a, classes), jaccard_join.prefix(b, classes)
            assert len(np.intersect1d(pa, pb)) >= min(ma, mb)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {k: [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in ROWS if r[0] == k] for k in {r[0] for r in ROWS}}
    got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    for k, v in ids.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id == k)
        assert sum(r[1] for r in mine) == sum(map(len, v))
        for start, length, crc, total, piece in mine:
            part = v[0][start : start + length]
            assert total == len(v[0]) and part.tolist() == piece and zlib.crc32(part.tobytes()) == crc
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [0, *itertools.accumulate(n for _, n in v)][:-1]
        assert sum(n for _, n in v) <= 2048 and len(v) <= packing.SEGMENTS


def test_packing_pads_little_whatever_the_partitions(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(r.choice([5, 60, 400, 900, 5000])))) for i in range(700)]
    sizes = None
    for n in (1, 8, 64, 211):
        got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), vocabulary("word_bpe_49k.json")).collect()
        assert sum(x.length for x in got) == (sizes := sizes or sum(x.length for x in got))
        assert 1 - sizes / (2048 * len({x.sequence_id for x in got})) < 0.01
        again = collections.defaultdict(int)
        for x in got:
            again[x.sequence_id] += x.length
        assert max(again.values()) <= 2048


def test_packing_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json")).count() == 0


def test_piece_memory_beyond_its_cap(monkeypatch):
    monkeypatch.setattr(packing.Ids, "KEEP", 3)
    ids = packing.Ids(vocabulary("word_bpe_49k.json"))
    for batch in (["one two three four five", "six seven"], ["one two", "eight nine"], ["one two three", "don't", "", "five ten, 12"]):
        expected = [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
        assert ids.encode(batch) == expected


def test_packer_keeps_every_limit():
    cut = lambda x, n: ((x[0], n), (x[0], x[1] - n), n)
    p = packing.Packer(cut, tokens=100, segments=4, loss=60, pool=8)
    placed = [x for i in range(200) for x in p.add((i, 1 + 7 * i % 90), 1 + 7 * i % 90, 1 + 7 * i % 90)] + list(p.close())
    load = collections.Counter()
    for (_, n), s, _ in placed:
        load[s] += n
    assert sum(load.values()) == sum(1 + 7 * i % 90 for i in range(200))
    assert max(load.values()) <= 60 and max(collections.Counter(s for _, s, _ in placed).values()) <= 4


def test_sharding(docs, spark):
    got = sharding.shard_by_bytes(docs).collect()
    assert count_of((r.doc_id, r.size, r.text_crc32) for r in got) == count_of((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, F.lit("same text " * 20)).otherwise(F.repeat(F.hex(F.xxhash64("id")), 20)).alias("text"))
    rows = sharding.shard_by_bytes(many).collect()
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * min(size.values())
    assert len({r.shard for r in rows if r.doc_id < 300}) == 1


def test_sharding_cuts_overfull_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 2)
    monkeypatch.setattr(sharding, "MIN_RANGES", 256)
    found = []
    whole = sharding._parts
    monkeypatch.setattr(sharding, "_parts", lambda *a: found.append(whole(*a)) or found[0])
    # Many texts of unequal size, and one text that is a quarter of all bytes.
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("the same text " * 40)).otherwise(F.repeat(F.hex(F.xxhash64("id")), (F.col("id") % 40).cast("int"))).alias("text"))
    got = sharding.shard_by_bytes(rows).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert any(n > 1 for _, n in found[0])
    assert len(got) == 5000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) < 1.15 * min(size.values())


def test_language_id(spark):
    rows = [(i, sentence(30, "en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(300)] + [(900, None, "en"), (901, "12 !!", None), (902, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df, language_id.learnable())).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:300]]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}


def test_language_id_learns_every_language(spark, monkeypatch):
    rng = random.Random(3)
    own = {f"l{k:02}": [rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") + rng.choice("bcdfghjklmnprstvz") for _ in range(4)] for k in range(70)}
    rows = [(200 * k + i, " ".join("".join(rng.choices(v, k=2)) for _ in range(40)), lang) for k, (lang, v) in enumerate(own.items()) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (64_000, 4 * 70):
        monkeypatch.setattr(language_id, "MAX_ROWS", most)
        model = language_id.train(df, F.lit(True))
        assert model.langs == sorted(own)
        got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
        assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9


def test_codewords_are_apart():
    for k in (2, 4, 6, 20):
        m = language_id.codewords(k)
        assert len({tuple(r) for r in m}) == k


def test_quality_classifier(spark):
    rows = [(i, sentence(40) if i % 2 else " ".join(x + "***" for x in sentence(40).split())) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.rule_ensemble(df, labels, "quality", quality_classifier.learnable()).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(400)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    none = quality_classifier.rule_ensemble(df, labels.limit(0), "quality").select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_html_extraction(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<div id=main class='post-12'><h1>Title &amp; more</h1><p>One  two<br>three <span class='ad'>buy</span> four<p>Five<ul><li>six<li>seven</ul><form><input>go</form>"
        "<script>var a='<p>no</p>'</script></div><aside>side</aside><section class='comments'><p>nice!</p></section><footer>f</footer></body></html>"
    )
    rows = [(i, "http://a.example/1", page) for i in range(20)] + [(50, None, None), (51, "http://a.example/2", ""), (52, "http://b.example/", "just text &lt;b&gt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.consensus_extract(df).collect()}
    assert got[3].text == "Title & more One two three four Five six seven" and got[3].n_chars == len(got[3].text)
    assert (got[50].text, got[51].text, got[52].text) == ("", "", "just text <b>")


@pytest.mark.parametrize("mark", ["class='content no-sidebar'", "class=has-sidebar", "id=ad-free", "class='post-share-enabled'", "class='page with-comments'"])
def test_html_names_that_only_contain_a_boilerplate_word(mark):
    page = f"<body><div {mark}><p>The article</p></div><p>and a line of its own that is longer than the article is</p></body>"
    assert "The article" in " ".join(t for _, t in html_extraction.parse(page)[1])


@pytest.mark.parametrize("mark", ["class=sidebar", "class='site-footer x'", "id=cookie-notice", "class=ad-728x90", "role=search"])
def test_html_boilerplate_is_left_out(mark):
    page = f"<body><div {mark}><p>Not this</p></div><p>a line of text that is longer than the other one</p></body>"
    assert html_extraction.extract(page, []) == "a line of text that is longer than the other one"


def test_html_keeps_captions_formulas_and_text_that_is_alone():
    page = "<article><p>See</p><figure><img><figcaption>A map</figcaption></figure><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>"
    assert html_extraction.extract(page, []) == "See A map where x=2 holds"
    long = "all of the text of this page " * 5
    for tag in ("form", "div hidden", "header", "div class=notice"):
        page = f"<body><{tag}><div class=x><nav>menu</nav><p>{long}</p></div></{tag.split()[0]}></body>"
        assert html_extraction.extract(page, []) == long.strip()
    for tag in ("nav", "footer", "aside", "section class=comments", "div class=sidebar", "span class=ad"):
        page = f"<body><{tag}><div class=x><p>{long}</p></div></{tag.split()[0]}></body>"
        assert html_extraction.extract(page, []) == ""


def test_html_words_across_images_and_several_containers():
    assert html_extraction.extract("<body><p>foo<img>bar<wbr>baz<br>end</p></body>", []) == "foobarbaz end"
    assert html_extraction.extract("<body><fieldset><p>in a box</p></fieldset></body>", []) == "in a box"
    first, second = "the first part of the article " * 9, "and its end " * 4
    page = f"<body><nav><a>m</a></nav><div class=part-one><p>{first}</p></div><div class=part-two><p>{second}</p></div><footer>f</footer></body>"
    assert html_extraction.extract(page, []) == f"{first}{second}".strip()


def plain_article(parts: list) -> str:
    """The expected text of a page made of (is article, html, text) parts."""
    return " ".join(t for article, _, t in parts if article)


@pytest.mark.parametrize("seed", range(6))
def test_html_pages_with_more_boilerplate_than_article(spark, seed):
    r, rows, want = random.Random(seed), [], {}
    shapes = {"comments": "<section class=comments><p>{}</p><div><p>{}</p></div></section>", "footer": "<footer><p>{}</p><p>{}</p></footer>", "aside": "<aside><div>{}</div><p>{}</p></aside>", "nav": "<nav><ul><li>{}<li>{}</ul></nav>", "ad": "<div class='ad-728x90'><p>{} {}</p></div>", "form": "<form><p>{}</p><input name=q>{}</form>", "cookie": "<div id=cookie-notice>{} {}</div>"}
    for k in range(12):
        parts = []
        for _ in range(r.randint(2, 5)):
            t = sentence(r.randint(8, 25))
            parts.append((True, f"<p>{t}", t))
            if r.random() < 0.7:
                parts.append((False, shapes[r.choice(list(shapes))].format(sentence(r.randint(10, 80)), sentence(r.randint(10, 80))), ""))
        around = r.choice(["<article>{}</article>", "<main><div class='post-{}'>{{}}</div></main>".format(k), "<div class=content>{}</div>"])
        rows.append((k, f"http://h{seed}.example/{k}", f"<html><head><title>x</title></head><body><header>Site</header>{around.format(''.join(h for _, h, _ in parts))}<footer>{sentence(60)}</footer><section class='comments'>{sentence(150)}</section></body></html>"))
        want[k] = plain_article(parts)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit(1), "paths": F.lit(2), "votes": F.lit(3)})
    assert {x.page_id: x.text for x in html_extraction.consensus_extract(df).collect()} == want


def test_html_empty_table(spark):
    assert html_extraction.consensus_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_text_after_a_deep_nest():
    for n in (10, 600, 3000):
        for nest in ("<div>" * n + "deep" + "</div>" * n, "<div><b>" * n + "deep" + "</b></div>" * n):
            page = f"<body><div class=main>{nest}<p>after the nest</p></div><div>other</div></body>"
            assert html_extraction.extract(page, [["html>body>div.main"]]) == "deep after the nest"
    for n in (10, 600):
        page = "<body><div class=main>" + "<div>" * n + "deep<footer>foot <b>note</b></footer> down" + "</div>" * n + "<p>after the nest</p></div></body>"
        assert html_extraction.extract(page, []) == "deep down after the nest"


def test_decontamination(spark):
    item = "A train travels at 60 km per hour for 3 hours from Boston. How far does it go in 3 hours at 60 km per hour?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, "what is six plus seven")], "item_id long, text string")
    texts = [
        item.upper().lower(),
        "Well. A train travels at 75 km per hour for 4 hours from Dallas. How far does it go in 4 hours at 75 km per hour? Yes.",
        "A train travels at 75 km per hour for 4 hours from Dallas. How far does it go in 9 hours at 12 km per hour?",
        None, "", sentence(300), "so what is six plus seven then",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.leaks(df, bench).collect()}
    assert (1, 1) in got and got[1, 1] == "reparameterised" and (2, 1) not in got and got[6, 5] == "verbatim"
    assert not {d for d, _ in got} & {3, 4, 5}
    assert sorted(r.doc_id for r in decontamination.drop_leaked(df, bench).collect() if r.doc_id is not None) == sorted(set(range(7)) - {d for d, _ in got})
    assert decontamination.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_of_two_variants(spark):
    item = "A train travels at 60 km per hour for 3 hours from Boston. How far does it go in 3 hours at 60 km per hour?"
    variant = "A train travels at 75 km per hour for 4 days from Dallas. How far does it go in 4 days at 75 km per hour?"
    third = "A train travels at 80 km per hour for 9 weeks from New York City. How far does it go in 9 weeks at 80 km per hour?"
    texts = [f"{item} {variant}", f"{variant} And then more. {item}", f"{variant} {third}", f"{third} {variant} {sentence(50)} {item}", sentence(300),
             "A train travels at 75 km per hour for 4 hours from Dallas. How far does it go in 9 hours at 12 km per hour?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert sorted(got) == [(0, 1, "verbatim"), (1, 1, "verbatim"), (2, 1, "reparameterised"), (3, 1, "verbatim")]


def test_decontamination_of_long_excerpts(spark):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("l", "m", "n", "p", "r", "s", "t", "v", "x", "z", "k", "q")] * 5
    item = " ".join(w + "abcde"[i // 60] * 2 for i, w in enumerate(words))  # 300 different words
    of = lambda a, n: "so " + " ".join(item.split()[a : a + n]) + " then"
    numbers = " ".join(str(100 + i) for i in range(60)) + " " + item
    texts = [of(30, 25), of(100, 109), of(50, 15), of(7, 20), of(50, 15) + of(90, 15), " ".join(str(500 + i) for i in range(40)), of(299, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.kind, r.n_windows) for r in decontamination.leaks(df, spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")).collect()]
    assert sorted(got) == [(d, i, "verbatim", n) for d, n in ((0, 18), (1, 102), (3, 13)) for i in (1, 2)]


@pytest.mark.parametrize("op", [quality_rules.divergence_rules, substring_dedup.remove_repeated_windows, suffix_dedup.remove_repeated_bytes, jaccard_join.near_duplicates, sharding.shard_by_bytes])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 8 in ids and not set(range(9, 20)) & set(ids)
    rest = corpus_pipeline.repeated_passages(spark, kept, "")
    assert rest.columns == docs.columns and rest.count() > 0


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    lowest = collections.defaultdict(set)
    for doc, n, component in expected_groups(ROWS):
        lowest[doc].add(component if n else doc)
    assert count_of(r.doc_id for r in kept) == count_of(doc for doc, own in lowest.items() if doc in own)
    assert {(r.doc_id, r.text) for r in kept} <= {r[:2] for r in ROWS}

    # Passages: a 35-word window stays only where it begins first, by doc_id and place.
    w = {r.doc_id: words(r.text) for r in kept}
    first: dict = {}
    for doc in sorted(w, key=lambda d: (d is not None, d or 0)):
        for i in range(len(w[doc]) - 34):
            first.setdefault(tuple(w[doc][i : i + 35]), (doc, i))
    want = {}
    for doc, x in w.items():
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 34):
            if first[tuple(x[i : i + 35])] != (doc, i):
                gone[i : i + 35] = True
        if not x or not gone.all():
            want[doc] = [v for v, g in zip(x, gone, strict=True) if not g]
    rest = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(kept, docs.schema), "").collect()
    assert {r.doc_id: words(r.text) for r in rest} == want


def test_language_id_decodes_the_nearest_codeword_by_weighted_loss():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(90, 40))).astype(np.float32)
    langs = ["aa", "bb", "cc"]
    own = np.repeat(np.arange(3), 30)
    x[np.arange(90), own] += 6
    model = language_id.fit(x, [langs[k] for k in own])
    p = model.decode(x)
    assert (p.argmax(1) == own).mean() > 0.95 and np.allclose(p.sum(1), 1, atol=1e-4)
    for row, mine in zip(x, p, strict=True):
        loss = [sum(t * np.log1p(np.exp(-c * (row @ model.w[:, k] + model.bias[k]))) for k, (c, t) in enumerate(zip(code, model.trust, strict=True))) for code in model.code]
        assert int(np.argmin(loss)) == mine.argmax()


def test_pipeline_stages_with_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline

    names = ["score", "predicted", "n_words", "n_removed", "kept_sha256", "row_key", "carry"]
    clash = docs.select("doc_id", "text", "lang", *[F.lit(7.0).alias(n) for n in names])
    spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    item = ROWS[40][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, clash, f"file://{tmp_path}")
        assert got.columns == clash.columns, name
        rows = got.collect()
        assert rows and all(r[n] == 7.0 for r in rows for n in names), name
    assert corpus_pipeline.pack(spark, clash, "").agg(F.count_distinct("doc_id")).first()[0] == len({r[0] for r in ROWS} - {None})


@pytest.mark.parametrize("op", [substring_dedup.remove_repeated_windows, suffix_dedup.remove_repeated_bytes])
def test_many_equal_rows(spark, op):
    df = spark.createDataFrame([(1, ROWS[-4][1])] * 300, SCHEMA.split(", lang")[0])
    got = op(df)
    assert got.count() == 300 and got.where("n_removed = 0").count() == 0


def test_small_buckets_are_judged_together(spark):
    r = np.random.default_rng(21)
    body = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    shared = [body(500) for _ in range(40)]
    rows = [(10 * i + j, body(149 + 10 * j) + f"{j}{s}{j}" + body(200)) for i, s in enumerate(shared) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, calls = [], []
    for together in (0, suffix_dedup.BYTES.together):
        seen = spark.sparkContext.accumulator(0)

        def counted(strings, counts, seen=seen):
            seen.add(1)
            return suffix_dedup.longest_previous(strings, counts)

        spans = repeats.repeated_spans(docs, repeats.Units("bytes", 400, 32, together), counted)
        held = lambda row: sorted({p for h in row["hits"] or () for p in range(h["s"], h["s"] + h["n"])})
        got.append({row["doc_id"]: held(row) for row in spans.collect()})
        calls.append(seen.value)
    want = {10 * i + j: list(range(150 + 10 * j, 251 + 10 * j)) for i in range(40) for j in range(3)}
    assert got == [want, want]
    assert calls[1] < calls[0] / 4


@pytest.mark.parametrize("op", [substring_dedup.remove_repeated_windows, suffix_dedup.remove_repeated_bytes])
def test_super_k_mers_go_before_the_strings_are_packed(docs, op, monkeypatch):
    """What is stored at once: the cut super-k-mers and their counts are not kept beside the packed strings."""
    left = []

    def pack(cand, units, real=repeats._pack_rows):
        left.extend(p for p in common._made if p not in before and ("-superkmers-" in p or "-minimisers-" in p))
        return real(cand, units)

    before = set(common._made)
    monkeypatch.setattr(repeats, "_pack_rows", pack)
    assert op(docs).count() == docs.count()
    assert not left


def test_jobs_of_the_jaccard_join(spark):
    """The driver plans every job: comparing stored pairs takes few of them, as does a round of the components."""
    edges = common.materialize(spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(100, i) for i in range(101, 120)], "a long, b long"), "edges-of-test")
    sets = common.materialize(spark.createDataFrame([(i, bytearray(np.arange(i, i + 40, dtype=np.uint64).tobytes())) for i in range(1, 120)], "node long, shingles binary"), "sets-of-test")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert {(r.a, r.b): (r.na, r.nb, r.both) for r in jaccard_join.compare(edges, sets).collect()} == {(a, b): (40, 40, max(0, 40 - b + a)) for a, b in edges.collect()}
    assert jobs() - before < 13
    assert {r.node: r.comp for r in jaccard_join.connected_components(edges).collect()} == {i: 1 if i < 10 else 100 for i in [*range(1, 10), *range(100, 120)]}
