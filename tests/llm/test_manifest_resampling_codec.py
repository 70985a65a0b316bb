"""The Merkle manifest, importance resampling and the BPE codec against plain Python on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquelake.llm import bpe_codec, importance_resampling, merkle_manifest
from torquelake.llm.queries import op11_merkle_manifest, op12_importance_resampling, op13_bpe_codec, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, rank string, ids string"
R = random.Random(11)


def prose(n: int) -> str:
    return " ".join("".join(R.choice(["the", "ing", "é", "Er", "on", "A", "7", "-"]) for _ in range(R.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    texts: list = [None, "", " \n", "A", "x" * 50_000, "日本語 " * 3000, prose(8000), "don't <|endoftext|> stop", "!!! ???"]
    texts += [prose(R.randint(1, 60)) for _ in range(600)]
    texts += ["The same text, word for word, again and again: " * 5] * 200
    langs = [None, "", "en", "en", "en", "en", "é", "fr", "zz", *[f"l{k}" for k in range(9)]]
    rows = [(3 * i, t, langs[i % len(langs)], "web" if i % 3 else None, None if i % 5 == 0 else i, "p", "r", "i") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[20], (None, "Without an ID and Words", "en", None, 3, None, None, None), (6, "the id of another row", "en", "web", 1, "", "", "")]


ROWS = corpus()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(ROWS, SCHEMA).repartition(7).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "The ingon the er A7 the ing"), (2, None), (3, "the The the")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/none/benchmark.parquet")
    return at


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None


def plain_manifest() -> collections.Counter:
    def leaf(row, text):
        fields = [row[0], row[3], row[2], row[4], text]
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    groups = collections.defaultdict(list)
    for row in ROWS:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))

    def tree(nodes: list[str]):
        paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            up, own = [], []
            for a in range(0, len(nodes), 8):
                run = nodes[a : a + 8]
                for k in range(len(run)):
                    for o in owners[a + k]:
                        paths[o].append((run[:k], run[k + 1 :]))
                up.append(digest(*run))
                own.append([o for x in owners[a : a + 8] for o in x])
            nodes, owners = up, own
        return nodes[0], paths

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, mine, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + top
            node = leaf(row, lower(row[1])) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else mine
            for left, right in path:
                node = digest(*left, node, *right)
            out.append((row[0], mine, trees[g][0], root, digest(*(x for left, right in path for x in (*left, *right))), node, node == root))
    return collections.Counter(out)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_merkle_manifest(spark, tables, height, monkeypatch):
    whole = merkle_manifest.manifest
    monkeypatch.setattr(merkle_manifest, "manifest", lambda *a: whole(*a, height=height))
    got = op11_merkle_manifest(spark, tables).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_manifest()
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_traverse_returns_paths_that_fold_to_the_root():
    for n in (1, 2, 7, 8, 9, 64, 65, 300):
        leaves = [digest(str(k)) for k in range(n)]
        levels = merkle_manifest.levels_above(n, 9)
        root, paths = merkle_manifest.traverse(leaves, levels)
        assert {len(p) for p in paths} == {levels}
        for node, path in zip(leaves, paths, strict=True):
            for left, right in path:
                node = digest(left, node, right)
            assert node == root


def plain_resampling() -> collections.Counter:
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
        return w, [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]  # noqa: B905

    docs = [(row[0], *features(row[1])) for row in ROWS]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in docs:
        s.update(f)
    for text in ("The ingon the er A7 the ing", None, "the The the"):
        t.update(features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in s}
    scored = []
    for doc, w, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    eligible = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    rows = [(*x[:4], k + 1 if k < 25 * len(eligible) // 100 else None) for k, x in enumerate(eligible)]
    return collections.Counter(rows + [(*x[:4], None) for x in scored if x[4] < 20])


def test_importance_resampling(spark, tables):
    got = op12_importance_resampling(spark, tables).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_resampling()


def test_draw_with_many_ties(spark):
    rows = [(i, 1, 0, i % 3) for i in range(60)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    for percent, eligible in ((0, F.lit(True)), (50, F.col("doc_id") % 2 == 0), (100, F.lit(True)), (50, F.lit(False))):
        got = {r.doc_id: r["rank"] for r in importance_resampling.draw(scored, eligible, percent).collect()}
        pool = sorted((r for r in rows if r[0] % 2 == 0 or percent != 50), key=lambda r: (-r[3], r[0])) if "false" not in str(eligible) else []
        assert {k: v for k, v in got.items() if v} == {r[0]: k + 1 for k, r in enumerate(pool[: percent * len(pool) // 100])}
        assert len(got) == 60


def test_gains_count_every_feature():
    hashes, n = importance_resampling.feature_hashes("A b\x00c É", longest=3)
    assert n == 4 and hashes.tolist() == [zlib.crc32(x.encode()) for x in ("a", "b", "c", "É", "a b", "b c", "c É", "a b c", "b c É")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_bpe_round_trip(spark, tables, library):
    got = op13_bpe_codec(spark, tables).collect()
    want = []
    for row in ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_bpe_encode_and_decode_keep_other_columns(spark, tables, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 60")
    coded = bpe_codec.encode(docs, vocabulary("byte_bpe_50k.json"))
    assert set(coded.columns) == set(docs.columns)
    back = bpe_codec.decode(coded, vocabulary("byte_bpe_50k.json")).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == docs.count()


def test_bpe_against_the_library_on_hard_texts(library):
    r = random.Random(5)
    parts = ["a", "A", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", "日本", "😀", "́", "\x85", "\xa0", "\x1c", "\x0b", "0", "²", "Ⅷ", "the", "ing", "--", "====", "<|endoftext|>", "<|", "ſ", "Dž", "ƻ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x250), r.randrange(0xD800), r.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(3000)]
    texts += ["".join(r.choice("abcdeiostn") for _ in range(r.randint(1, 40))) for _ in range(5000)]
    texts += [c * k for c in ("a", " ", "ab", "-", "é") for k in (*range(70), 1000)]
    codec = bpe_codec.Codec(vocabulary("byte_bpe_50k.json"))
    for codec.KEEP in (1_000_000, 3):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_verification_is_exact_and_both_merges_agree():
    r = random.Random(6)
    codec = bpe_codec.Codec(vocabulary("byte_bpe_50k.json"))
    words = list({"".join(r.choice("aeinorst e") for _ in range(r.randint(1, 14))).encode() for _ in range(20_000)})
    exact = codec.merge_all(words)
    assert exact == [np.array(codec.merge(w), "<u4").tobytes() for w in words]
    proposals = [codec.propose(w) for w in words]
    good = [bool(codec.compatible(p[:-1], p[1:]).all()) for p in proposals]
    assert good == [np.array(p, "<u4").tobytes() == e for p, e in zip(proposals, exact, strict=True)]
    assert 0.05 < np.mean(good) < 0.95


def test_bpe_decodes_what_is_no_text(library):
    codec = bpe_codec.Codec(vocabulary("byte_bpe_50k.json"))
    r = random.Random(7)
    for _ in range(300):
        ids = [r.choice([r.randrange(256), r.randrange(50257)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("query", [op11_merkle_manifest, op12_importance_resampling, op13_bpe_codec])
def test_empty_tables(spark, tables, query):
    assert query(spark, f"{tables}/none").count() == 0
