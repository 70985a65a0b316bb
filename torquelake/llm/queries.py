"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.llm import (
    bpe_codec,
    decontamination,
    html_extraction,
    importance_resampling,
    jaccard_join,
    language_id,
    merkle_manifest,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
)
from torquelake.llm.common import fold, load


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.divergence_rules(load(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs, language_id.learnable()))
    return found.select("doc_id", (~language_id.learnable()).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.consensus_extract(load(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(load(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(load(spark, sf_dir, "documents")).drop("kept_text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(load(spark, sf_dir, "documents")).drop("kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = quality_classifier.rule_ensemble(docs, labels, "quality", quality_classifier.learnable())
    return scored.select("doc_id", (~quality_classifier.learnable()).alias("held_out"), "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents")).drop("node")


def vocabulary(name: str) -> str:
    """A tokenizer's file, from the installed package or the folder in TOKENIZERS_DIR."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, docs = merkle_manifest, load(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold("doc_id", 3) == 0, m.leaf_digest(*[lowered if f == "text" else F.col(f) for f in fields]))
    found = m.manifest(docs, m.leaf_digest(*[F.col(f) for f in fields]), "lang", ["doc_id"], {"tampered": tampered})
    found = found.withColumn("folded_root", m.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(m.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_codec.round_trip(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    ids, text = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), ids, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_bpe_codec": op13_bpe_codec,
}

_WORDS = r"regexp_extract_all(coalesce(%s, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS % "text"} AS ws FROM documents),
      win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
      dup AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
      gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN dup USING (k), (SELECT unnest(range(35)) AS j)),
      each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
      kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS % "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS ws FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
      e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
      e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e2.b FROM r JOIN e2 ON r.y = e2.a)
      SELECT x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON r.x = n.doc_id GROUP BY x""",
}


def _quality_sql() -> str:
    q, pick = quality_rules, lambda p: f"length(regexp_replace(t, '[^{p[1:-1]}]', '', 'g'))"
    classes = {"upper": r"[\p{Lu}]"} | {k: v for k, v in q.CLASSES.items() if k != "upper"}
    part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"""WITH w AS (SELECT doc_id, coalesce(lang, '{q.NO_LANG}') AS lang, coalesce("text", '') AS t, {_WORDS % '"text"'} AS ws FROM documents),
      win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
      dup AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
      rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN dup USING (doc_id, k), (SELECT unnest(range(3)) AS j) GROUP BY doc_id),
      b AS (SELECT doc_id, lang, t, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {pick(q.CLASSES['symbol'])} AS n_symbols,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
      s AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, len(ls) - len(list_distinct(ls)) AS n_dup_lines, list_transform(ws, lambda x: lower(x)) AS lw,
          [{', '.join(pick(p) for p in classes.values())}] AS cs FROM b),
      wc AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(lw) AS w FROM s) GROUP BY ALL),
      lists AS (SELECT lang, list(w ORDER BY r) AS words FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS r FROM wc) WHERE r <= {q.COMMON} GROUP BY lang),
      h AS (SELECT doc_id, lang, base_failed, 'class' AS kind, unnest(range(1, {len(q.CLASS_NAMES) + 1})) AS i, unnest(list_append(cs, length(t) - list_sum(cs))) AS c, length(t) AS total FROM s
        UNION ALL SELECT doc_id, lang, base_failed, 'word', unnest(range(1, len(wc) + 2)), unnest(list_append(wc, n_words - coalesce(list_sum(wc), 0))), n_words
        FROM (SELECT doc_id, s.lang, base_failed, n_words, list_transform(coalesce(words, []), lambda x: len(list_filter(lw, lambda y: y = x))) AS wc FROM s LEFT JOIN lists ON s.lang = lists.lang)),
      sh AS (SELECT doc_id, lang, base_failed, kind, i, CASE WHEN total > 0 THEN c / total::DOUBLE ELSE 0 END AS p FROM h),
      ref AS (SELECT lang, kind, i, avg(p) AS q FROM sh WHERE NOT base_failed GROUP BY ALL),
      d AS (SELECT doc_id, kind, sqrt(greatest(0, sum(({part.format(a='p', b='q')} + {part.format(a='q', b='p')}) / 2))) AS d FROM sh JOIN ref USING (lang, kind, i) GROUP BY ALL),
      j AS (SELECT s.*, CASE WHEN length(t) >= {q.MIN_CHARS_FOR_CLASSES} THEN x.d END AS cd, CASE WHEN n_words >= {q.MIN_WORDS_FOR_COMMON} THEN y.d END AS wd
        FROM s LEFT JOIN d x ON s.doc_id = x.doc_id AND x.kind = 'class' LEFT JOIN d y ON s.doc_id = y.doc_id AND y.kind = 'word')
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(cd > {q.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(wd > {q.MAX_WORD_DISTANCE}, false) AS kept,
        round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM j"""


ORACLES["op5_quality_rules"] = _quality_sql()


# crc32 of the bytes whose hexadecimal digits are {}, byte by byte over the table of the CTE ``crc``.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len({0}) // 2 + 1), lambda i: "
    "(16 * (instr('0123456789ABCDEF', substr({0}, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr({0}, 2 * i, 1)) - 1)::BIGINT)), "
    "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
)


def _resampling_sql() -> str:
    r, word = importance_resampling, r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    found = "SELECT {id}, regexp_extract_all(" + _LOWER_AZ.format("coalesce(\"text\", '')") + f", {word}) AS w FROM {{table}}"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    ratio = f"((t + 1)::DOUBLE * (bt + {r.BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (tt + {r.BUCKETS})::DOUBLE)"
    return f"""WITH {_CRC_TABLE},
      dw AS ({found.format(id="doc_id", table="documents")}),
      df AS (SELECT doc_id, unnest({runs}) AS f FROM dw),
      tf AS (SELECT unnest({runs}) AS f FROM ({found.format(id="item_id", table="benchmark")})),
      b AS (SELECT f, {_CRC.format("h")} % {r.BUCKETS} AS b FROM (SELECT f, hex(f) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)), crc),
      sn AS (SELECT b, count(*) AS n FROM df JOIN b USING (f) GROUP BY b),
      tn AS (SELECT b, count(*) AS n FROM tf JOIN b USING (f) GROUP BY b),
      tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM sn) AS bt, (SELECT coalesce(sum(n), 0) FROM tn) AS tt),
      g AS (SELECT b, floor(1000 * ln({ratio}))::BIGINT AS g FROM (SELECT b, coalesce(sn.n, 0) AS s, coalesce(tn.n, 0) AS t FROM sn FULL JOIN tn USING (b)), tot),
      wt AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS total FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY doc_id),
      sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('{r.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS gum FROM dw LEFT JOIN wt USING (doc_id)),
      rk AS (SELECT doc_id, row_number() OVER (ORDER BY weight + gum DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_words >= {r.MIN_WORDS})
      SELECT doc_id, n_features, weight, weight + gum AS score, CASE WHEN r <= {r.PERCENT} * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""


def _manifest_sql() -> str:
    framed = lambda c: f"""coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"""
    leaf = lambda text: "sha256(" + " || ".join([*map(framed, ("doc_id", "source", "lang", "n_chars")), framed(text)]) + ")"
    up = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')))"
    of = "nodes[8 * (i // 8) + 1:i]", "nodes[i + 2:8 * (i // 8) + 8]"
    return f"""WITH RECURSIVE {_CRC_TABLE},
      leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('"text"')} AS leaf,
        CASE WHEN {_CRC.format("hex(doc_id::VARCHAR)")} % 3 = 0 THEN {leaf(_LOWER_AZ.format('"text"'))} ELSE {leaf('"text"')} END AS tampered FROM documents, crc),
      placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
      tree(g, level, nodes) AS (SELECT g, 0, list(leaf ORDER BY pos) FROM placed GROUP BY g UNION ALL SELECT g, level + 1, {up} FROM tree WHERE len(nodes) > 1),
      subroots AS (SELECT g, nodes[1] AS subroot, level AS height FROM tree WHERE len(nodes) = 1),
      places AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS gpos FROM subroots),
      above(level, nodes) AS (SELECT 0, list(subroot ORDER BY g) FROM subroots UNION ALL SELECT level + 1, {up} FROM above WHERE len(nodes) > 1),
      step AS (SELECT g, level, nodes, false AS top FROM tree WHERE len(nodes) > 1 UNION ALL SELECT g, height + above.level, nodes, true FROM subroots, above WHERE len(nodes) > 1),
      walk(k, g, pos, gpos, height, level, proof, node) AS (SELECT row_number() OVER (), g, pos, gpos, height, 0, '', tampered FROM placed JOIN places USING (g) JOIN subroots USING (g)
        UNION ALL SELECT k, g, pos, gpos, height, level + 1, proof || l || r, sha256(l || node || r) FROM (
          SELECT k, g, pos, gpos, height, level, proof, node, array_to_string({of[0]}, '') AS l, array_to_string({of[1]}, '') AS r FROM (
            SELECT walk.*, nodes, CASE WHEN top THEN gpos // (8 ^ (walk.level - height))::BIGINT ELSE pos // (8 ^ walk.level)::BIGINT END AS i FROM walk JOIN step ON walk.g = step.g AND walk.level = step.level))),
      ends AS (SELECT g, pos, arg_max(proof, level) AS proof, arg_max(node, level) AS node FROM walk GROUP BY g, pos),
      r AS (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1)
      SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM placed JOIN ends USING (g, pos) JOIN subroots USING (g), r"""


ORACLES |= {"op11_merkle_manifest": _manifest_sql(), "op12_importance_resampling": _resampling_sql()}
