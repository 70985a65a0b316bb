"""Benchmark decontamination by template canonicalisation (native: DataFrame functions only).

1. Numbers, units after numbers, and names (capitalised words inside a sentence) become typed
   placeholders; everything is lower-cased, marks are dropped, so documents and items turn into
   token templates.
2. Hashed windows of template tokens of all documents meet those of the benchmark in a hash join.
   An item shorter than a window is one window of its own length.
3. Windows of one item in one document are aligned by their shift, the place in the document less
   that in the item. Each shift alone, each range of ``DRIFTS`` shifts (values of other lengths move
   what follows them) and the whole document are an occurrence. An item counts as leaked when in any
   of them enough of its windows occur and its slots are consistent, that is, each value of the item
   stands for one value throughout. Equal values mean a verbatim leak, others a re-parameterised one.
   ``MIN_RUN`` windows in a row at one shift with equal values are a leak whatever their share (an
   excerpt). The passing occurrence with the most windows is reported, a verbatim one first among equals.

The benchmark's windows are broadcast only if there are at most ``MAX_BROADCAST_WINDOWS`` of them;
otherwise Spark shuffles both sides by hash. Only matched windows move in any case.

Defined results: null or empty texts match nothing; items of fewer than ``MIN_WINDOW`` tokens match
nothing; repeated documents are found each, repeated items each; an empty table on either side gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import let, materialize, text_or_empty

WINDOW, MIN_WINDOW = 8, 5
#: Share of an item's windows that must occur in a document, and share of consistent slots.
MIN_COVERAGE, MIN_CONSISTENT = 0.35, 0.8
#: Verbatim windows in a row that are a leak by themselves: 20 tokens.
MIN_RUN = 20 - WINDOW + 1
MAX_BROADCAST_WINDOWS = 1_000_000
#: Widths of the ranges of shifts, each less than the item's length at most, so that copies in a row stay apart.
DRIFTS = (0, 4, 16)

#: Placeholders: one private character, followed by the value until it is stripped.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_PRIVATE = r"\x{E000}-\x{E002}"
#: Unit words that count as units after a number.
UNITS = (
    "km m cm mm mi miles mile ft feet foot in inch inches yd yards kg g mg lb lbs oz tons ton l ml litres liters gallons gal "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kmh km/h m/s kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa bar psi c f k usd eur gbp dollars dollar cents euros pounds percent"
).split()


def canonical(text: Column) -> Column:
    """The text with typed placeholders that still carry their values, lower-cased, without marks, tokens parted by one space."""
    private = text.contains(NUMBER) | text.contains(NAME) | text.contains(UNIT)
    t = F.when(private, F.regexp_replace(text, f"[{_PRIVATE}]", " ")).otherwise(text)
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})[\p{Ll}'-]+", NAME + "$0")
    t = F.lower(F.regexp_replace(t, r"[0-9]+(?:[.,:/][0-9]+)*", f" {NUMBER}$0 "))
    unit = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))

    def valued(x: Column) -> Column:
        with_units = F.regexp_replace(x, rf"({NUMBER}[^ ]+ ) *({unit}|[%$€£°])(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2 ")
        # Marks inside a number become "_", so that a value remains one token.
        return F.when(x.contains(NUMBER), F.regexp_replace(with_units, r"(?<=[0-9])[.,:/](?=[0-9])", "_")).otherwise(x)

    t = let(t, valued)
    kept = rf"a-z0-9\p{{L}}\p{{M}}\p{{N}}{_PRIVATE}_"
    t = F.regexp_replace(t, rf" [^{kept}]+|(?![a-z])[^{kept} ](?<!{UNIT}[^{kept}])[^{kept}]*", " ")
    return F.trim(t)


def _template(values: Column) -> Column:
    return F.regexp_replace(values, f"([{_PRIVATE}])[^ ]*", "$1")


def windows(df: DataFrame, key: str, text: str, exact: bool, length: int) -> DataFrame:
    """key, pos, h of all windows of ``length`` tokens; with ``exact``, of texts whose windows have that length.

    Shifted copies of the token hashes are zipped and hashed by row, which stays in generated code.
    """
    tokens = F.split(_template(F.nullif(F.col(text), F.lit(""))), " ")
    at = df.select(F.col(key), F.transform(tokens, lambda x: F.xxhash64(x)).alias("_h"))
    if exact:
        at = at.where(F.least(F.size("_h"), F.lit(WINDOW)) == length)
    shifted = F.arrays_zip(F.col("_h").alias("_t0"), *[F.slice("_h", i + 1, F.size("_h")).alias(f"_t{i}") for i in range(1, length)])
    each = at.where(F.size("_h") >= length).select(key, F.posexplode(shifted).alias("pos", "_w")).where(f"_w._t{length - 1} IS NOT NULL")
    return each.select(key, "pos", F.xxhash64(*[F.col(f"_w._t{i}") for i in range(length)]).alias("h"))


def slots_at(text: str, at: Column, length: Column) -> Column:
    """The placeholders with values of the window of ``length`` tokens at ``at`` of a canonical text."""
    return let(F.split(F.col(text), " "), lambda v: F.filter(F.slice(v, at + 1, length), lambda x: x.rlike(f"^[{_PRIVATE}]")))


def occurrences(hits: DataFrame) -> DataFrame:
    """_key, _item, shift and each occurrence it belongs to: the width (-1: the whole document) and the first shift of a range."""
    shifts = hits.select("_key", "_item", "shift", "_n").distinct()
    for d in DRIFTS:
        w = Window.partitionBy("_key", "_item").orderBy("shift").rangeBetween(-d, 0)
        near = F.filter(F.collect_set("shift").over(w), lambda a: a > F.col("shift") - F.col("_n"))
        shifts = shifts.withColumn(f"_d{d}", F.transform(near, lambda a, d=d: F.struct(F.lit(d).alias("width"), a.alias("first"))))
    whole = F.array(F.struct(F.lit(-1).alias("width"), F.lit(0).alias("first")))
    return shifts.select("_key", "_item", "shift", F.explode(F.concat(whole, *[F.col(f"_d{d}") for d in DRIFTS])).alias("_occ"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, windows found, the item's windows, coverage, slot consistency and kind of each leak."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), canonical(text_or_empty(text)).alias("_canon"))
    items = materialize(items, "benchmark-templates").withColumn("_n", F.when(F.length("_canon") > 0, F.size(F.split("_canon", " "))).otherwise(0))
    lengths = sorted(r[0] for r in items.where(F.col("_n") >= MIN_WINDOW).select(F.least(F.col("_n"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW values
    every = docs.select(F.xxhash64(doc_id, text).alias("_rk"), F.col(doc_id).alias("doc_id"), canonical(text_or_empty(text)).alias("_canon"))
    every = every.select(F.struct("_rk", "doc_id").alias("_key"), "_canon")
    parts = []
    for length in lengths or [WINDOW]:
        of_items = windows(items.select(F.struct("item", "item_id").alias("_item"), "_canon"), "_item", "_canon", True, length).withColumnRenamed("pos", "ipos")
        of_items = materialize(of_items, "benchmark-windows")
        if of_items.count() <= MAX_BROADCAST_WINDOWS:
            of_items = F.broadcast(of_items)
        of_docs = windows(every, "_key", "_canon", False, length)
        parts.append(of_docs.join(of_items, "h").select("_key", "_item", "pos", "ipos", F.lit(length).alias("length")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = materialize(hits, "template-hits")
    found = hits.groupBy("_key", "_item").agg(F.count_distinct("ipos").alias("n_windows"))
    total = items.select(F.struct("item", "item_id").alias("_item"), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(1)).cast("long").alias("item_windows"))
    # No occurrence has more windows than its document.
    covered = found.join(total, "_item").where((F.col("n_windows") / F.col("item_windows") >= MIN_COVERAGE) | (F.col("n_windows") >= MIN_RUN))
    lengths_of = items.select(F.struct("item", "item_id").alias("_item"), "_n")
    near = hits.join(covered.select("_key", "_item"), ["_key", "_item"], "left_semi").join(lengths_of, "_item").withColumn("shift", F.col("pos") - F.col("ipos"))
    near = materialize(near, "aligned-hits")
    members = materialize(occurrences(near), "occurrences")
    enough = near.select("_key", "_item", "shift", "ipos").distinct().join(members, ["_key", "_item", "shift"]).groupBy("_key", "_item", "_occ").agg(F.count_distinct("ipos").alias("n_windows"))
    enough = enough.join(total, "_item").withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= MIN_COVERAGE)
    # Slots of the item's windows that have any; then of the documents hit there, whose texts are read once more.
    item_texts = items.where(F.col("_canon").rlike(f"[{_PRIVATE}]")).select(F.struct("item", "item_id").alias("_item"), F.col("_canon").alias("_ic"))
    slotted = near.join(item_texts, "_item").withColumn("islots", slots_at("_ic", F.col("ipos"), F.col("length"))).where(F.size("islots") > 0).drop("_ic", "_n")
    slotted = materialize(slotted, "slotted-hits")
    if slotted.count() <= MAX_BROADCAST_WINDOWS // 10:
        slotted = F.broadcast(slotted)
    slots = every.join(slotted, "_key").withColumn("slots", slots_at("_canon", F.col("pos"), F.col("length")))
    slots = materialize(slots.where(F.size("slots") == F.size("islots")).select("_key", "_item", "shift", "ipos", "islots", "slots"), "slot-values")
    pairs = slots.select("_key", "_item", "shift", F.explode(F.arrays_zip("islots", "slots")).alias("z")).select("_key", "_item", "shift", F.col("z.islots").alias("was"), F.col("z.slots").alias("now")).distinct()
    pairs = pairs.join(members, ["_key", "_item", "shift"]).select("_key", "_item", "_occ", "was", "now").distinct()
    by_value = pairs.groupBy("_key", "_item", "_occ", "was").agg(F.count("*").alias("k"), F.max((F.col("was") == F.col("now")).cast("int")).alias("same"))
    slot = by_value.groupBy("_key", "_item", "_occ").agg(F.avg((F.col("k") == 1).cast("double")).alias("consistent"), F.min("same").alias("same"))
    out = enough.join(slot, ["_key", "_item", "_occ"], "left").withColumn("slot_consistency", F.coalesce("consistent", F.lit(1.0))).where(F.col("slot_consistency") >= MIN_CONSISTENT)
    of_run = ["_key", "_item", "shift", "ipos"]
    exact = near.select(of_run).distinct().join(slots.where(F.col("slots") != F.col("islots")).select(of_run), of_run, "left_anti")
    runs = exact.withColumn("_run", F.col("ipos") - F.row_number().over(Window.partitionBy("_key", "_item", "shift").orderBy("ipos")))
    runs = runs.groupBy("_key", "_item", "shift", "_run").agg(F.count("*").alias("n_windows")).where(F.col("n_windows") >= MIN_RUN).join(total, "_item")
    runs = runs.select("_key", "_item", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), F.lit(1.0).alias("slot_consistency"), F.lit(1).alias("same"))
    out = out.select(runs.columns).unionByName(runs)
    best = F.struct("n_windows", F.coalesce("same", F.lit(1)).alias("same"), "slot_consistency", "coverage", "item_windows")
    out = out.groupBy("_key", "_item").agg(F.max(best).alias("_best")).select("_key", "_item", "_best.*")
    return out.select(
        F.col("_key.doc_id").alias("doc_id"), F.col("_item.item_id").alias("item_id"), F.col("n_windows").cast("long").alias("n_windows"), "item_windows", "coverage", "slot_consistency",
        F.when(F.coalesce("same", F.lit(1)) == 1, "verbatim").otherwise("reparameterised").alias("kind"), F.col("_key._rk").alias("row_key"),
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item leaked, whatever columns it has."""
    found = leaks(docs, benchmark).select(F.col("row_key").alias("_leaked_row"), F.col("doc_id").alias("_leaked_id")).distinct()
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    kept = boxed.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_leaked_id")) & (F.col("_key") == F.col("_leaked_row")), "left_anti")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
