"""Mixing of sources to target weights, in whole blocks of tokens.

The documents of a source, in a fixed pseudorandom order, are one stream of
words cut into blocks of equal length, shorter ones where a source or its
target is small, so that a target is met to the word or a small part of it. The mix is a row of slots in output
shards. Each shard draws its sources' counts from a multinomial over the
targets; the sums of the draws are then settled on the whole-block targets, so
that no source falls short or runs over. A source's slots run through its
blocks once per pass, each pass in an own pseudorandom permutation of the
block indexes (swap-or-not rounds: exact for any number of blocks, without a
sort), and the blocks are joined by index.

Everything here is DataFrame functions; only one-row sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import BROADCAST_ROWS, WORD, level_buckets, numbered, running_start, save, scratch, word_count

#: Words per block where single words matter, and where documents should stay whole.
FINE_BLOCK, TEXT_BLOCK = 32, 2048
#: Blocks that a source's size and target hold at least, as far as single words allow.
LEAST_BLOCKS = 64
SHARD_SLOTS = 4096
#: Slots that one task makes out of the counts.
TASK_SLOTS = 100_000
#: Rounds of the permutation, and cells per lookup of a draw.
ROUNDS, CELLS = 20, 1024


@dataclass(frozen=True)
class Mix:
    """``sources`` (key, target, blocks, slots), ``slots`` (shard, source_no, pass, block), ``pieces`` (document parts by block)."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    sizes: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> tuple[DataFrame, int]:
    """Sources in code point order (null last) with their targets; also the number of sources.

    Every round gives the free sources one level per weight; those above
    ``max_repeats`` times their size are set to that bound, which raises the
    level of the others, until none is above.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int") + 1)
    sources = save(numbered(grouped, order, "source_no").withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(max_repeats)), "sources")
    count, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level, held = 0.0, -1
    while True:
        over = F.col("bound") <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count(F.when(over, 1)).alias("held"),
            F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0)).alias("bounds"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if row["held"] == held or not row["free"]:
            break
        held, level = row["held"], (total - row["bounds"]) / row["free"]
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target), count


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0..size-1 that depends on ``keys``."""

    def swap_or_not(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *keys), size) - x, size)
        larger = F.greatest(x, partner)
        return F.when(F.xxhash64(larger, r, *keys).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap_or_not)


def draw_counts(sources: DataFrame, slots: int, shard_slots: int, seed: int, small: bool) -> DataFrame:
    """Multinomial counts (shard, source_no, n): each slot draws a source in proportion to its whole-block target."""
    spark = sources.sparkSession
    width = max(1, slots // CELLS)
    ranges = sources.filter("slots > 0").select("source_no", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor((F.col("end_slot") - 1) / width))))
    cells = F.broadcast(cells) if small else cells
    drawn = spark.range(slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("at"))
    drawn = drawn.withColumn("cell", F.floor(F.col("at") / width)).join(cells, "cell")
    hit = drawn.filter((F.col("at") >= F.col("first_slot")) & (F.col("at") < F.col("end_slot")))
    return hit.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block: int = FINE_BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 17,
    keys: tuple[str, ...] = ("doc_id",),
) -> Mix:
    """Plan a mix of all ``documents`` (source, the columns in ``keys``, and text or its number of words as ``size``).

    Weights go to the sources in code point order, null last, and repeat. The
    mix is as long as all documents together. A null text has no words; null
    sources are one source; repeated rows are documents of their own; an empty
    table gives empty results.
    """
    size = F.col("size") if "size" in documents.columns else word_count(F.col("text"))
    sizes = save(documents.select(*keys, "source", size.cast("long").alias("size")), "sizes")
    rows, _ = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    sources, count = source_targets(sizes, weights, max_repeats)
    small = count <= BROADCAST_ROWS
    fitting = F.floor(F.least("source_size", F.col("target")) / LEAST_BLOCKS)
    sources = sources.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), fitting)).cast("long"))
    blocks = F.ceil(F.col("source_size") / F.col("length"))
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * blocks)).otherwise(0).cast("long")
    sources = save(sources.withColumn("blocks", blocks).withColumn("slots", wanted), "targets")
    buckets = level_buckets(count)
    sources = save(running_start(sources, [], ["source_no"], F.col("slots"), "first_slot", buckets), "targets")
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    # Draws, and where each shard's draws stand in the source's own row of slots.
    counts = save(draw_counts(sources, total, shard_slots, seed, small), "draws")
    drawn = running_start(counts, ["source_no"], ["shard"], F.col("n"), "ahead", level_buckets(total // shard_slots + 1))
    drawn = drawn.repartition(max(1, total // TASK_SLOTS), "source_no", "shard")  # few rows of counts, many slots
    slots = drawn.select("shard", "source_no", F.explode(F.sequence(F.col("ahead"), F.col("ahead") + F.col("n") - 1)).alias("j"))

    # Settlement: draws beyond a source's target go, one by one, to the sources that were drawn too rarely.
    sums = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    wanted = sources.select("source_no", "slots", "blocks").join(sums, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    wanted = save(wanted, "settled")
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    wanted = save(running_start(wanted, [], ["source_no"], over, "over_from", buckets), "settled")
    wanted = save(running_start(wanted, [], ["source_no"], under, "under_from", buckets), "settled")
    sized = F.broadcast(wanted) if small else wanted
    slots = slots.join(sized, "source_no")
    kept = slots.filter("j < slots").select("shard", "source_no", "j", "blocks")
    surplus = slots.filter("j >= slots").select("shard", (F.col("over_from") + F.col("j") - F.col("slots")).alias("r"))
    lacking = wanted.filter("slots > drawn").select("source_no", "blocks", "under_from", "drawn", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("j"))
    lacking = lacking.select("source_no", "blocks", "j", (F.col("under_from") + F.col("j") - F.col("drawn")).alias("r"))
    moved = surplus.join(lacking, "r").select("shard", "source_no", "j", "blocks")
    run = F.floor(F.col("j") / F.col("blocks"))
    slots = kept.unionByName(moved).select(
        "shard", "source_no", run.alias("pass"), permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), run).alias("block")
    )

    # Each document's stretch of its source's stream, cut at block borders.
    own = sources.select("source", "source_no", "source_size", "target", "length")
    own = F.broadcast(own) if small else own
    known = sizes.join(own.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_start(known, ["source_no"], [*keys, "size"], F.col("size"), "start", level_buckets(rows))
    last = F.col("start") + F.col("size") - 1
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor(last / F.col("length")))))
    low, high = F.greatest(F.col("start"), F.col("block") * F.col("length")), F.least(last + 1, (F.col("block") + 1) * F.col("length"))
    pieces = pieces.withColumn("from_word", low - F.col("start")).withColumn("words", high - low)
    return Mix(sources, slots, pieces, known)


def taken_words(documents: DataFrame, **settings) -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target (its source's) and taken (words, repeats counted)."""
    plan = mix(documents.select("doc_id", "text", "source"), **settings)
    picks = plan.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    met = plan.pieces.join(picks, ["source_no", "block"], "left")
    result = ["doc_id", "size", "source_size", "target"]
    summed = met.groupBy("source_no", "start", *result).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    empty = plan.sizes.filter("size = 0").select(*result, F.lit(0).cast("long").alias("taken"))
    return summed.select(*result, "taken").unionByName(empty)


def mix_documents(documents: DataFrame, block: int = TEXT_BLOCK, **settings) -> DataFrame:
    """The mixed corpus: one row of ``documents`` per pass that takes words of it, ``text`` cut to the words taken.

    Blocks are long, so most documents come whole or not at all in a pass;
    parts that do not touch are put on lines of their own, and n_chars follows
    if present. Documents without words are never taken. Rows equal in id,
    text and source are planned once and take the same words.
    """
    with scratch(documents.sparkSession) as keep:
        # Counted before rows are told apart, so that no text is exchanged for it.
        own = documents.select(F.xxhash64("doc_id", "text", "source").alias("key"), "source", word_count(F.col("text")).alias("size"))
        plan = mix(own.dropDuplicates(["key"]), block=block, keys=("key",), **settings)
        met = plan.pieces.join(plan.slots, ["source_no", "block"])
        parts = met.groupBy("key", "size", "pass").agg(
            F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("parts")
        )
        parts = keep(parts, "parts")
    packed = documents.select(F.xxhash64("doc_id", "text", "source").alias("key"), F.struct("*").alias("row"))
    joined = packed.join(parts, "key")
    text = F.col("row.text")
    all_words = F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"))
    cut = F.array_join(F.transform("parts", lambda p: F.trim(F.array_join(F.slice(all_words, (p["from_word"] + 1).cast("int"), p["words"].cast("int")), ""))), "\n")
    mixed = F.when(F.col("words") == F.col("size"), text).otherwise(cut)
    joined = joined.select("row", mixed.alias("mixed"))
    changed = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in documents.columns])
