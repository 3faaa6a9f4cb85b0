"""Mixing sources to target weights, in DataFrame operations only.

Each source is a stream of its documents' words in a pseudorandom order, cut into blocks of one length. The mix has as
many slots as the targets ask for. Slots are dealt to output shards; in each shard every slot draws its source, which
makes multinomial source counts. Draws beyond a source's quota pass to sources below theirs, so that totals come out exact.
A source's slots, numbered over all shards, map through one pseudorandom permutation of its block numbers for each pass
over the source, and blocks and documents meet in a join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE_WORD, store

WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST_PASSES = 3
#: Words of a block. Sources of fewer than BLOCKS_LEAST such blocks have shorter ones.
BLOCK_WORDS, BLOCKS_LEAST = 2048, 256
#: Slots of an output shard.
SHARD_SLOTS = 4096
#: Documents whose offsets one sort task numbers.
BUCKET_ROWS = 8192
ROUNDS = 24


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """One row a source: src, rank, source_size, target.

    The targets are shares of the sum of all sizes by weight, held at `most` times the source's size; the excess goes to
    the others by weight. That fixes one level x with target = min(most * size, weight * x): sources ordered by
    size / weight are held as long as x, computed over the rest, exceeds their bound. A null source is one source, the last.
    Null or empty texts have size 0; with no words at all, every target is 0.
    """
    totals = sized.groupBy(F.col("src")).agg(F.sum("size").alias("source_size"))
    all_rows = W.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("rank", F.row_number().over(all_rows) - 1).withColumn("weight", weight)
    by_bound = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before = by_bound.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_bound.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bound = F.lit(float(most)) * F.col("source_size")
    leveled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("held", F.coalesce(F.sum(bound).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("held")) / F.sum("weight").over(from_here))
        .withColumn("bound", bound)
        .withColumn("is_held", F.col("bound") <= F.col("weight") * F.col("level"))
        .withColumn("x", F.max(F.when(~F.col("is_held"), F.struct(-F.col("source_size") / F.col("weight"), -F.col("rank"), "level"))).over(everything).getField("level"))
    )
    target = F.when(F.col("is_held"), F.col("bound")).otherwise(F.col("weight") * F.coalesce("x", "level"))
    return leveled.select("src", "rank", "source_size", F.least(target, "bound").alias("target"))


def permuted(index: Column, size: Column, key: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0..size-1: ROUNDS of swap-or-not, each a bijection.

    x and (k - x) mod size trade places if a hash of the round and of the greater of the two says so.
    """
    def swapped(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, F.lit(seed), r), size) - x, size)
        swap = F.xxhash64(F.greatest(x, partner), key, F.lit(seed + 1), r) < 0
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swapped)


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, blocks_least: int = BLOCKS_LEAST, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mix of docs (doc_id, source, text): doc_id, src, text_hash, size, first (the first word's place in the source's
    stream), source_size, target, taken, pieces. A row for each of docs' rows. pieces: words a to b-1 of the text are
    taken `uses` times.
    """
    rows = docs.select("doc_id", F.col("source").alias("src"), words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = store(rows.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed))))
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    targets = source_targets(sized)
    length = F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.col("source_size") / blocks_least))).cast("long")
    plan = store(
        targets.withColumn("len", length)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("len")))
        .withColumn("quota", F.least(F.round(F.col("target") / F.col("len")).cast("long"), F.col("blocks") * MOST_PASSES))
    )
    # Offsets: sums of the buckets before, and of the bucket's documents before.
    sums = sized.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    offsets = sums.select("src", "bucket", (F.sum("sum").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum")).alias("offset"))
    within = W.partitionBy("src", "bucket").orderBy("h", "doc_id", "text_hash")
    placed = sized.withColumn("start", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    # Rows without a word share their places; a number tells them apart.
    placed = placed.withColumn("nth", F.row_number().over(within))
    placed = placed.join(offsets, placed["src"].eqNullSafe(offsets["src"]) & (placed["bucket"] == offsets["bucket"]), "left").select(placed["*"], (F.col("start") + F.col("offset")).alias("first"))
    placed = placed.join(plan, placed["src"].eqNullSafe(plan["src"]), "left").select("doc_id", placed["src"], "text_hash", "size", "h", "nth", "first", "rank", "source_size", "target", "len")
    last = F.floor((F.col("first") + F.col("size") - 1) / F.col("len"))
    block = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / F.col("len")), last)).otherwise(F.array(-1 - F.pmod("h", F.lit(2**40))))
    pieces = placed.withColumn("block", F.explode(block))
    a = F.greatest(F.col("first"), F.col("block") * F.col("len")) - F.col("first")
    b = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * F.col("len")) - F.col("first")
    pieces = pieces.withColumn("a", F.when(F.col("size") > 0, a).otherwise(F.lit(0))).withColumn("b", F.when(F.col("size") > 0, b).otherwise(F.lit(0)))
    uses = block_uses(plan, shard_slots, seed).groupBy("rank", "block").agg(F.count("*").alias("uses"))
    joined = pieces.join(uses, ["rank", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    keys = ["doc_id", "src", "text_hash", "size", "first", "nth", "source_size", "target"]
    taken = F.sum((F.col("b") - F.col("a")) * F.col("uses"))
    return joined.groupBy(*keys).agg(taken.alias("taken"), F.sort_array(F.collect_list(F.struct("a", "b", "uses"))).alias("pieces"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs needs doc_id, source, text. Returns doc_id, source, size, source_size, target, taken, a row for each of docs' rows.

    Null ids and repeated rows are rows like others. Texts that are null or have no word take nothing. An empty table
    gives an empty result. Other columns of docs are left aside, so their names can't clash.
    """
    return mixed(docs, **options).select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row of docs comes back once for each pass that takes words of it, cut to the words taken.

    A text that a pass takes whole is unchanged; of another, the words taken stand with single spaces. n_chars, where docs
    have it, is the new text's. Texts without a word are in no pass. A null id or source is a value like others; rows that
    repeat id, source and text take their own shares of the words. Any partitioning gives the same rows. Names that begin with _mix_ are taken.
    """
    key, nth = ["_mix_id", "_mix_source", "_mix_hash"], W.partitionBy("_mix_id", "_mix_source", "_mix_hash")
    # Rows alike in id, source and text are numbered on both sides: by their other columns here, by their place in the mix there.
    parts = mixed(docs, **options).where("taken > 0").select(F.xxhash64("doc_id").alias("_mix_id"), F.xxhash64("src").alias("_mix_source"), F.col("text_hash").alias("_mix_hash"), "first", "nth", F.col("pieces").alias("_mix_pieces"))
    parts = parts.withColumn("_mix_nth", F.row_number().over(nth.orderBy("first", "nth"))).drop("first", "nth")
    kept = docs.withColumn("_mix_id", F.xxhash64("doc_id")).withColumn("_mix_source", F.xxhash64("source")).withColumn("_mix_hash", F.xxhash64("text"))
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    kept = kept.withColumn("_mix_nth", F.row_number().over(nth.orderBy(others)))
    passes = F.sequence(F.lit(1), F.array_max(F.transform("_mix_pieces", lambda p: p["uses"])).cast("int"))
    met = kept.join(parts, [*key, "_mix_nth"]).withColumn("_mix_pass", F.explode(passes))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    met = met.withColumn("_mix_whole", F.forall("_mix_pieces", lambda p: p["uses"] >= F.col("_mix_pass")))
    runs = F.flatten(F.transform(F.filter("_mix_pieces", lambda p: p["uses"] >= F.col("_mix_pass")), lambda p: F.slice(words, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    out = met.withColumn("text", F.when(F.col("_mix_whole"), F.col("text")).otherwise(F.array_join(runs, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def block_uses(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """The mix itself, a row a slot: shard, rank (the slot's source), slot (within the source), block."""
    everything = W.partitionBy()
    shares = (
        plan.where("quota > 0")
        .withColumn("to", F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("slots", F.sum("quota").over(everything))
        .select("rank", "quota", "blocks", "to", "slots")
    )
    cumulated = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("to", "rank"))).alias("wheel"), F.coalesce(F.max("slots"), F.lit(0)).alias("slots"))
    shards = cumulated.select("wheel", "slots", F.explode(F.expr(f"CASE WHEN slots > 0 THEN sequence(0L, (slots - 1) div {shard_slots}) ELSE array() END")).alias("shard"))
    drawn = (
        shards.repartition("shard")
        .select("shard", "slots", "wheel", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.col("slots") - F.col("shard") * shard_slots) - 1)).alias("nth"))
        .withColumn("at", F.pmod(F.xxhash64("shard", "nth", F.lit(seed + 1)), F.col("slots")))
        .select("shard", F.expr("filter(wheel, w -> w.to > at)[0].rank").alias("rank"))
    )
    counts = store(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")))  # the multinomial counts: shards x sources rows
    shifted = (
        counts.withColumn("to", F.sum("n").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
        .join(plan.select("rank", "quota"), "rank")
        .withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("to") + F.col("n"))))
    )
    kept = shifted.where("kept > 0").select("shard", "rank", (F.col("to") - F.col("n")).alias("first"), F.col("kept").alias("n"))
    # Draws past a quota, as intervals of one line, meet the sources' wants, as intervals of the same line.
    over = shifted.where("kept < n").select("shard", (F.col("n") - F.col("kept")).alias("m"))
    over = over.groupBy("shard").agg(F.sum("m").alias("m")).withColumn("over_to", F.sum("m").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    wants = (
        plan.select("rank", "quota").join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("quota > got")
        .withColumn("want_to", F.sum(F.col("quota") - F.col("got")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("want_from", F.col("want_to") - F.col("quota") + F.col("got"))
    )
    # All ends of both kinds of intervals, in order, cut the line into pieces of one shard and one source each.
    ends = over.select(F.col("over_to").alias("at"), "shard", F.lit(None).alias("want")).unionByName(
        wants.select(F.col("want_to").alias("at"), F.lit(None).cast("long").alias("shard"), F.struct("rank", "got", "want_from").alias("want"))
    )
    ends = ends.groupBy("at").agg(F.max("shard").alias("shard"), F.max("want").alias("want"))
    onward = W.orderBy("at").rowsBetween(W.currentRow, W.unboundedFollowing)
    pieces = ends.select(
        "at", F.lag("at", 1, 0).over(W.orderBy("at")).alias("from"), F.first("shard", ignorenulls=True).over(onward).alias("shard"), F.first("want", ignorenulls=True).over(onward).alias("want")
    )
    moved = pieces.where("shard IS NOT NULL AND want IS NOT NULL").select(
        "shard", "want.rank", (F.col("want.got") + F.col("from") - F.col("want.want_from")).alias("first"), (F.col("at") - F.col("from")).alias("n")
    )
    dealt = kept.unionByName(moved).repartition("shard", "rank")
    slots = dealt.select("shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    slots = slots.join(plan.select("rank", "blocks"), "rank")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64("rank", turn), seed + 2)
    return slots.select("shard", "rank", "slot", block.alias("block"))
