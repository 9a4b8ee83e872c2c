"""Mixing sources to target weights, in DataFrame functions only.

Each source's texts, in a fixed order, form one stream of words that is packed into blocks of
``block_words``. The sources' targets fill the output's slots, one block each, in shards of
``shard_slots``. A shard's counts of slots by source are a multinomial draw: every slot draws its source on its own, by inverse
transform of a hash of its shard and place. A source's n-th slot maps through a pseudorandom permutation of its
block numbers (a new one for each pass over them), and blocks join their slots by number.

The draws decide how many slots a source gets. So that it comes near its target all the same, shards are drawn in rounds, three quarters of the slots that are left
at a time: a round's shards draw by the shares of what the sources still lack after the rounds before. The rounds end with one of at most LAST_SLOTS slots, whose
spread (some square root of the source's part of them) is what a source misses its target by. Only draws beyond ``cap`` passes over a source's blocks are given up.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share the total size;
a target stops at ``cap`` times its source's size and the excess is shared again by weight.

A source of any size is cut into runs of documents by a hash of the id and text, and its shards into runs of SHARD_RUN; only sums of
runs are brought together. A slot finds its source by equal cells of the unit interval, of which there are as many as sources. The windows without a
partition are over the list of sources.

Cases: a null or empty text has size 0 and takes nothing; a very long text spans many blocks; a null source is a source; null ids are kept; repeated
rows each get a row and their own place in the stream, in an order that doesn't matter as they are equal; other columns are ignored unless asked
for, whatever their names; an empty table gives an empty result. Equal inputs and parameters give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: A source is cut into at least BUCKETS runs, into more from BUCKETS * BUCKET_ROWS documents on.
BUCKETS, BUCKET_ROWS = 1024, 1 << 20
#: Shards whose counts are summed together, and slots of a task that draws.
SHARD_RUN, TASK_SLOTS = 1024, 1 << 20
#: Slots of the last round.
LAST_SLOTS = 64
#: Steps of the unit interval that a draw tells apart.
STEPS = 1 << 40
#: The ten largest primes below 2**21. One that doesn't divide n gives a permutation of 0 .. n - 1 for n below 2**41.
PRIMES = [2097143, 2097133, 2097131, 2097097, 2097091, 2097083, 2097047, 2097041, 2097031, 2097023]
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words that ASCII white space sets apart; null: 0.

    Without two neighbouring spaces the words are one more than the spaces inside; only other texts need the pattern.
    """
    plain = F.coalesce(text.cast("string"), F.lit(""))
    for space in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    inner = F.trim(plain)
    spaces = F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit("")))
    return F.when(inner == "", F.lit(0)).when(F.contains(inner, F.lit("  ")), F.regexp_count(inner, F.lit("[^ ]+"))).otherwise(spaces + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("sid", F.row_number().over(order) - 1)
    table = table.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("sid") % len(weights) + 1))
    full = cap * F.col("source_size")
    by = Window.orderBy(F.col("full_at"), F.col("sid"))
    table = table.withColumn("full_at", full / F.col("w")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum(full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - before) / after  # a unit of weight's share if the sources before are full and the others are not
    table = table.withColumn("level", F.when(level <= F.col("full_at"), level))
    level = F.max("level").over(Window.partitionBy())  # the first that fits; with more sources taken as full it only falls
    return table.select("source", "sid", "source_size", F.least(full, F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """k's place in a pseudorandom permutation of 0 .. n - 1 chosen by key."""
    usable = F.filter(F.array(*(F.lit(p).cast("long") for p in PRIMES)), lambda p: n % p != 0)
    prime = F.element_at(usable, (F.pmod(F.xxhash64(F.lit("factor"), *key), F.size(usable)) + 1).cast("int"))
    return F.pmod(k * prime + F.pmod(F.xxhash64(F.lit("offset"), *key), n), n)


def draws(spark: SparkSession, shares: DataFrame, slots: int, first_shard: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, n): how many of its slots each shard of a round gives each source of shares (sid, wanted); its n by source are a multinomial draw."""
    upto, every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    cdf = shares.filter("wanted > 0")
    cdf = cdf.select("sid", "wanted", F.sum("wanted").over(every).alias("all"), F.sum("wanted").over(upto).alias("upto"), F.max("sid").over(every).alias("last"), F.count("*").over(every).alias("sources"))
    edge = lambda c: F.floor(c / F.col("all") * STEPS)
    cdf = cdf.select("sid", F.ceil(F.lit(float(STEPS)) / F.col("sources")).alias("width"), edge(F.col("upto") - F.col("wanted")).alias("low"), F.when(F.col("sid") == F.col("last"), STEPS).otherwise(edge(F.col("upto"))).alias("high")).filter("high > low")
    cells = C.written(cdf.select("sid", "low", "high", "width", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width")))).alias("cell")), "cells")
    width = cells.agg(F.max("width")).first()[0] or 1
    shard = F.floor(F.col("id") / shard_slots) + first_shard
    drawn = spark.range(0, slots, 1, min(max(C.partitions(spark), -(-slots // TASK_SLOTS)), -(-slots // 4096))).select(shard.alias("shard"), F.pmod(F.xxhash64(F.lit(seed), shard, F.pmod("id", F.lit(shard_slots))), F.lit(STEPS)).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter("low <= u and u < high")
    return drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))


def shard_counts(spark: SparkSession, wanted: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, n) of all rounds; wanted: (sid, wanted), slots that each source should get."""
    left, first, rounds = int(wanted.agg(F.ceil(F.sum("wanted"))).first()[0] or 0), 0, None
    while left > 0:
        slots = left if left <= LAST_SLOTS else -(-3 * left // 4)
        lacking = wanted
        if rounds is not None:
            drew = rounds.groupBy("sid").agg(F.sum("n").alias("drew"))
            lacking = wanted.join(drew, "sid", "left").select("sid", (F.col("wanted") - F.coalesce("drew", F.lit(0))).alias("wanted"))
        drawn = C.written(draws(spark, lacking, slots, first, shard_slots, seed), "draws")
        rounds = drawn if rounds is None else rounds.unionByName(drawn)
        left, first = left - slots, first - (-slots // shard_slots)
    return rounds if rounds is not None else wanted.select("sid", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("n")).limit(0)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, block_words: int = 32, shard_slots: int = 4096, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: id_col, size, source_size, target, taken (words of it in the mix, repeats counted), then the columns keep."""
    text = F.col(text_col).cast("string")
    sized = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), F.xxhash64(text).alias("body"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"))
    sized = C.written(sized, "sized")
    buckets = max(BUCKETS, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "body"), F.lit(buckets)).cast("int"))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    plan = C.written(targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "bucket", F.coalesce(F.sum("size").over(by), F.lit(0)).alias("offset"))

    # each document's place in its source's stream
    within = Window.partitionBy("source", "bucket").orderBy("id", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    placed = placed.select("d.*", (F.col("before") + F.col("offset")).alias("start")).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.id", "d.size", "d.start", "d.kept", "p.sid", "p.source_size", "p.target")
    overlap = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    overlap = overlap.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words))

    # a source's slots are numbered through its shards: the sums of runs of shards, then the shards of a run
    run = F.floor(F.col("shard") / SHARD_RUN)
    blocks = F.ceil(F.col("source_size") / block_words)
    filled = C.written(plan.filter("source_size > 0").select("sid", blocks.alias("blocks"), F.floor(cap * blocks).alias("most"), (F.col("target") * blocks / F.col("source_size")).alias("wanted")), "wanted")
    drawn = shard_counts(docs.sparkSession, filled.select("sid", "wanted"), shard_slots, seed).withColumn("run", run)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = drawn.groupBy("sid", "run").agg(F.sum("n").alias("n")).select("sid", "run", before(Window.partitionBy("sid").orderBy("run")).alias("first"))
    numbered = drawn.select("sid", "shard", "run", "n", before(Window.partitionBy("sid", "run").orderBy("shard")).alias("inner")).join(runs, ["sid", "run"])
    numbered = numbered.join(filled, "sid").withColumn("first", F.col("first") + F.col("inner")).withColumn("n", F.least(F.col("n"), F.col("most") - F.col("first"))).filter("n > 0").select("sid", "shard", "first", "n", "blocks")
    # deal the shards out before they grow to slots
    slots = numbered.repartition(C.partitions(docs.sparkSession), "sid", "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    used = slots.select("sid", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), turn).alias("block")).groupBy("sid", "block").agg(F.count("*").alias("uses"))

    names = ["id", "size", "start", "sid", "source_size", "target"]
    # both sides grow with the data, but the planner takes the exploded slots for as small as the list of sources: no broadcast
    taken = overlap.join(used.hint("merge"), ["sid", "block"], "left").groupBy(*names).agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken"), F.first("kept").alias("kept"))
    rows = taken.unionByName(placed.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken"), "kept"))
    return rows.select(C.null_id("id", id_col), "size", "source_size", "target", "taken", *(F.col(f"kept.{k}").alias(k) for k in keep))
