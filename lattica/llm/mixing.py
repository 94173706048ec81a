"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, its documents one after the other, are packed into blocks
of ``block_words``.  The mix is dealt to output shards of equal numbers of block
slots.  Each slot of a shard draws its source with the targets as probabilities,
so the counts of the sources in a shard are multinomial; over the shards, the
draws of one slot number are spread evenly, which brings the totals close to the
targets.  A source's counts, summed along the shards, number its slots; these
run through pseudorandom permutations of its block indices, one permutation per
round, and blocks are joined to slots by index.  A source's blocks are taken
``max_repeats`` times at most; slots drawn beyond that stay empty.

DataFrame functions only.  Draws are hashes of the seed and the slot, so reruns
agree.  Prefix sums go in two levels, by groups of places: neither the largest
source nor the list of sources is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import n_buckets, stage

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Words of a block; slots of a shard at most (a small mix has as many shards as slots in each).
BLOCK_WORDS, SHARD_SLOTS, SEED = 32, 256, 17
#: Multipliers of the permutations i -> (a i + b) mod n; the first that does not divide n serves.
PRIMES = (2097143, 2097133, 2097131, 2097097)
#: A source, null kept apart from the empty string.
SRC = ["no_source", "source_key"]
#: Units of a slot, in which the sources' shares of all slots are whole numbers.
UNIT = 1 << 20
#: Numbers that one row is spread into at once.
RUN = 1 << 14
GROUP = 4096


def _before(df: DataFrame, keys: list[str], place: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over smaller places (whole numbers) of the same keys, in two levels."""
    grouped = df.withColumn("_group", F.floor(F.col(place) / GROUP))
    inner = Window.partitionBy(*keys, "_group").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum"))
    shift = sums.select(*keys, "_group", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_shift"))
    both = grouped.join(shift, [*keys, "_group"])
    return both.withColumn(name, F.col("_shift") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_group", "_shift")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order`` from 0: numbered within sorted ranges, and shifted."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = stage(ranged, "mix-ranged").withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id") % (1 << 33)})
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(sizes.select("_range", shift.alias("_shift")), "_range").withColumn(name, F.col("_shift") + F.col("_at")).drop("_id", "_range", "_at", "_shift")


def _spread(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each number from ``first`` to ``last``; long spans are dealt out in runs."""
    wide = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_last >= _first")
    runs = wide.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / RUN))))
    runs = runs.withColumn("_from", F.col("_first") + F.col("_run") * RUN).repartition("_from", *df.columns[:2])
    return runs.withColumn(name, F.explode(F.sequence("_from", F.least("_last", F.col("_from") + RUN - 1)))).drop("_first", "_last", "_run", "_from")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words; 0 for null), with the source as a joinable key."""
    text = F.coalesce("text", F.lit(""))
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    size = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)
    return docs.select(
        "doc_id", "source", size.cast("long").alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source its place, size, weight and target in words.

    Weights repeat along the sources by code point, null last.  Targets share all
    words by weight up to ``max_repeats`` times a source's size.  Each pass stops
    the sources that would be above that and shares the rest among the others;
    all that reaches the driver is four sums.
    """
    totals = sizes.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = _numbered(totals, SRC, "place").withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    caps = stage(caps, "mix-caps")
    words, free = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, stopped = words / free if free else 0.0, 0
    while free:
        over = F.col("weight") * level > F.col("cap")
        n, held, free = caps.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (words - held) / free, n
    return caps.withColumn("target", F.least(F.col("weight") * level, F.col("cap").cast("double"))).drop("cap")


def shard_counts(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The draw: blocks of each source per output shard, (source, blocks, shard, n).

    Slot t of shard s draws the point U(seed, t) + s / shards of the interval that
    the sources share, modulo its length.  Within a shard the points of its slots
    are independent and uniform, so its counts are multinomial; what the targets
    leave of the interval is the empty slot's.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    plan = targets.where("target > 0").withColumn("blocks", blocks)
    plan = plan.withColumn("units", F.round(F.col("target") * F.col("blocks") / F.col("source_size") * UNIT).cast("long"))
    plan = _before(plan, [], "place", "units", "low")
    plan = stage(plan.select(*SRC, "blocks", "low", (F.col("low") + F.col("units")).alias("high")), "mix-plan")
    units = plan.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    wanted = max(-(-units // UNIT), 1)
    slots = min(shard_slots, int((wanted - 1) ** 0.5) + 1)
    shards = -(-wanted // slots)
    length, cell = slots * shards * UNIT, 64 * UNIT
    drawn = spark.range(slots * shards if units else 0).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("t"))
    point = F.pmod(F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(length)) + F.col("shard") * (slots * UNIT), F.lit(length))
    drawn = drawn.select("shard", point.alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    cells = _spread(plan, F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell), "cell")
    found = drawn.join(cells, "cell").where("low <= point AND point < high")
    return stage(found.groupBy(*SRC, "blocks", "shard").agg(F.count("*").alias("n")), "mix-counts")


def block_copies(counts: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The blocks that the slots take: (source, block, copies, shards), in ``shards`` where each copy goes."""
    first = _before(counts, SRC, "shard", "n", "first")
    limit = F.col("blocks") * max_repeats - 1
    slots = _spread(first, F.col("first"), F.least(F.col("first") + F.col("n") - 1, limit), "k")
    slots = slots.withColumns({"round": F.floor(F.col("k") / F.col("blocks")), "i": F.col("k") % F.col("blocks")})
    a = F.lit(1).cast("long")
    for p in reversed(PRIMES):
        a = F.when(F.col("blocks") % p != 0, F.lit(p).cast("long")).otherwise(a)
    b = F.pmod(F.xxhash64(F.lit(seed + 1), *SRC, "round"), F.col("blocks"))
    block = (a * F.col("i") + b) % F.col("blocks")
    return slots.groupBy(*SRC, block.alias("block")).agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("shard")).alias("shards"))


def place_documents(sizes: DataFrame) -> DataFrame:
    """Each document's first word in the stream of its source: by hashed bucket, then doc_id."""
    buckets = n_buckets(sizes.sparkSession, sizes.count(), 4096)
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = dealt.groupBy(*SRC, "bucket").agg(F.sum("size").alias("n"))
    offsets = _before(sums, SRC, "bucket", "n", "offset").drop("n")
    inside = Window.partitionBy(*SRC, "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.withColumn("upto", F.sum("size").over(inside))
    return ends.join(offsets, [*SRC, "bucket"]).withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).drop("bucket", "offset", "upto")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and ``pieces``.

    ``pieces`` lists what the mix takes of the document: structs of the first
    word (from 0), the number of words, the copies, and the output shard of each
    copy.  ``taken`` is the number of words with copies.  A block is taken at
    most ``max_repeats`` times, hence no document more often.  A null text has
    size 0; documents and sources without words take nothing and have an empty
    list.  A null source is one of the sources.  Rows that repeat a doc_id are
    documents of their own, in order of size.  Other columns are ignored.  The
    taken words of a source differ from its target by the draw, by about
    sqrt(shard_slots) / 2 blocks at most in the mean.
    """
    sizes = stage(document_sizes(docs), "mix-sizes")
    targets = stage(source_targets(sizes, weights, max_repeats), "mix-targets")
    copies = block_copies(shard_counts(targets, block_words, shard_slots, seed), max_repeats, seed)
    kind = "array<struct<first:bigint,n:bigint,copies:bigint,shards:array<bigint>>>"
    placed = place_documents(sizes.where("size > 0"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    rows = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    rows = rows.join(copies.hint("merge"), [*SRC, "block"], "left")
    begin = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    piece = F.struct((begin - F.col("start")).alias("first"), (end - begin).alias("n"), F.col("copies"), F.col("shards"))
    by_doc = rows.groupBy("doc_id", "source", *SRC, "size", "start").agg(
        F.coalesce(F.sum((end - begin) * F.col("copies")), F.lit(0)).alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("copies").isNotNull(), piece))).alias("pieces"),
    )
    empty = sizes.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "pieces": F.array().cast(kind)})
    by_doc = by_doc.drop("start").unionByName(empty)
    known = targets.select(*SRC, "source_size", "target")
    return by_doc.join(F.broadcast(known) if targets.count() <= 100_000 else known, SRC).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "pieces"
    )


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
