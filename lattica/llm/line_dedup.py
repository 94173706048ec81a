"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

The corpus is a sequence of line ids, documents in order of ``doc_id``.  Ranks
of suffixes by their first ``h`` lines are doubled: the pair of the ranks at
``p`` and ``p + h``, sorted and numbered, ranks the suffixes by ``2 h`` lines.
Suffixes that share a rank form an LCP interval of that depth; an interval of
one can't hold a repeat and leaves, so each round has fewer rows, and rounds end
when all intervals are single.

Suffixes in an interval of depth ``min_lines`` repeat; the first in corpus order
is the original.  How far a later one agrees with it, their longest common
prefix, follows from the ranks of all rounds, the deepest first.  That gives the
maximal runs, which are deleted; the original stays.  The shallower intervals
give the repeats of fewer lines that are long all the same.

DataFrame functions only.  A sort by range numbers the ranks: the id that
``monotonically_increasing_id`` gives after it rises with the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import release, stage, unstage

MIN_LINES = 3
#: Bytes from which a run of fewer lines is a repeat too; a word counts as WORD_BYTES at least, so 50 words are enough.
LONG_BYTES, WORD_BYTES = 400, 8
#: What identifies one document: its id, and its text where an id repeats.
DOC = ["doc_id", "text_key"]


def line_ids(docs: DataFrame) -> DataFrame:
    """One row per line: document, place, 128 bits that stand for the line, and its length."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    rows = keyed.select(*DOC, F.posexplode("lines").alias("pos", "line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    length = F.greatest(F.octet_length("line"), WORD_BYTES * words)
    return rows.select(*DOC, "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), length.alias("head"), length.cast("long").alias("length"))


def _intervals(suffixes: DataFrame, name: str, repeated_rows: bool = False) -> DataFrame:
    """Suffixes with keys k1, k2 -> those whose key repeats, with its rank and the first place that has it."""
    place = F.struct(*DOC, "pos")
    groups = suffixes.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    ranked = groups.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2")
    ranked = stage(ranked.select("k1", "k2", "first", F.monotonically_increasing_id().alias("rank")), f"{name}-ranks")
    found = suffixes.join(ranked, ["k1", "k2"]).select(*DOC, "pos", "rank", "first", "head", "length")
    found = stage(found.dropDuplicates([*DOC, "pos"]) if repeated_rows else found, name)
    unstage(ranked)
    return found


def _paired(suffixes: DataFrame, step: int) -> DataFrame:
    """Key each suffix by its rank and that of the suffix ``step`` lines on; those without one can't repeat at that depth.

    ``length`` is that of the deeper run after a step of one line, and not used after others.
    """
    ahead = suffixes.select(*DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("k2"), F.col("length").alias("rest"))
    paired = suffixes.select(*DOC, "pos", F.col("rank").alias("k1"), "head").join(ahead, [*DOC, "pos"])
    return paired.withColumn("length", F.col("head") + F.col("rest")).drop("rest")


def suffix_levels(docs: DataFrame) -> list[DataFrame]:
    """The suffix array by doubling: table j has the suffixes whose first 2**j lines repeat, (doc_id, text_key, pos, rank, first).

    ``rank`` orders suffixes by those lines (lines by their ids).  No suffix
    repeats for as many lines as a further table would stand for.
    """
    release(docs.sparkSession)
    levels = [_intervals(line_ids(docs), "lines-1", True)]
    while levels[-1].limit(1).count():
        release(docs.sparkSession)  # each round plans anew; what the last ones left would fill the driver's heap
        levels.append(_intervals(_paired(levels[-1], 1 << (len(levels) - 1)), f"lines-{1 << len(levels)}"))
    unstage(levels.pop())
    return levels


def suffix_intervals(levels: list[DataFrame], depth: int) -> DataFrame | None:
    """The LCP intervals of at least ``depth`` lines; for other depths than powers of two, two ranks that overlap are the key."""
    j = depth.bit_length() - 1
    if j >= len(levels):
        return None
    return levels[j] if depth == 1 << j else _intervals(_paired(levels[j], depth - (1 << j)), f"lines-{depth}")


def _later(suffixes: DataFrame, depth: int) -> DataFrame:
    """Suffixes whose first ``depth`` lines stand earlier too: their place, and where their original is."""
    later = suffixes.where(F.struct(*DOC, "pos") > F.col("first"))
    own = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    return later.select(*DOC, "pos", "first", F.when(own, F.col("first.pos") + depth).otherwise(0).alias("past"))


def _heads(later: DataFrame) -> DataFrame:
    """Those that don't go on where the suffix before them, with the original before theirs, left off."""
    before = Window.partitionBy(*DOC).orderBy("pos")
    last, place = F.lag("first").over(before), F.col("first")
    on = (F.lag("pos").over(before) == F.col("pos") - 1) & (last["doc_id"] == place["doc_id"]) & (last["text_key"] == place["text_key"]) & (last["pos"] == place["pos"] - 1)
    return later.withColumn("on", F.coalesce(on, F.lit(False))).where("NOT on").drop("on")


def common_prefixes(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``pairs`` (doc_id, text_key, pos, first, ...) with ``lcp``: the number of lines in which the suffixes at the two places agree.

    From the deepest table down: where the next 2**j lines of both have the same
    rank, the prefix is longer by that.
    """
    rest = [c for c in pairs.columns if c not in (*DOC, "pos")]
    now = stage(pairs.withColumn("lcp", F.lit(0)), "lines-lcp")
    for j in reversed(range(len(levels))):
        ends = F.array(F.struct(*DOC, "pos"), "first")
        ahead = now.withColumn("end", F.explode(ends)).select(*now.columns, *[F.col(f"end.{c}").alias(f"e_{c}") for c in DOC], (F.col("end.pos") + F.col("lcp")).alias("e_pos"))
        ranks = levels[j].select(*[F.col(c).alias(f"e_{c}") for c in (*DOC, "pos")], "rank")
        both = ahead.join(ranks, ["e_doc_id", "e_text_key", "e_pos"], "left").groupBy(*DOC, "pos")
        same = (F.count("rank") == 2) & (F.min("rank") == F.max("rank"))
        longer = F.any_value("lcp") + F.when(same, 1 << j).otherwise(0)
        following = stage(both.agg(*[F.any_value(c).alias(c) for c in rest], longer.cast("int").alias("lcp")), "lines-lcp")
        unstage(now)
        now = following
        release(pairs.sparkSession)
    return now


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_bytes: int | None = LONG_BYTES) -> DataFrame:
    """Maximal runs of lines that are later copies: (doc_id, text_key, start, stop), lines from 0, stop exclusive.

    Copies have ``min_lines`` lines or ``long_bytes`` bytes; for the latter the depth
    grows by one line a round, as each depth has its own long runs.  What a copy
    shares with the first ``min_lines`` lines (or all, if fewer) of its own
    original, in the same text, is not part of it.
    """
    levels = suffix_levels(docs)
    spans = []
    deepest = suffix_intervals(levels, min_lines)
    if deepest is not None:
        runs = common_prefixes(_heads(_later(deepest, min_lines)), levels)
        spans.append(runs.select(*DOC, F.greatest("pos", "past").alias("start"), (F.col("pos") + F.col("lcp")).alias("stop")))
    shallow = levels[0] if levels else None
    for depth in range(1, min_lines if long_bytes is not None else 1):
        if shallow is None:
            break
        long = stage(_later(shallow.where(F.col("length") >= long_bytes), depth), f"lines-{depth}-long")
        spans.append(long.select(*DOC, F.greatest("pos", "past").alias("start"), (F.col("pos") + depth).alias("stop")))
        if depth + 1 < min_lines:
            shallow = (levels[1] if len(levels) > 1 else None) if depth == 1 else _intervals(_paired(shallow, 1), f"lines-by-{depth + 1}")
    if not spans:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, start int, stop int")
    later = spans[0]
    for more in spans[1:]:
        later = later.unionByName(more)
    in_order = Window.partitionBy(*DOC).orderBy("start")
    covered = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > covered, F.lit(True))
    later = later.groupBy(*DOC, "start").agg(F.max("stop").alias("stop"))
    islands = later.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(in_order))
    return stage(islands.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run"), "lines-runs")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_bytes: int | None = LONG_BYTES) -> DataFrame:
    """The documents with ``kept`` (text without later copies), ``n_lines``, ``n_removed`` and ``runs``.

    Lines end at LF.  A place is removed if a run of at least ``min_lines`` lines
    (or of ``long_bytes`` bytes, where a word counts as 8 at least; None: no such
    rule) over it also starts earlier in the corpus: at a smaller doc_id, or further
    up in the same text; places are judged on the input.  Where a copy overlaps its
    original the first ``min_lines`` lines of that stay (of five equal lines, three).  Null text has no lines
    and stays null; empty text is one empty line.  Rows that repeat an id are in
    order of a hash of their text; equal rows are one document and are treated
    alike.  A null doc_id comes before the others.  All columns of ``docs`` stay
    as they are; columns named like a result are replaced.
    """
    runs = repeated_runs(docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text"), min_lines, long_bytes)
    cuts = runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_cuts")
    on = (F.coalesce(docs["doc_id"], F.lit(-(2**63))) == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    # cuts grow with the corpus: the same join at every size, where a broadcast would go over to a shuffle of all texts at some
    joined = docs.join(cuts.hint("merge"), on, "left").withColumn("_cuts", F.coalesce("_cuts", none)).drop("_id", "_key")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    ends = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["stop"]))
    starts = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.size("_lines")))
    between = F.filter(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: g["b"] > g["a"])
    kept = F.flatten(F.transform(between, lambda g: F.slice(F.col("_lines"), g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate("_cuts", F.lit(0), lambda s, c: s + c["stop"] - c["start"])
    untouched = F.size("_cuts") == 0
    out = joined.withColumn("_lines", F.split("text", "\n")).withColumns(
        {
            "kept": F.when(untouched, F.col("text")).otherwise(F.array_join(kept, "\n")),
            "n_lines": n.cast("long"),
            "n_removed": removed.cast("long"),
            "runs": F.col("_cuts"),
        }
    )
    return out.drop("_lines", "_cuts")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """By lines alone, as the SQL twin defines it; the pipeline also takes out long runs of fewer lines."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), long_bytes=None)
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def sql() -> str:
    """Windows of MIN_LINES lines; the first place of each stays, and later ones go but for what they share with it."""
    ahead = " || chr(10) || ".join(f"lead(line, {k}) OVER w" for k in range(MIN_LINES))
    covered = " OR ".join(f"coalesce(lag(later AND pos + {k} >= past, {k}, false) OVER d, false)" for k in range(MIN_LINES))
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM split WHERE text IS NOT NULL),
runs AS (SELECT doc_id, pos, line, {ahead} AS run FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
seen AS (
  SELECT doc_id, pos, line, run IS NOT NULL AND row_number() OVER f > 1 AS later,
         CASE WHEN first_value(doc_id) OVER f = doc_id THEN first_value(pos) OVER f + {MIN_LINES} ELSE 0 END AS past
  FROM runs WINDOW f AS (PARTITION BY run ORDER BY doc_id, pos)),
marked AS (SELECT doc_id, pos, line, ({covered}) AS gone FROM seen WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
edges AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS starts FROM marked),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::int)::BIGINT AS n_removed, sum(starts::int)::BIGINT AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id)"""
