"""Exact top-k by inner product with a three-phase uniform threshold.

Each vector is cut into ``slices``; a slice of the candidates is one score list
per query, and a score is the sum over its lists.

1. Every list sends its ``k`` best local scores.  The exact scores of what was
   sent give each query a lower bound: the k-th best of them.
2. The bound divided by the number of lists is a cutoff.  A vector whose local
   scores all lie below it can't reach the bound, whatever the signs, so the
   lists send just the entries at or above the cutoff.
3. Sums of what was sent, with the cutoff for what wasn't, bound each candidate
   from above; those that can still reach the bound are scored exactly.

Lists are computed as products of blocks of queries and blocks of candidates.
The candidates are cut into blocks once.  Queries are broadcast in groups of a
checked size (``QUERY_BYTES``), and each group streams over the candidate blocks
without a shuffle.  Phase 2 takes the products again: keeping those of phase 1
would be a table of queries times candidates.  Equal vectors are one candidate: ties go to smaller ids, so the ``k + 1``
smallest ids stand for any number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stage
from lattica.shipping import ship

SCALE, EVERY, K, SLICES = 256, 50, 5, 2
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Bytes of one candidate block, and of the queries that are broadcast at once.
BLOCK_BYTES, QUERY_BYTES = 8 << 20, 32 << 20


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or any component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(embedding.isNotNull() & finite, ints)


def dot(a: Column, b: Column) -> Column:
    """Exact inner product of two arrays of longs; components that one of them lacks count as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def _matrix(ints: pa.ListScalar, width: int) -> np.ndarray:
    """Rows of one block, padded with zeros; as float64, which is exact here (see ``local_scores``)."""
    rows = ints.values
    lengths, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def local_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, in floating point where every sum fits its 53 bits, else in integers, which ``top_k`` has checked to suffice."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if top < 2**53 else q @ c.T


def _pairs(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    for row in range(batch.num_rows):
        cell = {n: batch.column(n)[row] for n in batch.schema.names}
        q, c = _matrix(cell["q_ints"], width), _matrix(cell["c_ints"], width)
        q_ids, c_ids = cell["q_ids"].values.to_numpy(), cell["c_ids"].values.to_numpy()
        for at in range(0, len(q_ids), 256):
            yield cell, slice(at, at + 256), q_ids[at : at + 256], c_ids, local_scores(q[at : at + 256], c)


_ENTRY = "q long, c long, list int, local long"


def _entries(q: np.ndarray, c: np.ndarray, which: int, local: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q), pa.array(c), pa.array(np.full(len(q), which, np.int32)), pa.array(local)], names=["q", "c", "list", "local"]
    )


def _merge(old: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best scores of each row and their ids, from the old ones and a block's."""
    take = min(keep, scores.shape[1])
    at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
    best = np.take_along_axis(scores, at, 1), ids[at]
    if old is None:
        return best
    scores, ids = np.concatenate([old[0], best[0]], axis=1), np.concatenate([old[1], best[1]], axis=1)
    at = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)


def _groups(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Ranges of block numbers of at most ``limit`` bytes, or of one block."""
    out: list[tuple[int, int]] = []
    held = 0
    for number, size in sorted(sizes):
        if out and held + size <= limit:
            out[-1], held = (out[-1][0], number), held + size
        else:
            out.append((number, number))
            held = size
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    slices: int = SLICES,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for each row that ``is_query`` picks.

    Null vectors and those with a null, NaN or infinite component take no part.
    Vectors of unequal length are compared as if padded with zeros; an empty one
    scores 0.  A row is never its own candidate; among rows that repeat an id,
    none is a candidate for that id, and each vector under it is one.  Ties go
    to the smaller id.  Fewer than ``k`` candidates give fewer rows, an empty
    table none.  Other columns of ``vectors`` are ignored.  Where some vector's
    squares sum to 2**63 or more, so that a score need not fit a long, a
    ValueError says so; below, no product can overflow.

    Work is queries times candidates, as exact search over a stated query set
    is; shuffled are the candidates (once), the lists' best, and what passes the
    cutoff.  The candidate blocks are read once per group of queries and phase.
    """
    ship(vectors.sparkSession)
    keep = k + 1  # one of the best may be the query's own
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("ints"), is_query.alias("is_q"))
    rows = rows.where(F.col("ints").isNotNull() & F.col("id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("ints").orderBy("id"))
    first = rows.select("ints", "id").distinct().withColumn("r", rank).where(F.col("r") <= keep)
    distinct = first.groupBy("ints").agg(F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = stage(distinct.withColumn("c", F.monotonically_increasing_id()), "topk-candidates")  # numbered once, when written
    queries = stage(
        rows.where("is_q").select("ints", "id").distinct().groupBy("ints").agg(F.collect_list("id").alias("q_ids")).join(distinct.select("ints", F.col("c").alias("q")), "ints"),
        "topk-queries",
    )
    square = F.aggregate("ints", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    n, width, most = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    if most >= 2.0**63:
        raise ValueError("vectors are too long: their inner products need not fit a 64-bit integer")
    m = queries.count()
    n_cb = max(1, -(-n // max(1, min(candidate_block, BLOCK_BYTES // (8 * max(width, 1))))))
    n_qb = max(1, -(-m // max(1, min(query_block, BLOCK_BYTES // (8 * max(width, 1))))))
    slices = max(1, min(slices, width))
    part = -(-max(width, 1) // slices)

    def block(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def packed(df: DataFrame, key: str, by: str, *more: str) -> DataFrame:
        """One row per block and list: the ids, and their vectors' components of that slice."""
        lists = df.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("cut", F.slice("ints", F.col("list") * part + 1, part))
        rows_ = lists.groupBy(by, "list").agg(F.collect_list(F.struct(F.col(key), F.col("cut"), *more)).alias("rows"))
        return rows_.select(by, "list", F.col(f"rows.{key}").alias(f"{key}_ids"), F.col("rows.cut").alias(f"{key}_ints"), *[F.col(f"rows.{x}").alias(x) for x in more])

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * width * 8 // BLOCK_BYTES)
    candidates = packed(distinct.withColumn("cb", block("c", n_cb)), "c", "cb").repartition(min(tasks, n_cb * slices), "cb", "list")
    candidates = stage(candidates, "topk-blocks")
    in_blocks = queries.withColumn("qb", block("q", n_qb))
    sizes = in_blocks.groupBy("qb").agg(F.sum(F.size("ints") * 8 + 16 * slices)).collect()  # a row per block
    groups = _groups([(r[0], r[1]) for r in sizes], query_bytes)

    def pairs(query_rows: DataFrame, *more: str) -> list[DataFrame]:
        """For each group of queries, its blocks beside all blocks of candidates."""
        numbered = query_rows.withColumn("qb", block("q", n_qb))
        some = [packed(numbered.where(F.col("qb").between(lo, hi)), "q", "qb", *more) for lo, hi in groups]
        return [candidates.join(F.broadcast(g), "list").select("list", "qb", "q_ids", "q_ints", "c_ids", "c_ints", *more) for g in some]

    def each(found: list[DataFrame], compute, name: str) -> DataFrame:
        """What ``compute`` finds in each group; one job a group, so no more than one is broadcast at once."""
        out = [g.mapInArrow(compute, _ENTRY) for g in found]
        if len(out) > 1:
            out = [stage(g, name) for g in out]
        return reduce(DataFrame.unionAll, out) if out else vectors.sparkSession.createDataFrame([], _ENTRY)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for cell, rows_, q_ids, c_ids, scores in _pairs(batch, part):
                key = cell["list"].as_py(), cell["qb"].as_py(), rows_.start
                held[key] = q_ids, _merge(held[key][1] if key in held else None, scores, c_ids, keep)
        for (which, _, _), (q_ids, (scores, ids)) in held.items():
            yield _entries(np.repeat(q_ids, ids.shape[1]), ids.ravel(), which, scores.ravel())

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows_, q_ids, c_ids, scores in _pairs(batch, part):
                bound = cell["bound"].values.to_numpy()[rows_]
                a, b = np.nonzero(scores >= -(-bound // slices)[:, None])
                yield _entries(q_ids[a], c_ids[b], cell["list"].as_py(), scores[a, b])

    def exact(pairs_: DataFrame) -> DataFrame:
        q = queries.select("q", F.col("ints").alias("x"))
        c = distinct.select("c", F.col("ints").alias("y"))
        return pairs_.join(c, "c").join(q, "q").withColumn("score", dot(F.col("x"), F.col("y"))).drop("x", "y")

    # 1: local lists, and the bound that they prove
    local = Window.partitionBy("q", "list").orderBy(F.desc("local"), "c")
    sent = each(pairs(queries), best, "topk-lists").withColumn("r", F.row_number().over(local)).where(F.col("r") <= keep)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    bounds = exact(sent.select("q", "c").distinct()).withColumn("r", place).where(F.col("r") == keep).select("q", F.col("score").alias("bound"))
    # 2: entries at or above the cutoff; without a bound there are too few candidates to leave any out
    lowest = -(2**62)
    bounded = stage(queries.select("q", "ints").join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(lowest))), "topk-bounds")
    entries = each(pairs(bounded, "bound"), beyond, "topk-entries")
    # 3: upper bounds, then exact scores of what is left
    sums = entries.groupBy("q", "c").agg(F.sum("local").alias("known"), F.count("*").alias("lists")).join(bounded.select("q", "bound"), "q")
    upper = F.col("known") + (slices - F.col("lists")) * F.ceil(F.col("bound") / slices)
    scored = exact(sums.where(upper >= F.col("bound")).select("q", "c"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    scored = scored.join(distinct.select("c", "least", "ids"), "c").withColumn("r", F.row_number().over(order))
    found = scored.where(F.col("r") <= keep).select("q", "score", F.explode("ids").alias("vec_id"))
    asked = queries.select("q", F.explode("q_ids").alias("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(found, "q").where(F.col("query_id") != F.col("vec_id")).withColumn("rank", F.row_number().over(final))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


def sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, 1 + len(q.ints)), lambda i: q.ints[i] * c.ints[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
