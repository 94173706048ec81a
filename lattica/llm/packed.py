"""Byte-level hashing of whole Arrow batches, and connected components.

A text column is one byte buffer with bounds; hashes of any byte range come from
one running sum over the buffer, so words, shingles and windows cost a few numpy
operations for a batch and none for a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage, unstage

#: Bytes of text that one step handles; a longer text is a step of its own.
STEP_BYTES = 4 << 20
_BASE = 0x5851F42D4C957F2D  # odd
_WORD64 = np.uint64(64)
#: Tables of powers grow by this many.
_POWERS_STEP = 1 << 17


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)


_made: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first ``n`` powers of the base.  The longest table that was needed is kept, and no longer one: a worker holds it while it idles."""
    n_kept = len(_made.get(inverse, ()))
    if not n_kept or n_kept < n:
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        out = np.full(max(-(-n // _POWERS_STEP), 1) * _POWERS_STEP, base, np.uint64)
        out[0] = 1
        _made[inverse] = np.multiply.accumulate(out, out=out)
    return _made[inverse][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ranges:
    """Hashes of ranges of ``data`` (uint8): equal bytes, equal hash."""

    def __init__(self, data: np.ndarray):
        self.inverse = _powers(len(data) + 1, True)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * _powers(len(data), False), out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def hash_width(self, width: int) -> np.ndarray:
        """Of every range of ``width`` bytes."""
        n = max(len(self.sums) - width, 0)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def steps(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows in steps: their keys, all their bytes, and bounds of each text in them (null: empty)."""
    blank = b"" if pa.types.is_binary(texts.type) else ""
    texts = pc.fill_null(texts, blank).cast(pa.large_binary())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_BYTES, "right")))
        some = texts.slice(at, to - at)
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield keys.slice(at, to - at), data, offsets - offsets[0]
        at = to


def min_labels(groups: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    """Nodes (0 to n - 1) that share a group, directly or in steps, get the smallest of them as label."""
    label = np.arange(n)
    order = np.argsort(groups, kind="stable")
    g, v = groups[order], nodes[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(g)))
    keep = np.repeat(sizes > 1, sizes)
    v, sizes = v[keep], sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    while len(v):
        least = np.repeat(np.minimum.reduceat(label[v], starts), sizes)
        new = label.copy()
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) that is not the smallest of its component; root is.

    Large stars and small stars in turn.  Each round is a written table, and only
    counts of it reach the driver.
    """
    u, w = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")
    now = stage(edges.where("a <> b").select(u, w).distinct(), f"{name}-edges")
    mark = (F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)")))
    seen = now.agg(*mark).first()
    while seen[0]:
        both = now.union(now.select("w", "u")).toDF("v", "x")
        least = both.groupBy("v").agg(F.min("x").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("x > v").select(F.col("x").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        small = large.join(large.groupBy("u").agg(F.min("w").alias("m")), "u")
        following = small.select("u", F.col("m").alias("w")).union(small.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w")))
        following = stage(following.distinct(), f"{name}-edges")
        marked = following.agg(*mark).first()
        unstage(now)
        now = following
        if marked == seen:
            break
        seen = marked
    return now.select(F.col("u").alias("v"), F.col("w").alias("root"))
