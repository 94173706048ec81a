"""Set-similarity self-join of n-gram sets with prefix trees.

A set that links to another shares most of its shingles with it, so it has few
that no other set has.  Counting those among one half of all shingles (by hash)
leaves the sets that can link at all.  Among them the exact number of sets that
have each shingle gives a global order: sets that link share one of their rarest
few (the prefix filter), and sets connected by such shingles form blocks that no
link leaves.  Within a block every set is a path of a trie over one order, the
shingles of most sets first, so near copies share most of their path.  A set is
looked up before it is inserted: the walk counts shared shingles once for all
sets below a node, and leaves a subtree when what remains of either side can't
reach the threshold any more, or when all below is of the set's own component
already.

Equal sets are one vertex.  Blocks of more than ``block_sets`` sets are cut into
parts, and every pair of parts is a task of its own.  Sets, edges and counts
stay in tables; the driver sees totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import n_buckets, small_batches, stage
from lattica.llm.packed import Ranges, components, min_labels, mix, steps

WORDS, PERCENT = 5, 75
BLOCK_SETS = 4096
BUCKET_TOKENS = 2_000_000
#: Shingles with a smaller hash are counted to leave sets out; the others only in what is left.
COUNTED = np.uint64(1 << 63)
_FEATURES = "doc_id long, h1 long, h2 long, n long"
_ONCE = "bucket int, keys binary, sids binary, runs binary"
_ENTRIES = "bucket int, a binary, b binary"
_SHARED = "part int, keys binary, sids binary, number binary"


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    begins[inner] = ~space[inner]
    ends[inner - 1] = ~space[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = Ranges(low).hash(start, stop)
    first = np.searchsorted(start, bounds)  # of each text, in words
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    odd = np.uint64(2) * np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    place = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    total, left = np.zeros(len(place), np.uint64), np.repeat(np.minimum(count, size), n)
    for i in range(size):
        total += np.where(left > i, padded[place + i] * odd[i], np.uint64(0))
    grams = mix(total + left.astype(np.uint64))
    for i in np.flatnonzero(n > 1):
        grams[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[at[:-1][n > 0]] = True
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def digests(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)))]) for salt in (1, 0x5DEECE66D)]
    return tuple(mix(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def _feature_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, bounds in steps(batch.column(0), batch.column(1)):
            grams, at = shingles(data, bounds, size)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (*digests(grams, at), np.diff(at)))], names=["doc_id", "h1", "h2", "n"])


def required(n, percent: int = PERCENT):
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-n * percent // 100)


def _deal(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, cuts, np.flatnonzero(np.diff(cuts))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _counted_rows(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The counted shingles of a step by bucket, six bytes each, set after set; one that several sets here have comes once, without a set.

    Shingles that agree in those six bytes count as shared, which leaves more sets in.
    """
    for batch in batches:
        for _, data, bounds in steps(batch.column(0), batch.column(1)):
            grams, at = shingles(data, bounds, size)
            sid = digests(grams, at)[0]
            _, one = np.unique(sid, return_index=True)
            doc = np.repeat(np.arange(len(sid)), np.diff(at))
            use = np.zeros(len(sid), bool)
            use[one] = True
            use = use[doc] & (grams < COUNTED)
            keys, doc = grams[use] & np.uint64(2**48 - 1), doc[use]
            value, first, number = np.unique(keys, return_index=True, return_counts=True)
            first = first[np.argsort(doc[first] + len(sid) * (number > 1), kind="stable")]  # set after set, the shared last
            shared = np.zeros(len(keys), bool)
            shared[np.unique(keys, return_index=True)[1][number > 1]] = True
            keys, owner = keys[first], np.where(shared[first], -1, doc[first])
            order, cuts, full = _deal(_bucket_of(keys, buckets), buckets)
            keys, owner = keys[order], owner[order]
            six = np.frombuffer(keys.astype("<u8").tobytes(), np.uint8).reshape(-1, 8)[:, :6]
            rows = []
            for i in full:
                own = owner[cuts[i] : cuts[i + 1]]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                runs = np.diff(np.append(starts, len(own))).astype(np.int32)
                sets = np.where(own[starts] >= 0, sid[own[starts]], 0)
                if own[-1] < 0:
                    runs[-1] = -runs[-1]
                rows.append((int(i), six[cuts[i] : cuts[i + 1]].tobytes(), sets.tobytes(), runs.tobytes()))
            yield _batch(rows, _ONCE)


def _alone(table: pa.Table, parts: int) -> pa.Table:
    """Of a bucket: how many shingles each set has that no other has, packed by parts of the sets."""
    raw = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, 6)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :6] = raw
    keys = keys.view("<u8").ravel()
    sids, runs = np.frombuffer(b"".join(table["sids"].to_pylist()), np.int64), np.frombuffer(b"".join(table["runs"].to_pylist()), np.int32)
    sids, shared = np.repeat(sids, np.abs(runs)), np.repeat(runs < 0, np.abs(runs))
    order = np.argsort(keys)
    k, s, m = keys[order], sids[order], shared[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    alone = (np.minimum.reduceat(s, starts) == np.maximum.reduceat(s, starts)) & ~np.logical_or.reduceat(m, starts)
    sid, n = np.unique(s[starts[alone]], return_counts=True)
    order, cuts, full = _deal(_bucket_of(sid.view(np.uint64), parts), parts)
    sid, n = sid[order], n[order].astype(np.int32)
    return pa.Table.from_batches([_batch([(int(i), sid[cuts[i] : cuts[i + 1]].tobytes(), n[cuts[i] : cuts[i + 1]].tobytes()) for i in full], _ENTRIES)])


def _sums(table: pa.Table) -> pa.Table:
    sids, counts = np.frombuffer(b"".join(table["a"].to_pylist()), np.int64), np.frombuffer(b"".join(table["b"].to_pylist()), np.int32)
    sid, inverse = np.unique(sids, return_inverse=True)
    return pa.table({"sid": pa.array(sid), "alone": pa.array(np.bincount(inverse, counts, len(sid)).astype(np.int64))})


def _set_keys(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for sid, raw in zip(batch["h1"].to_pylist(), batch["keys"].to_pylist()):
        yield sid, np.frombuffer(raw, np.uint64)


def _in_parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = _bucket_of(batch["h1"].to_numpy().view(np.uint64), parts).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["h1", "n", "of_part"])


def _all_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """All shingles of the sets that are left, by bucket, with their set."""
    for batch in batches:
        found = list(_set_keys(batch))
        if found:
            keys = np.concatenate([k for _, k in found])
            sids = np.repeat([s for s, _ in found], [len(k) for _, k in found])
            order, cuts, full = _deal(_bucket_of(keys, buckets), buckets)
            keys, sids = keys[order], sids[order]
            yield _batch([(int(i), keys[cuts[i] : cuts[i + 1]].tobytes(), sids[cuts[i] : cuts[i + 1]].tobytes()) for i in full], _ENTRIES)


def _counts(table: pa.Table, parts: int) -> pa.Table:
    """Of a bucket: each set's shingles that others have too, and how many sets have them, packed by parts of the sets."""
    keys, sids = np.frombuffer(b"".join(table["a"].to_pylist()), np.uint64), np.frombuffer(b"".join(table["b"].to_pylist()), np.int64)
    _, inverse, number = np.unique(keys, return_inverse=True, return_counts=True)
    number = number[inverse]
    keys, sids, number = keys[number > 1], sids[number > 1], number[number > 1].astype(np.uint32)
    order, cuts, full = _deal(_bucket_of(sids.view(np.uint64), parts), parts)
    keys, sids, number = keys[order], sids[order], number[order]
    rows = [(int(i), *(x[cuts[i] : cuts[i + 1]].tobytes() for x in (keys, sids, number))) for i in full]
    return pa.Table.from_batches([_batch(rows, _SHARED)])


def _prefixes(counts: pa.Table, sizes: pa.Table, percent: int, buckets: int) -> pa.Table:
    """The rarest shingles of each set that it must share with what it links to; those that it has alone are its rarest."""
    keys, sids, number = (np.frombuffer(b"".join(counts[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("sids", np.int64), ("number", np.uint32)))
    order = np.lexsort((keys, number, sids))
    keys, sids = keys[order], sids[order]
    sid, first, shared = np.unique(sids, return_index=True, return_counts=True)
    known, n = sizes["h1"].to_numpy(), sizes["n"].to_numpy()
    by_id = np.argsort(known)
    n = n[by_id][np.searchsorted(known[by_id], sid)] if len(sid) else first
    take = np.clip(n - required(n, percent) + 1 - (n - shared), 0, shared)
    chosen = np.arange(len(keys)) - np.repeat(first, shared) < np.repeat(take, shared)
    return pa.Table.from_batches(list(_send(keys[chosen], sids[chosen], buckets)))


def _connect(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with one vertex each, and edges from every vertex to the smallest that keys connect it to."""
    vertices, v = np.unique(sids, return_inverse=True)
    root = vertices[min_labels(keys, v, len(vertices))]
    key, first = np.unique(keys, return_index=True)
    apart = root != vertices
    return key, root[v[first]], vertices[apart], root[apart]


def _send(keys: np.ndarray, sids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each key once with one of the sets that it connects here, by bucket; and the connections, in buckets below 0."""
    key, vertex, a, b = _connect(keys, sids)
    order, cuts, full = _deal(_bucket_of(key, buckets), buckets)
    key, vertex = key[order], vertex[order]
    rows = [(int(i), key[cuts[i] : cuts[i + 1]].tobytes(), vertex[cuts[i] : cuts[i + 1]].tobytes()) for i in full]
    if len(a):
        rows.append((-1 - int(a[0] % buckets), a.tobytes(), b.tobytes()))
    yield _batch(rows, _ENTRIES)


def _edges(entries: pa.Table) -> pa.Table:
    a = np.frombuffer(b"".join(entries["a"].to_pylist()), np.uint64)
    b = np.frombuffer(b"".join(entries["b"].to_pylist()), np.int64)
    if entries["bucket"][0].as_py() >= 0:
        _, _, a, b = _connect(a, b)
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b)})


class _Node:
    __slots__ = ("label", "children", "member", "rep", "mixed", "least", "most")

    def __init__(self, label: np.ndarray, member: int, rep: int, n: int):
        self.label, self.children, self.member, self.rep = label, {}, member, rep
        self.mixed, self.least, self.most = False, n, n


class Trie:
    """Sets in global order, one path each, with the walk that finds a set's links."""

    def __init__(self, sets: list[np.ndarray], parent: list[int], percent: int = PERCENT):
        self.sets, self.parent, self.percent, self.root = sets, parent, percent, None

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def insert(self, i: int) -> None:
        keys, n = self.sets[i], len(self.sets[i])
        if self.root is None:
            self.root = _Node(keys[:0], -1, i, n)
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            node.mixed = node.mixed or self.find(node.rep) != self.find(i)
            below = node.children.get(int(keys[at])) if at < n else None
            if below is None:
                if at == n:
                    node.member = i
                else:
                    node.children[int(keys[at])] = _Node(keys[at:], i, i, n)
                return
            k = min(len(below.label), n - at)
            differ = np.flatnonzero(below.label[:k] != keys[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(below.label):  # split
                upper = _Node(below.label[:k], -1, below.rep, below.least)
                upper.most, upper.mixed = below.most, below.mixed
                upper.children[int(below.label[k])] = below
                below.label = below.label[k:]
                node.children[int(keys[at])] = upper
                below = upper
            node, at = below, at + k

    def uniform(self, node: _Node) -> bool:
        """Whether all below is of one component; what was mixed may have been joined since."""
        if node.mixed:
            roots = {self.find(c.rep) for c in node.children.values() if not c.mixed}
            if node.member >= 0:
                roots.add(self.find(node.member))
            node.mixed = len(roots) != 1 or any(c.mixed for c in node.children.values())
        return not node.mixed

    def link(self, i: int) -> None:
        """Join set i with the components of all that it links to."""
        keys, n, p = self.sets[i], len(self.sets[i]), self.percent
        stack = [(self.root, 0, 0, 0)] if self.root is not None else []
        while stack:
            node, at, shared, depth = stack.pop()
            if node.most * 100 < p * n or n * 100 < p * node.least or self.uniform(node) and self.find(node.rep) == self.find(i):
                continue
            if len(node.label):
                where = np.searchsorted(keys, node.label)
                hits = keys[np.minimum(where, n - 1)] == node.label
                shared += int(hits.sum())
                at, depth = int(where[-1]) + bool(hits[-1]), depth + len(node.label)
            need = -(-p * (n + max(node.least, required(n, p))) // (100 + p))
            if shared + min(n - at, node.most - depth) < need:
                continue
            if node.member >= 0:
                m = len(self.sets[node.member])
                if 100 * shared >= p * (n + m - shared):
                    self.join(i, node.member)
            stack += [(c, at, shared, depth) for c in node.children.values()]


def _links(table: pa.Table, percent: int) -> pa.Table:
    """Edges (a, b) between sets: each set's first, and the first of what it is linked with in the same pair of parts."""
    columns = {c: table[c].to_pylist() for c in ("block", "i", "j", "h1", "h2", "part")}
    groups: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(columns["block"], columns["i"], columns["j"])):
        groups.setdefault(key, []).append(row)
    sids, part, mark = columns["h1"], columns["part"], list(zip(columns["h1"], columns["h2"]))
    a, b = [], []
    for (_, i, j), rows in groups.items():
        rows = sorted({mark[r]: r for r in rows}.values(), key=lambda r: mark[r])
        raw = [np.frombuffer(table["keys"][r].as_py(), np.uint64) for r in rows]
        _, inverse, number = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        place = np.empty(len(number), np.int64)
        place[np.argsort(-number, kind="stable")] = np.arange(len(number))  # the order: of most sets first, then by hash
        sets = [np.sort(x) for x in np.split(place[inverse], np.cumsum([len(x) for x in raw])[:-1])]
        trie = Trie(sets, list(range(len(rows))), percent)
        if i == j:
            for k in range(len(rows)):
                trie.link(k)
                trie.insert(k)
        else:
            for k, r in enumerate(rows):
                if part[r] == i:
                    trie.insert(k)
            for k, r in enumerate(rows):
                if part[r] == j:
                    trie.link(k)
        for k, r in enumerate(rows):
            if trie.find(k) != k:
                a.append(sids[r])
                b.append(sids[rows[trie.find(k)]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of other than space and U+0009 to U+000D, A-Z lower-cased;
    texts of fewer than ``size`` words are one shingle.  Sets link when
    100 * intersection >= percent * union.  Null texts and texts without words
    are empty and linked with nothing.  Equal sets always link, so exact copies
    and repeated rows share a component; the smallest doc_id names it.  Columns
    but doc_id (long) and text are ignored.  Shingles are compared by 64-bit
    hashes, and sets are told apart by 128 bits and named by 64 of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(docs.mapInArrow(lambda it: _feature_rows(it, size), _FEATURES), "join-features")
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = n_buckets(spark, tokens // 2, BUCKET_TOKENS)
    # sets that can link
    counted = docs.mapInArrow(lambda it: _counted_rows(it, size, buckets), _ONCE).groupBy("bucket").applyInArrow(lambda t: _alone(t, buckets), _ENTRIES)
    alone = counted.withColumnRenamed("bucket", "part").groupBy("part").applyInArrow(_sums, "sid long, alone long")
    distinct = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    may = distinct.join(alone, F.col("h1") == F.col("sid"), "left").where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") * (100 - percent) / 100))
    may = may.select(F.col("rep").alias("doc_id"), F.col("h1").alias("s1"), F.col("h2").alias("s2"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, data, bounds in steps(batch.column(0), batch.column(1)):
                grams, at = shingles(data, bounds, size)
                h1, h2 = digests(grams, at)
                some = batch.slice(done, len(h1))
                done += len(h1)
                mine = np.flatnonzero((h1 == some["s1"].to_numpy()) & (h2 == some["s2"].to_numpy()))
                keys = pa.array([grams[at[i] : at[i + 1]].tobytes() for i in mine], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h1[mine]), pa.array(h2[mine]), pa.array(np.diff(at)[mine]), keys], names=["h1", "h2", "n", "keys"])

    sets = stage(docs.join(may, "doc_id").mapInArrow(take, "h1 long, h2 long, n long, keys binary"), "join-sets")
    # blocks
    left = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = n_buckets(spark, left, BUCKET_TOKENS)
    counts = sets.mapInArrow(lambda it: _all_rows(it, some), _ENTRIES).groupBy("bucket").applyInArrow(lambda t: _counts(t, some), _SHARED)
    sizes = sets.select("h1", "n").mapInArrow(lambda it: _in_parts(it, some), "h1 long, n long, of_part int")
    entries = counts.groupBy("part").cogroup(sizes.groupBy("of_part")).applyInArrow(lambda c, s: _prefixes(c, s, percent, some), _ENTRIES)
    inside = components(entries.groupBy("bucket").applyInArrow(_edges, "a long, b long"), "join-blocks")
    members = inside.select(F.col("v").alias("h1"), F.col("root").alias("block")).union(inside.select("root", "root").distinct())
    parts = members.groupBy("block").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("parts"))
    # links
    placed = sets.join(members, "h1").join(parts, "block").withColumn("part", F.pmod("h2", F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")
    dealt = pairs.withColumn("task", F.pmod(F.xxhash64("block", "i", "j"), F.lit(some)))
    links = dealt.groupBy("task").applyInArrow(lambda t: _links(t, percent), "a long, b long")
    roots = components(links, "join-links")
    named = distinct.join(roots, F.col("h1") == F.col("v"), "left").select("h1", "h2", F.coalesce("root", "h1").alias("root"), "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = named.join(least, "root").select("h1", "h2", "component_id")
    found = rows.join(of_set, ["h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
sizes AS (SELECT doc_id, len(grams)::BIGINT AS n FROM sets),
g AS (SELECT doc_id, unnest(grams) AS gram FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sizes UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v)
SELECT v AS doc_id, any_value(n) AS n_shingles, min(r) AS component_id FROM reach JOIN sizes ON sizes.doc_id = v GROUP BY v"""
