import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing as m


def targets(sizes: dict, weights=(1, 2, 3), cap=3):
    """The contract, literally: share by weight, stop at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def test_documents(spark, sf, documents):
    rows = m.op9_mix_sources(spark, sf).collect()
    text = {r["doc_id"]: r for r in documents.collect()}
    sizes = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = text[r["doc_id"]]["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
    want, taken = targets(sizes), {}
    for r in rows:
        s = text[r["doc_id"]]["source"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.05, abs=64)
    assert sorted(rows) == sorted(m.op9_mix_sources(spark, sf).collect())


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10}, {"a": 5, None: 900, "": 300}, {"a": 1, "b": 1, "c": 1, "d": 100000}, {"x": 7}])
def test_targets_stop_at_caps(spark, sizes):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        assert r["taken"] == pytest.approx(r["target"], rel=0.02, abs=64)


def test_pieces_add_up_and_odd_rows(odd, nothing):
    out = m.mix(odd).collect()
    assert len(out) == odd.count() and m.mix(nothing).count() == 0
    for r in out:
        assert sum(p["n"] * p["copies"] for p in r["pieces"]) == r["taken"]
        assert all(0 <= p["first"] and p["first"] + p["n"] <= r["size"] and p["copies"] <= 3 for p in r["pieces"])
    assert {r["taken"] for r in out if r["size"] == 0} == {0}


def test_permutation_visits_every_block(spark):
    counts = spark.createDataFrame([(False, "s", 2097143, 0, 2097143)], "no_source boolean, source_key string, blocks long, shard long, n long")
    copies = m.block_copies(counts).drop("shards")
    assert copies.agg(F.count("*"), F.max("copies"), F.min("block"), F.max("block")).first()[:] == (2097143, 1, 0, 2097142)


def draw(wanted, seed, shard_slots):
    """The draw, literally: (source, shard) of every slot; ``wanted``: (key, units) in order."""
    import xxhash

    ends, total = [], 0
    for key, units in wanted:
        total += units
        ends.append((total, key))
    n = max(-(-total // m.UNIT), 1)
    slots = min(shard_slots, int((n - 1) ** 0.5) + 1)
    shards = -(-n // slots)
    length = slots * shards * m.UNIT

    def spark_hash(seed, t):  # Spark's xxhash64 of an int, then a long
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(t.to_bytes(8, "little"), h)
        return h - (1 << 64) if h >> 63 else h

    for t in range(slots):
        for s in range(shards):
            point = (spark_hash(seed, t) % length + s * slots * m.UNIT) % length
            if key := next((k for e, k in ends if point < e), None):
                yield key, s


@pytest.mark.parametrize("seed, shard_slots", [(17, 256), (3, 256), (17, 5)])
def test_every_row_against_a_twin(spark, documents, seed, shard_slots):
    """Targets, draws, permutations and blocks again in plain Python."""
    import collections
    import math

    import xxhash

    rows = m.mix(documents, seed=seed, shard_slots=shard_slots).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    key = {s: (s is None, s or "") for s in order}
    blocks = {s: -(-sizes[s] // m.BLOCK_WORDS) for s in order}
    units = [(key[s], round(want[s] * blocks[s] / sizes[s] * m.UNIT)) for s in order if want[s] > 0]
    counts = collections.Counter(draw(units, seed, shard_slots))
    copies = collections.defaultdict(list)
    for s in order:
        k, n = 0, blocks[s]
        a = next((p for p in m.PRIMES if n % p), 1)
        for shard in sorted(sh for src, sh in counts if src == key[s]):
            for _ in range(counts[key[s], shard]):
                if k < 3 * n:
                    h = xxhash.xxh64_intdigest((seed + 1).to_bytes(4, "little"), 42)
                    h = xxhash.xxh64_intdigest(int(s is None).to_bytes(4, "little"), h)
                    h = xxhash.xxh64_intdigest((s or "").encode(), h)
                    h = xxhash.xxh64_intdigest((k // n).to_bytes(8, "little"), h)
                    h -= (1 << 64) if h >> 63 else 0
                    copies[s, (a * (k % n) + h % n) % n].append(shard)
                k += 1
    placed = {r["doc_id"]: r["start"] for r in m.place_documents(m.document_sizes(documents).where("size > 0")).collect()}
    taken = collections.Counter()
    for r in rows:
        found = []
        if r["size"]:
            start, stop = placed[r["doc_id"]], placed[r["doc_id"]] + r["size"]
            for block in range(start // m.BLOCK_WORDS, (stop - 1) // m.BLOCK_WORDS + 1):
                begin, end = max(block * m.BLOCK_WORDS, start), min((block + 1) * m.BLOCK_WORDS, stop)
                if went := copies.get((r["source"], block)):
                    found.append((begin - start, end - begin, len(went), sorted(went)))
        assert [tuple(p) for p in r["pieces"]] == found
        assert r["taken"] == sum(n * c for _, n, c, _ in found)
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 3 * math.sqrt(min(shard_slots, 256)) * m.BLOCK_WORDS


def test_draws_decide_and_stay_near_targets(spark, documents):
    one, two = ({r["doc_id"]: r["taken"] for r in m.mix(documents, seed=s).collect()} for s in (1, 2))
    assert one != two


def test_repeated_rows_stay_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "", "s"), (1, "", "s"), (None, "x y", None), (None, "x y", None)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 0), ("1", 0), ("1", 3), ("1", 3), ("None", 2), ("None", 2)]


def test_no_python_on_executors(documents):
    plan = m.mix(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
