from collections import Counter

import numpy as np
import pytest

from lattica.llm import chroma as c


def tone(hz, n, rate=c.RATE):
    return np.clip(128 + 100 * np.sin(2 * np.pi * hz * np.arange(n) / rate), 0, 255).astype(np.uint8)


def prints_of(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([b for _, b in rows], pa.binary())], names=["doc_id", "audio"])
    (out,) = c._print_rows(iter([batch]), c.RATE, c.FRAME, c.HOP)
    return [np.frombuffer(x, "<u4") for x in out["prints"].to_pylist()]


def runs_of(x):
    return [tuple(x[k : k + c.RUN]) for k in range(len(x) - c.RUN + 1)]


def brute(rows):
    """The rules of ``align``, literally; components from all pairs that share a run."""
    prints = dict(zip([i for i, _ in rows], prints_of(rows)))
    rep = {i: next((j for j in sorted(prints) if len(prints[i]) and np.array_equal(prints[j], prints[i])), i) for i in prints}
    classes = sorted(i for i in set(rep.values()) if len(prints[i]))
    first = {}
    for i in classes:
        for k, key in enumerate(runs_of(prints[i])):
            first.setdefault(key, (i, k))
    best, degree = {}, Counter()
    for i in classes:
        votes = {}
        for k, key in enumerate(runs_of(prints[i])):
            j, there = first[key]
            if j < i:
                votes.setdefault(j, {}).setdefault(k - there, []).append(k)
        found = []
        for j, histogram in votes.items():
            degree[i] += 1
            degree[j] += 1
            n, offset = min((-len(ks), o) for o, ks in histogram.items())
            error = c.bit_errors(prints[i], prints[j], offset, min(histogram[offset]), max(histogram[offset]) + c.RUN)
            if error <= c.MAX_ERROR:
                found.append((n, error, j, offset))
        if found:
            n, error, j, offset = min(found)
            best[i] = (j, offset, -n, error)
    own, root = {i: set(runs_of(prints[i])) for i in classes}, {i: i for i in prints}
    for i in classes:
        for j in classes:
            if own[i] & own[j]:
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return sorted((i, len(dict(rows)[i] or b""), len(prints[i]), rep[i], *best.get(rep[i], (None,) * 4), degree[rep[i]], root[rep[i]]) for i in prints)


def same(got, want):
    assert [g[:7] + g[8:] for g in got] == [w[:7] + w[8:] for w in want]
    assert [g[7] for g in got] == [pytest.approx(w[7]) if w[7] is not None else None for w in want]


def test_pitch_classes_of_tones():
    for step in range(12):
        hz = 880 * 2 ** (step / 12)
        energy = c.chroma((tone(hz, 4096, 32000).astype(np.float32) - 128) / 128, np.array([0]), rate=32000, frame=4096)
        assert energy[0].argmax() == step


def test_integral_image_against_plain_sums():
    rng = np.random.default_rng(0)
    energy = rng.random((60, 12)).astype(np.float32)
    both, n = c.packed_prints(np.concatenate([energy, energy[:30]]), np.array([60, 30]))
    alone, _ = c.packed_prints(energy, np.array([60]))
    assert n.tolist() == [41, 11] and np.array_equal(both[:41], alone) and np.array_equal(both[41:], alone[:11])
    assert len(c.filters()) == 16 and all(y + h <= 12 and w <= c.WINDOW for _, y, h, w in c.filters())
    kind, y, h, w = c.filters()[2]
    assert kind == 2
    smooth = np.sqrt(sum(f * energy[i : 56 + i] for i, f in enumerate(c.SMOOTHING)))
    smooth /= np.sqrt((smooth**2).sum(1, keepdims=True))
    value = np.log((1 + smooth[: w // 2, y : y + h].sum()) / (1 + smooth[w // 2 : w, y : y + h].sum()))
    bits = (int(alone[0]) >> (2 * (15 - 2))) & 3
    assert bits == [0, 1, 3, 2][int(np.searchsorted((-c.LEVEL, 0.0, c.LEVEL), value))]


def test_alignment_against_brute_force(spark):
    rng = np.random.default_rng(4)
    noise = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    song = noise(9000)
    rows = [(1, song), (2, song), (3, song[64 * 20 :]), (4, noise(64 * 30) + song[:6000]), (5, noise(5000)), (6, None), (7, b""), (8, b"x" * 300)]
    rows += [(9, tone(440, 4000).tobytes()), (10, tone(440, 3000).tobytes())]
    df = spark.createDataFrame(rows, "doc_id long, audio binary").selectExpr("*", "1 AS prints", "2 AS rep")
    got = sorted((tuple(r) for r in c.align(c.fingerprints(df)).collect()), key=lambda r: r[0])
    same(got, brute(rows))
    assert got[1][3] == 1 and got[2][4:6] == (1, -20) and got[3][4:6] == (1, 30) and got[4][4] is None


def test_documents_and_odd_rows(spark, sf, documents, odd, nothing):
    rows = [(r["doc_id"], r["text"].encode()) for r in documents.select("doc_id", "text").collect()]
    same(sorted((tuple(r) for r in c.op4_chroma(spark, sf).collect()), key=lambda r: r[0]), brute(rows))
    assert c.align(c.fingerprints(odd, "text")).count() == odd.count()
    assert c.align(c.fingerprints(nothing, "text")).count() == 0


def test_later_holders_meet_whoever_was_first(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    a, b, tail = noise(6400), noise(6400), noise(3200)
    parts = [noise(3200) for _ in range(4)]
    rows = [(1, a), (2, b), (3, a + b), (4, noise(5000))]
    rows += [(10 + i, p + noise(9600)) for i, p in enumerate(parts)]
    rows += [(20, b"".join(parts)), (21, b"".join(parts) + tail), (22, tail + noise(64) + b"".join(parts))]
    df = spark.createDataFrame([(i, bytes(x)) for i, x in rows], "doc_id long, audio binary")
    got = sorted((tuple(r) for r in c.align(c.fingerprints(df)).collect()), key=lambda r: r[0])
    same(got, brute(rows))
    by_id = {g[0]: g for g in got}
    assert [by_id[i][-1] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert len({by_id[i][-1] for i in (10, 11, 12, 13, 20, 21, 22)}) == 1


def test_passages_and_noise(spark):
    """A passage in the middle of other sound aligns without errors; copies with some noise align at the right place."""
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(0, 256, n).astype(np.uint8)
    passage = noise(6400)
    rows = [(1, np.concatenate([noise(64 * 100), passage, noise(64 * 70)])), (2, np.concatenate([noise(64 * 30), passage, noise(64 * 150)]))]
    melody = np.concatenate([tone(hz, 1600) for hz in rng.uniform(200, 1500, 40)])
    rows += [(10, melody)] + [(11 + i, np.clip(melody + rng.normal(0, level, len(melody)), 0, 255).round().astype(np.uint8)) for i, level in enumerate((0.5, 1.0, 2.0))]
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in rows], "doc_id long, audio binary")
    got = {r["doc_id"]: r for r in c.align(c.fingerprints(df)).collect()}
    assert (got[2]["aligned_to"], got[2]["offset"], got[2]["bit_error_rate"]) == (1, -70, 0.0)
    for i in (11, 12, 13):
        assert got[i]["aligned_to"] is not None and got[i]["offset"] == 0 and got[i]["bit_error_rate"] <= c.MAX_ERROR and got[i]["component_id"] == 10


def test_many_near_copies_make_few_links(spark):
    rng = np.random.default_rng(5)
    song = rng.integers(0, 256, 12_000).astype(np.uint8)
    rows = []
    for i in range(300):
        copy = song.copy()
        copy[rng.integers(0, 12_000, 3)] ^= np.uint8(1 << rng.integers(3, 7))
        rows.append((i, copy.tobytes()))
    df = spark.createDataFrame(rows, "doc_id long, audio binary")
    prints = c.fingerprints(df)
    assert c.align(prints).select("component_id").distinct().count() == 1
    assert c.links(prints).count() < 300 * 30


def brute_all(rows, max_error=c.MAX_ERROR):
    """The rules of ``align_all``, literally, pair by pair."""
    prints = dict(zip([i for i, _ in rows], prints_of(rows)))
    rep = {i: next((j for j in sorted(prints) if len(prints[i]) and np.array_equal(prints[j], prints[i])), i) for i in prints}
    best, degree = {}, Counter()
    classes = sorted(i for i in set(rep.values()) if len(prints[i]))
    for i in classes:
        found = []
        for j in (j for j in classes if j < i):
            first = {}
            for k, key in enumerate(runs_of(prints[j])):
                first.setdefault(key, k)
            histogram = {}
            for k, key in enumerate(runs_of(prints[i])):
                if key in first:
                    histogram.setdefault(k - first[key], []).append(k)
            if histogram:
                degree.update((i, j))
                n, offset = min((-len(ks), o) for o, ks in histogram.items())
                error = c.bit_errors(prints[i], prints[j], offset, min(histogram[offset]), max(histogram[offset]) + c.RUN)
                found += [(n, error, j, offset)] * (error <= max_error)
        if found:
            n, error, j, offset = min(found)
            best[i] = (j, offset, -n, error)
    roots = {w[0]: w[-1] for w in brute(rows)}
    return sorted((i, len(dict(rows)[i] or b""), len(prints[i]), rep[i], *best.get(rep[i], (None,) * 4), degree[rep[i]], roots[i]) for i in prints)


def shared_passages():
    """One passage in all, in near copies and between other sound; tones, whose runs repeat; and passages first held by others."""
    rng = np.random.default_rng(12)
    noise = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    passage, parts = noise(64 * 50), [noise(3200) for _ in range(3)]
    rows = [(i, noise(64 * int(rng.integers(0, 40))) + passage + noise(64 * int(rng.integers(0, 40)))) for i in range(12)]
    rows += [(20 + i, tone(440, 3000 + 640 * i).tobytes()) for i in range(4)]
    rows += [(30 + i, p + noise(4800)) for i, p in enumerate(parts)]
    rows += [(40, noise(64) + b"".join(parts)), (41, noise(64 * 9) + parts[2] + parts[0]), (42, parts[0] + noise(640) + parts[2]), (43, noise(5000)), (44, None)]
    song = np.frombuffer(noise(9000), np.uint8)
    for i in range(8):
        copy = song.copy()
        copy[rng.integers(0, 9000, 2)] ^= np.uint8(64)
        rows.append((50 + i, copy.tobytes()))
    return [*rows, (60, rows[-1][1])]


def test_all_pairs_against_brute_force(spark):
    """Later holders of a run are linked and aligned with each other, in one block as in many."""
    rows = shared_passages()
    df = spark.createDataFrame([(i, x and bytes(x)) for i, x in rows], "doc_id long, audio binary")
    want = brute_all(rows)
    for block_bytes in (c.BLOCK_BYTES, 1500):
        got = sorted((tuple(r) for r in c.align_all(c.fingerprints(df), block_bytes=block_bytes).collect()), key=lambda r: r[0])
        same(got, want)
    by_id = {w[0]: w for w in want}
    assert all(by_id[i][8] == 11 for i in range(12))


def test_the_query_counts_all_links(spark, tmp_path):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ,.\n!?", np.uint8)
    rng = np.random.default_rng(6)
    text = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    passage = text(64 * 40)
    rows = [(i, text(64 * 30) + passage + text(64 * 30)) for i in range(5)] + [(9, text(5000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_links"] for r in c.op4_chroma(spark, str(tmp_path)).collect()}
    assert got == {**{i: 4 for i in range(5)}, 9: 0}


def test_pairs_in_small_steps():
    prints = prints_of(shared_passages())

    def of(step):
        return sorted(tuple(round(float(v), 9) for v in row) for some in c.pair_peaks(prints, step=step) for row in zip(*some))

    assert of(c.STEP_VOTES) == of(40) == of(3)
