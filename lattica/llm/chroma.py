"""Chroma fingerprints of audio columns, and the alignment of recordings.

A recording becomes frames of twelve pitch classes: the energy of each frame's
spectrum by note, whatever the octave, smoothed over time and normalized.
Sixteen filters compare areas of a window of frames, and sums over areas come
from an integral image; each comparison is two bits in Gray code, so a place in
a recording is one packed 32-bit integer.

Recordings that hold the same run of integers are linked.  Every run votes, at
each of its places, for the offset to the recording in which it occurs first;
the offset histogram of each pair has a peak, and the bit errors between the
first and the last vote at the peak decide on the alignment.  Having a run is an
equivalence, so links to the first holder of each connect all its holders, and
the components are those of all pairs though the links grow with the input.
Equal fingerprints are one class.

``align_all`` goes on from these components: all pairs within one are compared
in blocks, so each pair that shares a run has its votes, whoever was first, and
only sums and the best of each class leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import n_buckets, small_batches, stage
from lattica.llm.packed import Ranges, components, mix, steps

#: Samples a second, samples of a frame, samples from frame to frame.
RATE, FRAME, HOP = 8000, 256, 64
LOWEST_HZ, HIGHEST_HZ = 100.0, 3600.0
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
#: Frames of a filter's window, and the level that parts weak from strong differences.
WINDOW, LEVEL = 16, 0.08
RUN, MAX_ERROR = 6, 0.15
#: Bytes of fingerprints of a block; the pairs of two blocks are a task.
BLOCK_BYTES = 512 << 10
#: Votes, or compared integers, that a task holds at once.
STEP_VOTES = 1 << 21
_PRINTS = "doc_id long, n_samples long, h1 long, h2 long, prints binary"


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters: every kind, band and width in turn."""
    out = []
    for i in range(16):
        height = (12, 6, 4, 2)[i % 4]
        out.append((i % 6, (5 * i) % (13 - height), height, (16, 8, 12, 4)[(i // 4 + i) % 4]))
    return out


def pitch_classes(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Matrix from spectrum bins to the twelve classes; A is class 0."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    used = (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)
    out = np.zeros((len(hz), 12), np.float32)
    out[np.flatnonzero(used), np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1.0
    return out


def chroma(samples: np.ndarray, starts: np.ndarray, rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Energy by pitch class of the frames that begin at ``starts``."""
    window, to_class = np.hanning(frame).astype(np.float32), pitch_classes(rate, frame)
    out = np.empty((len(starts), 12), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(samples, frame) if len(samples) >= frame else None
    for at in range(0, len(starts), 8192):
        spectrum = np.fft.rfft(views[starts[at : at + 8192]] * window, axis=1)
        out[at : at + 8192] = (spectrum.real**2 + spectrum.imag**2) @ to_class
    return out


def packed_prints(energy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers of all recordings one after the other, and how many each has; ``counts`` are its frames."""
    ends = np.cumsum(counts)
    number = np.maximum(counts - (WINDOW + len(SMOOTHING) - 1) + 1, 0)
    smooth_n = np.maximum(counts - len(SMOOTHING) + 1, 0)
    # frames that the smoothing can reach without leaving their recording
    whole = sum(w * energy[i : len(energy) - len(SMOOTHING) + 1 + i] for i, w in enumerate(SMOOTHING)) if len(energy) >= len(SMOOTHING) else energy[:0]
    inside = np.repeat((ends - counts) - (np.cumsum(smooth_n) - smooth_n), smooth_n) + np.arange(smooth_n.sum())
    frames = np.sqrt(np.maximum(whole[inside], 0.0))
    frames /= np.maximum(np.sqrt((frames**2).sum(1, keepdims=True)), 1e-6)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.astype(float).cumsum(0).cumsum(1)
    at = np.repeat((np.cumsum(smooth_n) - smooth_n) - (np.cumsum(number) - number), number) + np.arange(number.sum())

    def area(x0, x1, y0, y1):  # frames from x0 to x1, classes from y0 to y1, from each place on
        return image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]

    gray = np.array([0, 1, 3, 2], np.uint32)
    out = np.zeros(len(at), np.uint32)
    for kind, y, h, w in filters():
        all_, y2, x2 = area(0, w, y, y + h), y + h // 2, w // 2
        if kind == 0:  # against what lies outside the band
            first, second = all_ * 12 / h, area(0, w, 0, 12)
        elif kind == 1:  # classes below and above
            first, second = area(0, w, y, y2), area(0, w, y2, y + h)
        elif kind == 2:  # before and after
            first, second = area(0, x2, y, y + h), area(x2, w, y, y + h)
        elif kind == 3:  # one diagonal and the other
            first = area(0, x2, y, y2) + area(x2, w, y2, y + h)
            second = all_ - first
        elif kind == 4:  # middle classes and outer ones
            inner = h - 2 * (h // 3)
            first, second = area(0, w, y + h // 3, y + h // 3 + inner) * h / inner, all_
        else:  # middle frames and outer ones
            first = 2 * area(w // 4, w - w // 4, y, y + h)
            second = all_
        value = np.log((1 + first) / (1 + second))
        out = (out << np.uint32(2)) | gray[np.searchsorted((-LEVEL, 0.0, LEVEL), value)]
    return out, number


def _print_rows(batches: Iterator[pa.RecordBatch], rate: int, frame: int, hop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, bounds in steps(batch.column(0), batch.column(1)):
            size = np.diff(bounds)
            counts = np.where(size >= frame, (size - frame) // hop + 1, 0)
            starts = np.repeat(bounds[:-1] - hop * (np.cumsum(counts) - counts), counts) + hop * np.arange(counts.sum())
            samples = (data.astype(np.float32) - 128.0) / 128.0
            prints, number = packed_prints(chroma(samples, starts, rate, frame), counts)
            at = 4 * np.concatenate([[0], np.cumsum(number)])
            raw = prints.astype("<u4").tobytes()
            one = Ranges(np.frombuffer(raw, np.uint8)).hash(at[:-1], at[1:])
            cells = pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())
            second = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(one.view(np.int64)), pa.array(second.view(np.int64)), cells], names=["doc_id", "n_samples", "h1", "h2", "prints"])


def fingerprints(recordings: DataFrame, audio_col: str = "audio", id_col: str = "doc_id", rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """doc_id, n_samples, h1 and h2 (128 bits of the fingerprint) and prints (little-endian unsigned 32-bit).

    ``audio_col`` is binary, or text taken as its UTF-8 bytes: unsigned 8-bit mono
    PCM.  Null counts as empty; a recording under ``frame`` + 19 ``hop`` samples
    has no integers.  Other columns are ignored.
    """
    small_batches(recordings.sparkSession)
    rows = recordings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(audio_col).cast("binary").alias("audio"))
    return rows.mapInArrow(lambda it: _print_rows(it, rate, frame, hop), _PRINTS)


def run_hashes(x: np.ndarray, run: int) -> np.ndarray:
    """Hash of the run at every place of a fingerprint that has a whole one."""
    x = x.astype(np.uint64)
    n = max(len(x) - run + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(run):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n])
    return h.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """The run at every place of a class."""
    for batch in batches:
        keys, who, where = [], [], []
        for rep, raw in zip(batch["rep"].to_pylist(), batch["prints"].to_pylist()):
            h = run_hashes(np.frombuffer(raw, "<u4"), run)
            if not len(h):
                continue
            keys.append(h)
            where.append(np.arange(len(h)))
            who.append(np.full(len(h), rep, np.int64))
        if keys:
            columns = [pa.array(np.concatenate(c)) for c in (keys, who, where)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "pos"])


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int, start: int, stop: int) -> float:
    """Part of differing bits between a[start:stop] and what is ``offset`` before it in b, as far as both are there."""
    start, stop = max(start, offset, 0), min(stop, len(a), len(b) + offset)
    n = stop - start
    return float(np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).sum()) / (32 * n) if n > 0 else 1.0


_PEAK = ("rep", "anchor", "offset", "votes", "start", "stop")


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, "<u4") for x in batch[c].to_pylist()] for c in ("x", "y"))
        error = [bit_errors(p, q, *w) for p, q, *w in zip(a, b, *(batch[c].to_pylist() for c in ("offset", "start", "stop")))]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in _PEAK), pa.array(error, pa.float64())], names=[*_PEAK, "error"])


def _classes(prints: DataFrame) -> DataFrame:
    """h1, h2, rep and prints of each class of equal fingerprints."""
    some = prints.where(F.octet_length("prints") > 0)
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("prints").alias("prints"))
    return stage(classes, "chroma-classes")


def _voted(classes: DataFrame, run: int) -> DataFrame:
    """rep, pos, anchor and there: each place of a run that a class of smaller id has, with the first holder's first place."""
    runs = stage(classes.select("rep", "prints").mapInArrow(lambda it: _runs(it, run), "key long, rep long, pos long"), "chroma-runs")
    first = runs.groupBy("key").agg(F.min(F.struct("rep", "pos")).alias("at"), F.min("rep").alias("least"), F.max("rep").alias("most"))
    first = first.where("least < most").select("key", F.col("at.rep").alias("anchor"), F.col("at.pos").alias("there"))
    return runs.join(first, "key").where("rep > anchor")


def _peaks(classes: DataFrame, run: int, max_error: float) -> DataFrame:
    """Each class with each first holder of one of its runs: the peak of their offset histogram, and its bit errors."""
    voted = _voted(classes, run)
    span = (F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + run).alias("stop"))
    histogram = voted.groupBy("rep", "anchor", (F.col("pos") - F.col("there")).alias("offset")).agg(*span)
    best = F.max(F.struct("votes", (-F.col("offset")).alias("o"), "start", "stop")).alias("best")
    peaks = histogram.groupBy("rep", "anchor").agg(best)
    peaks = peaks.select("rep", "anchor", (-F.col("best.o")).alias("offset"), "best.votes", "best.start", "best.stop")
    own = classes.select("rep", F.col("prints").alias("x"))
    other = classes.select(F.col("rep").alias("anchor"), F.col("prints").alias("y"))
    both = peaks.join(own, "rep").join(other, "anchor").select(*_PEAK, "x", "y")
    measured = both.mapInArrow(_errors, "rep long, anchor long, offset long, votes long, start long, stop long, error double")
    return stage(measured.withColumn("aligned", F.col("error") <= max_error), "chroma-peaks")


def links(prints: DataFrame, run: int = RUN, max_error: float = MAX_ERROR) -> DataFrame:
    """Links that connect all classes that share a run: class_id, other_id (smaller), offset, votes, start, stop, bit_error_rate.

    Any two classes that have a run of ``run`` equal integers are both linked with
    the class of the smallest id that has it, or one of them is that.  ``offset``
    is the one for which most places vote (then the smaller), ``start`` and
    ``stop`` the span of those places in class_id, and ``bit_error_rate`` the part
    of differing bits in it: up to ``max_error`` recordings count as aligned there.
    """
    peaks = _peaks(_classes(stage(prints, "chroma-prints")), run, max_error)
    return peaks.select(F.col("rep").alias("class_id"), F.col("anchor").alias("other_id"), "offset", "votes", "start", "stop", F.col("error").alias("bit_error_rate"))


def align(prints: DataFrame, run: int = RUN, max_error: float = MAX_ERROR) -> DataFrame:
    """One row per recording: doc_id, n_samples, n_prints, class_id, aligned_to, offset, votes, bit_error_rate, n_links, component_id.

    ``class_id`` is the smallest doc_id with the same integers; recordings
    without any are classes of their own.  ``aligned_to`` is a class of smaller
    id, or null: of the links (see ``links``) with at most ``max_error`` differing
    bits the one with most votes, then fewer errors, then the smaller id.
    ``n_links`` counts the links of the class, to smaller and from larger ones.
    ``component_id`` is the smallest class_id reachable through classes that share
    a run of ``run`` integers, whichever holder was first.  Rows that repeat an id
    are recordings of their own; a null id is kept and never represents a class
    that has another.
    """
    prints = stage(prints, "chroma-prints")
    classes = _classes(prints)
    peaks = _peaks(classes, run, max_error)
    best = F.min(F.struct((-F.col("votes")).alias("v"), "error", "anchor", "offset")).alias("best")
    chosen = peaks.where("aligned").groupBy("rep").agg(best)
    chosen = chosen.select("rep", "best.anchor", "best.offset", (-F.col("best.v")).alias("votes"), "best.error")
    degree = peaks.select(F.explode(F.array("rep", "anchor")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    edges = peaks.select(F.col("rep").alias("a"), F.col("anchor").alias("b"))
    roots = components(edges, "chroma-components").select(F.col("v").alias("rep"), "root")
    return _rows(prints, classes.select("h1", "h2", "rep").join(chosen, "rep", "left").join(degree, "rep", "left").join(roots, "rep", "left"))


def _rows(prints: DataFrame, of_class: DataFrame) -> DataFrame:
    """One row per recording, with what is known of its class."""
    out = prints.select("doc_id", "n_samples", "h1", "h2", (F.octet_length("prints") / 4).cast("long").alias("n_prints")).join(of_class, ["h1", "h2"], "left")
    mine = F.when(F.col("n_prints") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_samples", "n_prints", mine.alias("class_id"), F.col("anchor").alias("aligned_to"), "offset", "votes", F.col("error").alias("bit_error_rate"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("root"), mine).alias("component_id"))


def pair_peaks(prints: list[np.ndarray], apart: np.ndarray | None = None, run: int = RUN, step: int = STEP_VOTES) -> Iterator[tuple[np.ndarray, ...]]:
    """i, j (smaller), offset, votes, start, stop and error of every pair of fingerprints that share a run, some at a time; no pair comes twice.

    With ``apart`` only pairs that differ in it.  Each place of a run in i votes
    for the offset to its first place in j.
    """
    n = len(prints)
    hashes = [run_hashes(x, run) for x in prints]
    sizes = np.array([len(h) for h in hashes], np.int64)
    if not sizes.sum():
        return
    who = np.repeat(np.arange(n), sizes)
    pos = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int64)
    held, first = np.unique(key * n + who, return_index=True)  # the first place of each key in each that has it
    there, holder = pos[first], held % n
    base, room = np.concatenate([[0], np.cumsum([len(x) for x in prints])]), int(sizes.max()) + 1
    flat = np.concatenate(prints)

    def peaks(places: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Of pairs with i among those of ``places`` and j from ``low`` on, below ``high``."""
        a = np.searchsorted(held, key[places] * n + low)
        count = np.maximum(np.searchsorted(held, key[places] * n + np.minimum(who[places], high)) - a, 0)
        at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        own = np.repeat(places, count)
        if apart is not None:
            kept = apart[who[own]] != apart[holder[at]]
            at, own = at[kept], own[kept]
        if not len(at):
            return
        code = (who[own] * n + holder[at]) * (2 * room) + (pos[own] - there[at] + room)
        order = np.argsort(code, kind="stable")  # places stay in order
        code, place = code[order], pos[own[order]]
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        votes = np.diff(np.append(heads, len(code)))
        start, stop, pair = place[heads], place[np.append(heads[1:], len(code)) - 1] + run, code[heads] // (2 * room)
        of = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        most = np.repeat(np.maximum.reduceat(votes, of), np.diff(np.append(of, len(pair))))
        best = np.flatnonzero(votes == most)
        best = best[np.append(True, pair[best][1:] != pair[best][:-1])]  # then the smaller offset
        i, j, offset = pair[best] // n, pair[best] % n, code[heads[best]] % (2 * room) - room
        start, stop, votes = start[best], stop[best], votes[best]
        ends = np.cumsum(stop - start)
        cut = 0
        while cut < len(i):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + step, "right")))
            s = slice(cut, to)
            length = stop[s] - start[s]
            begins = np.cumsum(length) - length
            x = np.repeat(base[i[s]] + start[s] - begins, length) + np.arange(length.sum())
            y = x + np.repeat(base[j[s]] - offset[s] - base[i[s]], length)
            wrong = np.add.reduceat(np.bitwise_count(flat[x] ^ flat[y]).astype(np.int64), begins)
            yield i[s], j[s], offset[s], votes[s], start[s], stop[s], wrong / (32 * length)
            cut = to

    # votes of all places of each i, counted before they are made
    smaller = np.searchsorted(held, key * n + who) - np.searchsorted(held, key * n)
    total = np.concatenate([[0], np.cumsum(np.bincount(who, smaller, n).astype(np.int64))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        to = max(i + 1, int(np.searchsorted(total, total[i] + step, "right")) - 1)
        width = n if total[to] - total[i] <= step else max(step // int(sizes[i]), 1)  # one with very many votes meets the others in turn
        for low in range(0, to, width):
            yield from peaks(np.arange(bounds[i], bounds[to]), low, low + width)
        i = to


_BEST = {"neg_votes": pa.int64(), "error": pa.float64(), "anchor": pa.int64(), "offset": pa.int64()}
_FOUND = "rep long, n_links long, best struct<neg_votes:bigint,error:double,anchor:bigint,offset:bigint>"


def _block(rows: pa.Table, run: int, max_error: float) -> pa.Table:
    """rep, n_links and best of each class of two blocks, from the pairs across them; or of one, from all of its pairs."""
    rows = rows.sort_by("rep")
    reps, side = rows["rep"].to_numpy(), rows["side"].to_numpy()
    n = len(reps)
    n_links, best = np.zeros(n, np.int64), [None] * n
    prints = [np.frombuffer(x, "<u4") for x in rows["prints"].to_pylist()]
    for i, j, offset, votes, _, _, error in pair_peaks(prints, side if rows["p"][0] != rows["q"][0] else None, run):
        n_links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        order = np.lexsort((j, error, -votes, i))
        order = order[error[order] <= max_error]
        order = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
        for k in order.tolist():
            found = (-int(votes[k]), float(error[k]), int(reps[j[k]]), int(offset[k]))
            best[i[k]] = min(best[i[k]] or found, found)
    return pa.table({"rep": reps, "n_links": n_links, "best": pa.array([b and dict(zip(_BEST, b)) for b in best], pa.struct(list(_BEST.items())))})


def align_all(prints: DataFrame, run: int = RUN, max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``align``, from every pair of classes that share a run, whoever was its first holder.

    ``n_links`` is the number of other classes that share a run with the class,
    and ``aligned_to`` the best of all those of smaller id: each place of a run
    votes for the offset to its first place there.  Pairs are in one component;
    the smaller components are put together to blocks, larger ones are cut into
    blocks of about ``block_bytes`` of fingerprints, and all pairs of these are
    tasks.  A pair is never a row.
    """
    prints = stage(prints, "chroma-prints")
    classes = _classes(prints)
    edges = stage(_voted(classes, run).select(F.col("rep").alias("a"), F.col("anchor").alias("b")).distinct(), "chroma-shared")
    roots = stage(components(edges, "chroma-components").select(F.col("v").alias("rep"), "root"), "chroma-roots")
    roots = roots.unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    members = stage(classes.select("rep", "prints").join(roots, "rep"), "chroma-members")
    n_bytes = members.groupBy("root").agg(F.sum(F.octet_length("prints")).alias("n_bytes"))
    n = n_buckets(prints.sparkSession, members.agg(F.coalesce(F.sum(F.octet_length("prints")), F.lit(0))).first()[0], block_bytes)
    parts = F.ceil(F.col("n_bytes") / block_bytes).cast("int")
    placed = members.join(n_bytes, "root").withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    whole = F.col("parts") == 1
    placed = placed.withColumn("of", F.when(whole, F.pmod(F.xxhash64("root"), F.lit(n))).otherwise(F.col("root"))).withColumn("whole", whole)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = placed.select("whole", "of", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "rep", "prints")
    found = tasks.groupBy("whole", "of", "p", "q").applyInArrow(lambda rows: _block(rows, run, max_error), _FOUND)
    of_rep = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.min("best").alias("best"))
    known = of_rep.select("rep", "n_links", "best.anchor", "best.offset", (-F.col("best.neg_votes")).alias("votes"), "best.error")
    return _rows(prints, classes.select("h1", "h2", "rep").join(known, "rep", "left").join(roots, "rep", "left"))


def op4_chroma(spark, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the bytes of each whole text of ``documents`` are taken as samples, so copies and shared passages are repeated sound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_all(fingerprints(docs, "text"))
