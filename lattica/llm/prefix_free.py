"""Removal of repeated byte strings by prefix-free parsing.

Triggers cut every text into phrases: a byte is a trigger where the rolling hash
of the ``KEY`` bytes from it is the least of those that a window of ``window``
bytes over it holds.  A phrase runs from the first window that has the trigger
to the end of the last, so every window lies in exactly one phrase, and equal
windows have equal triggers at equal offsets.

The parse - which text has which phrases, as hashes - is dealt by trigger.  A
phrase that a text of a smaller doc_id also has goes whole.  What is left of
each phrase is its first text; its windows can only repeat in another phrase of
the same trigger, as happens where a repeat begins or ends.  So just the phrases
of triggers with several are sent as text.  They are the dictionary, and its
suffix array, sorted by the first ``window`` bytes, puts suffixes with that much
in common together; the parse turns the least text of each such interval into
bytes to remove.  Suffixes of different triggers need no order, so no task holds
more than its share of the dictionary.  A trigger with more than ``HOT_PHRASES``
phrases - a common string in very many contexts - would be one task's: its
windows are dealt one by one instead, by a hash of their own bytes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import n_buckets, release, small_batches, stage, unstage
from lattica.llm.packed import Ranges, mix, steps

WINDOW, KEY = 50, 20
BUCKET_BYTES = 24 << 20
#: Windows whose suffix array is sorted at once.
SORT_WINDOWS = 400_000
#: Phrases from which a trigger's windows are dealt one by one.
HOT_PHRASES = 4096
_PARSE = "bucket int, phrases binary, docs binary, runs binary"
_FOUND = "part int, docs binary, phrases binary, triggers binary, hot binary"
_ASKED = "doc_id long, phrases binary, triggers binary, hot binary"
_RUNS = "doc_id long, text_key long, starts binary, stops binary"
_PHRASES = "bucket int, triggers binary, phrases binary, sizes binary, text binary, which binary, docs binary, keys binary, places binary"
_LOW48 = np.uint64(2**48 - 1)


def phrases(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, key: int = KEY) -> tuple[np.ndarray, ...]:
    """(text, trigger hash, first window, last window, hash) of every phrase, in order; places count in ``data``."""
    ranges = Ranges(data)
    keys = ranges.hash_width(key)
    wide = window - key + 1  # keys in a window
    n = len(data) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    # the least key of each window, the leftmost of equals: minima over doubling spans of keys with their place in the low bits
    low = np.uint64((1 << int(len(keys)).bit_length()) - 1)
    least, span = (keys & ~low) | np.arange(len(keys), dtype=np.uint64), 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = (np.minimum(least[:n], least[wide - span : wide - span + n]) & low).astype(np.int64)
    # windows that cross a bound hold no string of one text
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    inside = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(len(text))
    # a phrase: windows of one text in a row with the same trigger
    place = least[inside]
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(text)) - 1 if len(start) else start
    first, last, trigger = inside[start], inside[stop], keys[place[start]]
    return text[start], trigger, first, last, mix(ranges.hash(first, last + window) ^ trigger)


def _deal(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, cuts, np.flatnonzero(np.diff(cuts))


def _bucket_of(triggers: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(triggers ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def _pack48(*columns: np.ndarray) -> bytes:
    """48 bits of each number; of triggers that share them each is looked at, which does no harm."""
    wide = np.column_stack([c.astype("<u8") for c in columns])
    return np.frombuffer(wide.tobytes(), np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(parts: list[bytes], columns: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").reshape(-1, columns).T


def _parse_rows(batches: Iterator[pa.RecordBatch], window: int, key: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each phrase of a step once, with its least text, by bucket of the trigger; the texts above that in rows with bucket -1."""
    for batch in batches:
        for ids, data, bounds in steps(batch.column(0), batch.column(1)):
            text, trigger, _, _, phrase = phrases(data, bounds, window, key)
            doc = ids.to_numpy()[text]
            order = np.lexsort((doc, phrase))
            t, p, d = trigger[order], phrase[order], doc[order]
            first = np.ones(len(p), bool)
            first[1:] = p[1:] != p[:-1]
            least = d[np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))] if len(p) else d
            above = d > least
            above[1:] &= (p[1:] != p[:-1]) | (d[1:] != d[:-1])
            rows = []
            if above.any():
                rows.append((-1, _pack48(t[above], p[above]), d[above].tobytes(), np.ones(above.sum(), np.int32).tobytes()))
            t, p, d = t[first], p[first], d[first]
            order = np.lexsort((d, _bucket_of(t, buckets)))
            t, p, d = t[order], p[order], d[order]
            cuts = np.searchsorted(_bucket_of(t, buckets), np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                own = d[cuts[i] : cuts[i + 1]]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                runs = np.diff(np.append(starts, len(own))).astype(np.int32)
                rows.append((int(i), _pack48(t[cuts[i] : cuts[i + 1]], p[cuts[i] : cuts[i + 1]]), own[starts].tobytes(), runs.tobytes()))
            yield _batch(rows, _PARSE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _resolve(table: pa.Table, parts: int, many: int) -> pa.Table:
    """Of a bucket, by text: phrases that go whole, triggers whose phrases differ, and those of them with over ``many``; packed by parts of the texts."""
    t, p = _unpack48(table["phrases"].to_pylist(), 2)
    d = np.repeat(np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64), np.frombuffer(b"".join(table["runs"].to_pylist()), np.int32))
    whole, differ, hot = np.ones(len(p), bool), np.zeros(len(p), bool), np.zeros(len(p), bool)
    if table["bucket"][0].as_py() >= 0:
        order = np.lexsort((d, p, t))
        t, p, d = t[order], p[order], d[order]
        trigger = np.append(True, t[1:] != t[:-1])
        phrase = trigger | np.append(True, p[1:] != p[:-1])
        starts = np.flatnonzero(phrase)
        sizes = np.diff(np.append(starts, len(p)))
        whole = d > np.repeat(d[starts], sizes)
        at = np.flatnonzero(trigger)
        count = np.repeat(np.add.reduceat(phrase.astype(np.int64), at), np.diff(np.append(at, len(p))))
        differ = ~whole & (count > 1)
        hot = differ & (count > many)
    rows = []
    for number, (keep, hashes) in enumerate(((whole, p), (differ, t), (hot, t))):
        docs, some = d[keep], hashes[keep]
        order, cuts, full = _deal(_bucket_of(docs.view(np.uint64), parts), parts)
        docs, some = docs[order], some[order]
        for i in full:
            cells = [b"", b"", b""]
            cells[number] = _pack48(some[cuts[i] : cuts[i + 1]])
            rows.append((int(i), docs[cuts[i] : cuts[i + 1]].tobytes(), *cells))
    return pa.Table.from_batches([_batch(rows, _FOUND)])


def _by_text(table: pa.Table) -> pa.Table:
    """One row per text: its phrases that go whole, its triggers whose phrases differ, and the hot ones of these."""
    kinds = {}
    for name in ("phrases", "triggers", "hot"):
        cells = [(d, h) for d, h in zip(table["docs"].to_pylist(), table[name].to_pylist()) if h]
        docs, hashes = np.frombuffer(b"".join(d for d, _ in cells), np.int64), _unpack48([h for _, h in cells], 1)[0]
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
        starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
        cuts = np.append(starts, len(docs))
        kinds[name] = {int(docs[a]): hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])}
    found = sorted(kinds["phrases"].keys() | kinds["triggers"].keys())
    return pa.Table.from_batches([_batch([(d, *(kinds[name].get(d, b"") for name in kinds)) for d in found], _ASKED)])


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _windows(data: np.ndarray, window: int, hot: np.ndarray, text, trigger, first, last, phrase) -> tuple[np.ndarray, ...]:
    """Phrases, with the windows of hot ones as phrases of their own under hashes of their own."""
    stay, count = ~hot, (last - first + 1)[hot]
    at = np.repeat(first[hot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    own = mix(Ranges(data).hash(at, at + window))
    old, new = (text, trigger, first, last, phrase), (np.repeat(text[hot], count), own, at, at, own)
    return tuple(np.concatenate([x[stay], y]) for x, y in zip(old, new))


def _phrase_rows(batches: Iterator[pa.RecordBatch], window: int, key: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per text the runs of its phrases that go whole; and by bucket the phrases of triggers that differ, with who has them where."""
    none = (None,) * 9
    for batch in batches:
        done = 0
        for ids, data, bounds in steps(batch.column(0), batch.column(1)):
            asked = batch.slice(done, len(ids))
            done += len(ids)
            text, trigger, first, last, phrase = phrases(data, bounds, window, key)
            ids, cuts = ids.to_numpy(), np.searchsorted(text, np.arange(len(ids) + 1))
            text_key = asked.column(4).to_numpy()
            whole, differ, hot = (np.zeros(len(text), bool) for _ in range(3))
            for i, (p, t, h) in enumerate(zip(*(asked.column(c).to_pylist() for c in (2, 3, 5)))):
                own = slice(cuts[i], cuts[i + 1])
                whole[own] = _member(phrase[own] & _LOW48, np.frombuffer(p, np.uint64))
                differ[own] = _member(trigger[own] & _LOW48, np.frombuffer(t, np.uint64)) & ~whole[own]
                if h:
                    hot[own] = _member(trigger[own] & _LOW48, np.frombuffer(h, np.uint64)) & differ[own]
            begin = bounds[text[whole]]
            which, start, stop = _merged(text[whole], first[whole] - begin, last[whole] + window - begin)
            edges = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which)) if len(which) else np.zeros(1, np.int64)
            rows = [(int(ids[which[a]]), int(text_key[which[a]]), start[a:b].tobytes(), stop[a:b].tobytes(), *none) for a, b in zip(edges, edges[1:])]
            text, trigger, first, last, phrase, hot = (x[differ] for x in (text, trigger, first, last, phrase, hot))
            if hot.any():
                text, trigger, first, last, phrase = _windows(data, window, hot, text, trigger, first, last, phrase)
            order, cuts, full = _deal(_bucket_of(trigger, buckets), buckets)
            for i in full:
                here = order[cuts[i] : cuts[i + 1]]
                _, one, same = np.unique(phrase[here], return_index=True, return_inverse=True)
                a, b = first[here[one]], last[here[one]] + window
                size = b - a
                at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows.append(
                    (None, None, None, None, int(i), trigger[here[one]].tobytes(), phrase[here[one]].tobytes(), size.astype(np.int32).tobytes(), data[at].tobytes(),
                     same.astype(np.int32).tobytes(), ids[text[here]].tobytes(), text_key[text[here]].tobytes(), (first[here] - bounds[text[here]]).tobytes())
                )
            yield _batch(rows, f"{_RUNS}, {_PHRASES}")


def suffix_minima(text: np.ndarray, sizes: np.ndarray, least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every phrase, the least document of all phrases that hold the same string; and where each phrase's begin.

    The suffixes of the phrases are sorted by their first ``window`` bytes; those
    with ``window`` bytes in common are neighbours.
    """
    count = sizes - window + 1
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.cumsum(sizes) - sizes
    place = np.repeat(begin - at[:-1], count) + np.arange(at[-1])
    strings = np.lib.stride_tricks.sliding_window_view(text, window)[place] if len(place) else np.zeros((0, window), np.uint8)
    # the bytes as big-endian words: the last key of lexsort is the first to count
    words = np.zeros((len(place), -(-window // 8) * 8), np.uint8)
    words[:, :window] = strings
    columns = words.view(">u8").astype(np.uint64).T
    array = np.lexsort(columns[::-1])
    ordered = columns[:, array]
    new = np.ones(len(array), bool)
    new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(0)
    starts = np.flatnonzero(new)
    owner = np.repeat(least, count)
    out = np.empty(len(array), np.int64)
    if len(array):
        out[array] = np.repeat(np.minimum.reduceat(owner[array], starts), np.diff(np.append(starts, len(array))))
    return out, at


def _removed(table: pa.Table, window: int) -> pa.Table:
    """Runs of bytes to remove, by document, from all phrases of a bucket; some triggers at a time."""
    joined = {c: [x.as_py() for x in table[c]] for c in table.column_names[1:]}
    triggers, content = (np.frombuffer(b"".join(joined[c]), np.uint64) for c in ("triggers", "phrases"))
    sizes, text = np.frombuffer(b"".join(joined["sizes"]), np.int32).astype(np.int64), np.frombuffer(b"".join(joined["text"]), np.uint8)
    shift = np.concatenate([[0], np.cumsum([len(x) // 8 for x in joined["phrases"]])])
    which = np.concatenate([np.frombuffer(x, np.int32) + s for x, s in zip(joined["which"], shift)])
    docs, keys, places = (np.frombuffer(b"".join(joined[c]), np.int64) for c in ("docs", "keys", "places"))
    del joined
    # rows are told apart by text as well: an id may repeat
    order = np.lexsort((keys, docs))
    fresh = np.append(True, (docs[order][1:] != docs[order][:-1]) | (keys[order][1:] != keys[order][:-1]))
    row = np.empty(len(docs), np.int64)
    row[order] = np.cumsum(fresh) - 1
    of_row = order[fresh]
    # the dictionary: each phrase once, with the least document that has it
    _, one, same = np.unique(content, return_index=True, return_inverse=True)
    entry = same[which]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, docs)
    begin, size = (np.cumsum(sizes) - sizes)[one], sizes[one]
    groups = int((size - window + 1).sum()) // SORT_WINDOWS + 1
    group = (mix(triggers[one]) >> np.uint64(8)) % np.uint64(groups)
    found = []
    for g in range(groups):
        mine = np.flatnonzero(group == g)
        at = np.repeat(begin[mine] - (np.cumsum(size[mine]) - size[mine]), size[mine]) + np.arange(size[mine].sum())
        by_window, first = suffix_minima(text[at], size[mine], least[mine], window)
        local = np.full(len(one), -1)
        local[mine] = np.arange(len(mine))
        held = np.flatnonzero(local[entry] >= 0)
        found += [_runs_of(local[entry[h]], docs[h], row[h], places[h], by_window, first, window) for h in np.array_split(held, len(held) // (1 << 15) + 1)]
    row, start, stop = _merged(*(np.concatenate(x) for x in zip(*found)))
    cuts = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
    runs = [(int(docs[of_row[row[a]]]), int(keys[of_row[row[a]]]), start[a:b].tobytes(), stop[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    return pa.Table.from_batches([_batch(runs, _RUNS)])


def _runs_of(entry, docs, rows, places, by_window, first, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parse: windows whose least document is below their own, as runs of bytes."""
    n = np.diff(first)[entry]
    ends = np.cumsum(n)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    hit = by_window[np.repeat(first[entry], n) + inner] < np.repeat(docs, n)
    occurrence = np.repeat(np.arange(len(entry)), n)[hit]
    start = (np.repeat(places, n) + inner)[hit]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (occurrence[1:] != occurrence[:-1])
    run = np.flatnonzero(fresh)
    stop = start[np.append(run[1:], len(start)) - 1] + window if len(run) else run
    return rows[occurrence[run]], start[run], stop


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one document that overlap or touch, as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    # the furthest stop so far within a document: documents are kept apart by an offset
    _, number = np.unique(doc, return_inverse=True)
    apart = number * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + apart)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + apart[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - apart)[np.append(first[1:], len(doc)) - 1]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        out = []
        for text, starts, stops in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = (text or "").encode()
            a, b = (np.frombuffer(b"".join(x or []), np.int64) for x in (starts, stops))
            _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
            edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
            out.append((len(data), a, b, b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1].tolist() for x in out], pa.list_(pa.int64())),
                pa.array([x[2].tolist() for x in out], pa.list_(pa.int64())),
                pa.array([x[3] for x in out], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "starts", "stops", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: int = KEY, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """One row per document: doc_id, n_bytes, starts and stops of removed runs, and kept (the bytes left).

    A byte goes if a string of ``window`` bytes over it also starts in a text of
    a smaller doc_id.  Strings are judged on the input, overlap, and never cross
    texts; a repeat within one text only stays.  Null counts as empty; texts
    shorter than ``window`` keep all.  Rows that share a doc_id don't count as
    repeats of each other, but each is judged; a null doc_id is the least of
    all.  Columns but doc_id (long) and text are ignored.  ``hot_phrases`` only
    decides how a trigger's windows are dealt, not what is found.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    lowest = -(2**63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = _runs(docs, window, key, hot_phrases)
    release(spark)
    cut = docs.withColumn("text_key", F.xxhash64("text")).join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts", "stops")
    out = cut.mapInArrow(_cut_rows, "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


def _found(docs: DataFrame, window: int, key: int, buckets: int, hot_phrases: int) -> DataFrame:
    """What each text is asked for (``_by_text``), as a table; so the parse need not stay while texts are dealt."""
    parse = docs.mapInArrow(lambda it: _parse_rows(it, window, key, buckets), _PARSE)
    # what a step resolved alone needs no meeting: it goes to groups of its own
    own = -1 - F.pmod(F.xxhash64("docs"), F.lit(buckets)).cast("int")
    dealt = parse.withColumn("group", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(own))
    found = dealt.groupBy("group").applyInArrow(lambda t: _resolve(t, buckets, hot_phrases), _FOUND)
    return stage(found.groupBy("part").applyInArrow(_by_text, _ASKED), "repeats-asked")


def _drop_shuffles(spark: SparkSession) -> None:
    """Again and again: something still holds the last query's plan when garbage is first collected, and the files go only a collection later."""
    for _ in range(3):
        release(spark)
        time.sleep(1)


def _runs(docs: DataFrame, window: int, key: int, hot_phrases: int) -> DataFrame:
    """(doc_id, text_key, starts, stops): lists of packed runs to remove, as a table."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = n_buckets(spark, total, BUCKET_BYTES)
    found = _found(docs, window, key, buckets, hot_phrases)
    _drop_shuffles(spark)  # of the parse
    asked = docs.join(found.hint("merge"), "doc_id").select("doc_id", "text", "phrases", "triggers", F.xxhash64("text").alias("text_key"), "hot")
    both = stage(asked.mapInArrow(lambda it: _phrase_rows(it, window, key, buckets), f"{_RUNS}, {_PHRASES}"), "repeats-phrases")
    del asked
    unstage(found)
    _drop_shuffles(spark)  # of the texts
    differ = both.where("bucket is not null").drop("doc_id", "text_key", "starts", "stops")
    edges = differ.groupBy("bucket").applyInArrow(lambda t: _removed(t, window), _RUNS)
    all_runs = both.where("bucket is null").select("doc_id", "text_key", "starts", "stops").union(edges)
    runs = stage(all_runs.groupBy("doc_id", "text_key").agg(F.collect_list("starts").alias("starts"), F.collect_list("stops").alias("stops")), "repeats-runs")
    unstage(both)
    return runs


def op7_prefix_free(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
