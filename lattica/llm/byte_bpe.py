"""Byte-level BPE by Spark higher-order functions over distinct words.

A text is cut into pieces by the tokenizer's pattern, once; chunks of texts are
kept as places in their lists of distinct pieces.  Each distinct piece, once for
the whole corpus, becomes an array of its bytes, and ``aggregate`` folds
merges over it: the adjacent pair of the lowest rank, the leftmost of equals, is
joined until no pair has a rank.  Ranks are in a literal of the plan: an array of
small maps, one per hash of the key, since a lookup in one large map is linear.
Bytes are held as the characters U+0000 to U+00FF, which Spark can use as map
keys.  The ids of a text are its pieces' ids in order; decoding concatenates the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import let, release, small_batches, stage, unstage
from lattica.llm.packed import Ranges, steps

#: Largest dictionary of distinct pieces, in bytes, that is sent to every worker; beyond it texts and pieces meet by shuffle.
BROADCAST_BYTES = 128 << 20
#: The fold copies its array at each merge, so longer pieces (in bytes) take the same merges from a heap instead.
LONGEST_FOLDED = 512
#: Distinct pieces that one task folds.
WORDS_EACH = 200_000
#: Pieces of a chunk of texts, the unit in which ids are put together.
CHUNK_PIECES = 200_000
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_DICT = "word string, ids array<int>"
_DENSE = {"compression": "zstd"}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def jvm_pattern(pattern: str) -> str:
    r"""``pattern`` for Java, where ``\s`` and ``\S`` would be ASCII only."""
    inside = regex.sub(r"\[\^\\s", lambda m: "[^" + _SPACE, pattern)
    return inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def _cells(ranks: dict[bytes, int]) -> int:
    """A power of two, for two to four ranks in a cell: a task reads the literal object by object before it starts."""
    return 1 << max((len(ranks) // 2).bit_length() - 1, 0)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as array<map<string,int>>, which the optimizer folds into a literal of the plan."""
    cells: list[dict[str, int]] = [{} for _ in range(_cells(ranks))]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        cells[zlib.crc32(key.encode()) % len(cells)][key] = rank
    return F.from_json(F.lit(json.dumps(cells, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(chars: Column, table: Column, size: int) -> Column:
    """The tokens of one piece (``chars``: its bytes as characters) as array<string>.

    The state of the fold is the parts and the rank of each part with the next.
    """
    none = F.lit(2**31 - 1)

    def rank(pair: Column) -> Column:
        return let(pair, lambda key: F.coalesce(F.element_at(F.get(table, F.crc32(key).bitwiseAND(F.lit(size - 1)).cast("int")), key), none))

    def one(there: Column, pair: Column) -> Column:
        return F.when(there, F.array(rank(pair))).otherwise(F.array().cast("array<int>"))

    def merge_at(p: Column, r: Column, at: Column, both: Column) -> Column:  # at: from 1
        new_p = F.concat(F.slice(p, 1, at - 1), F.array(both), F.slice(p, at + 2, F.size(p)))
        left = one(at > 1, F.concat(F.get(p, at - 2), both))
        right = one(at < F.size(r), F.concat(both, F.get(p, at + 1)))
        return F.struct(new_p.alias("p"), F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"))

    def merge(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def lowest(low: Column) -> Column:
            def found(at: Column) -> Column:
                return let(F.concat(F.get(p, at - 1), F.get(p, at)), lambda both: merge_at(p, r, at, both))

            return F.when(F.coalesce(low, none) == none, state).otherwise(let(F.array_position(r, low).cast("int"), found))

        return let(F.array_min(r), lowest)

    def start(parts: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))
        return F.aggregate(F.sequence(F.lit(2), F.size(parts)), F.struct(parts.alias("p"), ranks.alias("r")), merge, lambda s: s["p"])

    return F.when((F.length(chars) < 2) | (rank(chars) < none), F.array(chars)).otherwise(let(F.split(chars, ""), start))


def merge_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long piece, in n log n: a heap of pairs by rank, then place."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapify(pairs)
    alive = bytearray(b"\1") * n
    while pairs:
        _, i, stop = heappop(pairs)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], 0
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if 0 <= a and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heappush(pairs, (r, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encode_words(words: DataFrame, ranks: dict[bytes, int], longest_folded: int = LONGEST_FOLDED) -> DataFrame:
    """Distinct ``word`` -> (word, ids), by the fold; longer pieces by the heap.

    Every single byte needs a rank, as in any byte-level vocabulary.
    """
    size = _cells(ranks)
    chars = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")

    def coded(table: Column) -> Column:
        def looked_up(token: Column) -> Column:
            return F.element_at(F.get(table, F.crc32(token).bitwiseAND(F.lit(size - 1)).cast("int")), token)

        return let(fold_merges(chars, table, size), lambda tokens: F.transform(tokens, looked_up))

    short = words.where(F.octet_length("word") <= longest_folded)
    folded = short.select("word", F.explode(F.transform(F.array(rank_literal(ranks)), coded)).alias("ids"))

    def by_heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merge_by_heap(w.encode(), ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["word", "ids"])

    long = words.where(F.octet_length("word") > longest_folded).select("word")
    return folded.unionByName(long.mapInArrow(by_heap, _DICT)) if long.limit(1).count() else folded


def pieces(text: Column, pattern: str) -> Column:
    """The pattern's matches in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(jvm_pattern(pattern)), F.lit(0))


def cut_texts(docs: DataFrame, pattern: str) -> DataFrame:
    """Texts in chunks of at most CHUNK_PIECES pieces (a longer text is a chunk of its own), as a table.

    ``chunk``; ``keys`` and ``counts``: doc_id and number of pieces of each text;
    ``words``: the distinct pieces; ``at``: the place in ``words`` of every piece,
    as unsigned 16-bit integers, or 32-bit ones where ``words`` needs them.  The
    pattern runs in the JVM, and in Python where a text has code points that the
    JVM's Unicode tables don't know.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    newer = F.coalesce(F.col("text").rlike(r"\p{Cn}"), F.lit(False))
    cut = docs.select("doc_id", F.when(~newer, pieces(F.col("text"), pattern)).alias("words"), F.when(newer, F.col("text")).alias("newer"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        own = regex.compile(jvm_pattern(pattern))
        for batch in batches:
            words = batch.column(1)
            if words.null_count:
                found = [None if t is None else own.findall(t) for t in batch.column(2).to_pylist()]
                words = pc.coalesce(pa.array(found, words.type), words)
            bounds = words.offsets.to_numpy().astype(np.int64)
            row = 0
            while row < len(words):
                stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_PIECES, "right")) - 1)
                coded = pc.dictionary_encode(words.values.slice(bounds[row], bounds[stop] - bounds[row]))
                at = coded.indices.to_numpy().astype("<u2" if len(coded.dictionary) <= 1 << 16 else "<u4")
                counts = pa.array(np.diff(bounds[row : stop + 1]).astype(np.int32))
                cells = [_one_list(batch.column(0).slice(row, stop - row)), _one_list(counts), _one_list(coded.dictionary), pa.array([at.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["keys", "counts", "words", "at"])
                row = stop

    chunks = cut.mapInArrow(pack, f"keys array<{kind}>, counts array<int>, words array<string>, at binary")
    # small row groups: a row is up to a megabyte
    return stage(chunks.withColumn("chunk", F.monotonically_increasing_id()), "bpe-cut", _DENSE | {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 8})


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass(frozen=True)
class Dictionary:
    """Pieces by sorted hash, the number of ids of each, and all ids in that order."""

    hashes: np.ndarray
    n: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, small: bool, most: int) -> Dictionary | None:
        """Packed on the executors, and sorted here, with ``most`` ids of a piece; None if two of the pieces share a hash.

        Partitions come one by one, so the JVM of the driver holds one at a time.
        """
        kind, size = np.dtype("<u2" if small else "<u4"), np.min_scalar_type(most)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(1).flatten().to_numpy().astype(kind)
                n = pc.list_value_length(batch.column(1)).to_numpy().astype(size)
                cells = _word_hashes(batch.column(0)).tobytes(), n.tobytes(), ids.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["h", "n", "ids"])

        joined = bytearray(), bytearray(), bytearray()
        for row in table.select("word", "ids").mapInArrow(pack, "h binary, n binary, ids binary").toLocalIterator():
            for whole, part in zip(joined, row):
                whole += part
        hashes, n, ids = (np.frombuffer(whole, t) for whole, t in zip(joined, (np.uint64, size, kind)))
        order = np.argsort(hashes)
        hashes = hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            return None
        first, n = (np.cumsum(n, dtype=np.int64) - n)[order], n[order]
        parts = []
        for at in range(0, len(n), 1 << 19):  # ids in the order of the hashes
            some = n[at : at + (1 << 19)].astype(np.int64)
            ends = np.cumsum(some)
            parts.append(ids[np.repeat(first[at : at + len(some)] - (ends - some), some) + np.arange(ends[-1])])
        return cls(hashes, n, np.concatenate(parts) if parts else ids)

    def starts(self) -> np.ndarray:
        """Where the ids of each piece begin."""
        ends = np.cumsum(self.n, dtype=np.uint32 if len(self.ids) < 1 << 32 else np.int64)
        return ends - self.n

    def find(self, words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each word."""
        hashes = _word_hashes(words)
        at = np.searchsorted(self.hashes, hashes)
        if len(hashes) and not (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes).all():
            raise ValueError("a piece is not in the dictionary of distinct pieces")
        return starts[at].astype(np.int64), self.n[at].astype(np.int64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    found = [Ranges(data).hash(bounds[:-1], bounds[1:]) for _, data, bounds in steps(words, words)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _binary(bounds: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data]).cast(pa.binary())


def _assemble(keys: pa.Array, counts: np.ndarray, at: bytes, flat: np.ndarray, first: np.ndarray, n: np.ndarray, vocabulary: pa.Array) -> pa.RecordBatch:
    """Put ids and decoded bytes of a chunk's texts together; the ids of word i are the n[i] from flat[first[i]] on."""
    bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    some = np.frombuffer(at, "<u2" if len(at) == 2 * bounds[-1] else "<u4")
    each = n[some]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(first[some] - ends[:-1], each) + np.arange(ends[-1])].astype("<u4")
    tokens = ends[bounds]
    texts = vocabulary.take(pa.array(ids))
    byte_at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])[tokens]
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(np.diff(tokens)), _binary(4 * tokens, pa.py_buffer(ids.tobytes())), _binary(byte_at, texts.buffers()[2] or pa.py_buffer(b""))],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    longest_folded: int = LONGEST_FOLDED,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes).

    Null and empty texts have no tokens.  Repeated rows are encoded each; other
    columns are ignored.  The pattern runs once over each text.  The dictionary
    of distinct pieces goes to every worker if it is within ``broadcast_bytes``;
    else each chunk of texts meets its pieces by shuffle.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    cut = cut_texts(docs, pattern)
    words = stage(cut.select(F.explode("words").alias("word")).distinct(), "bpe-words", _DENSE)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-words.count() // WORDS_EACH))
    release(spark, executors=True)  # the fold fills the heap beside the workers that have cut the texts
    dictionary = stage(encode_words(words.repartition(tasks, "word"), ranks, longest_folded), "bpe-dictionary", _DENSE)
    unstage(words)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    size, most = dictionary.agg(F.coalesce(F.sum(F.octet_length("word") + 4 * F.size("ids") + 12), F.lit(0)), F.coalesce(F.max(F.size("ids")), F.lit(0))).first()
    release(spark)
    known = Dictionary.of(dictionary, len(tokens) <= 1 << 16, most) if size <= broadcast_bytes else None
    if known:
        sent = spark.sparkContext.broadcast(known)
        del known  # it is in the broadcast's file
        release(spark, executors=True)  # of what the fold has left

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
            vocabulary, known = pa.array(tokens, pa.binary()), sent.value
            starts = known.starts()
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, counts, words = (batch.column(c)[i].values for c in range(3))
                    yield _assemble(keys, counts.to_numpy(), batch.column(3)[i].as_py(), known.ids, *known.find(words, starts), vocabulary)

        return cut.select("keys", "counts", "words", "at").mapInArrow(look_up, schema)

    needed = cut.select("chunk", F.posexplode("words").alias("place", "word")).join(dictionary, "word")

    def meet(texts: pa.Table, known: pa.Table) -> pa.Table:
        vocabulary, known = pa.array(tokens, pa.binary()), known.sort_by("place")["ids"].combine_chunks()
        n = pc.list_value_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = known.flatten().to_numpy()
        rows = [(texts[c].chunk(0)[0] for c in ("keys", "counts", "at"))] if texts.num_rows else []
        found = [_assemble(k.values, c.values.to_numpy(), at.as_py(), flat, np.cumsum(n) - n, n, vocabulary) for k, c, at in rows]
        return pa.Table.from_batches(found)

    needed = needed.select(F.col("chunk").alias("of_chunk"), "place", "ids")
    return cut.select("chunk", "keys", "counts", "at").groupBy("chunk").cogroup(needed.groupBy("of_chunk")).applyInArrow(meet, schema)


def decode(ids: bytes, ranks: dict[bytes, int]) -> bytes:
    """The bytes of a list of ids: its tokens, one after the other."""
    token = {rank: t for t, rank in ranks.items()}
    return b"".join(token[i] for i in np.frombuffer(ids, "<u4").tolist())


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
