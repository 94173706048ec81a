"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and, for words of the
lexicon, the word itself; learned transitions tie neighbours together, so words
of code-switched text get labels in runs.  Forward-backward gives each word a
distribution over languages; a text's language is the one with the largest mean.

The model is fitted on the driver from a bounded sample of labelled rows, by
Adam on the exact gradient of the conditional likelihood.  A training sequence
is made of short spans from different rows, so that switches occur in it.
Features are hashed into ``2**bits`` rows of weights; nothing of the model grows
with the corpus.  Labelling is one narrow pass over whole texts: features are
looked up once per distinct word of a batch, and the recursions run over all
texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import small_batches, stage

UNDETERMINED = "und"
#: What is learned from: so many different texts of each language at most, each of them whole.
ROWS_PER_LANGUAGE = 200
SPAN, SPANS = 16, 4
BITS, EPOCHS, RATE, L2, SEED = 17, 4, 0.05, 1e-6, 5
LEXICON_WORDS = 2000
#: Code points of a unit; longer runs of letters, as in scripts without spaces, are several units.
UNIT = 24
#: Weights at most: with many languages features share more rows, so the model stays as small.
MAX_WEIGHTS = 1 << 22
#: Words of one step of labelling; texts are never cut.
STEP_WORDS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # feature row x language
    transitions: np.ndarray  # from x to
    start: np.ndarray
    lexicon: np.ndarray  # sorted hashes of words that are features themselves
    bits: int


def letters_only(text: Column) -> Column:
    """Runs of letters and combining marks, in lower case, one space between."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " ")))


def _units(words: pa.Array) -> pa.ListArray:
    """Each word in consecutive units of at most UNIT code points."""
    spaced = pc.replace_substring_regex(words, pattern=f"(?s)(.{{{UNIT}}})", replacement=r"\1 ")
    return pc.split_pattern(pc.utf8_rtrim(spaced, " "), " ")


def _code_points(words: pa.Array, width: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, of ``width`` at most, framed by ^ and $; and lengths."""
    text = np.array(words.to_pylist(), dtype=f"U{width}")
    points = text.view(np.uint32).reshape(len(text), -1) if len(text) else np.zeros((0, width), np.uint32)
    lengths = (points != 0).sum(1)
    framed = np.zeros((len(text), width + 2), np.uint32)
    framed[:, 0] = 94
    framed[:, 1:-1] = points
    framed[np.arange(len(text)), lengths + 1] = 36
    return framed, lengths + 2


def word_hashes(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), np.uint64)
    for column in points.T:
        h = (h ^ column.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def features(words: pa.Array, lexicon: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of each word (0 where there is none), and how many each has.

    n-grams of 2 to 4 characters anywhere, affixes of 1 to 4 at either end, and
    the whole word if the lexicon has it.
    """
    points, lengths = _code_points(words)
    wide, found = points.astype(np.uint64), []

    def add(h: np.ndarray, kind: int, there: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * _MIX
        found.append(np.where(there, (h >> np.uint64(64 - bits)).astype(np.int32), np.int32(-1)))

    place = np.arange(points.shape[1])
    for n in (2, 3, 4):
        h = np.zeros((len(points), points.shape[1] - n + 1), np.uint64)
        for i in range(n):
            h = (h * np.uint64(1_000_003) + wide[:, i : i + h.shape[1]]) * _MIX
        inside = place[: h.shape[1]] + n <= lengths[:, None]
        used = int(inside.sum(1).max(initial=0))
        add(h[:, :used], n, inside[:, :used])
    for n in (1, 2, 3, 4):
        h, t = np.zeros(len(points), np.uint64), np.zeros(len(points), np.uint64)
        for i in range(n):
            h = (h * np.uint64(1_000_003) + wide[:, 1 + i]) * _MIX
            t = (t * np.uint64(1_000_003) + wide[np.arange(len(points)), np.maximum(lengths - 2 - i, 0)]) * _MIX
        add(h[:, None], 10 + n, (lengths >= n + 2)[:, None])
        add(t[:, None], 20 + n, (lengths >= n + 2)[:, None])
    whole = word_hashes(points)
    at = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    add(whole[:, None], 30, (lexicon[at] == whole)[:, None] if len(lexicon) else np.zeros((len(whole), 1), bool))
    rows = np.concatenate(found, 1)
    return rows, np.maximum((rows >= 0).sum(1), 1)


def emissions(words: pa.Array, model: Model) -> np.ndarray:
    """Mean feature weight of each language, scaled by the root of the number of features."""
    out = np.zeros((len(words), len(model.languages)))
    padded = np.vstack([model.weights, np.zeros((1, len(model.languages)))]).astype(np.float32)  # -1 finds the zeros
    at = 0
    for some in _slices(words):
        rows, n = features(some, model.lexicon, model.bits)
        out[at : at + len(rows)] = padded[rows].sum(1) / np.sqrt(n)[:, None]
        at += len(rows)
    return out


def _slices(words: pa.Array, size: int = 1 << 12) -> Iterator[pa.Array]:
    return (words.slice(at, size) for at in range(0, len(words), size))


def _padded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of several slices under each other, with -1 behind the shorter."""
    out = np.full((sum(len(rows) for rows, _ in parts), max(rows.shape[1] for rows, _ in parts)), -1, np.int32)
    at = 0
    for rows, _ in parts:
        out[at : at + len(rows), : rows.shape[1]] = rows
        at += len(rows)
    return out, np.concatenate([n for _, n in parts])


def forward_backward(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; ``bounds`` cuts ``scores`` into sequences of one word or more.

    The recursions step through all sequences together, the longer first, so a
    step costs as much as there are sequences of its length.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = bounds[:-1][order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right") if len(lengths) else []
    likely = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(likely), np.ones_like(likely)
    for t, n in enumerate(alive):
        at = first[:n] + t
        a = likely[at] * (alpha[at - 1] @ move if t else np.exp(start - start.max()))
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = (likely[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both / both.sum(1, keepdims=True)


def _pair_expectation(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of neighbouring labels, for sequences of one length (sequence x place x label)."""
    s, t, k = scores.shape
    likely, move = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions)
    alpha, beta = np.empty_like(likely), np.ones_like(likely)
    for i in range(t):
        a = likely[:, i] * (alpha[:, i - 1] @ move if i else np.exp(start))
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (likely[:, i + 1] * beta[:, i + 1]) @ move.T
        beta[:, i] = b / b.sum(1, keepdims=True)
    one = alpha * beta
    one /= one.sum(2, keepdims=True)
    two = alpha[:, :-1, :, None] * move * (likely * beta)[:, 1:, None, :]
    return one, two / two.sum((2, 3), keepdims=True)


def fit(rows: list[tuple[str, list[str]]], bits: int = BITS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit on (language, words) rows.  Without rows the model has no language and labels nothing."""
    languages = tuple(sorted({lang for lang, words in rows if words}))
    k, rng = len(languages), np.random.default_rng(seed)
    rows = [(lang, _units(pa.array(ws, pa.string())).flatten().to_pylist()) for lang, ws in rows]
    while bits > 8 and k << bits > MAX_WEIGHTS:
        bits -= 1
    words = pa.array([w for _, ws in rows for w in ws], pa.string())
    labels = np.repeat([languages.index(lang) if ws else 0 for lang, ws in rows], [len(ws) for _, ws in rows]).astype(np.int64)
    weights, transitions, start = np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k)
    if not k:
        return Model(languages, weights, transitions, start, np.zeros(0, np.uint64), bits)
    bounds = _row_bounds(rows)
    del rows
    coded = pc.dictionary_encode(words)
    index = coded.indices.to_numpy()
    hashes = np.concatenate([word_hashes(_code_points(some)[0]) for some in _slices(coded.dictionary)])
    values, same = np.unique(hashes, return_inverse=True)
    counts = np.bincount(same, np.bincount(index, minlength=len(hashes)))
    lexicon = np.sort(values[np.lexsort((values, -counts))[:LEXICON_WORDS]])
    feats, n = _padded([features(some, lexicon, bits) for some in _slices(coded.dictionary)])
    spans = [(max(min(a, b - SPAN), a0), b if a + SPAN > b else a + SPAN) for a0, b in bounds for a in range(a0, b, SPAN)]  # the last of a row ends with it
    full = np.array([np.resize(np.arange(a, b), SPAN) for a, b in spans])
    moments = [np.zeros_like(x) for x in (weights, weights, transitions, transitions, start, start)]
    step, size = 0, 32
    for _ in range(epochs):
        shuffled = full[rng.permutation(len(full))]
        shuffled = np.resize(shuffled, (-(-len(shuffled) // SPANS) * SPANS, SPAN))  # the first again, where the last sequence is short
        sequences = shuffled.reshape(-1, SPANS * SPAN)
        for at in range(0, len(sequences), size):
            batch = sequences[at : at + size]
            own, gold = index[batch], labels[batch]
            used, back = np.unique(own, return_inverse=True)
            rows_of, scale = feats[used], 1 / np.sqrt(n[used])[:, None]
            padded = np.where(rows_of[:, :, None] >= 0, weights[rows_of], 0.0).sum(1) * scale
            one, two = _pair_expectation(padded[back].reshape(*own.shape, k), transitions, start)
            truth = np.eye(k)[gold]
            residual = (one - truth) / len(batch)
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, back.ravel(), residual.reshape(-1, k))
            grad = np.zeros_like(weights)
            there = rows_of >= 0
            np.add.at(grad, rows_of[there], np.repeat(by_word * scale, there.sum(1), axis=0))
            pairs = np.zeros((k, k))
            np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
            step += 1
            grads = (grad + L2 * weights, (two.sum((0, 1)) - pairs) / len(batch), residual[:, 0].sum(0))
            for j, (param, g) in enumerate(zip((weights, transitions, start), grads)):
                m, v = moments[2 * j], moments[2 * j + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, weights, transitions, start, lexicon, bits)


def _row_bounds(rows: list[tuple[str, list[str]]]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(ws) for _, ws in rows]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def training_rows(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """A bounded sample of rows with a language: of each the ``rows_per_language`` different texts whose hashes are lowest, whole.

    However often a text is repeated, it is one; a language with fewer texts gives
    all of them.  Rows without text or language take no part.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashes = usable.select("lang", F.xxhash64("text").alias("h")).distinct()
    # a threshold for each language that keeps about twice what is needed, then the lowest of what is kept
    counts = hashes.groupBy("lang").count()
    most = F.lit(4.0 * rows_per_language + 100) / F.col("count") * float(1 << 20)
    near = hashes.join(counts, "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < most)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("h"), F.lit(1 << 20)), "h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= rows_per_language).select("lang", "h")
    chosen = stage(chosen, "language-sample")  # its size is known then, and Spark broadcasts it if that is small
    some = usable.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    words = F.split(F.regexp_replace(letters_only(F.col("text")), rf"([^ ]{{{UNIT}}})(?=[^ ])", "$1 "), " ")
    rows = some.select("lang", "h", words.alias("words")).orderBy("lang", "h")
    return [(row["lang"], [w for w in row["words"] if w]) for row in rows.toLocalIterator()]


def label(docs: DataFrame, model: Model, word_labels: bool = False, carry: Sequence[str] = (), certainty: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, the columns of ``carry`` and, on demand, ``labels``: the language of each word of ``words``, and ``certainty``.

    ``score`` is the mean probability of the predicted language over the words,
    of which those over UNIT code points count once for each of their units; such
    a word's label is the language with the largest sum over them.  ``certainty``
    is the mean of the largest probability of each, whichever language has it.
    A text that is null or has no letter is ``und`` with score 0, as is every
    text if the model has no language.  Ties go to the first language by name.
    Texts of any length are labelled whole; repeated rows each; columns but
    doc_id and text are ignored.
    """
    languages, k = np.array([*model.languages, UNDETERMINED], dtype=object), len(model.languages)
    small_batches(docs.sparkSession)
    model_sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + (", words array<string>, labels array<string>" if word_labels else "") + (", certainty double" if certainty else "")
    names = [f.split()[0] for f in schema.split(", ")] + [f"carried_{i}" for i in range(len(carry))]
    schema += "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def some(keys: pa.Array, texts: pa.Array, carried: list[pa.Array], model: Model) -> pa.RecordBatch:
        words = pc.split_pattern(texts, " ")
        flat = words.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        counts = np.add.reduceat(np.append(real, False).astype(np.int64), np.minimum(words.offsets.to_numpy()[:-1] - words.offsets[0].as_py(), len(real))) if len(words) else np.zeros(0, np.int64)
        flat = flat.filter(pa.array(real))
        have = counts > 0
        units, of_word = flat, None
        if pc.any(pc.greater(pc.utf8_length(flat), UNIT)).as_py():
            split = _units(flat)
            units, of_word = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        mean = np.zeros((len(words), k))
        probable = np.zeros((0, k))
        sure = np.zeros(len(words))
        if k and have.any():
            coded = pc.dictionary_encode(units)
            scores = emissions(coded.dictionary, model)[coded.indices.to_numpy()]
            bounds = np.concatenate([[0], np.cumsum(counts[have])])
            if of_word is not None:
                bounds = of_word[bounds]
            probable = forward_backward(scores, bounds, model.transitions, model.start)
            mean[have] = np.add.reduceat(probable, bounds[:-1]) / np.diff(bounds)[:, None]
            sure[have] = np.add.reduceat(probable.max(1), bounds[:-1]) / np.diff(bounds)
            if of_word is not None and word_labels:
                probable = np.add.reduceat(probable, of_word[:-1])
        best = np.where(have & (k > 0), mean.argmax(1) if k else 0, k)
        score = np.where(have & (k > 0), mean.max(1, initial=0.0), 0.0)
        columns = [keys, pa.array(languages[best], pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
        if word_labels:
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            chosen = languages[probable.argmax(1)] if k else np.full(len(flat), UNDETERMINED, dtype=object)
            columns += [pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(chosen, pa.string()))]
        if certainty:
            columns.append(pa.array(np.clip(sure, 0.0, 1.0)))
        return pa.RecordBatch.from_arrays(columns + carried, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_sent.value
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column(1)), 1).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, before + 6 * STEP_WORDS, "right")))
                part = batch.slice(at, to - at)
                yield some(part.column(0), part.column(1), part.columns[2:], model)
                at = to

    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    labelled = docs.select("doc_id", letters_only(F.col("text")).alias("text"), *carried).mapInArrow(run, schema)
    return labelled.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(training_rows(docs.where(~held_out(F.col("doc_id"))).select("text", "lang")))
    predicted = label(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
