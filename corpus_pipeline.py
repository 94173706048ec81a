"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, language_crf, line_dedup, mixing, ngram_join
from lattica.llm.common import let, release, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean probability of each word's own language below which a text counts as of none.
MIN_LANGUAGE_CERTAINTY = 0.5
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: A word with the white space after it.
_SPACED_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents as a table with ``row_id``: ids may be null or repeat, and rows too."""
    return stage(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), f"pipeline-{name}")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in none of the labelled languages go: null, without a letter, or of words that are of no language in the mean.

    Texts of several languages stay.  If no row has a language and a text there is
    nothing to judge by, and all rows stay.  Rows that are equal are treated alike;
    columns other than those of ``documents`` are left out; an empty table stays empty.
    """
    release(spark, executors=True)
    model = language_crf.fit(language_crf.training_rows(docs.select("text", "lang")))
    if not model.languages:
        return docs.select(*COLUMNS)
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    labelled = language_crf.label(keyed.select("doc_id", "text", "text_key"), model, carry=["text_key"], certainty=True)
    rejected = (F.col("lang_pred") == language_crf.UNDETERMINED) | (F.col("certainty") < MIN_LANGUAGE_CERTAINTY)
    gone = stage(labelled.where(rejected).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "pipeline-rejected")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return keyed.join(gone, same, "left_anti").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier in the corpus go; a document that was nothing else goes with them.

    Null and empty texts stay as they are, and equal rows are one document here, so
    all of them stay alike.  Rows that share an id are in order of a hash of their
    text; a null id comes first.  Other columns are left out.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    empty = ~F.coalesce("kept", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(~((F.col("n_removed") > 0) & empty)).withColumn("text", F.col("kept"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by near-duplicate links the one with the smallest doc_id stays, null last.

    Rows that are equal are copies: one of them stays.  Rows that share an id are
    documents of their own.  Texts that are null or without words are linked with
    nothing, and all stay.  Other columns are left out.
    """
    release(spark, executors=True)
    rows = numbered(docs, "to-compare")
    found = ngram_join.link_components(rows.select(F.col("row_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_id"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("least")
    stays = found.join(rows.select("row_id", "doc_id"), "row_id").groupBy("component_id").agg(least)
    return rows.join(stays.select(F.col("least.row_id").alias("row_id")), "row_id", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row, those taken again after the rest; rows without any go.

    Equal rows and rows that share an id are documents of their own; a null source
    is a source; null and empty texts have no words and go.  Other columns are left out.
    """
    rows = numbered(docs, "to-mix")
    mixed = mixing.mix(rows.select(F.col("row_id").alias("doc_id"), "text", "source")).where("taken > 0").select(F.col("doc_id").alias("row_id"), "pieces")

    def text_of(words):
        def copy(number: int):
            some = F.filter("pieces", lambda p: p["copies"] >= number)
            return F.array_join(F.flatten(F.transform(some, lambda p: F.slice(words, p["first"].cast("int") + 1, p["n"].cast("int")))), "")

        copies = F.array(*[F.trim(copy(n)) for n in range(1, mixing.MAX_REPEATS + 1)])
        return F.array_join(F.filter(copies, lambda c: c != ""), "\n")

    words = F.regexp_extract_all("text", F.lit(_SPACED_WORD), F.lit(0))
    joined = rows.join(mixed, "row_id")
    return joined.withColumn("text", let(words, text_of)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the text that they decode to; a row for each row, whatever its id or text."""
    release(spark, executors=True)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    coded = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]
#: SQL can't express the model, the draws or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
