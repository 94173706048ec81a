import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as c
from lattica.llm import byte_bpe


def test_stages(spark, sf, documents):
    docs, seen = documents, [documents]
    for name, function in c.STAGES:
        docs = function(spark, docs, sf).cache()
        if name != c.STAGES[-1][0]:
            assert docs.columns == documents.columns
        seen.append(docs)
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    # what is left of near duplicates after the third stage: nothing
    from lattica.llm.ngram_join import link_components

    assert link_components(seen[3]).where("doc_id <> component_id").count() == 0
    # the mix repeats or leaves out words of the same text, and adds none
    assert seen[4].groupBy("doc_id").count().where("count > 1").count() == 0
    before = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    for r in seen[4].collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        old = re.findall(r"[^\x20\x09-\x0D]+", before[r["doc_id"]])
        assert words and set(words) <= set(old) and len(words) <= 3 * len(old)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(c.TOKENIZER))
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    for r in seen[5].limit(20).collect():
        assert byte_bpe.decode(bytes(r["ids"]), ranks).decode() == texts[r["doc_id"]]


def test_language_stage_keeps_clean_documents(spark, sf, documents):
    kept = c.identify_language(spark, documents, sf)
    assert kept.count() == documents.count()
    junk = spark.createDataFrame([(10**7, "12 34 !!", None, "s", 8), (10**7 + 1, None, "en", "s", 0)], documents.schema)
    assert c.identify_language(spark, documents.union(junk), sf).where(F.col("doc_id") >= 10**7).count() == 0


def test_language_stage_keeps_texts_of_several_languages(spark, sf, documents):
    langs = [r["lang"] for r in documents.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(3).collect()]
    texts = [documents.where(F.col("lang") == lang).orderBy(F.desc("n_chars"), "doc_id").first()["text"] for lang in langs]
    words = [w for n, text in zip((40, 30, 30), texts) for w in (re.findall(r"[^\W\d_]+", text) * 40)[:n]]
    mixed = spark.createDataFrame([(10**7, " ".join(words), langs[0], "s", 1)], documents.schema)
    model = c.language_crf.fit(c.language_crf.training_rows(documents.select("text", "lang")))
    row = c.language_crf.label(mixed, model, certainty=True).first()
    assert row["score"] < 0.5 < row["certainty"]
    assert c.identify_language(spark, documents.union(mixed), sf).where(F.col("doc_id") == 10**7).count() == 1


LONG = " ".join(f"the word number {w} of this long english text" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"))


def odd_corpus(spark, documents):
    """Repeated rows, two texts under one id, null ids, sources and texts, an empty text, clashing columns."""
    unique = " ".join(f"another{w} story{w} entirely{w}" for w in "abcdefghijklmnopqrst")
    extra = [(10**7, LONG, "en", "s", 1)] * 3 + [(10**7 + 5, LONG + " end", "en", "s", 1), (10**7 + 5, unique, "en", "t", 1)]
    extra += [(None, unique + " more words without an id", None, None, None), (None, None, "en", "s", 0), (10**7 + 7, "", "en", "s", 0)]
    rows = documents.limit(60).unionByName(spark.createDataFrame(extra, documents.schema))
    return rows.selectExpr("*", "1 AS row_id", "2 AS component_id", "3 AS pieces", "4 AS text_key").cache()


def test_rows_are_told_apart(spark, sf, documents):
    docs = odd_corpus(spark, documents)
    kept = c.drop_near_duplicates(spark, docs, sf)
    own = kept.where(f"doc_id >= {10**7} OR doc_id IS NULL").collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in own) == sorted([("10000000", "the wor"), ("10000005", "another"), ("10000007", ""), ("None", "")])
    mixed = c.mix_sources(spark, docs, sf).where(f"doc_id = {10**7}").collect()
    assert 1 <= len(mixed) <= 3  # three rows in, each once at most
    for name, function in c.STAGES:
        out = function(spark, docs, sf)
        assert out.count() <= docs.count() and (name == c.STAGES[-1][0] or out.columns == documents.columns)
        assert function(spark, docs.limit(0), sf).count() == 0


def test_without_any_label_all_stay(spark, sf, documents):
    bare = documents.withColumn("lang", F.lit(None).cast("string"))
    assert c.identify_language(spark, bare, sf).count() == documents.count()
