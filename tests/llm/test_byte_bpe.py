import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import byte_bpe as b

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = b.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODEC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(rows, text):
    for r in rows:
        want = CODEC.encode_ordinary(text or "") if isinstance(text, str) else CODEC.encode_ordinary(text[r["doc_id"]] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want) and r["n_tokens"] == len(want)


@pytest.mark.parametrize("limit", [b.BROADCAST_BYTES, 0])
def test_documents_as_the_library(spark, documents, limit):
    odd = ["it's  we'll   \n\n x\t y ", "a" * 3000 + " " + "ab" * 900, "ñ日本語 \U0001f600\u0085q  　 z", "12345 !!?? <|endoftext|>", "", None, " ", "é́"]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = b.encode(docs, RANKS, PATTERN, broadcast_bytes=limit).collect()
    assert len(rows) == len(text)
    check(rows, text)
    for r in rows:
        assert bytes(r["decoded"]) == (text[r["doc_id"]] or "").encode() == b.decode(bytes(r["ids"]), RANKS)


@pytest.mark.parametrize("limit", [b.BROADCAST_BYTES, 0])
def test_odd_rows(odd, nothing, limit):
    assert b.encode(odd, RANKS, PATTERN, broadcast_bytes=limit).count() == odd.count()
    assert b.encode(nothing, RANKS, PATTERN, broadcast_bytes=limit).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text("abct he", min_size=1, max_size=60), st.text(min_size=1, max_size=30)))
def test_heap_makes_the_same_merges(word):
    data = word.encode()
    parts = [data[i : i + 1] for i in range(len(data))]
    while data not in RANKS:
        ranked = [(RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS]
        if not ranked:
            break
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [RANKS[data]] if data in RANKS else [RANKS[x] for x in parts]
    assert b.merge_by_heap(data, RANKS) == want


def test_fold_and_heap_agree(spark, documents):
    from pyspark.sql import functions as F

    words = documents.limit(40).select(F.explode(b.pieces(F.col("text"), PATTERN)).alias("word")).distinct()
    folded = {r["word"]: r["ids"] for r in b.encode_words(words, RANKS).collect()}
    heap = {r["word"]: r["ids"] for r in b.encode_words(words, RANKS, longest_folded=0).collect()}
    assert folded == heap and len(folded) > 100
