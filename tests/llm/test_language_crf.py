import numpy as np
from pyspark.sql import functions as F

from lattica.llm import language_crf as crf


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, move, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    bounds = np.array([0, 4, 5, 7])
    got = crf.forward_backward(scores, bounds, move, start)
    for a, b in zip(bounds, bounds[1:]):
        want = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            weight = np.exp(start[path[0]] + sum(scores[a + i, s] for i, s in enumerate(path)) + sum(move[p, q] for p, q in zip(path, path[1:])))
            for i, s in enumerate(path):
                want[i, s] += weight
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_gradient_statistics_match_forward_backward():
    rng = np.random.default_rng(2)
    scores, move, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    one, two = crf._pair_expectation(scores, move, start)
    flat = crf.forward_backward(scores.reshape(10, 3), np.array([0, 5, 10]), move, start).reshape(2, 5, 3)
    assert np.allclose(one, flat) and np.allclose(two.sum(3), one[:, :-1]) and np.allclose(two.sum(2), one[:, 1:])


def test_held_out_accuracy(spark, sf, documents):
    got = crf.op1_language_id(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_code_switching_and_odd_rows(spark, documents, odd, nothing):
    model = crf.fit(crf.training_rows(documents.select("text", "lang")))
    out = {r["doc_id"]: r for r in crf.label(odd.where("doc_id <> 5"), model, word_labels=True).collect()}
    for i in (0, 1, 2, 11):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert len(out[9]["words"]) == 2 == len(out[9]["labels"])
    assert crf.label(odd, model).count() == odd.count() and crf.label(nothing, model).count() == 0
    switched = documents.where("lang = 'en'").limit(1).first()["text"].split()[:40] + documents.where("lang = 'fr'").limit(1).first()["text"].split()[:40]
    row = crf.label(spark.createDataFrame([(1, " ".join(switched))], "doc_id long, text string"), model, word_labels=True).first()
    assert {"en", "fr"} <= set(row["labels"])


def test_nothing_to_learn_from(odd, nothing):
    assert crf.training_rows(nothing) == []
    model = crf.fit([])
    assert {r["lang_pred"] for r in crf.label(odd, model).collect()} == {"und"}


def test_training_bound(documents):
    rows = crf.training_rows(documents, rows_per_language=3)
    assert all(sum(lang == x for x, _ in rows) <= 3 for lang in ("en", "fr"))
    whole = {tuple(r["w"]) for r in documents.select(F.split(crf.letters_only(F.col("text")), " ").alias("w")).collect()}
    assert all(any(w == tuple("".join(ws).split()) or "".join(w) == "".join(ws) for w in whole) for _, ws in rows)


def test_every_language_is_learned(spark):
    repeated = spark.range(20_000).selectExpr("'fr' AS lang", "'bonjour tout le monde' AS text")
    few = spark.range(50).selectExpr("'en' AS lang", "concat('hello world ', translate(id, '0123456789', 'abcdefghij')) AS text")
    rows = crf.training_rows(repeated.union(few))
    assert {lang for lang, _ in rows} == {"fr", "en"} and len(rows) == 51
    many = [(f"l{i:03d}", f"{chr(0x4E00 + i) * 4} {chr(0x5E00 + i) * 3}".split()) for i in range(300)]
    assert len(crf.fit(many, epochs=1).languages) == 300


def test_query_against_all_paths(spark):
    """Label, score and ties of short texts from the sum over all label sequences."""
    from itertools import product

    import pyarrow as pa

    rows = [("xa", ["abab", "baba", "aabb"]), ("xb", ["cdcd", "dcdc", "ccdd"]), ("xc", ["efef", "fefe"])]
    model = crf.fit(rows, bits=10)
    texts = ["abab cdcd efef", "Dcdc", "baba baba fefe cdcd aabb", "12", None, "zz zz"]
    got = {r["doc_id"]: r for r in crf.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = [w for w in (text or "").lower().split() if w.isalpha()]
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        scores, total = crf.emissions(pa.array(words), model), np.zeros((len(words), 3))
        for path in product(range(3), repeat=len(words)):
            weight = np.exp(model.start[path[0]] + sum(scores[j, s] for j, s in enumerate(path)) + sum(model.transitions[p, q] for p, q in zip(path, path[1:])))
            for j, s in enumerate(path):
                total[j, s] += weight
        mean = (total / total.sum(1, keepdims=True)).mean(0)
        assert got[i]["lang_pred"] == model.languages[int(mean.argmax())] and abs(got[i]["score"] - mean.max()) < 1e-9


def test_other_columns_are_no_input(odd, documents):
    model = crf.fit(crf.training_rows(documents.select("text", "lang")))
    a = crf.label(documents.limit(20), model).orderBy("doc_id").collect()
    b = crf.label(documents.limit(20).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("q")), model).orderBy("doc_id").collect()
    assert a == b


def test_long_runs_are_read_whole(spark):
    a, b = "アイウエオカキクケコサシ", "漢字文書語言学校先生私"
    rng = np.random.default_rng(3)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(lang, run(letters, 300)) for lang, letters in (("xa", a), ("xb", b)) for _ in range(30)]
    model = crf.fit(crf.training_rows(spark.createDataFrame(rows, "lang string, text string")))
    middle = [(1, run(a, 12) + run(b, 400) + run(a, 12)), (2, run(b, 12) + run(a, 400) + run(b, 12)), (3, run(a, 240) + run(b, 240))]
    out = {r["doc_id"]: r for r in crf.label(spark.createDataFrame(middle, "doc_id long, text string"), model, word_labels=True).collect()}
    assert (out[1]["lang_pred"], out[2]["lang_pred"]) == ("xb", "xa") and out[1]["labels"] == ["xb"] and out[1]["words"] == [middle[0][1]]
    assert 0.3 < out[3]["score"] < 0.7


def test_sample_does_not_shrink_with_copies(spark):
    texts = spark.range(40).selectExpr("'en' AS lang", "concat('words of text ', translate(id, '0123456789', 'abcdefghij')) AS text")
    copies = texts.where("text LIKE '% a'").crossJoin(spark.range(40000).select()).union(texts)
    assert sorted(crf.training_rows(copies, rows_per_language=20)) == sorted(crf.training_rows(texts, rows_per_language=20))
    assert len(crf.training_rows(copies, rows_per_language=20)) == 20
