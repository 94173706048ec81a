import hashlib
import re

from pyspark.sql import functions as F

from lattica.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    keep = (
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m.split(".")),
        lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    )
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if keep[k](m.group()))


TEXTS = [
    "mail a@b@c.d.e, x._y@e.f_g@h.i and b.o-b+1@mail-2.example.org.",
    "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1 256.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 and 5555555555554444",
    "+1 (415) 555-2671 é \U0001f600 +49.30.1234567 +12 +1234567890123456 +1-2-3-4-5-6-7-8-9",
    "a." * 3000 + "@" + "b." * 3000 + "c",
    "1" * 5000 + " +" + "2" * 3000,
    "x" * 20000,
]


def test_base_against_plain_patterns(spark, documents, odd):
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").union(extra)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in pii.find_pii(rows).collect():
        assert [tuple(s) for s in r["base"]] == base(text[r["doc_id"]])
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def test_contexts_find_what_the_base_misses(spark):
    rows = [(i, f"zork blip customer ref phone +1 415 555 {2000 + i} thanks") for i in range(30)]
    rows += [(100 + i, f"reach us at customer ref phone 41555520{i:02d} thanks") for i in range(5)]
    rows += [(200 + i, f"invoice number 8855{i:04d} due") for i in range(30)]
    out = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        (span,) = out[100 + i]["spans"]
        assert rows[30 + i][1][span["start"] : span["stop"]] == f"41555520{i:02d}" and pii.KINDS[span["kind"]] == "phone"
    assert not any(out[200 + i]["spans"] for i in range(30))


def test_groups_right_contexts_and_trimming(spark):
    """Identifiers in groups, contexts after them, punctuation around them, and a second round of patterns."""
    rows = [(1000 + i, f"call +1 415 555 {2000 + i} mobile today") for i in range(300)]
    rows += [(100 + i, f"dial 030 1234 56{i:02d}, mobile now") for i in range(20)]  # known by the word after
    rows += [(200 + i, f"noise xyzzy (030 1234 56{i:02d}) end") for i in range(20)]  # known as instances: a new pattern
    rows += [(300, "noise xyzzy [040 9999 9999]; end"), (301, f"{'w' * 5000} 12345678 z"), (302, "id 040 9999 9998 end")]
    text = dict(rows)
    out = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000] == ["+1 415 555 2000"] and out[103] == out[203] == ["030 1234 5603"]
    assert out[300] == ["040 9999 9999"] and out[301] == [] and out[302] == []


def brute_scores(edges, min_seeds, min_confidence):
    seeds = {(i, k): 1.0 for _, i, k, _ in edges if k is not None}
    total, flat = {}, {}
    for p, i, _, n in edges:
        total[p] = total.get(p, 0) + n
        flat[p, i] = flat.get((p, i), 0) + n
    scores, before = dict(seeds), None
    while True:
        patterns = {}
        for p in total:
            for kind in range(4):
                own = [(n, scores[i, kind]) for (q, i), n in flat.items() if q == p and (i, kind) in scores]
                confidence = sum(n * x for n, x in own) / (total[p] + 1)
                if sum(x >= pii.MIN_SCORE for _, x in own) >= min_seeds and confidence >= min_confidence:
                    patterns[p, kind] = confidence
        if patterns.keys() == before:
            return scores, patterns
        before = patterns.keys()
        scores = dict(seeds)
        for i in {i for _, i in flat}:
            for kind in range(4):
                rest = 1.0
                for (p, k), confidence in patterns.items():
                    if k == kind and (p, i) in flat:
                        rest *= 1 - confidence
                if rest < 1:
                    scores[i, kind] = max(scores.get((i, kind), 0), 1 - rest)


def test_graph_against_plain_scores(spark):
    import random

    rng = random.Random(4)
    edges = {}
    for _ in range(600):
        i = rng.randrange(60)
        kind = i % 2 if i % 3 else None
        edges[f"p{(i % 2) * 5 + rng.randrange(5) if rng.random() < 0.95 else rng.randrange(10)}", f"i{i}", kind] = rng.randrange(1, 5)
    rows = [(*k, n) for k, n in edges.items()]
    df = spark.createDataFrame(rows, "pattern string, instance string, seed int, n long")
    scores, patterns = pii.score_graph(df, min_seeds=3, min_confidence=0.5)
    want_scores, want_patterns = brute_scores(rows, 3, 0.5)
    assert {(r["pattern"], r["kind"]): round(r["confidence"], 9) for r in patterns.collect()} == {k: round(v, 9) for k, v in want_patterns.items()} != {}
    assert {(r["instance"], r["kind"]): round(r["score"], 9) for r in scores.collect()} == {k: round(v, 9) for k, v in want_scores.items()}


def test_a_hundred_thousand_matches_in_one_text(spark):
    import time

    text = " ".join(f"{i % 256}.1.2.3 x{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.find_pii(df).first()
    took = time.time() - began
    assert [tuple(s) for s in row["base"]] == base(text) and took < 60


def test_digest_columns_and_odd_rows(spark, sf, odd, nothing):
    row = pii.op6_pii(spark, sf).first()
    assert list(row.asDict()) == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(nothing).count() == 0
    one = spark.createDataFrame([(1, "x a@b.cd 1.2.3.4")], "doc_id long, text string")
    out = pii.find_pii(one).select(pii.render(F.col("base")).alias("s")).first()["s"]
    assert out == "email:2:8,ip:9:16" and hashlib.sha256(out.encode()).hexdigest()


def test_luhn(spark):
    cases = ["4111111111111111", "4111111111111112", "5555555555554444", "000000000000"]
    df = spark.createDataFrame([(c,) for c in cases], "d string").select("d", pii.luhn(F.col("d")).alias("ok"))
    assert {r["d"]: r["ok"] for r in df.collect()} == {c: luhn(c) for c in cases}
