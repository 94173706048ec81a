"""Personal data: base patterns, and bootstrapped contextual extraction on top of them.

Base patterns find e-mail and IP addresses, payment cards and phone numbers.
They seed the bootstrap: the words before and after a seed are lexical patterns,
a pattern with many seeds of one kind vouches for the other identifiers that
stand in it, and those vouch for further patterns.  Patterns and instances are a
graph whose scores Spark computes in rounds over grouped edges, until the
accepted patterns stay the same; occurrences of accepted instances in accepted
patterns become spans of the pattern's kind.

DataFrame functions only.  Where a span starts follows from the lengths of the
pieces that ``split`` leaves between the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import let, stage

KINDS = ("email", "ip", "card", "phone")
_WS = r"\x20\x09-\x0D"
# A match can only start where a run of its first class does, or where the last match ended; so each run is tried once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Words that hold a digit or an @, with the groups of digits after them.
TOKEN = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+(?:\x20[(+]?[0-9][0-9().+/-]*+[^{_WS}0-9\p{{L}}]*+(?![^{_WS}]))*+"
#: Rounds at most; seeds of a pattern, its confidence, the score of an instance, digits of one without an @.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE, MIN_DIGITS = 20, 5, 0.8, 0.9, 5
#: Matches that are put into one list before lists are joined: a list is copied each time that it grows.
CHUNK = 128
_KEY = ["doc_id", "text_key"]
_BASE = "array<struct<start:int,kind:int,stop:int>>"
_SPAN = "array<struct<start:int,stop:int,text:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping: array of (start, stop, text, before, after), in code points.

    ``before`` and ``after`` reach to the neighbouring matches.  Time grows with
    the text and hardly more than the number of matches.
    """

    def spans(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(F.arrays_zip(gaps.alias("gap"), found.alias("found"), F.slice(gaps, 2, F.size(gaps)).alias("rest")), joined)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(F.coalesce(x["found"], F.lit("")))
        span = F.struct(begin.alias("start"), end.alias("stop"), x["found"].alias("text"), x["gap"].alias("before"), x["rest"].alias("after"))
        return F.struct(end.alias("at"), F.when(x["found"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    def joined(pairs: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * CHUNK + 1, CHUNK), empty, step))

        def shifted(state: Column, chunk: Column) -> Column:
            own = F.transform(
                chunk["out"],
                lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["stop"] + state["at"]).alias("stop"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after")),
            )
            return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(chunks, none, shifted, lambda s: F.flatten(s["out"]))

    return let(F.split(text, pattern, -1), spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: array of (start, kind number, stop)."""
    digits = lambda s: F.regexp_replace(s["text"], "[^0-9]", "")
    long = lambda s, a, b: F.length(digits(s)).between(a, b)
    rules = (
        (EMAIL, text.contains("@"), lambda s: F.lit(True)),
        (IP, text.rlike("[0-9]\\.[0-9]"), lambda s: s["text"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        (CARD, text.rlike("[0-9]"), lambda s: F.when(long(s, 12, 19), luhn(digits(s))).otherwise(F.lit(False))),
        (PHONE, text.contains("+"), lambda s: long(s, 9, 15)),
    )
    found = []
    for number, (pattern, there, keep) in enumerate(rules):
        spans = F.transform(F.filter(matches(text, pattern), keep), _as_span(number))
        found.append(F.when(there, spans).otherwise(F.array().cast(_BASE)))
    return F.array_sort(F.concat(*found))


def _as_span(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["stop"].alias("stop"))


def _words(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[{_WS}]+", " ")


def candidates(text: Column) -> Column:
    """Words with a digit or @ and the groups of digits after them, without the punctuation around: (start, stop, text, left, right).

    ``left``: up to two words before, ``right``: the word after, in lower case;
    other candidates are no context.
    """
    edge = r"[^\p{L}\p{N}+]*+"

    def with_context(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["text"], f"^{edge}", 0))
        tail = F.length(F.regexp_extract(F.reverse(s["text"]), r"^[^\p{L}\p{N}]*+", 0))
        left = F.reverse(F.regexp_extract(F.reverse(s["before"]), rf"^[{_WS}]*+([^{_WS}]++(?:[{_WS}]++[^{_WS}]++)?)", 1))
        right = F.regexp_extract(F.coalesce(s["after"], F.lit("")), rf"^[{_WS}]*+([^{_WS}]++)", 1)
        stop = F.greatest(s["stop"] - tail, s["start"] + head)
        own = F.lower(F.substring(s["text"], head + 1, stop - s["start"] - head))
        return F.struct((s["start"] + head).alias("start"), stop.alias("stop"), own.alias("text"), _words(left).alias("left"), _words(right).alias("right"))

    none = F.array().cast("array<struct<start:int,stop:int,text:string,left:string,right:string>>")
    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(matches(text, TOKEN), with_context), lambda s: s["text"] != "")).otherwise(none)


def render(spans: Column) -> Column:
    """kind:start:stop by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Scores of instances (instance, kind, score) and confidences of patterns (pattern, kind, confidence).

    ``edges``: pattern, instance, seed (kind number, null if the base doesn't
    know it), n.  A pattern's confidence in a kind is the part of its
    occurrences, plus one, that instances of that kind hold, weighed by score;
    it counts from ``min_seeds`` different instances and ``min_confidence`` on.
    An instance's score is the noisy-or of the patterns that it stands in.
    Rounds end when the accepted patterns are those of the round before.
    """
    seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    flat = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    scores, patterns, seen = seeds, None, None
    for _ in range(rounds):
        mass = flat.join(scores, "instance").groupBy("pattern", "kind")
        mass = mass.agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.sum((F.col("score") >= MIN_SCORE).cast("int")).alias("support"))
        found = mass.join(total, "pattern").withColumn("confidence", F.col("mass") / (F.col("total") + 1))
        found = found.where((F.col("support") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "kind", "confidence")
        patterns = stage(found, "pii-patterns")
        mark = patterns.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        met = flat.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        scores = stage(seeds.unionByName(met).groupBy("instance", "kind").agg(F.max("score").alias("score")), "pii-scores")
        if not mark[0]:
            break
    return scores, patterns


def _seen(found: DataFrame) -> DataFrame:
    """Every candidate in every pattern: (doc_id, text_key, start, stop, instance, seed, pattern).

    ``seed`` is the kind of a base span that overlaps it, found by running
    extremes over the spans of a text in order.
    """
    once = found.where(F.size("words") > 0).dropDuplicates(_KEY)
    base = once.select(*_KEY, F.explode("base").alias("b")).select(*_KEY, "b.start", "b.stop", "b.kind", *[F.lit(None).cast("string").alias(c) for c in ("text", "left", "right")])
    words = once.select(*_KEY, F.explode("words").alias("w")).select(*_KEY, "w.start", "w.stop", F.lit(None).cast("int").alias("kind"), "w.text", "w.left", "w.right")
    in_order = Window.partitionBy(*_KEY).orderBy("start", F.col("kind").isNull(), "stop")
    known = F.col("kind").isNotNull()
    up_to = F.max(F.when(known, F.struct("stop", "kind"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy(*_KEY).orderBy(F.desc("start"), F.col("kind").isNotNull(), F.desc("stop"))
    after = F.min(F.when(known, F.struct("start", "kind"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    seed = F.when(up_to["stop"] > F.col("start"), up_to["kind"]).when(after["start"] < F.col("stop"), after["kind"])
    marked = base.unionByName(words).withColumn("seed", seed).where("kind IS NULL")
    last = F.regexp_extract(F.reverse("left"), rf"^[^{_WS}]++", 0)
    last = F.reverse(last)
    some = [F.concat(F.lit("l:"), "left"), F.concat(F.lit("l:"), last), F.concat(F.lit("r:"), "right"), F.concat(F.lit("b:"), last, F.lit(" "), "right")]
    there = [F.col("left") != "", F.col("left") != "", F.col("right") != "", (F.col("left") != "") & (F.col("right") != "")]
    patterns = F.array_distinct(F.array_compact(F.array(*[F.when(t, p) for t, p in zip(there, some)])))
    return marked.select(*_KEY, "start", "stop", F.col("text").alias("instance"), "seed", F.explode(patterns).alias("pattern"))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind number, stop; in code points, stop exclusive).

    ``spans`` is ``base`` and what the bootstrap adds: candidates (see
    ``candidates``) with an @ or at least five digits that overlap no base span.
    Of several kinds the one with the best score, then confidence, then the first
    counts.  Null and empty texts have none.  Equal rows are treated alike.
    Columns but doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), base_spans(text).alias("base"), candidates(text).alias("words"))
    found = stage(found, "pii-base")
    seen = stage(_seen(found), "pii-words")
    edges = stage(seen.groupBy("pattern", "instance", "seed").agg(F.count("*").alias("n")), "pii-edges")
    scores, patterns = score_graph(edges, rounds, min_seeds, min_confidence)
    looks = F.col("instance").contains("@") | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= MIN_DIGITS)
    fresh = seen.where(F.col("seed").isNull() & looks).join(patterns, "pattern").join(scores.where(F.col("score") >= min_score), ["instance", "kind"])
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("confidence")).alias("c"), "kind", "stop")).alias("best")
    added = fresh.groupBy(*_KEY, "start").agg(best).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "best.kind", "best.stop")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("added").cast(_BASE).alias("added"))
    out = found.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_BASE)))).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")
    return out.select("doc_id", *[count(n) for n in range(len(KINDS))], F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
