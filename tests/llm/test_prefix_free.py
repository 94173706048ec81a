import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import prefix_free as p


def brute(rows, window):
    """(doc_id, bytes, removed runs, kept) of every row."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for k in range(len(b) - window + 1):
            if least[b[k : k + window]] < i:
                gone[k : k + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), edge[::2].tolist(), edge[1::2].tolist(), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"], r["n_bytes"], list(r["starts"]), list(r["stops"]), bytes(r["kept"])) for r in df.collect())


def test_documents(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want = {i: (n, sum(b) - sum(a), len(a), hashlib.sha256(kept).hexdigest()) for i, n, a, b, kept in brute(rows, 50)}
    got = {r["doc_id"]: tuple(r)[1:] for r in p.op7_prefix_free(spark, sf).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0


@pytest.mark.parametrize("window, key", [(8, 3), (12, 12), (5, 2)])
def test_small_alphabets(spark, window, key):
    rng = np.random.default_rng(window)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 60)))) for i in range(40)] + [(99, "a" * 80), (98, "a" * 90), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(p.remove_repeats(df, window, key)) == brute(rows, window)


@pytest.mark.parametrize("many", [1, 2, 5])
def test_hot_triggers_find_the_same(spark, many):
    rng = np.random.default_rng(many)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 60)))) for i in range(40)] + [(99, "a" * 80), (3, "b" * 30), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(p.remove_repeats(df, 8, 3, hot_phrases=many)) == brute(rows, 8)


def test_one_key_in_many_contexts(spark):
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefgh"), 40)) for _ in range(6000)]
    common = "the same passage of some forty characters"
    rows = [(i, noise[2 * i] + common + noise[2 * i + 1]) for i in range(3000)]
    rows += [(3000 + i, "x" + rows[7 * i][1][5:100]) for i in range(40)]  # repeats that begin and end within contexts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = found(p.remove_repeats(df, hot_phrases=500))
    assert got == brute(rows, 50) == found(p.remove_repeats(df))
    assert sum(len(r[2]) for r in got) >= 40


def test_windows_of_hot_phrases():
    data = np.frombuffer(b"0123456789abcdef0123456789", np.uint8)
    n = lambda *x: np.array(x, np.int64)
    u = lambda *x: np.array(x, np.uint64)
    text, trigger, first, last, phrase = p._windows(data, 5, np.array([False, True, True]), n(0, 0, 1), u(1, 2, 2), n(0, 2, 18), n(3, 4, 20), u(7, 8, 9))
    assert text.tolist() == [0, 0, 0, 0, 1, 1, 1] and first.tolist() == [0, 2, 3, 4, 18, 19, 20] and last.tolist() == [3, 2, 3, 4, 18, 19, 20]
    assert trigger[1:4].tolist() == trigger[4:].tolist() == phrase[1:4].tolist() and len(set(trigger[1:4].tolist())) == 3


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()]
    assert found(p.remove_repeats(odd.where("doc_id is not null"))) == brute(rows, 50)
    assert p.remove_repeats(odd).where("doc_id is null").count() == 1
    assert p.remove_repeats(nothing).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=20), min_size=1, max_size=8))
def test_suffix_intervals(texts):
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    least, at = p.suffix_minima(data, sizes, np.arange(len(texts)), 6)
    for i, t in enumerate(texts):
        for k in range(len(t) - 5):
            assert least[at[i] + k] == min(j for j, u in enumerate(texts) if t[k : k + 6] in u)


def test_every_window_is_in_one_phrase_and_equal_windows_have_equal_triggers():
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 101, 200).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 101, 300).astype(np.uint8), piece, rng.integers(97, 101, 100).astype(np.uint8), piece])
    text, trigger, first, last, _ = p.phrases(data, np.array([0, 520, len(data)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == [*range(0, 520 - 49), *range(520, len(data) - 49)]
    owner = np.repeat(trigger, last - first + 1)
    of = dict(zip(covered.tolist(), owner.tolist()))
    assert all(of[300 + k] == of[600 + k] for k in range(150) if 300 + k in of)


def test_tables_and_shuffles_go_when_used(spark, monkeypatch):
    made, order = [], []
    stage, unstage, release = p.stage, p.unstage, p.release
    monkeypatch.setattr(p, "stage", lambda df, name, *more: (order.append(name), made.append(stage(df, name, *more)), made[-1])[-1])
    monkeypatch.setattr(p, "release", lambda *more: (order.append("release"), release(*more))[1])
    monkeypatch.setattr(p, "unstage", lambda df: (order.append("unstage"), unstage(df))[1], raising=False)
    text = "".join(chr(97 + i * i % 23) for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, "y" * 30 + text[:120])], "doc_id long, text string")
    got = {r["doc_id"]: len(r["kept"]) for r in p.remove_repeats(df).collect()}
    assert got == {1: 200, 2: 1, 3: 30}
    steps = [a for a, b in zip(order, [None, *order]) if a != b]
    assert steps == ["repeats-asked", "release", "repeats-phrases", "unstage", "release", "repeats-runs", "unstage", "release"]
    left = [t for t in made if spark._jvm.java.io.File(t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")).exists()]
    assert left == made[2:]
