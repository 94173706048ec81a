import numpy as np
import pytest

from lattica.llm import line_dedup as d


def brute(rows, m):
    """Kept text of every (doc_id, text), documents in order of id."""
    first = {}
    text = {i: t for i, t in rows}
    order = sorted(text.items())
    for i, t in order:
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines) - m + 1):
            first.setdefault(tuple(lines[k : k + m]), (i, k))
    out = {}
    for i, t in order:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - m + 1):
            j, at = first[tuple(lines[k : k + m])]
            if (j, at) < (i, k):
                other = (text[j] or "").split("\n")
                n = next((n for n in range(len(lines) - k) if at + n >= len(other) or other[at + n] != lines[k + n]), len(lines) - k)
                gone |= set(range(max(k, at + m) if i == j else k, k + n))
        out[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5, 6])
def test_against_windows(spark, m):
    rng = np.random.default_rng(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", ""], rng.integers(1, 25)))) for i in range(30)] + [(50, None), (51, ""), (52, "\n" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in d.dedup_lines(df, m).collect()}
    assert got == brute(rows, m)


def test_columns_stay(odd, nothing):
    out = d.dedup_lines(odd.drop("kept"))
    assert set(odd.drop("kept").columns) <= set(out.columns) and out.count() == odd.count()
    assert d.dedup_lines(odd).count() == odd.count() and d.dedup_lines(nothing).count() == 0
    assert out.where("text is null").first()["kept"] is None
    same = {r["kept"] for r in out.where("doc_id = 5 and text like 'The%'").collect()}
    assert len(same) == 1  # equal rows are treated alike


def test_ranks_are_the_order_of_suffixes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c"], rng.integers(1, 40)))) for i in range(12)] + [(20, "a\n" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {(r["doc_id"], r["pos"]): (r["k1"], r["k2"]) for r in d.line_ids(df).collect()}
    levels = d.suffix_levels(df)
    for j, level in enumerate(levels):
        def lines(i, p):
            return tuple(ids[i, p + k] for k in range(1 << j))

        groups = {}
        for i, p in ids:
            if (i, p + (1 << j) - 1) in ids:
                groups.setdefault(lines(i, p), []).append((i, p))
        want = {place for g in groups.values() if len(g) > 1 for place in g}
        got = {(r["doc_id"], r["pos"]): r for r in level.collect()}
        assert got.keys() == want
        ranks = {}
        for place, r in got.items():
            assert ranks.setdefault(lines(*place), r["rank"]) == r["rank"]
            assert (r["first"]["doc_id"], r["first"]["pos"]) == min(groups[lines(*place)])
        assert [ranks[k] for k in sorted(ranks)] == sorted(set(ranks.values()))
    assert len(levels) == 7  # the last text repeats itself over 69 lines


def test_first_run_stays_whole(spark):
    rows = [(1, "h\na\na\na\na\nt"), (2, "x\ny\nx\ny\nx\ny\nx"), (3, "\n".join("a" * 5000)), (4, "q\na\na\na\nr")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in d.dedup_lines(df, long_bytes=None).collect()}
    assert got == {1: "h\na\na\na\nt", 2: "x\ny\nx", 3: "", 4: "q\nr"}


def test_repeated_rows_don_t_multiply(spark):
    rows = [(1, "\n".join(f"l{i}" for i in range(200)))] * 6 + [(2, "\n".join(f"l{i}" for i in range(100, 200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert d.suffix_levels(df)[0].count() == 300
    out = d.dedup_lines(df).collect()
    assert len(out) == 7 and [r["n_removed"] for r in out if r["doc_id"] == 1] == [0] * 6 and [r["n_removed"] for r in out if r["doc_id"] == 2] == [100]


def test_no_python_on_executors(documents):
    plan = d.dedup_lines(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_runs_of_few_lines(spark):
    one = " ".join(f"w{i}" for i in range(50))
    two = [" ".join(f"{c}{i}" for i in range(25)) for c in "ab"]
    unspaced = "語" * 140
    short = " ".join(f"s{i}" for i in range(49))
    rows = [(1, "\n".join(["start", one, "x", *two, "y", unspaced, short])), (2, "\n".join(["other", one, "z", short])), (3, "\n".join([two[0], "q", *two, "q"])), (4, f"m\n{unspaced}\n{two[1]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: f"other\nz\n{short}", 3: f"{two[0]}\nq\nq", 4: f"m\n{two[1]}"}
    assert {r["doc_id"]: r["kept"] for r in d.dedup_lines(df).collect()} == want
    assert {r["doc_id"]: r["kept"] for r in d.dedup_lines(df, 5).collect()} == want
    assert {r["doc_id"]: r["kept"] for r in d.dedup_lines(df, long_bytes=None).collect()} == dict(rows)


def test_the_same_join_at_every_size(documents):
    plan = d.dedup_lines(documents.select("doc_id", "text"), long_bytes=None)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_driver_gives_memory_back_each_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(d, "release", lambda session: calls.append(session))
    lines = [f"l{i}" for i in range(70)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines))], "doc_id long, text string")
    levels = d.suffix_levels(df)
    assert len(levels) == 7 and len(calls) >= 7
