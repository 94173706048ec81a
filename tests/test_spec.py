import pytest

from lattica.operators import prepare
from lattica.plans.spec import ModelSpec, bind, bind_clusters, by_position, rename_fe, select_fe

COLUMNS = ["Wage", "worker", "firm", "time", "region"]
FE = ("worker", "firm", "time")


def test_columns_once_in_order():
    assert ModelSpec("y", ("a", "b"), ("a", "z"), ("f", "b"), "f", "w").columns() == ("y", "a", "b", "f", "z", "w")


def test_names_bind_whatever_the_case():
    assert bind(["WAGE", "nope", "wage", "Firm"], COLUMNS, "test") == ("Wage", "firm")


def test_clusters():
    assert bind_clusters(["time", "worker"], FE, COLUMNS) == ("worker", "time")
    assert bind_clusters(["region", "time", "firm", "worker"], FE, COLUMNS) == ("worker", "firm", "time")
    assert bind_clusters(["nope", "nada"], FE, COLUMNS, by_position=True) == ("worker", "firm")
    assert bind_clusters([], FE, COLUMNS) == ()
    with pytest.raises(ValueError):
        bind_clusters(["nope"], FE, COLUMNS)


def test_fixed_effects_by_position():
    assert select_fe(FE, [3, 1, 9], ["firm", "time"]) == (("time", "worker"), ("time",))
    assert by_position(FE, [2, 7, 1, 2], "dims") == ("worker", "firm")
    assert rename_fe(FE, ("w", "f", "t")) == {"worker": "w", "firm": "f", "time": "t"}
    with pytest.raises(ValueError):
        rename_fe(FE, ("w",))


def test_dense_ids_over_many_ranges(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "c", "b"] + [f"k{i:03d}" for i in range(500)]], "g string")
    ids = {r["g"]: r["level_id"] for r in prepare.dense_ids(df, "g").collect()}
    assert [g for g, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(ids) and sorted(ids.values()) == list(range(1, 504))


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, g string")
    assert prepare.drop_missing(df).count() == 1 and prepare.drop_missing(df, ["g"]).count() == 3
    with pytest.raises(ValueError):
        prepare.reject_missing(df)
    assert prepare.reject_missing(df.where("x = 1"), ["x"]) == 1
