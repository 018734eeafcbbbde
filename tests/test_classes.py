import pytest
from pyspark.sql import functions as F

from grovemark.functions.labels import is_class_or_below
from grovemark.operators import classes
from grovemark.session import lookup_join

# Part of the diabetes classes; the foot has two numbers.
PATHS = [
    ("D003920", "C19.246", "root"),
    ("D048909", "C19.246.099", "complications"),
    ("D003925", "C19.246.099.500", "angiopathies"),
    ("D003930", "C19.246.099.500.382", "retinopathy"),
    ("D003929", "C19.246.099.937", "neuropathies"),
    ("D017719", "C19.246.099.500.191", "foot"),
    ("D017719", "C19.246.099.937.250", "foot"),
    ("D003922", "C19.246.267", "type 1"),
    ("D014929", "C19.246.267.960", "Wolfram"),
    ("D016640", "C19.246.200", "gestational"),
    ("X1", "C19.2467", "not below the root"),
]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame(PATHS, "ui string, mn string, heading string")


def test_subtree_stops_at_dots(paths):
    assert "X1" not in {r.ui for r in classes.subtree(paths, "C19.246").collect()}


def test_ancestors(paths):
    got = {r.ui: set(r.ancestors) for r in classes.ancestors(paths, "D003920").collect()}
    assert got["D003930"] == {"D048909", "D003925"}
    assert got["D017719"] == {"D003925", "D003929", "D048909"}
    assert got["D014929"] == {"D003922"}
    assert got["D016640"] == set()


def test_closure_of_one_path_only(paths):
    scoring = paths.filter("mn != 'C19.246.099.500.191'")
    got = {(r.ui, r.descendant_ui) for r in classes.class_closure(scoring).collect()}
    assert ("D003929", "D017719") in got and ("D003925", "D017719") not in got


def test_positive_flag_and_unknown_class(spark, paths):
    rows = [(1, "D003925"), (2, "D003930"), (3, "D017719"), (4, "D048909"), (5, "unknown")]
    docs = classes.with_ancestors(spark.createDataFrame(rows, "id long, ui string"), paths, "D003920", "ui")
    flag = is_class_or_below(F.col("ui"), F.col("ancestors"), "D003925")
    assert {r.id: r.f for r in docs.select("id", flag.alias("f")).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_patch_replaces_by_number(spark, paths):
    new = spark.createDataFrame([("D9", "C19.246.200", "other"), ("D8", "C19.246.777", "new")], paths.schema)
    got = {r.mn: r.ui for r in classes.patch(paths, new).collect()}
    assert got["C19.246.200"] == "D9" and got["C19.246.777"] == "D8" and len(got) == len(PATHS) + 1


@pytest.mark.parametrize("bound", [100, 0])
@pytest.mark.parametrize("keep", [True, False])
def test_keep_listed_by_both_routes(spark, bound, keep):
    rows = [(1, ["b", "a", "b", "c"]), (2, ["c"]), (3, None), (4, []), (5, ["a", None, "b"]), (6, ["a", "d"]), (6, ["c", "b"])]
    rows += [(7, ["a"] * 40 + ["z"])] * 2
    df = spark.createDataFrame(rows, "id long, items array<string>")
    listed = spark.createDataFrame([("a",), ("b",), (None,)], "word string")
    found = classes.keep_listed(df, "id", "items", listed, keep, max_inline=bound, hot_rows=20)
    inside = lambda items: None if items is None else [x for x in items if (x in ("a", "b")) == keep]
    assert sorted(map(str, ((r.id, r["items"]) for r in found.collect()))) == sorted(map(str, ((k, inside(v)) for k, v in rows)))


def test_no_wanted_heading_gives_null(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["c"])], "id long, items array<string>")
    wanted = spark.createDataFrame([("a",)], "ui string")
    got = {r.id: r["items"] for r in classes.restrict_headings(df, "id", "items", wanted).collect()}
    assert got == {1: ["a"], 2: None}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_splits_hot_keys(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(3000)] + [(-1, None)], "id long, k string")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 3000, 2)], "k string, v long")
    want = sorted(map(tuple, big.join(lookup, "k", how).select("id", "k", "v").collect()), key=repr)
    got = sorted(map(tuple, lookup_join(big, lookup, "k", how, hot_rows=100).select("id", "k", "v").collect()), key=repr)
    assert got == want
