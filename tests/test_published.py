from datetime import timedelta

import pytest
from helpers import DistanceModel, TwoColumns, text_rows, write_csv
from pyspark.sql import functions as F

from latewing.plans.batch_scoring import score_file
from latewing.schema import PREDICTION, InputError
from latewing.sources import published as P
from latewing.sources.files import read_text

SOON = timedelta(0)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1,), (2,)], "x int")


def seen(spark, root, name="one"):
    return sorted((r["run_id"], r["x"]) for r in P.published(spark, root, name).collect())


def test_a_run_is_replaced_even_with_nothing(spark, tmp_path, rows):
    root = str(tmp_path / "out")
    P.publish(root, {"one": rows}, "r1")
    P.publish(root, {"one": rows}, "002")
    assert seen(spark, root) == [("002", 1), ("002", 2), ("r1", 1), ("r1", 2)]
    P.publish(root, {"one": rows.limit(0)}, "r1")
    assert seen(spark, root) == [("002", 1), ("002", 2)]
    with pytest.raises(ValueError, match="run_id"):
        P.publish(root, {"one": rows.selectExpr("x", "'mine' AS RUN_ID")}, "r1")
    with pytest.raises(ValueError, match="letters"):
        P.publish(root, {"one": rows}, "a/b")
    with pytest.raises(FileNotFoundError):
        P.published(spark, root, "two")


class Lost(BaseException):
    """The driver is gone: nothing after it runs."""


@pytest.mark.parametrize("step", ["first output", "second output", "check", "pointer aside", "rename", "after"])
def test_a_driver_lost_between_any_two_steps(spark, tmp_path, rows, monkeypatch, step):
    root = str(tmp_path / "out")
    P.publish(root, {"one": rows, "two": rows}, "r1")
    old, new = [("r1", 1), ("r1", 2)], [("r1", 11), ("r1", 12)]
    later = rows.select((F.col("x") + 10).alias("x"))
    broken = rows.select(F.raise_error(F.lit("stop")).cast("int").alias("x"))

    def lost(*_):
        raise Lost

    rename, delete = P._Files.rename, P._Files.delete
    with monkeypatch.context() as patch:
        patch.setattr(P._Files, "delete", lambda *_: None)  # a lost driver does not tidy up
        outputs, check = {"one": later, "two": later}, None
        if step == "first output":
            outputs["one"] = broken
        elif step == "second output":
            outputs["two"] = broken
        elif step == "check":
            check = lost
        elif step == "pointer aside":
            patch.setattr(P._Files, "replace", lost)
        elif step == "rename":
            patch.setattr(P._Files, "rename", lost)
        else:
            patch.setattr(P._Files, "rename", lambda *a: (rename(*a), lost()))
        with pytest.raises((Lost, Exception)):
            P.publish(root, outputs, "r1", check=check)
    want = new if step == "after" else old
    assert seen(spark, root) == seen(spark, root, "two") == want
    P.publish(root, {"one": later, "two": later}, "r1")
    assert seen(spark, root) == seen(spark, root, "two") == new
    assert P._Files.delete is delete and P.sweep(spark, root) == 0
    assert P.sweep(spark, root, SOON) > 0 and seen(spark, root) == seen(spark, root, "two") == new
    assert P.sweep(spark, root, SOON) == 0


def test_a_failed_run_leaves_no_files(spark, tmp_path, rows):
    root = tmp_path / "out"
    broken = rows.select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        P.publish(str(root), {"one": rows, "two": broken}, "r1")
    assert not list(root.rglob("*.parquet"))


def test_columns_of_the_newest_run_are_read(spark, tmp_path, rows):
    root = str(tmp_path / "out")
    P.publish(root, {"one": rows}, "r1")
    P.publish(root, {"one": rows.selectExpr("x", "'new' AS y")}, "r2")
    found = {tuple(r) for r in P.published(spark, root, "one").select("run_id", "x", "y").collect()}
    assert found == {("r1", 1, None), ("r1", 2, None), ("r2", 1, "new"), ("r2", 2, "new")}


def test_scored_file_has_a_record_and_an_ordered_export(spark, tmp_path):
    rows = text_rows(40)
    rows[3]["DISTANCE"], rows[5]["ORIGIN"], rows[6]["ORIGIN"] = "x", "", " "
    path, root = write_csv(tmp_path / "in.csv", rows), str(tmp_path / "out")
    assert score_file(spark, path, DistanceModel, root, "r1", strict=False, export=True) == 37
    record = {r["output"]: r for r in P.run_records(spark, root).collect()}
    assert {n: r["rows"] for n, r in record.items()} == {"scored": 37, "quarantine": 3, "export": None}
    assert record["scored"]["facts"] == {
        "rows_read": "40", "rows_broken": "3", "DISTANCE_numeric": "1", "ORIGIN_blank": "2",
    }
    back = read_text(spark, P.published_folder(spark, root, "export", "r1"))
    assert back.columns[-1] == PREDICTION and len(back.columns) == len(rows[0]) + 1
    assert [r["ARR_DELAY"] for r in back.collect()] == [str(i) for i in range(40) if i not in (3, 5, 6)]


def test_a_model_names_its_columns(spark, tmp_path):
    path, root = write_csv(tmp_path / "in.csv", text_rows(4)), str(tmp_path / "out")
    assert score_file(spark, path, TwoColumns, root, "r1", features=["DISTANCE", "CRS_ELAPSED_TIME"]) == 4
    assert sorted(r[0] for r in P.published(spark, root, "scored").select(PREDICTION).collect()) == [125, 126.1, 127.2, 128.3]
    with pytest.raises(InputError, match="Missing model features: NOPE"):
        score_file(spark, path, TwoColumns, root, "r1", features=["DISTANCE", "NOPE"])


def test_missing_values_never_reach_a_model(spark):
    from latewing.operators.scoring import score_features

    table = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "DISTANCE double, CRS_ELAPSED_TIME double")
    with pytest.raises(Exception, match="Missing values in: DISTANCE"):
        score_features(table, TwoColumns, features=["DISTANCE", "CRS_ELAPSED_TIME"]).collect()


def test_the_input_is_read_once(spark, tmp_path):
    """Counted by the file scans of the jobs that strict scoring runs."""
    path, root = write_csv(tmp_path / "in.csv", text_rows(50)), str(tmp_path / "out")
    opened = []
    original = type(spark.read).csv
    reader = type(spark.read)
    reader.csv = lambda self, *a, **k: (opened.append(a), original(self, *a, **k))[1]
    text = reader.text
    reader.text = lambda self, *a, **k: (opened.append(("text", *a)) if "runs" not in str(a) else None, text(self, *a, **k))[1]
    try:
        assert score_file(spark, path, DistanceModel, root, "r1") == 50
    finally:
        reader.csv, reader.text = original, text
    # The header's look at the first line (twice: the check of the file, the schema), and one scan.
    assert len(opened) == 3 and not any(a[0] == "text" for a in opened)


def test_divided_outputs_go_to_their_own_folders(spark, tmp_path, rows):
    root = str(tmp_path / "out")
    both = rows.selectExpr("x AS k", "x * 2 AS x", "'a' AS `z.z`")
    parts = {"one": ["k", "z.z"], "two": ["x"], "none": ["k"]}
    for _ in range(2):
        place = F.when(F.col("k") == 1, "one").otherwise("two")
        record = P.publish(root, P.Divided(both, place, parts), "r1")
    assert {n: o["rows"] for n, o in record["outputs"].items()} == {"one": 1, "two": 1, "none": 0}
    P.publish(root, {"two": rows}, "r2")  # written on its own, read together
    assert [tuple(r) for r in P.published(spark, root, "one").collect()] == [(1, "a", "r1")]
    assert seen(spark, root, "two") == [("r1", 4), ("r2", 1), ("r2", 2)]
    assert P.published(spark, root, "none").count() == 0
    assert P.sweep(spark, root, SOON) > 0 and seen(spark, root, "two") == [("r1", 4), ("r2", 1), ("r2", 2)]
    with pytest.raises(ValueError, match="no output: __place=else"):
        P.publish(root, P.Divided(both, F.lit("else"), parts), "r1")
    assert seen(spark, root, "two") == [("r1", 4), ("r2", 1), ("r2", 2)]
    assert len(list((tmp_path / "out" / "data").glob("*/*/_version=*"))) == 4
