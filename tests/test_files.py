import pytest
from helpers import SCORED, SCORED_SCHEMA, TEXT_COLUMNS, BrokenModel, DistanceModel, text_rows, write_csv

from latewing.operators.row_index import block_offsets, with_row_index, with_scan_position
from latewing.plans.batch_scoring import score_file
from latewing.sources.published import published
from latewing.schema import PREDICTION, InputError
from latewing.sources import files, sinks
from pyspark.sql import functions as F


def test_monthly_files(spark, tmp_path):
    names = ["YEAR", "MONTH", "FL_DATE", "ORIGIN", "CRS_DEP_TIME", "ARR_DELAY", "NOTE"]
    for month in (1, 2):
        rows = [
            {"YEAR": "2026", "MONTH": str(month), "FL_DATE": f"2026-0{month}-01", "CRS_DEP_TIME": "0600", "ARR_DELAY": x}
            for x in ("1.5", "")
        ]
        write_csv(tmp_path / f"month_{month}.csv", rows, names)
    df = files.read_records(spark, str(tmp_path))
    types = dict(df.dtypes)
    assert (types["YEAR"], types["ARR_DELAY"], types["CRS_DEP_TIME"], types["NOTE"]) == ("int", "double", "string", "string")
    assert df.count() == 4 and df.where("ARR_DELAY is null").count() == 2
    assert df.first()["CRS_DEP_TIME"] == "0600"
    stored = str(tmp_path / "stored")
    files.store_by_month(df, stored)
    back = spark.read.parquet(stored).where("YEAR = 2026 and MONTH = 2")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(YEAR" in back._jdf.queryExecution().executedPlan().toString()


def test_no_monthly_files(spark, tmp_path):
    with pytest.raises(InputError, match="No CSV files found"):
        files.read_records(spark, str(tmp_path))


def test_union_of_months(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2.5, 2)], "c double, a int")
    got = sorted(tuple(r) for r in files.union_months(a, b).select("a", "b", "c").collect())
    assert got == [(1, "x", None), (2, None, 2.5)]


def test_inspection(spark, tmp_path):
    good = write_csv(tmp_path / "good.csv", text_rows(3))
    assert files.inspect_input(spark, good) == TEXT_COLUMNS
    with pytest.raises(InputError, match="not found"):
        files.inspect_input(spark, str(tmp_path / "none.csv"))
    with pytest.raises(InputError, match=r"\.csv"):
        files.inspect_input(spark, str(tmp_path / "trips.txt"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(InputError, match="empty"):
        files.inspect_input(spark, str(tmp_path / "empty.csv"))
    short = write_csv(tmp_path / "short.csv", text_rows(1), [c for c in TEXT_COLUMNS if c not in ("ORIGIN", "DEST")])
    with pytest.raises(InputError, match="Missing required columns: DEST, ORIGIN"):
        files.inspect_input(spark, short)
    scored = write_csv(tmp_path / "scored.csv", text_rows(1), [*TEXT_COLUMNS, PREDICTION])
    with pytest.raises(InputError, match=PREDICTION):
        files.inspect_input(spark, scored)
    (tmp_path / "binary.csv").write_bytes(b"\xff\xfe\x00\x81\x82,\xff\n\xff\xff\n")
    with pytest.raises(InputError):
        files.inspect_input(spark, str(tmp_path / "binary.csv"))


def test_text_keeps_cells_and_drops_the_byte_order_mark(spark, tmp_path):
    path = write_csv(tmp_path / "bom.csv", text_rows(7), bom=True)
    df = files.read_text(spark, path)
    assert df.columns == TEXT_COLUMNS and set(dict(df.dtypes).values()) == {"string"}
    assert df.first()["CRS_DEP_TIME"] == "0630"
    assert files.count_rows(spark, path) == 7


def test_upload_check(spark, tmp_path):
    path = write_csv(tmp_path / "up.csv", text_rows(9), [c for c in TEXT_COLUMNS if c != "DEST"])
    got = files.analyse_upload(spark, path)
    assert (got["rows"], got["columns"], got["missing"], got["preview"].count()) == (9, 9, ["DEST"], 5)


def test_row_numbers_over_many_blocks(spark, tmp_path):
    lines = 20_000
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.csv").write_text("n,pad\n" + "\n".join(f"{i},{'x' * (i % 40)}" for i in range(lines)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        scan = with_scan_position(files.read_text(spark, str(tmp_path)))
        indexed = with_row_index(scan, block_offsets(scan))
        assert scan.select("__file", "__block").distinct().count() > 3
        assert indexed.count() == 3 * lines
        assert indexed.where(F.col("row_index") != F.col("n").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def read_back(spark, folder):
    return spark.read.parquet(folder)


def test_score_file_passes_text_through(spark, tmp_path):
    rows = text_rows(12)
    path = write_csv(tmp_path / "in.csv", rows)
    out = str(tmp_path / "out")
    assert score_file(spark, path, DistanceModel, out, "r1") == 12
    assert score_file(spark, path, DistanceModel, out, "r1") == 12
    got = published(spark, out, "scored").orderBy(F.col("ARR_DELAY").cast("int")).collect()
    assert len(got) == 12
    assert [r["CRS_DEP_TIME"] for r in got] == [r["CRS_DEP_TIME"] for r in rows]
    assert [r[PREDICTION] for r in got] == [round(float(r["DISTANCE"]) / 100, 2) for r in rows]


def test_strict_scoring_names_file_rows_and_writes_nothing(spark, tmp_path):
    rows = text_rows(12)
    rows[8]["DISTANCE"] = "abc"
    path = write_csv(tmp_path / "in.csv", rows)
    out = tmp_path / "out"
    with pytest.raises(InputError, match=r"Column DISTANCE has 1 invalid numeric value\(s\) \(row 10\)"):
        score_file(spark, path, DistanceModel, str(out), "r1")
    assert not list(out.rglob("*.parquet")) and not list(out.rglob("*.json"))


def test_failing_model_publishes_nothing(spark, tmp_path):
    path = write_csv(tmp_path / "in.csv", text_rows(4))
    out = tmp_path / "out"
    with pytest.raises(Exception):
        score_file(spark, path, BrokenModel, str(out), "r1")
    assert not list(out.rglob("*.parquet"))


def test_quarantine_scores_the_good_rows(spark, tmp_path):
    rows = text_rows(10)
    rows[2]["ORIGIN"] = " "
    rows[7]["FL_DATE"] = "never"
    path = write_csv(tmp_path / "in.csv", rows)
    out = str(tmp_path / "out")
    assert score_file(spark, path, DistanceModel, out, "r1", strict=False) == 8
    assert published(spark, out, "scored").count() == 8
    bad = {r["ARR_DELAY"]: r["broken_rules"] for r in published(spark, out, "quarantine").collect()}
    assert bad == {"2": "ORIGIN_blank", "7": "FL_DATE_date"}


def test_csv_export_keeps_order_and_text(spark, tmp_path):
    rows = text_rows(30)
    rows[3]["DEST"] = ""
    path = write_csv(tmp_path / "in.csv", rows)
    scan = with_scan_position(files.read_text(spark, path))
    indexed = with_row_index(scan, block_offsets(scan)).repartition(5)
    folder = tmp_path / "export"
    sinks.export_csv(indexed, str(folder), order="row_index")
    lines = []
    for part in sorted(folder.glob("part-*.csv")):
        lines += part.read_text().splitlines()[1:]
    assert lines == (tmp_path / "in.csv").read_text().splitlines()[1:]


def test_loading_scored_files(spark, tmp_path):
    names = ["FL_DATE", "OP_UNIQUE_CARRIER", PREDICTION, "OTHER"]
    rows = [
        {"FL_DATE": "2026-09-01", "OP_UNIQUE_CARRIER": "AA", PREDICTION: "1.5"},
        {"FL_DATE": "9/2/2026 12:00:00 AM", "OP_UNIQUE_CARRIER": "AA", PREDICTION: "2"},
        {"FL_DATE": "bad", "OP_UNIQUE_CARRIER": "DL", PREDICTION: "3"},
        {"FL_DATE": "2026-09-03", "OP_UNIQUE_CARRIER": "DL", PREDICTION: "inf"},
        {"FL_DATE": "2026-09-03", "OP_UNIQUE_CARRIER": "DL", PREDICTION: "x"},
    ]
    loaded = files.read_predictions(spark, write_csv(tmp_path / "p.csv", rows, names))
    assert loaded.frame.columns == ["FL_DATE", "OP_UNIQUE_CARRIER", PREDICTION]
    assert (loaded.file_rows, loaded.frame.count()) == (5, 3)
    assert loaded.notes == [
        "2 row(s) with an invalid predicted_arr_delay value were ignored.",
        "1 row(s) have a missing or invalid FL_DATE; they are left out of the time analysis and the date filter.",
    ]


@pytest.mark.parametrize(
    "text, message",
    [
        ("", "is empty"),
        ("a,b\n1,2\n", "has no 'predicted_arr_delay' column"),
        (f"{PREDICTION}\n", "contains no rows"),
        (f"{PREDICTION}\nx\n", "no valid predictions"),
    ],
)
def test_scored_file_errors(spark, tmp_path, text, message):
    path = tmp_path / "p.csv"
    path.write_text(text)
    with pytest.raises(InputError, match=message):
        files.read_predictions(spark, str(path))
    with pytest.raises(InputError, match="not found"):
        files.read_predictions(spark, str(tmp_path / "none.csv"))


def test_typed_predictions(spark):
    frame = files.load_predictions(spark.createDataFrame(SCORED, SCORED_SCHEMA)).frame
    assert frame.count() == 8 and dict(frame.dtypes)["FL_DATE"] == "date"


def test_months_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,ARR_DELAY,ORIGIN\n2025,1.5,A\n2025,,B\n")
    (tmp_path / "b.csv").write_text('NOTE,ORIGIN,YEAR,ARR_DELAY\n"x,\n""y""",C,2026,-2\n')
    rows = {r["ORIGIN"]: r for r in files.read_records(spark, str(tmp_path)).collect()}
    assert {k: (r["YEAR"], r["ARR_DELAY"], r["NOTE"]) for k, r in rows.items()} == {
        "A": (2025, 1.5, None), "B": (2025, None, None), "C": (2026, -2.0, 'x,\n"y"'),
    }


def test_cells_of_another_type_are_not_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,ARR_DELAY\n2025,abc\n2026.0,1\n2027,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, str(tmp_path)).collect()
    rows = files.read_records(spark, str(tmp_path), corrupt="unread").collect()
    assert sorted((r["YEAR"] or 0, r["unread"] or "") for r in rows) == [(0, "2026.0,1"), (2025, "2025,abc"), (2027, "")]


def test_line_breaks_in_cells(spark, tmp_path):
    rows = text_rows(4)
    path = tmp_path / "in.csv"
    names = [*TEXT_COLUMNS, "NOTE"]
    lines = [",".join(names)] + [",".join([*(r[c] for c in TEXT_COLUMNS), '"a\nb, ""c"""']) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    assert files.count_rows(spark, str(path)) == 4
    assert {r["NOTE"] for r in files.read_text(spark, str(path)).collect()} == {'a\nb, "c"'}
    rows[2]["DISTANCE"] = "x"
    lines[3] = ",".join([*(rows[2][c] for c in TEXT_COLUMNS), '"a\nb"'])
    path.write_text("\n".join(lines) + "\n")
    with pytest.raises(InputError, match=r"\(row 4\)"):
        score_file(spark, str(path), DistanceModel, str(tmp_path / "out"), "r1")


def test_a_folder_is_scored(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(2):
        write_csv(folder / f"{i}.csv", text_rows(5))
    assert score_file(spark, str(folder), DistanceModel, str(tmp_path / "out"), "r1") == 10


def test_white_space_is_no_text(spark):
    from pyspark.sql import functions as F

    from latewing.operators.quality import text_rules

    rows = spark.createDataFrame([("\t",), ("  ",), ("",), (None,), (" a",)], "ORIGIN string")
    broken = rows.select(F.coalesce(text_rules(["ORIGIN"])[0].broken, F.lit(False)).alias("b")).collect()
    assert [r["b"] for r in broken] == [True, True, True, True, False]


def test_only_files_with_line_breaks_are_read_unsplit(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("\n  \nORIGIN,DEST\nX,Y\n" * 1 + "Z,W\n" * 50)
    (tmp_path / "c.csv").write_text('ORIGIN,DEST\n"X\nX",Y\n')
    (tmp_path / "d.csv").write_text("DEST,ORIGIN\nY,V\n")
    (tmp_path / "empty.csv").write_text("")
    found = files.csv_files(spark, f"{tmp_path}/*.csv")
    heads = {r["file_path"].rsplit("/", 1)[-1]: r for r in files.file_heads(spark, list(found.values())).collect()}
    assert {n: (r["head"], r["breaks"]) for n, r in heads.items()} == {
        "a%20b.csv": ("ORIGIN,DEST", False), "c.csv": ("ORIGIN,DEST", True), "d.csv": ("DEST,ORIGIN", False)}
    rows = files.read_records(spark, str(tmp_path)).groupBy("ORIGIN", "DEST").count().collect()
    assert {tuple(r) for r in rows} == {("X", "Y", 1), ("Z", "W", 50), ("X\nX", "Y", 1), ("V", "Y", 1)}
    plan = files.file_heads(spark, list(found.values()))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
