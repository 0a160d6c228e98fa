"""Files in, reports out."""

import json
import os
from dataclasses import replace

import pytest

from plumbline import Catalog, Dataset, ProfileConfig, run
from plumbline.sinks import reports
from plumbline.sources import files, grids

EXACT = ProfileConfig(unique_mode="exact")
MESSY = ''',,
   , ,

 id ,name,,name,name__1
1,"Smith, J",x,,5,extra
2,"say ""hi""",y
'''


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.CSV").write_text("k,v,when\n1,x,2020-01-01\n2,,2021-05-05\n2,,2021-05-05\n")
    (tmp_path / "deep" / "b.csv").write_text("n\n" + "\n".join(map(str, range(60))) + "\n")
    (tmp_path / "deep" / "er" / "notes.txt").write_text("no data")
    return tmp_path


def test_discover(spark, folder):
    found = files.discover(spark, [str(folder), str(folder / "missing"), str(folder / "deep" / "b.csv")])
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["a.CSV", "b.csv"]
    assert found.where("length > 0").count() == 2


def test_open_and_profile(spark, folder, tmp_path_factory):
    found = files.discover(spark, [str(folder)])
    datasets, notes = files.open_datasets(spark, found, EXACT)
    assert notes == [] and [d.name for d in datasets] == ["a", "b"]
    assert dict(datasets[0].df.dtypes)["when"] == "date"
    out = str(tmp_path_factory.mktemp("out"))
    catalog = Catalog(spark, datasets, EXACT, found.count())
    written = reports.write_catalog(catalog, out)
    failed = [r["note"] for r in written.collect() if "failed" in r["note"]]
    assert failed == []
    made = sorted(os.listdir(out))
    assert len(made) == 3 and "_total" in made
    first = [m for m in made if "__a__sheet-None" in m][0]
    over = spark.read.option("header", True).csv(f"{out}/{first}/overview").head()
    assert (over["rows"], over["duplicate_rows"]) == ("3", "2")
    document = json.loads("".join(r[0] for r in spark.read.text(f"{out}/_total/master_summary").collect()))
    assert document["totals"] == {"files_found": 2, "datasets_processed": 2, "datasets_failed": 0, "total_rows": 63, "total_columns": 4}
    assert [d["dataset_name"] for d in document["datasets"]] == ["b", "a"]
    assert [w["rule"] for w in document["quality_warnings"]] == ["duplicate_rows"]


def test_run(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    assert run(spark, [str(folder / "deep")], out, EXACT, "parquet") == {
        "files_found": 1, "datasets_processed": 1, "datasets_failed": 0, "total_rows": 60, "total_columns": 1}
    assert spark.read.parquet(f"{out}/_total/totals").head()["total_rows"] == 60


def test_failed_report_is_a_note(spark, tmp_path):
    notes = reports.write_reports({"bad": spark.range(1).selectExpr("raise_error('no') as x"),
                                   "good": spark.range(1).toDF("x")}, str(tmp_path))
    assert len(notes) == 1 and notes[0].startswith("Report 'bad' failed")
    assert spark.read.option("header", True).csv(f"{tmp_path}/good").count() == 1


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_formats(spark, tmp_path, fmt):
    reports.write_report(spark.createDataFrame([(1, ["a"])], "n int, l array<string>"), f"{tmp_path}/r", fmt)
    assert spark.read.format(fmt).load(f"{tmp_path}/r").head()["l"] == ["a"]


def test_messy_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSY)
    grid = files.csv_grid(spark, str(tmp_path / "m.csv"))
    datasets, _ = files.grid_datasets(grid)
    df = datasets[0].df
    assert df.columns == ["id", "name", "col_3", "name__1", "name__1__1"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "col_3": "string", "name__1": "string",
                               "name__1__1": "bigint"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Smith, J", "x", None, 5), (2, 'say "hi"', "y", None, None)]


def grid_of(spark, sheets):
    rows = [("w.xlsx", name, i, [None if c is None else str(c) for c in cells])
            for name, table in sheets.items() for i, cells in enumerate(table)]
    return spark.createDataFrame(rows, "path string, sheet string, row_no bigint, cells array<string>").repartition(3)


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,t\n1,"say ""x, y"" z"\n2,plain\n')
    df = files.read_csv(spark, str(tmp_path / "q.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'say "x, y" z'), (2, "plain")]
    (tmp_path / "b.csv").write_text('id,t\n1,"two\nlines"\n2,plain\n')
    with pytest.raises(ValueError, match="multiline"):
        files.read_csv(spark, str(tmp_path / "b.csv"))
    df = files.read_csv(spark, str(tmp_path / "b.csv"), multiline=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "two\nlines"), (2, "plain")]
    datasets, notes = files.open_datasets(spark, files.discover(spark, [str(tmp_path)]), EXACT)
    assert [d.df.count() for d in datasets] == [2, 2] and len(notes) == 1


def test_headers_without_collisions(spark):
    cells = ["a", "a", "a__1", "a__1__1", "ID", "id", "Id", "", "col_8"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(cells)], "k int, pos int, cell string")
    names = [r["name"] for r in grids.repaired_names(df, ["k"]).orderBy("pos").collect()]
    assert names == ["a", "a__1", "a__1__1", "a__1__1__1", "ID", "id__1", "Id__2", "col_8", "col_8__1"]
    assert len({n.lower() for n in names}) == len(names)


def test_failed_table_stays(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    lost = spark.read.parquet(str(tmp_path / "t"))
    for f in (tmp_path / "t").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    for sample in (None, 3):
        c = Catalog(spark, [Dataset("bad", lost, "x"), Dataset("good", spark.range(7).toDF("v"), "y")],
                    replace(EXACT, sample_rows=sample))
        got = {r["dataset_name"]: r for r in c.datasets_index.collect()}
        assert got["good"]["status"] == "ok" and got["good"]["rows"] == 7
        assert got["bad"]["status"].startswith("failed: ") and got["bad"]["columns"] is None
        assert tuple(c.totals.head())[1:] == (1, 1, 7, 1)
        assert [r for r in c.warnings.collect() if r["dataset_name"] == "bad"] == []


def test_sheets(spark):
    grid = grid_of(spark, {
        "one": [(None, " "), ("a", "b"), (1, True), (2, False), (3, None)],
        "head": [("only", "header")], "blank": [(None,), ("  ",)]})
    datasets, notes = files.grid_datasets(grid, max_rows=2)
    got = {d.sheet: d.df for d in datasets}
    assert got["one"].dtypes == [("a", "bigint"), ("b", "boolean")] and got["one"].count() == 2
    assert notes == ["w (sheet one) is cut at 2 rows."]
    assert got["head"].columns == ["only", "header"] and got["head"].count() == 0
    assert got["blank"].columns == []
    _, exact = files.grid_datasets(grid, max_rows=3)
    assert exact == []
    c = Catalog(spark, datasets, EXACT)
    assert c.datasets_index.count() == 3 and c.ids.select("dataset_id").distinct().count() == 3


@pytest.mark.parametrize("texts, kind", [
    (["1", "-2"], "bigint"), (["1", "2.5", ".5", "1e3"], "double"), (["true", "False"], "boolean"),
    (["2020-01-01", "2020-01-01 10:00:00.5"], "timestamp_ntz"), (["2020-13-01"], "string"),
    (["1", "x"], "string"), ([None], "string"), (["12f"], "string"), (["9999999999999999999"], "double")])
def test_types(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "c string")
    assert grids.column_types(df).head()["type"] == kind
    assert grids.typed(df).where("c is not null").count() == sum(t is not None for t in texts)


def test_inventories(spark, tmp_path):
    spark.range(0, 30, 1, 3).write.parquet(f"{tmp_path}/t")
    got = files.file_inventory(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert [r["rows"] for r in got] == [10, 10, 10] and all(r["bytes"] > 0 for r in got)
    df = spark.createDataFrame([('{"a": [1, 2], "b": {"c": []}}',), ("[1, 2, 3]",), ("oops",), (None,)], "j string")
    assert [(r["json_keys"], r["json_items"]) for r in files.json_inventory(df, "j").collect()] == [
        (2, 2), (0, 3), (0, 0), (0, 0)]


def test_staged_reads_columns(spark, folder):
    df = files.staged(files.read_csv(spark, str(folder / "a.CSV")))
    assert "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_dataset_has_path_and_sheet(spark):
    c = Catalog(spark, [Dataset("Mein Bücher-Heft!", spark.range(1), "p", "Blatt 1")], EXACT)
    assert c.ids.head()["dataset_dir"].endswith("__Mein_Bücher-Heft__Blatt_1")


def test_tables_of_folders(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 as a", "id % 3 as b").repartition(3).write.partitionBy("a", "b").parquet(f"{tmp_path}/lake/t")
    spark.range(10).repartition(2).write.json(f"{tmp_path}/lake/u")
    (tmp_path / "lake" / "one.csv").write_text("x\n1\n")
    (tmp_path / "lake" / "two.csv").write_text("y\n1\n2\n")
    found = files.discover(spark, [str(tmp_path)])
    got = {r["name"]: (r["format"], r["files"] > 1, r["partition_columns"]) for r in files.tables(found).collect()}
    assert got == {"t": ("parquet", True, ["a", "b"]), "u": ("json", True, []), "one": ("csv", False, []), "two": ("csv", False, [])}
    datasets, notes = files.open_datasets(spark, found, EXACT)
    assert notes == [] and {d.name: (d.df.count(), len(d.df.columns)) for d in datasets} == {"t": (10, 3), "u": (10, 1), "one": (1, 1), "two": (2, 1)}
