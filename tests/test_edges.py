"""Small tables with the awkward values."""

import datetime as dt
import hashlib
import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline import Catalog, Dataset, ProfileConfig, TableProfile, profile
from plumbline.operators import (
    categorical, correlation, distinct, frequent, lists, numeric, overview, sampling, schema, temporal, text,
    uniqueness,
)
from plumbline.plans.profile import REPORTS

EXACT = ProfileConfig(unique_mode="exact")


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_column(df):
    return {r["column"]: r for r in rows(df)}


@pytest.fixture(scope="module")
def odd(spark):
    """Names to quote, NaN, negative zero, nulls, blanks."""
    return spark.createDataFrame(
        [(1, 0.0, " ", "<NULL>", True, None, "a"), (2, -0.0, "", None, None, None, "a"),
         (3, math.nan, " \t", "é\U0001f600", False, None, "a"), (4, None, None, "x", True, None, None)],
        "`a.b` int, `c d` double, `e``f` string, label string, flag boolean, nothing string, `once` string")


def test_reports_on_odd_values(odd):
    table = TableProfile(odd, EXACT)
    for name in REPORTS:
        getattr(table, name).collect()


@pytest.mark.parametrize("columns", ["id bigint, x double, s string, d date", "s string", "x int"])
def test_reports_on_no_rows(spark, columns):
    table = TableProfile(spark.createDataFrame([], columns), EXACT)
    for name in REPORTS:
        getattr(table, name).collect()


def test_reports_on_no_columns(spark):
    made, notes = profile(spark.range(3).select(), EXACT)
    assert rows(made["overview"])[0]["columns"] == 0
    assert made["schema"].collect() == [] and made["row_missingness"].collect() == []


@pytest.mark.parametrize("mode", ["exact", "approx", "sample"])
def test_schema(odd, mode):
    got = by_column(schema.schema_profile(odd, replace(EXACT, unique_mode=mode)))
    assert got["a.b"]["unique"] == 4 and got["nothing"] == {
        "column": "nothing", "dtype": "string", "non_null": 0, "null": 4, "null_pct": 100.0, "unique": 1}
    assert got["c d"]["unique"] == 3  # one zero, NaN and null
    assert got["once"]["unique"] == 2


def test_types_are_classified_by_class(spark):
    df = spark.createDataFrame([([1], {"a": 1.5}, dt.timedelta(1), b"x", dt.date(2020, 1, 2))],
                               "a array<int>, m map<string,double>, i interval day, b binary, d date")
    got = by_column(schema.schema_profile(df, EXACT))
    assert {r["unique"] for r in got.values()} == {1}
    assert rows(TableProfile(df, EXACT).numeric_summary) == []
    assert overview.duplicate_rows(df.union(df), EXACT).head().asDict()["duplicate_rows"] == 2


def test_nan_is_a_value_but_no_number(odd):
    got = by_column(numeric.numeric_summary(odd, EXACT))["c d"]
    assert got["count"] == 3 and got["max"] == 0.0 and got["50%"] == 0.0
    shape = by_column(numeric.distribution_shape(odd, EXACT))
    assert shape["c d"]["zero_pct"] == pytest.approx(200 / 3)


def test_text_blanks(odd):
    got = by_column(text.text_profile(odd, EXACT))
    assert got["e`f"]["empty_string"] == 1 and got["e`f"]["whitespace_only"] == 3
    assert got["label"]["max_len"] == 6 and got["nothing"]["avg_len"] is None


def test_categories(odd):
    got = {(r["column"], r["value"]): r["count"] for r in rows(categorical.categorical_topk(odd, EXACT))}
    assert got["label", "<NULL>"] == 2  # the text and the missing value meet, by definition
    assert got["e`f", ""] == 3 and got["flag", "true"] == 2 and got["nothing", "<NULL>"] == 4


@pytest.mark.parametrize("values, constant, ratio", [
    ([.1] * 50, True, 0.02), ([7.0, None], False, 2.0), ([None, None], True, 0.0), ([1.0], True, 1.0)])
def test_constant(spark, values, constant, ratio):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = rows(numeric.distribution_shape(df, EXACT))[0]
    assert got["is_constant"] is constant and got["unique_ratio"] == ratio
    assert got["approx_skew"] in (0.0, None)


def test_one_row(spark):
    got = rows(numeric.numeric_summary(spark.createDataFrame([(5,)], "x int"), EXACT))[0]
    assert got["std"] is None and got["25%"] == got["75%"] == 5.0


@pytest.mark.parametrize("cols", [2, 7])
def test_correlation(spark, cols):
    """Nulls on either side and a constant."""
    import numpy as np
    rng = np.random.default_rng(1)
    data = rng.normal(1e6, 1.0, (300, cols))
    data[:, 1] = data[:, 0] * 2 + rng.normal(0, .1, 300)
    if cols > 2:
        data[:, 2] = 0.1
    table = [[None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(row)] for i, row in enumerate(data)]
    df = spark.createDataFrame(table, ", ".join(f"c{j} double" for j in range(cols))).repartition(5)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in rows(correlation.correlations(df, EXACT))}
    assert len(got) == cols * cols
    for a in range(cols):
        for b in range(cols):
            keep = [i for i in range(300) if table[i][a] is not None and table[i][b] is not None]
            if 2 in (a, b):  # the constant
                assert got[f"c{a}", f"c{b}"] is None
            else:
                want = np.corrcoef(data[keep, a], data[keep, b])[0, 1]
                assert got[f"c{a}", f"c{b}"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("cols", [3, 8])
def test_infinities_touch_their_pairs_only(spark, cols):
    """The infinity of the last column is in a row where column 0 is null."""
    import numpy as np
    data = np.random.default_rng(2).normal(0, 1, (60, cols)).tolist()
    data[7][0], data[7][-1] = None, float("inf")
    df = spark.createDataFrame(data, ", ".join(f"c{j} double" for j in range(cols))).repartition(3)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in rows(correlation.correlations(df, EXACT))}
    keep = [i for i in range(60) if i != 7]
    a, b = ([data[i][j] for i in keep] for j in (0, cols - 1))
    assert got["c0", f"c{cols - 1}"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    assert got["c1", f"c{cols - 1}"] is None and got["c0", "c1"] is not None


def test_correlation_guard(spark):
    df = spark.range(3).selectExpr(*[f"id as c{i}" for i in range(81)])
    assert correlation.correlations(df, EXACT).count() == 81 * 81 and correlation.correlation_note(df, EXACT) is None
    capped = replace(EXACT, max_corr_cols=80)
    assert correlation.correlations(df, capped).collect() == []
    assert correlation.correlation_note(df, capped) == \
        "Skipped correlation: 81 numeric columns exceeds limit (80)."


def test_one_long_cell_keeps_a_list(spark):
    df = spark.range(100).selectExpr("case when id = 0 then repeat('long;', 200) else concat('a;', id % 3) end as t")
    assert [r["column"] for r in lists.list_columns(df, EXACT).collect()] == ["t"]
    prose = spark.range(100).selectExpr("case when id < 11 then repeat('long;', 200) else 'a;b' end as t")
    assert lists.list_columns(prose, EXACT).collect() == []


def test_tokens_with_equal_beginnings(spark):
    df = spark.range(60).selectExpr("concat(repeat('x', 125), id % 2, ';y') as t")
    got = lists.list_tokens(df, EXACT).collect()
    assert sorted(r["count"] for r in got) == [30, 30, 60]


def test_all_sparse_columns_are_reported(spark):
    df = spark.range(100).selectExpr(*[f"case when id = {i} then id end as c{i}" for i in range(25)])
    c = Catalog(spark, [Dataset("sparse", df, "p")], EXACT)
    assert c.high_missing_columns.count() == 25
    assert c.warnings.where("rule = 'column_missing'").count() == 25
    assert len(c.hotspot_matrix().columns) == 28 and c.hotspot_cells().count() == 25


@pytest.mark.parametrize("n", [1, 7, 500])
def test_draws_agree(spark, n):
    df = spark.range(0, 1000, 1, 7).selectExpr("id % 700 as a", "concat('v', id % 700) as b")
    drawn = sampling.random_rows(df, n, 3)
    first = sorted(map(tuple, drawn.collect()))
    assert len(first) == n and sorted(map(tuple, drawn.collect())) == first
    assert n < 500 or drawn.rdd.getNumPartitions() > 1


def test_many_quantiles_in_few_jobs(spark):
    from plumbline.functions.ranks import values_at_ranks
    df = spark.range(0, 3000, 1, 4).selectExpr(*[f"cast((id * {2 * i + 1}) % 3001 as double) as c{i}" for i in range(12)])
    wanted = {f"c{i}": (3000, {"lo": 30, "mid": 1500}) for i in range(12)}
    got = {(r["column"], r["label"]): r["value"] for r in values_at_ranks(
        df, {f"c{i}": f"c{i}" for i in range(12)}, wanted, replace(EXACT, rank_group_rows=100, rank_sketch_k=256)).collect()}
    for i in range(12):
        own = sorted(float(k * (2 * i + 1) % 3001) for k in range(3000))
        assert got[f"c{i}", "lo"] == own[30] and got[f"c{i}", "mid"] == own[1500]


@pytest.mark.parametrize("share, found", [(200, True), (199, False)])
def test_list_threshold(spark, share, found):
    df = spark.createDataFrame([("a|b" if i < share else "c",) for i in range(1000)] + [(None,)] * 500, "s string")
    got = rows(lists.list_columns(df, EXACT))
    assert [r["separator"] for r in got] == (["|"] if found else [])


@pytest.mark.parametrize("length, found", [(500, True), (501, False)])
def test_list_length_gate(spark, length, found):
    df = spark.createDataFrame([("a;b",), (";" * length,)], "s string")
    assert bool(rows(lists.list_columns(df, EXACT))) is found


def test_list_items_of_regex_separators(spark):
    df = spark.createDataFrame([("a| b |c",), ("",), (None,), ("|",)], "s string")
    assert rows(lists.list_profile(df, EXACT)) == [{
        "column": "s", "separator": "|", "rows_with_separator_pct": pytest.approx(200 / 3),
        "avg_items": 2.0, "p50_items": 2, "p90_items": 3, "max_items": 3}]
    assert [(r["token"], r["count"]) for r in rows(lists.list_tokens(df, EXACT))] == [("a", 1), ("b", 1), ("c", 1)]


def test_ties_break_by_value(spark):
    df = spark.createDataFrame([(f"v{i:02}",) for i in range(30)] * 2, "s string").repartition(7)
    got = [r["value"] for r in rows(categorical.categorical_topk(df, EXACT))]
    assert got == [f"v{i:02}" for i in range(20)]


@pytest.mark.parametrize("held, found", [(50, True), (49, False)])
def test_key_threshold(spark, held, found):
    df = spark.createDataFrame([(i,) for i in range(held)], "n int")
    assert bool(rows(uniqueness.key_candidates(df, EXACT))) is found


def test_key_names_and_limit(spark):
    names = ["x", "user_id", "doi", "b_id", "a_id", "my isbn", "zguid"]
    df = spark.createDataFrame([tuple([1] * 7)] * 20, ", ".join(f"`{n}` int" for n in names))
    got = [r["column"] for r in rows(uniqueness.key_candidates(df, replace(EXACT, key_limit=5)))]
    assert got == ["user_id", "doi", "b_id", "a_id", "my isbn"]
    assert [r["column"] for r in rows(uniqueness.key_candidates(df, EXACT))] == [*got, "zguid"]
    assert rows(uniqueness.key_duplicates(df, EXACT))[0]["rows_in_repeated_keys"] == 20


def test_keys_need_ten_values(spark):
    df = spark.createDataFrame([(i if i < 9 else None,) for i in range(40)], "my_id int")
    assert rows(uniqueness.key_duplicates(df, EXACT)) == []


def test_years(spark):
    df = spark.createDataFrame(
        [("in 1066, 1999 and 2005", dt.date(1850, 1, 1), 1), (None, dt.date(2031, 5, 5), 20201231)],
        "created string, start_date date, year int")
    got = by_column(temporal.temporal_coverage(df, EXACT))
    assert (got["created"]["min_year"], got["created"]["year_hits"]) == (1999, 1)
    assert (got["start_date"]["max_year"], got["start_date"]["year_hits"]) == (2031, 1)
    assert got["year"]["min_year"] == 2020


def test_duplicates_of_wide_rows(spark):
    base = spark.range(500).selectExpr("id", "repeat('long text ', 20) as t", "cast(0.0 as double) as z")
    copies = spark.range(3).selectExpr("7L as id", "repeat('long text ', 20) as t", "cast(-0.0 as double) as z")
    df = base.unionByName(copies).repartition(6)
    got = overview.duplicate_rows(df, EXACT).head()
    assert (got["rows"], got["duplicate_rows"]) == (503, 4)


def test_duplicates_where_nulls_move(spark):
    df = spark.createDataFrame([(None, "a", "b"), ("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert overview.duplicate_rows(df, EXACT).head()["duplicate_rows"] == 0
    assert overview.duplicate_rows(df.union(df.limit(1)), EXACT).head()["duplicate_rows"] == 2


@pytest.mark.parametrize("limit", [3, 20, 10_000])
def test_quantiles_by_any_route(spark, limit):
    """Heavy ties, infinities, negatives: against a sort in Python, narrowing or not."""
    import random
    rng = random.Random(3)
    values = {
        "ties": [rng.choice([0.0, 0.0, 0.0, 1.0, 5.5]) for _ in range(999)],
        "two": [0.0] * 500 + [1.0] * 499,
        "wild": [rng.gauss(0, 1) ** 9 for _ in range(997)] + [math.inf, -math.inf],
        "holes": [rng.randint(-5, 900) if rng.random() < .4 else None for _ in range(999)],
    }
    df = spark.createDataFrame(list(zip(*values.values())), ", ".join(
        f"{n} {'int' if n == 'holes' else 'double'}" for n in values)).repartition(4)
    got = by_column(numeric.column_quantiles(df, replace(EXACT, rank_group_rows=limit, rank_sketch_k=32)))
    for name, column in values.items():
        held = sorted(v for v in column if v is not None)
        n = len(held)
        for label, q in numeric.QUARTILES.items():
            assert got[name][label] == held[int((n - 1) * q + .5)], (name, label)
        assert got[name]["median"] == (held[(n - 1) // 2] + held[n // 2]) / 2


def test_histogram_adds_up(spark):
    df = spark.createDataFrame([(float(i % 13), 4) for i in range(100)] + [(None, 4)], "x double, flat int")
    got = rows(numeric.numeric_histogram(df, EXACT, bins=5))
    assert sum(r["count"] for r in got if r["column"] == "x") == 100
    assert [r["count"] for r in got if r["column"] == "flat"] == [101, 0, 0, 0, 0]


@pytest.mark.parametrize("report", ["schema", "numeric_summary", "categorical_summary", "list_tokens",
                                    "key_duplicates", "row_missingness", "correlations"])
def test_partitions_do_not_matter(spark, sf_dir, report):
    from checks.data import table
    from checks.queries import rounded
    df = table(spark, sf_dir, "dirty_orders")
    one, many = (rows(rounded(getattr(TableProfile(df.repartition(n), EXACT), report), 4)) for n in (1, 9))
    assert one == many


def test_random_rows(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = sampling.random_rows(df, 300, 1, ["k"]).collect()
    assert len(a) == 300 == len(set(a)) and set(a) == set(sampling.random_rows(df.repartition(9), 300, 1, ["k"]).collect())
    assert set(a) != set(sampling.random_rows(df, 300, 2, ["k"]).collect())
    assert sampling.random_rows(df, 300, 1).count() == 300
    assert sampling.random_rows(df, 30_000, 1).count() == 20_000
    hot = df.selectExpr("k % 2 as k")  # a key that is none still yields the asked number
    assert sampling.random_rows(hot, 300, 1, ["k"]).count() == 300


def test_draw_narrows_the_edge(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DIGITS", 1)
    monkeypatch.setattr(sampling, "EDGE", 3)
    df = spark.range(3000).withColumnRenamed("id", "k")
    ranked = sorted(range(3000), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
    for n in (0, 1, 2, 999, 2999, 3000):
        rows, total = sampling.draw(df, n, 7, ["k"])
        assert total == 3000 and sorted(r.k for r in rows.collect()) == sorted(ranked[:n])


def test_head_opens_few_files(spark, tmp_path):
    spark.range(0, 1000, 1, 10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    head = sampling.head_rows(df, 150)
    assert head.count() == 150
    assert len(sampling._first_files(df, 150).inputFiles()) == 10  # the scan is filtered by file, not cut
    assert sampling._first_files(df, 150).select("_metadata.file_path").distinct().count() == 2
    assert sampling.head_rows(df.selectExpr("id + 1 as x"), 150).count() == 150


def test_sampled_profile(spark):
    cfg = replace(EXACT, sample_rows=40, sample_strategy="random")
    table = TableProfile(spark.range(100), cfg)
    got = rows(table.overview)[0]
    assert (got["rows"], got["rows_sample"], got["sampled"]) == (100, 40, True)
    assert table.notes()[0] == "Profiled on a sample of 40 rows (of 100 total) using strategy=random."
    assert rows(TableProfile(spark.range(100), replace(cfg, sample_rows=0)).overview)[0]["sampled"] is False


def test_approx_counts_have_no_bias_from_partitions(spark):
    df = spark.range(50_000).selectExpr("id", "cast(id % 1000 as string) as s").repartition(40)
    got = {r["column"]: r["unique_non_null"] for r in rows(distinct.approx_distinct(df, EXACT))}
    assert abs(got["id"] / 50_000 - 1) < .03 and abs(got["s"] / 1000 - 1) < .03


def test_catalog_survives_a_bad_table(spark):
    bad = spark.range(5).selectExpr("raise_error('broken file') as x", "id")
    empty = spark.createDataFrame([], "x int")
    c = Catalog(spark, [Dataset("good", spark.range(60), "p/good"), Dataset("bad", bad, "p/bad", "S 1"),
                        Dataset("empty", empty, "p/empty")], EXACT)
    assert [r["dataset_name"] for r in rows(c.sources_table)] == ["good", "empty", "bad"]
    assert {r["dataset_name"]: r["status"].split(":")[0] for r in rows(c.sources_table)} == {"good": "ok", "empty": "ok", "bad": "failed"}
    assert any("broken file" in note for _, note in c.notes)
    assert ("empty", "empty_dataset") in [(r["dataset_name"], r["rule"]) for r in rows(c.warnings)]
    assert c.hotspot_matrix().count() == 0 and c.hotspot_matrix(["id"]).count() == 0


def test_hotspots_of_equal_names(spark):
    """Two sheets of one name stay apart."""
    one, other = spark.createDataFrame([(None, 1), (2, 1)], "a int, b int"), spark.createDataFrame([(None, None)], "a int, b int")
    c = Catalog(spark, [Dataset("t", one, "p", "S1"), Dataset("t", other, "p", "S2")], EXACT)
    cells = {(r["sheet_name"], r["column"]): r["share"] for r in rows(c.hotspot_cells())}
    assert cells == {("S1", "a"): 0.5, ("S2", "a"): 1.0, ("S2", "b"): 1.0}
    grid = {r["sheet_name"]: (r["a"], r["b"]) for r in rows(c.hotspot_matrix())}
    assert grid == {"S1": (0.5, 0.0), "S2": (1.0, 1.0)}


def test_empty_catalog(spark):
    c = Catalog(spark, [], EXACT)
    assert rows(c.totals) == [{"files_found": 0, "datasets_processed": 0, "datasets_failed": 0, "total_rows": 0, "total_columns": 0}]
    assert c.sources_table.collect() == [] and c.warnings.collect() == []


# --- frequent values --------------------------------------------------------------------------------

def top_of(values, k):
    return sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("items, k", [(12_288, 5), (48, 3), (48, 5), (48, 40), (48, 100), (6, 2)])
def test_top_values(spark, items, k):
    """Skewed, few and nearly unique values, by summaries of any size: always the exact ranking."""
    rng = random.Random(4)
    data = [(f"s{min(int(rng.paretovariate(0.7)), 3000)}", f"f{rng.randrange(7)}", f"u{i}", None) for i in range(6000)]
    df = spark.createDataFrame(data, "skewed string, few string, unique string, nothing string").repartition(6)
    cells = [{"field": c, "value": c} for c in df.columns]
    got = frequent.top_values(df, cells, k, replace(EXACT, frequent_items=items))
    for i, c in enumerate(df.columns):
        own = sorted((r["place"], r["value"], r["n"]) for r in got.where(f"field = '{c}'").collect())
        assert own == [(j, v, n) for j, (v, n) in enumerate(top_of([r[i] for r in data if r[i] is not None], k), 1)]


def test_summaries_settle_without_a_full_count(spark):
    """A few values of many rows among many rare ones: the summary settles them, and no full count is planned."""
    df = spark.range(0, 40_000, 1, 4).selectExpr("case when id % 4 = 0 then concat('hot', id % 3) else concat('v', id) end as v")
    frames, rest = frequent._settled(df, [{"field": "v", "value": "v"}], 3, replace(EXACT, frequent_items=96), frequent.value_rows, "value is not null")
    assert rest == [] and sorted((r["value"], r["n"]) for r in frames[0].where("n > 100").collect()) == [("hot0", 3334), ("hot1", 3333), ("hot2", 3333)]
    frames, rest = frequent._settled(df, [{"field": "v", "value": "v"}], 4, replace(EXACT, frequent_items=96), frequent.value_rows, "value is not null")
    assert frames == [] and len(rest) == 1  # the fourth is one of many


# --- distinct values as bitmaps ---------------------------------------------------------------------

def test_distinct_by_words(spark):
    nan, big = float("nan"), 2**63 - 1
    data = [
        (0, 0.0, 0.1, dt.date(1969, 12, 31), True), (-1, -0.0, 0.1 + 0.2, dt.date(1970, 1, 1), True), (63, 0.01, 0.3, dt.date(1970, 1, 1), None),
        (64, 1e300, -0.3, None, None), (big, -1e300, 1e15 + 0.5, None, None), (-big - 1, nan, 0.299999, None, None), (64, nan, float("inf"), None, None),
        (None, None, float("-inf"), None, None), (-64, 0.01, None, None, None),
    ]
    df = spark.createDataFrame(data, "i bigint, a double, b double, d date, t boolean").repartition(3)
    assert {r["column"]: r["unique_non_null"] for r in rows(distinct.exact_distinct(df))} == {"i": 7, "a": 5, "b": 8, "d": 2, "t": 1}
    assert {r["column"]: r["unique_non_null"] for r in rows(distinct.exact_distinct(spark.range(100_000).selectExpr("id - 50000 as i", "id / 100D as a", "cast(id as float) / 3 as f")))} == {
        "i": 100_000, "a": 100_000, "f": 100_000}


def test_dense_keys_move_as_bitmaps(spark):
    plan = distinct.exact_distinct(spark.range(10_000))
    words = plan._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in words


# --- quantiles --------------------------------------------------------------------------------------

@pytest.mark.parametrize("group", [50, 400, 10**6])
def test_quantiles_of_awkward_columns(spark, group):
    """Ties, infinities, tiny and huge values, one value only; every tenth rank."""
    from plumbline.functions.ranks import values_at_ranks
    rng = random.Random(9)
    inf = math.inf
    columns = {
        "ties": [float(rng.randrange(3)) for _ in range(3000)], "ends": [rng.choice([-inf, inf, 0.0, 1.0]) for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)], "one": [7.5] * 3000, "line": [float(i) for i in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    ranks = {f"r{k}": k for k in (0, 1, *range(5, 3000, 300), 2998, 2999)}
    got = values_at_ranks(df, {c: c for c in columns}, {c: (3000, ranks) for c in columns}, replace(EXACT, rank_group_rows=group, rank_sketch_k=256))
    found = {(r["column"], r["label"]): r["value"] for r in got.collect()}
    assert found == {(c, label): sorted(v)[k] for c, v in columns.items() for label, k in ranks.items()}


def test_rank_trees_are_compiled(spark):
    from plumbline.functions.ranks import search
    tree = search("x", [1.0, 2.0, 2.5, 9.0], str)
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1.5, 2, 2.4, 2.5, 8, 9, 10)], "x double").selectExpr("x", f"{tree} as i")
    assert [r["i"] for r in df.orderBy("x").collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


# --- keys show that no row repeats; correlations in blocks ------------------------------------------

@pytest.mark.parametrize("make, expected", [
    ("id as k, 'x' as v", (500, 0)), ("id % 499 as k, 'x' as v", (500, 2)), ("'x' as v, id as k", (500, 0)), ("'x' as v, id / 2 as k", (500, 0)),
    ("case when id > 0 then id end as k", (500, 0)), ("case when id > 1 then id end as k", (500, 2)), ("1 as k", (500, 500)),
])
def test_repeated_rows_with_and_without_a_key(spark, make, expected):
    got = overview.duplicate_rows(spark.range(500).selectExpr(*make.split(", ")), EXACT).head()
    assert (got["rows"], got["duplicate_rows"]) == expected


def test_keys_of_no_rows(spark):
    assert tuple(overview.duplicate_rows(spark.createDataFrame([], "k int, v string"), EXACT).head()) == (0, 0, 0.0)


@pytest.mark.parametrize("block, held", [(3, 2), (4, 1), (64, 16)])
def test_correlations_in_blocks(spark, monkeypatch, block, held):
    monkeypatch.setattr(correlation, "BLOCK", block)
    monkeypatch.setattr(correlation, "HELD", held)
    rng = random.Random(2)
    data = [[None if rng.random() < 0.1 else rng.gauss(0, 1) + (i if rng.random() < 0.5 else 0) for i in range(11)] for _ in range(300)]
    data[0][10] = math.inf
    df = spark.createDataFrame([tuple(r) for r in data], ", ".join(f"c{i} double" for i in range(11))).repartition(5)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in rows(correlation.correlations(df, EXACT))}
    assert len(got) == 121
    for i in range(11):
        for j in range(11):
            both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
            if any(math.isinf(v) for p in both for v in p):
                assert got[f"c{i}", f"c{j}"] is None
                continue
            x, y = zip(*both)
            mx, my = sum(x) / len(x), sum(y) / len(y)
            sxy = sum((a - mx) * (b - my) for a, b in both)
            expected = sxy / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
            assert got[f"c{i}", f"c{j}"] == pytest.approx(expected)


def test_two_thousand_columns_hand_on_blocks(spark):
    """Each task hands on one row for each pair of blocks, not one for each pair of columns."""
    df = spark.range(0, 40, 1, 2).selectExpr(*[f"cast((id * {i + 1}) % 37 as double) as c{i}" for i in range(2000)])
    sums = correlation._sums(df, df.schema.fields, [0.0] * 2000)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 + 3  # two groups of blocks: three pairs of groups
    assert sums.count() == 2000 * 2001 // 2


def test_counts_at_the_ends_make_no_rows(spark, monkeypatch):
    """Sketches of whole columns and the counts at their ends are plain aggregates: no value becomes a row for them."""
    from plumbline.functions import ranks
    values = [None, -0.0, 0.0, 1.5, 1.5, float("inf"), float("-inf"), 7.0]
    df = spark.createDataFrame([(v, i % 3 + 0.0) for i, v in enumerate(values)], "a double, b double")
    found = ranks._counts(df, ["a", "b"], {0: [0.0, 1.5, float("inf")], 1: [1.0]}, ProfileConfig(aggregates_per_scan=4))
    assert found == {(0, 0.0): (1, 3), (0, 1.5): (3, 5), (0, float("inf")): (6, 7), (1, 1.0): (3, 6)}
    monkeypatch.setattr(ranks, "_members", None)  # not needed for whole columns
    spans = [ranks.Span(0, [3], 7), ranks.Span(1, [4], 8)]
    (own,), (other,) = ranks._sketch_ends(df, ["a", "b"], spans, ProfileConfig(aggregates_per_scan=1))
    assert own[1] <= 1.5 <= own[2] and other[1] <= 1.0 <= other[2]


def test_warnings_count_no_distinct_values(spark, monkeypatch):
    """Constants show in the least and the largest value; years, sizes and distinct values are not read for warnings."""
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 7, nan, 0.0, None, 5, nan, "x"), (2, 7, nan, -0.0, None, None, 1.0, "x"), (3, 7, nan, 0.0, None, 5, nan, "x")],
        "k int, same int, nans double, zeros double, none bigint, gap int, mixed double, text string")
    df = df.withColumn("amount", F.lit("1.50").cast("decimal(9,2)"))
    tables = [Dataset("t", df, "t"), Dataset("empty", df.limit(0), "empty")]
    expected = {"t": {"same", "nans", "zeros", "none", "amount"}, "empty": {"k", "same", "nans", "zeros", "none", "gap", "mixed", "amount"}}

    def constants(c, frame):
        return {n: {r["column"] for r in frame(c).collect() if r["dataset_name"] == n} for n in expected}

    full = Catalog(spark, tables, EXACT)
    full.sources_table
    known = {n: {r["column"] for r in full.schema.where("type_class = 'numeric' and (non_null = 0 or unique <= 1)").collect() if r["dataset_name"] == n} for n in expected}
    assert known == expected == constants(full, lambda c: c.constant_columns)
    monkeypatch.setattr("plumbline.plans.catalog.distinct_counts", None)
    for c in (full, Catalog(spark, tables, EXACT)):
        assert constants(c, lambda c: c.warnings.where("rule = 'column_constant'")) == expected
    bare = Catalog(spark, tables, EXACT)
    warned = sorted(map(tuple, bare.warnings.collect()), key=str)
    assert warned == sorted(map(tuple, full.warnings.collect()), key=str) and "facts" not in bare.__dict__
