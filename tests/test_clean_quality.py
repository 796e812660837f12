import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import clean, quality
from sparkprep.operators.pollute import pollute
from sparkprep.operators.profile import infer_schema
from sparkprep.operators.robust import outlier_stats


@pytest.fixture(scope="module")
def types(students):
    return infer_schema(students)


@pytest.fixture(scope="module")
def imputed(students, types):
    return clean.impute_missing(students, types)


def test_impute_missing(students, imputed):
    rows = imputed.collect()
    assert len(rows) == 16
    assert sum(r["Age"] == 0 for r in rows) == 7
    assert sum(r["Name"] == "NA" for r in rows) == 2
    assert not any(c is None or c == "" for r in rows for c in r)


def test_duplicates(students):
    out = clean.drop_duplicates(students)
    assert out.count() == 14
    assert clean.drop_duplicates(out).count() == 14


def test_keep_first_by_order(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("b", 2, 5)], "k string, v int, n int")
    assert sorted(tuple(r) for r in clean.drop_duplicates(df, "n").collect()) == [("a", 1, 3), ("b", 2, 5)]


def test_duplicates_with_variants(spark):
    df = spark.createDataFrame([("1", '{"a":1}'), ("1", '{"a": 1}'), ("1", '{"a":2}')], "k string, t string")
    df = df.select("k", F.parse_json("t").alias("v"))
    out = clean.drop_duplicates(df)
    assert out.columns == ["k", "v"] and out.count() == 2


def test_outlier_drop_is_sequential(imputed, types):
    out = clean.drop_outliers(imputed, types)
    assert out.count() == 13
    assert {r["Name"] for r in out.collect()}.isdisjoint({"Odd", "Odder", "Oddest"})


def test_outlier_impute(imputed, types):
    out = clean.impute_outliers(imputed, types).collect()
    assert len(out) == 16
    rows = {r["Name"]: r for r in out}
    assert rows["Odder"]["Age"] == 23.5 and rows["Oddest"]["Age"] == 23.5
    assert rows["Odd"]["Salary"] == 22500.0 and rows["Oddest"]["Salary"] == 22500.0


def test_strict_needs_numbers_everywhere(students, types):
    with pytest.raises(clean.StepFailed):
        clean.drop_outliers(students, types, strict=True)
    assert clean.drop_outliers(students, types).count() <= 16


def test_quality_improves(students, types):
    before = quality.quality_metrics(students, types).first()
    cleaned = clean.impute_outliers(clean.drop_duplicates(clean.impute_missing(students, types)), types)
    after = quality.quality_metrics(cleaned, types).first()
    assert after["dq"] > before["dq"] and after["missing_pct"] == 0


def test_quality_by_hand(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, "b"), (3.0, "c"), (4.0, ""), (1000.0, "e"), (1.0, "a")], "x double, s string"
    )
    types = {"x": "number", "s": "string"}
    m = quality.quality_metrics(df, types).first()
    # median 2.5, MAD 1.5: only 1000 lies beyond 4.5 of the median
    assert m["missing_pct"] == round(100 / 12, 3)
    assert m["dup_pct"] == round(100 / 6, 3)
    assert m["outlier_pct"] == round(100 / 6, 3)
    assert m["dq"] == pytest.approx(1 - (1 / 12 + 1 / 6 + 1 / 6) / 3)
    old = quality.quality_metrics(df, types, compat=True).first()
    # the header counts as one more distinct row
    assert old["dup_pct"] == 0.0
    assert old["dq"] == pytest.approx(1 - (1 / 12 + 0 + 1 / 6) / 3)


def test_compat_counts_the_last_number_column_only(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 10)] + [(999.0, 5.5)], "x double, y double")
    types = {"x": "number", "y": "number"}
    assert quality.quality_metrics(df, types).first()["outlier_pct"] == 5.0
    assert quality.quality_metrics(df, types, compat=True).first()["outlier_pct"] == 0.0


def test_baseline_bundle_skips_missing_cells_in_duplicates(spark):
    df = spark.createDataFrame([("a", ""), ("", "a"), ("b", "c")], "x string, y string")
    row = quality.baseline_metrics(df, {"x": "string", "y": "string"}).first()
    assert (row["m"], row["d"], row["o"]) == (round(2 / 6, 3), 0.0, 0.0)


def test_empty_table_has_no_ratios(spark):
    empty = spark.createDataFrame([], "x double, s string")
    row = quality.quality_metrics(empty, {"x": "number", "s": "string"}).first()
    assert row["n_rows"] == 0 and row["dq"] is None


def expected_stats(values):
    median = np.median(values)
    return median, np.median(np.abs(values - median))


@pytest.mark.parametrize("limits", [(10**9, 200_000), (0, 200_000), (0, 100)])
def test_median_and_mad_are_exact(spark, limits):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(4001) < 0.35, 7.0, rng.normal(0, 50, 4001))
    columns = {
        "hot": hot,
        "even": np.append(rng.lognormal(0, 3, 4000), np.nan),
        "same": np.full(4001, 2.5),
        "two": rng.integers(0, 2, 4001).astype(float),
        "wide": rng.choice([1e-300, 1e300, 0.0, -1e300, 3.0], 4001),
    }
    pdf = __import__("pandas").DataFrame(columns)
    df = spark.createDataFrame(pdf).repartition(5)
    stats = outlier_stats(df, list(columns), small_cells=limits[0], gather_limit=limits[1])
    for name, values in columns.items():
        values = values[~np.isnan(values)]
        median, mad = expected_stats(values)
        assert stats[name].n == len(values)
        assert (stats[name].median, stats[name].mad) == (median, mad), name


def test_empty_and_text_columns_have_no_median(spark):
    df = spark.createDataFrame([("x", None), ("3", None), ("5", None)], "s string, n double")
    stats = outlier_stats(df, ["s", "n"])
    assert stats["s"].median == 4.0 and stats["s"].n == 2
    assert stats["n"].median is None
    assert clean.drop_outliers(df, {"s": "number", "n": "number"}).count() == 3


def test_pollution_shares_and_repeatability(spark):
    df = spark.range(4000).selectExpr("id", "cast(id * 2 + 1 as double) x", "concat('t', id) s")
    types = {"id": "number", "x": "number", "s": "string"}
    a, b = pollute(df, types, "id"), pollute(df.repartition(3), types, "id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    row = a.agg(F.count("*").alias("n"), F.avg((F.col("s") == "").cast("int")).alias("m")).first()
    assert abs(row["n"] / 4000 - 1.2) < 0.03 and abs(row["m"] - 0.4) < 0.03
