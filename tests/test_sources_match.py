import json

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import match
from sparkprep.sources import csv as C
from sparkprep.sources import json as J
from sparkprep.sources.files import file_stats, read_any, sample_rows


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quotes_breaks_and_empty_cells(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,text,n\n1,"a ""b"", c\nd",\n2,,5\n')
    rows = [tuple(r) for r in C.read_csv(spark, path).collect()]
    assert rows == [("1", 'a "b", c\nd', None), ("2", None, "5")]


def test_ragged_rows_are_quarantined(spark, tmp_path):
    path = write(tmp_path, "r.csv", "a,b\n1,2\n3\n4,5,6\n")
    good, bad = C.quarantine(C.read_csv(spark, path, keep_corrupt=True))
    assert [tuple(r) for r in good.collect()] == [("1", "2")]
    assert sorted(r[0] for r in bad.collect()) == ["3", "4,5,6"]


def test_csv_sink_keeps_the_created_marker(spark, tmp_path):
    df = spark.createDataFrame([("_ext_", 'x,"y"', "a\nb")], "a string, b string, c string")
    C.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in C.read_csv(spark, str(tmp_path / "out")).collect()] == [("_ext_", 'x,"y"', "a\nb")]


DOCUMENT = {"meta": {"n": 2}, "data": {"rows": [{"a": 1, "b": None}, {"a": "x", "c": [1, 2]}]}, "tail": [1]}


def test_json_document_finds_the_first_list(spark, tmp_path):
    found = J.read_json_document(spark, write(tmp_path, "d.json", json.dumps(DOCUMENT)))
    assert found.path == "$['data']['rows']"
    assert found.table.columns == ["a", "b", "c"]
    rows = found.table.select(
        F.to_json("a").alias("a"), F.is_variant_null("b").alias("b_null"), F.col("b").isNull().alias("b_absent"), F.to_json("c").alias("c")
    ).collect()
    assert [tuple(r) for r in rows] == [("1", True, False, None), ('"x"', False, True, "[1,2]")]


def test_json_document_is_written_back_in_place(spark, tmp_path):
    document = {"first": {"k": 1}, "rows": [{"a": 1}, {"a": 2, "b": "y"}], "last": "é"}
    found = J.read_json_document(spark, write(tmp_path, "d.json", json.dumps(document)))
    J.write_json_document(found.table, str(tmp_path / "out"), found)
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert json.loads(text) == document and list(json.loads(text)) == list(document)
    J.write_json_document(found.table, str(tmp_path / "bare"))
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "bare")).collect())
    assert json.loads(text) == document["rows"]
    J.write_json_document(found.table, str(tmp_path / "parts"), found, max_rows=1)
    lines = spark.read.text(str(tmp_path / "parts" / "records")).collect()
    assert sorted((json.loads(r["value"]) for r in lines), key=str) == sorted(document["rows"], key=str)
    rest = spark.read.text(str(tmp_path / "parts" / "envelopes")).collect()
    assert [json.loads(r["value"]) for r in rest] == [{"first": {"k": 1}, "last": "é"}]


def test_several_documents_keep_their_envelopes(spark, tmp_path):
    for name, document in (("1", {"src": "one", "rows": [{"a": 1}, 7]}), ("2", {"src": "two", "n'k": [1], "rows": [{"a": 2}]}), ("3", "{broken")):
        write(tmp_path, f"{name}.json", document if isinstance(document, str) else json.dumps(document))
    write(tmp_path, "2.json", json.dumps({"src": "two", "rows": [{"a": 2}], "n'k": [1]}))
    found = J.read_json_document(spark, str(tmp_path / "*.json"))
    assert sorted(r["value"] for r in found.rejected.collect()) == ["7", "{broken"]
    J.write_json_document(found.table, str(tmp_path / "out"), found)
    rest = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "envelopes")).collect()]
    assert sorted(rest, key=str) == sorted([{"src": "one"}, {"src": "two", "n'k": [1]}], key=str)
    assert spark.read.text(str(tmp_path / "out" / "records")).count() == 2


def test_json_compat_marks_absent_keys(spark, tmp_path):
    path = write(tmp_path, "l.jsonl", '{"a":1}\n{"b":2}\nnot json\n[1]\n')
    records, bad = J.read_json_lines(spark, path, compat=True)
    assert [tuple(json.loads(c) for c in r) for r in records.select(F.to_json("a"), F.to_json("b")).collect()] == [(1, "_ext_"), ("_ext_", 2)]
    assert sorted(r[0] for r in bad.collect()) == ["[1]", "not json"]
    texts = [json.loads(r[0]) for r in J.to_json_text(records).collect()]
    assert texts == [{"a": 1}, {"b": 2}]


def test_unusable_files(spark, tmp_path):
    assert J.read_json_document(spark, write(tmp_path, "e.json", '{"a": 1}')) is None
    assert J.read_json_document(spark, write(tmp_path, "f.json", "{broken")) is None
    with pytest.raises(ValueError):
        read_any(spark, "table.xml")


def test_file_stats_and_sample(spark, tmp_path):
    write(tmp_path, "one.csv", "a\n" + "\n".join(map(str, range(500))) + "\n")
    df = C.read_csv(spark, str(tmp_path / "one.csv"))
    assert [tuple(r)[:2] for r in file_stats(df).collect()] == [("one.csv", 500)]
    a, b = sample_rows(df, ["a"]).collect(), sample_rows(df.repartition(7), ["a"]).collect()
    assert len(a) == 20 and set(a) == set(b)
    assert sample_rows(df.limit(19), ["a"]).count() == 0


def trigram_counts(name):
    padded = f"  {name.lower()} "
    out = {}
    for i in range(len(padded) - 2):
        out[padded[i : i + 3]] = out.get(padded[i : i + 3], 0) + 1
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_edges_against_all_pairs(spark):
    source = ["customer_id", "Customer Name", "age", "acctbal", "zip", "name"]
    target = ["cust_id", "name", "customer_age", "balance", "zipcode", "customer_name", "age"]
    want = {}
    for u in source:
        for v in target:
            a, b = trigram_counts(u), trigram_counts(v)
            dot = sum(n * b.get(g, 0) for g, n in a.items())
            cosine = dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
            ratio = 1 - edit_distance(u.lower(), v.lower()) / max(len(u), len(v))
            if (weight := (ratio + cosine) / 2) > 0.5:
                want[u, v] = round(weight, 3)
    cat = lambda names: spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, column string")
    got = {(r["u"], r["v"]): r["weight"] for r in match.similarity_edges(cat(source), cat(target)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 0.001 for k in want)


def edges(spark, rows):
    df = spark.createDataFrame(rows, "u string, u_position int, v string, weight double")
    return match.ranked(df)


def test_matching_shares_replaces_and_refuses(spark):
    # within 5 %: both stay; clearly heavier: replaces; lighter: falls to its second wish
    got = match.match_columns(
        edges(
            spark,
            [
                ("a", 0, "t", 0.80), ("b", 1, "t", 0.82),
                ("c", 2, "s", 0.60), ("d", 3, "s", 0.90), ("c", 2, "r", 0.55),
                ("e", 4, "s", 0.70), ("e", 4, "q", 0.52),
            ],
        )
    )
    assert {(r["u"], r["v"]) for r in got.collect()} == {("a", "t"), ("b", "t"), ("d", "s"), ("c", "r"), ("e", "q")}


def test_two_holders_yield_only_to_more_than_both(spark):
    rows = [("a", 0, "t", 0.51), ("b", 1, "t", 0.52), ("c", 2, "t", 1.0)]
    assert {r["u"] for r in match.match_columns(edges(spark, rows)).collect()} == {"a", "b"}
    rows = [("a", 0, "t", 0.2), ("b", 1, "t", 0.2), ("c", 2, "t", 1.0)]
    assert {r["u"] for r in match.match_columns(edges(spark, rows)).collect()} == {"c"}


def test_matching_has_no_round_limit_and_takes_weight_zero(spark):
    rows = [(f"u{i}", i, f"v{i}", 0.9) for i in range(1200)] + [("x", 1200, "y", 0.0), ("z", 1201, "y", 0.0)]
    got = match._stable_pairs(edges(spark, rows).toPandas())
    assert len(got) == 1202


def test_matching_per_table_pair_and_leftovers(spark):
    df = edges(spark, [("a", 0, "t", 0.9)]).withColumn("pair", F.lit(1))
    df = df.unionByName(edges(spark, [("a", 0, "s", 0.8)]).withColumn("pair", F.lit(2)))
    got = match.match_columns(df, ["pair"])
    assert {(r["pair"], r["u"], r["v"]) for r in got.collect()} == {(1, "a", "t"), (2, "a", "s")}
    cat = lambda rows: spark.createDataFrame(rows, "pair int, column string")
    left = match.unmatched(cat([(1, "a"), (2, "a"), (2, "z")]), cat([(1, "t"), (1, "y"), (2, "s")]), got, ["pair"])
    assert {tuple(r) for r in left.collect()} == {(1, "CREATE", "y"), (2, "DROP", "z")}


def test_containment_both_ways_agree(spark):
    source = spark.range(300).selectExpr("id % 50 a", "concat('k', id % 7) b", "'hot' c")
    target = spark.range(60).selectExpr("id x", "concat('k', id % 9) y", "'hot' z")
    small = {tuple(r) for r in match.value_containment(source, target).collect()}
    large = {tuple(r) for r in match.value_containment(source, target, broadcast_bytes=0).collect()}
    assert small == large
    assert {r[:2] + (r[4],) for r in small} >= {("a", "x", 0.833333), ("b", "y", 0.777778), ("c", "z", 1.0)}


def test_failing_rows_are_set_aside(spark):
    from pyspark.sql import types as T

    from sparkprep.operators.table_functions import isolate

    def halved(part):
        if (part["n"] % 7 == 3).any() or part["t"].isna().any():
            raise KeyError("odd one")
        return part.assign(half=part["n"] / 2)[["n", "half"]]

    schema = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("half", T.DoubleType())])
    df = spark.createDataFrame([(i, None if i == 50 else str(i)) for i in range(100)], "n long, t string").repartition(3)
    done = isolate(df, halved, schema)
    good, failed = done.good.collect(), done.failed.collect()
    assert len(good) + len(failed) == 100 and all(r["half"] == r["n"] / 2 for r in good)
    assert sorted(json.loads(r["record"])["n"] for r in failed) == sorted([*range(3, 100, 7), 50])
    assert {r["error"] for r in failed} == {"KeyError: 'odd one'"}
    assert isolate(df.limit(0), halved, schema).failed.count() == 0
    with pytest.raises(ValueError):
        isolate(df.withColumnRenamed("t", "__error"), halved, schema)
