"""Mappings and value logic from an example, against trying everything."""

import random

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import match, synthesis
from sparkprep.operators.match import VALUE_FUNCTIONS, apply_function, column_values
from sparkprep.operators.restructure import Create, Drop, Merge, Rename, Split
from sparkprep.plans.run import prepare_from_example


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    names = ["Ada Lovelace", "Cem Demir", "Dora Maar", "Emil Nolde Sr", "Fay", "Gus Grissom", "Hal Finney", None]
    rows = [(i, names[i % 8], rng.choice(["North", "SOUTH"]), rng.choice(["A1", "b2", "C3"]), f"2024-0{i % 9 + 1}-1{i % 7} 00:00:00", rng.randrange(10**6)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, name string, region string, code string, day string, noise long")


def example_of(people):
    return people.select(
        F.split_part("name", F.lit(" "), F.lit(1)).alias("first"),
        F.when(F.instr("name", " ") > 0, F.expr("substr(name, instr(name, ' ') + 1)")).alias("family"),
        F.lower(F.concat_ws("|", "region", "code")).alias("place"),
        F.col("id").alias("number"),
        F.date_format("day", "dd-MM-yyyy").alias("since"),
        F.lit(None).cast("string").alias("remark"),
    )


def test_rules_and_functions_are_found(people):
    programs = synthesis.assign(synthesis.score_programs(people, example_of(people)), people.columns)
    assert {(p.targets, p.sources, p.function) for p in programs} == {
        (("first", "family"), ("name",), "split"),
        (("place",), ("region", "code"), "lower"),
        (("number",), ("id",), "identity"),
        (("since",), ("day",), "day_month_year"),
    }
    assert all(p.containment == 1.0 for p in programs)
    rules = synthesis.rules_of(programs, people.columns, example_of(people).columns)
    assert set(rules) == {
        Split("name", ("first", "family")),
        Merge(("region", "code"), "place"),
        Rename("id", "number"),
        Rename("day", "since"),
        Drop(("noise",)),
        Create(("remark",)),
    }


def test_a_run_reaches_the_example(people):
    example = example_of(people)
    found = prepare_from_example(people, example.where("number % 3 = 0"), steps=["missingValues/impute"])
    out = found.run.result.table
    assert out.columns == example.columns and out.count() == people.count()
    want = example.na.fill("").collect()
    got = {r["number"]: r for r in out.collect()}
    for r in want:
        made = got[str(r["number"])] if str(r["number"]) in got else got[r["number"]]
        assert made["place"] == r["place"] and made["since"] == r["since"] and made["remark"] == "_ext_"
        assert made["first"] == (r["first"] or "NA") and made["family"] == (r["family"] or ("" if r["first"] else "NA")) or made["family"] == "NA"


def test_sketches_discard_nothing_that_exact_scores_would_take(people):
    """Scores from a small sketch equal those of all candidates scored exactly."""
    example = example_of(people)
    small = synthesis.score_programs(people, example, sketch=32)
    whole = synthesis.score_programs(people, example, sketch=10**6, least=0.5)
    assert synthesis.assign(small, people.columns) == synthesis.assign(whole, people.columns)
    texts = column_values(people)
    for p in whole:
        if len(p.sources) == 1 and p.function != "split":
            made = {r[0] for r in people.select(VALUE_FUNCTIONS[p.function](texts[p.sources[0]])).distinct().collect()} - {None}
            want = {str(r[0]) for r in example.select(p.targets[0]).distinct().collect() if r[0] not in (None, "")}
            assert p.containment == len(made & want) / len(want) and p.jaccard == len(made & want) / len(made | want)


def test_nothing_in_common(spark, people):
    strange = spark.createDataFrame([("zzz", None)], "q string, r string")
    assert synthesis.score_programs(people, strange) == []
    empty = people.limit(0)
    assert synthesis.score_programs(empty, example_of(people)) == [] and synthesis.score_programs(people, strange.limit(0)) == []
    assert synthesis.rules_of([], ["a"], ["b"]) == [Drop(("a",)), Create(("b",))]


def test_functions_leave_markers_alone(spark):
    df = spark.createDataFrame([("NA",), ("_ext_",), ("2024-05-06 01:02:03",), ("x Y",), (None,)], "c string")
    assert [r[0] for r in df.select(apply_function(F.col("c"), "day_month_year")).collect()] == ["NA", "_ext_", "06-05-2024", None, None]
    assert [r[0] for r in df.select(apply_function(F.col("c"), "lower")).collect()][-2:] == ["x y", None]


def test_functions_run_on_distinct_cells_and_make_the_same_values(spark):
    """Rows are reduced to distinct cells before the functions; missing cells are kept, as a function may make a value of one."""
    source = spark.createDataFrame([("Ab c", 1), ("Ab c", 1), (None, 7), ("", None), (" x", 7)] * 3, "a string, b int")
    cells = match.distinct_cells(source)
    assert cells.count() == 6
    made = match.made_values(cells, dict.fromkeys(match.VALUE_FUNCTIONS, source.columns)).distinct()
    each = match.long_values(source, match.candidate_expressions(source), "u")
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in each.collect()}
    some = match.made_values(cells, {"lower": ["a"]})
    assert {tuple(r) for r in some.collect()} == {("lower(a)", "ab c"), ("lower(a)", " x")}


def test_every_program_that_reaches_the_least_containment_is_scored(spark):
    """Programs far behind a column's best, and merges of which one piece alone meets few of the target's, against trying everything."""
    rows = [(f"k{i % 2}" if i < 600 else None, str(i), f"v{i}", f"v{i}" if i % 5 < 3 else f"w{i}", f"p{i}|q") for i in range(1000)]
    source = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    goal = [(f"k{i % 2}|{i}" if i < 600 else f"z{i}|{i}", f"v{i}", f"P{i}|q|v{i}".lower(), f"|{i}" if i >= 600 else None) for i in range(1000)]
    example = spark.createDataFrame(goal, "m string, n string, o string, e string")
    got = {(p.targets, p.sources, p.function): (p.containment, p.jaccard) for p in synthesis.score_programs(source, example)}
    want = {}
    for v in range(4):
        known = {r[v] for r in goal} - {None}
        for i in range(5):
            for j in range(5):
                made = {r[i] if i == j else f"{r[i] or ''}|{r[j] or ''}" for r in rows} - {None}
                if len(made & known) / len(known) >= 0.5:
                    sources = ("abcde"[i],) if i == j else ("abcde"[i], "abcde"[j])
                    want[example.columns[v], sources] = (len(made & known) / len(known), len(made & known) / len(made | known))
    assert {(t[0], s): score for (t, s, f), score in got.items() if f == "identity"} == want
    assert {k: v[0] for k, v in want.items()} == {("m", ("a", "b")): 0.6, ("n", ("c",)): 1.0, ("n", ("d",)): 0.6, ("o", ("e", "c")): 1.0, ("o", ("e", "d")): 0.6, ("e", ("a", "b")): 1.0}
