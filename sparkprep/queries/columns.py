"""Restructuring, value functions, and matching of columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions import scalars as S
from sparkprep.operators import match as M
from sparkprep.operators.restructure import Create, Drop, Merge, Rename, Split, apply_mapping, mapping_from_pairs
from sparkprep.operators.table_functions import get_table_function, isolate, pandas_table_function, table_function
from sparkprep.plans.run import prepare_from_example
from sparkprep.queries.registry import query, table
from sparkprep.session import rebalanced


@query(
    "q21_rename_merge_split",
    """select p_partkey as part_id, concat(p_brand, '|', p_type) as brand_type,
  split_part(p_name, ' ', 1) as colour, substr(p_name, strpos(p_name, ' ') + 1) as item, p_size, p_retailprice from part""",
)
def rename_merge_split(spark, folder):
    rules = [
        Rename("p_partkey", "part_id"),
        Merge(("p_brand", "p_type"), "brand_type"),
        Split("p_name", ("colour", "item")),
    ]
    return apply_mapping(table(spark, folder, "part"), rules)


@query(
    "q22_create_drop_reorder",
    """select '_ext_' as customer_rank, c_mktsegment as segment, '_ext_' as notes, c_custkey as id, c_acctbal from customer""",
)
def create_drop_reorder(spark, folder):
    rules = mapping_from_pairs(
        [
            (["c_custkey"], ["id"]),
            (["c_mktsegment"], ["segment"]),
            (["c_name", "c_nationkey"], []),
            ([], ["customer_rank", "notes"]),
        ]
    )
    order = ["customer_rank", "segment", "notes", "id", "c_acctbal"]
    return apply_mapping(table(spark, folder, "customer"), rules, order)


@query(
    "q23_nway_merge",
    """select l_orderkey, concat_ws('|', cast(l_partkey as varchar), cast(l_suppkey as varchar),
  cast(l_linenumber as varchar), l_returnflag) as line_code from lineitem""",
)
def nway_merge(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_tax")
    rules = [Merge(("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), "line_code"), Drop(("l_tax",))]
    return apply_mapping(df, rules)


@query(
    "q23_merge_compat",
    """with j as (select doc_id, concat(cast(to_json(text) as varchar), '|', cast(to_json(source) as varchar)) as joined from documents),
p as (select doc_id, string_split(replace(joined, '"', ''), '|') as pieces from j)
select doc_id, concat(pieces[1], '|', pieces[2]) as merged, '_ext_' as extra from p""",
)
def merge_compat(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text", "source")
    return apply_mapping(df, [Merge(("text", "source"), "merged"), Create(("extra",))], compat=True)


@query(
    "q34_std_dates",
    """select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as slashed, strftime(o_orderdate, '%d-%B-%y') as day_month_name,
  strftime(o_orderdate, '%Y-%B-%d') as year_month_name, strftime(o_orderdate, '%d-%B-%Y') as day_month_name_year,
  strftime(o_orderdate, '%d-%m-%Y') as day_month_year, strftime(o_orderdate, '%d-%m-%y %H-%M-%S') as with_time
from orders""",
)
def std_dates(spark, folder):
    df = table(spark, folder, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = df.withColumn("us", F.date_format("o_orderdate", "MM d, yyyy"))
    df = df.withColumn("stamp", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return df.select(
        "o_orderkey",
        S.reformat_local_date(F.concat("stamp", F.lit("-05:00")), "yyyy/MM/dd").alias("slashed"),
        S.reformat_date(F.col("d"), "yyyy-MM-dd", "dd-MMMM-yy").alias("day_month_name"),
        S.reformat_date(F.col("d"), "yyyy-MM-dd", "yyyy-MMMM-dd").alias("year_month_name"),
        S.reformat_date(F.col("d"), "yyyy-MM-dd", "dd-MMMM-yyyy").alias("day_month_name_year"),
        S.reformat_date(F.col("us"), "MM d, yyyy", "dd-MM-yyyy").alias("day_month_year"),
        S.reformat_date(F.col("stamp"), "yyyy-MM-dd HH:mm:ss", "dd-MM-yy HH-mm-ss").alias("with_time"),
    )


@query(
    "q35_std_strings",
    """select o_orderkey, lower(o_orderpriority) as lowered, lower(trim(concat('  ', o_orderpriority, ' '))) as trimmed,
  split_part(o_orderpriority, ' ', 1) as first_part,
  case when strpos(o_orderpriority, ' ') > 0 then substr(o_orderpriority, strpos(o_orderpriority, ' ') + 1) else '' end as rest,
  list_last(string_split(o_orderpriority, ' ')) as last_word, replace(o_orderpriority, ' ', '-') as dashed,
  length(o_orderpriority) as n_chars,
  case lower(o_orderstatus) when 'f' then 'finished' when 'o' then 'open' else o_orderstatus end as status,
  case when lower(o_orderstatus) = 'f' then 1 else 0 end as is_final,
  concat(o_orderstatus, ' ', o_orderpriority) as full_text from orders""",
)
def std_strings(spark, folder):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        S.lower(p).alias("lowered"),
        S.lower_trim(F.concat(F.lit("  "), p, F.lit(" "))).alias("trimmed"),
        S.first_part(p).alias("first_part"),
        S.rest_part(p).alias("rest"),
        S.last_word(p).alias("last_word"),
        S.dashed(p).alias("dashed"),
        S.text_length(p).cast("bigint").alias("n_chars"),
        S.map_values(s, {"F": "finished", "O": "open"}).alias("status"),
        S.flag(s, "f").alias("is_final"),
        S.join_text(s, p).alias("full_text"),
    )


@query(
    "q36_std_numbers",
    """select o_orderkey, o_totalprice / 1e6 as millions, round(o_totalprice, 1) as one_digit,
  cast(ceil(o_totalprice / 10) as bigint) * 10 as up_to_ten, (o_totalprice + o_custkey) / 2 as mean_value,
  printf('%.1f', round(o_totalprice, 1)) as as_text from orders""",
)
def std_numbers(spark, folder):
    price, cust = F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        S.scale(price, 1e6).alias("millions"),
        S.rounded(price, 1).alias("one_digit"),
        S.round_up_to(price, 10).alias("up_to_ten"),
        S.mean_of(price, cust).alias("mean_value"),
        S.rounded_text(price, 1).alias("as_text"),
    )


@query(
    "q37_std_buckets",
    """select p_partkey, case when p_size >= 30 then 'large' when p_size between 10 and 25 then 'medium' else 'small' end as size_class
from part""",
)
def std_buckets(spark, folder):
    c = F.col("p_size").cast("string")
    return table(spark, folder, "part").select(
        "p_partkey", S.bucket(c, [(30, float("inf"), "large"), (10, 25, "medium")], "small").alias("size_class")
    )


@query(
    "q38_std_arrays",
    """select vec_id, array_to_string([printf('%.4f', x) for x in embedding], ', ') as joined,
  cast(len(embedding) as bigint) as n_values, label from embeddings""",
)
def std_arrays(spark, folder):
    text = F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double")))
    df = table(spark, folder, "embeddings").withColumn("tags", text)
    return df.select(
        "vec_id", S.join_list(df, "tags", ", ").alias("joined"), F.size("embedding").cast("bigint").alias("n_values"), "label"
    )


def _containment_sql() -> str:
    source = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    target = ["o_orderkey", "o_custkey", "o_orderstatus"]
    s = " union ".join(f"select '{c}' as u, cast({c} as varchar) as value from lineitem" for c in source)
    t = " union ".join(f"select '{c}' as v, cast({c} as varchar) as value from orders" for c in target)
    return f"""with s as ({s}), t as ({t}), totals as (select v, count(*) as n_target from t group by v),
common as (select u, v, count(*) as common from s join t using (value) group by u, v)
select u, v, common, n_target, round(cast(common as double) / n_target, 6) as containment from common join totals using (v)"""


def line_order_containment(spark, folder):
    source = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    target = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return source, target, M.value_containment(source, target)


@query("q45_value_containment", _containment_sql())
def value_containment(spark, folder):
    return line_order_containment(spark, folder)[2]


def _evidence_sql() -> str:
    """Names and values together: trigram cosine and edit distance in SQL."""
    source = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    target = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    cols = ", ".join(f"('u', '{c}')" for c in source) + ", " + ", ".join(f"('v', '{c}')" for c in target)
    values_s = " union ".join(f"select '{c}' as u, cast({c} as varchar) as value from customer" for c in source)
    values_t = " union ".join(f"select '{c}' as v, cast({c} as varchar) as value from supplier" for c in target)
    return f"""with names(side, name) as (values {cols}),
grams as (select side, name, substr(concat('  ', lower(name), ' '), cast(i as integer), 3) as gram, count(*) as n
  from names, unnest(range(1, length(name) + 2)) as r(i) group by all),
norms as (select side, name, sqrt(sum(n * n)) as norm from grams group by all),
dots as (select a.name as u, b.name as v, sum(a.n * b.n) as dot from grams a join grams b using (gram)
  where a.side = 'u' and b.side = 'v' group by all),
edges as (select u, v, round(((1.0 - levenshtein(lower(u), lower(v)) / cast(greatest(length(u), length(v)) as double))
  + dot / (nu.norm * nv.norm)) / 2, 3) as weight
  from dots join norms nu on nu.side = 'u' and nu.name = u join norms nv on nv.side = 'v' and nv.name = v),
s as ({values_s}), t as ({values_t}), totals as (select v, count(*) as n_target from t group by v),
common as (select u, v, count(*) as common from s join t using (value) group by u, v),
contained as (select u, v, round(cast(common as double) / n_target, 6) as containment from common join totals using (v))
select u, v, case when weight > 0.5 then weight end as weight, containment
from (select * from edges where weight > 0.5) e full join contained using (u, v)"""


def column_evidence(spark, folder):
    source, target = table(spark, folder, "customer"), table(spark, folder, "supplier")
    edges = M.similarity_edges(M.column_catalogue(source, "customer"), M.column_catalogue(target, "supplier"))
    values = M.value_containment(source, target)
    return edges.join(values, ["u", "v"], "full").select("u", "v", "weight", "containment")


@query("q42_column_edges", _evidence_sql())
def column_edges(spark, folder):
    return column_evidence(spark, folder)


def _evidence_matches(spark, folder):
    """Matching on the mean of name weight and value containment."""
    score = (F.coalesce("weight", F.lit(0.0)) + F.coalesce("containment", F.lit(0.0))) / 2
    evidence = column_evidence(spark, folder).select("u", "v", F.round(score, 6).alias("weight"))
    source = M.column_catalogue(table(spark, folder, "customer"), "customer")
    place = source.select(F.col("column").alias("u"), F.col("position").alias("u_position"))
    return M.match_columns(M.ranked(evidence).join(place, "u"))


# With distinct weights and no rival within five percent, a stable matching is the
# greedy one: heaviest pair first, each column once. That is what the SQL walks.
_greedy = f"""with recursive evidence as ({_evidence_sql()}),
scored as (select u, v, round((coalesce(weight, 0) + coalesce(containment, 0)) / 2, 6) as weight from evidence),
numbered as (select *, row_number() over (order by weight desc, u, v) as k from scored),
walk as (select cast(0 as bigint) as k, cast([] as varchar[]) as us, cast([] as varchar[]) as vs
  union all select n.k,
    case when list_contains(us, n.u) or list_contains(vs, n.v) then us else list_append(us, n.u) end,
    case when list_contains(us, n.u) or list_contains(vs, n.v) then vs else list_append(vs, n.v) end
  from walk join numbered n on n.k = walk.k + 1),
last as (select us, vs from walk order by k desc limit 1),
pairs as (select unnest(us) as u, unnest(vs) as v from last)"""


@query("q43_column_match", f"{_greedy} select u, v, weight from pairs join scored using (u, v)")
def column_match(spark, folder):
    return _evidence_matches(spark, folder)


@query(
    "q44_create_drop_lists",
    f"""{_greedy}, targets(c) as (values ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')),
sources(c) as (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'))
select 'CREATE' as action, c as "column" from targets where c not in (select v from pairs)
union all select 'DROP' as action, c as "column" from sources where c not in (select u from pairs)""",
)
def create_drop_lists(spark, folder):
    source = M.column_catalogue(table(spark, folder, "customer"), "customer")
    target = M.column_catalogue(table(spark, folder, "supplier"), "supplier")
    return M.unmatched(source, target, _evidence_matches(spark, folder))


_DAY = "try_strptime(case when {0} like '____-__-__%' then substr({0}, 1, 10) end, '%Y-%m-%d')"
_NUMBER = "try_cast({0} as double)"
FUNCTION_SQL = {
    "identity": "{0}",
    "lower": "lower({0})",
    "lower_trim": "lower(trim({0}))",
    "first_part": "split_part({0}, ' ', 1)",
    "rest_part": "case when instr({0}, ' ') > 0 then substr({0}, instr({0}, ' ') + 1) else '' end",
    "last_word": "regexp_extract({0}, '[^ ]*$')",
    "dashed": r"regexp_replace(trim({0}), '\s+', '-', 'g')",
    "round_up_10": f"cast(cast(ceil({_NUMBER} / 10) as bigint) * 10 as varchar)",
    "rounded_0": f"cast(cast(round({_NUMBER}, 0) as bigint) as varchar)",
    "day_month_year": f"strftime({_DAY}, '%d-%m-%Y')",
    "year_slash": f"strftime({_DAY}, '%Y/%m/%d')",
    "day_monthname_year": f"strftime({_DAY}, '%d-%B-%Y')",
}


def _made_sql(rel: str, columns: list[str], functions: list[str]) -> str:
    """Distinct values of every function of every column: (u, place, value)."""
    parts = []
    for c in columns:
        for f in functions:
            text = f"nullif(cast({c} as varchar), '')"
            parts.append(f"select '{f}({c})' as u, {len(parts)} as place, {FUNCTION_SQL[f].format(text)} as value from {rel}")
    return f"select distinct * from ({' union all '.join(parts)}) where value is not null"


def _wanted_sql(rel: str, columns: list[str]) -> str:
    """Distinct filled values of the target's columns: (v, value)."""
    return " union ".join(f"select '{c}' as v, cast({c} as varchar) as value from {rel} where coalesce(cast({c} as varchar), '') <> ''" for c in columns)


@query(
    "q46_infer_logic",
    f"""with src as (select o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from orders),
goal as (select o_custkey as client, lower(o_orderpriority) as priority,
  strftime(strptime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%d-%m-%Y') as placed_on from src),
made as ({_made_sql('src', ['o_custkey', 'o_orderpriority', 'o_orderdate'], list(FUNCTION_SQL))}),
wanted as ({_wanted_sql('goal', ['client', 'priority', 'placed_on'])}),
totals as (select v, count(*) as n from wanted group by v),
scored as (select v, u, place, count(*) / cast(max(n) as double) as containment from made join wanted using (value) join totals using (v) group by v, u, place)
select v, u as expression, round(containment, 6) as containment from scored
qualify row_number() over (partition by v order by round(containment, 6) desc, place) = 1""",
)
def infer_logic(spark, folder):
    source = rebalanced(table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderdate"))
    source = source.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    target = source.select(
        F.col("o_custkey").alias("client"),
        F.lower("o_orderpriority").alias("priority"),
        F.date_format(F.to_timestamp("o_orderdate"), "dd-MM-yyyy").alias("placed_on"),
    )
    return M.propose_expressions(source, target)


_PARTS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_EXAMPLE = ["item", "finish", "thing", "label", "price", "stock"]
_example_sql = """example as (select p_partkey as item, split_part(p_name, ' ', 1) as finish, split_part(p_name, ' ', 2) as thing,
  lower(p_brand || '|' || p_type) as label, cast(round(p_retailprice, 0) as bigint) as price, cast(null as varchar) as stock from part)"""


def _programs_sql() -> str:
    """CTEs that end in ``taken``: every program scored over all values, then assigned best first."""
    functions = list(FUNCTION_SQL)
    pairs = []
    for a in _PARTS:
        for b in _PARTS:
            for f in ("identity", "lower"):
                if a != b:
                    joined = f"concat(coalesce(cast({a} as varchar), ''), '|', coalesce(cast({b} as varchar), ''))"
                    pairs.append(f"select '{a},{b}' as sources, '{f}' as f, {functions.index(f)} as place, {FUNCTION_SQL[f].format(joined)} as value from part")
    singles = [
        f"select '{c}' as sources, '{f}' as f, {functions.index(f)} as place, {FUNCTION_SQL[f].format(f'nullif(cast({c} as varchar), {chr(39) * 2})')} as value from part"
        for c in _PARTS
        for f in functions
    ]
    used = "(list_has_any(us, ss) or list_has_any(vs, ts))"
    at = " ".join(f"when '{c}' then {i}" for i, c in enumerate(_PARTS))
    return f"""{_example_sql},
made as (select distinct * from ({' union all '.join(singles + pairs)}) where value is not null),
wanted as ({_wanted_sql('example', _EXAMPLE)}),
n_made as (select sources, f, count(*) as n_made from made group by all), n_wanted as (select v, count(*) as n_wanted from wanted group by v),
common as (select v, sources, f, place, count(*) as n from made join wanted using (value) group by all),
scored as (select v as targets, sources, f, place, round(cast(n as double) / n_wanted, 6) as containment,
  round(cast(n as double) / (n_wanted + n_made - n), 6) as jaccard from common join n_made using (sources, f) join n_wanted using (v)),
splits as (select a.targets || ',' || b.targets as targets, a.sources, 'split' as f, -1 as place,
  least(a.containment, b.containment) as containment, least(a.jaccard, b.jaccard) as jaccard
  from scored a join scored b on a.sources = b.sources and a.f = 'first_part' and b.f = 'rest_part' and a.targets <> b.targets),
programs as (select *, string_split(sources, ',') as ss, string_split(targets, ',') as ts from (from scored union all from splits) where containment >= 0.5),
numbered as (select *, row_number() over (order by containment desc, len(ts) desc, jaccard desc, place,
  list_transform(ss, lambda c: case c {at} end), ts) as k from programs),
walk as (select cast(0 as bigint) as k, cast([] as varchar[]) as us, cast([] as varchar[]) as vs, cast([] as bigint[]) as ks
  union all select n.k, case when {used} then us else list_concat(us, ss) end, case when {used} then vs else list_concat(vs, ts) end,
    case when {used} then ks else list_append(ks, n.k) end from walk join numbered n on n.k = walk.k + 1),
last as (select ks from walk order by k desc limit 1),
taken as (select * from numbered where list_contains((select ks from last), k))"""


@query(
    "q60_prepare_from_example",
    f"""with recursive {_programs_sql()}
select targets, sources, f as "function", containment, jaccard, containment as reached from taken
union all select 'stock', '', 'create', null, null, null""",
)
def prepare_parts_from_example(spark, folder):
    """Mapping and value logic found in an example, run on the source, and what share of the example the run reached."""
    parts = table(spark, folder, "part")
    words = [F.split_part("p_name", F.lit(" "), F.lit(i + 1)).alias(c) for i, c in enumerate(("finish", "thing"))]
    example = parts.select(
        F.col("p_partkey").alias("item"),
        *words,
        F.lower(F.concat_ws("|", "p_brand", "p_type")).alias("label"),
        F.round("p_retailprice", 0).cast("bigint").alias("price"),
        F.lit(None).cast("string").alias("stock"),
    )
    found = prepare_from_example(parts, example, steps=["missingValues/impute"])
    made = M.value_containment(found.run.result.table, example).where("u = v").select(F.col("v"), F.col("containment").alias("reached"))
    rows = [(",".join(p.targets), ",".join(p.sources), p.function, round(p.containment, 6), round(p.jaccard, 6)) for p in found.programs]
    rows += [(t, "", "create", None, None) for r in found.rules if isinstance(r, Create) for t in r.targets]
    programs = spark.createDataFrame(rows, "targets string, sources string, function string, containment double, jaccard double")
    each = programs.select("*", F.explode(F.split("targets", ",")).alias("v")).join(made, "v", "left")
    return each.groupBy("targets", "sources", "function", "containment", "jaccard").agg(F.min("reached").alias("reached"))


@table_function("orders_in_thousands")
def orders_in_thousands(df):
    return df.withColumn("thousands", F.col("o_totalprice") / 1000)


@pandas_table_function("priority_number", "o_orderkey bigint, thousands double, priority_number bigint")
def priority_number(part):
    number = part["o_orderpriority"].str.split("-").str[0].astype("int64")
    return part.assign(priority_number=number)[["o_orderkey", "thousands", "priority_number"]]


@query(
    "q55_table_function",
    """select o_orderkey, o_totalprice / 1000 as thousands,
  cast(split_part(o_orderpriority, '-', 1) as bigint) as priority_number from orders""",
)
def run_table_function(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return df.transform(get_table_function("orders_in_thousands")).transform(get_table_function("priority_number"))


@query(
    "q61_isolated_failures",
    """with tried as (select *, o_custkey % 97 as turn, cast(split_part(o_orderpriority, '-', 1) as bigint) as number from orders)
select o_orderkey, number * 10 as urgency, null::bigint as record_key, null::varchar as error from tried where turn <> 0
union all select null, null, o_orderkey, 'ValueError: customer without a turn' from tried where turn = 0""",
)
def isolated_failures(spark, folder):
    """A user function over the orders: the rows it takes, and those it fails on with their error."""

    def urgency(part):
        if (part["o_custkey"] % 97 == 0).any():
            raise ValueError("customer without a turn")
        number = part["o_orderpriority"].str.split("-").str[0].astype("int64")
        return part.assign(urgency=number * 10)[["o_orderkey", "urgency"]]

    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("urgency", T.LongType())])
    done = isolate(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), urgency, schema)
    none = F.lit(None)
    good = done.good.select("*", none.cast("long").alias("record_key"), none.cast("string").alias("error"))
    key = F.get_json_object("record", "$.o_orderkey").cast("long").alias("record_key")
    failed = done.failed.select(none.cast("long").alias("o_orderkey"), none.cast("long").alias("urgency"), key, "error")
    return good.unionByName(failed)
