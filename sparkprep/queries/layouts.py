"""The thirteen target layouts on source-shaped tables.

A source frame is written once, as SQL that both engines read the same way, with
blanks put in by the repeatable random choice. Imputation and layout are stated
independently: DataFrame operators on one side, SQL on the other.
"""

from __future__ import annotations

from sparkprep.operators.clean import impute_missing
from sparkprep.operators.standardise import LAYOUTS
from sparkprep.queries.registry import query, table


def gap(cell: str, key: str, name: str) -> str:
    """SQL that empties a fifth of a text column's cells."""
    return f"case when substr(md5(concat(cast({key} as string), '|{name}')), 1, 4) < '3333' then '' else {cell} end as {name}"


def text(cell: str) -> str:
    return f"cast({cell} as string)"


def register(name: str, tables: list[str], source: str, kinds: dict[str, str], target: str) -> None:
    """One query: source frame, imputation (``n`` 0.0, ``s`` NA, ``x`` as is), layout."""
    layout = LAYOUTS[name.split("_", 1)[1]]
    cells = []
    for c, kind in kinds.items():
        default = {"n": "'0.0'", "s": "'NA'"}.get(kind)
        cells.append(f"coalesce(nullif({c}, ''), {default}) as {c}" if default else c)
    sql = f"with raw as ({source.format(**{t: t for t in tables})}), src as (select {', '.join(cells)} from raw) {target}"
    types = {c.strip('"'): "number" if k == "n" else "string" for c, k in kinds.items()}
    spark_source = source.replace('"', "`")

    def run(spark, folder):
        raw = spark.sql(spark_source, **{t: table(spark, folder, t) for t in tables})
        return layout(impute_missing(raw.select(*[f"`{c}`" for c in types]), types))

    query(name, sql)(run)


register(
    "v01_stock_prices",
    ["events"],
    f"""select {gap("concat(substr(cast(ts as string), 1, 19), '-05:00')", "event_id", "date")},
  {gap(text("value"), "event_id", "open")}, {gap(text("value * 1.1"), "event_id", "high")},
  {text("value * 0.9")} as low, {text("value")} as close, {text("value")} as adj_close,
  {gap(text("user_id * 1000.0"), "event_id", "volume")} from {{events}}""",
    dict(date="s", open="n", high="n", low="n", close="n", adj_close="n", volume="n"),
    """select case when date = 'NA' then 'NA' else replace(substr(date, 1, 10), '-', '/') end as date,
  round(cast(open as double), 3) as open_price, round(cast(high as double), 3) as daily_high,
  round(cast(low as double), 3) as daily_low, round(cast(close as double), 3) as close_price,
  cast(volume as double) / 1e6 as trade_volume_millions from src""",
)

register(
    "v02_chess_games",
    ["documents"],
    f"""select {text("doc_id")} as id, case when doc_id % 2 = 0 then 'TRUE' else 'False' end as rated,
  {text("doc_id * 60")} as created_at, {text("doc_id * 60 + 9")} as last_move_at, {gap(text("n_chars"), "doc_id", "turns")},
  {gap("source", "doc_id", "victory_status")},
  case doc_id % 3 when 0 then 'white' when 1 then 'black' else 'draw' end as winner, lang as increment_code,
  {text("doc_id + 7")} as white_id, {gap(text("n_chars + 1"), "doc_id", "white_rating")}, {text("doc_id + 8")} as black_id,
  {text("n_chars + 2")} as black_rating, {gap("text", "doc_id", "moves")}, lang as opening_eco,
  {gap("source", "doc_id", "opening_name")}, {text("doc_id % 20")} as opening_ply from {{documents}}""",
    dict(
        id="s", rated="s", created_at="n", last_move_at="n", turns="n", victory_status="s", winner="s", increment_code="s",
        white_id="s", white_rating="n", black_id="s", black_rating="n", moves="s", opening_eco="s", opening_name="s",
        opening_ply="n",
    ),
    """select id as game_id, case when lower(rated) = 'true' then 1 else 0 end as is_rated, created_at as start_time,
  last_move_at as end_time, turns as turns_taken, victory_status,
  case winner when 'white' then 'w' when 'black' then 'b' else winner end as winner, white_id as w_id,
  white_rating as w_rating, black_id as b_id, black_rating as b_rating,
  case when moves = 'NA' then 'NA' else regexp_replace(trim(moves), '\\s+', '-', 'g') end as moves_sequence,
  opening_name as opening_strategy_name from src""",
)

register(
    "v03_financial_audits",
    ["orders", "customer"],
    f"""select substr(cast(o_orderdate as string), 1, 4) as "Year", {gap("c_name", "o_orderkey", "Firm_Name")},
  {gap(text("o_orderkey"), "o_orderkey", "Total_Audit_Engagements")}, {text("c_custkey")} as "High_Risk_Cases",
  {text("c_nationkey")} as "Compliance_Violations", {text("o_custkey")} as "Fraud_Cases_Detected",
  {gap("c_mktsegment", "o_orderkey", "Industry_Affected")}, {text("o_totalprice")} as "Total_Revenue_Impact",
  case when o_orderstatus = 'F' then 'Yes' else 'No' end as "AI_Used_for_Auditing",
  {text("o_orderkey % 80")} as "Employee_Workload", {gap(text("o_totalprice"), "o_orderkey", "Audit_Effectiveness_Score")},
  {gap(text("c_acctbal"), "o_orderkey", "Client_Satisfaction_Score")}
  from {{orders}} join {{customer}} on o_custkey = c_custkey""",
    dict(
        Year="n", Firm_Name="s", Total_Audit_Engagements="n", High_Risk_Cases="n", Compliance_Violations="n",
        Fraud_Cases_Detected="n", Industry_Affected="s", Total_Revenue_Impact="n", AI_Used_for_Auditing="s",
        Employee_Workload="n", Audit_Effectiveness_Score="n", Client_Satisfaction_Score="n",
    ),
    """select "Year" as year, "Firm_Name" as firm_name, "Total_Audit_Engagements" as total_audit_engagement,
  "High_Risk_Cases" as high_risk_cases_count, "Compliance_Violations" as compliance_violations_count,
  "Fraud_Cases_Detected" as fraud_cases_count, "Industry_Affected" as industry_affected,
  "Total_Revenue_Impact" as revenue_impact_millions,
  case when lower("AI_Used_for_Auditing") = 'yes' then 1 else 0 end as ai_used,
  "Employee_Workload" as employee_workload_percent, "Audit_Effectiveness_Score" as audit_impact_score,
  "Client_Satisfaction_Score" as client_satisfaction_score,
  (cast("Audit_Effectiveness_Score" as double) + cast("Client_Satisfaction_Score" as double)) / 2 as overall_score from src""",
)

register(
    "v04_streaming_users",
    ["customer", "orders"],
    f"""select {text("o_orderkey")} as "User_ID",
  {gap("case when c_custkey % 4 = 0 then c_mktsegment else concat(c_mktsegment, ' ', c_name, ' Jr') end", "o_orderkey", "Name")},
  {gap(text("c_nationkey + 18"), "o_orderkey", "Age")}, {gap(text("c_nationkey"), "o_orderkey", "Country")},
  o_orderpriority as "Subscription_Type", {gap(text("c_acctbal"), "o_orderkey", "Watch_Time_Hours")},
  c_mktsegment as "Favorite_Genre", {gap("substr(cast(o_orderdate as string), 1, 10)", "o_orderkey", "Last_Login")}
  from {{orders}} join {{customer}} on o_custkey = c_custkey""",
    dict(
        User_ID="n", Name="s", Age="n", Country="s", Subscription_Type="s", Watch_Time_Hours="n", Favorite_Genre="s",
        Last_Login="s",
    ),
    """select "User_ID" as id, split_part("Name", ' ', 1) as first_name,
  case when "Name" = 'NA' then 'NA' when strpos("Name", ' ') > 0 then substr("Name", strpos("Name", ' ') + 1) else '' end as last_name,
  "Age" as age, "Country" as country_name, "Subscription_Type" as subscription,
  cast(ceil(cast("Watch_Time_Hours" as double) / 10) as bigint) * 10 as watch_time_hours,
  "Favorite_Genre" as favourite_genre,
  case when "Last_Login" = 'NA' then 'NA' else strftime(cast("Last_Login" as date), '%d-%B-%y') end as last_access from src""",
)

register(
    "v05_films",
    ["part", "lineitem"],
    f"""select {text("l_orderkey")} as "ID", {gap("p_name", "l_orderkey", "film")}, p_brand as film_rating, p_type as cinema_score,
  {gap("concat(substr(cast(l_shipdate as string), 9, 2), '/', substr(cast(l_shipdate as string), 6, 2), '/', substr(cast(l_shipdate as string), 1, 4))", "l_orderkey", "release_date")},
  {text("p_size")} as run_time, {gap(text("p_retailprice * 1000000"), "l_orderkey", "budget")},
  {text("l_quantity")} as box_office_other, {text("l_extendedprice")} as box_office_worldwide,
  {text("l_suppkey")} as rotten_tomatoes_score, {text("l_partkey")} as rotten_tomatoes_counts,
  {text("p_size")} as metacritic_score, {gap(text("p_size + 1"), "l_orderkey", "metacritic_counts")},
  {text("l_discount")} as imdb_score, {gap(text("l_partkey * 500"), "l_orderkey", "imdb_counts")}
  from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    dict(
        ID="n", film="s", film_rating="s", cinema_score="s", release_date="s", run_time="n", budget="n", box_office_other="n",
        box_office_worldwide="n", rotten_tomatoes_score="n", rotten_tomatoes_counts="n", metacritic_score="n",
        metacritic_counts="n", imdb_score="n", imdb_counts="n",
    ),
    """select "ID" as film_id, film as film_name, film_rating as watch_rating, cinema_score,
  case when release_date = 'NA' then 'NA' else strftime(strptime(release_date, '%d/%m/%Y'), '%Y-%B-%d') end as released_date,
  run_time as run_time_minutes, cast(budget as double) / 1e6 as budget_millions, box_office_worldwide as total_box_office,
  rotten_tomatoes_score, rotten_tomatoes_counts as rotten_tomatoes_counts_millions, metacritic_score,
  metacritic_counts as metacritic_counts_millions, imdb_score, cast(imdb_counts as double) / 1e3 as imdb_counts_millions from src""",
)

_watch = {
    "User ID": "n", "Heart Rate (BPM)": "n", "Blood Oxygen Level (%)": "n", "Step Count": "n", "Sleep Duration (hours)": "s",
    "Activity Level": "s", "Stress Level": "s",
}
register(
    "v06_smartwatch",
    ["events"],
    f"""select {text("event_id")} as "User ID", {text("value")} as "Heart Rate (BPM)",
  {text("value * 2")} as "Blood Oxygen Level (%)", {text("user_id * 10")} as "Step Count",
  case when event_id % 7 = 0 then 'ERROR' else {text("value")} end as "Sleep Duration (hours)",
  case event_id % 5 when 0 then ' Actve' when 1 then 'Highly_Active ' when 2 then 'Seddentary' when 3 then '' else upper(event_type) end
    as "Activity Level",
  case when event_id % 11 = 0 then '' else {text("user_id % 10 + 1")} end as "Stress Level" from {{events}}""",
    {f'"{c}"': k for c, k in _watch.items()},
    """select "User ID" as id, printf('%.1f', round(cast("Heart Rate (BPM)" as double), 1)) as heart_rate_bpm,
  printf('%.1f', round(cast("Blood Oxygen Level (%)" as double), 1)) as "blood_oxygen_level_%",
  printf('%.0f', round(cast("Step Count" as double), 0)) as step_count,
  coalesce(printf('%.1f', round(try_cast("Sleep Duration (hours)" as double), 1)), 'NA') as hours_slept,
  case when "Activity Level" = 'NA' then 'NA' else
    case lower(trim("Activity Level")) when 'actve' then 'active' when 'highly_active' then 'highly active'
      when 'seddentary' then 'sedentary' else lower(trim("Activity Level")) end end as activity_level,
  case when "Stress Level" = 'NA' then 'NA' when cast("Stress Level" as double) >= 8 then 'high'
    when cast("Stress Level" as double) between 4 and 7 then 'medium' else 'low' end as stress_level from src""",
)

register(
    "v07_ecommerce",
    ["lineitem", "part"],
    f"""select {text("l_orderkey")} as "InvoiceNo", {text("l_partkey")} as "StockCode",
  {gap("upper(p_name)", "l_orderkey", "Description")}, {gap(text("l_quantity"), "l_orderkey", "Quantity")},
  {gap("substr(cast(l_shipdate as string), 1, 19)", "l_orderkey", "InvoiceDate")}, {text("p_retailprice")} as "UnitPrice",
  {text("l_suppkey")} as "CustomerID", {gap("p_brand", "l_orderkey", "Country")}
  from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    dict(
        InvoiceNo="n", StockCode="s", Description="s", Quantity="n", InvoiceDate="s", UnitPrice="n", CustomerID="n", Country="s"
    ),
    """select "InvoiceNo" as invoice_number, "StockCode" as stock_code,
  case when "Description" = 'NA' then 'NA' else lower("Description") end as "desc", "Quantity" as qty,
  case when "InvoiceDate" = 'NA' then 'NA' else strftime(cast("InvoiceDate" as timestamp), '%d-%m-%y %H-%M-%S') end as invoice_date,
  "UnitPrice" as unit_price, "CustomerID" as customer_id,
  case when "Country" = 'NA' then 'NA' else lower("Country") end as country from src""",
)

_grades = {
    "Student_ID": "s", "Email": "s", "Gender": "s", "Age": "n", "Department": "s", "Attendance (%)": "n", "Midterm_Score": "n",
    "Final_Score": "n", "Assignments_Avg": "n", "Quizzes_Avg": "n", "Projects_Score": "n", "Total_Score": "n", "Grade": "s",
    "Study_Hours_per_Week": "n", "Extracurricular_Activities": "s", "Internet_Access_at_Home": "s",
    "Parent_Education_Level": "s", "Family_Income_Level": "s", "Stress_Level (1-10)": "n", "Sleep_Hours_per_Night": "n",
    "First_Name": "s", "Last_Name": "s", "Participation_Score": "n",
}
_grade_cells = {c: text("c_acctbal") for c, k in _grades.items() if k == "n"} | {
    "Student_ID": "concat('S', cast(c_custkey as string))",
    "Email": "concat(lower(c_name), '@example.org')",
    "Gender": "c_mktsegment",
    "Age": text("c_nationkey"),
    "Department": "c_mktsegment",
    "Grade": "substr(c_mktsegment, 1, 1)",
    "Extracurricular_Activities": "case when quality = 1 then 'Yes' else 'No' end",
    "Internet_Access_at_Home": "case when toxic = 1 then 'YES' else 'no' end",
    "Parent_Education_Level": "c_mktsegment",
    "Family_Income_Level": "c_mktsegment",
    "First_Name": "case when c_custkey % 3 = 0 then '' else c_name end",
    "Last_Name": "case when c_custkey % 5 = 0 then '' else c_mktsegment end",
}
register(
    "v08_student_grades",
    ["customer", "labels"],
    "select " + ", ".join(f'{cell} as "{c}"' for c, cell in _grade_cells.items())
    + " from {customer} left join {labels} on c_custkey = doc_id",
    {f'"{c}"': k for c, k in _grades.items()},
    """select "Student_ID" as student_id, "Email" as student_email, "Gender" as student_gender, "Age" as student_age,
  "Department" as dept, "Attendance (%)" as attendance_percent, "Midterm_Score" as midterm_score,
  "Final_Score" as final_score, "Assignments_Avg" as assignments_avg, "Quizzes_Avg" as quizzes_avg,
  "Projects_Score" as projects_score, "Total_Score" as student_total_score, "Grade" as grade,
  "Study_Hours_per_Week" as weekly_study_hours,
  case when lower("Extracurricular_Activities") = 'yes' then 1 else 0 end as takes_extracurriculars,
  case when lower("Internet_Access_at_Home") = 'yes' then 1 else 0 end as has_home_internet,
  "Parent_Education_Level", "Family_Income_Level", "Stress_Level (1-10)", "Sleep_Hours_per_Night",
  case when "First_Name" = 'NA' or "Last_Name" = 'NA' then 'NA' else concat("First_Name", ' ', "Last_Name") end as full_name from src""",
)

register(
    "v09_news",
    ["documents", "orders"],
    f"""select text as short_description, {gap("upper(source)", "doc_id", "category")},
  {gap("substr(cast(o_orderdate as string), 1, 10)", "doc_id", "date")}, {gap("lang", "doc_id", "authors")},
  concat('https://example.org/', cast(doc_id as string)) as link, text as headline
  from {{documents}} join {{orders}} on doc_id = o_orderkey""",
    dict(short_description="s", category="s", date="s", authors="s", link="s", headline="s"),
    """select case when category = 'NA' then 'NA' else lower(category) end as category, headline, authors, link as article_link,
  case when date = 'NA' then 'NA' else strftime(cast(date as date), '%d-%B-%Y') end as published_date from src""",
)

register(
    "v10_social_posts",
    ["conversations"],
    f"""select {text("turn")} as line_count, {text("conv_id")} as engagement,
  {gap("upper(role)", "conv_id * 100 + turn", "tone")}, {gap("text", "conv_id * 100 + turn", "text")},
  case when turn % 5 = 4 then null else split(text, ' ') end as tags, role as language from {{conversations}}""",
    dict(line_count="n", engagement="n", tone="s", text="s", tags="x", language="s"),
    """select text as post_content, engagement as user_engagement, language as post_language,
  coalesce(array_to_string(tags, ', '), 'NA') as post_tags, case when tone = 'NA' then 'NA' else lower(tone) end as tone,
  case when text = 'NA' then 0 else cast(length(text) as integer) end as post_character_count from src""",
)

register(
    "v11_recipes",
    ["documents"],
    f"""select split(text, ' ') as ingredients, {text("doc_id")} as id, {gap("lang", "doc_id", "cuisine")} from {{documents}}""",
    dict(ingredients="x", id="n", cuisine="s"),
    """select id as recipe_id, cuisine, array_to_string(ingredients, '| ') as ingredients_list from src""",
)

register(
    "v12_flight_routes",
    ["supplier", "nation"],
    f"""select {text("s_acctbal")} as dst_lat, {text("s_suppkey")} as src_lat, {gap(text("s_acctbal"), "s_suppkey", "dst_lon")},
  {text("s_nationkey")} as src_lon, concat(n_name, ' City ', substr(md5(n_name), 1, 3)) as dst,
  {gap("concat(s_name, ' ', upper(substr(md5(s_name), 1, 3)))", "s_suppkey", "src")}
  from {{supplier}} join {{nation}} on s_nationkey = n_nationkey""",
    dict(dst_lat="n", src_lat="n", dst_lon="n", src_lon="n", dst="s", src="s"),
    """select split_part(src, ' ', 1) as source, split_part(dst, ' ', 1) as destination, src_lat as source_latitude,
  src_lon as source_longitude, dst_lat as destination_latitude, dst_lon as destination_longitude,
  list_last(string_split(src, ' ')) as source_airport_code, list_last(string_split(dst, ' ')) as destination_airport_code from src""",
)

register(
    "v13_product_reviews",
    ["documents", "orders"],
    f"""select text as summary, concat('R', cast(o_custkey as string)) as "reviewerID",
  {gap("concat(substr(cast(o_orderdate as string), 6, 2), ' ', cast(cast(substr(cast(o_orderdate as string), 9, 2) as integer) as string), ', ', substr(cast(o_orderdate as string), 1, 4))", "doc_id", "reviewTime")},
  {text("doc_id")} as "unixReviewTime", {gap(text("n_chars"), "doc_id", "overall")}, text as "reviewText",
  {gap("source", "doc_id", "reviewerName")}, concat('B', cast(doc_id as string)) as asin
  from {{documents}} join {{orders}} on doc_id = o_orderkey""",
    dict(
        summary="s", reviewerID="s", reviewTime="s", unixReviewTime="n", overall="n", reviewText="s", reviewerName="s", asin="s"
    ),
    """select "reviewerID" as reviewer_id, asin as amazon_id, "reviewerName" as user_name,
  case when "reviewTime" = 'NA' then 'NA' else strftime(strptime("reviewTime", '%m %d, %Y'), '%d-%m-%Y') end as review_date,
  overall as overall_review_score, lower(trim(summary)) as summary from src""",
)
