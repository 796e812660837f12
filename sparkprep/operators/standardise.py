"""Value standardisation of thirteen known layouts.

Each function takes an imputed source table and returns the target layout in one
projection; ``NA`` cells pass through. The source and target column names, labels
and date patterns are fixed values of the layouts. Where published examples and rules differ,
the example decides, then the rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions import scalars as S
from sparkprep.functions.cells import quoted


def _layout(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Target columns in order; text names a source column taken as it is."""
    return df.select(*[(quoted(c) if isinstance(c, str) else c).alias(t) for t, c in columns.items()])


def stock_prices(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "date": S.reformat_local_date(F.col("date"), "yyyy/MM/dd"),
            "open_price": S.rounded(F.col("open"), 3),
            "daily_high": S.rounded(F.col("high"), 3),
            "daily_low": S.rounded(F.col("low"), 3),
            "close_price": S.rounded(F.col("close"), 3),
            "trade_volume_millions": S.scale(F.col("volume"), 1e6),
        },
    )


def chess_games(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "game_id": "id",
            "is_rated": S.flag(F.col("rated"), "true"),
            "start_time": "created_at",
            "end_time": "last_move_at",
            "turns_taken": "turns",
            "victory_status": "victory_status",
            "winner": S.map_values(F.col("winner"), {"white": "w", "black": "b"}),
            "w_id": "white_id",
            "w_rating": "white_rating",
            "b_id": "black_id",
            "b_rating": "black_rating",
            "moves_sequence": S.dashed(F.col("moves")),
            "opening_strategy_name": "opening_name",
        },
    )


def financial_audits(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "year": "Year",
            "firm_name": "Firm_Name",
            "total_audit_engagement": "Total_Audit_Engagements",
            "high_risk_cases_count": "High_Risk_Cases",
            "compliance_violations_count": "Compliance_Violations",
            "fraud_cases_count": "Fraud_Cases_Detected",
            "industry_affected": "Industry_Affected",
            "revenue_impact_millions": "Total_Revenue_Impact",
            "ai_used": S.flag(F.col("AI_Used_for_Auditing"), "yes"),
            "employee_workload_percent": "Employee_Workload",
            "audit_impact_score": "Audit_Effectiveness_Score",
            "client_satisfaction_score": "Client_Satisfaction_Score",
            "overall_score": S.mean_of(F.col("Audit_Effectiveness_Score"), F.col("Client_Satisfaction_Score")),
        },
    )


def streaming_users(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "id": "User_ID",
            "first_name": S.first_part(F.col("Name")),
            "last_name": S.rest_part(F.col("Name")),
            "age": "Age",
            "country_name": "Country",
            "subscription": "Subscription_Type",
            "watch_time_hours": S.round_up_to(F.col("Watch_Time_Hours"), 10),
            "favourite_genre": "Favorite_Genre",
            "last_access": S.reformat_date(F.col("Last_Login"), "yyyy-MM-dd", "dd-MMMM-yy"),
        },
    )


def films(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "film_id": "ID",
            "film_name": "film",
            "watch_rating": "film_rating",
            "cinema_score": "cinema_score",
            "released_date": S.reformat_date(F.col("release_date"), "dd/MM/yyyy", "yyyy-MMMM-dd"),
            "run_time_minutes": "run_time",
            "budget_millions": S.scale(F.col("budget"), 1e6),
            "total_box_office": "box_office_worldwide",
            "rotten_tomatoes_score": "rotten_tomatoes_score",
            "rotten_tomatoes_counts_millions": "rotten_tomatoes_counts",
            "metacritic_score": "metacritic_score",
            "metacritic_counts_millions": "metacritic_counts",
            "imdb_score": "imdb_score",
            # The published example shows thousands under this name.
            "imdb_counts_millions": S.scale(F.col("imdb_counts"), 1e3),
        },
    )


# Known misspellings of activity levels and their correction.
ACTIVITY_SPELLINGS = {
    "actve": "active",
    "highly_active": "highly active",
    "seddentary": "sedentary",
}


def smartwatch(df: DataFrame, spellings: dict[str, str] = ACTIVITY_SPELLINGS) -> DataFrame:
    return _layout(
        df,
        {
            "id": "User ID",
            "heart_rate_bpm": S.rounded_text(F.col("Heart Rate (BPM)"), 1),
            "blood_oxygen_level_%": S.rounded_text(F.col("Blood Oxygen Level (%)"), 1),
            "step_count": S.rounded_text(F.col("Step Count"), 0),
            "hours_slept": S.rounded_text(F.col("Sleep Duration (hours)"), 1),
            "activity_level": S.map_values(S.lower_trim(F.col("Activity Level")), spellings),
            "stress_level": S.bucket(
                F.col("Stress Level"), [(8, float("inf"), "high"), (4, 7, "medium")], otherwise="low"
            ),
        },
    )


def ecommerce(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "invoice_number": "InvoiceNo",
            "stock_code": "StockCode",
            "desc": S.lower(F.col("Description")),
            "qty": "Quantity",
            "invoice_date": S.reformat_date(F.col("InvoiceDate"), "yyyy-MM-dd HH:mm:ss", "dd-MM-yy HH-mm-ss"),
            "unit_price": "UnitPrice",
            "customer_id": "CustomerID",
            "country": S.lower(F.col("Country")),
        },
    )


def student_grades(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "student_id": "Student_ID",
            "student_email": "Email",
            "student_gender": "Gender",
            "student_age": "Age",
            "dept": "Department",
            "attendance_percent": "Attendance (%)",
            "midterm_score": "Midterm_Score",
            "final_score": "Final_Score",
            "assignments_avg": "Assignments_Avg",
            "quizzes_avg": "Quizzes_Avg",
            "projects_score": "Projects_Score",
            "student_total_score": "Total_Score",
            "grade": "Grade",
            "weekly_study_hours": "Study_Hours_per_Week",
            "takes_extracurriculars": S.flag(F.col("Extracurricular_Activities"), "yes"),
            "has_home_internet": S.flag(F.col("Internet_Access_at_Home"), "yes"),
            "Parent_Education_Level": "Parent_Education_Level",
            "Family_Income_Level": "Family_Income_Level",
            "Stress_Level (1-10)": "Stress_Level (1-10)",
            "Sleep_Hours_per_Night": "Sleep_Hours_per_Night",
            "full_name": S.join_text(F.col("First_Name"), F.col("Last_Name")),
        },
    )


def news(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "category": S.lower(F.col("category")),
            "headline": "headline",
            "authors": "authors",
            "article_link": "link",
            "published_date": S.reformat_date(F.col("date"), "yyyy-MM-dd", "dd-MMMM-yyyy"),
        },
    )


def social_posts(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "post_content": "text",
            "user_engagement": "engagement",
            "post_language": "language",
            "post_tags": S.join_list(df, "tags", ", "),
            "tone": S.lower(F.col("tone")),
            "post_character_count": S.text_length(F.col("text")),
        },
    )


def recipes(df: DataFrame) -> DataFrame:
    return _layout(
        df, {"recipe_id": "id", "cuisine": "cuisine", "ingredients_list": S.join_list(df, "ingredients", "| ")}
    )


def flight_routes(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "source": S.first_part(F.col("src")),
            "destination": S.first_part(F.col("dst")),
            "source_latitude": "src_lat",
            "source_longitude": "src_lon",
            "destination_latitude": "dst_lat",
            "destination_longitude": "dst_lon",
            "source_airport_code": S.last_word(F.col("src")),
            "destination_airport_code": S.last_word(F.col("dst")),
        },
    )


def product_reviews(df: DataFrame) -> DataFrame:
    return _layout(
        df,
        {
            "reviewer_id": "reviewerID",
            "amazon_id": "asin",
            "user_name": "reviewerName",
            "review_date": S.reformat_date(F.col("reviewTime"), "MM d, yyyy", "dd-MM-yyyy"),
            "overall_review_score": "overall",
            "summary": S.lower_trim(F.col("summary")),
        },
    )


LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        stock_prices,
        chess_games,
        financial_audits,
        streaming_users,
        films,
        smartwatch,
        ecommerce,
        student_grades,
        news,
        social_posts,
        recipes,
        flight_routes,
        product_reviews,
    )
}
