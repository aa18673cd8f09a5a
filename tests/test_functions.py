from pyspark.sql import functions as F

from hazeframe.functions import scalars as S


def _eval(spark, values, fn, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_hazard_levels(spark):
    vals = [None, 0.0, 12.0, 12.01, 35.4, 35.41, 55.4, 150.4, 150.5, 999.0]
    assert _eval(spark, vals, S.hazard_level) == [
        None, "good", "good", "moderate", "moderate", "unhealthy_sensitive", "unhealthy_sensitive",
        "unhealthy", "hazardous", "hazardous"]


def test_pm25_level_is_right_closed(spark):
    vals = [0.0, 0.01, 12.0, 35.4, 500.0, 500.1, -1.0, None]
    assert _eval(spark, vals, S.pm25_level) == ["good" if False else None, "good", "good", "moderate",
                                                "hazardous", None, None, None]


def test_time_of_day_and_period_differ_at_boundaries(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    assert _eval(spark, hours, S.time_of_day, "int") == ["night", "night", "morning", "morning", "afternoon",
                                                         "afternoon", "evening", "evening"]
    assert _eval(spark, hours, S.time_period, "int") == ["night", "night", "night", "morning", "morning",
                                                         "afternoon", "afternoon", "evening"]


def test_season(spark):
    assert _eval(spark, list(range(1, 13)), S.season_of, "int") == [
        "dry", "dry", "transition", "transition", "wet", "wet", "wet", "wet", "wet", "wet", "dry", "dry"]


def test_weekday_monday_is_zero(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string")
    assert [r[0] for r in df.select(S.weekday_of(F.to_date("d"))).collect()] == [0, 6]


def test_found_count(spark):
    assert _eval(spark, [">1000", "42", None, "abc", "0"], S.found_count, "string") == [1001, 42, 0, 0, 0]


def test_round_half_even_and_capitalize(spark):
    assert _eval(spark, [0.125, 0.135, 2.5], lambda c: S.round_half_even(c, 2)) == [0.12, 0.14, 2.5]
    assert _eval(spark, ["dry", "TRANSITION"], S.capitalize, "string") == ["Dry", "Transition"]


def test_nonfinite_to_null(spark):
    vals = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert _eval(spark, vals, S.finite_or_null) == [1.0, None, None, None, None]
