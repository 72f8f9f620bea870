"""Queries of problem 3, mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.instants import normal_form
from siftline.sources.tables import read


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, field_name, value, zone): every dated field of both tables, from one scan each."""
    state = read(spark, d, "cfp_state").select(
        F.lit("cfp_state").alias("table_name"), F.col("ord").alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("deadline", "conf_date")])).alias("x"),
    ).select("table_name", "row_id", "x.field_name", "x.value", F.lit(None).cast("string").alias("zone"))
    results = read(spark, d, "event_results").select(
        F.lit("event_results").alias("table_name"), F.col("check_id").alias("row_id"), F.lit("cfp_end_local").alias("field_name"), F.col("cfp_end_local").alias("value"), F.col("timezone").alias("zone")
    )
    return state.unionByName(results).where(F.col("value").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value that has an unambiguous form; the others give no row."""
    return normal_form(stacked(spark, d), "value", "zone").where(F.col("normal_form").isNotNull()).select("table_name", "row_id", "field_name", "normal_form")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table and field: values, how many became a date, an instant, or nothing."""
    f = F.col("normal_form")
    return normal_form(stacked(spark, d), "value", "zone").groupBy("table_name", "field_name").agg(
        F.count("*").alias("n_values"), F.count_if(F.length(f) == 10).alias("n_dates"), F.count_if(F.length(f) > 10).alias("n_instants"), F.count_if(f.isNull()).alias("n_unresolved")
    )


def p3_iso(spark: SparkSession, d: str) -> DataFrame:
    """The normal forms of values that are plain ISO dates, or instants in UTC."""
    found = normal_form(stacked(spark, d), "value", "zone").where(F.col("normal_form").isNotNull() & F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?\z"))
    return found.select("table_name", "row_id", "field_name", "normal_form")


_ALL = "SELECT 'cfp_state' AS table_name, ord AS row_id, 'deadline' AS field_name, deadline AS v FROM cfp_state UNION ALL SELECT 'cfp_state', ord, 'conf_date', conf_date FROM cfp_state UNION ALL SELECT 'event_results', check_id, 'cfp_end_local', cfp_end_local FROM event_results"
P3_ISO = rf"""SELECT table_name, row_id, field_name, CASE WHEN length(v) = 10 THEN strftime(try_cast(v AS DATE), '%Y-%m-%d') ELSE strftime(try_strptime(v, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') END AS normal_form FROM ({_ALL})
  WHERE regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}}Z)?$') AND CASE WHEN length(v) = 10 THEN try_cast(v AS DATE) IS NOT NULL ELSE try_strptime(v, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL END"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_iso": p3_iso}
SQL: dict[str, str] = {"p3_iso": P3_ISO}
