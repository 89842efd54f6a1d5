"""Evaluation scores of predictions against golden answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.text import collapse_space, strip
from cedarlog.operators.retrieval import jaccard
from cedarlog.operators.rules import validate_rules

# Difference of means that decides a comparison.
MARGIN = 0.1
FIRST_BETTER, SECOND_BETTER, EQUAL = "first", "second", "equal"


def normal_sql(sql: Column) -> Column:
    return collapse_space(strip(F.lower(sql)))


def sql_score(predicted: Column, expected: Column) -> Column:
    """1 when both texts are equal but for case and white space; no prediction scores 0."""
    same = F.coalesce(normal_sql(predicted) == normal_sql(expected), F.lit(False))
    return F.when((F.length(predicted) > 0) & same, 1.0).otherwise(0.0)


def answer_score(predicted: Column, expected: Column) -> Column:
    """Share of words that both texts have."""
    return jaccard(F.coalesce(predicted, F.lit("")), F.coalesce(expected, F.lit("")))


def regex_scores(samples: DataFrame, predictions: DataFrame, line: str = "line") -> DataFrame:
    """``id, score``: 1 when the predicted pattern matches all samples of its item.

    ``samples`` holds ``id`` and the line, ``predictions`` ``id`` and ``predicted``. Any
    pattern that compiles may win, named groups or not.
    """
    rules = predictions.filter(F.length("predicted") > 0).select(
        F.col("id").alias("service_name"), F.lit(1).alias("attempt"), F.col("predicted").alias("pattern")
    )
    checked = validate_rules(
        samples.withColumnRenamed("id", "service_name"), rules, line, need_names=False
    ).select(F.col("service_name").alias("id"), "ok")
    return predictions.select("id").join(checked, "id", "left").select(
        "id", F.coalesce(F.col("ok"), F.lit(False)).cast("double").alias("score")
    )


def evaluate(golden: DataFrame, predictions: DataFrame, score) -> DataFrame:
    """``id, score, predicted, expected`` for every golden item, also those without prediction."""
    return golden.join(predictions, "id", "left").select(
        "id", score(F.col("predicted"), F.col("expected")).alias("score"), "predicted", "expected"
    )


def mean_score(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("items"), F.round(F.avg("score"), 6).alias("mean"))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Means of two runs, their difference and a verdict, in one aggregate over both."""
    both = first.select("score", F.lit(1).alias("run")).unionByName(
        second.select("score", F.lit(2).alias("run"))
    )
    mean = lambda run: F.avg(F.when(F.col("run") == run, F.col("score")))
    means = both.agg(mean(1).alias("a"), mean(2).alias("b"))
    diff = F.col("a") - F.col("b")
    return means.select(
        F.round("a", 6).alias("first_mean"),
        F.round("b", 6).alias("second_mean"),
        F.round(diff, 6).alias("difference"),
        F.when(diff > MARGIN, FIRST_BETTER)
        .when(diff < -MARGIN, SECOND_BETTER)
        .otherwise(EQUAL)
        .alias("verdict"),
    )
