"""Feedback: distributions, themes, opportunities, users' satisfaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import lexicons as L
from corvina.functions import text as T
from corvina.operators.analytics import first_last


def labelled(feedback: DataFrame) -> DataFrame:
    """Adds sentiment, category, comment_length, detailed; ratings are brought into 1 to 5."""
    rating = F.least(F.greatest(F.col("rating"), F.lit(1)), F.lit(5))
    out = feedback.withColumn("rating", rating)
    length = F.length(F.coalesce("comment", F.lit("")))
    return out.select("*", T.sentiment(F.col("comment")).alias("sentiment"), T.feedback_category(F.col("rating"), F.col("comment")).alias("feedback_category"), length.alias("comment_length"), (length > 20).alias("detailed"))


def summary(feedback: DataFrame) -> DataFrame:
    """One row: n, mean, population standard deviation from whole-number sums, users, sentiments."""
    s1, s2, n = F.sum("rating"), F.sum(F.col("rating") * F.col("rating")), F.count("*")
    one = labelled(feedback).agg(n.alias("n"), s1.alias("s1"), s2.alias("s2"), F.count_distinct("user_id").alias("n_users"), *[F.count(F.when(F.col("sentiment") == x, 1)).alias(f"n_{x}") for x in ("positive", "neutral", "negative")], F.count(F.when(F.col("detailed"), 1)).alias("n_detailed"))
    mean = F.col("s1") / F.col("n")
    return one.select("n", mean.alias("mean_rating"), F.sqrt((F.col("s2") * F.col("n") - F.col("s1") * F.col("s1")) / (F.col("n") * F.col("n"))).alias("std_rating"), "n_users", "n_positive", "n_neutral", "n_negative", "n_detailed")


def themes(feedback: DataFrame, most: int = 5) -> DataFrame:
    """word, n: the most frequent words over three letters outside the stop list, those of them that
    occur more than once. Ties go to the word that sorts first."""
    word = F.explode(F.filter(T.words(F.lower("comment")), lambda w: (F.length(w) > 3) & ~w.isin(L.THEME_STOP)))
    counts = feedback.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(most).where("n > 1")


def opportunities(feedback: DataFrame) -> DataFrame:
    """feedback_category, n, priority: the three complaint classes with most rows, high over 10 % of
    all; and negative_sentiment if over 20 % of all comments are negative."""
    rows = labelled(feedback)
    total = rows.agg(F.count("*").alias("total"), F.count(F.when(F.col("sentiment") == "negative", 1)).alias("n_negative"))
    complaints = rows.where(F.col("feedback_category").endswith("complaint") | (F.col("feedback_category") == "general_dissatisfaction")).groupBy("feedback_category").agg(F.count("*").alias("n"))
    top = complaints.orderBy(F.desc("n"), "feedback_category").limit(3).crossJoin(F.broadcast(total))
    top = top.select("feedback_category", "n", F.when(F.col("n") > 0.1 * F.col("total"), "high").otherwise("medium").alias("priority"))
    extra = total.where(F.col("n_negative") > 0.2 * F.col("total")).select(F.lit("negative_sentiment").alias("feedback_category"), F.col("n_negative").alias("n"), F.lit("high").alias("priority"))
    return top.unionByName(extra)


def satisfaction(feedback: DataFrame) -> DataFrame:
    """Per user with two ratings or more: first, last, trend (half a point and more either way)."""
    at = F.struct("ts", "query_id")
    out = feedback.groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("rating", at).alias("first_rating"), F.max_by("rating", at).alias("last_rating")).where("n >= 2")
    move = F.col("last_rating") - F.col("first_rating")
    return out.withColumn("trend", F.when(move > 0.5, "improving").when(move < -0.5, "declining").otherwise("stable"))


def user_summary(feedback: DataFrame) -> DataFrame:
    """Per user: n, sum, least and most rating, and means of the first and last three."""
    ends = first_last(feedback, ["user_id"], ["ts", "query_id"], "rating", 3)
    mean = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(c)
    ends = ends.select(F.col("user_id").alias("_user"), mean("first").alias("first_three"), mean("last").alias("last_three"))
    sums = feedback.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.min("rating").alias("least"), F.max("rating").alias("most"))
    return sums.join(ends, F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user")
