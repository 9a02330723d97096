"""As-of lookup: the credit score known at the end of each report month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankflow.functions import month_of, next_month, sorted_set
from bankflow.operators.scaffold import month_list

_TIE = "score_id"


def scores_before(scores: DataFrame, months: DataFrame) -> DataFrame:
    """Every score beside every report month that ends after it.

    The months come from an array, so this is a projection of the scores and not a range join. Its
    output grows with scores times months; :func:`asof_latest` reduces the scores first.
    """
    carried = scores.columns
    return (
        scores.withColumn("_months", month_list(months))
        .withColumn(
            "_later", F.filter("_months", lambda m: F.col("score_date") < next_month(m))
        )
        .select(F.explode_outer("_later").alias("month_start"), *carried)
        .filter(F.col("month_start").isNotNull())
    )


def latest_per_score_month(scores: DataFrame) -> DataFrame:
    """The last score of each customer in each calendar month."""
    return _newest(
        scores.withColumn("month_start", month_of("score_date")), "customer_id", "month_start"
    )


def month_steps(months: DataFrame) -> DataFrame:
    """For each calendar month in the range of the report months, which of them is the first not before it.

    ``_index`` counts the report months from one. At most twelve rows a year, so it may be broadcast at any
    data size.
    """
    span = months.agg(
        F.min("month_start").alias("_first"),
        F.max("month_start").alias("_last"),
        sorted_set("month_start").alias("_months"),
    )
    calendar = F.explode(F.sequence("_first", "_last", F.expr("interval 1 month")))
    earlier = F.filter("_months", lambda m: m < F.col("_calendar"))
    return span.select("_months", calendar.alias("_calendar")).select(
        "_calendar", (F.size(earlier) + 1).alias("_index")
    )


def score_marks(scores: DataFrame, months: DataFrame) -> DataFrame:
    """The newest score a customer has gained by each report month where it changes.

    A score takes effect in the first report month that ends after it (``_index``). Scores after the last
    report month are never known in time and drop out. The result has at most one row per customer and
    report month. The raw scores meet the report months in a hash lookup by calendar month, and are reduced
    in each task before they are shuffled.
    """
    first = months.agg(F.min("month_start")).scalar()
    effective = (
        scores.filter(F.col("score_date").isNotNull())
        .withColumn("_calendar", F.greatest(month_of("score_date"), first))
        .join(F.broadcast(month_steps(months)), "_calendar")
        .drop("_calendar")
    )
    return _newest(effective, "customer_id", "_index")


def asof_latest(scores: DataFrame, months: DataFrame, method: str = "interval") -> DataFrame:
    """Latest score per customer and report month, for months at or after the first score.

    ``interval`` keeps one score per customer and effective month, finds where the next one takes
    over, and writes the report months in between: one output row per result.
    ``rank`` lists, for each customer and report month, all of the customer's reduced scores that are
    candidates, newest first, and keeps the first; it is the check of the first form. A customer has at
    most one reduced score per calendar month, so the candidates stay inside a row: no pair is shuffled.
    """
    if method == "interval":
        per_customer = Window.partitionBy("customer_id").orderBy("_index")
        listed = month_list(months)
        until = F.coalesce(F.lead("_index").over(per_customer), F.size(listed) + 1)
        return (
            score_marks(scores, months)
            .withColumn("_valid", F.slice(listed, F.col("_index"), until - F.col("_index")))
            .select(
                F.explode_outer("_valid").alias("month_start"),
                "customer_id", "score_date", "probability_of_default",
            )
            .filter(F.col("month_start").isNotNull())
        )
    if method == "rank":
        reduced = latest_per_score_month(scores).filter(F.col("score_date").isNotNull())
        score = F.struct("score_date", "probability_of_default")
        # Dates differ between calendar months, so the date alone settles the order.
        ranked = reduced.groupBy("customer_id").agg(
            F.sort_array(F.collect_list(score), asc=False).alias("_ranked")
        )
        ends = F.transform(
            "_months", lambda m: F.struct(m.alias("month_start"), next_month(m).alias("end"))
        )
        newest = F.transform(
            "_ends",
            lambda e: F.struct(
                e.month_start.alias("month_start"),
                F.get(F.filter("_ranked", lambda s: s.score_date < e.end), 0).alias("score"),
            ),
        )
        return (
            ranked.withColumn("_months", month_list(months))
            .withColumn("_ends", ends)
            .select("customer_id", F.explode_outer(newest).alias("_newest"))
            .filter(F.col("_newest.score").isNotNull())
            .select(
                "_newest.month_start", "customer_id",
                "_newest.score.score_date", "_newest.score.probability_of_default",
            )
        )
    raise ValueError(f"unknown method {method!r}")


def _newest(scores: DataFrame, *keys: str) -> DataFrame:
    """Row with the latest score date per key; pruned to one row per key before the shuffle."""
    order = [F.desc_nulls_first("score_date")]
    if _TIE in scores.columns:
        order.append(F.desc_nulls_last(_TIE))
    order.append(F.desc_nulls_last("probability_of_default"))
    newest = Window.partitionBy(*keys).orderBy(*order)
    return (
        scores.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
    )
