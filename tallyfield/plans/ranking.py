"""Rankings: loading, the yearly panel, score changes around a subscription, and the donor pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import strict_weighted_avg
from tallyfield.functions.text import join_key, parse_number, range_midpoint
from tallyfield.operators.joins import null_safe_join, unmatched, yearly_spine
from tallyfield.operators.ordered import change_from_previous
from tallyfield.operators.typing import type_numbers
from tallyfield.session import materialised

# Source columns of a ranking document and the names they get.
RENAMED = {
    "rank_order": "world_rank",
    "name": "university_name",
    "location": "country",
    "scores_teaching": "teaching",
    "scores_international_outlook": "international",
    "scores_research": "research",
    "scores_citations": "citations",
    "scores_industry_income": "income",
    "scores_overall": "total_score",
    "stats_number_students": "num_students",
    "stats_student_staff_ratio": "student_staff_ratio",
    "stats_pc_intl_students": "international_students",
    "stats_female_male_ratio": "female_male_ratio",
    "year": "year",
}


def load_rankings(documents: DataFrame, history: DataFrame) -> DataFrame:
    """Landed ranking rows cleaned, typed, renamed and stacked on the finished history."""
    scored = documents.select(*RENAMED).withColumn("scores_overall", range_midpoint(F.col("scores_overall")))
    scored = materialised(scored, "scored")  # typing reads it twice: once to profile, once to convert
    typed = type_numbers(scored, keep=("name", "location")).withColumn("rank_order", F.col("rank_order") / 10)
    recent = typed.select(*[F.col(old).alias(new) for old, new in RENAMED.items()])
    earlier = history.withColumn("total_score", parse_number(F.col("total_score")))
    return earlier.unionByName(recent)


def keyed(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("name", join_key(F.col(source)))


def score_panel(subscriptions: DataFrame, rankings: DataFrame, first: int, last: int) -> DataFrame:
    """Entity x year panel of rank, score and decision, ranked entities only, gaps filled down then up.

    Subscriptions may hold any number of rows per entity and year. Equal rows are counted first and carried as
    `n_rows`, so the fills run over one row per entity and year and no entity's rows are gathered. Within a year
    missing values take the year's highest known one; later years hand on their highest, earlier years receive the
    lowest of the next known year.
    """
    subs = materialised(
        keyed(subscriptions, "parent_account")
        .groupBy("parent_account", "name", "year", "decision")
        .agg(F.count(F.lit(1)).alias("n")),
        "events",
    )
    names = subs.select("parent_account", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("variants"))
    events = subs.groupBy("name", "year", "decision").agg(F.sum("n").alias("n_events"))
    ranks = materialised(
        keyed(rankings, "university_name")
        .groupBy("name", "year", "world_rank", "total_score")
        .agg(F.count(F.lit(1)).alias("n_ranks")),
        "ranks",
    )
    known = ranks.groupBy("name", "year").agg(
        *[f(c).alias(f"{c}_{tag}") for c in ("world_rank", "total_score") for f, tag in ((F.max, "high"), (F.min, "low"))]
    )
    spine = null_safe_join(yearly_spine(names, first, last), known, ["name", "year"])
    w = Window.partitionBy("name").orderBy("year")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

    def carried(c: str):
        return F.coalesce(
            F.last(f"{c}_high", ignorenulls=True).over(back), F.first(f"{c}_low", ignorenulls=True).over(ahead)
        )

    filled = (
        spine.withColumn("ranked_years", F.count("world_rank_high").over(Window.partitionBy("name")))
        .where(F.col("ranked_years") > 0)
        .select("name", "year", "variants", carried("world_rank").alias("rank_fill"), carried("total_score").alias("score_fill"))
    )
    joined = null_safe_join(null_safe_join(filled, events, ["name", "year"]), ranks, ["name", "year"])
    one = F.lit(1)
    return (
        joined.select(
            "name",
            "year",
            F.coalesce("world_rank", "rank_fill").alias("world_rank"),
            F.coalesce("total_score", "score_fill").alias("total_score"),
            F.coalesce("decision", F.lit(0)).alias("decision"),
            F.col("decision").alias("decision_raw"),
            (F.col("variants") * F.coalesce("n_events", one) * F.coalesce("n_ranks", one)).alias("n"),
        )
        .groupBy("name", "year", "world_rank", "total_score", "decision", "decision_raw")
        .agg(F.sum("n").alias("n_rows"))
    )


def score_changes(panel: DataFrame, left_out_year: int) -> DataFrame:
    """Mean score per entity and decision, less the mean before; entities without both states drop out."""
    means = (
        panel.where(F.col("year") != left_out_year)
        .groupBy("name", "decision")
        .agg(strict_weighted_avg(F.col("total_score"), F.col("n_rows")).alias("avg_score"))
    )
    changes = change_from_previous(means, "avg_score", ["name"], "decision", "diff_after")
    return changes.where(F.col("diff_after").isNotNull()).withColumn("increase", F.signum("diff_after").cast("int"))


def change_signs(changes: DataFrame) -> DataFrame:
    return changes.groupBy("increase").agg(F.count(F.lit(1)).alias("count"))


def gainers(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("increase") == 1).orderBy(F.desc_nulls_last("diff_after"), "name")


def donor_pool(
    rankings: DataFrame, subscriptions: DataFrame, first: int, last: int, left_out: tuple[str, str] | None = None
) -> DataFrame:
    """(year, name, total_score) of entities that are scored without a subscription in every year of the range.

    `left_out` is one (university, country) pair that is never a donor.
    """
    ranks = keyed(rankings, "university_name").where(F.col("year").between(first, last))
    events = keyed(subscriptions, "parent_account")
    free = unmatched(ranks, events, ["name", "year"]).where(F.col("total_score").isNotNull())
    if left_out:
        university, country = left_out
        free = free.where(~((F.col("university_name") == university) & (F.col("country") == country)))
    scores = materialised(free.select("year", "name", "total_score"), "donors")
    complete = scores.groupBy("name").agg(F.count_distinct("year").alias("years")).where(F.col("years") == last - first + 1)
    return null_safe_join(scores, complete.select("name"), ["name"], "left_semi")


def complete_entities(scores: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Entities with a value in every period of the table and no row without one: (entity, years, mean).

    `years` counts distinct periods, so repeated rows of one period cannot stand in for a missing period.
    """
    periods = scores.agg(F.count_distinct(period))
    per = scores.groupBy(entity).agg(
        F.count_distinct(F.when(F.col(value).isNotNull(), F.col(period))).alias("years"),
        F.count_if(F.col(value).isNull()).alias("__missing"),
        F.avg(value).alias("mean"),
    )
    return per.where((F.col("years") == periods.scalar()) & (F.col("__missing") == 0)).drop("__missing")


def donor_pairs(rankings: DataFrame, donors: DataFrame) -> DataFrame:
    """Yearly series of every ranked entity that is no donor, with the donors' mean as its control.

    (pair, date, test, control, donors): the date is the first of January, an entity's repeated scores of a year are
    averaged, and so are a donor's before the donors are. The control side has one row per year.
    """
    yearly = keyed(rankings, "university_name").where(F.col("total_score").isNotNull())
    tests = yearly.groupBy("name", "year").agg(F.avg("total_score").alias("test"))
    tests = tests.join(donors.select("name").distinct(), "name", "left_anti")
    each = donors.groupBy("name", "year").agg(F.avg("total_score").alias("score"))
    control = each.groupBy("year").agg(F.avg("score").alias("control"), F.count(F.lit(1)).alias("donors"))
    day = F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1))
    return tests.join(control, "year").select(F.col("name").alias("pair"), day.alias("date"), "test", "control", "donors")


def donor_series(donors: DataFrame) -> DataFrame:
    """(donor, date, value) per donor and year: its mean score, dated the first of January."""
    each = donors.groupBy("name", "year").agg(F.avg("total_score").alias("value"))
    return each.select(F.col("name").alias("donor"), F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)).alias("date"), "value")


def subscription_periods(subscriptions: DataFrame) -> DataFrame:
    """(pair, pre_end, post_start) per entity: the years before its first renewal, and from then on."""
    renewed = keyed(subscriptions, "parent_account").where((F.col("decision") == 1) & F.col("year").isNotNull() & F.col("name").isNotNull())
    first = renewed.groupBy(F.col("name").alias("pair")).agg(F.min("year").cast("int").alias("first"))
    start = lambda year: F.make_date(year, F.lit(1), F.lit(1))
    return first.select("pair", start(F.col("first") - 1).alias("pre_end"), start(F.col("first")).alias("post_start"))
