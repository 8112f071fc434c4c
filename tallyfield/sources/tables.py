"""The workload's logical tables as views over a folder of Parquet tables. Every view reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rankings up to this year come as a finished table, later ones as landed documents.
HISTORY_END = 1998
DAILY_START = "2001-01-05"

PAYLOAD_ROW = (
    "name string, location string, year int, rank_order string, scores_overall string, scores_teaching string, "
    "scores_international_outlook string, scores_research string, scores_citations string, "
    "scores_industry_income string, stats_number_students string, stats_student_staff_ratio string, "
    "stats_pc_intl_students string, stats_female_male_ratio string"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Renewals and cancellations with missing parents, umbrella parents and missing purchase dates."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, lineitem = table(spark, folder, "nation"), table(spark, folder, "lineitem")
    shipped = lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("event_date"))
    priority, name, day = F.col("o_orderpriority"), F.col("c_name"), F.col("o_orderdate").cast("date")
    parent = (
        F.when(priority == "1-URGENT", F.lit(None).cast("string"))
        .when(priority == "2-HIGH", F.concat(name, F.lit(" System")))
        .when(priority == "3-MEDIUM", F.concat(name, F.lit(" Consortium")))
        .when(priority == "4-NOT SPECIFIED", F.concat(name, F.lit(" Consortium West")))
        .otherwise(name)
    )
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(shipped, orders["o_orderkey"] == shipped["l_orderkey"], "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("o_custkey").alias("account_id"),
            name.alias("account_name"),
            parent.alias("parent_account"),
            F.when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "Course Platform").otherwise("Repository").alias("asset_name"),
            F.col("c_nationkey").alias("carnegie"),
            F.col("n_name").alias("billing_country"),
            F.floor("c_acctbal").alias("employees"),
            F.col("c_mktsegment").alias("industry"),
            priority.alias("order_type"),
            F.when(priority != "5-LOW", F.date_sub(day, (F.col("o_orderkey") % 45).cast("int"))).alias("purchase_date"),
            day.alias("usage_start_date"),
            "event_date",
            F.col("o_totalprice").alias("price"),
            F.when(F.col("o_orderstatus") == "P", "cancellation").otherwise("renewal").alias("kind"),
        )
    )


def rank_source(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return (
        orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.floor(F.avg("o_totalprice") / 10000).alias("score"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("name"), F.col("n_name").alias("location"), "year", "cnt", "score")
    )


def payload(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking rows as the landed documents hold them: all text."""
    cnt, score = F.col("cnt"), F.col("score")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])

    return rank_source(spark, folder).select(
        "entry_id",
        "name",
        "location",
        "year",
        text(cnt * 10).alias("rank_order"),
        F.when(score % 7 == 0, "-").when(score % 3 == 0, text(score, "—", score + 5)).otherwise(text(score, ".5")).alias("scores_overall"),
        text(cnt + 10, ".", score % 10).alias("scores_teaching"),
        text(score + 11, ".", cnt % 10).alias("scores_international_outlook"),
        text(score + 12, ".", cnt % 10).alias("scores_research"),
        text(score + 13, ".", cnt % 10).alias("scores_citations"),
        text(score + 14, ".", cnt % 10).alias("scores_industry_income"),
        text(score + 1, ",", F.lpad((cnt * 7 % 1000).cast("string"), 3, "0")).alias("stats_number_students"),
        text(cnt + 9, ".", score % 10).alias("stats_student_staff_ratio"),
        F.when(score % 23 == 0, "%").otherwise(text(score, "%")).alias("stats_pc_intl_students"),
        text(cnt + 40, " : ", 60 - cnt).alias("stats_female_male_ratio"),
    )


def rank_history(spark: SparkSession, folder: str) -> DataFrame:
    """The finished table of earlier years: final column names, total score still text."""
    cnt, score = F.col("cnt"), F.col("score")
    tenth = lambda a, b: (a + b / 10).cast("double")
    return (
        rank_source(spark, folder)
        .where(F.col("year") <= HISTORY_END)
        .select(
            cnt.cast("double").alias("world_rank"),
            F.col("name").alias("university_name"),
            F.col("location").alias("country"),
            tenth(cnt + 10, score % 10).alias("teaching"),
            tenth(score + 11, cnt % 10).alias("international"),
            tenth(score + 12, cnt % 10).alias("research"),
            tenth(score + 13, cnt % 10).alias("citations"),
            tenth(score + 14, cnt % 10).alias("income"),
            F.when(score % 7 == 0, "-").otherwise(score.cast("string")).alias("total_score"),
            ((score + 1) * 1000 + cnt * 7 % 1000).cast("double").alias("num_students"),
            tenth(cnt + 9, score % 10).alias("student_staff_ratio"),
            score.cast("double").alias("international_students"),
            F.concat((cnt + 40).cast("string"), F.lit(" : "), (60 - cnt).cast("string")).alias("female_male_ratio"),
            "year",
        )
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Daily uploads per site; days without any are absent."""
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") == "N")
        .groupBy(F.col("l_suppkey").alias("site_key"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum("l_quantity").cast("long").alias("uploads"))
    )


def downloads_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") != "N")
        .groupBy(F.col("l_suppkey").alias("site_key"), F.year("l_shipdate").alias("years"), F.month("l_shipdate").alias("months"))
        .agg(F.sum("l_quantity").cast("long").alias("downloads"))
    )


def downloads_daily(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") != "N")
        .groupBy(F.col("l_suppkey").alias("site_key"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.sum("l_quantity").cast("long").alias("downloads"))
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Site directory."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site_key"),
        F.col("s_name").alias("institution_name"),
        F.concat(F.lit("http://"), F.regexp_replace(F.lower("s_name"), "#", "-"), F.lit(".example.org/")).alias("site_url"),
    )


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Geocoder answers: one nested address per account name, as landed."""
    part = "struct<long_name:string,types:array<string>>"
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")

    def component(name, *types) -> Column:
        return F.struct(name.alias("long_name"), F.array(*[F.lit(t) for t in types]).alias("types")).cast(part)

    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_name").alias("university"),
        F.array(
            component(F.col("c_mktsegment"), "locality", "political"),
            component(F.col("n_name"), "country", "political"),
            component(F.lit("00000"), "postal_code"),
        ).alias("address_components"),
    )


