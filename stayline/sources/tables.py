"""The input tables and the customer views built on them.

The given star schema has no bank customers, so order history stands in:
`Age` holds the number of orders, `Gender` the market segment, `CreditScore`
is derived from finished orders, and so on. The shape is that of the training
table, the meaning is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.fields import TARGET
from stayline.functions.decisions import add_decisions

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

# Orders before LABEL_FROM make the features, later ones the label.
LABEL_FROM = "2000-08-01 00:00:00"
ACTIVE_FROM = "1999-08-01 00:00:00"

# The fixed linear model of the scored view, and weaker models beside it.
LINEAR_MODELS = {
    "full": {"intercept": -0.1, "IsActiveMember": -1.8, "Orders": -0.25, "Europe": 0.6, "Balance": 0.0001},
    "activity": {"intercept": -0.1, "IsActiveMember": -1.8},
    "orders": {"intercept": -0.1, "Orders": -0.25},
    "balance": {"intercept": -0.1, "Balance": 0.0001},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table '{name}'")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: ids, features and the label `Exited`.

    Orders are read once. Features and label come out of the same aggregation,
    so the big side is shuffled by customer and joined in that partitioning;
    partial aggregates keep a customer with very many orders small.
    """
    before = F.col("o_orderdate") < F.lit(LABEL_FROM).cast("timestamp")
    active = F.col("o_orderdate") >= F.lit(ACTIVE_FROM).cast("timestamp")
    urgent = F.col("o_orderpriority").startswith("1")
    history = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.when(before, 1)).alias("n_orders"),
            F.count(F.when(before & (F.col("o_orderstatus") == "F"), 1)).alias("n_done"),
            # Priorities start with a digit: a bit for each needs no second shuffle, unlike a distinct count.
            F.bit_count(
                F.bit_or(F.when(before, F.call_function("shiftleft", F.lit(1), F.ascii("o_orderpriority") - F.lit(ord("0")))))
            ).alias("n_priorities"),
            F.max(F.when(before & urgent, 1)).alias("urgent"),
            F.max(F.when(before & active, 1)).alias("active"),
            F.min(F.when(before, F.year("o_orderdate"))).alias("first_year"),
            F.max(F.when(before, F.col("o_totalprice"))).alias("max_price"),
            F.max(F.when(~before, 1)).alias("came_back"),
        )
    )

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("double")

    return (
        table(spark, sf_dir, "customer")
        .join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("RowNumber"),
            F.col("c_custkey").alias("CustomerId"),
            F.col("c_name").alias("Surname"),
            (300 + 50 * number("n_done")).cast("double").alias("CreditScore"),
            F.col("r_name").alias("Geography"),
            F.col("c_mktsegment").alias("Gender"),
            number("n_orders").alias("Age"),
            F.coalesce(2000 - F.col("first_year"), F.lit(0)).cast("double").alias("Tenure"),
            F.col("c_acctbal").alias("Balance"),
            number("n_priorities").alias("NumOfProducts"),
            number("urgent").alias("HasCrCard"),
            number("active").alias("IsActiveMember"),
            F.col("max_price").alias("EstimatedSalary"),
            F.when(F.col("came_back").isNull(), 1).otherwise(0).alias(TARGET),
        )
    )


def linear_terms() -> dict:
    """The inputs of the fixed linear models."""
    return {
        "intercept": F.lit(1.0),
        "IsActiveMember": F.col("IsActiveMember"),
        "Orders": F.col("Age") - 9,
        "Europe": F.when(F.col("Geography") == "EUROPE", 1.0).otherwise(0.0),
        "Balance": F.col("Balance"),
    }


def linear_probability(model: str):
    """P(churn) of one of the fixed linear models, unrounded."""
    terms = linear_terms()
    total = None
    for name, weight in LINEAR_MODELS[model].items():
        part = F.lit(weight) * terms[name]
        total = part if total is None else total + part
    return 1.0 / (1.0 + F.exp(-total))


def scored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table with p_churn of the fixed model and a label it explains.

    `Exited` is random in the given orders; `Churned` draws the label from the
    model by a fixed rule, so that scores can be good or bad at it.
    """
    p = linear_probability("full")
    draw = ((F.col("CustomerId") * 7919) % 1000) / F.lit(1000.0)
    return training_table(spark, sf_dir).withColumns(
        {"p_churn": F.round(p, 6), "Churned": F.when(draw < p, 1).otherwise(0)}
    )


def decided_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_decisions(scored_customers(spark, sf_dir))


def _contact_address(key):
    return (
        F.when(key % 11 == 2, " ")
        .when(key % 13 == 1, "not-an-email")
        .otherwise(F.concat(F.lit("  User"), key.cast("string"), F.lit("@Example.COM ")))
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring records as text, some of them damaged, with their row position."""
    key = F.col("CustomerId")

    def text(name: str):
        return F.col(name).cast("string")

    return training_table(spark, sf_dir).select(
        key.alias("row_index"),
        F.concat(F.lit("cust-"), key.cast("string")).alias("customer_id"),
        F.when(key % 31 == 7, "1.0d").otherwise(text("CreditScore")).alias("CreditScore"),
        F.col("Geography"),
        F.when(key % 23 == 5, "").otherwise(F.col("Gender")).alias("Gender"),
        F.when(key % 17 != 3, text("Age")).alias("Age"),
        F.when(key % 29 == 6, "  ").otherwise(text("Tenure")).alias("Tenure"),
        F.when(key % 19 == 4, "bad").otherwise(text("Balance")).alias("Balance"),
        text("NumOfProducts").alias("NumOfProducts"),
        text("HasCrCard").alias("HasCrCard"),
        text("IsActiveMember").alias("IsActiveMember"),
        F.when(key % 37 == 8, "NaN")
        .otherwise(F.coalesce(F.col("EstimatedSalary"), F.lit(0.0)).cast("string"))
        .alias("EstimatedSalary"),
        _contact_address(key).alias("email"),
    )


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows as a batch run leaves them, with missing and odd values mixed in."""
    key = F.col("CustomerId")
    p = (
        F.when(key % 13 == 0, None)
        .when(key % 17 == 0, float("nan"))
        .when(key % 19 == 0, float("inf"))
        .when(key % 23 == 0, 1.5)
        .otherwise(F.col("p_churn"))
    )
    return decided_customers(spark, sf_dir).select(
        key.alias("index"),
        F.when(key % 10 == 0, None)
        .when(key % 10 == 5, " ")
        .otherwise(F.concat(F.lit(" cust-"), key.cast("string"), F.lit(" ")))
        .alias("id"),
        _contact_address(key).alias("email"),
        F.when(key % 4 == 0, None).when(key % 4 == 1, "  ").otherwise(F.col("Surname")).alias("name"),
        p.alias("p_churn"),
        F.when(key % 7 == 0, None)
        .when(key % 7 == 1, "  ")
        .otherwise(F.col("recommended_action"))
        .alias("recommended_action"),
        "clv",
        "net_gain",
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft bodies: all turns, some with subject lines or blank runs, and web pages with tags."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    spoken = (
        table(spark, sf_dir, "conversations")
        .select(
            F.concat_ws("-", F.lit("c"), conv, turn).alias("draft_id"),
            F.when((turn % 4 == 3) & (conv % 6 == 1), "  \n ")
            .when((turn % 4 == 1) & (conv % 2 == 0), F.concat(F.lit("Subject: offer "), conv, F.lit("\n\n\n"), text))
            .when(turn % 4 == 1, F.concat(F.lit("  SUBJECT : offer "), conv, F.lit("\r\n"), text, F.lit("\nsubject:again\n")))
            .when(conv % 7 == 3, F.concat(text, F.lit("\n \n\n  Best regards & \"thanks\" \n \n")))
            .otherwise(text)
            .alias("body"),
        )
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p-"), F.col("page_id")).alias("draft_id"), F.col("html").alias("body")
    )
    return spoken.unionByName(pages)


def draft_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of every conversation as numbered drafts, long form."""
    conv, turn = F.col("conv_id"), F.col("turn")
    first = W.partitionBy("conv_id").orderBy("turn")
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("draft_no", F.row_number().over(first))
        .select(
            F.col("conv_id").alias("group_id"),
            "draft_no",
            F.when((turn == 1) & (conv % 5 == 0), F.concat(F.lit("Subject: hi\n"), F.col("text")))
            .when((turn == 2) & (conv % 9 == 0), F.concat(F.lit("<b>"), F.col("text"), F.lit("</b>")))
            .when((turn == 0) & (conv % 11 == 0), "   ")
            .otherwise(F.col("text"))
            .alias("body"),
        )
    )


def draft_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of exactly three drafts side by side, with an answer that picks one of them."""
    conv = F.col("group_id")
    sides = (
        draft_groups(spark, sf_dir)
        .groupBy("group_id")
        .agg(
            F.count("*").alias("n_drafts"),
            *[F.max(F.when(F.col("draft_no") == n, F.col("body"))).alias(f"draft_{n}") for n in (1, 2, 3)],
        )
        .filter(F.col("n_drafts") == 3)
        .drop("n_drafts")
    )
    return sides.withColumn(
        "answer",
        F.when(conv % 8 == 0, F.concat(F.lit("  "), F.col("draft_2"), F.lit(" \n")))
        .when(conv % 8 == 1, "I choose Draft 3.")
        .when(conv % 8 == 2, "option2 please")
        .when(conv % 8 == 3, "the SECOND one")
        .when(conv % 8 == 4, "Third is best, of 13 reasons")
        .when(conv % 8 == 5, "")
        .when(conv % 8 == 6, F.col("draft_3")),
    )


def send_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery outcomes as a mail provider reports them: any of status, ok and code may be missing."""
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("id"),
        F.when(key % 50 == 7, "queued").alias("status"),
        F.when(kind == "click", True).when((kind == "view") & (key % 3 == 0), False).alias("ok"),
        F.when(kind.isin("purchase", "signup"), 202).when(kind == "error", 500).alias("status_code"),
    )


