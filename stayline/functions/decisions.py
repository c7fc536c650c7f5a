"""From churn probability to customer value, action and expected gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import ACTION_COSTS, HIGH_RISK, LOW_RISK, NO_ACTION, OFFER_CALL, SEND_EMAIL
from stayline.functions.numbers import zero_if_missing


def customer_value(balance: Column, tenure: Column, salary: Column) -> Column:
    """Balance grown by 10 % per year of tenure plus 5 % of salary; negatives count as 0."""

    def floor0(value: Column) -> Column:
        return F.greatest(F.lit(0.0), zero_if_missing(value))

    return floor0(balance) * (1.0 + floor0(tenure) / 10.0) + 0.05 * floor0(salary)


def recommended_action(p_churn: Column) -> Column:
    return (
        F.when(p_churn.isNull() | F.isnan(p_churn), None)
        .when(p_churn < LOW_RISK, NO_ACTION)
        .when(p_churn < HIGH_RISK, SEND_EMAIL)
        .otherwise(OFFER_CALL)
    )


def action_cost(action: Column) -> Column:
    """Cost of an action; an unknown action costs nothing."""
    cost = F.lit(0.0)
    for name, amount in ACTION_COSTS.items():
        cost = F.when(action == name, amount).otherwise(cost)
    return cost


def net_gain(p_churn: Column, value: Column, cost: Column) -> Column:
    return p_churn * value - cost


def add_decisions(scored: DataFrame, p_churn: str = "p_churn") -> DataFrame:
    """Add clv, recommended_action and net_gain; a missing probability gives nulls."""
    p = F.col(p_churn)
    valued = scored.withColumns(
        {
            "clv": customer_value(F.col("Balance"), F.col("Tenure"), F.col("EstimatedSalary")),
            "recommended_action": recommended_action(p),
        }
    )
    return valued.withColumn(
        "net_gain",
        F.when(
            F.col("recommended_action").isNotNull(),
            net_gain(p, F.col("clv"), action_cost(F.col("recommended_action"))),
        ),
    )


def cost_table(spark) -> DataFrame:
    """The action costs as a table of three rows, for joins."""
    return spark.createDataFrame(list(ACTION_COSTS.items()), "recommended_action string, action_cost double")


def add_action_cost(df: DataFrame, costs: DataFrame) -> DataFrame:
    """Look the cost up in a table kept outside the code; unknown actions cost 0.

    The size of `costs` decides the join: Spark broadcasts it below its threshold.
    """
    return df.join(costs, "recommended_action", "left").withColumn(
        "action_cost", F.coalesce("action_cost", F.lit(0.0))
    )
