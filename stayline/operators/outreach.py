"""From selected customers to prompts, drafts, a request payload and an outbox table.

Nothing here sends mail or calls a model. A draft writer is any function from
a table with `prompt` and `context` to the same table with `draft`; the default
one returns the prompt with its context, cleaned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import BATCH_PROMPT, FROM_EMAIL, SEND_MODE, TONE_POLICY
from stayline.functions import text
from stayline.operators.selection import target_metadata

Writer = Callable[[DataFrame], DataFrame]

# Fixed value of the contract.
EMPTY_DRAFT = "writer returned an empty draft"

# A request is one row; longer lists become several requests, so that no row grows with the list.
RECIPIENTS_PER_REQUEST = 1_000


def normal_recipients(targets: DataFrame) -> DataFrame:
    """Cleaned id, email and name; targets without a valid address are marked as skipped."""
    return targets.withColumns(
        {
            "id": F.coalesce(
                text.strip_or_null(F.col("id").cast("string")),
                F.concat(F.lit("idx-"), F.col("index").cast("string")),
            ),
            "email": text.normal_email(F.col("email")),
            "name": text.strip_or_null(F.col("name")),
        }
    ).withColumn("skipped", F.col("email").isNull())


def request_number(order: str) -> Column:
    return F.floor((F.col(order) - 1) / RECIPIENTS_PER_REQUEST)


def batch_prompt(recipients: DataFrame, sender: str, company: str, template: str = BATCH_PROMPT, order: str = "position") -> DataFrame:
    """One prompt per request of at most RECIPIENTS_PER_REQUEST recipients, ids in `order` (from 1 without gaps)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("id")))), lambda r: r["id"])
    values = {
        "from_name": F.lit(text.require_text(sender, "from_name")),
        "company_name": F.lit(text.require_text(company, "company_name")),
        "recipient_count": F.col("recipient_count"),
        "recipient_ids": F.array_join("ids", ", "),
    }
    prompt = text.fill_template(template, values)
    per_request = recipients.groupBy(request_number(order).alias("request_no"))
    return per_request.agg(F.count("*").alias("recipient_count"), listed.alias("ids")).select(
        "request_no", "recipient_count", prompt.alias("message_prompt")
    )


def payload(
    recipients: DataFrame,
    sender: str,
    company: str,
    template: str = BATCH_PROMPT,
    from_email: str = FROM_EMAIL,
    tone_policy: str = TONE_POLICY,
    send_mode: str = SEND_MODE,
    order: str = "position",
) -> DataFrame:
    """Request rows with prompt, sender and the recipients that can be reached.

    One row holds RECIPIENTS_PER_REQUEST recipients at most; a request in which
    none is reachable is left out.
    """
    text.require_email(from_email, "from_email")
    entry = F.struct(
        F.col(order),
        F.struct("id", "email", "name", target_metadata(recipients).alias("metadata")).alias("recipient"),
    )
    reachable = F.collect_list(F.when(~F.col("skipped"), entry))
    in_order = F.array_sort(F.col("entries"), lambda a, b: (a[order] - b[order]).cast("int"))
    listed = F.transform(in_order, lambda e: e["recipient"])
    prompts = batch_prompt(recipients, sender, company, template, order)
    return (
        recipients.groupBy(request_number(order).alias("request_no"))
        .agg(reachable.alias("entries"))
        .filter(F.size("entries") > 0)
        .join(prompts, "request_no")
        .select(
            "request_no",
            F.lit(company.strip()).alias("company_name"),
            F.lit(sender.strip()).alias("from_name"),
            listed.alias("recipients"),
            "message_prompt",
            F.lit(from_email).alias("from_email"),
            F.lit(tone_policy).alias("tone_policy"),
            F.lit(send_mode).alias("send_mode"),
        )
    )


def with_prompts(recipients: DataFrame, tone: str, company: str, sender: str) -> DataFrame:
    """Add one writing request per recipient."""
    prompt = text.recipient_prompt(tone, company, sender, F.col("id"), F.col("email"), F.col("p_churn"))
    return recipients.withColumn("prompt", prompt)


def echo_writer(requests: DataFrame) -> DataFrame:
    """The default writer: prompt and context as plain text."""
    return requests.withColumn("draft", text.plain_body(text.with_context(F.col("prompt"), F.col("context"))))


def context_of(company: str, sender: str, from_email: str) -> Column:
    return text.merged_context(
        F.lit(None).cast("map<string,string>"),
        {"company_name": company, "from_name": sender, "from_email": from_email},
    )


def draft_rows(drafted: DataFrame, company: str) -> DataFrame:
    """Subject and body per drafted recipient; empty drafts stay out (see `draft_errors`)."""
    return with_body(drafted).filter(F.col("body_text").isNotNull()).withColumn(
        "subject", text.subject_line(F.col("body_text"), company)
    )


def draft_errors(drafted: DataFrame) -> DataFrame:
    return with_body(drafted).filter(F.col("body_text").isNull()).select(
        F.lit("draft").alias("stage"), "id", "email", F.lit(EMPTY_DRAFT).alias("message")
    )


def drafts_and_errors(drafted: DataFrame, company: str) -> DataFrame:
    """`draft_rows` and `draft_errors` in one table from one pass: a row has either a body or a stage and message."""
    body = F.col("body_text")
    return with_body(drafted).select(
        "id",
        "email",
        F.when(body.isNotNull(), F.col("rank")).alias("rank"),
        F.when(body.isNotNull(), text.subject_line(body, company)).alias("subject"),
        "body_text",
        F.when(body.isNull(), F.lit("draft")).alias("stage"),
        F.when(body.isNull(), F.lit(EMPTY_DRAFT)).alias("message"),
    )


def with_body(drafted: DataFrame) -> DataFrame:
    return drafted.withColumn("body_text", text.strip_or_null(F.col("draft")))


def outbox(messages: DataFrame, from_email: str, html: bool = False) -> DataFrame:
    """Messages in the shape a mail provider takes, as JSON. A table, nothing is sent."""
    body = text.html_body(F.col("body_text")) if html else F.col("body_text")
    message = F.struct(
        F.struct(F.lit(text.require_email(from_email, "from_email")).alias("email")).alias("from"),
        F.array(F.struct(F.array(F.struct(F.col("email"))).alias("to"))).alias("personalizations"),
        F.col("subject"),
        F.array(
            F.struct(F.lit("text/html" if html else "text/plain").alias("type"), body.alias("value"))
        ).alias("content"),
    )
    return messages.select("id", "email", F.to_json(message).alias("message"))
