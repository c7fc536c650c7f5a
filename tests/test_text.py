import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.functions import text


def apply(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def test_emails(spark):
    got = apply(spark, text.normal_email, " A@B.Co ", "a@b", "a b@c.de", None, "", "x@y.z q", " k@l.m ", "a@@b.c")
    assert got == ["a@b.co", None, None, None, None, None, "k@l.m", None]


def test_optional(spark):
    assert apply(spark, text.strip_or_null, " a ", "\t\n", None, "\x1f") == ["a", None, None, None]


def test_plain_body(spark):
    got = apply(
        spark,
        text.plain_body,
        "Subject: Win back\n\n<p>Hello there</p>\n\n\n  Bye  ",
        "SUBJECT : x",
        "Subject:\n\nHi",
        "a\r\nb\x0bc",
        "Hi\nSubject: keep",
        None,
        "subject\n: no",
    )
    assert got == ["Win back\n\nHello there\n\nBye", "x", "Hi", "a\nb\nc", "Hi\nSubject: keep", "", "subject\n: no"]


def test_subject_lines_dropped(spark):
    got = apply(spark, text.body_without_subject_lines, "Subject: a\nHi\n\n subject : b\n\nBye", "Subject: x\nSubject: y\nZ", "<b>q</b>")
    assert got == ["Hi\n\nBye", "Z", "q"]


def test_draft_checks(spark):
    got = apply(spark, text.draft_problem, "fine", " ", None, "a > b", "<p>x", "Hi\n  SUBJECT: x", "the subject: fine")
    assert got == ["ok", "empty", "empty", "html", "html", "subject", "ok"]


@pytest.mark.parametrize(
    "answer, index",
    [
        ("  Second body. ", 1),
        ("Draft 2", 1),
        ("option 3!", 2),
        ("draft3", 2),
        ("I like number 1 and 2", 0),
        ("version x2", 0),
        ("the SECOND one", 1),
        ("third", 2),
        ("first or second", 0),
        ("no idea", 0),
        ("", 0),
        (None, 0),
        ("12 reasons for the third", 2),
    ],
)
def test_choice(spark, answer, index):
    drafts = ["First body.", "Second body.", "Third body."]
    got = apply(spark, lambda t: text.chosen_draft(t, [F.lit(d) for d in drafts]), answer)
    assert got == [drafts[index]]


def test_tone(spark):
    drafts = {"serious": F.lit("a"), "witty": F.lit(" b "), "concise": F.lit("c")}
    assert apply(spark, lambda t: text.selected_tone(t, drafts), "b", " c", "zz", "a") == ["witty", "concise", "serious", "serious"]


def test_subject(spark):
    got = apply(spark, lambda t: text.subject_line(t, "Acme"), "\n\n Subject: <b>Hello</b> you\nrest", "Plain\nx", "  ", None, "<p></p>\nx")
    assert got == ["Hello you", "Plain", "Acme check-in", "Acme check-in", "Acme check-in"]


def test_html(spark):
    raw = "a & b > \"c\" 'd'"
    got = apply(spark, text.html_body, " Intro <p>x</p> ", raw, " ", None)
    assert got == ["<p>x</p>", f"<p>{html.escape(raw)}</p>", "", ""]


def test_templates(spark):
    values = {"name": F.lit("Ann"), "n": F.lit(3)}
    made = spark.range(1).select(text.fill_template("  Hi {name}, {n} of {{them}}! ", values)).first()[0]
    assert made == "Hi Ann, 3 of {them}!"
    with pytest.raises(ValueError, match="'who'"):
        text.fill_template("Hi {who}", values)
    with pytest.raises(ValueError):
        text.fill_template("   ", values)


def test_prompt_digits(spark):
    def prompt(t):
        return text.recipient_prompt("witty", "Co", "Me", F.lit("c1"), F.lit("a@b.c"), t.cast("double"))

    got = apply(spark, prompt, "0.725", "0.125", "0.995", "1", "0.005")
    assert [re.search(r"is (\S+)\. Do", g).group(1) for g in got] == [f"{p:.2f}" for p in (0.725, 0.125, 0.995, 1, 0.005)]
    assert got[0].startswith("Write a witty retention outreach email from Me at Co to customer c1 (a@b.c). ")


def test_context(spark):
    given = F.create_map(F.lit("from_name"), F.lit("Old"), F.lit("note"), F.lit(" n "), F.lit("void"), F.lit(" "))
    merged = text.merged_context(given, {"company_name": " Co ", "from_name": "New", "from_email": " ", "recipient_name": None})
    row = spark.range(1).select(
        text.with_context(F.lit(" Go "), merged).alias("full"),
        text.with_context(F.lit("Go"), text.merged_context(F.lit(None).cast("map<string,string>"), {})).alias("bare"),
        text.picker_prompt([F.lit(x) for x in "abc"], F.create_map(F.lit("k"), F.lit("v"))).alias("pick"),
    ).first()
    assert row["full"] == "Go\n\nContext:\nfrom_name: New\nnote: n\ncompany_name: Co"
    assert row["bare"] == "Go"
    assert row["pick"].endswith("\n\nDraft 1:\na\n\nDraft 2:\nb\n\nDraft 3:\nc\n\nContext:\nk: v")


def lines_kept(value, drop_subjects):
    """The line rules stated over Python lines, to check the expressions against."""
    kept = []
    for line in [part.strip() for part in re.sub(r"<[^>]+>", "", value).splitlines()]:
        if drop_subjects and re.match(r"subject\s*:", line, re.I):
            continue
        if line or (kept and kept[-1]):
            kept.append(line)
    return kept


ALPHABET = st.sampled_from(list("ab<> :\n\r\t\x0b\x1c\x85  ") + ["Subject:", "subject :", "<p>", "\n\n"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=20, max_size=40))
def test_line_rules_on_random_text(spark, values):
    got = apply(spark, text.body_without_subject_lines, *values)
    assert got == ["\n".join(lines_kept(v, True)).strip() for v in values]
    stripped = apply(spark, lambda t: F.coalesce(text.strip(t), F.lit("")), *values)
    assert stripped == [v.strip() for v in values]


def test_picker_context_keys(spark):
    row = spark.range(1).select(
        text.picker_lines(F.create_map(*[F.lit(x) for x in (" b ", " 1 ", "a", "  ", "  ", "x", "c", "2", "b", "3")])).alias("lines"),
        text.picker_lines(F.create_map(F.lit(" "), F.lit("x"))).alias("none"),
        text.picker_lines(F.lit(None).cast("map<string,string>")).alias("null"),
    ).first()
    assert (row["lines"], row["none"], row["null"]) == ("b: 3\nc: 2", None, None)
