"""Text rules for e-mails, drafts and prompts, as column expressions.

Python and Java disagree on white space and line breaks, so both are spelled
out here: `(?U)` makes \\s cover Unicode, and the separators x1c-x1f are added.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.fields import EMAIL_PATTERN, TAG_PATTERN, TONES

# What Python takes for white space.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"
SPACE_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"
# A line break with the white space around it. The look-behind and the possessive
# quantifier keep the search linear on long runs of spaces.
PADDED_BREAK = rf"(?U)(?:(?<!{SPACE_IN_LINE}){SPACE_IN_LINE}++)?\n{SPACE_IN_LINE}*+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SUBJECT_PREFIX = rf"(?Ui)^{SPACE_IN_LINE}*subject{SPACE_IN_LINE}*:{SPACE}*"
SUBJECT_LINE = rf"(?Uim)^{SPACE_IN_LINE}*subject{SPACE_IN_LINE}*:[^\n]*\n?"
CHOICE_PATTERN = r"(?i)\b(?:draft|option)?\s*([123])\b"
ANY_TAG = r"[<>]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def strip_or_null(text: Column) -> Column:
    """Stripped text, blank becomes null."""
    return F.nullif(strip(text), F.lit(""))


def is_email(text: Column) -> Column:
    return text.rlike("(?U)" + EMAIL_PATTERN)


def normal_email(text: Column) -> Column:
    """Stripped, lower-cased address, or null when it is not one."""
    address = F.lower(strip(text))
    return F.when(is_email(address), address)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG_PATTERN, "")


def trim_lines(text: Column) -> Column:
    """Every line stripped, breaks written as newline."""
    broken = F.regexp_replace(text, LINE_BREAK, "\n")
    return F.regexp_replace(broken, PADDED_BREAK, "\n")


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one, none at either end."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normal_draft(text: Column) -> Column:
    """Lines stripped, blank runs collapsed."""
    return collapse_blank_lines(trim_lines(F.coalesce(text, F.lit(""))))


def plain_body(text: Column) -> Column:
    """Draft without tags and without a subject prefix on its first content line."""
    lines = normal_draft(strip_tags(F.coalesce(text, F.lit(""))))
    return strip(F.regexp_replace(lines, SUBJECT_PREFIX, ""))


def body_without_subject_lines(text: Column) -> Column:
    """Draft without tags and without any subject line."""
    lines = trim_lines(strip_tags(F.coalesce(text, F.lit(""))))
    return collapse_blank_lines(F.regexp_replace(lines, SUBJECT_LINE, ""))


def draft_problem(text: Column) -> Column:
    """What is wrong with a draft: empty, html, subject, or ok."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(strip(body) == "", "empty")
        .when(body.rlike(ANY_TAG), "html")
        .when(trim_lines(body).rlike(SUBJECT_LINE), "subject")
        .otherwise("ok")
    )


def chosen_draft(answer: Column, drafts: list[Column]) -> Column:
    """The draft an answer points at: its text, a number 1-3, an ordinal word, else the first."""
    said = strip(F.coalesce(answer, F.lit("")))
    number = F.regexp_extract(said, CHOICE_PATTERN, 1)
    lowered = F.lower(said)
    choice = F.when(said.isin(*drafts), said)
    for position, draft in enumerate(drafts, start=1):
        choice = choice.when(number == str(position), draft)
    for word, draft in zip(("first", "second", "third"), drafts):
        choice = choice.when(lowered.contains(word), draft)
    return choice.otherwise(drafts[0])


def selected_tone(chosen: Column, drafts: Mapping[str, Column]) -> Column:
    """The tone whose draft equals the chosen text; serious when none does."""
    text = strip(chosen)
    tone = F.when(strip(drafts[TONES[0]]) == text, TONES[0])
    for name in TONES[1:]:
        tone = tone.when(strip(drafts[name]) == text, name)
    return tone.otherwise(TONES[0])


def subject_line(text: Column, company: str | Column) -> Column:
    """First non-blank line without prefix and tags; a stock subject when that is blank."""
    company = F.lit(company) if isinstance(company, str) else company
    lines = strip(trim_lines(F.coalesce(text, F.lit(""))))
    first = F.substring_index(lines, "\n", 1)
    subject = strip(strip_tags(strip(F.regexp_replace(first, SUBJECT_PREFIX, ""))))
    return F.when(subject != "", subject).otherwise(F.concat(company, F.lit(" check-in")))


def html_body(text: Column) -> Column:
    """From the first tag on, or the escaped text in a paragraph."""
    body = strip(F.coalesce(text, F.lit("")))
    tag_at = F.locate("<", body)
    escaped = body
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    return (
        F.when(body == "", "")
        .when(tag_at > 0, body.substr(tag_at, F.length(body)))
        .otherwise(F.concat(F.lit("<p>"), escaped, F.lit("</p>")))
    )


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """A {name} template as one concatenation; a name without a value is an error."""
    if not isinstance(template, str) or not template.strip():
        raise ValueError("'prompt_template' must be a non-empty string")
    parts = []
    for literal, name, spec, _ in string.Formatter().parse(template.strip()):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec:
            raise ValueError("prompt template must not use format specifications")
        if name not in values:
            raise ValueError(f"prompt template is missing required variable '{name}'")
        parts.append(values[name].cast("string"))
    return strip(F.concat(*parts))


def recipient_prompt(tone: str, company: str, sender: str, id_: Column, email: Column, p_churn: Column) -> Column:
    """The request for one customer's draft, with the probability to two digits."""
    return F.concat(
        F.lit(f"Write a {tone} retention outreach email from {sender} at {company} to customer "),
        id_,
        F.lit(" ("),
        email,
        F.lit("). Customer churn probability is "),
        F.format_number(p_churn, 2),
        F.lit(". Do not mention scoring. Include one clear next step."),
    )


def merged_context(context: Column, extra: Mapping[str, str | None]) -> Column:
    """A map with stripped, non-blank extra values put over the given ones."""
    given = {key: str(value).strip() for key, value in extra.items() if value is not None and str(value).strip()}
    base = F.coalesce(context, F.create_map().cast("map<string,string>"))
    if not given:
        return base
    added = F.create_map(*[F.lit(item) for pair in given.items() for item in pair])
    updated = F.transform_values(base, lambda key, old: F.coalesce(F.try_element_at(added, key), old))
    fresh = F.map_filter(added, lambda key, _: ~F.array_contains(F.map_keys(base), key))
    return F.map_concat(updated, fresh)


def context_lines(context: Column) -> Column:
    """One `key: value` line per entry, in the map's order, blanks left out; null when none."""
    lines = F.transform(
        F.filter(F.map_entries(context), lambda e: strip_or_null(e["value"]).isNotNull()),
        lambda e: F.concat(e["key"], F.lit(": "), strip(e["value"])),
    )
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def picker_lines(context: Column) -> Column:
    """`key: value` lines of trimmed, non-blank keys and values; of keys alike after trimming the first has the last one's value."""
    entries = F.transform(F.map_entries(context), lambda e: F.struct(strip_or_null(e["key"]).alias("key"), strip_or_null(e["value"]).alias("value")))
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    keys = F.transform(entries, lambda e: e["key"])

    def line(entry: Column, place: Column) -> Column:
        last = F.element_at(F.filter(entries, lambda x: x["key"] == entry["key"]), -1)["value"]
        return F.when(F.array_position(keys, entry["key"]) == place + 1, F.concat(entry["key"], F.lit(": "), last))

    return F.nullif(F.array_join(F.transform(entries, line), "\n"), F.lit(""))


def with_context(prompt: Column, context: Column, lines: Callable[[Column], Column] = context_lines) -> Column:
    """A prompt followed by its context block, if there is one."""
    block = lines(context)
    return F.when(block.isNull(), strip(prompt)).otherwise(
        F.concat(strip(prompt), F.lit("\n\nContext:\n"), block)
    )


def picker_prompt(drafts: list[Column], context: Column) -> Column:
    """The request to choose among three drafts, with the context block if there is one."""
    parts = [
        F.lit(
            "Pick the strongest draft for cold sales/retention outreach.\n"
            "Return exactly one full draft body from the options below with no extra text."
        )
    ]
    for number, draft in enumerate(drafts, start=1):
        parts += [F.lit(f"\n\nDraft {number}:\n"), draft]
    return with_context(F.concat(*parts), context, picker_lines)


def python_quoted(text: Column) -> Column:
    """`text` in quotes the way error messages show it."""
    escaped = text
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    only_single = text.contains("'") & ~text.contains('"')
    return F.when(only_single, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def require_text(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"'{name}' must be a non-empty string")
    return value.strip()


def require_email(value, name: str) -> str:
    """Driver-side check of one configured address."""
    address = require_text(value, name)
    if not re.match(EMAIL_PATTERN, address):
        raise ValueError(f"'{name}' must be a valid email address")
    return address
