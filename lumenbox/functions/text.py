"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Descriptions of sensitive kinds
PII_KINDS = {
    "email": "email addresses",
    "phone": "phone numbers",
    "name": "personal names of individuals",
    "address": "street or postal addresses",
    "card": "credit card or bank account numbers",
    "key": "API keys, access tokens, passwords, or secret strings",
    "id": "government ID numbers such as SSN or passport numbers",
}
_YES = r"\b(?:yes|true|correct)\b"
_NO = r"\b(?:no|false|incorrect)\b"


def non_empty(text: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    return F.coalesce(*[non_empty(t) for t in texts], F.lit(""))


def parse_yes_no(text: Column) -> Column:
    """True, false, or null where the answer says both or neither."""
    low = F.lower(F.coalesce(text, F.lit("")))
    yes, no = low.rlike(_YES), low.rlike(_NO)
    return F.when(yes != no, yes)


def yes_probability(text: Column) -> Column:
    """1.0 or 0.0 from an answer in words; null if it abstains."""
    return parse_yes_no(text).cast("double")


def salvage_objects(text: Column) -> Column:
    """Every innermost {...} that parses as JSON, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.filter(found, lambda o: F.try_parse_json(o).isNotNull())


def step_lines(text: Column) -> Column:
    """array<string>: instructions of numbered or bulleted lines."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(?:\d+[.)]|[-*])\s+(.*\S)", 1)), lambda x: x != "")


def clean_line(text: Column, label: Column) -> Column:
    return F.trim(first_truthy(text, label))


def normalise_ocr(text: Column) -> Column:
    """Letters and digits, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def kind_of(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(non_empty(label), F.lit("unknown"))))


def kinds_text(kinds: Column) -> Column:
    """Descriptions of an array of kinds, joined; unknown ones as they are."""
    known = F.create_map(*[F.lit(v) for pair in PII_KINDS.items() for v in pair])
    return F.array_join(F.transform(kinds, lambda k: F.coalesce(F.try_element_at(known, k), k)), ", ")


def descriptor(role: Column, text: Column, theme_role: Column) -> Column:
    """How a user would name an element."""
    colour = F.when(theme_role == "primary", "blue ").when(theme_role == "danger", "red ").otherwise("")
    quoted = F.concat(F.lit('the "'), text, F.lit('"'))
    return (
        F.when(role == "button", F.replace(F.concat(F.lit("the "), colour, text, F.lit(" button")), F.lit("  "), F.lit(" ")))
        .when(role == "menu", F.concat(quoted, F.lit(" menu in the menu bar")))
        .when(role == "nav_item", F.concat(quoted, F.lit(" item in the sidebar")))
        .when(role == "field", F.concat(quoted, F.lit(" input field")))
        .when(role == "tab", F.concat(quoted, F.lit(" tab")))
        .otherwise(F.concat(F.lit("the "), text, F.lit(" element")))
    )


def box_kind(role: Column) -> Column:
    return F.when(role.isin("button", "field"), "tight").otherwise("region")


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def item_caption(label: Column, text: Column, description: Column, number: Column, confidence: Column) -> Column:
    """First text that is not empty, else #number; with the confidence, cut to 60."""
    name = F.coalesce(non_empty(label), non_empty(text), non_empty(description), F.concat(F.lit("#"), number.cast("string")))
    return F.left(F.when(confidence.isNull(), name).otherwise(F.concat(name, F.lit(" "), F.format_string("%.2f", F.bround(confidence, 2)))), F.lit(60))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def plain_base64(content: Column) -> Column:
    """Base64 in one line, whatever the session's chunking is."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def word_count(text: Column) -> Column:
    """Words by white space: the token count where a backend reports none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
