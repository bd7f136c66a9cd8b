"""Encyclopedia markup as Column expressions: categories, values, infobox, abstract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import let, record
from entitylake.rules import INFOBOX_FIELDS

# The markup patterns that results depend on.
CATEGORY = r"(?iu)\[\[Category:([^\]|]+)"
LINK = r"\[\[([^\]|]+\|)?([^\]]+)\]\]"
LINK_LABEL = "$2"
TEMPLATE = r"\{\{[^\}]+\}\}"
TAG = r"<[^>]+>"
REFERENCE = r"(?s)<ref[^>]*>.*?</ref>"
CITATION = r"\{\{[Cc]ite[^}]*\}\}"
FOOTNOTE = r"\{\{[Ee]fn[^}]*\}\}"
EMPHASIS = r"'{2,}"
HORIZONTAL_LIST = r"(?iU)\{\{hlist\s*\|([^}]+)\}\}"
FLAT_LIST = r"(?iU)\{\{flatlist\s*\|([^}]+)\}\}"
INFOBOX = r"(?is)\{\{Infobox[^{]+?\n(.*?)\n\}\}"
FIELD_VALUE = r"([^\n|]+)"
FIELD_VALUE_WITH_TEMPLATES = r"((?:\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|[^\n|])++)"
LEFTOVER_BRACES = r"\}\}+"
SKIPPED_LINE_STARTS = ("{{", "[[", "|", "#")
SKIPPED_CLEAN_STARTS = ("}}", "|")
HEADING_START = "=="
ABSTRACT_LENGTH = 500


# What a text must contain for the pattern to match: a byte search that spares most texts the pattern.
NEEDED = {
    LINK: "[[",
    TEMPLATE: "{{",
    TAG: "<",
    REFERENCE: "<ref",
    CITATION: "{{",
    FOOTNOTE: "{{",
    EMPHASIS: "''",
    HORIZONTAL_LIST: "{{",
    FLAT_LIST: "{{",
    LEFTOVER_BRACES: "}}",
}


def _replace(c: Column, pattern: str, replacement: str) -> Column:
    return let(
        c,
        lambda v: F.when(
            F.contains(v, F.lit(NEEDED[pattern])), F.regexp_replace(v, pattern, replacement)
        ).otherwise(v),
    )


def _drop(c: Column, *patterns: str) -> Column:
    return reduce(lambda value, pattern: _replace(value, pattern, ""), patterns, c)


def _link_labels(c: Column) -> Column:
    return _replace(c, LINK, LINK_LABEL)


def _body(c: Column, pattern: str) -> Column:
    return F.when(F.contains(c, F.lit(NEEDED[pattern])), X.first_match(c, pattern))


def tagged_values(c: Column | str, pattern: str) -> Column:
    """Stripped first groups of all matches, in text order."""
    return F.transform(X.all_matches(c, pattern, 1), X.strip)


def categories(c: Column | str) -> Column:
    return tagged_values(c, CATEGORY)


def clean_value(c: Column | str) -> Column:
    """Plain text of one infobox value, null when nothing is left.

    Tags are dropped before reference bodies, so the text between ``<ref>`` and
    ``</ref>`` survives in values (kept on purpose; the abstract drops it).
    """

    def plain(raw: Column) -> Column:
        flat = F.coalesce(_body(raw, FLAT_LIST), raw)
        return X.blank_to_null(X.squeeze(_drop(_link_labels(flat), TEMPLATE, TAG, REFERENCE)))

    return let(X.col(c), plain)


def clean_list(c: Column | str) -> Column:
    """The value as an array: the items of a horizontal list, else the single plain value.

    Null when nothing is left.  ``{{hlist|[[A b]]|c}}`` gives ``[A b, c]``.
    """

    def items(body: Column) -> Column:
        cleaned = F.transform(
            F.split(body, r"\|"), lambda item: X.strip(_drop(_link_labels(item), TAG))
        )
        return F.filter(cleaned, lambda item: item != "")

    def either(raw: Column) -> Column:
        values = F.coalesce(
            let(_body(raw, HORIZONTAL_LIST), items),
            F.filter(F.array(clean_value(raw)), lambda v: v.isNotNull()),
        )
        return let(values, lambda v: F.when(F.size(v) > 0, v))

    return let(X.col(c), either)


def infobox(c: Column | str) -> Column:
    """The first infobox block, null without one."""
    return X.first_match(c, INFOBOX, 0)


def infobox_fields(
    c: Column | str, fields: dict[str, str] = INFOBOX_FIELDS, whole_templates: bool = False
) -> Column:
    """Struct of the first value of each field in the first infobox.

    By default a value ends at the first ``|``, even inside a link or template:
    ``[[Rock music|Rock]]`` gives ``[[Rock music``.  ``whole_templates=True``
    reads over links and templates instead and gives each field as the list of its
    values: several for a horizontal list, null when nothing is left.
    """
    value = FIELD_VALUE_WITH_TEMPLATES if whole_templates else FIELD_VALUE

    def read(block: Column) -> Column:
        raw = [X.first_match(block, rf"(?iU)\|\s*(?:{names})\s*=\s*{value}") for names in fields.values()]
        # One cleaning expression for all fields keeps the plan small.
        clean = clean_list if whole_templates else clean_value
        cleaned = F.transform(F.array(*raw), lambda v: clean(X.strip(v)))
        return let(
            cleaned, lambda values: record(**{name: F.get(values, i) for i, name in enumerate(fields)})
        )

    return let(infobox(c), read)


def _clean_line(line: Column) -> Column:
    without_markup = _drop(_link_labels(line), EMPHASIS, REFERENCE, CITATION, FOOTNOTE, TAG, TEMPLATE)
    return X.squeeze(without_markup)


def abstract(c: Column | str) -> Column:
    """The opening paragraph in plain text.

    A fold over the lines carrying (open templates, finished, text so far).  A
    line inside a template is skipped; a heading ends the fold, as does a blank
    line after the first text and more than 500 characters of text.  Lines that
    start with a template, link, table or list sign are skipped as well, so a
    paragraph opening with a link is lost (kept on purpose).  Once finished, a
    line costs one comparison.
    """

    def state(depth: Column, done: Column, text: Column) -> Column:
        return record(depth=depth, done=done, text=text)

    def add_line(s: Column, depth: Column, line: Column) -> Column:
        def decide(clean: Column) -> Column:
            longer = F.when(s["text"] == "", clean).otherwise(F.concat(s["text"], F.lit(" "), clean))
            return (
                F.when(X.starts_with_any(clean, SKIPPED_CLEAN_STARTS), state(depth, s["done"], s["text"]))
                .when(
                    clean != "",
                    let(longer, lambda t: state(depth, F.length(t) > ABSTRACT_LENGTH, t)),
                )
                .otherwise(state(depth, s["text"] != "", s["text"]))
            )

        return let(_clean_line(line), decide)

    def step(s: Column, line: Column) -> Column:
        opened = X.count_of(line, "{{") - X.count_of(line, "}}")

        def outside(depth: Column) -> Column:
            return (
                F.when(depth > 0, state(depth, s["done"], s["text"]))
                .when(F.startswith(line, F.lit(HEADING_START)), state(depth, F.lit(True), s["text"]))
                .when(
                    X.starts_with_any(line, SKIPPED_LINE_STARTS),
                    state(depth, s["done"], s["text"]),
                )
                .otherwise(add_line(s, depth, line))
            )

        return F.when(s["done"], s).otherwise(let((s["depth"] + opened).cast("int"), outside))

    return F.aggregate(
        F.split(X.col(c), "\n"),
        state(F.lit(0), F.lit(False), F.lit("")),
        step,
        lambda s: X.strip(_drop(s["text"], LEFTOVER_BRACES)),
    )
