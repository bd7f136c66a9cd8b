"""Rule-based typing of pages and the false-match test on linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record
from entitylake.rules import FalseMatchRules, TypeRules

OFF_TOPIC = "off_topic"
NO_EVIDENCE = "no_evidence"
WORD_WITHOUT_CATEGORY = "word_without_category"
NO_TYPE = "no_type"


def entity_decision(
    title: Column, text: Column, categories: Column, rules: TypeRules | None = None
) -> Column:
    """Struct (type, reason): exactly one of the two is null.

    The tests are substring tests ("mc" is found in "McCartney") except the
    whole-word one.  Reasons, first match wins: an off-topic category; neither a
    signal nor the whole word; the whole word alone without a known category; no
    rule that yields a type.
    """
    rules = rules or TypeRules()

    def decide(cats: Column, heading: Column) -> Column:
        both = F.concat(heading, F.lit(" "), cats)
        has_signal = X.contains_any(both, rules.signals)
        has_word = _whole_word(both, rules.whole_word)
        known = X.contains_any(cats, [w for _, words in rules.types for w in words])
        kind = F.coalesce(
            *[F.when(X.contains_any(cats, words), F.lit(name)) for name, words in rules.types],
            F.when(X.contains_any(heading, rules.title_words), F.lit(rules.title_words_type)),
            F.when(_whole_word(heading, rules.whole_word), F.lit(rules.whole_word_type)),
            F.when(text.rlike(rules.infobox), F.lit(rules.infobox_type)),
        )
        reason = (
            F.when(X.contains_any(cats, rules.off_topic), F.lit(OFF_TOPIC))
            .when(has_signal, F.lit(None))
            .when(~has_word, F.lit(NO_EVIDENCE))
            .when(~known, F.lit(WORD_WITHOUT_CATEGORY))
        )
        return let(
            reason,
            lambda r: let(
                F.when(r.isNull(), kind),
                lambda k: record(
                    type=k, reason=F.when(k.isNull(), F.coalesce(r, F.lit(NO_TYPE)))
                ),
            ),
        )

    joined = F.lower(F.array_join(categories, " "))
    return let(joined, lambda cats: let(F.lower(title), lambda heading: decide(cats, heading)))


def _whole_word(c: Column, word: str) -> Column:
    return c.rlike(rf"(?iU)\b{X.java_literal(word)}\b")


def classify(
    pages: DataFrame,
    title: str = "title",
    text: str = "text",
    categories: str = "categories",
    rules: TypeRules | None = None,
) -> DataFrame:
    """The rows that are entities, with their ``type``."""
    decision = entity_decision(F.col(title), F.col(text), F.col(categories), rules)
    return pages.select("*", keep_if(decision, lambda d: d["type"].isNotNull())).drop("reason")


def classify_stats(
    pages: DataFrame,
    title: str = "title",
    text: str = "text",
    categories: str = "categories",
    rules: TypeRules | None = None,
) -> DataFrame:
    """Number of pages per outcome: the type for accepted ones, else the reason."""
    decision = entity_decision(F.col(title), F.col(text), F.col(categories), rules)
    return (
        pages.select(decision.alias("d"))
        .groupBy(
            F.when(F.col("d.type").isNull(), F.lit("rejected"))
            .otherwise(F.lit("accepted"))
            .alias("outcome"),
            F.coalesce("d.type", "d.reason").alias("detail"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def false_match(categories: Column | str, rules: FalseMatchRules | None = None) -> Column:
    """Whether the categories speak against a link.

    A protected phrase always keeps the record; otherwise a wrong phrase drops
    it, and so do more than ``max_off_topic`` categories without one on-topic word.
    Missing categories count as none.
    """
    rules = rules or FalseMatchRules()

    def test(items: Column) -> Column:
        return let(
            F.lower(F.array_join(items, " ")),
            lambda cats: F.when(X.contains_any(cats, rules.protected), False)
            .when(X.contains_any(cats, rules.wrong), True)
            .otherwise(
                ~X.contains_any(cats, rules.on_topic) & (F.size(items) > rules.max_off_topic)
            ),
        )

    return let(F.coalesce(X.col(categories), F.array().cast("array<string>")), test)
