"""Rule-based sentiment with the whole published rule set, map-only.

Method (rules and constants of Hutto & Gilbert 2014, re-stated over token arrays):

* entries of several words: leftmost, longest match first; a matched phrase is one unit;
* a unit wholly in capitals, in a text that is not, moves 0.733 away from zero;
* boosters one to three units before a scored unit move it by their value x (1, 0.95, 0.9),
  by 0.733 more where they stand in capitals as above;
* a negator within the three units before multiplies by -0.74;
* the first contrast word halves what comes before it and lifts what comes after it by half;
* up to four `!` add 0.292 each, two or three `?` add 0.18 each and more of them 0.96, in the
  direction of the sum (and of the larger share).

compound = s / sqrt(s^2 + 15); pos / neg / neu are the shares of (v+1), |v-1| and the number of
unscored units.

Plan: everything is an expression over the arrays of one row, so there is no shuffle, no join
and no row per token. The rules are literals; words of one value share one IN list, which is a
hash-set lookup, so a lexicon of thousands of words costs a few lookups a token.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PUNCTUATION
from ..functions.text import WHITESPACE_RE
from .sentiment import (BOOSTER_DECAY, DEFAULT_BOOSTERS, DEFAULT_LEXICON, DEFAULT_NEGATORS, NEGATION_SCALAR,
                        NORMALISER_ALPHA, sentiment_label)

# Fixed values of the scoring method (published constants).
CAPITALS_INCREMENT = 0.733
EXCLAMATION_STEP, EXCLAMATIONS = 0.292, 4
QUESTION_STEP, QUESTIONS, QUESTION_MOST = 0.18, 3, 0.96
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5

NOT_BLANK_RE = "[^" + WHITESPACE_RE[1:-1]  # any sign but white space
CAPITALS_RE = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


@dataclass(frozen=True)
class SentimentRules:
    """Lower-case entries; those with blanks are phrases."""

    lexicon: Mapping[str, float] = field(default_factory=lambda: DEFAULT_LEXICON)
    negators: Sequence[str] = DEFAULT_NEGATORS
    boosters: Mapping[str, float] = field(default_factory=lambda: DEFAULT_BOOSTERS)
    contrast: Sequence[str] = ("but",)

    def phrases(self) -> list[str]:
        """Entries of several words, those of the most words first."""
        entries = {*self.lexicon, *self.negators, *self.boosters, *self.contrast}
        return sorted((e for e in entries if " " in e), key=lambda e: (-e.count(" "), e))

    def phrase_regex(self) -> str:
        """Matches a phrase in a text whose every word has a blank of its own on either side."""
        words = ["  ".join(re.escape(w) for w in p.split(" ")) for p in self.phrases()]
        return "(?i) (?:" + "|".join(words) + ") "


def looked_up(word: Column, values: Mapping[str, float]) -> Column:
    """The value of `word`, 0 without one."""
    by_value: dict[float, list[str]] = {}
    for entry, value in values.items():
        by_value.setdefault(float(value), []).append(entry)
    if not by_value:
        return F.lit(0.0)
    cases = None
    for value, entries in sorted(by_value.items()):
        cases = (F if cases is None else cases).when(word.isin(entries), F.lit(value))
    return F.when(word.isin(list(values)), cases).otherwise(F.lit(0.0))


def with_units(rows: DataFrame, text: str, rules: SentimentRules, out: str = "_units") -> DataFrame:
    """`rows` + the words and phrases of `text` in their order and case.

    What a later step reads twice is a projection of its own, so that it is computed once.
    """
    def words(part: Column, by: str) -> Column:
        return F.filter(F.split(part, by), lambda w: w != F.lit(""))

    tokens = words(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)), WHITESPACE_RE)
    if not rules.phrases():
        return rows.withColumn(out, tokens)
    regex, spaced = rules.phrase_regex(), F.col("_spaced")
    rows = rows.withColumn("_spaced", F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" ")))
    between, found = F.split(spaced, regex, -1), F.regexp_extract_all(spaced, F.lit(regex), F.lit(0))
    return rows.withColumn(out, F.flatten(F.zip_with(between, found, lambda part, phrase: F.concat(
        words(part, " +"), F.array_compact(F.array(F.replace(F.trim(phrase), F.lit("  "), F.lit(" ")))))))).drop("_spaced")


def occurrences(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def emphasis(text: Column) -> Column:
    """What repeated exclamation and question marks add."""
    questions = occurrences(text, "?")
    return (F.least(occurrences(text, "!"), F.lit(EXCLAMATIONS)) * EXCLAMATION_STEP
            + F.when(questions > QUESTIONS, QUESTION_MOST).when(questions > 1, questions * QUESTION_STEP).otherwise(0.0))


def rule_sentiment(docs: DataFrame, rules: SentimentRules, text: Column | str = "text",
                   keep: Sequence[str] = ("platform", "id")) -> DataFrame:
    """keep + label, compound, pos, neu, neg (rounded to 4), one row for each row of `docs`.

    Null, empty and blank texts are neutral 0/0/1/0; a text of signs alone has no unit and gets
    label neutral and 0/0/0/0.
    """
    given = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_keep"), given.alias("_text"))
    rows = with_units(rows, "_text", rules)
    rows = rows.withColumn("_words", F.transform("_units", F.lower))  # once a unit, not once a rule

    # most words are in no entry: one lookup for them
    entries = sorted({*rules.lexicon, *rules.boosters, *rules.negators, *rules.contrast})

    def facts(unit: Column, word: Column) -> Column:
        def fact(*of: Column) -> Column:
            names = ("value", "boost", "negator", "contrast", "capitals")
            return F.struct(*[c.alias(n) for c, n in zip((*of, unit.rlike(CAPITALS_RE)), names, strict=True)])

        return F.when(word.isin(entries), fact(
            looked_up(word, rules.lexicon), looked_up(word, rules.boosters), word.isin(list(rules.negators)),
            word.isin(list(rules.contrast)))).otherwise(fact(F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False)))

    rows = rows.select("_keep", "_text", F.zip_with("_units", "_words", facts).alias("_facts"))
    rows = rows.select("*", (F.exists("_facts", lambda f: f["capitals"]) & F.exists("_facts", lambda f: ~f["capitals"]))
                       .alias("_mixed"), (F.array_position(F.col("_facts.contrast"), True) - 1).alias("_turn"))

    def scored(fact: Column, at: Column) -> Column:
        value, shouted = fact["value"], F.col("_mixed")
        earlier = [F.get(F.col("_facts"), (at - d).cast("int")) for d in (1, 2, 3)]
        push = F.when(shouted & fact["capitals"], CAPITALS_INCREMENT).otherwise(0.0)
        for unit, decay in zip(earlier, BOOSTER_DECAY):
            louder = F.when(shouted & unit["capitals"], CAPITALS_INCREMENT).otherwise(0.0)
            push = push + F.when(unit["boost"] != 0, (unit["boost"] + louder) * decay).otherwise(0.0)
        negated = F.coalesce(earlier[0]["negator"], F.lit(False))
        for unit in earlier[1:]:
            negated = negated | F.coalesce(unit["negator"], F.lit(False))
        turned = F.when((F.col("_turn") >= 0) & (at < F.col("_turn")), BEFORE_CONTRAST).when(
            (F.col("_turn") >= 0) & (at > F.col("_turn")), AFTER_CONTRAST).otherwise(1.0)
        moved = (value + F.signum(value) * push) * F.when(negated, NEGATION_SCALAR).otherwise(1.0) * turned
        return F.when(value != 0, moved).otherwise(0.0)

    rows = rows.select("_keep", (~F.col("_text").rlike(NOT_BLANK_RE)).alias("_blank"), emphasis(F.col("_text")).alias("_e"),
                       F.transform("_facts", scored).alias("_v"))

    rows = rows.select("_keep", "_blank", "_e", F.size("_v").alias("_units"), F.filter("_v", lambda v: v != 0).alias("_v"))

    def total_of(wanted, part) -> Column:
        return F.aggregate(F.filter("_v", wanted), F.lit(0.0), lambda a, v: a + part(v))

    rows = rows.select("_keep", "_blank", "_e", F.aggregate("_v", F.lit(0.0), lambda a, v: a + v).alias("_s"),
                       total_of(lambda v: v > 0, lambda v: v + 1).alias("_p"),
                       total_of(lambda v: v < 0, lambda v: 1 - v).alias("_n"),
                       (F.col("_units") - F.size("_v")).cast("double").alias("_u"))
    positive = F.col("_p") + F.when(F.col("_p") > F.col("_n"), F.col("_e")).otherwise(0.0)
    negative = F.col("_n") + F.when(F.col("_p") < F.col("_n"), F.col("_e")).otherwise(0.0)
    total = positive + negative + F.col("_u")
    lifted = F.col("_s") + F.signum("_s") * F.col("_e")
    compound = lifted / F.sqrt(lifted * lifted + NORMALISER_ALPHA)

    def share(part: Column, blank: float) -> Column:
        return F.when(F.col("_blank"), blank).when(total > 0, F.round(part / total, 4)).otherwise(0.0)

    return rows.select("_keep.*", F.when(F.col("_blank"), "neutral").otherwise(sentiment_label(compound)).alias("label"),
                       F.when(F.col("_blank"), 0.0).otherwise(F.round(compound, 4)).alias("compound"),
                       share(positive, 0.0).alias("pos"), share(F.col("_u"), 1.0).alias("neu"),
                       share(negative, 0.0).alias("neg"))
