"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``metrics`` measures a text once; ``RULES`` bounds ratios of the measures; ``apply_rules`` turns both into
columns. There is no user function, no join and no shuffle, so the plan is a scan and a projection.

A null text counts as empty. Texts are processed whole. Empty texts have no words and fail the base rule.
An empty table gives no rows, repeated rows give repeated rows. Results are added under the names below;
an input column of the same name is replaced. Windows of three words are compared by 64-bit hashes inside
one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import let

# Fixed values.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "with", "as", "was", "for", "on", "are", "at", "by", "be",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "est", "que", "pour", "dans", "qui", "sur", "par",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "ein", "eine", "für", "auf", "im", "sich", "nicht",
    "el", "los", "las", "y", "una", "se", "del", "por", "con", "para", "al", "lo", "como", "más",
]


@dataclass(frozen=True)
class Rule:
    """``name``: low <= 1000 * part / whole <= high, compared in integers. A whole of 0 passes."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


RULES = [
    Rule("mean_word_length", "word_chars", "n_words", low=2000, high=20000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=300),
    Rule("upper_case", "n_upper", "n_letters", high=500),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
            "n_letters", "n_stop_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in ``words``, the first included."""
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                    F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def count(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def places(pairs: Column) -> Column:
        twin = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["g"] == p["g"], F.lit(False))
                        | F.coalesce(F.get(pairs, i + 1)["g"] == p["g"], F.lit(False)))
        return F.sort_array(F.transform(twin, lambda p: p["i"]))

    def of(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)) \
            .otherwise(let(pairs, lambda s: let(places(s), count)))

    return let(grams, of).cast("long")


def metrics(text: Column | str = "text") -> Column:
    """A struct of ``MEASURES`` (long), each over the whole text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    blank = F.translate(text, SPACES, " " * len(SPACES))
    length = F.length(text)

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, SPACES)) > 0)
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        n_upper = length - F.length(_without(text, upper))
        n_lower = length - F.length(_without(text, upper.lower()))
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
            (length - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            n_upper.cast("long").alias("n_upper"),
            (n_upper + n_lower).cast("long").alias("n_letters"),
            stop.cast("long").alias("n_stop_words"))

    return let(F.filter(F.split(blank, " "), lambda w: w != ""), of)


def verdict(measures: Column, rules: list[Rule]) -> Column:
    """True where no rule is broken."""
    checks = []
    for rule in rules:
        part, whole = measures[rule.part], measures[rule.whole]
        if rule.low is not None:
            checks.append(1000 * part >= rule.low * whole)
        if rule.high is not None:
            checks.append(1000 * part <= rule.high * whole)
    result = F.lit(True)
    for check in checks:
        result = result & check
    return result


def base_failed(measures: Column) -> Column:
    return (measures["n_words"] < 50) | (100 * measures["n_repeat_words"] > 50 * measures["n_words"])


def assess(text: Column | str = "text", rules: list[Rule] | None = None) -> Column:
    """A struct of the measures, base_failed and kept."""
    rules = RULES if rules is None else rules

    def of(m: Column) -> Column:
        return F.struct(*[m[name].alias(name) for name in MEASURES], base_failed(m).alias("base_failed"),
                        (~base_failed(m) & verdict(m, rules)).alias("kept"))

    return let(metrics(text), of)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``quality``: see ``assess``."""
    return docs.withColumn("quality", assess(text_column, rules))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_column: str = "text") -> DataFrame:
    """The rows that pass, with their columns."""
    return docs.where(assess(text_column, rules)["kept"])
