"""Quality rules: a threshold table compiled into one projection, JVM expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
WINDOW = 8
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are by this from be or an at "
    "de la le les des et que un une du pour pas dans sur est par avec au en qui "
    "der die und das den von mit sich ist nicht ein eine dem im für auf als auch zu "
    "el los y se del las por con no una su al lo para es"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric must lie in [low, high]; it only speaks on texts of at least ``words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 20.0, 20),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("marks", "marks_per_word", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, None, 50),
    Rule("repeated_lines", "repeated_line_ratio", None, 0.5),
    Rule("repeated_words", "repeated_word_ratio", None, 0.3),
)


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once, as a bound lambda variable."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur at least twice."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(w: Column) -> Column:
        keyed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            h = lambda i: F.get(s, i)["h"]
            twice = lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda i: F.get(s, i)["i"])

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct(
            (i + width).alias("end"), (acc["n"] + i + width - F.greatest(acc["end"], i)).alias("n")
        )
        return let(keyed, lambda s: F.aggregate(F.sort_array(starts(s)), zero, add, lambda acc: acc["n"]))

    some = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            windows(h),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
        ),
    )
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(some)


def text_metrics(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, the column ``carry`` if named, the counts of the whole text and the ratios that rules use.

    A null or blank text has no words, symbols or lines; ratios over nothing are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    ids = ["doc_id"] + ([carry] if carry else [])
    base = docs.select(
        *ids,
        words.alias("words"),
        count(SPACE_RUN).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("[^!?]").alias("n_marks"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u"))).alias("lines"),
    )
    stop = F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")
    counted = base.select(
        *ids,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.u")).cast("long").alias("n_dup_lines"),
        _repeats(F.col("words"), WINDOW).alias("n_repeat_words"),
        "n_marks",
        stop.alias("n_stop_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b).cast("double"))
    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_marks", "n_words").alias("marks_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("repeated_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeated_word_ratio"),
    )


def compiled(rules: Sequence[Rule]) -> list[Column]:
    """The table as Boolean columns, true where a rule is broken."""
    out = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        out.append((bad & (F.col("n_words") >= r.words)).alias(f"bad_{r.name}"))
    return out


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, ``base_failed``, one flag per rule and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of words in repeated 8-word windows.  ``kept``: no rule broken
    and not base_failed.  Null, empty and blank texts have 0 words and fail.  Other columns are ignored; rows with
    equal doc_id are judged one by one.
    """
    measured = text_metrics(docs, carry)
    flags = compiled(rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.select("*", failed.alias("base_failed"), *flags)
    any_bad = reduce(lambda a, b: a | b, [F.col(f"bad_{r.name}") for r in rules], F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~any_bad)
