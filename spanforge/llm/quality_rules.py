"""Quality rules: a threshold table compiled into one Spark projection.

Every signal is a column expression over the whole text; no function of the user's is
called. Words are runs of anything but space and the five ASCII control blanks.

Cases: a null or empty text has no words, all signals zero, and fails the base rule; a
very long text is handled in its row; repeated rows are judged alike; an empty table
gives an empty result; columns with the names of output columns are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# fixed values: frequent function words of the corpus languages
STOP_WORDS = (
    "the and of to in is that it for was on are with this "
    "der die das und ist in den von zu mit nicht ein eine im "
    "le la les de des et en un une du que est pour dans "
    "el los las del y que en un una por con se"
).split()


class Rule(NamedTuple):
    """A signal must lie in [low, high]; None leaves a side open."""

    name: str
    signal: str
    low: float | None
    high: float | None


RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.15),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.3),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has at least twice.

    Windows with their positions are sorted as rows of strings, so equal ones are
    neighbours; the positions found are sorted and each adds at most three words.
    """

    def covered(sorted_windows: Column) -> Column:
        m = F.size(sorted_windows)
        pairs = F.zip_with(
            F.slice(sorted_windows, F.lit(1), m - 1), F.slice(sorted_windows, F.lit(2), m - 1),
            lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["at"], y["at"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        return _let(places, lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(
            F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"), lambda total, x: total + x)))

    n = F.size(words)
    windows = F.arrays_zip(
        F.slice(words, F.lit(1), n - 2).alias("a"), F.slice(words, F.lit(2), n - 2).alias("b"),
        F.slice(words, F.lit(3), n - 2).alias("c"), F.sequence(F.lit(0), n - 3).alias("at"))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), covered))


def _counts(whole: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(whole) - _without(whole, BLANKS)).cast("long"),
        "n_symbols": _without(whole, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def _ratios(whole: Column, lines: Column, count) -> dict[str, Column]:
    """Ratios of the counts that ``count`` gives by name."""
    stop = "(?<![^\\x20\\x09-\\x0D])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + ")(?=[.,;:]?(?:[\\x20\\x09-\\x0D]|$))"
    per_word, per_line = F.greatest(count("n_words"), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    return {
        "mean_word_length": count("word_chars") / per_word,
        "symbol_ratio": count("n_symbols") / per_word,
        "exclamation_ratio": _without(whole, "!?") / per_word,
        "stop_word_ratio": F.regexp_count(F.lower(whole), F.lit(stop)) / per_word,
        "duplicate_line_ratio": count("n_dup_lines") / per_line,
        "bullet_line_ratio": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))) / per_line,
        "ellipsis_line_ratio": F.size(F.filter(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))) / per_line,
    }


def _lines_of(whole: Column) -> Column:
    return F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def _base_failed(signal) -> Column:
    return (signal("n_words") < 50) | (100 * signal("n_repeat_words") > 50 * signal("n_words"))


def _broken(rule: Rule, signal) -> Column:
    value, bad = signal(rule.signal), F.lit(False)
    if rule.low is not None:
        bad = bad | (value < rule.low)
    if rule.high is not None:
        bad = bad | (value > rule.high)
    return bad


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules are about."""
    whole = F.coalesce(F.col(text), F.lit(""))
    arrays = docs.withColumns({"__words": words_of(whole), "__lines": _lines_of(whole)})
    counted = arrays.withColumns(_counts(whole, F.col("__words"), F.col("__lines")))
    return counted.withColumns(_ratios(whole, F.col("__lines"), F.col)).drop("__words", "__lines")


def verdicts(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the signals, base_failed, failed_rules (names) and kept."""
    checks = [F.when(_broken(rule, F.col), F.lit(rule.name)) for rule in rules]
    failed = with_signals(docs, text).withColumns({
        "base_failed": _base_failed(F.col),
        "failed_rules": F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"),
    })
    return failed.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def passes(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text passes, as one condition.

    A filter is pushed below the projection that makes its columns, which then are
    worked out again wherever they are named; here arrays, counts and ratios are each
    bound once per row.
    """

    def judged(parts: Column) -> Column:
        whole, words, lines = parts["text"], parts["words"], parts["lines"]

        def verdict(counts: Column) -> Column:
            def decide(ratios: Column) -> Column:
                def signal(name: str) -> Column:
                    return ratios[name] if name in ratio_names else counts[name]

                bad = _base_failed(signal)
                for rule in rules:
                    bad = bad | _broken(rule, signal)
                return ~bad

            ratios = _ratios(whole, lines, lambda name: counts[name])
            ratio_names = set(ratios)
            return _let(F.struct(*(c.alias(n) for n, c in ratios.items())), decide)

        return _let(F.struct(*(c.alias(n) for n, c in _counts(whole, words, lines).items())), verdict)

    whole = F.coalesce(text, F.lit(""))
    return _let(F.struct(whole.alias("text"), words_of(whole).alias("words"), _lines_of(whole).alias("lines")), judged)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text passes, unchanged; no column is added."""
    return docs.filter(passes(F.col(f"`{text}`"), rules))
