"""Quality rules: a table of thresholds, compiled into one projection.

Every measure of a text is an expression of Spark's own, and so is the verdict:
no user function runs, nothing is shuffled, and each row is judged by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.llm.frames import SPACES, fresh

# The characters counted as symbols, and the least number of words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for as with was by be on are this from at "
    "der die das und ist von mit den nicht ein zu dem auf für im eine als auch es an "
    "le la les de des et en un une du que est pour qui dans par sur au il pas "
    "el los las y del se por con una para como su lo más"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie within ``low`` and ``high``; None sets no bound."""

    measure: str
    low: float | None = None
    high: float | None = None


# Length, symbols, stop words and lines. A rule drops what no prose has; texts of plain prose pass with a wide margin.
RULES = (
    Rule("mean_word_length", 2, 15),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_words_per_word", low=0.02),
    Rule("dup_lines_per_line", high=0.5),
    Rule("exclaimed_per_word", high=0.3),
)
# Judged apart and first: fewer words than this, or more than half of them in repeated windows.
BASE_RULES = (Rule("n_words", low=MIN_WORDS), Rule("percent_repeat_words", high=50))


def compile_rules(rules: Sequence[Rule], measures: Mapping[str, Column]) -> Column:
    """True where every rule holds; a measure that is null breaks none."""
    tests = []
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            tests.append(F.coalesce(value >= rule.low, F.lit(True)))
        if rule.high is not None:
            tests.append(F.coalesce(value <= rule.high, F.lit(True)))
    return reduce(Column.__and__, tests, F.lit(True))


def _ratio(of: Column, to: Column) -> Column:
    return F.when(to > 0, of / to)


def _covered(places: Column) -> Column:
    """Words in the windows that start at the given places, which ascend."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")
        ),
        lambda acc: acc["n"],
    )


def with_quality(
    docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, base_rules: Sequence[Rule] = BASE_RULES
) -> DataFrame:
    """``docs`` with a struct ``quality`` of measures and verdicts behind its columns.

    Fields: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words, n_exclaimed`` (bigint), ``base_failed`` and
    ``kept``. Words are runs without white space; lines are those with a word.
    A null or empty text has no words, so it fails the base rules. Windows of
    words are compared by 64-bit hashes within one text. All steps cost at
    most n log n in the words of a text. A column of the name ``quality`` in
    ``docs`` stays, and the struct is then called ``quality_``.
    """
    (result,) = fresh(docs, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counts = _let(words, lambda w: _let(lines, lambda l: _counts(text, w, l)))
    return docs.withColumn(result, _let(counts, lambda c: _verdicts(c, rules, base_rules)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it and wherever Spark moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counts(text: Column, words: Column, lines: Column) -> Column:
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_exclaimed": F.size(F.filter(words, lambda x: F.endswith(x, F.lit("!!")))),
        "n_other_script": F.length(F.regexp_replace(text, r"[\P{L}\p{IsLatin}]+", "")),
    }
    return F.struct(*[c.cast("bigint").alias(name) for name, c in counts.items()])


def _repeat_words(words: Column) -> Column:
    """Words in windows that come twice or more. Only where there are such windows, all are put in order."""
    windows = F.transform(
        F.slice(words, WINDOW, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), x),
    )
    return _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(
            _let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), _in_repeated)
        ),
    )


def _in_repeated(placed: Column) -> Column:
    """Words covered by windows that equal one next to them in this order, by hash and place."""
    repeated = F.filter(
        placed,
        lambda e, k: (e["x"] == F.get(placed, k + 1)["x"])
        | ((k > 0) & (e["x"] == F.get(placed, F.greatest(k - 1, F.lit(0)))["x"])),
    )
    return _covered(F.sort_array(F.transform(repeated, lambda e: e["i"])))


def _verdicts(counts: Column, rules: Sequence[Rule], base_rules: Sequence[Rule]) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclaimed")
    got = {name: counts[name] for name in names}
    n = got["n_words"]
    measures = got | {
        "percent_repeat_words": _ratio(100 * got["n_repeat_words"], n),
        "mean_word_length": _ratio(got["word_chars"], n),
        "symbols_per_word": _ratio(got["n_symbols"], n),
        # Null where most is in letters of another script than the list's.
        "stop_words_per_word": F.when(2 * counts["n_other_script"] <= got["word_chars"], _ratio(got["n_stop_words"], n)),
        "dup_lines_per_line": _ratio(got["n_dup_lines"], got["n_lines"]),
        "exclaimed_per_word": _ratio(got["n_exclaimed"], n),
    }
    base_failed = ~compile_rules(base_rules, measures)
    return F.struct(
        *[c.alias(name) for name, c in got.items()],
        base_failed.alias("base_failed"),
        (~base_failed & compile_rules(rules, measures)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their columns."""
    judged = with_quality(docs, text_col, rules)
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*docs.columns)
