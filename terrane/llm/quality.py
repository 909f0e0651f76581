"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged alike;
an empty table gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import fresh, words

#: Frequent function words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "be", "at", "by", "this", "are", "from", "or", "an", "a", "have", "not"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que", "qui", "dans", "pour", "par", "sur", "pas", "au", "il", "ne", "se", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"],
}
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A ratio of two metrics that must lie in [low, high]; either bound may be None."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Base: fewer than 20 words, or over 30 % of the words in repeated windows.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.03, None),
    Rule("upper_case_share", "n_upper", "word_chars", None, 0.5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.4),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper")


def _windows(word_hashes: Column, n: Column) -> Column:
    """A hash for each window of WINDOW words."""
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(word_hashes, i + k) for k in range(WINDOW))))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: sort (hash, start), compare neighbours, add up the union."""
    n = F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.zip_with(F.slice(pairs, F.lit(1), n - 1), F.slice(pairs, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def with_metrics(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with one more column, a struct of METRICS (long), and its name."""
    out, w, g = fresh(df, "_metrics"), fresh(df, "_words"), fresh(df, "_windows")
    stops = sorted({x for some in STOP_WORDS.values() for x in some})
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(w, words(F.col(text)))
    hashed = fresh(df, "_hashes")
    df = df.withColumn(hashed, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(g, _windows(F.col(hashed), F.size(w)))
    lines = fresh(df, "_lines")
    df = df.withColumn(lines, F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.size(F.split(body, SYMBOLS, -1)) - 1,
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(F.col(g))).otherwise(0),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))),
        "n_upper": F.size(F.split(body, "[A-Z]", -1)) - 1,
    }
    df = df.withColumn(out, F.struct(*(c.cast("long").alias(k) for k, c in counts.items())))
    return df.drop(w, hashed, g, lines), out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every rule holds; compared as products, so a zero denominator is no special case."""
    good = F.lit(True)
    for r in rules:
        if r.low is not None:
            good = good & (m[r.over].cast("double") >= F.lit(r.low) * m[r.under])
        if r.high is not None:
            good = good & (m[r.over].cast("double") <= F.lit(r.high) * m[r.under])
    return good


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes the base rule and the table; same columns."""
    columns = df.columns
    df, m = with_metrics(df, text)
    good = fresh(df, "_good")
    # A generator of one row: Catalyst would push a plain filter below the metrics and work them out again for each rule.
    df = df.withColumn(good, F.explode(F.array(~base_failed(F.col(m)) & verdict(F.col(m), rules)))).filter(F.col(good))
    return df.select(*(F.col(f"`{c}`") for c in columns))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, metrics, base_failed and kept for each row."""
    df, m = with_metrics(df.select(key, text), text)
    m = F.col(m)
    return df.select(key, *(m[k].alias(k) for k in METRICS), base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))
