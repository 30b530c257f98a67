"""Quality rules as a short-circuit cascade.

A rule is a named condition on the text that rejects it. On a bounded sample
(``SAMPLE_ROWS`` texts of ``SAMPLE_BYTES`` at most) each rule's time and the share that it rejects are measured, and the rules are
tried in the order of rejection per cost: the first that rejects ends the
evaluation of a row (``CASE`` stops there). The order changes the cost alone,
never the verdict.

Words are runs of characters other than space and U+0009 to U+000D. Null has no
words and is rejected by the first rule that applies to few words. Every row is
judged alone; without rows the result is empty. All work is column expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.native import let, total

SAMPLE_ROWS = 1000
SAMPLE_BYTES = 64 << 10
SPACE = " \t\n\u000b\f\r"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def removed(text: Column, pattern: str) -> Column:
    """Number of characters that the one-character pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def filled_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)


def dup_lines(text: Column) -> Column:
    return let(filled_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash chained over their words. Sorting
    (hash, place) brings equal windows together; then each place adds the words
    up to the next one, three at most.
    """
    zero = F.lit(0).cast("long")

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, zero).otherwise(let(h, repeated))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(pairs, covered))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (
            (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: total(F.transform(
            p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))).cast("long"))
    return let(words, windows)


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the text and its measures."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, t.alias("__text"), words(t).alias("__words"))
    w = F.col("__words")
    return split.select(
        *keep, F.col("__text").alias("text"), F.size(w).cast("long").alias("n_words"),
        word_chars(w).alias("word_chars"), removed(F.col("__text"), SYMBOLS).alias("n_symbols"),
        dup_lines(F.col("__text")).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"))


def text_rules(text: Column) -> dict[str, Column]:
    """The rules as conditions on a text alone."""
    w = words(text)
    return rules(text, F.size(w).cast("long"), word_chars(w), removed(text, SYMBOLS), dup_lines(text), repeat_words(w))


def rules(text: Column, n_words: Column, chars: Column, symbols: Column, dups: Column,
          repeats: Column) -> dict[str, Column]:
    """The rules over given measures; each is true for texts to reject."""
    return {
        "few_words": n_words < 50,
        "repeated_words": 100 * repeats > 50 * n_words,
        "symbols": 10 * symbols > n_words,  # one symbol in ten words, the usual published ratio
        "capitals": 10 * removed(text, "[A-Z]") > 4 * chars,
        "word_length": (chars > 25 * n_words) | (chars < 2 * n_words),
        "same_lines": 10 * dups > 8 * F.size(F.split(text, "\n")),
    }


def rule_order(docs: DataFrame, text: str = "text", make: Callable[[Column], dict[str, Column]] = text_rules,
               sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejected share per second beyond that of an empty rule, measured on a sample of ``sample_rows`` at most."""
    picked = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    picked = picked.where((F.pmod(F.xxhash64("t"), F.lit(16)) == 0) & (F.octet_length("t") <= SAMPLE_BYTES))
    sample = docs.sparkSession.createDataFrame(picked.take(sample_rows), "t string")

    def measured(rule: Column) -> tuple[float, float]:
        """(share rejected, seconds) of a rule."""
        began = time.perf_counter()
        n, hit = sample.agg(F.count("*"), F.count_if(rule)).first()
        return hit / max(1, n), time.perf_counter() - began

    conditions = make(F.col("t"))
    nothing = F.length("t") < 0
    measured(nothing)  # the first job pays for the session
    base = min(measured(nothing)[1] for _ in range(3))  # what a job costs besides its rule
    found = {}
    for name, rule in conditions.items():
        share, seconds = measured(rule)
        found[name] = share / max(seconds - base, 1e-3)
    return sorted(found, key=lambda x: (-found[x], x))


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(name)).otherwise(verdict)
    return verdict


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.where(cascade(text_rules(t), rule_order(docs, text)).isNull())
