"""Text helpers: tokenising, stop words, stripping, chunk headers.

Tokenisation is a built-in regex extraction on lower-cased text (letters and
digits runs), so it runs JVM-side and gives the same tokens as the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# English stop words removed from documents and queries.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing",
    "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more",
    "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once",
    "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same",
    "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with",
    "would", "you", "your", "yours", "yourself", "yourselves",
]


def stop_words_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def tokens(text: Column) -> Column:
    """All tokens of ``text`` in order (array<string>)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def content_tokens(text: Column) -> Column:
    """Tokens without stop words, in order."""
    sw = stop_words_array()
    return F.filter(tokens(text), lambda t: ~F.array_contains(sw, t))


def query_terms_expr(text: Column) -> Column:
    """Distinct non-stop tokens in order of first appearance."""
    return F.array_distinct(content_tokens(text))


# Characters removed by ``strip``: space, \t, \n, \x0b, \f, \r.
WHITESPACE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (a plain trim, no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def chunk_header(artifact_type: Column, number: Column, title: Column) -> Column:
    """``[PULL_REQUEST #12] title``."""
    return F.concat(F.lit("["), F.upper(artifact_type), F.lit(" #"), number.cast("string"),
                    F.lit("] "), F.coalesce(title, F.lit("None")))
