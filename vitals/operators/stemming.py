"""English stems as column expressions (H6), meant for distinct terms.

The steps of the English Snowball stemmer: regions R1 and R2, plural and
past endings, the three suffix lists and the final e and l. A region is
kept as the length of the word before it, since only ends of words change.
Words of two letters or less, and words in other scripts, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exceptional words, prefixes of R1 and suffix lists of the English Snowball stemmer.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
R1_PREFIXES = ["gener", "commun", "arsen"]
SUFFIXES_IN_R1 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"),
    ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
]
DERIVED_IN_R1 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
]
DELETED_IN_R2 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous",
                 "al", "er", "ic"]

_SHORT_SYLLABLE = r"([^aeiouy][aeiouy][^aeiouywxY]$)|(^[aeiouy][^aeiouy]$)"
_REGION = r"[^aeiouy]*[aeiouy]+[^aeiouy]"


def _cut(w: Column, n) -> Column:
    """The word without its last ``n`` letters."""
    return F.left(w, F.length(w) - n)


def _last(w: Column, *suffixes: str) -> Column:
    """The longest of the suffixes (patterns) that the word ends in, or an empty string: one pattern, as a branch per suffix is long code."""
    return F.regexp_extract(w, "(" + "|".join(suffixes) + r")\z", 1)


def _in(region: Column, w: Column, suffix: Column) -> Column:
    return F.length(w) - F.length(suffix) >= region


def _swapped(w: Column, suffix: Column, pairs: dict[str, str], region: Column) -> Column:
    """The word with another ending, where its suffix lies in the region."""
    by = F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), suffix)
    return F.when((suffix != "") & _in(region, w, suffix), F.concat(_cut(w, F.length(suffix)), by)).otherwise(w)


def with_stems(terms, term: str = "term", out: str = "stem"):
    """``terms`` with the stem of a column of lower-case words.

    Every step is a projection of its own, so its word is computed once and not
    once per mention in the next step. All steps become one method, which the JVM
    compiles up to 8,000 bytes of code only.
    """
    keep = terms.columns
    w, suffix = F.col("__w"), F.col("__s")

    def step(df, value: Column):
        return df.withColumn("__w", value)

    marked = F.regexp_replace(F.col(term), r"^y|(?<=[aeiouy])(?<!^y)y", "Y")
    df = terms.withColumn("__w", marked)
    df = df.withColumn("__s", F.regexp_extract(w, "^(" + "|".join([*R1_PREFIXES, _REGION]) + ")", 1))
    df = df.withColumn("__r1", F.when(suffix == "", F.length(w)).otherwise(F.length(suffix)))
    df = df.withColumn("__s", F.regexp_extract(F.substring(w, F.col("__r1") + 1, F.length(w)), "^(" + _REGION + ")", 1))
    df = df.withColumn("__r2", F.when(suffix == "", F.length(w)).otherwise(F.col("__r1") + F.length(suffix)))
    r1, r2 = F.col("__r1"), F.col("__r2")

    ies = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    df = step(df, F.when(F.endswith(w, F.lit("sses")), _cut(w, 2)).when(w.rlike("(ied|ies)$"), ies)
              .when(w.rlike("[aeiouy].*[^us]s$"), _cut(w, 1)).otherwise(w))
    df = df.withColumn("__kept", F.when(w.isin(KEPT_AFTER_PLURAL), w))

    df = df.withColumn("__s", _last(w, "eed", "eedly", "ed", "edly", "ing", "ingly"))
    bare, eed = _cut(w, F.length(suffix)), F.startswith(suffix, F.lit("ee"))
    df = df.withColumn("__past", (suffix != "") & ~eed & bare.rlike("[aeiouy]"))
    df = step(df, F.when(F.col("__past"), bare).when(eed & _in(r1, w, suffix), F.concat(bare, F.lit("ee"))).otherwise(w))
    lacks_e = w.rlike("(at|bl|iz)$") | ((r1 >= F.length(w)) & w.rlike(_SHORT_SYLLABLE))
    df = step(df, F.when(F.col("__past") & lacks_e, F.concat(w, F.lit("e")))
              .when(F.col("__past") & w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(w, 1)).otherwise(w))

    df = step(df, F.when(w.rlike("..*[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))

    pairs = {**dict(SUFFIXES_IN_R1), "ogi": "og", "li": ""}
    df = df.withColumn("__s", _last(w, *dict(SUFFIXES_IN_R1), "(?<=l)ogi", "(?<=[cdeghkmnrt])li"))
    df = step(df, _swapped(w, suffix, pairs, r1))

    pairs = {**dict(DERIVED_IN_R1), "ative": ""}
    df = df.withColumn("__s", _last(w, *pairs))
    df = step(df, _swapped(w, suffix, pairs, F.when(suffix == "ative", r2).otherwise(r1)))

    df = df.withColumn("__s", _last(w, *DELETED_IN_R2, "(?<=[st])ion"))
    df = step(df, F.when(_in(r2, w, suffix), _cut(w, F.length(suffix))).otherwise(w))

    last_e = _in(r2, w, F.lit("e")) | (_in(r1, w, F.lit("e")) & ~_cut(w, 1).rlike(_SHORT_SYLLABLE))
    df = step(df, F.when((F.endswith(w, F.lit("e")) & last_e) | (F.endswith(w, F.lit("ll")) & _in(r2, w, F.lit("l"))), _cut(w, 1)).otherwise(w))

    exceptions = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    stem = F.when(F.length(F.col(term)) <= 2, F.col(term)).otherwise(
        F.coalesce(F.element_at(exceptions, F.col(term)), F.col("__kept"), F.replace(w, F.lit("Y"), F.lit("y"))))
    return df.select(*keep, stem.alias(out))
