"""Secret scan: fixed patterns, and a randomness battery with false-discovery control.

Patterns (per kind, leftmost and non-overlapping, spans in code points of the
whole match): ``assign`` a named credential whose value has 12 characters or
more, ``access`` a key id of 18 or more, ``hex`` a run of 16 or more.

Battery: every run of ``[A-Za-z0-9+/_-]`` of ``MIN_LENGTH`` characters or more,
with up to two ``=`` behind it, is a candidate. Its encoding (hex, base32, base64) is inferred from its letters;
runs of digits alone are none. Three tests ask whether it looks drawn evenly
from that alphabet: chi-squared over the letter counts, Wald-Wolfowitz runs
around the alphabet's middle, and the lag-1 serial correlation. A candidate that
one of them rejects at ``REJECT`` (Bonferroni) is ordinary. For the others the
chance that ordinary text of that length spreads as evenly is the p-value: the
chi-squared statistic against its mean and variance under the letter
frequencies of text. Short strings cannot get a small one.

False-discovery control: Benjamini-Hochberg at ``FDR``, over all candidates of
the corpus of the same encoding and length class (power of two). The p-values
are counted in fine bins, so the corpus passes as one small histogram and only
the cut-offs (some dozen numbers) return. What passes is a span ``random``,
unless it lies within a pattern span.

Null is the empty text: no spans. Every row is handled alone, repeated or not;
an empty table has no rows and no cut-offs. All work is column expressions.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.native import let, matches, total

ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # maximal runs: the same spans as runs of any length, then dropped if under 18
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
MIN_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH  # '=' only as padding: in 'sig=...' it stands before the value
REJECT = 0.001
FDR = 0.01
BINS_PER_DECADE = 20
LAST_BIN = 800

ALPHABETS = {
    16: string.digits + "abcdef",
    32: string.ascii_uppercase + "234567",
    64: string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
#: Sum of p^2 and of p^3 over the letters of ordinary text, per alphabet size.
TEXT_MOMENTS = {16: (0.125, 0.02), 32: (0.0667, 0.0054), 64: (0.0667, 0.0054)}
KINDS = ("assign", "access", "hex", "random")

_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
        (m["start"] + F.length(m["text"])).alias("end"))).cast(f"array<{_SPAN}>")


def pattern_spans(text: Column) -> Column:
    """All pattern spans by start, then kind."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = let(value, lambda v: F.filter(
        matches(text, ASSIGN), lambda m, i: F.length(F.get(v, i)) >= MIN_ASSIGN))
    assign = F.when(text.rlike(ASSIGN), _spans(long_enough, "assign")).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return F.sort_array(F.concat(assign, _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")))


def neglog_tail(z: Column) -> Column:
    """-log10 of the upper tail of the normal distribution, for z >= 0 (smaller z: as 0)."""
    x = F.greatest(z, F.lit(0.0))
    # fixed values: the five-term rational approximation of the normal tail
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * x)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    return (x * x / 2 + math.log(math.sqrt(2 * math.pi))) / math.log(10) - F.log10(poly)


def _per_size(size: Column, value) -> Column:
    out = F.lit(None)
    for a in ALPHABETS:
        out = F.when(size == a, value(a)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """struct(size, stratum, bin) of a candidate; null where no encoding fits."""
    core = F.regexp_replace(token, "=+$", "")

    def tests(s: Column) -> Column:
        size = s["size"]
        canon = s["canon"]
        n = F.length(canon)

        def count(part: str | Column, of: Column) -> Column:
            part = F.lit(part) if isinstance(part, str) else part
            return (F.length(of) - F.length(F.replace(of, part, F.lit("")))) / F.length(part)

        def measured(m: Column) -> Column:
            a = size.cast("double")
            nd = n.cast("double")
            squares = total(F.transform(F.array_distinct(m["chars"]), lambda c: F.pow(count(c, canon), 2)), 0.0)
            chi = a * squares / nd - nd
            z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (nd - 1) / nd)
            ones = count("1", m["half"])
            both = 2 * ones * (nd - ones)
            runs = 1 + count("01", m["half"]) + count("10", m["half"])
            spread = both * (both - nd) / (nd * nd * (nd - 1))
            z_runs = F.when(spread > 0, F.abs(runs - both / nd - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))

            def serial(x: Column) -> Column:
                mean = total(x, 0.0) / nd
                return let(F.transform(x, lambda v: v - mean), lambda d: let(
                    total(F.transform(d, lambda v: v * v), 0.0), lambda var: F.when(var > 0, F.abs(total(
                        F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1),
                                   lambda p, q: p * q), 0.0) / var + 1 / nd) * F.sqrt(nd)).otherwise(F.lit(99.0))))
            z_serial = serial(F.transform(m["chars"], lambda c: _per_size(
                size, lambda k: F.instr(F.lit(ALPHABETS[k]), c)).cast("double")))
            # two-sided for runs and correlation; Bonferroni over the three tests
            worst = F.greatest(neglog_tail(z_chi), neglog_tail(z_runs) - math.log10(2),
                               neglog_tail(z_serial) - math.log10(2)) - math.log10(3)
            k2 = _per_size(size, lambda k: F.lit(TEXT_MOMENTS[k][0]))
            k3 = _per_size(size, lambda k: F.lit(TEXT_MOMENTS[k][1]))
            same = (squares - nd) / (nd * (nd - 1))
            sd = F.sqrt((4 * (nd - 2) * (k3 - k2 * k2) + 2 * (k2 - k2 * k2)) / (nd * (nd - 1)))
            neglog = F.when(worst > -math.log10(REJECT), F.lit(0.0)).otherwise(neglog_tail((k2 - same) / sd))
            stratum = size * 100 + F.floor(F.log2(nd)).cast("int")
            return F.struct(size.alias("size"), stratum.alias("stratum"),
                            F.least(F.floor(neglog * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int").alias("bin"))

        half = _per_size(size, lambda k: F.translate(canon, ALPHABETS[k], "0" * (k // 2) + "1" * (k - k // 2)))
        inner = let(F.struct(F.split(canon, "").alias("chars"), half.alias("half")), measured)
        return F.when(size.isNotNull() & (n >= MIN_LENGTH), inner)

    def encoded(c: Column) -> Column:
        size = (F.when(c.rlike("^[0-9]*$"), F.lit(None)).when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(16))
                .when(c.rlike("^[A-Z2-7]+$"), F.lit(32)).when(c.rlike("^[A-Za-z0-9+/_-]+$"), F.lit(64)))
        canon = F.when(size == 16, F.lower(c)).otherwise(F.translate(c, "-_", "+/"))
        return let(F.struct(size.cast("int").alias("size"), canon.alias("canon")), tests)
    return let(core, encoded)


def candidates(text: Column) -> Column:
    """Array of (start, end, stratum, bin) of the candidates that have an encoding."""
    tested = F.transform(matches(text, CANDIDATE), lambda m: let(battery(m["text"]), lambda b: F.struct(
        m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"),
        b["stratum"].alias("stratum"), b["bin"].alias("bin"))))
    return F.filter(tested, lambda c: c["stratum"].isNotNull())


def cutoffs(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """The lowest passing bin of each stratum; strata without discoveries are left out."""
    tests = docs.select(F.explode(candidates(_text(text))).alias("c"))
    bins = tests.groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = bins.select("stratum", "bin", F.sum("n").over(down).alias("rank"),
                         F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    p = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    passing = ranked.where(p <= FDR * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in passing.collect()}  # alphabets x length classes


def find_secrets(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out`` (in place of a column of that name): an array of (start, rank, kind, end) by start, then kind."""
    cut = cutoffs(docs, text)
    pairs = [F.lit(x) for kv in sorted(cut.items()) for x in kv]
    limit = F.create_map(*pairs) if pairs else F.create_map(F.lit(-1), F.lit(0))

    def combined(base: Column) -> Column:
        random = F.filter(candidates(_text(text)), lambda c: (c["bin"] >= F.element_at(limit, c["stratum"]))
                          & ~F.exists(base, lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"])))
        added = F.transform(random, lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")))
        return F.sort_array(F.concat(base, added.cast(f"array<{_SPAN}>")))
    return docs.withColumn(out, let(pattern_spans(_text(text)), combined))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, and overlapping ones together, replaced by ``mark``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark_once = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(mark_once.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)
