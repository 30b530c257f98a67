"""Statement audit (B21) and ad-hoc read-only SQL rendered as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values of the read-only gate: characters dropped from the front, allowed first words, forbidden character.
GATE_LEADING = "-– \n"
GATE_FIRST_WORDS = ["SELECT", "WITH"]
GATE_FORBIDDEN = ";"

_LEAD = "^[" + re.escape(GATE_LEADING) + "]+"
_HEAD = "^(" + "|".join(GATE_FIRST_WORDS) + r")([^\p{L}\p{N}_]|$)"


def statement_verdict(query: Column) -> tuple[Column, Column]:
    """(is_safe, reason) for a column of statement texts; reason is
    ``not_select``, ``semicolon`` or NULL."""
    norm = F.upper(F.regexp_replace(strip(query), _LEAD, ""))
    starts = F.coalesce(norm.rlike(_HEAD), F.lit(False))
    semi = F.coalesce(query.contains(GATE_FORBIDDEN), F.lit(False))
    reason = F.when(~starts, "not_select").when(semi, "semicolon")
    return reason.isNull(), reason


def statement_audit(texts: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    ok, reason = statement_verdict(F.col(text_col))
    return texts.select(*keys, ok.alias("is_safe"), reason.alias("reason"))


def is_safe_statement(spark: SparkSession, query: str) -> bool:
    """The gate for a single statement, by the same expression (used before it goes to ``spark.sql``)."""
    return spark.range(1).select(statement_verdict(F.lit(query))[0]).first()[0]


def _as_text(c: Column, dtype: str) -> Column:
    if dtype == "boolean":
        return F.when(c, "True").when(~c, "False").otherwise("None")
    return F.coalesce(c.cast("string"), F.lit("None"))


def adhoc_table_text(spark: SparkSession, tables: dict[str, DataFrame], statement: str,
                     max_rows: int = 50) -> DataFrame:
    """Run a read-only statement over named tables; at most ``max_rows`` rows,
    each rendered as ``v1 | v2 | ...`` with NULL shown as ``None``."""
    if not is_safe_statement(spark, statement):
        raise ValueError("only SELECT queries are permitted")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    res = spark.sql(statement).limit(max_rows)
    parts = [_as_text(F.col(f"`{n}`"), t) for n, t in res.dtypes]
    return res.select(F.concat_ws(" | ", *parts).alias("line"))
