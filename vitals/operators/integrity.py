"""Integrity checks (A16): the rules of all tables as data, counted in one pass per table.

Spark enforces no keys, so NOT NULL, CHECK, UNIQUE and foreign-key rules become
counts of what breaks them. Each row of a table is scanned once and gives, per rule, at
most one entry (rule, key, side); entries of all tables meet in one aggregate by
(rule, key), folded on the map side first, so a repository with most events is
one row per task. A rule that holds reports 0.

* NOT NULL and CHECK count rows (NULL passes a CHECK);
* UNIQUE counts key values that occur more than once (keys with a NULL pass);
* a foreign key counts child rows whose non-NULL key no parent row has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANOMALY_STATUSES, ANOMALY_TYPES, CITATION_TYPES, CONFIDENCES


@dataclass(frozen=True)
class Rule:
    table: str
    name: str
    kind: str  # not_null, check, unique or foreign
    columns: tuple[str, ...]
    values: tuple[str, ...] = ()
    parent: tuple[str, str] = ("", "")


def not_null(table: str, *columns: str) -> list[Rule]:
    return [Rule(table, f"not_null_{c}", "not_null", (c,)) for c in columns]


def check(table: str, name: str, column: str, values: list[str]) -> list[Rule]:
    return [Rule(table, name, "check", (column,), tuple(values))]


def unique(table: str, name: str, *columns: str) -> list[Rule]:
    return [Rule(table, name, "unique", columns)]


def foreign(table: str, name: str, column: str, parent: str, parent_column: str) -> list[Rule]:
    return [Rule(table, name, "foreign", (column,), parent=(parent, parent_column))]


# The rules of the engine's tables. Tables without an id of their own have their natural key.
RULES: list[Rule] = [
    *unique("repos", "pk_id_unique", "id"), *not_null("repos", "id", "name"), *unique("repos", "unique_name", "name"),
    *unique("events", "pk_id_unique", "id"), *not_null("events", "id", "type", "repo_name", "created_at"),
    *foreign("events", "fk_repo", "repo_name", "repos", "name"),
    *unique("repo_metrics_daily", "unique_repo_date", "repo_name", "date"),
    *not_null("repo_metrics_daily", "repo_name", "date", "star_count", "fork_count", "issue_opened", "issue_closed",
              "pr_opened", "pr_merged", "commit_count"),
    *foreign("repo_metrics_daily", "fk_repo", "repo_name", "repos", "name"),
    *unique("github_artifacts", "pk_id_unique", "artifact_id"),
    *unique("github_artifacts", "unique_repo_type_number", "repo_name", "type", "number"),
    *check("github_artifacts", "check_type", "type", ["issue", "pull_request"]),
    *not_null("github_artifacts", "repo_name", "type", "number"),
    *foreign("github_artifacts", "fk_repo", "repo_name", "repos", "name"),
    *unique("artifact_chunks", "unique_artifact_chunk", "artifact_id", "chunk_index"),
    *not_null("artifact_chunks", "artifact_id", "chunk_index", "text", "repo_name", "artifact_type"),
    *foreign("artifact_chunks", "fk_artifact", "artifact_id", "documents", "artifact_id"),
    *unique("anomalies", "pk_id_unique", "id"),
    *check("anomalies", "check_type", "anomaly_type", ANOMALY_TYPES),
    *check("anomalies", "check_status", "status", ANOMALY_STATUSES),
    *not_null("anomalies", "repo_name", "anomaly_type", "detected_at", "window_start", "window_end", "metric_name",
              "baseline_value", "observed_value", "z_score", "status"),
    *foreign("anomalies", "fk_repo", "repo_name", "repos", "name"),
    *unique("investigation_reports", "pk_id_unique", "id"),
    *check("investigation_reports", "check_confidence", "confidence", CONFIDENCES),
    *not_null("investigation_reports", "anomaly_id", "created_at"),
    *foreign("investigation_reports", "fk_anomaly", "anomaly_id", "anomalies", "id"),
    *check("report_citations", "check_type", "citation_type", CITATION_TYPES),
    *not_null("report_citations", "report_id", "citation_type"),
    *foreign("report_citations", "fk_report", "report_id", "investigation_reports", "id"),
    *foreign("embeddings", "fk_document", "vec_id", "documents", "artifact_id"),
]


def _key(columns: tuple[str, ...]) -> Column:
    """The key as text; null where a part is."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(known, F.to_json(F.struct(*columns)))


def _entries(table: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, key, child, parent): what each row of a table has to say, from one scan."""
    out = []

    def entry(number: int, key: Column, child: int, parent: int, when: Column) -> None:
        out.append(F.when(when, F.struct(F.lit(number).alias("rule"), key.alias("key"),
                                         F.lit(child).cast("long").alias("child"), F.lit(parent).cast("long").alias("parent"))))
    nothing = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        if r.table == table:
            key = _key(r.columns)
            if r.kind == "not_null":
                entry(i, nothing, 1, 0, F.col(r.columns[0]).isNull())
            elif r.kind == "check":
                c = F.col(r.columns[0])
                entry(i, nothing, 1, 0, c.isNotNull() & ~c.isin(*r.values))
            else:
                entry(i, key, 1, 0, key.isNotNull())
        if r.kind == "foreign" and r.parent[0] == table:
            key = _key((r.parent[1],))
            entry(i, key, 0, 1, key.isNotNull())
    return df.select(F.explode(F.array(*out)).alias("e")).where("e is not null").select("e.*")


def constraint_violations(tables: dict[str, DataFrame], rules: list[Rule] | None = None) -> DataFrame:
    """(table_name, rule, violations) for every rule, from one scan of each table that a rule names."""
    rules = RULES if rules is None else rules
    named = {r.table for r in rules} | {r.parent[0] for r in rules if r.kind == "foreign"}
    entries = reduce(DataFrame.unionByName, [_entries(t, tables[t], rules) for t in sorted(named)])
    per_key = entries.groupBy("rule", "key").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r.kind))])
    kind = F.element_at(kinds, F.col("rule"))
    broken = (F.when(kind == "unique", (F.col("child") > 1).cast("long"))
              .when(kind == "foreign", F.when(F.col("parent") == 0, F.col("child")).otherwise(F.lit(0)))
              .otherwise(F.col("child")))
    found = per_key.groupBy("rule").agg(F.sum(broken).alias("violations"))
    spark = entries.sparkSession
    every = spark.createDataFrame([(i, r.table, r.name) for i, r in enumerate(rules)], "rule int, table_name string, name string")
    return every.join(found, "rule", "left").select(
        "table_name", F.col("name").alias("rule"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
