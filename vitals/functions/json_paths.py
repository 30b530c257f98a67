"""JSON payload paths of the event table (payload is a JSON text column).

Both payload generations are handled: the PR number may sit at the top level
or under ``pull_request``; the merged flag is absent in the newer format and
then defaults to true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jtext(payload: Column | str, path: str) -> Column:
    """Text at a JSONPath of the payload; missing paths are null."""
    return F.get_json_object(F.col(payload) if isinstance(payload, str) else payload, path)


def action(payload="payload") -> Column:
    return jtext(payload, "$.action")


def pr_number(payload="payload") -> Column:
    """Top-level ``number`` first, then ``pull_request.number``."""
    return F.coalesce(jtext(payload, "$.number"),
                      jtext(payload, "$.pull_request.number")).try_cast("int")


def merged_or_true(payload="payload") -> Column:
    """The merged flag of the pull request; absent or unreadable flags count as merged."""
    return F.coalesce(jtext(payload, "$.pull_request.merged").try_cast("boolean"), F.lit(True))


def release_tag(payload="payload") -> Column:
    """Release tag: ``release.tag_name``, falling back to the top-level ``ref``."""
    return F.coalesce(jtext(payload, "$.release.tag_name"), jtext(payload, "$.ref"))


def release_name(payload="payload") -> Column:
    return jtext(payload, "$.release.name")


def release_body(payload="payload") -> Column:
    return jtext(payload, "$.release.body")


def label_names_json(labels: Column | str) -> Column:
    """GitHub label objects -> JSON array of their names (``["bug","docs"]``)."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.to_json(F.transform(F.coalesce(c, F.array()), lambda x: x["name"]))
