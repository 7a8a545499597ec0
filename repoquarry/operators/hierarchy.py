"""Delegation edges of an agent hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.text import json_string, non_empty
from repoquarry.operators.grouping import ordered_concat

DEFAULT_PARENT = "repo-root"


def edge_source() -> Column:
    """Where the edge to a sub-agent row starts."""
    return F.coalesce(non_empty(F.col("parent_agent")), F.lit(DEFAULT_PARENT))


def edge_triggers() -> Column:
    """Triggers of the edge to a sub-agent row; its name where it has none."""
    return F.when(F.size("triggers") > 0, F.col("triggers")).otherwise(F.array("name"))


def handoff_edges(agents: DataFrame) -> DataFrame:
    """(repo_id, ord, src, dst, triggers) for every sub-agent."""
    return agents.where("is_sub_agent").select(
        "repo_id", "ord", edge_source().alias("src"), F.col("name").alias("dst"), edge_triggers().alias("triggers")
    )


def edge_json(src: Column, dst: Column, triggers: Column) -> Column:
    """One edge as an indented JSON object."""
    items = F.array_join(F.transform(triggers, lambda t: F.concat(F.lit("        "), json_string(t))), ",\n")
    return F.concat(
        F.lit('    {\n      "from": '), json_string(src),
        F.lit(',\n      "to": '), json_string(dst),
        F.lit(',\n      "triggers": [\n'), items, F.lit("\n      ]\n    }"),
    )


def handoff_documents(edges: DataFrame) -> DataFrame:
    """(repo_id, content): the edges of each repository as one indented JSON document."""
    text = edge_json(F.col("src"), F.col("dst"), F.col("triggers"))
    body = ordered_concat(edges.select("repo_id", "ord", text.alias("text")), ["repo_id"], "ord", "text", ",\n")
    return body.select("repo_id", handoff_text(F.col("text")).alias("content"))


def handoff_text(edges: Column) -> Column:
    """The document around a repository's edges."""
    return F.concat(F.lit('{\n  "handoffs": [\n'), edges, F.lit("\n  ]\n}\n"))
