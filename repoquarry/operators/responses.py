"""Model responses: JSON extraction, all-or-nothing validation, agent flattening.

One response is one row, and everything up to the final `posexplode` happens
inside that row with VARIANT and array functions: no shuffle, and nesting of any
depth without a driver-side loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions import json_values as js
from repoquarry.functions.staging import built_once, evaluate_once
from repoquarry.functions.text import utf16_length
from repoquarry.operators.defaults import HOOK_TYPE, TOOL_TYPE

_NODE_TYPE = "struct<path:array<int>,nested:boolean,parent:variant,value:variant>"


def extract_json(response: Column) -> Column:
    """Text from the first `{` to the last `}`; NULL when there is none."""
    return F.regexp_substr(response, F.lit(r"(?s)\{.*\}"))


# ------------------------------------------------------------------ agent tree


def _children(owner: Column, keep: Callable[[Column], Column]) -> Column:
    """(index, value) of the entries of `subAgents` that satisfy `keep`."""
    listed = F.transform(
        js.elements_of(owner, "subAgents"), lambda value, i: F.struct(i.alias("i"), value.alias("value"))
    )
    none = F.array().cast("array<struct<i:int,value:variant>>")
    return F.coalesce(F.filter(listed, lambda child: keep(child["value"])), none)


def _list_depth(value: Column) -> Column:
    """How many lists lie inside each other in a VARIANT value, at least 1: no tree of agents has more levels."""
    # escapes go first, so that a quote always ends a text; then all but the brackets of lists
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(value), r"\\.", ""), r'"[^"]*"|[^\[\]"]+', "")
    return F.aggregate(
        F.split(F.coalesce(brackets, F.lit("")), ""),
        F.struct(F.lit(0).alias("now"), F.lit(1).alias("most")),
        lambda state, bracket: F.struct(
            (state["now"] + F.when(bracket == "[", 1).when(bracket == "]", -1).otherwise(0)).alias("now"),
            F.greatest(state["most"], state["now"] + F.when(bracket == "[", 1).otherwise(0)).alias("most"),
        ),
        lambda state: state["most"],
    )


def _level_limit(agents: Column) -> Column:
    """At least as many as a tree of agents has levels, and few: every level but the first needs a list of its own.

    Trees with many such lists are looked at more closely, since they may be in one level.
    """
    lists = F.regexp_count(F.to_json(agents), F.lit('"subAgents"'))
    # the one-element array binds the number to a variable
    limit = F.transform(F.array(F.coalesce(lists, F.lit(0))), lambda n: F.when(n < 8, n + 1).otherwise(_list_depth(agents)))
    return limit[0]


def _agent_nodes(
    agents: Column, keep_top: Callable[[Column], Column], keep_nested: Callable[[Column], Column]
) -> Column:
    """All agents of a response in pre-order, as an array of `_NODE_TYPE`.

    Works level by level inside the row, in no more rounds than lists lie inside
    each other in this response.  Levels are kept side by side and put together
    once, so the work grows with the number of agents and of levels, not with their product.
    """
    none = F.array().cast(f"array<{_NODE_TYPE}>")

    def node(path, nested, parent, value):
        return F.struct(
            path.alias("path"), F.lit(nested).alias("nested"), parent.alias("parent"), value.alias("value")
        )

    top = F.transform(
        js.elements(agents),
        lambda value, i: node(F.array(i), False, F.lit(None).cast("variant"), value),
    )
    top = F.coalesce(F.filter(top, lambda n: keep_top(n["value"])), none).cast(f"array<{_NODE_TYPE}>")

    def next_level(level):
        return F.flatten(
            F.transform(
                level,
                lambda owner: F.transform(
                    _children(owner["value"], keep_nested),
                    lambda child: node(
                        F.concat(owner["path"], F.array(child["i"])),
                        True,
                        js.field(owner["value"], "name"),
                        child["value"],
                    ),
                ),
            )
        ).cast(f"array<{_NODE_TYPE}>")

    walked = F.aggregate(
        F.sequence(F.lit(1), _level_limit(agents)),
        F.struct(top.alias("level"), F.array().cast(f"array<array<{_NODE_TYPE}>>").alias("seen")),
        lambda state, _: F.struct(
            next_level(state["level"]).alias("level"),
            F.concat(state["seen"], F.array(state["level"])).alias("seen"),
        ),
        lambda state: F.flatten(state["seen"]),
    )

    def pre_order(left, right):
        return F.when(left["path"] < right["path"], -1).when(left["path"] > right["path"], 1).otherwise(0)

    return F.array_sort(walked, pre_order)


def normalize_tools(tools: Column) -> Column:
    """Array of (name, command, description) from strings, objects or anything else."""

    def one(tool):
        what, text = js.kind(tool), js.text_of(tool)
        name = js.field(tool, "name")
        from_object = F.struct(
            js.string_or(name, F.lit("unknown")).alias("name"),
            js.string_or(js.field(tool, "command"), js.string_or(name, F.lit(""))).alias("command"),
            js.string_or(js.field(tool, "description"), js.string_or(name, F.lit(""))).alias("description"),
        )
        from_text = F.struct(
            F.substring_index(text, " ", 1).alias("name"), text.alias("command"), text.alias("description")
        )
        other = js.script_string(tool)
        from_other = F.struct(F.lit("unknown").alias("name"), other.alias("command"), other.alias("description"))
        return (
            F.when(what == "STRING", from_text).when(what.isin("OBJECT", "ARRAY"), from_object).otherwise(from_other)
        )

    none = F.array().cast(f"array<{TOOL_TYPE}>")
    return F.coalesce(F.transform(js.elements(tools), one).cast(f"array<{TOOL_TYPE}>"), none)


@built_once
def _agent_columns(column: str) -> list[Column]:
    # separate columns, not one struct: each is evaluated once
    node = F.col(column)
    value, parent = node["value"], node["parent"]
    names = F.transform(
        _children(value, lambda c: (js.kind(c) == "STRING") | _is_named_object(c)),
        lambda c: F.when(js.kind(c["value"]) == "STRING", js.text_of(c["value"])).otherwise(
            js.script_string(js.field(c["value"], "name"))
        ),
    )
    null = F.lit(None).cast("string")
    declared_parent = F.when(node["nested"], parent).otherwise(js.field(value, "parentAgent"))
    no_tools = F.array().cast(f"array<{TOOL_TYPE}>")
    return [
        js.string_or(js.field(value, "name"), F.lit("unknown")).alias("name"),
        js.string_or(js.field(value, "description"), F.lit("")).alias("description"),
        js.strings_of(js.field(value, "skills")).alias("skills"),
        F.coalesce(normalize_tools(js.field(value, "tools")), no_tools).alias("tools"),
        (node["nested"] | js.truthy(js.field(value, "isSubAgent"))).alias("is_sub_agent"),
        js.string_or(declared_parent, null).alias("parent_agent"),
        # the one-element array binds the names to a variable, so they are listed once
        F.transform(F.array(names), lambda n: F.when(F.size(n) > 0, n))[0].alias("sub_agents"),
        js.strings_of(js.field(value, "triggers")).alias("triggers"),
        js.string_or(js.field(value, "sourceDir"), null).alias("source_dir"),
    ]


def _is_named_object(value: Column) -> Column:
    return (js.kind(value) == "OBJECT") & js.field(value, "name").isNotNull()


@built_once
def _raw_agent_nodes(agents: str) -> Column:
    return _agent_nodes(F.col(agents), lambda v: js.kind(v).isin("OBJECT", "ARRAY"), _is_named_object)


def flatten_agents(df: DataFrame, agents: str = "agents", keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Nested agents of VARIANT column `agents` as rows `(keys, ord, path, name, ...)` in pre-order.

    Nested objects become sub-agents of the agent that holds them; strings stay
    name references; entries that are neither, and nested objects without a
    name key, are dropped.
    """
    rows = df.select(*keys, F.posexplode(_raw_agent_nodes(agents)).alias("ord", "__node"))
    return rows.select(
        *keys, F.col("ord").cast("long").alias("ord"), F.col("__node.path").alias("path"), *_agent_columns("__node")
    )


def extract_tools(agents: DataFrame) -> DataFrame:
    """(repo_id, ord, pos, name, command, description): every tool of every agent, repeats kept."""
    exploded = agents.select("repo_id", "ord", F.posexplode("tools").alias("pos", "tool"))
    return exploded.select("repo_id", "ord", F.col("pos").cast("long").alias("pos"), "tool.*")


# ------------------------------------------------------------------ validation


def _issue(bad: Column, *where) -> Column:
    return F.when(bad, F.concat(*[F.lit(w) if isinstance(w, str) else w for w in where]))


def _not_text(value: Column, required: bool, shortest: int = 0, longest: int | None = None) -> Column:
    text = js.text_of(value)
    bad_length = F.lit(False)
    if shortest:
        bad_length = bad_length | (utf16_length(text) < shortest)
    if longest is not None:
        bad_length = bad_length | (utf16_length(text) > longest)
    return F.when(value.isNull(), F.lit(required)).when(~js.is_text(value), True).otherwise(bad_length)


def _not_texts(value: Column) -> Column:
    """Present but not an array of strings."""
    all_text = F.forall(js.elements(value), js.is_text)
    return value.isNotNull() & ~F.coalesce(all_text, F.lit(False))


def _not_array(value: Column) -> Column:
    return value.isNotNull() & ~js.is_array(value)


_SKILL = ("name", "description", "sourceDir", "patterns", "triggers", "category", "examples")
_TOOL = ("name", "command", "description")
_AGENT = ("name", "description", "skills", "tools", "isSubAgent", "parentAgent", "subAgents", "triggers", "sourceDir")
_HOOK = ("name", "event", "description", "commands", "condition")


# what is checked comes as a struct of its members, NULL where it is no object


def _skill_issues(skill: Column, where: Column) -> list[Column]:
    category = skill["category"]
    known = F.coalesce(js.text_of(category).isin(*rules.SKILL_CATEGORIES), F.lit(False))
    return [
        _issue(skill.isNull(), where),
        _issue(_not_text(skill["name"], True, 1, rules.SKILL_NAME_MAX), where, ".name"),
        _issue(_not_text(skill["description"], True, 1), where, ".description"),
        _issue(_not_text(skill["sourceDir"], False), where, ".sourceDir"),
        _issue(_not_texts(skill["patterns"]), where, ".patterns"),
        _issue(_not_texts(skill["triggers"]), where, ".triggers"),
        _issue(category.isNotNull() & (~js.is_text(category) | ~known), where, ".category"),
        _issue(_not_texts(skill["examples"]), where, ".examples"),
    ]


def _tool_is_bad(tool: Column) -> Column:
    # the one-element array binds the members to a variable, so they are taken out once
    bad_object = F.exists(
        F.array(js.members(tool, _TOOL)),
        lambda t: t.isNull() | _not_text(t["name"], True, 1) | _not_text(t["command"], False) | _not_text(t["description"], False),
    )
    return F.when(js.is_text(tool), js.text_of(tool) == "").otherwise(bad_object)


def _agent_issues(agent: Column, where: Column) -> list[Column]:
    sub = agent["isSubAgent"]
    tools = agent["tools"]
    bad_tools = F.coalesce(F.exists(js.elements(tools), _tool_is_bad), F.lit(False))
    return [
        _issue(agent.isNull(), where),
        _issue(_not_text(agent["name"], True, 1), where, ".name"),
        _issue(_not_text(agent["description"], False), where, ".description"),
        _issue(_not_texts(agent["skills"]), where, ".skills"),
        _issue(_not_array(tools) | bad_tools, where, ".tools"),
        _issue(sub.isNotNull() & (js.kind(sub) != "BOOLEAN"), where, ".isSubAgent"),
        _issue(_not_text(agent["parentAgent"], False), where, ".parentAgent"),
        _issue(_not_array(agent["subAgents"]), where, ".subAgents"),
        _issue(_not_texts(agent["triggers"]), where, ".triggers"),
        _issue(_not_text(agent["sourceDir"], False), where, ".sourceDir"),
    ]


def _hook_issues(hook: Column, where: Column) -> list[Column]:
    return [
        _issue(hook.isNull(), where),
        _issue(_not_text(hook["name"], True, 1), where, ".name"),
        _issue(_not_text(hook["event"], True, 1), where, ".event"),
        _issue(_not_text(hook["description"], False), where, ".description"),
        _issue(_not_texts(hook["commands"]), where, ".commands"),
        _issue(_not_text(hook["condition"], False), where, ".condition"),
    ]


def _present(issues: list[Column]) -> Column:
    return F.filter(F.array(*issues), lambda issue: issue.isNotNull())


def _each(root: Column, label: str, names: tuple[str, ...], check: Callable[[Column, Column], list[Column]]) -> Column:
    per_item = F.transform(
        js.members_of_each(root, label, names), lambda v, i: _present(check(v, F.concat(F.lit(label + "."), i.cast("string"))))
    )
    return F.coalesce(F.flatten(per_item), F.array().cast("array<string>"))


def _no_list(root: Column, name: str) -> Column:
    """Present but not an array."""
    return ~js.is_array(root, f'$["{name}"]') & js.field(root, name).isNotNull()


@built_once
def violations(body: str) -> Column:
    """Paths of everything in the response in VARIANT column `body` that breaks the schema; empty when it is valid."""
    root = F.col(body)
    nodes = _agent_nodes(js.field(root, "agents"), lambda v: F.lit(True), lambda v: js.is_object(v) | ~js.is_text(v))
    agents = F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), js.members(n["value"], _AGENT).alias("agent")))
    agent_issues = F.flatten(
        F.transform(
            agents,
            lambda n: _present(
                _agent_issues(
                    n["agent"],
                    F.concat(F.lit("agents."), F.array_join(n["path"].cast("array<string>"), ".subAgents.")),
                )
            ),
        )
    )
    top = _present(
        [
            _issue(~js.is_object(root), "(root)"),
            _issue(_no_list(root, "skills"), "skills"),
            _issue(_no_list(root, "agents"), "agents"),
            _issue(_no_list(root, "hooks"), "hooks"),
            _issue(_not_text(js.field(root, "summary"), False), "summary"),
        ]
    )
    return F.concat(
        top,
        _each(root, "skills", _SKILL, _skill_issues),
        F.coalesce(agent_issues, F.array().cast("array<string>")),
        _each(root, "hooks", _HOOK, _hook_issues),
    )


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Add `body` (VARIANT), `violations` and `valid` to a table of model responses.

    `valid` needs a JSON object in the text and no violation at all.
    """
    found = js.with_json(df.withColumn("__json", extract_json(F.col(response))), "__json", "body").drop("__json")
    not_json = F.array(F.lit("(json)"))
    checked = evaluate_once(
        found, "violations", F.when(F.col("body").isNull(), not_json).otherwise(violations("body"))
    )
    return checked.withColumn("valid", F.size("violations") == 0)


def response_findings(parsed: DataFrame) -> DataFrame:
    """(repo_id, path) per violation."""
    return parsed.select("repo_id", F.explode("violations").alias("path"))


# ------------------------------------------------------------------ typed tables


def _text_or(value: Column, default: str | None) -> Column:
    return F.coalesce(js.text_of(value), F.lit(default).cast("string"))


def _texts(value: Column) -> Column:
    return F.coalesce(F.transform(js.elements(value), js.text_of), F.array().cast("array<string>"))


def response_skills(parsed: DataFrame) -> DataFrame:
    """Skills of the valid responses, defaults filled in: (repo_id, ord, name, ...)."""

    rows = parsed.where("valid").select(
        "repo_id", F.posexplode(js.elements(js.field(F.col("body"), "skills"))).alias("ord", "__skill")
    )

    def part(name):
        return js.field(F.col("__skill"), name)

    return rows.select(
        "repo_id",
        F.col("ord").cast("long").alias("ord"),
        js.text_of(part("name")).alias("name"),
        js.text_of(part("description")).alias("description"),
        _text_or(part("sourceDir"), "").alias("source_dir"),
        _texts(part("patterns")).alias("patterns"),
        _texts(part("triggers")).alias("triggers"),
        _text_or(part("category"), "patterns").alias("category"),
        _texts(part("examples")).alias("examples"),
    )


def hooks_of(body: Column) -> Column:
    """Hooks of a valid response as an array; empty when absent."""

    def one(hook):
        return F.struct(
            js.text_of(js.field(hook, "name")).alias("name"),
            js.text_of(js.field(hook, "event")).alias("event"),
            _text_or(js.field(hook, "description"), "").alias("description"),
            _texts(js.field(hook, "commands")).alias("commands"),
            js.text_of(js.field(hook, "condition")).alias("condition"),
        )

    none = F.array().cast(f"array<{HOOK_TYPE}>")
    return F.coalesce(F.transform(js.elements(js.field(body, "hooks")), one).cast(f"array<{HOOK_TYPE}>"), none)


def response_agents(parsed: DataFrame) -> DataFrame:
    """Agents of the valid responses, flattened."""
    valid = parsed.where("valid").select("repo_id", js.field(F.col("body"), "agents").alias("agents"))
    return flatten_agents(valid).drop("path")


def response_summary(body: Column) -> Column:
    return _text_or(js.field(body, "summary"), "")
