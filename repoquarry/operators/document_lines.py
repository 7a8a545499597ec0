"""Every list a repository's documents show, assembled together from one long table of lines.

Each skill and agent is turned into its lines at once, rows of `(repo_id, list, at, key, position, extra)`.  Three
aggregations follow, whatever the number of lists: lines are made distinct, joined within slices of positions, and the slices
of a repository become one row with a column for each list.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions.text import title_case
from repoquarry.operators.grouping import slice_of
from repoquarry.operators.hierarchy import edge_json, edge_source, edge_triggers

SKILL, LAYOUT, CONVENTION, TEST_PATTERN, LANGUAGE = "skill", "layout", "convention", "test_pattern", "language"
TOOL, TEST_COMMAND, DELEGATION, HANDOFF, ROOT = "tool", "test_command", "delegation", "handoff", "root"
OF_SKILLS = (SKILL, LAYOUT, CONVENTION, TEST_PATTERN, LANGUAGE)
OF_AGENTS = (TOOL, TEST_COMMAND, DELEGATION, HANDOFF, ROOT)
#: lists of which the first lines are shown only
LIMITS = {CONVENTION: rules.CONVENTIONS_MAX, TEST_PATTERN: rules.TESTING_MAX}


def skill_link() -> Column:
    """List item of a skill row."""
    name = F.col("name")
    return F.concat(F.lit("- ["), title_case(name), F.lit("](../skills/"), name, F.lit("/SKILL.md): "), F.col("description"))


def delegation_line() -> Column:
    """List item of a sub-agent row."""
    triggers = F.when(F.size("triggers") > 0, F.array_join("triggers", ", ")).otherwise("any task")
    return F.concat(F.lit("- `@"), F.col("name"), F.lit("` for "), triggers, F.lit(": "), F.col("description"))


def is_test_command(command: Column) -> Column:
    lowered = F.lower(command)
    return reduce(lambda a, b: a | b, [lowered.contains(word) for word in rules.TEST_COMMAND_WORDS])


def is_test_skill() -> Column:
    return (F.col("category") == "quality") | F.col("name").contains("test")


def named_language(pattern: Column) -> Column:
    """Language that a pattern names, or NULL."""
    lowered = F.lower(pattern)

    def hit(words):
        return reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])

    (first, words), *rest = rules.PATTERN_LANGUAGES
    return reduce(lambda acc, item: acc.when(hit(item[1]), item[0]), rest, F.when(hit(words), first))


def _line(name: str, key: Column, pos: Column | None = None, extra: Column | None = None, repeats: bool = False) -> Column:
    """One line; with `repeats` equal keys at different positions stay apart, else the first one counts."""
    position = F.struct(F.col("ord").cast("long").alias("ord"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"))
    at = position if repeats else F.lit(None).cast("struct<ord:bigint,pos:int>")
    words = F.lit(None).cast("string") if extra is None else extra
    return F.struct(
        F.lit(name).alias("list"), at.alias("at"), key.cast("string").alias("key"),
        position.alias("position"), words.alias("extra"),
    )


def _when(condition: Column, line: Column) -> Column:
    """The line where the condition holds, else NULL."""
    return F.when(F.coalesce(condition, F.lit(False)), line)


def _exploded(df: DataFrame, single: list[Column], repeated: list[Column]) -> DataFrame:
    parts = [F.array(*single)] if single else []
    parts += [F.coalesce(part, F.array().cast(f"array<{_LINE}>")) for part in repeated]
    lines = F.filter(F.concat(*parts), lambda line: line.isNotNull())
    return df.select("repo_id", F.explode(lines).alias("line")).select("repo_id", "line.*")


_LINE = "struct<list:string,at:struct<ord:bigint,pos:int>,key:string,position:struct<ord:bigint,pos:int>,extra:string>"


def skill_lines(skills: DataFrame, wanted: Collection[str] = OF_SKILLS) -> DataFrame:
    single = {
        SKILL: _line(SKILL, skill_link(), repeats=True),
        LAYOUT: _when(F.col("source_dir") != "", _line(LAYOUT, F.col("source_dir"), extra=F.col("description"))),
    }

    def pattern_line(name):
        def build(pattern, pos):
            if name == CONVENTION:
                return _line(CONVENTION, pattern, pos)
            if name == TEST_PATTERN:
                return _when(is_test_skill(), _line(TEST_PATTERN, pattern, pos, repeats=True))
            language = named_language(pattern)
            return _when(language.isNotNull(), _line(LANGUAGE, language, pos))

        return F.transform("patterns", build)

    repeated = [pattern_line(name) for name in (CONVENTION, TEST_PATTERN, LANGUAGE) if name in wanted]
    return _exploded(skills, [line for name, line in single.items() if name in wanted], repeated)


def agent_lines(agents: DataFrame, wanted: Collection[str] = OF_AGENTS) -> DataFrame:
    sub = F.col("is_sub_agent")
    edge = F.concat(edge_json(edge_source(), F.col("name"), edge_triggers()), F.lit(","))
    single = {
        DELEGATION: _when(sub, _line(DELEGATION, delegation_line(), repeats=True)),
        HANDOFF: _when(sub, _line(HANDOFF, edge, repeats=True)),
        ROOT: _when(~sub, _line(ROOT, F.lit(""), extra=F.col("description"))),
    }

    def tool_line(name):
        def build(tool, pos):
            if name == TOOL:
                return _line(TOOL, tool["command"], pos, tool["description"])
            return _when(is_test_command(tool["command"]), _line(TEST_COMMAND, tool["command"], pos, repeats=True))

        return F.transform("tools", build)

    repeated = [tool_line(name) for name in (TOOL, TEST_COMMAND) if name in wanted]
    return _exploded(agents, [line for name, line in single.items() if name in wanted], repeated)


def _distinct(lines: DataFrame) -> DataFrame:
    """First line of every key with its text; lines that occur twice at one position are kept twice."""
    grouped = lines.groupBy("repo_id", "list", "at", "key").agg(
        F.min(F.struct("position", "extra")).alias("first"), F.max("position.ord").alias("last"), F.count(F.lit(1)).alias("n")
    )
    name, key, extra = F.col("list"), F.col("key"), F.col("first.extra")
    code = F.concat(F.lit("- `"), key, F.lit("`"))
    text = (
        F.when(name.isin(SKILL, DELEGATION, HANDOFF), key)
        .when(name.isin(CONVENTION, TEST_PATTERN), F.concat(F.lit("- "), key))
        .when(name == TEST_COMMAND, F.concat(F.lit("- Run tests: `"), key, F.lit("`")))
        .when(name == LAYOUT, F.concat(F.lit("- `"), key, F.lit("/` -- "), extra))
        .when(name == TOOL, code)
    )
    copies = F.when(F.col("at").isNotNull(), F.col("n")).otherwise(1).cast("int")
    return grouped.select(
        "repo_id", "list", "last", copies.alias("copies"), F.col("first.position").alias("position"), text.alias("text"),
        F.when(name == TOOL, F.concat(code, F.lit(" -- "), extra)).alias("detail"),
        F.when(name == LANGUAGE, key).when(name == ROOT, extra).alias("word"),
    )


def _sliced(lines: DataFrame) -> DataFrame:
    """(repo_id, list, slice) with the slice's lines in order: joined, or the first ones where a list has a limit."""
    rows = lines.withColumn("slice", slice_of("position.ord"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "text", "detail", "copies")))
    shown = F.flatten(F.transform("lines", lambda line: F.array_repeat(line["text"], line["copies"])))
    limited = F.col("list").isin(*LIMITS)
    limit = F.when(F.col("list") == CONVENTION, LIMITS[CONVENTION]).otherwise(LIMITS[TEST_PATTERN])
    lone = F.col("list").isin(LANGUAGE, ROOT)
    grouped = rows.groupBy("repo_id", "list", "slice").agg(
        F.when(~F.first(lone), ordered).alias("lines"),
        F.min(F.when(lone, F.struct("position", "word"))).alias("best"),
        F.max("last").alias("last"),
        F.sum("copies").alias("n"),
    )
    return grouped.select(
        "repo_id", "list", "slice", "best", "last", "n",
        F.when(~limited, F.array_join(shown, "\n")).alias("text"),
        F.when(F.col("list") == TOOL, F.array_join(F.transform("lines", lambda line: line["detail"]), "\n")).alias("detail"),
        F.when(limited, F.slice(shown, F.lit(1), limit)).alias("head"),
    )


def _whole(name: str, column: str) -> Column:
    """A list without limit: its slices in order; NULL where the repository has no line of it."""
    mine = F.col("list") == name
    parts = F.array_sort(F.collect_list(F.when(mine, F.struct("slice", column))))
    joined = F.array_join(F.transform(parts, lambda part: part[column]), "\n")
    return F.when(F.count_if(mine) > 0, joined)


def _first(name: str) -> Column:
    """The first lines of a list with a limit, over all its slices; each brings no more than the limit."""
    parts = F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("slice", "head"))))
    return F.slice(F.flatten(F.transform(parts, lambda part: part["head"])), 1, LIMITS[name])


def repo_lists(
    skills: DataFrame | None, agents: DataFrame | None, wanted: Collection[str] = (*OF_SKILLS, *OF_AGENTS)
) -> DataFrame:
    """One row per repository that has a skill or an agent line, a column for each list.

    Columns: `skill_links`, `commands`, `delegation`, `handoffs`, `convention_lines`, `layout_lines`, `testing_lines`,
    `tool_lines` (NULL where there are none), `pattern_language`, `root` (struct of position and description of the first root
    agent), `last_root` (`ord` of the last one), `has_subs`.  Lists not `wanted` are NULL, and a table none of them is made of may be None.  `ord` orders skills and agents
    of a repository; a repository may hold any share of all rows, since its lines meet only as slices.
    """
    parts = []
    if set(wanted) & set(OF_SKILLS):
        parts.append(skill_lines(skills, wanted))
    if set(wanted) & set(OF_AGENTS):
        parts.append(agent_lines(agents, wanted))
    slices = _sliced(_distinct(reduce(lambda a, b: a.unionByName(b), parts)))
    name = F.col("list")
    one = slices.groupBy("repo_id").agg(
        _whole(SKILL, "text").alias("skill_links"),
        _whole(TOOL, "text").alias("commands"),
        _whole(TOOL, "detail").alias("tool_lines"),
        _whole(DELEGATION, "text").alias("delegation"),
        _whole(HANDOFF, "text").alias("edges"),
        _whole(LAYOUT, "text").alias("layout_lines"),
        _whole(TEST_COMMAND, "text").alias("test_commands"),
        F.coalesce(F.sum(F.when(name == TEST_COMMAND, F.col("n"))), F.lit(0)).cast("int").alias("n_commands"),
        _first(CONVENTION).alias("conventions"),
        _first(TEST_PATTERN).alias("test_patterns"),
        F.min(F.when(name == LANGUAGE, F.col("best"))).alias("language_of"),
        F.min(F.when(name == ROOT, F.col("best"))).alias("root_of"),
        F.max(F.when(name == ROOT, F.col("last"))).alias("last_root"),
        (F.count_if(name == DELEGATION) > 0).alias("has_subs"),
    )
    room = F.greatest(F.lit(LIMITS[TEST_PATTERN]) - F.col("n_commands"), F.lit(0))
    patterns = F.slice("test_patterns", F.lit(1), room)
    patterns = F.when(F.size(patterns) > 0, F.array_join(patterns, "\n"))
    testing = F.when(F.col("test_commands").isNotNull() | patterns.isNotNull(), F.concat_ws("\n", "test_commands", patterns))
    return one.select(
        "repo_id", "skill_links", "commands", "tool_lines", "delegation", "layout_lines", "last_root", "has_subs",
        F.expr("left(edges, char_length(edges) - 1)").alias("handoffs"),
        F.when(F.size("conventions") > 0, F.array_join("conventions", "\n")).alias("convention_lines"),
        testing.alias("testing_lines"),
        F.col("language_of.word").alias("pattern_language"),
        F.when(F.col("root_of").isNotNull(), F.struct(F.col("root_of.position").alias("position"), F.col("root_of.word").alias("description"))).alias("root"),
    )
