"""Corpus-shaped views over the driver tables, as DataFrames.

The tables hold no source trees, so every row of a table becomes one file, one
skill, one agent, one response or one session event by a fixed rule of its
columns.  Nothing is filtered or cut: the views grow with the tables.
`sql_views.py` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.operators.grouping import even_join
from repoquarry.sources.files import inventory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy row work when the input has fewer splits than there are cores.

    A table of many files already has enough splits and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _div(col: str, n: int) -> Column:
    return F.floor(F.col(col) / F.lit(n)).cast("long")


def _plain_file() -> Column:
    directory = pick(["src", "lib", "api", "tests", "docs", "node_modules"], _div("doc_id", 20) % 6)
    extension = pick([".ts", ".tsx", ".js", ".py", ".go", ".md", ".test.ts"], F.col("doc_id") % 7)
    path = F.concat(directory, F.lit("/f"), F.col("doc_id").cast("string"), extension)
    return F.struct(F.col("source").alias("repo_id"), path.alias("path"), F.lit(-1).cast("long").alias("slot"))


def _manifest_file() -> Column:
    group, slot = _div("doc_id", 10), F.col("doc_id") % 10
    number = F.col("doc_id").cast("string")
    by_slot = [
        pick(["LICENSE", "LICENSE.md", "COPYING", "license.txt", "docs/LICENSE"], group % 5),
        pick(["app/package.json", "package.json", "package.json"], group % 3),
        pick(["pyproject.toml", "pyproject.toml", "setup.cfg"], group % 3),
        pick(["requirements.txt", "requirements.txt", "src/app.py", "main.py"], group % 4),
        pick(["go.mod", "cmd/main.go"], group % 2),
        pick(["tsconfig.json", "next.config.js", "angular.json", "vue.config.js", "nuxt.config.ts", ".eslintrc.js"], group % 6),
        F.concat(pick(["src", "web", "2024", "client"], group % 4), F.lit("/index"), pick([".js", ".ts", ".py", ".go", ".php"], group % 5)),
        pick(["packages/a/node_modules/x.js", "yarn.lock", "latest_news.js", "Dockerfile"], group % 4),
        F.concat(pick(["clients", "client", "web", "lib"], group % 4), F.lit("/u"), number, pick([".js", ".py", ".rs"], group % 3)),
        pick(["README.md", "docs/README.md", "docker-compose.dev.yml", "pkg/a/b.go"], group % 4),
    ]
    path = F.get(F.array(*by_slot), slot.cast("int"))
    return F.struct(F.concat(F.lit("r"), group.cast("string")).alias("repo_id"), path.alias("path"), slot.alias("slot"))


def _manifest_content() -> Column:
    group = _div("doc_id", 10)
    declared = pick(['"MIT"', '"SSPL-1.0"', '{"type":"MIT"}', '""', '"apache-2.0"'], group % 5)
    names = ["next", "react", "vue", "@angular/core", "express", "fastify", "nestjs", "left-pad", "lodash"]
    package = F.concat(
        F.lit('{"name":"p","license":'), declared,
        F.lit(',"dependencies":{"'), pick(names, group % 9), F.lit('":"^1.0"},"devDependencies":{"'),
        pick(names, (group * 7 + 5) % 9), F.lit('":"'), pick(["^2.0", ""], group % 2), F.lit('"}'),
        pick(["}", "}", "}", "", "} x"], _div("doc_id", 30) % 5),
    )
    headed = {
        2: pick(['license = "Apache-2.0"', 'license = {text = "MIT"}', 'LICENSE="  Weird  "', "name = 'x'"], group % 4),
        3: pick(["django==4", "flask", "fastapi", "numpy"], _div("doc_id", 40) % 4),
        4: pick(["gin-gonic/gin", "labstack/echo", "gofiber/fiber", "plain"], _div("doc_id", 20) % 4),
    }
    content = F.when(F.col("slot") == 1, package)
    for slot, line in headed.items():
        content = content.when(F.col("slot") == slot, F.concat(line, F.lit("\n"), F.col("text")))
    return content.otherwise(F.col("text"))


def _files(spark: SparkSession, sf_dir: str, *files: Column) -> DataFrame:
    # a generator, so that `path` is a column to everything downstream; `text` stays prunable
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "n_chars", "text", F.inline(F.array(*files)))
    return rows.select(
        "repo_id", F.col("doc_id").alias("ord"), "path", F.col("n_chars").alias("size"), _manifest_content().alias("content")
    )


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, 20 repositories by source."""
    return _files(spark, sf_dir, _plain_file())


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files per repository: licence, manifests, configuration and a few sources."""
    return _files(spark, sf_dir, _manifest_file())


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both file sets from one pass over the documents."""
    return _files(spark, sf_dir, _plain_file(), _manifest_file())


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(tree(spark, sf_dir))


def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(tree(spark, sf_dir), "remote")


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url): six spellings of a repository address."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    owner = F.replace(host, F.lit("."), F.lit("-"))
    repo = F.concat(F.lit("r"), F.col("page_id").cast("string"), F.lit(".x"))
    way = F.col("page_id") % 6
    url = (
        F.when(way == 0, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo))
        .when(way == 1, F.concat(F.lit("git@github.com:"), owner, F.lit("/"), repo, F.lit(".git")))
        .when(way == 2, F.concat(F.lit("github.com/"), owner, F.lit("/"), repo, F.lit(".git")))
        .when(way == 3, F.col("url"))
        .when(way == 4, F.concat(owner, F.lit("/"), repo))
        .otherwise(F.concat(F.lit("https://github.com/"), owner, F.lit("/")))
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def _words() -> Column:
    return F.split("p_name", " ")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One skill per part; repositories are the brands."""
    size, first, second = F.col("p_size"), F.get(_words(), F.lit(0)), F.get(_words(), F.lit(1))
    none = F.array().cast("array<string>")
    note = F.when(size % 5 == 0, F.concat(F.lit(": #"), size.cast("string"))).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return spread(rows).select(
        F.col("p_brand").alias("repo_id"),
        F.col("p_partkey").alias("ord"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("name"),
        F.concat(F.col("p_name"), F.lit(" for "), F.lower("p_type"), note).alias("description"),
        F.when(size % 4 == 0, "").otherwise(first).alias("source_dir"),
        F.when(size % 3 == 0, none)
        .otherwise(F.array(F.concat(F.lower("p_type"), F.lit(" "), size.cast("string")), F.concat(second, pick([".py", ".ts", "", " in Rust"], size % 4))))
        .alias("patterns"),
        F.when(size % 7 == 0, none).otherwise(_words()).alias("triggers"),
        pick(["architecture", "reliability", "quality", "security", "patterns", "misc"], size % 6).alias("category"),
        F.when(size % 2 == 0, none).otherwise(F.array(F.concat(F.lit("use "), F.col("p_name")))).alias("examples"),
    )


_ADJECTIVES = ["red", "blue", "hot", "cold", "old", "new", "small", "large"]
_THINGS = ["bolt", "plate", "ring", "gear", "widget", "rod", "anvil", "gizmo"]
COMMANDS = ["npm test", "make build", "Pytest -q", "go vet ./...", "npm run lint"]


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent per supplier, spread over the brands; every fifth brand has no sub-agents."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    brand = key % 25 + 1

    def skill(a, b):
        return F.concat(pick(_ADJECTIVES, (nation + a) % 8), F.lit("-"), pick(_THINGS, (key + b) % 8))

    def tool(index):
        command = pick(COMMANDS, index % 5)
        return F.struct(
            F.substring_index(command, " ", 1).alias("name"), command.alias("command"),
            F.concat(F.lit("step "), key.cast("string")).alias("description"),
        )

    none = F.array().cast("array<string>")
    tools = F.when(nation % 3 == 0, F.array().cast("array<struct<name:string,command:string,description:string>>"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Brand#"), brand.cast("string")).alias("repo_id"),
        key.alias("ord"),
        F.concat(F.lit("agent-"), key.cast("string")).alias("name"),
        F.when(nation % 7 == 0, "").otherwise(F.concat(F.lit("Handles nation "), nation.cast("string"))).alias("description"),
        F.array(skill(0, 0), skill(3, 1), skill(0, 0)).alias("skills"),
        tools.otherwise(F.array(tool(nation), tool(nation + key))).alias("tools"),
        ((brand % 5 != 0) & (nation % 4 != 0)).alias("is_sub_agent"),
        F.when(nation % 4 == 1, "").when(nation % 4 == 2, F.lit(None)).otherwise("root").alias("parent_agent"),
        F.when(nation % 5 == 0, F.array(F.concat(F.lit("agent-"), (key + 25).cast("string")))).alias("sub_agents"),
        F.when(nation % 2 == 0, none).otherwise(F.array(F.concat(F.lit("n"), nation.cast("string")), F.lit("all"))).alias("triggers"),
        F.when(nation % 3 == 1, F.concat(F.lit("src/n"), nation.cast("string"))).alias("source_dir"),
    )


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hook per customer."""
    key = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select(
        F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("repo_id"),
        key.alias("ord"),
        F.concat(F.lit("hook-"), key.cast("string")).alias("name"),
        pick(list(rules.HOOK_EVENTS), key % 5).alias("event"),
        F.concat(F.lit("For "), F.lower("c_mktsegment")).alias("description"),
        F.array(F.concat(F.lit("run "), key.cast("string")), F.lit("check")).alias("commands"),
        F.when(key % 3 == 0, F.concat(F.lit("file:"), F.lower("c_mktsegment"))).alias("condition"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, repo_name, summary, language, framework): one repository per brand."""
    number = F.regexp_extract("repo_id", "([0-9]+)", 1).cast("int")
    distinct = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id")).distinct()
    return distinct.select(
        "repo_id",
        F.concat(F.lit("My "), F.col("repo_id")).alias("repo_name"),
        F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("Repository "), F.col("repo_id"))).alias("summary"),
        F.when(number % 2 == 0, "Go").alias("language"),
        F.when(number % 4 == 0, "Gin").alias("framework"),
    )


def model_responses(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None) -> DataFrame:
    """One response per part: prose around JSON, some of it invalid; with the columns of `beside` for its `repo_id`, if given."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    category = pick(["architecture", "quality", "misc", "patterns"], size % 4)
    # the repeated summary key is legal: the last one counts
    body = F.concat(
        F.lit('{"summary":"first","skills":[{"name":"'), F.col("p_name"), F.lit('","description":"'), F.col("p_type"),
        F.lit('","category":"'), category, F.lit('","patterns":["a","'), key, F.lit('"]}'),
        F.when(size % 5 == 0, F.concat(F.lit(',{"name":"extra","description":"'), key, F.lit('"}'))).otherwise(""),
        F.lit('],"agents":[{"name":"lead'), key, F.lit('","tools":["npm test",{"name":"build"}],"subAgents":["ref",{"name":"'),
        F.col("p_brand"), F.lit('","skills":["s"],"subAgents":[{"name":"leaf","tools":["x y"]}]}]},{"name":"other","isSubAgent":true,"parentAgent":"lead'),
        key, F.lit('"}]'),
        F.when(size % 3 == 0, F.concat(F.lit(',"hooks":[{"name":"h'), key, F.lit('","event":"pre-push","commands":["go"]}]'))).otherwise(""),
        F.when(size % 2 == 0, F.concat(F.lit(',"summary":"Part '), key, F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    response = (
        F.when(size % 11 == 0, F.lit('{"a":1} and {"b":2}'))
        .when(size % 13 == 0, F.lit("no json at all"))
        .otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    )
    repo = F.concat(F.lit("p"), key).alias("repo_id")
    rows = table(spark, sf_dir, "part").select(repo, "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    if beside is None:
        return spread(rows).select("repo_id", response.alias("response"))
    # the short columns are shuffled, not the texts made of them
    more = [name for name in beside.columns if name != "repo_id"]
    return even_join(rows, beside, ["repo_id"]).select("repo_id", response.alias("response"), *more)


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile row per part, matching `model_responses`."""
    size = F.col("p_size")
    dirs = F.when(size % 3 == 0, F.array(F.lit("src"), F.lit("lib"))).when(size % 3 == 1, F.array(F.lit("clients")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("repo_id"),
        pick(["TypeScript", "Python", "Go", "Rust"], size % 4).alias("language"),
        F.when(size % 2 == 0, "Flask").alias("framework"),
        (size % 2 == 0).alias("has_tests"),
        (size % 5 == 0).alias("has_root_package"),
        dirs.otherwise(F.array().cast("array<string>")).alias("source_dirs"),
        F.when(size % 2 == 0, F.array(F.struct(F.lit("client").alias("name"), F.lit("client").alias("path"), size.cast("long").alias("file_count"))))
        .otherwise(F.array().cast("array<struct<name:string,path:string,file_count:bigint>>")).alias("domains"),
    )


def asset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset files with sound and broken front matter, one per document; some repositories lack a kind."""
    group, key = _div("doc_id", 20), F.col("doc_id").cast("string")
    repo = F.concat(F.lit("q"), _div("doc_id", 12).cast("string"))
    path = F.concat(
        pick([".github/skills/s", ".github/agents/a", ".github/hooks/h", ".github/skills/t"], F.col("doc_id") % 4), key,
        pick(["/SKILL.md", ".agent.md", ".yaml", "/notes.md"], F.col("doc_id") % 4),
    )
    variants = [
        F.concat(F.lit("---\nname: n"), key, F.lit("\ndescription: d\ntools: ['a', 'b']\n---\n"), F.col("text")),
        F.concat(F.lit("---\nname: n"), key, F.lit("\n---\n"), F.col("text")),
        F.concat(F.lit("---\ndescription: 'd'\ntools: codebase\n---\n"), F.col("text")),
        F.concat(F.lit("no front matter\n"), F.replace(F.col("text"), F.lit("---"), F.lit(""))),
        F.concat(F.lit("---\nname: n\n"), F.replace(F.col("text"), F.lit("---"), F.lit(""))),
    ]
    hook_variants = [
        F.concat(F.lit("name: h"), key, F.lit('\nevent: pre-push\ncommands:\n  - "x"\n')),
        F.concat(F.lit("name: h"), key, F.lit("\nevent: on-save\ncommands: []\n")),
        F.lit("event: 'pre-commit'\ncommands: [a, b]\n"),
    ]
    choice = group % 5
    text = F.when(choice == 0, variants[0])
    for index in range(1, 5):
        text = text.when(choice == index, variants[index])
    hook = F.when(group % 3 == 0, hook_variants[0]).when(group % 3 == 1, hook_variants[1]).otherwise(hook_variants[2])
    content = F.when(F.col("doc_id") % 4 == 2, hook).otherwise(text)
    return table(spark, sf_dir, "documents").select(repo.alias("repo_id"), path.alias("path"), content.alias("content"))


def catalogue_lines(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """(repo_id, ord, line): one registry line per event, some of them bad.

    Three lines per registry, or with `by_type` only five very large registries.
    """
    way = F.col("event_id") % 9
    line = (
        F.when(way == 4, "")
        .when(way == 5, F.concat(F.col("props"), F.lit(" x")))
        .when(way == 6, F.concat(F.lit('{"type":"","name":"'), F.col("event_type"), F.lit('"}')))
        .when(way == 7, F.col("props"))
        .otherwise(
            F.concat(
                F.lit('{"type":"skill","name":"'), F.col("event_type"), F.lit('","description":"'),
                F.col("user_id").cast("string"), F.lit('","triggers":["t"],"props":'), F.col("props"), F.lit("}"),
            )
        )
    )
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"))
    return events.select(
        (F.col("event_type") if by_type else F.concat(F.lit("u"), _div("event_id", 3).cast("string"))).alias("repo_id"),
        F.col("event_id").alias("ord"),
        line.alias("line"),
    )


def session_events(conversations: DataFrame) -> DataFrame:
    """Conversation turns as session events, 30 seconds apart; works on batch and streaming input."""
    way = (F.col("conv_id") + F.col("turn") * 3) % 7
    type_ = (
        F.when((F.col("turn") < 2) | (F.col("role") == "system"), rules.EVENT_DELTA)
        .when(way == 3, rules.EVENT_ERROR)
        .when(way == 5, rules.EVENT_IDLE)
        .when(way == 6, rules.EVENT_MESSAGE)
        .otherwise(rules.EVENT_DELTA)
    )
    seconds = F.col("conv_id") * 60 + F.col("turn") * 30 + 1704067200
    content = F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("text"))
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("long").alias("seq"),
        F.timestamp_seconds(seconds).alias("ts"),
        type_.alias("type"),
        F.when(type_ == rules.EVENT_MESSAGE, content).alias("content"),
        F.when(type_ == rules.EVENT_DELTA, F.col("text")).alias("delta"),
    )
