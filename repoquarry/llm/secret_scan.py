"""Secret scan: expressions propose candidates, a random forest on their features removes false positives.

Candidates, features, the forest's vote and redaction are column functions of one row: no join, no shuffle, no Python.
The forest is trained with Spark's random forest on labelled findings and then written out as one column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm.spans import find, let, once

THRESHOLD = 0.5
TREES, DEPTH, SEED = 20, 7, 7
EXAMPLES = 600
BEFORE = 32
MASK = "[SECRET]"
FINDING = "array<struct<start:bigint,end:bigint,score:double,secret:boolean,match:string>>"

_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential)"
_PREFIXES = r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|npm_"
# a value given to a secret's name; a key block; dotted tokens; a key with a known prefix, whatever stands beside it;
# a run of letters and digits, entered at its start, that no dot or @ joins to a name (a full stop may follow)
CANDIDATE = (
    rf"(?<=(?i:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"'`,;<>(){{}}\[\]]{{8,}}+"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+(?:\.{1,2}[A-Za-z0-9_-]++){1,4}+"
    r"|(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9@]|\.[A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9])(?:{_PREFIXES})(?:(?<=A[KS]IA)|(?=[A-Za-z_-]*+[0-9]))[A-Za-z0-9_-]{{12,}}+"
    r"|(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9@]|\.[A-Za-z0-9])"
)
NEED = rf"A[KS]IA|eyJ|SG\.|[A-Za-z+/_.-][0-9]|[0-9][A-Za-z+/_.-]|PRIVATE KEY|(?i:{_NAMES})[\"']?\s{{0,3}}[:=]"

# fixed values: words that make up placeholders and names rather than keys
DICTIONARY = (
    "access account admin address allow android answer apple application author build button cache change changeme channel check "
    "class client cloud color config connect content control count country create customer data database default demo "
    "description design development device document domain download dummy element email enter error event example export "
    "feature field file filter format function general group handler header hello here home host image import index input "
    "insert integration item language layer layout level library license link list local login machine manager master "
    "message method mock model module monitor mountain name network number object option order output package page "
    "param password pattern payload person placeholder platform please plugin policy preview product production profile "
    "project property public query question random record release report request resource response result river sample "
    "schema screen search secret section secure select server service session setting simple source staging standard "
    "start state static status storage stream string style submit summary support system table target template test "
    "text theme title token type update upload user value vector version view visitor water window world your"
).split()

FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    # candidate, text before it, path of its document
    "length": lambda v, b, p: F.length(v).cast("double"),
    "digits": lambda v, b, p: F.regexp_count(v, F.lit("[0-9]")) / F.length(v),
    "upper": lambda v, b, p: F.regexp_count(v, F.lit("[A-Z]")) / F.length(v),
    "hex": lambda v, b, p: v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
    "transitions": lambda v, b, p: F.regexp_count(v, F.lit("[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]")) / F.length(v),
    "repeats": lambda v, b, p: F.regexp_count(v, F.lit(r"(.)\1")) / F.length(v),
    "distinct": lambda v, b, p: F.size(F.array_distinct(F.split(v, "(?<=.)(?=.)"))) / F.length(v),
    "separators": lambda v, b, p: F.regexp_count(v, F.lit("[_./-]")) / F.length(v),
    "dictionary": lambda v, b, p: 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.length(v),
    "key_block": lambda v, b, p: v.startswith("-----BEGIN").cast("double"),
    "named": lambda v, b, p: b.rlike(rf"(?i){_NAMES}[^\n]{{0,12}}$").cast("double"),
    "assigned": lambda v, b, p: b.rlike(r"[:=]\s*[\"']?$").cast("double"),
    "quoted": lambda v, b, p: b.rlike(r"[\"'`]$").cast("double"),
    "digest_word": lambda v, b, p: b.rlike(r"(?i)\b(?:commit|revision|sha\d*|md5|hash|checksum|digest|etag|uuid|guid|blob|tree|build|fingerprint|integrity)\b[^\n]{0,12}$").cast("double"),
    "prefixed": lambda v, b, p: v.rlike(rf"^(?:{_PREFIXES}|eyJ|SG\.)").cast("double"),
    "test_path": lambda v, b, p: p.rlike(r"(?i)(?:^|[/_.-])(?:tests?|spec|examples?|samples?|docs?|fixtures?|mocks?)(?:[/_.-]|$)").cast("double"),
}


def labelled_examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(text, path, label): `n` renderings of each known kind of true and false finding, with values from hashes.

    This is the set the scan is trained on where no reviewed findings are given.
    """
    number = F.col("id").cast("string")
    hexa, long_hex = F.md5(number), F.sha1(number)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(number, 256))), "[+/=]", "x")
    upper = F.upper(F.translate(F.substring(F.sha2(number, 256), 1, 16), "0189", "gqyz"))
    words = F.array(*map(F.lit, DICTIONARY))
    word = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    size = (12 + F.col("id") % 12).cast("int")
    quote = F.when(F.col("id") % 2 == 0, '"').otherwise("")
    sign = F.when(F.col("id") % 3 == 0, " = ").when(F.col("id") % 3 == 1, "=").otherwise(": ")
    kinds: list[tuple[int, list[Column]]] = [
        (1, [F.lit("token"), sign, quote, long_hex, quote]),
        (1, [F.lit("password"), sign, quote, F.substring(mixed, 1, 20), quote]),
        (1, [F.lit("password"), sign, F.substring(hexa, 1, 20)]),
        (1, [F.lit("api_key"), sign, quote, mixed, quote]),
        (1, [F.lit("secret"), sign, quote, hexa, quote]),
        (1, [F.lit("AKIA"), upper]),
        (1, [F.lit("ghp_"), F.substring(mixed, 1, 36)]),
        (1, [F.lit("sk_live_"), F.substring(mixed, 1, 24)]),
        (1, [F.lit("eyJ"), F.substring(mixed, 1, 17), F.lit("."), mixed, F.lit("."), F.substring(mixed, 2, 43)]),
        (1, [F.lit("SG."), F.substring(mixed, 1, 22), F.lit("."), F.substring(mixed, 2, 43)]),
        (1, [F.lit("-----BEGIN RSA PRIVATE KEY-----")]),
        (1, [F.lit("passwd"), sign, quote, F.concat(word(5), F.substring(mixed, 3, 10)), quote]),
        (0, [F.lit("commit "), long_hex]),
        (0, [F.lit("md5 "), quote, hexa, quote]),
        (0, [F.lit("sha256: "), F.sha2(number, 256)]),
        (0, [F.lit("uuid "), F.regexp_replace(hexa, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")]),
        (0, [F.lit("token"), sign, quote, F.concat(F.lit("your_"), word(1), F.lit("_token_here")), quote]),
        (0, [F.lit("password"), sign, quote, F.concat(word(1), F.lit("_"), word(2)), quote]),
        (0, [F.lit("api_key"), sign, quote, F.concat(F.lit("example-"), word(1), F.lit("-1234")), quote]),
        (0, [F.lit("secret"), sign, F.concat(F.lit("config."), word(1), F.lit("."), word(2))]),
        (0, [F.lit("see "), F.concat(word(1), F.lit("-"), word(2), F.lit("-"), word(3), F.lit("-2"), (F.col("id") % 1000).cast("string"))]),
        (0, [F.lit("in "), F.concat(word(1), F.lit("/"), word(2), F.lit("/"), word(3), F.lit("_v"), (F.col("id") % 10).cast("string"))]),
        (0, [F.lit("in "), F.concat(word(1), F.lit("-"), word(2), F.lit("-"), word(3), F.lit("."), word(4), F.lit("_v2."), word(5), F.lit("_"), word(6), F.lit("_"), word(7))]),
        (0, [F.lit("token"), sign, quote, F.repeat(F.lit("x"), size), quote]),
        (0, [F.lit("build "), F.concat(word(1), F.lit("_"), F.lit("2024010112"), word(2))]),
        (0, [F.lit("password"), sign, quote, F.concat(F.lit("test"), word(1), F.lit("123")), quote]),
    ]
    after = F.when(F.col("id") % 5 == 4, F.lit(".")).when(F.col("id") % 5 == 3, F.lit(", here")).when(F.col("id") % 5 == 2, F.lit(")")).otherwise(F.lit(" is here"))
    rows = F.array(*[F.struct(F.concat(F.lit("the value of "), *parts, after).alias("text"), F.lit(label).alias("label")) for label, parts in kinds])
    lines = spark.range(n).select("id", F.inline(rows))
    path = F.when((F.col("label") == 0) & (F.col("id") % 4 == 0), "tests/fixtures/data.txt").otherwise("src/main.txt")
    return lines.select("text", path.alias("path"), "label")


def _context(body: Column, start: Column) -> Column:
    begin = F.greatest(start - BEFORE, F.lit(0))
    return F.substring(body, (begin + 1).cast("int"), (start - begin).cast("int"))


def _features(match: Column, before: Column, path: Column) -> Column:
    return F.struct(*[f(match, before, path).cast("double").alias(name) for name, f in FEATURES.items()])


def features_of(examples: DataFrame) -> DataFrame:
    """(label, features...) of every candidate in the texts of labelled findings (text, path, label)."""
    spans = examples.select("path", "label", "text", F.explode(find("text", CANDIDATE, F.col("text").rlike(NEED))).alias("s"))
    return spans.select("label", F.inline(F.array(_features(F.col("s.match"), _context(F.col("text"), F.col("s.start")), F.coalesce("path", F.lit(""))))))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """The forest learnt from labelled findings (text, path, label), as the text form of its trees.

    The rows are put in order in one partition, so the same findings give the same forest; a caller bounds them.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features_of(findings).orderBy("label", *FEATURES).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors.select("features", "label"))
    return forest.toDebugString


def forest_column(trees: str, value: Callable[[int], Column]) -> Column:
    """Share of the trees that vote for label 1, from the text form of a forest; `value` gives a feature by number."""
    roots: list[Column] = []
    lines = [line.strip() for line in trees.splitlines() if line.strip()]

    def node(at: int) -> tuple[Column, int]:
        if leaf := re.match(r"Predict: ([\d.E+-]+)", lines[at]):
            return F.lit(float(leaf[1])), at + 1
        test = re.match(r"If \(feature (\d+) <= ([\d.E+-]+)\)", lines[at])
        low, at = node(at + 1)
        high, at = node(at + 1)  # past the matching "Else"
        return F.when(value(int(test[1])) <= float(test[2]), low).otherwise(high), at

    at = 0
    while at < len(lines):
        if lines[at].startswith("Tree "):
            root, at = node(at + 1)
            roots.append(root)
        else:
            at += 1
    total = roots[0]
    for root in roots[1:]:
        total = total + root
    return total / F.lit(float(len(roots)))


def scan_secrets(df: DataFrame, forest: str, text: str = "text", path: str | None = None, threshold: float = THRESHOLD, out: str = "findings") -> DataFrame:
    """All columns of `df` and `out`: every candidate of the whole text with place, score and verdict.

    `score` is the share of trees that call the candidate a secret, `secret` whether it reaches `threshold`.  `path` names
    a column with the document's path, if there is one.  Places count code points, the end is exclusive.  Null and empty
    texts have no candidates.  A column named like `out` is replaced.
    """
    body, raw = "__secret_text", "__secret_spans"
    source = df.drop(out).withColumn(body, F.coalesce(F.col(text), F.lit("")))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    located = once(source, **{raw: find(body, CANDIDATE, F.col(body).rlike(NEED))})
    names = list(FEATURES)

    def judged(s: Column) -> Column:
        features = let(_context(F.col(body), s["start"]), lambda b: _features(s["match"], b, where))
        score = let(features, lambda f: forest_column(forest, lambda k: f[names[k]]))
        return let(score, lambda x: F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("score"), (x >= threshold).alias("secret"), s["match"].alias("match")))

    return once(located, **{out: F.transform(raw, judged).cast(FINDING)}).drop(body, raw)


def redact(df: DataFrame, text: str = "text", findings: str = "findings", mask: str = MASK) -> DataFrame:
    """`df` without `findings`, with every secret of the text replaced by `mask`; `n_chars`, if there, is counted anew."""

    def rebuilt(secrets: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            plain = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(plain, F.lit(mask))).alias("parts"))

        whole = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(F.col(text))))
        return F.aggregate(secrets, start, step, whole)

    secrets = F.filter(findings, lambda s: s["secret"])
    changed = once(df, __redacted=F.when(F.size(secrets) > 0, let(secrets, rebuilt)))
    columns = []
    for name in df.columns:
        if name == text:
            columns.append(F.coalesce("__redacted", F.col(text)).alias(text))
        elif name == "n_chars":
            columns.append(F.when(F.col("__redacted").isNotNull(), F.length("__redacted")).otherwise(F.col(name)).cast(df.schema[name].dataType).alias(name))
        elif name != findings:
            columns.append(F.col(name))
    return changed.select(*columns)
