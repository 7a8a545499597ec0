"""Stored inverted index of the catalogue: written once, appended to, searched by the buckets of the asked grams.

`<path>/entries` holds what is scored of every entry, `<path>/blocks` the postings: one row for a block of entries that share
a character n-gram and the best score any query filed under that gram can give them.  Blocks lie in folders by a hash of their gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.operators.catalogue import GRAM, _check_limit, _grams, answer, is_root_agent, relevance, searched_texts
from repoquarry.operators.grouping import spread_join, top_k_per_group

BUCKETS = 64
BLOCK = 256
_BLOCKS = "gram string, bound bigint, slot bigint, n bigint, members array<struct<repo_id:string,ord:bigint>>, bucket int"
_ENTRY = ("repo_id", "ord", "type", "name", "description", "category", "triggers", "is_sub_agent")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _bound(gram: Column) -> Column:
    """The most a query that holds `gram` can score: each text with the gram counts as if it held, and were, the query.

    The texts of the entry are in lower case already.
    """
    def points(text: Column, value: int) -> Column:
        return F.when(text.contains(gram), value).otherwise(0)

    per_trigger = rules.SCORE_TRIGGER_CONTAINS + rules.SCORE_TRIGGER_EQUALS
    triggers = F.filter("triggers", lambda t: t.contains(gram))
    parts = [
        points(F.col("name"), rules.SCORE_NAME_EQUALS + rules.SCORE_NAME_CONTAINS),
        points(F.col("description"), rules.SCORE_DESCRIPTION),
        F.size(triggers) * per_trigger,
        points(F.col("category"), rules.SCORE_CATEGORY),
        F.when(is_root_agent(), rules.SCORE_ROOT_AGENT).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, parts).cast("long")


def write_index(registry: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Add the entries of `registry` to the index at `path`, which is created where it does not exist.

    Repositories are appended whole and once: an entry is known by (repo_id, ord).  Every call to one index gives the same
    number of `buckets`.  Postings of one gram and bound are dealt to blocks of about `block` by a hash, so that
    a gram of every entry fills many tasks and no row grows with the catalogue.  Entries are dealt to tasks before their
    n-grams are listed, which are many times their size, however few files they come from.
    """
    path = path.rstrip("/")
    entries = registry.select(*_ENTRY)
    entries.write.mode("append").parquet(f"{path}/entries")
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    grams = F.array_distinct(F.flatten(F.transform(F.array_distinct(searched_texts()), lambda t: _grams(t, sizes))))
    dealt = entries.repartition("repo_id", "ord").withColumn("gram_list", grams)
    # in lower case once for an entry, not for each of its n-grams
    lowered = dealt.withColumns({name: F.lower(name) for name in ("name", "description", "category")}).withColumn(
        "triggers", F.transform(F.coalesce("triggers", F.array().cast("array<string>")), lambda t: F.lower(t))
    )
    postings = lowered.withColumn("gram", F.explode("gram_list")).select("gram", _bound(F.col("gram")).alias("bound"), "repo_id", "ord")
    postings = postings.withColumn("member", F.xxhash64("repo_id", "ord"))
    counts = postings.groupBy("gram", "bound").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("slots"))
    dealt = spread_join(postings, counts, ["gram", "bound"], "member").withColumn("slot", F.pmod("member", "slots"))
    blocks = dealt.groupBy("gram", "bound", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("repo_id", "ord")).alias("members")
    )
    blocks = blocks.withColumn("bucket", _bucket(F.col("gram"), buckets))
    blocks.repartition("bucket", "slot").sortWithinPartitions("bucket", "gram", "bound").write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, blocks) of a stored index."""
    path = path.rstrip("/")
    return spark.read.parquet(f"{path}/entries"), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def search_indexed(
    index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 10, type: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """`search_batch` on a stored index: the same rows (query_id, rank, score, repo_id, ord).

    Only the folders of the grams that are asked for are read; finding them is a job here, which brings at most
    `buckets` numbers to the driver.  A query is filed under its rarest gram.  The blocks of the highest bounds that
    together hold `k` entries are scored first; further blocks only where their bound reaches the score of the
    k-th hit, since no entry of the others can come before it.
    """
    _check_limit(k)
    entries, blocks = index
    entries = entries if type is None else entries.where(F.col("type") == type)
    asked = queries.select(F.lower("query").alias("q")).distinct()
    own = F.array_distinct(_grams(F.col("q"), F.array(F.least(F.char_length("q"), F.lit(GRAM)))))
    grams = asked.where("q <> ''").select("q", F.explode(own).alias("gram"))
    wanted = [row[0] for row in grams.select(_bucket(F.col("gram"), buckets)).distinct().collect()]
    blocks = blocks.where(F.col("bucket").isin(wanted))

    classes = blocks.groupBy("gram", "bound").agg(F.sum("n").alias("n"))
    counts = classes.groupBy("gram").agg(F.sum("n").alias("n"))
    # a query with a gram that no entry has is in no entry
    met = grams.join(counts, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    filed = met.where("least.n > 0").select("q", F.col("least.gram").alias("gram"))
    # one row for each bound of a query's gram: how many entries have a higher one
    higher = Window.partitionBy("q").orderBy(F.col("bound").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = filed.join(classes, "gram").withColumn("ahead", F.coalesce(F.sum("n").over(higher), F.lit(0))).drop("n")

    bonus = F.when(is_root_agent(), rules.SCORE_ROOT_AGENT).otherwise(0)

    def hits(chosen: DataFrame) -> DataFrame:
        found = spread_join(blocks, chosen.select("q", "gram", "bound"), ["gram", "bound"], "slot")
        pairs = found.select("q", F.inline("members"))
        scored = pairs.join(entries, ["repo_id", "ord"]).withColumn("score", relevance(F.col("q")).cast("long"))
        return scored.where(F.col("score") > bonus).select("q", "score", "repo_id", "ord")

    order = [F.col("score").desc(), F.col("repo_id"), F.col("ord")]
    first = top_k_per_group(hits(steps.where(F.col("ahead") < k)), ["q"], order, k, ["repo_id", "ord"])
    least = first.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    later = steps.where(F.col("ahead") >= k).join(least, "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))
    best = first.drop("rank").unionByName(hits(later))
    best = top_k_per_group(best, ["q"], order, k, ["repo_id", "ord"]).drop("rank")
    return answer(best, entries, asked, queries, k)
