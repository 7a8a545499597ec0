"""Registered queries of the subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm import (
    decontamination, language_id, licence_scan, manifest, minhash, packing, periodic_runs, pii, quality_rules, secret_scan, token_counts, toxicity, warc_zip,
)
from repoquarry.llm.common import remainder, table
from repoquarry.llm.spans import listed, once
from repoquarry.plans.storage import working_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secret candidates of all documents with the forest's score and verdict: a row for each."""
    forest = secret_scan.train(secret_scan.labelled_examples(spark))
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan_secrets(documents, forest, path="source").select("doc_id", F.inline("findings"))
    return found.withColumn("match", F.sha2("match", 256)).withColumnRenamed("match", "fingerprint")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to ZIP-packaged WARC archives and read back by range."""
    found = warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))

    def number(urn: str) -> Column:
        return F.regexp_extract(urn, "^<urn:record:(-?[0-9]+)>$", 1).try_cast("bigint")

    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "intact",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that documents repeat: a row for each document and item."""
    shards = decontamination.build_shards(table(spark, sf_dir, "benchmark"))
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), shards)
    return found.select("doc_id", F.inline("hits"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and signatures of all documents."""
    found = licence_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    every = F.flatten(F.map_values("places"))
    base = F.array_sort(F.map_keys(F.map_filter("places", lambda _, p: F.size(p) > 0)))
    return found.select(
        "doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    documents = table(spark, sf_dir, "documents")
    found = minhash.near_duplicates(documents, size=3, threshold=(100, 85))
    return found.withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of power-of-two length."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(documents, tokenizer_path(), checksums=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("findings", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")),
        F.sha2(listed(base, lambda s: s["kind"]), 256).alias("base_sha256"), listed(F.col("findings"), lambda s: s["kind"]).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt on the rows outside the held-out fold."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    machine = toxicity.fit(documents, labels.where(~held_out))
    scored = toxicity.score(documents, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by byte context trees of the rows outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(documents.where(~held_out))
    found = language_id.identify(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and the verdict of the weakly supervised rules."""
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        "doc_id", *quality_rules.COUNTS, failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), path, working_dir(spark, "token_cache"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, tree and proof of all documents, and what the proof says of rows that were tampered with."""
    documents = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(remainder("doc_id", 2) == 0, manifest.leaf_digest(*map(F.col, fields), F.replace("text", F.lit("\n"), F.lit(""))))
    found = manifest.manifest(documents, tampered=tampered).withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = (crc % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    plain = once(documents, words=F.when(planted, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    seed, n = F.floor(crc / 10), F.size("words")
    plain = once(plain, start=(seed % n).cast("int"))
    plain = once(plain, period=(1 + F.floor((n - F.col("start")) / (3 + seed % 8))).cast("int"))
    word = lambda i: F.get("words", (F.col("start") + (i - F.col("start")) % F.col("period")).cast("int"))
    tail = F.transform(F.sequence(F.col("start"), n - 1), word)
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("start")), tail), " ")
    found = periodic_runs.find_runs(plain.select("doc_id", F.when(F.col("words").isNotNull(), periodic).otherwise(F.col("text")).alias("text")))
    runs = F.col("runs")

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    # runs are in order of start and period, so the first of equal ones stays
    strongest = F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    found = once(found, strongest=strongest)
    return found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {}

SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
links AS (SELECT x AS u, y AS v FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other
)
SELECT sets.doc_id, len(s) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

SQL["op2_warc"] = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
last AS (SELECT body, max(page_id) AS last FROM rows WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT page_id, octet_length(rows.body)::BIGINT AS payload_bytes, sha1(rows.body) AS payload_digest,
    CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last <> page_id THEN last END AS refers_to, TRUE AS intact
FROM rows LEFT JOIN last USING (body)
"""


# crc32 takes the bytes of the decimal id one by one, and eight shifts (-1) after each
SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, coalesce('=' || source, '') AS grp, text, list_reduce(list_concat([4294967295], flatten(list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) AS crc,
        coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
    FROM documents
),
leaves AS (
    SELECT doc_id, grp, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
    FROM fields
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree(grp, lvl, pos, n, digest) AS (
    SELECT grp, 0, pos, n, leaf FROM numbered
    UNION ALL
    SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
),
subroots AS (SELECT grp, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS total FROM tree WHERE n = 1),
crown(lvl, pos, n, digest) AS (
    SELECT 0, place, total, subroot FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, pos // 3, n
),
roots AS (SELECT lvl AS crown_height, digest AS root FROM crown WHERE n = 1),
siblings AS (
    SELECT grp, lvl, pos, coalesce(lag(digest, 2) OVER run, '') || coalesce(lag(digest, 1) OVER run, '') AS l,
        coalesce(lead(digest, 1) OVER run, '') || coalesce(lead(digest, 2) OVER run, '') AS r
    FROM (SELECT grp, lvl, pos, n, digest FROM tree UNION ALL SELECT NULL, lvl, pos, n, digest FROM crown) WHERE n > 1
    WINDOW run AS (PARTITION BY grp, lvl, pos // 3 ORDER BY pos)
),
climb(grp, begun, here, lvl, h, proof) AS (
    SELECT grp, pos, pos, 0, coalesce(tampered, leaf), '' FROM numbered
    UNION ALL
    SELECT c.grp, begun, here // 3, c.lvl + 1, sha256(l || h || r), proof || l || r FROM climb c JOIN siblings s ON s.grp = c.grp AND s.lvl = c.lvl AND s.pos = c.here
),
end_of_climb(grp, begun, here, lvl, h, proof) AS (
    SELECT c.grp, begun, place, 0, h, proof FROM climb c JOIN subroots s ON s.grp = c.grp AND s.height = c.lvl
    UNION ALL
    SELECT c.grp, begun, here // 3, c.lvl + 1, sha256(l || h || r), proof || l || r FROM end_of_climb c JOIN siblings s ON s.grp IS NULL AND s.lvl = c.lvl AND s.pos = c.here
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM numbered JOIN subroots USING (grp) CROSS JOIN roots
JOIN end_of_climb c ON c.grp = numbered.grp AND c.begun = numbered.pos AND c.lvl = crown_height
"""
