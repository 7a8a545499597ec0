"""Near-duplicate documents by min-max hashing, banding, and exact confirmation.

Each permutation of the shingle space yields two signature values, the minimum and the maximum over the document's
shingles.  Both agree for two documents with the probability of their Jaccard similarity, so half the hash evaluations
give a signature of the same length, and of lower variance.  Bands of signature values make candidates; whether two
documents are linked is decided on their full shingle sets.

The steps, none of which gathers a group of unbounded size:

1. Texts with equal shingle sets form a class, represented by its smallest id.
2. Representatives that share a band are candidates; each is paired with the smallest of the band only.  Where
   the signatures put a pair far apart, the representative is paired again with the smallest of those left over.  What is
   far from both is compared by signature with all others left in the band, in blocks.
3. Connected components of these pairs are clusters: documents in different clusters are not alike.
4. Inside a cluster all similarities are computed exactly, in blocks of bounded size: a cluster of `k` blocks makes
   `k (k + 1) / 2` tasks.  A task yields the links of a spanning forest of its two blocks, never all pairs.
5. Connected components of those links, and class membership, give every row its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare, utf8
from repoquarry.llm.components import connected_components
from repoquarry.plans.storage import settle

PERMUTATIONS = 56
ROWS = 4
FAR = 0.45
BLOCK = 200_000
BAND_BLOCK = 4096
CACHE_WORDS = 300_000
_SEED = 20_240_229
# Spark's runtime Bloom filters at any size of the tables; a filter has at most 8 MB
_BLOOM = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g"}


def shingles(text: bytes, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are separated by ASCII white space and A-Z are lower-cased.  A text of fewer than `size` words is one
    shingle as a whole; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for word in words:
        if word not in cache:
            cache[word] = xxhash.xxh3_64_intdigest(word)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    mixed = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ ids[k : len(ids) - size + k + 1]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(1, 2**63, count, np.uint64) * 2 + 1, rng.integers(0, 2**63, count, np.uint64)


def signature(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation: 2 x permutations values of 32 bits."""
    lows, highs = np.full(len(factors), 2**64 - 1, np.uint64), np.zeros(len(factors), np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start : start + 4096]
        permuted = (part[None, :] ^ (part[None, :] >> np.uint64(32))) * factors[:, None] + shifts[:, None]
        lows, highs = np.minimum(lows, permuted.min(1)), np.maximum(highs, permuted.max(1))
    return (np.concatenate([lows, highs]) >> np.uint64(32)).astype(np.uint32)


def sign(df: DataFrame, key: str, text: str, size: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, digest of the shingle set, signature bytes, band keys) of every row."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        factors, shifts = _permutations(permutations)
        order = np.random.default_rng(_SEED + 1).permutation(2 * permutations)
        for batch in batches:
            sizes, digests, signed, bands = [], [], [], []
            for text in utf8(batch.column(1)):
                found = shingles(text, size, cache)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    signed.append(None)
                    bands.append(None)
                    continue
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                values = signature(found, factors, shifts)
                signed.append((values & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                grouped = values[order][: 2 * permutations // rows * rows].reshape(-1, rows)
                bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=b) - 2**63 for b, row in enumerate(grouped)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "signature", "bands"],
            )

    schema = "id bigint, n_shingles bigint, digest binary, signature binary, bands array<bigint>"
    return df.select(F.col(key).cast("bigint"), text).mapInArrow(run, schema)


def _agreement(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Add `near`: the share of equal signature values of `id` and `leader`."""
    left = signatures.select(F.col("id"), F.col("signature").alias("__a"))
    right = signatures.select(F.col("id").alias("leader"), F.col("signature").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(n, -1) if n else np.zeros((0, 1)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(1))], names=["id", "leader", "near"])

    joined = pairs.join(left, "id").join(right, "leader").select("id", "leader", "__a", "__b")
    return joined.mapInArrow(run, "id bigint, leader bigint, near double")


def _leftover_links(rest: DataFrame, signatures: DataFrame, far: float, block: int) -> DataFrame:
    """Links (u, v) that connect what is not far apart among all members (id, band) of each band.

    A band is dealt to blocks of about `block` members, and each two of its blocks to one task, with signatures only.  A task
    yields the links of a spanning forest, never all pairs.
    """
    count = F.count(F.lit(1))
    sizes = rest.groupBy("band").agg(count.alias("n"), F.ceil(count / F.lit(block)).cast("int").alias("k")).where("n > 1")
    placed = rest.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "id", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    rows = dealt.join(signatures.select("id", "signature"), "id").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, links = None, [], []

        def close() -> None:
            if len(members) < 2:
                members.clear()
                return
            members.sort(key=lambda m: (m[1], m[0]))
            ids, blocks = [m[0] for m in members], np.array([m[1] for m in members])
            signs = np.frombuffer(b"".join(m[2] for m in members), np.uint16).reshape(len(members), -1)
            # within a block each with those after it; of two blocks the members of one with those of the other
            inside = group[1] == group[2]
            last = len(members) if inside else int(np.searchsorted(blocks, blocks[0], "right"))
            root = np.arange(len(members))
            for i in range(last):
                later = np.arange(i + 1 if inside else last, len(members))
                later = later[root[later] != root[i]]
                for j in later[(signs[later] == signs[i]).mean(1) >= far].tolist():
                    if root[j] != root[i]:
                        links.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
            members.clear()

        for batch in batches:
            for i, band, own, low, high, signature in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (band, low, high) != group:
                    close()
                    group = (band, low, high)
                members.append((i, own, signature))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])
            links.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.select("id", "band", "block", "low", "high", "signature").mapInArrow(run, "u bigint, v bigint")


def _candidates(signed: DataFrame, far: float, block: int = BAND_BLOCK) -> DataFrame:
    """Links (u, v) that connect all representatives that share a band and are not clearly far apart.

    Most bands hold one document; what is stored are the members of shared bands other than their leader.  Those far from
    their leader meet the smallest of them in a second round; what is far from both leaders is compared with each other.
    """
    links, rest = None, signed.select("id", F.explode("bands").alias("band"))
    for _ in range(2):
        leaders = rest.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
        met = settle(rest.join(leaders, "band").where("id <> leader"), "met")
        near = settle(_agreement(met.select("id", "leader").distinct(), signed.select("id", "signature")), "near")
        found = near.where(F.col("near") >= far).select(F.col("id").alias("u"), F.col("leader").alias("v"))
        links = found if links is None else links.unionByName(found)
        rest = met.join(near.where(F.col("near") < far).select("id", "leader"), ["id", "leader"]).select("id", "band")
    return links.unionByName(_leftover_links(rest, signed, far, block))


def _forest(members: list[tuple[int, int, np.ndarray]], same: bool, accept: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning forest of the exact links among members (id, block, shingles) of two blocks, or of one."""
    members.sort(key=lambda m: (m[1], m[0]))
    ids = np.array([m[0] for m in members])
    block = np.array([m[1] for m in members])
    sizes = np.array([len(m[2]) for m in members])
    flat = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(len(members))
    hit = np.zeros(int(flat.max()) + 1, np.int32)
    links = []
    for i in range(len(members)):
        first = i + 1 if same else int(np.searchsorted(block, block[0], "right"))
        if first >= len(members) or not same and i >= first:
            break
        if (root[first:] == root[i]).all():
            continue
        own = flat[starts[i] : starts[i + 1]]
        hit[own] = 1
        common = np.add.reduceat(hit[flat[starts[first] :]], starts[first:-1] - starts[first])
        hit[own] = 0
        for j in first + np.flatnonzero(accept[0] * common >= accept[1] * (sizes[i] + sizes[first:] - common)):
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def _exact_links(clusters: DataFrame, texts: DataFrame, size: int, accept: tuple[int, int], block: int) -> DataFrame:
    """Links (u, v) confirmed on full shingle sets, enough of them to connect what is connected."""
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias("k"))
    placed = clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    # block b meets blocks c >= b as (b, c) and c <= b as (c, b)
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "id", "digest", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    # the comparison lets Spark see a selective side and drop other texts by a Bloom filter before they are shuffled
    wanted = texts.join(clusters.where("n_shingles > 0").select("id"), "id", "left_semi")
    rows = dealt.join(wanted, "id").repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        group, members, u, v = None, {}, [], []

        def close() -> None:
            if len(members) > 1:
                low, high = group[1:]
                for a, b in _forest([(i, b, found) for i, (b, found) in members.items()], low == high, accept):
                    u.append(a)
                    v.append(b)
            members.clear()

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
            for (i, digest, cluster, own, low, high), text in zip(keys, utf8(batch.column(6)), strict=True):
                if (cluster, low, high) != group:
                    close()
                    group = (cluster, low, high)
                found = shingles(text, size, cache)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest:  # else another text of a repeated id
                    members[i] = (own, found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select("id", "digest", "cluster", "block", "low", "high", "__text").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    threshold: tuple[int, int] = (100, 80),
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
    far: float = FAR,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `df`: (id, n_shingles, component_id, kept).

    Two texts are linked if `threshold[0] * |A & B| >= threshold[1] * |A | B|` for their sets of `size`-word shingles;
    `component_id` is the smallest id reachable over links.  Texts without words have no links.  Rows of one id
    are one node, whatever their texts; a row without an id has no links, no component and is kept.
    With the defaults a link is missed only if no band of 4 out of 112 signature values agrees: at similarity 0.8 with
    probability 4e-7, at 0.85 with 1e-8.
    """
    for name, value in _BLOOM.items():
        df.sparkSession.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{name}", value)
    source = df.select(F.col(key).cast("bigint").alias("__key"), F.col(text).alias("__text"))
    signed = settle(sign(source, "__key", "__text", size, permutations, rows), "signed")
    valid = signed.where("id IS NOT NULL AND digest IS NOT NULL")
    # of each class the smallest id, with that row's signature (equal in all rows of the class)
    classes = settle(valid.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n_shingles")), "classes")
    own = valid.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
    reps = settle(own.groupBy("id", "digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "reps")
    clusters = connected_components(_candidates(reps, far)).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    clusters = settle(reps.select("id", "digest", "n_shingles").join(clusters, "id"), "clusters")
    texts = source.select(F.col("__key").alias("id"), "__text")
    links = _exact_links(clusters, texts, size, threshold, block)
    # an id with several texts joins their classes
    several = valid.select("id", "digest").join(classes.select("digest", "rep"), "digest")
    several = several.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("id")
    several = valid.join(several, "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    components = connected_components(links.unionByName(several))
    known = classes.join(components, classes.rep == components.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = signed.select("id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
