"""Token counts, Merkle manifest and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from repoquarry.llm import manifest, periodic_runs, token_counts
from repoquarry.llm import queries as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet")


def crc(i):
    return zlib.crc32(str(i).encode())


# token counts


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(path, texts):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, corpus):
    rows = documents(spark, corpus).collect()
    path = tokenizer("word_bpe_49k.json")
    want = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, counted(path, [r["text"] or "" for r in rows]), strict=True)]
    got = [tuple(r) for r in Q.op11_token_counts(spark, corpus).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


ODD = [
    None, "", " ", "A  b\n\tc", "a b c", "A B C", "it's IT'S 12 x", "<|endoftext|>", "<|ENDOFTEXT|> a", "x<|endoftext|>y <|startoftext|>", "J̌ ǰ ǰ",
    "é ́e", " a b　", "a\u0085b", "İı STRASSE ß ẞ ΣΑΣ", "漢字 かな", "\x00\x1c\x1f a", "K K k", "#" * 500, "ab" * 50_000, "힣 한", "! ? !? ' s",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, tmp_path, name):
    path = tokenizer(name)
    df = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id int, text string")
    got = token_counts.count_tokens(df, path, f"{tmp_path}/cache").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == counted(path, [t or "" for t in ODD * 2])
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in ODD * 2]


def test_normal_forms_do_not_change_counts(spark, tmp_path):
    rng = random.Random(3)
    parts = ["a", "B", " ", "\n", "\t ", "'s", "S", "<|", "endoftext", "ENDOFTEXT", "|>", "<|endoftext|>", "é", "é", "J̌", "9", "!", " ", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)]
    path = tokenizer("word_bpe_49k.json")
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, f"{tmp_path}/cache").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == counted(path, texts)
    assert len({r["digest"] for r in got}) < len(set(texts))


def test_cache_encodes_only_distinct_misses(spark, tmp_path):
    path, cache = tokenizer("word_bpe_49k.json"), f"{tmp_path}/cache"
    version = token_counts.tokenizer_version(path)

    def stored():
        return spark.read.parquet(f"{cache}/{version}").count()

    first = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "One  Two", "three", None, "three"])], "doc_id int, text string")
    token_counts.count_tokens(first, path, cache).collect()
    assert stored() == 3
    token_counts.count_tokens(first, path, cache).collect()
    assert stored() == 3
    second = first.union(spark.createDataFrame([(9, "four"), (10, "THREE")], first.schema))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(second, path, cache).collect()}
    assert stored() == 4 and got == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1, 9: 1, 10: 1}
    # what the cache holds is what is returned: counts are joined, not made anew
    spark.createDataFrame([(bytearray(hashlib.sha256(b"five").digest()), 55)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(f"{cache}/{version}")
    assert token_counts.count_tokens(spark.createDataFrame([(1, "FIVE")], first.schema), path, cache).first()["n_tokens"] == 55


def test_many_misses_are_dealt_by_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW", 2)
    path = tokenizer("word_bpe_49k.json")
    texts = [f"word{i % 40} and {i % 40}" for i in range(200)] + ["hot"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_tokens", F.lit("clash"))
    got = token_counts.count_tokens(df, path, f"{tmp_path}/cache", keep=tuple(df.columns)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == counted(path, texts)
    assert spark.read.parquet(f"{tmp_path}/cache/{token_counts.tokenizer_version(path)}").count() == 41


# manifest


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(digests):
    """Root and, for each leaf, the list of (left, right) siblings; every three consecutive nodes have a parent."""
    paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, owned = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            owned.append([leaf for members in owners[at : at + 3] for leaf in members])
        level, owners = above, owned
    return level[0], paths


def whole_tree(rows):
    """(doc_id, leaf, subroot, root, path, row) of rows with doc_id, source, lang, n_chars, text."""
    leaves = [(r, sha("".join(value(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))) for r in rows]
    leaves.sort(key=lambda x: (x[0]["source"] is not None, (x[0]["source"] or "").encode(), x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    groups = [list(g) for _, g in groupby(leaves, key=lambda x: x[0]["source"])]
    trees = [tree([leaf for _, leaf in g]) for g in groups]
    if not trees:
        return []
    root, tops = tree([subroot for subroot, _ in trees])
    return [(r["doc_id"], leaf, subroot, root, path + top, r) for g, (subroot, paths), top in zip(groups, trees, tops, strict=True) for (r, leaf), path in zip(g, paths, strict=True)]


def proven(rows):
    """The rows of op12 by brute force."""
    out = []
    for i, leaf, subroot, root, path, r in whole_tree(rows):
        h = leaf
        if i is not None and crc(i) % 2 == 0:
            text = None if r["text"] is None else r["text"].replace("\n", "")
            h = sha("".join(map(value, (i, r["source"], r["lang"], r["n_chars"], text))))
        for left, right in path:
            h = sha(left + h + right)
        out.append((i, leaf, subroot, root, sha("".join(x + y for x, y in path)), h, h == root))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark, corpus):
    rows = documents(spark, corpus).collect()
    got = sorted([tuple(r) for r in Q.op12_merkle_manifest(spark, corpus).collect()], key=str)
    assert got == proven(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("sizes", [[1], [3], [4, 1], [243, 244, 1, 2], [1000, 10], [800]])
def test_trees_of_all_sizes(spark, sizes, tmp_path):
    """Groups of one row to several rounds of blocks, with repeated rows and ids, nulls, and an empty and a null group."""
    names = [None, "", "é", "z"]
    rows = [(None if i == 5 else i // 2 if g == 0 else i, names[g], None if i % 3 else "en", i % 4, f"{i % 7}\n") for g, n in enumerate(sizes) for i in range(n)]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in Q.op12_merkle_manifest(spark, str(tmp_path)).collect()], key=str)
    assert got == proven([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])


def test_more_groups_than_a_block(spark):
    rows = [(i, f"s{i % 300}", "en", 1, "x") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("path", F.lit("clash")).withColumn("pos", F.lit(1))
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in manifest.manifest(df).collect()}
    want = whole_tree([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])
    assert got == {i: (leaf, subroot, root, path) for i, leaf, subroot, root, path, _ in want}


def test_no_window_holds_a_whole_group(spark, corpus):
    """Siblings are found in windows of one block; only counts of parts are numbered by group."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    nodes, largest = manifest.number(rows.withColumnRenamed("leaf", "digest"), "source", ["doc_id"])
    assert largest == 3000 and [r[0] for r in nodes.orderBy("doc_id").select("pos").collect()] == list(range(3000))
    climbed = manifest._climbed(nodes, "source")
    assert max(r["count"] for r in climbed.groupBy("source", "block").count().collect()) == manifest.BLOCK


# periodic runs


def brute_runs(words, least=24, copies=3):
    found = {}
    for q in range(1, len(words) // copies + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, copies * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    """A list of few or many different words with stretches of many periods, some of them nested or side by side."""
    letters = rng.choice([1, 2, 3, 50])
    words = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.4:
            words += [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 90))]
            continue
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 23, 24, 25, 35, 36, 37, 60, 90]))]
        words += (unit * 8)[: int(len(unit) * rng.uniform(1.5, 6))]
        if rng.random() < 0.2:
            words += words[-40:] * rng.randint(1, 3)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    total = 0
    for _ in range(120):
        texts = [drawn(rng) for _ in range(rng.randint(0, 6))]
        want = [brute_runs(words) for words in texts]
        total += sum(map(len, want))
        assert periodic_runs.runs_of(texts) == want
    assert total > 200


def test_every_period_is_found():
    """Each period on both sides of a scale's ends, with exactly three copies between other words."""
    rng = random.Random(2)
    for q in [*range(1, 60), 99, 100, 101, 500, 1333]:
        unit = [b"%d.%d" % (q, k) for k in range(q)]
        copies = max(24, 3 * q)
        words = [b"x%d" % rng.randrange(10**6) for _ in range(50)] + (unit * 25)[:copies] + [b"y%d" % rng.randrange(10**6) for _ in range(50)]
        assert periodic_runs.runs_of([words, words[60:]])[0] == [(50, copies, q)]


def test_scales_cover_all_periods():
    found = periodic_runs.scales(100_000)
    assert found[0][0] == periodic_runs.SHORT + 1 and found[-1][1] >= 33_333
    assert all(b[0] == a[1] + 1 for a, b in zip(found, found[1:], strict=False)) and all(2 * low - high + 1 > 0 for low, high in found)


def expected(i, text):
    words = SPACE.findall(text or "")
    n = len(words)
    if i is not None and crc(i) % 10 == 0 and n:
        a, g = crc(i) // 10 % n, crc(i) // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    return (
        i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for k, w in enumerate(words) if k not in drop)),
    )


def test_periodic_runs_query(spark, corpus, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 400)))) for i in range(150)]
    texts += [(i, t) for i, t in ((200, None), (201, ""), (202, "\x0b one word \x1c"), (None, "a " * 60), (203, "a b " * 60), (203, "a b " * 60), (204, "é è\n" * 2000))]
    extra = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(1))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([expected(*t) for t in texts], key=str)
    assert sum(r[1] for r in got) > 10
    short = [r for r in documents(spark, corpus).collect() if len(r["text"] or "") < 20_000]
    got = [tuple(r) for r in Q.op13_periodic_runs(spark, corpus).collect()]
    assert set(got) >= {expected(r["doc_id"], r["text"]) for r in short} and len(got) == documents(spark, corpus).count()


def test_runs_keep_columns(spark):
    df = spark.createDataFrame([(None, "a " * 30, 1), (2, None, 2)], "doc_id int, text string, runs int")
    got = periodic_runs.find_runs(df, keep=tuple(df.columns)).collect()
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [(None, [(0, 30, 1)], "a"), (2, [], "")]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, copies=2)
