import random

import pytest

WORDS = "the of and stone river light carry under paper green window seven maple north quiet engine letter".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "ly", "er", "ing")) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Small tables with nulls, empty, long and repeated rows, and clashing extra columns."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    base = prose(1, 300)
    near = base.split()
    near[100] = "changed"
    item = "What does the seventh engine carry under the quiet river. It carries green paper letters north."
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: prose(2, 80), 5: None, 6: "", 7: " \n ", 8: "one two", 9: "One  two",
        10: prose(3, 20_000), 11: f"{prose(4, 150)} {item} {prose(5, 150)}", 12: f"{prose(6, 60)} idiot fool scum {prose(7, 30)}",
        13: 'token = "a3a1b97e25e5c1059743005344d08a6b96b1869b" mail a.b@c.example 4111 1111 1111 1111 +1 (886) 555-9674 10.0.0.1 999.1.1.1',
        14: "Licensed under the MIT License. " + prose(8, 60), 15: "#### $$$ " * 60, 16: "same line here\n" * 30, 17: "123 456",
    }
    rows = [(i, text, "en" if i % 2 else None, "src0", -1, None) for i, text in texts.items()]
    rows += [(1, base, "en", "src0", -1, None), (None, base, "en", None, -1, None), (None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i == 12)) for i in texts if i != 5] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://a", "x" * 1200), (2, "http://b c\n", "x" * 1200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", "x" * 1200), (2, "again", "x" * 1200), (6, "é", "é" * 800)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, corpus, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return {(r["doc_id"], r["text"]): r["text"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
