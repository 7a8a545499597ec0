"""Cases that went wrong before: letters, plans of the archive reader, crowded bands, and executors without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest

from repoquarry.llm import decontamination, language_id, minhash, warc_zip


@pytest.mark.parametrize("text", ["½ ²", "①", "Ⅷ 12", "12 ½", "…", "", None, "́"])
def test_no_letter_is_undetermined(text):
    assert language_id.normalized(text) == b""


def test_letters_beside_signs_stay():
    assert language_id.normalized("A½b Ⅷ ça²") == "a b ça".encode()


def test_index_entries_join_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"body {i} " * 50) for i in range(40)], "page_id int, url string, html string")
    written = warc_zip.write_archives(warc_zip.with_revisits(pages.repartition(3)), str(tmp_path / "out"), archive_bytes=2000)
    entries = warc_zip.index_entries(warc_zip.members(written))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    read = warc_zip.read_records(entries, tasks=5)
    assert read.rdd.getNumPartitions() == 5
    assert sorted(bytes(r["payload"]).decode() for r in read.collect()) == sorted(f"body {i} " * 50 for i in range(40))


def test_what_a_crowded_band_leaves_over_is_compared(spark):
    """Pairs that are alike, but far from both leaders of the only band they share, are linked."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[100 * k : 100 * k + 90]) for k in range(12)]
    near = texts[8].split()
    near[45] = "other"
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(near)])), "doc_id bigint, text string")
    signed = minhash.sign(df, "doc_id", "text", 3).cache()
    crowded = spark.createDataFrame([(r["id"], r["signature"], [7]) for r in signed.collect()], "id bigint, signature binary, bands array<bigint>")
    for block in (minhash.BAND_BLOCK, 3, 1):
        assert {tuple(sorted(r)) for r in minhash._candidates(crowded, minhash.FAR, block).collect()} == {(8, 12)}


def test_leaks_equal_exact_scores_of_all_pairs():
    """Retrieval against the sum of impacts of every passage and item, without index, blocks or batches."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 40)))) for i in range(70)]
    frequency, total = {}, len(items)
    for _, text in items:
        for w in set(decontamination.words_of(text)):
            frequency[w] = frequency.get(w, 0) + 1
    average = sum(len(decontamination.words_of(t)) for _, t in items) / total
    index = decontamination.build_index(items, total, frequency, average)
    lists = [list(rng.choice([*vocabulary, "none", "other"], n)) for n in (0, 1, 7, 60, 200)] + [decontamination.words_of(items[3][1]) * 2]
    want = set()
    for number, (_, text) in enumerate(items):
        words = decontamination.words_of(text)
        norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(words) / average)
        raw = {w: np.log1p((total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * words.count(w) * (decontamination.K1 + 1) / (words.count(w) + norm) for w in set(words)}
        stride = 1 << (len(words) - 1).bit_length()
        for t, passage in enumerate(lists):
            for k in range(max(1, -(-len(passage) // stride) - 1)):
                part = passage[k * stride : (k + 2) * stride]
                score = sum(v for w, v in raw.items() if w in part) / sum(raw.values())
                if score >= 0.6:
                    want.add((t, k * stride, k * stride + len(part), number, round(score, 9)))
    for cells in (2_000_000, 100):
        decontamination.CELLS, before = cells, decontamination.CELLS
        try:
            got = {(t, low, high, item, round(score, 9)) for t, low, high, item, score, _ in decontamination._retrieve(index, lists, 0.6)}
        finally:
            decontamination.CELLS = before
        assert got == want and len(want) > 20


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {work!r}).getOrCreate()
from repoquarry.llm import queries
for name in ("op7_toxicity", "op8_language_id", "op9_decontamination", "op13_periodic_runs"):
    print(name, len(queries.QUERIES[name](spark, {corpus!r}).collect()))
"""


def test_executors_need_no_copy_of_the_package(corpus, tmp_path):
    """Python workers started elsewhere, without the repository on their path, run the operators."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, work=str(tmp_path / "work"), corpus=corpus))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYTHONPATH": "/opt"}
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == ["op7_toxicity", "op8_language_id", "op9_decontamination", "op13_periodic_runs"]
