"""Token counts through a cache of digests.

The cache is a stored table (digest of a normalised text, number of tokens), one folder for each version of a
tokenizer: the digest of its file with the library's name and version.  Counting reads every text once to make digests, joins
them to the cache, sends each distinct text that is missing to the tokenizer once, and appends what it got.

Texts that a tokenizer can't tell apart share a digest.  Where it drops white space and folds case before it cuts
words, runs of white space become one space, and texts of ASCII letters only are lower-cased, unless one of the tokenizer's
added tokens may stand in them.  Otherwise a text is its own normal form.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from importlib.metadata import version as library_version
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare, utf8, worker_cache
from repoquarry.plans.storage import settle

CACHE_SCHEMA = "digest binary, n_tokens bigint"
OUTPUTS = ("n_bytes", "n_tokens", "digest")
CACHE_WORDS = 500_000
LONG_WORD = 64
HOT_SHARE = 1000  # a digest of more than a 1000th of the rows is hot: there are fewer than 1000 of them
FEW = 20_000  # missing digests up to this number are broadcast, 32 bytes each


def tokenizer_version(path: str) -> str:
    """Name of a tokenizer's folder in the cache: another file or library never sees its counts."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    held = hashlib.sha256(f"{library} {library_version(library)}\n".encode())
    held.update(Path(path).read_bytes())
    return held.hexdigest()


def _folds(path: str) -> list[str] | None:
    """The added tokens of a tokenizer that folds case and drops all white space, one token at most between two of it; else None."""
    if path.endswith(".model"):
        return None
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = (held.get("normalizer") or {}).get("normalizers") or [held.get("normalizer") or {}]
    cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [held.get("pre_tokenizer") or {}]
    added = [token["content"] for token in held.get("added_tokens") or []]
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in held.get("added_tokens") or [])
    spaces = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    known = {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"} and sum(s.get("type") == "Replace" for s in steps) == 1
    lower = any(s.get("type") == "Lowercase" for s in steps)
    removed = cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    if not (plain and spaces and known and lower and removed) or any(token.split() != [token] for token in added):
        return None
    count = _whole(path)
    # the cutting pattern must not match white space, alone or beside other characters
    probes = [" ", "\t\n\r\x0b\x0c", "a b", "a", "b", "! ?", "!", "?", "' s", "'", "s", "1 2", "1", "2"]
    n = dict(zip(probes, count(probes), strict=True))
    apart = all(n[f"{x} {y}"] == n[x] + n[y] for x, y in ("ab", "!?", "'s", "12"))
    return added if apart and n[" "] == n["\t\n\r\x0b\x0c"] == 0 else None


def _whole(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of whole texts, as the tokenizer's library gives them."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(path: str, by_word: bool) -> Callable[[list[bytes]], list[int]]:
    """Numbers of tokens of UTF-8 texts; `by_word` where those of a text are the sum over its words.

    Words are what ASCII white space separates.  A word's number is kept as long as the Python worker lives.
    """
    held = worker_cache()
    if ("token counter", path) not in held:
        held["token counter", path] = _whole(path), {}
    whole, known = held["token counter", path]

    def by_words(texts: list[bytes]) -> list[int]:
        if len(known) > CACHE_WORDS:
            known.clear()
        lists = [text.split() for text in texts]
        new = list(set(chain.from_iterable(lists)).difference(known))
        known.update(zip(new, whole([word.decode("utf-8", "replace") for word in new]), strict=True))
        counts = [sum(map(known.__getitem__, words)) for words in lists]
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        return counts

    return by_words if by_word else lambda texts: whole([text.decode("utf-8", "replace") for text in texts])


def _digest(text: Column, added: list[str] | None) -> Column:
    if added is None:
        return F.unhex(F.sha2(text, 256))
    spaced = F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))
    ascii_only = F.octet_length(text) == F.char_length(text)
    for token in added:
        ascii_only = ascii_only & ~F.contains(F.lower(text), F.lit(token.lower()))
    return F.unhex(F.sha2(F.when(ascii_only, F.lower(spaced)).otherwise(spaced), 256))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a version of a tokenizer; none if nothing is."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(f"{cache}/{version}")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem.getCondition()):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    # two runs at once may both append a text they both missed, with equal counts
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_missing(texts: DataFrame, path: str, by_word: bool) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, by_word)
        for batch in batches:
            held, counts = utf8(batch.column(1)), []
            for low, high in pieces(held):
                counts += count(held[low:high])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE_SCHEMA)


def fill_cache(df: DataFrame, seen: DataFrame, tokenizer: str, cache: str, text: str, added: list[str] | None) -> int:
    """Append the counts of the digests in `seen` that the cache lacks, read from the texts of `df`; returns how many.

    The texts are dealt by digest, after each task has left one of its equal ones.  Where few digests are missing,
    their list is broadcast instead, so that only their texts move.
    """
    spark, version = df.sparkSession, tokenizer_version(tokenizer)
    missing = settle(seen.select("digest").join(read_cache(spark, cache, version), "digest", "left_anti"), "missing")
    count = missing.count()
    if not count:
        return 0
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(_digest(body, added).alias("digest"), body.alias("text"))
    if count <= FEW:
        rows = rows.join(F.broadcast(missing), "digest", "left_semi")
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    if count > FEW:
        distinct = distinct.join(missing, "digest", "left_semi")
    encode_missing(distinct, tokenizer, added is not None).write.mode("append").parquet(f"{cache}/{version}")
    return count


def count_tokens(df: DataFrame, tokenizer: str, cache: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row, `n_bytes` of its text in UTF-8, `n_tokens`, and the `digest` that leads to the count.

    `tokenizer` is the path of a `.json` file for tokenizers or a `.model` file for sentencepiece, the same on every machine.
    Counts are those of the library for the whole text without begin, end or other special tokens added; strings of added tokens
    inside a text are handled as the library does by default.  `cache` is a folder on shared storage, which this call reads and
    appends to.  A null text counts as empty; repeated rows and null keys each get a row.  Kept columns named like an output
    are left out.
    """
    spark, added = df.sparkSession, _folds(tokenizer)
    kept = [name for name in keep if name not in OUTPUTS]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*kept, F.octet_length(body).cast("bigint").alias("n_bytes"), _digest(body, added).alias("digest"))
    rows = settle(rows, "digests")
    seen = settle(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "seen")
    fill_cache(df, seen, tokenizer, cache, text, added)
    counts = read_cache(spark, cache, tokenizer_version(tokenizer))
    # a digest that many rows share is joined by broadcast, so that no task gets all of them
    total = rows.count()
    hot = seen.where(F.col("n") * HOT_SHARE > total).join(counts, "digest").select("digest", F.col("n_tokens").alias("__hot"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    columns = [*kept, "n_bytes", "n_tokens", "digest"]
    done = marked.where("__hot IS NOT NULL").withColumn("n_tokens", F.col("__hot"))
    rest = marked.where("__hot IS NULL").join(counts, "digest")
    return done.select(*columns).unionByName(rest.select(*columns))
