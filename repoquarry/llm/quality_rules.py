"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one statistic of a text and votes good, bad or nothing.  No rule is trusted on its own: the
model has a class prior and, for each rule and class, the probability that a vote given is right; EM estimates
them from how the rules agree over all documents, without labels.  The posterior probability of good quality
replaces the usual "must pass every rule".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import prepare, utf8
from repoquarry.plans.storage import settle

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_digits", "n_distinct")
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"


@dataclass(frozen=True)
class Rule:
    """Votes good at or below `good`, bad at or above `bad` of `value / base`; abstains between and where base is 0."""

    name: str
    value: str
    base: str
    good: float
    bad: float
    reverse: bool = False  # high values are good: good at or above `good`, bad at or below `bad`


RULES = (
    Rule("length", "n_words", "one", 100, 50, reverse=True),
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.10, 0.50),
    Rule("repetition", "n_repeat_words", "n_words", 0.20, 0.50),
    Rule("upper_case", "n_upper", "n_letters", 0.10, 0.30),
    Rule("digits", "n_digits", "word_chars", 0.02, 0.15),
    Rule("letters", "n_letters", "word_chars", 0.85, 0.70, reverse=True),
    Rule("word_length_high", "word_chars", "n_words", 9, 12),
    Rule("word_length_low", "word_chars", "n_words", 3.5, 2.5, reverse=True),
    Rule("vocabulary", "n_distinct", "n_words", 0.25, 0.10, reverse=True),
)


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int((np.frombuffer(data, np.uint8) & 0xC0 != 0x80).sum())


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The statistics `COUNTS` and `EXTRA` of one text."""
    words = text.split()
    body = text.translate(None, SPACE)
    points = _points(body)
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    digits = len(body) - len(body.translate(None, DIGITS))
    signs = len(body) - len(body.translate(None, bytes(c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))))
    return (
        len(words), points, len(body) - len(body.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(body) - len(body.translate(None, UPPER)), points - digits - signs,
        digits, len(set(words)),
    )


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the statistics of every whole text; null counts as empty."""
    prepare(df.sparkSession)
    source = df.select(*keep, F.col(text).alias("__text"))
    types = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)
    made = (*COUNTS, *EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in utf8(batch.column(len(keep)))], np.int64).reshape(-1, len(made))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found.T)], names=[*keep, *made])

    return source.mapInArrow(run, types + ", ".join(f"{name} bigint" for name in made))


def votes(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add `pattern`: the votes of all rules as base-3 digits (0 abstains, 1 good, 2 bad), first rule lowest."""
    pattern = F.lit(0).cast("bigint")
    for j, rule in enumerate(rules):
        base = F.lit(1) if rule.base == "one" else F.col(rule.base)
        share = F.try_divide(F.col(rule.value).cast("double"), base)
        good, bad = (share >= rule.good, share <= rule.bad) if rule.reverse else (share <= rule.good, share >= rule.bad)
        pattern = pattern + F.when(bad, 2).when(good, 1).otherwise(0) * F.lit(3**j)
    return df.withColumn("pattern", pattern)


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over distinct vote vectors (0 abstains, 1 good, 2 bad) seen `n` times.

    Returns the posterior probability of good per vector, the accuracies (rules x (good, bad texts)) and the prior.
    A bad text breaks few rules, so a rule may miss most bad texts but is right on at least four of five good ones,
    and a bad vote is likelier on a bad text than on a good one; these bounds and the start (texts with a bad vote
    are probably bad) keep the classes from changing places.  Abstaining says nothing about the class.
    """
    good, bad = votes == 1, votes == 2
    posterior = np.where(bad.any(1), 0.1, 0.95)
    a1 = a0 = np.zeros(votes.shape[1])
    prior = 0.5
    for _ in range(rounds):
        w1, w0 = n * posterior, n * (1 - posterior)
        prior = float(np.clip((w1.sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        voted = good | bad
        a1 = np.clip(((w1[:, None] * good).sum(0) + 2) / ((w1[:, None] * voted).sum(0) + 2.1), 0.8, 0.9995)
        a0 = np.clip(((w0[:, None] * bad).sum(0) + 0.5) / ((w0[:, None] * voted).sum(0) + 2), 0.02, 0.99)
        a0 = np.maximum(a0, 2 * (1 - a1))
        logit = np.log(prior / (1 - prior)) + good @ np.log(a1 / (1 - np.minimum(a0, 0.99))) + bad @ np.log((1 - a1) / a0)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return posterior, np.stack([a1, a0], 1), prior


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns `keep`, the statistics, `pattern` and `quality`, the posterior probability of good quality.

    The statistics are written to shared storage once.  EM needs only how often each vote vector occurs, at most
    3 ** rules numbers whatever the corpus, and the posterior of a vector goes back to its documents by a join with
    that table.  An empty table gives an empty result; empty and null texts are judged as texts without words.
    """
    rows = settle(votes(statistics(df, text, keep), rules), "quality")
    seen = rows.groupBy("pattern").count().orderBy("pattern").toArrow()
    patterns, n = seen.column("pattern").to_numpy(), seen.column("count").to_numpy().astype(float)
    cast = patterns[:, None] // 3 ** np.arange(len(rules))[None, :] % 3
    posterior = estimate(cast, n)[0] if len(patterns) else np.zeros(0)
    known = df.sparkSession.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, posterior, strict=True)], "pattern bigint, quality double"
    )
    return rows.join(F.broadcast(known), "pattern", "left")
