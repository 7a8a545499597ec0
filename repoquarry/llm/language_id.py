"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order, kept as the counts of all (order + 1)-grams of its training
texts.  A text's code length under a language is the sum over its bytes of -log2 P(byte | context): the longest
context seen in training predicts the byte or escapes (method C: the escape has as many counts as the context has
distinct followers) to the next shorter one, where the bytes the longer context knew are excluded; below order 0
all 256 byte values not yet excluded are equally likely.  The statistics are frozen: scoring never updates them.
The language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare

ORDER = 3
UNDETERMINED = "und"
_GAPS = re.compile(r"[\W\d_]+")


def normalized(text: str | None) -> bytes:
    """Lower-cased letters with single spaces between the runs, in UTF-8; empty if there is no letter."""
    kept = _GAPS.sub(" ", text.lower()).strip() if text else ""
    if kept and not kept.replace(" ", "").isalpha():  # signs such as ½, ² or Ⅷ are word characters, but no letters
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    return kept.encode("utf-8", "replace")


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram ending at each byte, as a number, and the number of bytes of each text.

    Every text is led by `order` spaces, so the first bytes have a full context too.
    """
    pad = b" " * order
    data = np.frombuffer(b"".join(pad + text for text in texts), np.uint8).astype(np.uint64)
    lengths = np.array([len(text) for text in texts], np.int64)
    codes = np.zeros(max(len(data) - order, 0), np.uint64)
    for k in range(order + 1):
        codes = (codes << np.uint64(8)) | data[k : len(data) - order + k]
    if len(texts) > 1:  # windows that begin in one text and end in the next
        ends = np.cumsum(lengths + order)[:-1]
        wrong = (ends[:, None] + np.arange(-order, 0)[None, :]).ravel()
        keep = np.ones(len(codes), bool)
        keep[wrong[wrong < len(codes)]] = False
        codes = codes[keep]
    return codes, lengths


class ContextTree:
    """Frozen statistics of one language: for each order the gram counts and the totals of its contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.grams, self.contexts = order, [], []
        for k in range(order + 1):  # grams of k context bytes and the byte itself
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            values, inverse = np.unique(codes & mask, return_inverse=True)
            n = np.bincount(inverse, counts, len(values))
            self.grams.append((values, n))
            heads, at = np.unique(values >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, n, len(heads))
            distinct = np.bincount(at, minlength=len(heads)).astype(float)
            excluded = np.zeros(len(heads))
            if k:
                shorter, shorter_n = self.grams[k - 1]
                found = np.searchsorted(shorter, values & np.uint64((1 << 8 * k) - 1))
                excluded = np.bincount(at, shorter_n[found], len(heads))
            self.contexts.append((heads, total, distinct, excluded))

    @staticmethod
    def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 P(last byte | bytes before it) of each gram."""
        cost, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        less_n, less_q = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            values, n = self.grams[k]
            heads, total, distinct, excluded = self.contexts[k]
            gram = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = self._look(heads, gram >> np.uint64(8))
            left_n, left_q = total[at] - less_n, distinct[at] - less_q
            active = open_ & known & (left_q > 0)  # nothing left to predict: an escape that costs nothing
            here, hit = self._look(values, gram)
            hit &= active
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(hit, cost - np.log2(n[here] / (left_n + left_q)), cost)
                open_ &= ~hit
                cost = np.where(active & open_, cost - np.log2(left_q / (left_n + left_q)), cost)
            seen = open_ & known
            less_n, less_q = np.where(seen, excluded[at], less_n), np.where(seen, distinct[at], less_q)
        return cost + np.where(open_, np.log2(np.maximum(256 - less_q, 1)), 0)


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows with a language and a letter, counted per task before the shuffle."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, rows in _by_language(batch):
                codes, n = np.unique(grams([normalized(x) for x in rows], order)[0], return_counts=True)
                held.setdefault(name, []).append((codes, n))
                if sum(len(c) for c, _ in held[name]) > 2_000_000:
                    held[name] = [_merged(held[name])]
                    if len(held[name][0][0]) > 1_000_000:
                        yield _counted(name, *held.pop(name)[0])
        for name, parts in held.items():
            yield _counted(name, *_merged(parts))

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    by: dict[str, list] = {}
    for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by.setdefault(name, []).append(value)
    yield from by.items()


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _counted(name: str, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
    )


def fit(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> dict[str, ContextTree]:
    """Context trees of all languages of `df`, from every row with a language and a letter.

    The trees hold all counts of all rows, so every language has one and its code lengths do not depend on the others.
    The model passes through the driver; it grows with the distinct grams of the languages, not with their texts.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be between 0 and 6")
    counts = gram_counts(df, text, lang, order).toArrow().combine_chunks()
    if not counts.num_rows:
        return {}
    names = counts.column("lang").chunk(0).dictionary_encode()
    number, known = names.indices.to_numpy(), names.dictionary.to_pylist()
    codes, n = counts.column("gram").to_numpy().astype(np.uint64), counts.column("n").to_numpy()
    model = {}
    for name in sorted(known):
        own = number == known.index(name)
        model[name] = ContextTree(codes[own], n[own].astype(float), order)
    return model


def identify(df: DataFrame, model: dict[str, ContextTree], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with `lang_pred`, `score` and `bits` (code length per byte of the winner).

    `score` is the winner's posterior probability under equal priors, in [0, 1].  Text that is null or has no
    letter, and any text where the model is empty, gives `und` and 0.  Ties go to the first name.
    """
    prepare(df.sparkSession)
    names = sorted(model)
    order = model[names[0]].order if names else ORDER
    shared = df.sparkSession.sparkContext.broadcast([vars(model[name]) for name in names])  # plain values: executors need no copy of this package
    source = df.select(*keep, F.col(text).alias("__text"))
    types = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ContextTree.__new__(ContextTree) for _ in names]
        for tree, values in zip(trees, shared.value, strict=True):
            vars(tree).update(values)
        for batch in batches:
            texts = [normalized(x) for x in batch.column(len(keep)).to_pylist()]
            best, score, bits = [], [], []
            for low, high in pieces(texts):
                part = texts[low:high]
                codes, lengths = grams(part, order)
                distinct, inverse = np.unique(codes, return_inverse=True)
                row = np.repeat(np.arange(len(part)), lengths)
                cost = np.array([np.bincount(row, tree.bits(distinct)[inverse], len(part)) for tree in trees])
                for i, n in enumerate(lengths):
                    if not n or not len(trees):
                        best, score, bits = [*best, UNDETERMINED], [*score, 0.0], [*bits, 0.0]
                        continue
                    k = int(cost[:, i].argmin())
                    best.append(names[k])
                    score.append(float(1 / np.exp2(np.maximum(cost[k, i] - cost[:, i], -1000)).sum()))
                    bits.append(float(cost[k, i] / n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                names=[*keep, "lang_pred", "score", "bits"],
            )

    return source.mapInArrow(run, f"{types}lang_pred string, score double, bits double")
