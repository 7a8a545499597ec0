"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds, for each term of the items, its postings in item order with BM25 impacts, divided by the score that
the item gives itself; a passage's score for an item is thus the share of the item's weight it covers.  The items are
cut into blocks, and each term keeps its largest impact in each block.

All items above the threshold are retrieved by block-max WAND, for all passages of a batch at once: for each passage,
blocks whose block maxima add up to less than the threshold are skipped; the postings of the others are scored exactly.
No passage, item or posting is dropped otherwise.  Passages are cut to the item's own length class (powers of two), so
what they hold depends on no other item and no shard; of the other items only the idf in a score does.  Retrieved items are verified on the words themselves: the passage
must repeat the item's question and its answer.  Items of fewer than `MIN_WORDS` words are found by all their words in a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare

K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
SHARD_WORDS = 200_000
CELLS = 2_000_000  # passages x items scored at a time
THRESHOLD = 0.6
OVERLAP = 0.5
MIN_WORDS = 5  # an item of fewer is found by an exact run of all its words
NGRAM = 3
# scripts without spaces (Thai to Tibetan, Burmese, Khmer, New Tai Lue, Tai Tham, kana, Han): every character is a word
_ALONE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[^\W_{_ALONE}]+|[^\W_]")
_ASCII_WORDS = re.compile(r"[a-z0-9]+")  # the same words, where the text is ASCII only
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！｡])\s*|\n+")
HITS = "array<struct<item_id:bigint,passages:bigint,first_word:bigint,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, one by one in scripts without spaces."""
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: its last sentence is the answer, or its last quarter if there is one sentence."""
    sentences = [s for s in map(words_of, _SENTENCE.split(text or "")) if s]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def _ngrams(words: list[str]) -> list[tuple[str, ...]]:
    n = min(NGRAM, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def overlap(wanted: list[str], passage: list[str]) -> float:
    """Share of the 3-word runs of `wanted` (or the whole, if shorter) that stand in the passage; 1 if there are none."""
    runs = _ngrams(wanted)
    if not runs:
        return 1.0
    n = len(runs[0])
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return sum(run in there for run in runs) / len(runs)


@dataclass(frozen=True)
class Group:
    """The items of one length class of a shard: those of more than half of `stride` words, up to `stride`."""

    stride: int
    items: np.ndarray  # by number within the group: number within the shard
    begin: np.ndarray  # postings of term t: begin[t] to begin[t + 1]
    item: np.ndarray
    impact: np.ndarray
    block_begin: np.ndarray  # blocks that hold term t: block_begin[t] to block_begin[t + 1]
    block: np.ndarray
    block_max: np.ndarray  # the term's largest impact in that block


@dataclass(frozen=True)
class Index:
    """One shard of items."""

    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    groups: list[Group]
    short: list[tuple[np.ndarray, dict[int, list[int]]]]  # by number of words: sorted keys of the runs, items that end at a key


def _run_keys(short: list[tuple[int, list[int]]], terms: int) -> list[tuple[np.ndarray, dict[int, list[int]]]]:
    """A trie of the term runs (item, terms), level by level; a key is the number of the run before, and the next term."""
    levels, at = [], [0] * len(short)
    for k in range(max((len(run) for _, run in short), default=0)):
        key = {i: at[i] * terms + run[k] for i, (_, run) in enumerate(short) if len(run) > k}
        keys = np.unique(np.fromiter(key.values(), np.int64, len(key)))
        ending: dict[int, list[int]] = {}
        for i, value in key.items():
            at[i] = int(np.searchsorted(keys, value))
            if len(short[i][1]) == k + 1:
                ending.setdefault(at[i], []).append(short[i][0])
        levels.append((keys, ending))
    return levels


def build_index(items: list[tuple[int, str]], total: int, frequency: dict[str, int], average: float) -> Index:
    """Index of `items`; item count, document frequencies and average length are those of all shards."""
    terms: dict[str, int] = {}
    parts = [question_and_answer(text) for _, text in items]
    impacts: list[list[tuple[int, float]]] = []
    classes: dict[int, list[int]] = {}
    short: list[tuple[int, list[int]]] = []
    for number, (question, answer) in enumerate(parts):
        words = question + answer
        if len(words) < MIN_WORDS:
            short.append((number, [terms.setdefault(w, len(terms)) for w in words]))
            impacts.append([])
            continue
        classes.setdefault(1 << (len(words) - 1).bit_length(), []).append(number)
        counts = Counter(words)
        norm = K1 * (1 - B + B * len(words) / average)
        raw = {}
        for w, n in counts.items():
            idf = np.log1p((total - frequency[w] + 0.5) / (frequency[w] + 0.5))
            raw[terms.setdefault(w, len(terms))] = idf * n * (K1 + 1) / (n + norm)
        own = sum(raw.values())
        impacts.append([(t, value / own) for t, value in raw.items()])
    groups = []
    for stride, members in sorted(classes.items()):
        postings = sorted((t, k, value) for k, number in enumerate(members) for t, value in impacts[number])
        term, item = (np.array([x[i] for x in postings], np.int64) for i in (0, 1))
        impact = np.array([x[2] for x in postings])
        starts = np.flatnonzero(np.diff(term * len(members) + item // BLOCK_ITEMS, prepend=-1))  # a run of postings each
        block_max = np.maximum.reduceat(impact, starts) * 1.000001  # the bound must not round below a sum of impacts
        begin, block_begin = (np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))]).astype(np.int64) for t in (term, term[starts]))
        groups.append(Group(stride, np.array(members, np.int64), begin, item, impact, block_begin, item[starts] // BLOCK_ITEMS, block_max))
    return Index([i for i, _ in items], parts, terms, groups, _run_keys(short, len(terms)))


def build_shards(items: DataFrame, key: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> list[Index]:
    """Indexes of all items with a word, in shards of about `shard_words` words.

    A shard is what the driver and each task hold at a time; a larger set of items makes more shards.  Of rows that
    repeat an id with another text, each is an item.  A text without an id is an item with a negative number made from
    the text (far below other ids), unless an item with an id has the same text.
    """
    every = items.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    named, unnamed = every.where("id IS NOT NULL"), every.where("id IS NULL")
    own = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) - F.lit((1 << 63) - 1) - 1
    rows = named.unionByName(unnamed.join(named.select("text"), "text", "left_anti").select(own.alias("id"), "text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]|[\p{L}\p{N}]+"))
    sizes = rows.withColumn("n", words)
    total_words = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total_words // shard_words))
    sharded = [
        [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).orderBy("id", "text").collect()]
        for k in range(shards)
    ]
    sharded = [[(i, x) for i, x in shard if words_of(x)] for shard in sharded]
    frequency: Counter[str] = Counter()
    total = length = 0
    for shard in sharded:
        for _, x in shard:
            found = words_of(x)
            frequency.update(set(found))
            total, length = total + 1, length + len(found)
    return [build_index(shard, total, frequency, length / total) for shard in sharded if shard]


def _retrieve(index: Index, lists: list[list[str]], threshold: float) -> Iterator[tuple[int, int, int, int, float, int]]:
    """(text, first word, last word, item, score, passages) of all passages and items at or above the threshold.

    A passage of a longer item is a row of its own; the runs of a short item in a text are one row, with the first run.
    """
    sizes = np.array([len(words) for words in lists], np.int64)
    ids = np.fromiter(map(index.terms.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known = np.flatnonzero(ids >= 0)
    order = known[np.argsort(ids[known], kind="stable")]
    before = np.full(len(ids), -1, np.int64)  # the place before where the same word stands, in any text
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    for group in index.groups:
        yield from _retrieve_group(group, ids, before, sizes, starts, threshold)
    yield from _retrieve_short(index, ids, starts)


def _retrieve_short(index: Index, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, float, int]]:
    at, node = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for k, (keys, ending) in enumerate(index.short):
        inside = at + k < starts[np.searchsorted(starts, at, "right")]  # the run stays in its text
        at, node = at[inside], node[inside]
        term = ids[at + k]
        key = node * len(index.terms) + term
        node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = (term >= 0) & (keys[node] == key)
        at, node = at[there], node[there]
        ends = np.isin(node, list(ending))
        text = np.searchsorted(starts, at[ends], "right") - 1
        runs, first, count = np.unique(np.stack([text, node[ends]], 1), axis=0, return_index=True, return_counts=True)
        for (t, end), low, n in zip(runs.tolist(), (at[ends][first] - starts[runs[:, 0]]).tolist(), count.tolist(), strict=True):
            for item in ending[end]:
                yield t, low, low + k + 1, item, 1.0, n


def _spread(begin: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its places from begin[t] to begin[t + 1], in a row: the number of the term in the list, and the place."""
    counts = begin[terms + 1] - begin[terms]
    owner = np.repeat(np.arange(len(terms)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - begin[terms], counts)


def _retrieve_group(
    group: Group, ids: np.ndarray, before: np.ndarray, sizes: np.ndarray, starts: np.ndarray, threshold: float
) -> Iterator[tuple[int, int, int, int, float, int]]:
    stride, n_items, n_blocks = group.stride, len(group.items), -(-len(group.items) // BLOCK_ITEMS)
    # passages: two strides long, one stride apart, so that each run of an item's length lies in one of them
    count = np.maximum(1, -(-sizes // stride) - 1)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(sizes)), count)
    low = starts[text] + (np.arange(len(text)) - first[text]) * stride
    high = np.minimum(low + 2 * stride, starts[text + 1])
    # the query of a passage: its words that some item of the group has, each where it first stands in the passage
    there = group.begin[1:] > group.begin[:-1]
    at = np.flatnonzero(np.append(there, False)[ids])
    owner = np.searchsorted(starts, at, "right") - 1
    queries = []
    for back in (0, 1):
        number = (at - starts[owner]) // stride - back
        inside = (number >= 0) & (number < count[owner])
        passage = first[owner[inside]] + number[inside]
        new = before[at[inside]] < low[passage]
        queries.append((passage[new], ids[at[inside][new]]))
    step = max(1, CELLS // max(n_items, 1))
    for start in range(0, len(text), step):
        cuts = [np.searchsorted(passage, [start, start + step]) for passage, _ in queries]
        passage = np.concatenate([p[a:b] for (p, _), (a, b) in zip(queries, cuts, strict=True)]) - start
        terms = np.concatenate([t[a:b] for (_, t), (a, b) in zip(queries, cuts, strict=True)])
        rows = min(step, len(text) - start)
        # blocks whose maxima add up to the threshold; only their postings are scored
        query, place = _spread(group.block_begin, terms)
        bound = np.bincount(passage[query] * n_blocks + group.block[place], group.block_max[place], rows * n_blocks)
        alive = bound >= threshold
        some = alive.reshape(rows, n_blocks).any(1)[passage]
        passage, terms = passage[some], terms[some]
        query, place = _spread(group.begin, terms)
        held = alive[passage[query] * n_blocks + group.item[place] // BLOCK_ITEMS]
        query, place = query[held], place[held]
        scores = np.bincount(passage[query] * n_items + group.item[place], group.impact[place], rows * n_items)
        for cell in np.flatnonzero(scores >= threshold).tolist():
            p, item = start + cell // n_items, cell % n_items
            t = int(text[p])
            yield t, int(low[p] - starts[t]), int(high[p] - starts[t]), int(group.items[item]), float(scores[cell]), 1


def find_leaks(
    df: DataFrame, shards: list[Index], text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP, out: str = "hits"
) -> DataFrame:
    """All columns of `df` and `out`: the verified items of each whole text, an empty array where there are none.

    A hit is an item that a passage covers to `threshold` of its BM25 weight and whose question and answer the passage
    repeats to `least` of their 3-word runs each.  `passages` counts such passages, the other fields are those of the
    best one (earliest on ties).  An item of fewer than `MIN_WORDS` words is hit wherever all its words stand in a row.  Hits are in item order.  A column named like `out` is replaced.
    """
    prepare(df.sparkSession)
    # plain values, so that executors need no copy of this package to read them
    plain = [(x.ids, x.parts, x.terms, [tuple(vars(g).values()) for g in x.groups], x.short) for x in shards]
    shared = df.sparkSession.sparkContext.broadcast(plain)
    source = df.drop(out)
    at, names = source.columns.index(text), [*source.columns, out]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("passages", pa.int64()), ("first_word", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
        indexes = [Index(ids, parts, terms, [Group(*g) for g in groups], short) for ids, parts, terms, groups, short in shared.value]
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found: list[dict] = [{} for _ in texts]
            for start, stop in pieces(texts):
                lists = [words_of(x) for x in texts[start:stop]]
                for index in indexes:
                    for row, low, high, item, score, n in _retrieve(index, lists, threshold):
                        passage = lists[row][low:high]
                        question, answer = (overlap(part, passage) for part in index.parts[item])
                        if min(question, answer) < least:
                            continue
                        best = found[start + row].get(index.ids[item])
                        now = {"item_id": index.ids[item], "passages": n, "first_word": low, "score": score, "question": question, "answer": answer}
                        if best:
                            better = now if score > best["score"] else best
                            now = better | {"passages": best["passages"] + n}
                        found[start + row][index.ids[item]] = now
            hits = pa.array([[h[i] for i in sorted(h)] for h in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=names)

    return source.mapInArrow(run, f"{types}, `{out}` {HITS}")
