"""Runs: stretches of a text in which a passage of words repeats at once at least three times.

A run of period q is a stretch whose words q apart are equal, which no neighbour extends, and whose smallest period is q.
All of them are found, without comparing a text with itself at every distance:

* Periods up to `SHORT` are scanned directly: the words are compared with those q places on, for each such q.
* Longer ones by minimizers.  A scale covers the periods from `least` to `most`, about 1.5 times as large.  Every run of
  `most` words gets a hash; of each window of `2 * least - most + 1` hashes the minimum marks its place.  A run holds a
  whole window and, one period on, its copy, so a place in it is marked twice at that distance.  Between the two
  stands no other equal run of words, as that would give the run a smaller period.  Neighbouring marks with equal hashes
  at a distance of the scale are therefore enough to seed all runs; each seed is extended word by word to both sides.

A stretch of a smaller period is found at the multiples of its period too, with the same ends, and kept at the smallest.
Texts of one batch are put end to end with separators that equal nothing, longest first, so that a scale works on
the texts long enough for it at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare, utf8

SHORT = 15
LEAST_WORDS, LEAST_COPIES = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def scales(longest: int, short: int = SHORT, copies: int = LEAST_COPIES) -> list[tuple[int, int]]:
    """(least, most) period of each scale, up to the largest period a text of `longest` words can repeat."""
    found, least = [], short + 1
    while least * copies <= longest:
        most = max(least, least * 3 // 2 - 1)
        found.append((least, most))
        least = most + 1
    return found


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(31)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(values: np.ndarray, width: int, best: np.ufunc, worst: np.uint64) -> np.ndarray:
    """Smallest or largest value of each window: prefixes and suffixes of blocks of `width` meet in every window."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, worst, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = best.accumulate(padded, 1).ravel()
    behind = best.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    last = len(values) - width
    return best(behind[: last + 1], ahead[width - 1 : width + last])


def marked(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some window of `width`, ties all; sorted."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = _windows(values, width, np.minimum, np.uint64(2**64 - 1))
    # a place is marked if the largest of the minima of the windows it lies in is its own value
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_windows(np.concatenate([edge, least, edge]), width, np.maximum, np.uint64(0)) == values)


def _equal_ahead(a: np.ndarray, i: int, j: int) -> int:
    """How many values from `i` on equal those from `j` on; `i` < `j`."""
    done, step = 0, 64
    while j + done < len(a):
        size = min(step, len(a) - j - done)
        differ = a[i + done : i + done + size] != a[j + done : j + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, step * 2
    return done


def _scan(words: np.ndarray, period: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches of at least `least` words that repeat at the distance `period`."""
    differ = np.flatnonzero(words[period:] != words[:-period])
    differ = np.concatenate([[-1], differ, [len(words) - period]])
    long = np.flatnonzero(np.diff(differ) - 1 >= least - period)
    return [(int(differ[k]) + 1, int(differ[k + 1]) + period, period) for k in long]


def repeats(words: np.ndarray, longest: list[tuple[int, int]], least: int = LEAST_WORDS, copies: int = LEAST_COPIES, short: int = SHORT) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence of non-negative word numbers, and separators below zero, all distinct.

    A run has `least` words and `copies` periods at least; `copies` is 3 or more.  `longest` lists (words, end): the texts with more
    than `words` words end before `end`, by rising `words`; scales of longer periods leave the rest out.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        found[start, end] = min(found.get((start, end), period), period)

    for period in range(1, min(short, len(words) - 1) + 1):
        for run in _scan(words, period, max(least, copies * period)):
            keep(*run)
    power, hashes = 1, _mix(words.astype(np.uint64), np.full(len(words), 7, np.uint64))  # of `power` words each
    backwards = words[::-1]
    for low, high in scales(longest[-1][0] + 1 if longest else 0, short, copies):
        size = max((end for n, end in longest if n + 1 >= copies * low), default=0)
        hashes = hashes[:size]
        while 2 * power <= high:
            hashes, power = _mix(hashes[:-power], hashes[power:]), 2 * power
        count = max(0, size - high + 1)
        grams = _mix(hashes[:count], hashes[high - power :][:count])
        places = marked(grams, 2 * low - high + 1)
        order = places[np.argsort(grams[places], kind="stable")]
        distance = np.diff(order)
        seed = (grams[order[1:]] == grams[order[:-1]]) & (distance >= low) & (distance <= high)
        ends: dict[int, int] = {}
        for place, period in sorted(zip(order[:-1][seed].tolist(), distance[seed].tolist(), strict=True)):
            if place < ends.get(period, 0):
                continue  # inside the stretch just seen
            ahead = _equal_ahead(words, place, place + period)
            behind = _equal_ahead(backwards, len(words) - place - period, len(words) - place)
            ends[period] = place + ahead + 1
            if ahead + behind + period >= max(least, copies * period):
                keep(place - behind, place + ahead + period, period)
    return sorted((start, end, period) for (start, end), period in found.items())


def runs_of(texts: list[list[bytes]], least: int = LEAST_WORDS, copies: int = LEAST_COPIES, short: int = SHORT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, a list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    for words in texts:
        for word in words:
            numbers.setdefault(word, len(numbers))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    parts, begins, longest, at = [], [], {}, 0
    for number, k in enumerate(order):
        words = texts[k]
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - number], np.int64)]
        begins.append(at)
        at += len(words) + 1
        longest[len(words) - 1] = at
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    starts = np.array(begins)
    for start, end, period in repeats(np.concatenate(parts), sorted(longest.items()), least, copies, short):
        number = int(np.searchsorted(starts, start, "right")) - 1
        found[order[number]].append((start - begins[number], end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run repeats: all of it but its first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist())


def find_runs(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, copies: int = LEAST_COPIES
) -> DataFrame:
    """Columns `keep` of every row, its `runs` (start, length, period in words) by start and period, and `collapsed`.

    Words are separated by ASCII white space.  `collapsed` holds them joined by one space, each run cut to its first period.  A null
    or empty text has no runs and an empty `collapsed`; repeated rows and null keys each get a row.  Kept columns named like an
    output are left out.  A task holds about a megabyte of texts at a time, or one longer text.
    """
    if copies < 3:
        raise ValueError("runs of fewer than three copies are not covered by the scales")
    prepare(df.sparkSession)
    kept = [name for name in keep if name not in ("runs", "collapsed")]
    source = df.select(*kept, F.col(text).alias("__text"))
    types = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = utf8(batch.column(len(kept)))
            for low, high in pieces(texts):
                words = [value.split() for value in texts[low:high]]
                found = runs_of(words, least, copies)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                left = [collapsed(w, runs).decode() for w, runs in zip(words, found, strict=True)]
                columns = [column.slice(low, high - low) for column in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind), pa.array(left, pa.string())], names=[*kept, "runs", "collapsed"])

    return source.mapInArrow(run, f"{types}runs {RUNS}, collapsed string")
