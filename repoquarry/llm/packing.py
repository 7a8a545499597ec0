"""Packing by power-of-two decomposition: every document is cut into pieces of binary length.

A document of `n` tokens becomes `n // limit` pieces of `limit` tokens and one piece for each
set bit of the rest, longest first.  Each piece is a sequence of its own, so no sequence crosses
documents and, every length being a power of two, none is padded.  Sequences of equal length form
a bucket; `batch` numbers groups of equal-length sequences that make up one training batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import pieces, prepare, worker_cache

LIMIT = 2048
CACHE_WORDS = 700_000
NAMES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "batch")


class _Table(dict):
    """Entry number of each string; a new string gets the next one and is noted."""

    def __init__(self, owner: _Encoder):
        super().__init__()
        self.owner, self.new, self.numbers = owner, [], []

    def __missing__(self, word: str) -> int:
        self[word] = number = self.owner.entries
        self.owner.entries += 1
        self.new.append(word)
        self.numbers.append(number)
        return number

    def taken(self) -> tuple[list[str], list[int]]:
        """The strings noted since the last call, and their entry numbers."""
        new, numbers = self.new, self.numbers
        self.new, self.numbers = [], []
        return new, numbers


class _Encoder:
    """Token ids of many texts, encoding every distinct word once.

    The byte-level pre-tokenizer never joins characters across a space that stands between two non-space
    characters, nor across a letter and the punctuation after it.  A text is therefore the concatenation of its
    words, each but the first led by its space, and a word of letters and what follows them.  Words seen before
    come from a table; the parts that are new are encoded by the tokenizer in one call.  The tokenizer stays as loaded:
    a text that contains one of its added tokens, which it takes out before it cuts words, goes to it as a whole.
    """

    _letters = re.compile(r"[^\W\d_]+(?=[.,;:!?)\]\"])")
    _gap = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values() if token.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # by id: the token starts with a space
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.clear()

    def clear(self) -> None:
        self.entries = self.used = 0
        self.spaced, self.plain = _Table(self), _Table(self)  # words after a space; any other part of a text
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)  # count -1: white space together
        self.flat = np.zeros(1 << 18, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Fill in the entries of all new strings, a kind at a time."""
        spaced, numbers = self.spaced.taken()
        simple, simple_at, heads, tails, joined_at, direct, direct_at, wide = [], [], [], [], [], [], [], []
        for word, number in zip(spaced, numbers):
            if word.isalpha():
                simple.append(word)
                simple_at.append(number)
            elif not word or word[0].isspace() or word[-1].isspace():
                wide.append(number)
            elif found := self._letters.match(word):
                end = found.end()
                heads.append(self.spaced[word[:end]])
                tails.append(self.plain[word[end:]])
                joined_at.append(number)
            else:
                direct.append(" " + word)
                direct_at.append(number)
        more, more_at = self.spaced.taken()  # heads that were new as well
        simple += more
        simple_at += more_at
        plain, plain_at = self.plain.taken()
        self._room()
        self.count[wide] = -1
        if simple:  # one call for all: each begins with the only token that starts with a space
            ids = self._encode([" " + " ".join(simple)])[0]
            self._store(simple_at, ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        parts = self._encode(direct + plain)
        if parts:
            self._store(direct_at + plain_at, np.concatenate(parts), [len(ids) for ids in parts])
        if joined_at:
            both = np.array([heads, tails], np.int64).T.ravel()
            self._store(joined_at, self._ids(both), self.count[heads] + self.count[tails])

    def _room(self) -> None:
        if self.entries > len(self.begin):
            self.begin, self.count = (np.resize(x, max(self.entries, 2 * len(x))) for x in (self.begin, self.count))

    def _store(self, numbers: list[int], ids: np.ndarray, counts) -> None:
        """The ids of entries `numbers`, `counts` each, in a row."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.begin[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of entries, in a row."""
        counts = self.count[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        return self.flat[np.repeat(self.begin[numbers] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, text in enumerate(texts) if self.added.search(text)]
        if not whole:
            return self._from_words(texts)
        held = set(whole)
        out = self._from_words(["" if k in held else text for k, text in enumerate(texts)])
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def _from_words(self, texts: list[str]) -> list[np.ndarray]:
        if self.entries > CACHE_WORDS:
            self.clear()
        entries = []
        for text in texts:
            first, *rest = text.split(" ")
            at = np.empty(len(rest) + 1, np.int64)
            at[0] = self.plain[first]
            at[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.int64, len(rest))
            entries.append(at)
        self._learn()
        wide = [k for k, at in enumerate(entries) if (self.count[at] < 0).any() or texts[k][:1] == " "]
        for k in wide:  # white space side by side: cut only before single spaces
            cuts = [m.start() for m in self._gap.finditer(texts[k])]
            words = [texts[k][a:b] for a, b in zip([0, *cuts], [*cuts, len(texts[k])], strict=True)]
            clear = [i > 0 and not word[-1].isspace() for i, word in enumerate(words)]
            entries[k] = np.array([self.spaced[w[1:]] if c else self.plain[w] for w, c in zip(words, clear, strict=True)], np.int64)
        self._learn()
        return [self._ids(at) for at in entries]


def _encoder(path: str) -> _Encoder:
    """The worker's encoder for a tokenizer file; its table outlives tasks."""
    held = worker_cache()
    if ("encoder", path) not in held:
        held["encoder", path] = _Encoder(path)
    return held["encoder", path]


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """`n` as a sum of `limit`s and descending distinct powers of two below it."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    end_id: int = 1,
    limit: int = LIMIT,
    batch_tokens: int = 1 << 17,
    checksums: bool = False,
) -> DataFrame:
    """One row per piece: the other columns of `df` with `ids`, `start`, `length`, `sequence_id`, `offset`, `batch`.

    `tokenizer` is the path of a tokenizer file, `limit` a power of two.  A document's ids are those of its
    whole text and `end_id`; null text counts as empty, so every row has at least one piece.  `start` counts the
    document's ids before the piece, `doc_tokens` all of them.  `sequence_id` is unique; it and `batch`
    (up to `batch_tokens` ids in sequences of one length) are numbered within each input partition, so nothing is
    shuffled or counted beforehand and a task that runs again yields the same numbers.  With `checksums` the ids are
    replaced by `ids_crc32`, the unsigned CRC-32 of their little-endian unsigned 32-bit form.  Columns of `df` named like
    an output are dropped; repeated rows are packed each.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")
    prepare(df.sparkSession)
    made = ["ids_crc32" if checksums and name == "ids" else name for name in NAMES]
    schema = ", ".join(f"{name} {'array<int>' if name == 'ids' else 'bigint'}" for name in made)
    kept = [name for name in df.columns if name not in made and name != text]
    source = df.select(*kept, F.col(text).alias("__text"))
    types = ", ".join(f"`{name}` {source.schema[name].dataType.simpleString()}" for name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base = _encoder(tokenizer), TaskContext.get().partitionId() << 40
        seen, filled, open_batch, batches_made = 0, {}, {}, 0
        for batch in batches:
            texts = [text or "" for text in batch.column(len(kept)).to_pylist()]
            for low, high in pieces(texts):
                rows, start, length, ids, tokens, number = [], [], [], [], [], []
                for row, found in enumerate(encode(texts[low:high]), low):
                    found = np.append(found, np.int32(end_id))
                    at = 0
                    for size in binary_lengths(len(found), limit):
                        room = filled.get(size, 0)
                        if not room:
                            open_batch[size], batches_made = base + batches_made, batches_made + 1
                            room = max(1, batch_tokens // size)
                        filled[size] = room - 1
                        rows.append(row)
                        start.append(at)
                        length.append(size)
                        ids.append(found[at : at + size])
                        tokens.append(len(found))
                        number.append(open_batch[size])
                        at += size
                n = len(rows)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                carried = pa.RecordBatch.from_arrays(batch.columns[:-1], names=kept).take(pa.array(rows, pa.int64())) if kept else None
                columns = [carried.column(i) for i in range(len(kept))]
                columns += [pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                if checksums:
                    columns += [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                else:
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                columns += [pa.array(tokens, pa.int64()), pa.array(base + np.arange(seen, seen + n), pa.int64())]
                columns += [pa.array(np.zeros(n, np.int64)), pa.array(number, pa.int64())]
                seen += n
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return source.mapInArrow(run, f"{types}, {schema}" if kept else schema)
