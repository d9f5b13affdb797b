"""N-grams of token arrays in Arrow batches: occurrences of known ones, and keys of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens whose codes a task holds at a time.
TOKENS = 1 << 19
NONE = np.iinfo(np.int64).max


class Known:
    """Distinct 1- to 3-grams as codes of their words: a longer one is looked up by its beginning and its last word."""

    def __init__(self, terms: pa.Array) -> None:
        parts = pc.split_pattern(terms, " ")
        length = parts.value_lengths().to_numpy(zero_copy_only=False)
        flat = parts.flatten()
        self.words = flat.unique()
        codes = np.append(self.codes(flat), [0, 0])
        first = np.cumsum(length) - length
        begin = codes[first] * len(self.words) + codes[first + 1]
        self.pairs = np.append(np.unique(begin[length > 1]), NONE)
        whole = np.searchsorted(self.pairs, begin) * len(self.words) + codes[first + 2]
        self.triples = np.append(np.unique(whole[length > 2]), NONE)
        #: Positions of the terms by word, pair and triple.
        self.at = [np.full(n, -1) for n in (len(self.words), len(self.pairs), len(self.triples))]
        for n, place in enumerate((codes[first], np.searchsorted(self.pairs, begin), np.searchsorted(self.triples, whole)), 1):
            self.at[n - 1][place[length == n]] = np.flatnonzero(length == n)

    def codes(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words.cast(self.words.type), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _longer(self, begin: np.ndarray, last: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Codes of the grams that begin and end like this, -1 where there is none."""
        key = np.where((begin >= 0) & (last >= 0), begin * len(self.words) + last, -1)
        place = np.searchsorted(keys, key)
        return np.where(keys[place] == key, place, -1)

    def count(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and counts, in the order of rows and terms."""
        length = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tokens)), length)
        one = self.codes(tokens.flatten())
        two = self._longer(one[:-1], np.where(row[1:] == row[:-1], one[1:], -1), self.pairs)
        three = self._longer(two[:-1], np.where(row[2:] == row[:-2], one[2:], -1), self.triples)
        found = [np.append(at, -1)[codes] for at, codes in zip(self.at, (one, two, three), strict=True)]
        size = max(1, sum(int((at >= 0).sum()) for at in self.at))
        keys = np.concatenate([row[: len(f)][f >= 0] * size + f[f >= 0] for f in found])
        keys, counts = np.unique(keys, return_counts=True)
        return keys // size, keys % size, counts


def known_ngrams(tokens: Column, terms: Broadcast) -> Column:
    """The known n-grams of each row as (term, tf): the position in the shipped array of distinct terms, and its count.

    A term is one to three tokens joined by blanks; a null array has none.
    """

    @F.arrow_udf("array<struct<term:int,tf:int>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(terms.value)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            made, at = [], 0
            while at < len(batch):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                rows, found, counts = known.count(batch.slice(at, stop - at))
                offsets = np.searchsorted(rows, np.arange(stop - at + 1)).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(counts, pa.int32())], ["term", "tf"])
                made.append(pa.ListArray.from_arrays(pa.array(offsets), entries))
                at = stop
            kind = pa.list_(pa.struct([("term", pa.int32()), ("tf", pa.int32())]))
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    return counted(tokens)


#: Starts of n-grams that a task counts at a time, so that three word codes fit 63 bits; and odd factors of an n-gram's words, by half of its key.
STARTS, CODE_BITS = 1 << 20, 21
FACTORS = np.random.default_rng(20240521).integers(0, 1 << 63, size=(2, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_keys(words: pa.Array) -> np.ndarray:
    """128-bit XXH3 of each word, as two columns."""
    import xxhash

    digests = b"".join(xxhash.xxh3_128_digest(word) for word in words.cast(pa.binary()).to_pylist())
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def ngram_keys(rows: DataFrame, tokens: str, most: int = 3) -> DataFrame:
    """All 1- to ``most``-grams (3 at most) of a token array column: ``n``, their key ``k1``, ``k2`` and occurrences ``c``.

    A key may come in several rows, to be summed up. Keys have 128 bits, made
    from the words' XXH3: among two billion different n-grams any two share one
    with a probability of about 1e-20. A null array has none.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            row = np.repeat(np.arange(len(column)), pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))
            for low in range(0, len(flat), STARTS):
                part = flat.slice(low, STARTS + most - 1).dictionary_encode()
                codes, of = part.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[low : low + STARTS + most - 1]
                words = _word_keys(part.dictionary)
                begin = np.zeros(min(STARTS, len(codes)), np.int64)
                for n in range(1, most + 1):
                    begin = begin[: len(codes) - n + 1]
                    begin = begin << CODE_BITS | codes[n - 1 : n - 1 + len(begin)]
                    found, counts = np.unique(begin[of[: len(begin)] == of[n - 1 : n - 1 + len(begin)]], return_counts=True)
                    halves = np.zeros((2, len(found)), np.uint64)
                    for at in range(n):
                        word = words[found >> CODE_BITS * (n - 1 - at) & (1 << CODE_BITS) - 1]
                        halves += word.T * FACTORS[:, at : at + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), *(pa.array(h.view(np.int64)) for h in halves), pa.array(counts.astype(np.int64))], ["n", "k1", "k2", "c"])

    return rows.select(tokens).mapInArrow(keys, "n int, k1 long, k2 long, c long")
