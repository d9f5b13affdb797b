"""Phrase counts and collocations: a trie over word ids with hash containers that burst.

Each task counts phrases in a shallow trie: language and first word lead to a
hash container of the rest of the phrase, and a container that grows large
bursts into one container per next word; single words are counted at the root.
When a task holds too many phrases,
it hands on whole subtrees, largest first, as sorted, front-coded runs; runs
are merged per partition of prefixes by a loser tree that adds equal phrases.
Word ids are a task's own, so no dictionary of the corpus is sent around.

A phrase can be frequent only if all shorter phrases in it are, and if the
phrases that share its hash are so together. So hashes are summed first, size
by size between those that are frequent, and only phrases of frequent hashes
enter the trie. They are known through bit filters of bounded size; these may
let others pass, which are then counted, too, and dropped by the merge's exact
sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.llm.common import bit_filter, passes, save, scratch, small_batches
from lexatlas.llm.sorted_runs import decode, equal_groups, front_code

LEAST, LONGEST, TOP = 100, 5, 2000
#: Byte that stands for a border between pieces (it is in no UTF-8 text), and the bytes that are borders.
BORDER = b"\xff"
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words counted at a time, entries a container has before it bursts, and entries a task holds before it hands on subtrees.
BATCH_WORDS, BURST, HELD = 1 << 18, 1 << 14, 1 << 18
#: Different hashes that a task sums before it hands them on.
SUMMED = 1 << 21
#: Words of the corpus per partition of prefixes.
PARTITION_WORDS = 2_000_000
#: Bits of the filter per frequent phrase.
FILTER_BITS = 16
#: Bytes of a text whose words are found at a time, up to the next separator.
CHUNK = 1 << 22
TO_BORDER = bytes.maketrans(SEPARATORS, BORDER * len(SEPARATORS))
ROWS = "lang string, words int, f long, part int, block binary"


class Ids(dict):
    """Ids of a task's words in the order of their appearance; 0 is the border."""

    def __init__(self):
        super().__init__({BORDER: 0})
        self.names = [BORDER]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


def chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts that end at separators."""
    at = 0
    while len(text) - at > CHUNK:
        ends = [e for e in (text.find(s, at + CHUNK) for s in (b".", b",", b"\n", b";", b":", b"!", b"?", b"\r", b"\x0b", b"\x0c")) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


class Container:
    """Counts of the rest of phrases, by the bytes of their word ids; bursts by the next word."""

    __slots__ = ("counts", "below", "size")

    def __init__(self):
        self.counts: dict[bytes, int] = {}
        self.below: dict[bytes, dict[bytes, int]] | None = None
        self.size = 0

    def add(self, rest: list[bytes], times: list[int]) -> None:
        if self.below is None:
            counts = self.counts
            for key, n in zip(rest, times, strict=True):
                counts[key] = counts.get(key, 0) + n
            self.size = len(counts)
            if self.size > BURST and len(rest[0]) > 4:
                self.below = {}
                self.counts = {}
                self.add(list(counts), list(counts.values()))
            return
        for key, n in zip(rest, times, strict=True):
            counts = self.below.setdefault(key[:4], {})
            before = len(counts)
            counts[key[4:]] = counts.get(key[4:], 0) + n
            self.size += len(counts) - before

    def entries(self) -> Iterator[tuple[bytes, int]]:
        if self.below is None:
            yield from self.counts.items()
        else:
            for word, counts in self.below.items():
                for key, n in counts.items():
                    yield word + key, n


class PhraseTrie:
    """A task's counts: single words by language, and containers under (words, language, first word)."""

    def __init__(self, parts: int):
        self.ids, self.langs, self.lang_names = Ids(), {}, []
        self.hashes = np.zeros(1, np.uint64)
        self.singles: dict[int, np.ndarray] = {}
        self.nodes: dict[tuple[int, int, int], Container] = {}
        self.held, self.parts = 0, parts

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = len(self.lang_names)
            self.lang_names.append(name)
        return self.langs[name]

    def word_hashes(self) -> np.ndarray:
        import xxhash

        new = self.ids.names[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return self.hashes

    def slots(self, words: np.ndarray, langs: np.ndarray, longest: int) -> list[np.ndarray]:
        """Numbers of the phrases of 1, 2, ... ``longest`` words that begin at each place, as the filters know them."""
        import xxhash

        hashes = self.word_hashes()[words]
        total = np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) for n in self.lang_names], np.uint64)[langs]
        out = []
        for size in range(1, longest + 1):
            total = (total[: max(0, len(words) - size + 1)] ^ hashes[size - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
            out.append(total >> np.uint64(1))
        return out

    def count_words(self, words: np.ndarray, langs: np.ndarray) -> None:
        """Add single words."""
        real = words > 0
        for lang in np.unique(langs[real]).tolist():
            times = np.bincount(words[real & (langs == lang)])
            counts = self.singles.get(lang, np.zeros(0, np.int64))
            grown = np.zeros(max(len(times), len(counts)), np.int64)
            grown[: len(counts)] = counts
            grown[: len(times)] += times
            self.held += int(np.count_nonzero(grown) - np.count_nonzero(counts))
            self.singles[lang] = grown

    def count_phrases(self, words: np.ndarray, langs: np.ndarray, starts: dict[int, np.ndarray]) -> None:
        """Add the phrases of each size at its ``starts``; those of a size lie among those of the size below, down to 2."""
        code = np.empty(0, np.int64)
        for size in sorted(starts):
            at = starts[size]
            if not len(at):
                return
            if size == 2:
                code = pd.factorize(langs[at].astype(np.int64) << 32 | words[at])[0].astype(np.int64)
            else:
                code = code[np.searchsorted(starts[size - 1], at)]
            code = pd.factorize(code << 32 | words[at + size - 1])[0].astype(np.int64)
            self._add(words, langs, size, at, code)

    def _add(self, words: np.ndarray, langs: np.ndarray, size: int, starts: np.ndarray, code: np.ndarray) -> None:
        times = np.bincount(code)
        at = np.empty(len(times), np.int64)
        at[code[::-1]] = starts[::-1]  # where each phrase is met first
        first = langs[at].astype(np.int64) << 32 | words[at]
        order = np.argsort(first, kind="stable")
        at, times, first = at[order], times[order].tolist(), first[order]
        rest = np.ascontiguousarray(np.stack([words[at + i] for i in range(1, size)], axis=1).astype("<u4")).tobytes()
        width = 4 * (size - 1)
        keys = [rest[i : i + width] for i in range(0, width * len(at), width)]
        cuts = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)).tolist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            node = (size, int(first[low]) >> 32, int(first[low]) & 0xFFFFFFFF)
            container = self.nodes.get(node)
            if container is None:
                container = self.nodes[node] = Container()
            before = container.size
            container.add(keys[low:high], times[low:high])
            self.held += container.size - before

    def _subtrees(self, down_to: int) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
        """Take out single words, then subtrees, largest first, until ``down_to`` entries are left: (language, words, ids, counts)."""
        if self.held > down_to:
            for lang, counts in self.singles.items():
                words = np.flatnonzero(counts)
                self.held -= len(words)
                yield lang, 1, words[:, None], counts[words].tolist()
            self.singles = {}
        for node in sorted(self.nodes, key=lambda n: -self.nodes[n].size):
            if self.held <= down_to:
                break
            size, lang, word = node
            container = self.nodes.pop(node)
            self.held -= container.size
            rest, counts = zip(*container.entries(), strict=True)
            ids = np.frombuffer(b"".join(rest), "<u4").reshape(len(rest), size - 1)
            yield lang, size, np.column_stack([np.full(len(rest), word), ids]), list(counts)

    def runs(self, down_to: int) -> Iterator[tuple[str, int, int, bytes]]:
        """Hand on what ``_subtrees`` takes out as sorted runs: (language, words, partition, block).

        The prefix that chooses the partition is two words, as a very common
        first word may begin a large share of all phrases.
        """
        names, hashes = self.ids.names, self.word_hashes()
        gathered: dict[tuple[int, int], tuple[list[np.ndarray], list[int]]] = {}
        for lang, size, ids, counts in self._subtrees(down_to):
            parts, all_counts = gathered.setdefault((lang, size), ([], []))
            parts.append(ids)
            all_counts += counts
        for (lang, size), (parts, counts) in gathered.items():
            ids = np.concatenate(parts)
            prefix = hashes[ids[:, 0]] if size == 1 else (hashes[ids[:, 0]] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[ids[:, 1]]
            part = ((prefix ^ (prefix >> np.uint64(32))) % np.uint64(self.parts)).astype(np.int64)
            columns = [list(map(names.__getitem__, ids[:, i].tolist())) for i in range(size)]
            phrases = columns[0] if size == 1 else list(map(b" ".join, zip(*columns, strict=True)))
            entries = sorted(zip(part.tolist(), phrases, counts, strict=True))
            cuts = np.append(np.flatnonzero(np.append(True, np.diff([e[0] for e in entries]) != 0)), len(entries)).tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                _, strings, values = zip(*entries[low:high], strict=True)
                yield self.lang_names[lang], size, entries[low][0], front_code(strings, values)


def _tokens(batches: Iterator[pa.RecordBatch], trie: PhraseTrie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word ids, with borders between pieces and texts, and language numbers, some hundred thousand at a time."""
    words, langs, waiting = [], [], 0

    def flat() -> tuple[np.ndarray, np.ndarray]:
        lengths = [len(w) for w in words]
        return np.concatenate([np.array(w, np.int64) for w in words]), np.repeat(np.array(langs), lengths)

    for batch in batches:
        for name, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
            number = trie.lang(name)
            for part in chunks(body.as_py()):
                found = list(map(trie.ids.__getitem__, part.lower().translate(TO_BORDER).replace(BORDER, b" \xff ").split()))
                found.append(0)
                words.append(found)
                langs.append(number)
                waiting += len(found)
                if waiting >= BATCH_WORDS:
                    yield flat()
                    words, langs, waiting = [], [], 0
    if words:
        yield flat()


def _starts(trie: PhraseTrie, ids: np.ndarray, langs: np.ndarray, sizes: tuple[int, ...], filters: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """Where the phrases of each size from 2 on begin that the filters let pass, and the numbers of all phrases.

    A phrase passes if all shorter ones in it do, and its own size's filter if there is one.
    """
    slots = trie.slots(ids, langs, max(sizes))
    at = (ids > 0) & passes(filters[1], slots[0])
    found = {}
    for size in range(2, max(sizes) + 1):
        count = max(0, len(ids) - size + 1)
        at = at[:count] & at[1 : count + 1]
        if size in filters:
            at &= passes(filters[size], slots[size - 1])
        if size in sizes:
            found[size] = np.flatnonzero(at)
    return found, slots


def _likely(bodies: DataFrame, sizes: tuple[int, ...], filters: dict[int, np.ndarray], parts: int, least: int) -> DataFrame:
    """Rows (words, slot) of the hashes whose phrases occur ``least`` times together."""
    shared = bodies.sparkSession.sparkContext.broadcast(filters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PhraseTrie(parts)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size in sizes}

        def combined(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            slots, where = np.unique(np.concatenate([s for s, _ in some]), return_inverse=True)
            return slots, np.bincount(where, np.concatenate([n for _, n in some]), len(slots)).astype(np.int64)

        def out(size: int) -> pa.RecordBatch:
            slots, counts = combined(held[size])
            held[size] = []
            cuts = np.searchsorted(slots, [(p << 63) // parts for p in range(parts + 1)])
            cuts[-1] = len(slots)
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            blobs = [[x[cuts[p] : cuts[p + 1]].tobytes() for p in full] for x in (slots.astype("<u8"), counts.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([size] * len(full), pa.int32()), pa.array(full, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], ["words", "part", "slots", "counts"])

        for ids, langs in _tokens(batches, trie):
            found, numbers = _starts(trie, ids, langs, sizes, shared.value)
            for size, starts in found.items():
                if len(starts):
                    held[size].append(np.unique(numbers[size - 1][starts], return_counts=True))
                    if sum(len(s) for s, _ in held[size]) > SUMMED:
                        held[size] = [combined(held[size])]
                        if len(held[size][0][0]) > SUMMED // 2:
                            yield out(size)
        for size in sizes:
            if held[size]:
                yield out(size)

    def add(table: pa.Table) -> pa.Table:
        slots = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("slots").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()])
        found, where = np.unique(slots, return_inverse=True)
        found = found[np.bincount(where, counts, len(found)) >= least]
        return pa.table({"words": pa.array([table.column("words")[0].as_py()] * len(found), pa.int32()), "slot": pa.array(found.view(np.int64))})

    runs = bodies.mapInArrow(scan, "words int, part int, slots binary, counts binary")
    return runs.groupBy("words", "part").applyInArrow(add, "words int, slot long")


def _counts(bodies: DataFrame, sizes: tuple[int, ...], filters: dict[int, np.ndarray], parts: int, least: int) -> DataFrame:
    """Frequent phrases of the given sizes, (1,) or from 2 on: lang, words, phrase, f, slot; for single words also all occurrences (phrase null)."""
    shared = bodies.sparkSession.sparkContext.broadcast(filters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PhraseTrie(parts)
        totals: dict[int, int] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            lang, size, part, block = (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True))
            return pa.RecordBatch.from_arrays([lang, size, pa.nulls(len(rows), pa.int64()), part, block], ["lang", "words", "f", "part", "block"])

        for ids, langs in _tokens(batches, trie):
            if 1 not in sizes:
                trie.count_phrases(ids, langs, _starts(trie, ids, langs, sizes, shared.value)[0])
            else:
                trie.count_words(ids, langs)
                for lang, n in enumerate(np.bincount(langs[ids > 0]).tolist()):
                    totals[lang] = totals.get(lang, 0) + n
            if trie.held > HELD:
                yield out(list(trie.runs(HELD // 2)))
        yield out(list(trie.runs(0)))
        if totals:
            n = len(totals)
            names = [trie.lang_names[i] for i in totals]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([1] * n, pa.int32()), pa.array(list(totals.values()), pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary())],
                ["lang", "words", "f", "part", "block"],
            )

    def merge(table: pa.Table) -> pa.Table:
        lang, size = table.column("lang")[0].as_py(), table.column("words")[0].as_py()
        trie = PhraseTrie(1)
        trie.lang(lang)
        phrases, counts = [], []
        for phrase, met in equal_groups([decode(b) for b in table.column("block").to_pylist()]):
            total = sum(n for _, n in met)
            if total >= least:
                phrases.append(phrase)
                counts.append(total)
        ids = np.array([trie.ids[w] for p in phrases for w in p.split(b" ")], np.int64)
        slots = trie.slots(ids, np.zeros(len(ids), np.int64), size)[-1][::size].view(np.int64) if len(ids) else np.empty(0, np.int64)
        many = len(phrases)
        return pa.table([pa.array([lang] * many, pa.string()), pa.array([size] * many, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64()), pa.array(slots)], ["lang", "words", "phrase", "f", "slot"])

    runs = save(bodies.mapInArrow(scan, ROWS), "runs")
    # All occurrences are a row per task and language: summed without gathering them.
    totals = runs.filter("part < 0").groupBy("lang", "words").agg(F.sum("f").alias("f")).filter("f > 0").select("lang", "words", F.lit(None).cast("binary").alias("phrase"), "f", F.lit(None).cast("long").alias("slot"))
    merged = runs.filter("part >= 0").groupBy("lang", "words", "part").applyInArrow(merge, "lang string, words int, phrase binary, f long, slot long")
    return merged.unionByName(totals) if 1 in sizes else merged


def count_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """All phrases of up to ``longest`` words that occur ``least`` times or more in their language.

    Columns lang, words (their number), phrase (null: all word occurrences of
    the language) and f. A null lang is ``und``, a null text is empty; other
    columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    bodies = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    with scratch(spark) as keep:
        words = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        parts = max(1, words // 6 // PARTITION_WORDS)
        whole = save(_counts(bodies, (1,), {}, parts, least), "words")
        filters = {1: bit_filter(whole.filter("phrase is not null"), "slot", FILTER_BITS)}
        # Sizes 4 and up start from the hashes of three words, so that one pass sums them all.
        for sizes in [(size,) for size in range(2, min(longest, 3) + 1)] + [tuple(range(4, longest + 1))] * (longest > 3):
            likely = save(_likely(bodies, sizes, filters, parts, least), "likely")
            filters |= {size: bit_filter(likely.filter(F.col("words") == size), "slot", FILTER_BITS) for size in sizes}
        if longest > 1:
            whole = whole.unionByName(save(_counts(bodies, tuple(range(2, longest + 1)), filters, parts, least), "phrases"))
        return keep(whole.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f"), "counted")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase of ``a`` occurrences cut after k words has parts of l and r
    occurrences and the score floor(1000 a n / (l r)), exact in 128-bit
    decimals; the lowest cut counts, ties to the smallest k. Phrases inside a
    longer one that is as frequent are dropped. Order: score and a descending,
    phrase ascending by its UTF-8 bytes. An empty table gives no rows.
    """
    counted = count_phrases(documents, least, longest)
    known = counted.filter("phrase is not null")
    totals = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    phrases = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest")
    )
    sides = known.select("lang", "phrase", "f")
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(18,0))"
    score = F.expr(f"(1000BD * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    scored = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = phrases.filter("words > 2").select("lang", "words", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    spans = spans.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("from"))
    inside = spans.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
