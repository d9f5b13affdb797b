"""Token counts, packing, mixing, line dedup and SimHash against brute force on awkward rows."""

import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import lines, mixing, packing, simhash, token_counts
from lexatlas.llm.components import components
from lexatlas.llm.tokens import TokenIds

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Columns whose names the operators use inside.
CLASH = "_n int, size long, fp long, key string, words string, line_no int, rank int, start long, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def documents(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text, source) with every other column filled."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "k", "w", 4, 5, 6, "x") for i, t, s in rows], schema)


def reference_ids(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(BPE)
    return [encoder.encode(t or "", add_special_tokens=False).ids for t in texts]


TEXTS = [
    None, "", " ", "one two", "a" * 3000, "word " * 5000, "l'été n'est  pas\n\n fini", "<|endoftext|> in text", "tab\tand\x1cseparator\x85",
    "1.5, 2.5.\nEnd", "日本語 テキスト", "a.b,c .d ,e", "x-.y", "trailing ", " \n ", "​zero ﻿width",
]


def test_tokens_equal_the_library_on_any_mixture():
    picks = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "é", ".", ",", "!", "'s", "<|endoftext|>", "　", "\x1c", "中", "🙂", "\r\n", "10", "×", "̀"]
    texts = TEXTS + ["".join(picks.choice(parts) for _ in range(picks.randint(0, 20))) for _ in range(3000)]
    found = [np.frombuffer(x, "<u4").tolist() for x in TokenIds(BPE, remembered=200).encode([t or "" for t in texts])]
    assert found == reference_ids(texts)


def test_token_counts(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "one two", "s")]
    got = token_counts.count_tokens(documents(spark, rows), BPE, limit=1024)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), len(ids), len(ids) > 1024) for (i, t, _), ids in zip(rows, reference_ids([t for _, t, _ in rows])))
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(documents(spark, []), BPE).count() == 0


def test_packing_places_every_id_once(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "one two", "s")] + [(100 + i, "same text again", "s") for i in range(60)]
    got = packing.pack(documents(spark, rows), BPE, length=64).collect()
    ids = {}
    for (i, t, _), found in zip(rows, reference_ids([t for _, t, _ in rows])):
        ids[i] = [*found, 1]
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, found in parts.items():
        copies = sum(1 for row in rows if row[0] == i)
        assert sorted(found) == sorted([(a, min(64, len(ids[i]) - a)) for a in range(0, len(ids[i]), 64)] * copies)
    assert set(parts) == set(ids)
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 64
    filled = sum(r.length for r in got)
    assert filled >= 0.95 * 64 * (len(sequences) - 1)
    assert packing.pack(documents(spark, []), BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_plan_covers_the_histogram(seed):
    picks = random.Random(seed)
    histogram = {picks.randint(1, 256): picks.randint(1, 1000) for _ in range(80)}
    patterns = packing.plan_packs(histogram, 256)
    placed = Counter()
    for count, parts in patterns:
        assert count > 0 and sum(size * copies for size, copies in parts) <= 256
        for size, copies in parts:
            placed[size] += count * copies
    assert placed == histogram
    assert sum(c for c, _ in patterns) * 256 <= 1.15 * sum(k * v for k, v in histogram.items()) + 256


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("block", [4, 64])
def test_mixing_meets_targets_and_bounds(spark, block):
    picks = random.Random(block)
    sources = ["b", "a", "ä", None, "tiny"]
    rows = [(i, " ".join(["w"] * picks.randint(0, 400)), picks.choice(sources[:4])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "void"), (1002, "one two three", "tiny"), (5, rows[5][1], rows[5][2]), (None, "no id here", "a")]
    frame = documents(spark, rows)
    got = mixing.taken_words(frame, block=block).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, total, free = {}, sum(sizes.values()), set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    assert abs(sum(target.values()) - total) < 1e-6
    by_size = {sizes[s]: s for s in order}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[by_size[r.source_size]])
        taken[by_size[r.source_size]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= block + 0.005 * target[s]
    again = mixing.taken_words(frame.repartition(3), block=block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.taken_words(documents(spark, [])).count() == 0


def test_permutation_is_one(spark):
    for size in (1, 2, 3, 7, 64, 1000):
        image = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(1), F.lit(2)).alias("x"))
        assert sorted(r.x for r in image.collect()) == list(range(size))


def test_mixed_documents_keep_rows_and_cut_texts(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)), "ab"[i % 2]) for i in range(40)] + [(99, None, "a"), (98, " lead\n and  tail ", "c"), (None, "n o i d", "a")]
    frame = documents(spark, rows)
    got = mixing.mix_documents(frame, block=16)
    assert got.columns == frame.columns and got.schema["text"].dataType == frame.schema["text"].dataType
    original = {i: (t or "").split() for i, t, _ in rows}
    passes = Counter()
    for r in got.collect():
        mine = r.text.split()
        assert mine and Counter(mine) <= Counter(original[r.doc_id]) and r.n_chars == len(r.text)
        passes[r.doc_id] += len(mine)
    assert all(passes[i] <= 3 * len(original[i]) for i in passes) and 99 not in passes
    assert mixing.mix_documents(documents(spark, [])).count() == 0


def near(a, b):
    """Whether one word inserted, deleted or replaced (or none) makes a into b, by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= 1


def brute_lines(rows, min_words):
    seen = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            parts = tuple(x.decode() for x in line.encode().lower().split())
            if parts:
                seen.setdefault(parts, ((i is None, i or 0), n))
    order = sorted(seen, key=seen.get)
    dropped = {p for at, p in enumerate(order) if len(p) >= min_words and any(len(q) >= min_words and near(q, p) for q in order[:at])}
    out = {}
    for i, t, _ in rows:
        kept = []
        for n, line in enumerate((t or "").split("\n")):
            parts = tuple(x.decode() for x in line.encode().lower().split())
            if not parts or (parts not in dropped and seen[parts] == ((i is None, i or 0), n)):
                kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    picks = random.Random(9)
    rows = []
    for i in range(60):
        text = []
        for _ in range(picks.randint(1, 6)):
            line = [picks.choice("abc") for _ in range(picks.choice([2, 7, 8, 9]))]
            text.append(picks.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, "\n".join([*text, picks.choice(["", " ", "Short"])]), "s"))
    base = " ".join(f"w{i}" for i in range(3000))
    rows += [(100, base, "s"), (101, base.replace("w77 ", ""), "s"), (102, base + " more", "s"), (103, base.replace("w5 ", "v5 ").replace("w6 ", "v6 "), "s")]
    rows += [(104, None, "s"), (105, "", None), (None, "Short\nonly here", "s"), (106, "x\n" * 20, "s")]
    frame = documents(spark, rows)
    got = lines.dedup_lines(frame)
    assert got.columns == frame.columns
    found = {r.doc_id: r.text for r in got.collect()}
    assert found == brute_lines(rows, 8)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    twice = lines.dedup_lines(documents(spark, [rows[0], rows[0]])).collect()
    # Rows equal in id and text are two documents: one keeps its lines, the other has only repeats (and its blank lines).
    full = brute_lines([rows[0]], 8)[0]
    assert Counter(r.text for r in twice) == Counter([full, "\n".join(x for x in rows[0][1].split("\n") if not x.strip())])
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_lines_of_rows_without_an_own_id(spark):
    """Null and repeated ids: a line stays once, whichever of the rows keeps it; numbers above 2**53 beside nulls stay apart."""
    big = 2**60
    rows = [(None, f"shared line\nown line {i}", "s") for i in range(3)] + [(None, "shared line\nown line 0", "s")]
    rows += [(1, "a b\nc d", "s"), (1, "c d\ne f", "s"), (1, "c d\ne f", "s"), (big + 1, "big one\nx y z", "s"), (big + 2, "big two\nx y z", "s"), (None, None, "s"), (None, "", "s")]
    got = lines.dedup_lines(documents(spark, rows).coalesce(1)).collect()
    assert len(got) == len(rows)
    kept = Counter(line for r in got for line in (r.text or "").split("\n") if line)
    assert kept == Counter({line: 1 for _, t, _ in rows for line in (t or "").split("\n") if line})
    by_id = {r.doc_id: r.text for r in got if r.doc_id and r.doc_id > 1}
    assert by_id == {big + 1: "big one\nx y z", big + 2: "big two"}
    assert sum(r.text is None for r in got) == 1


def test_large_ids_beside_nulls_are_packed_apart(spark):
    big = 2**60
    rows = [(big + 1, "one two three", "s"), (big + 2, "four five six", "s"), (None, "seven", "s")]
    got = packing.pack(documents(spark, rows).coalesce(1), BPE, 16).collect()
    assert Counter(r.doc_id for r in got) == Counter([big + 1, big + 2, None])


def test_small_sources_meet_their_targets(spark):
    picks = random.Random(21)
    sizes = [1, 2, 3, 7, 40, 63, 64, 65, 400, 900, 1500, 2000]
    rows, number = [], 0
    for i, size in enumerate(sizes):
        left = size
        while left:
            words_here = min(left, picks.randint(1, 300))
            rows.append((number, " ".join(["w"] * words_here), f"s{i:02d}"))
            number, left = number + 1, left - words_here
    for run in (mixing.taken_words, lambda d: mixing.taken_words(d, block=mixing.TEXT_BLOCK)):
        taken, target, size = Counter(), {}, {}
        for r in run(documents(spark, rows)).collect():
            source = rows[r.doc_id][2]
            taken[source] += r.taken
            target[source], size[source] = r.target, r.source_size
        for source in target:
            assert abs(taken[source] - target[source]) <= max(1, 0.03 * target[source]), (source, size[source])
            assert taken[source] > 0
    mixed = mixing.mix_documents(documents(spark, rows)).collect()
    assert {r.source for r in mixed} == {r[2] for r in rows}


def test_session_settings_are_left_alone():
    """A session without spark.checkpoint.dir gets a folder of its own; nothing is written into its settings."""
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.conf.get("spark.checkpoint.dir", None)
from lexatlas.llm.common import save, shared_folder
class Bare:
    def __init__(self, spark): self.sparkContext, self.conf = spark.sparkContext, self
    def get(self, key, default=None): return None if key == "spark.checkpoint.dir" else default
    def set(self, *a): raise AssertionError("set")
first, again = shared_folder(Bare(spark)), shared_folder(Bare(spark))
assert first == again or spark.sparkContext.getCheckpointDir()
assert save(spark.range(3), "t").count() == 3
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]


def brute_components(prints):
    label = {}
    for i, (d, f) in enumerate(prints):
        label[i] = {i}
    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i][1], 16) ^ int(prints[j][1], 16)).bit_count() <= 3 and label[i] is not label[j]:
                joined = label[i] | label[j]
                for k in joined:
                    label[k] = joined
    return [min((prints[k][0] for k in label[i] if prints[k][0] is not None), default=None) for i in range(len(prints))]


def test_fingerprint_by_hand():
    import xxhash

    text = "The QUICK  brown\tfox jumps"
    parts = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash.fingerprint("Two words") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint("É é") & (1 << 64) - 1 == xxhash.xxh64_intdigest("É é".encode(), 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_equal_brute_force(spark):
    picks = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [picks.choice(vocabulary) for _ in range(300)]
        for c in range(picks.randint(1, 6)):
            copy = list(base)
            if c:
                copy[picks.randrange(300)] = "changed"
            rows.append((1000 - len(rows), " ".join(copy), "s"))
    rows += [(5, None, "s"), (6, "", "s"), (None, "", "s"), (None, "lonely words without id", "s"), (7, "one", "s"), (7, "one", "s"), (8, "two words", None)]
    frame = documents(spark, rows)
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert Counter((d, f) for d, f, _ in got) == Counter((i, f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}") for i, t, _ in rows)
    assert [c for _, _, c in got] == brute_components([(d, f) for d, f, _ in got])
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter({c for _, _, c in got})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_links_reach_all_of_a_large_group(spark, monkeypatch):
    """Groups above the bound are divided again and lose nothing."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", 100)
    picks = random.Random(2)
    values = set()
    for _ in range(6):
        base = picks.getrandbits(64)
        for _ in range(150):
            value = base
            for bit in picks.sample(range(64), picks.randint(0, 4)):
                value ^= 1 << bit
            values.add(value)
    values |= {(7 << 40) ^ k for k in range(400)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    prints = np.array(signed, np.int64).view(np.uint64)
    label = np.array(signed)
    near_ones = [np.flatnonzero(np.bitwise_count(prints ^ x) <= 3) for x in prints]
    while True:
        lower = np.array([label[n].min() for n in near_ones])
        if np.array_equal(lower, label):
            break
        label = lower
    assert [roots.get(v, v) for v in signed] == label.tolist()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{200 + i: 200 for i in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
