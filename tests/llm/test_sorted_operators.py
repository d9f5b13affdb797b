"""Suffix sorting, phrase counts and whitening against brute force, and the runs they share."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lexatlas.llm import phrases, sorted_runs, suffixes, whitening
from lexatlas.llm.common import scratch, save


def frame(spark, rows, schema="doc_id long, text string, lang string, key string, spans int"):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)


@pytest.mark.parametrize("seed", range(5))
def test_merge_of_runs_equals_sorting(seed):
    picks = random.Random(seed)
    runs = [sorted({bytes(picks.choice(b"ab\0") for _ in range(picks.randint(0, 12))) for _ in range(picks.randint(0, 40))}) for _ in range(picks.randint(1, 9))]
    want = defaultdict(list)
    for number, run in enumerate(runs):
        for at, string in enumerate(run):
            want[string].append((number, at))
    blocks = [sorted_runs.front_code(run, range(len(run))) for run in runs]
    got = list(sorted_runs.equal_groups([sorted_runs.decode(b) for b in blocks]))
    assert [(s, sorted(met)) for s, met in got] == [(s, want[s]) for s in sorted(want)]
    last = b""
    for common, string, _, _ in sorted_runs.merge([sorted_runs.decode(b) for b in blocks]):
        assert common == sorted_runs.common_prefix(last, string)
        last = string


def test_merge_never_compares_a_known_prefix(monkeypatch):
    """Strings with a long common beginning are read from where they are known to differ."""
    seen = []
    real = sorted_runs.common_prefix

    def watched(a, b, known=0):
        seen.append(known)
        return real(a, b, known)

    runs = [[b"x" * 500 + b"%04d" % i for i in range(r, 400, 4)] for r in range(4)]
    monkeypatch.setattr(sorted_runs, "common_prefix", watched)
    assert [s for _, s, _, _ in sorted_runs.merge([sorted_runs.decode(sorted_runs.front_code(r)) for r in runs])] == sorted(sum(runs, []))
    assert sum(k < 500 for k in seen) <= 4


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    times = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans, at = [], 0
        while at < len(b):
            stop = at
            while stop < len(b) and gone[stop]:
                stop += 1
            if stop > at:
                spans.append((at, stop))
            at = max(stop, at + 1)
        out.append((doc_id, len(b), tuple(spans), kept, hashlib.sha256(kept).hexdigest()))
    return out


def seen(frame):
    return [(r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept), r.kept_sha256) for r in frame.collect()]


def suffix_rows(seed):
    picks = random.Random(seed)
    passages = ["".join(picks.choice("abcdé ") for _ in range(picks.randint(30, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(picks.choice([picks.choice(passages), "".join(picks.choice("abc") for _ in range(picks.randint(0, 60)))]) for _ in range(picks.randint(0, 4)))
        if picks.random() < 0.3 and text:
            at = picks.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text, "en"))
    return rows + [(None, None, "en"), (None, rows[3][1], None), (7, rows[7][1], "en"), (90, "", "en"), (91, "ab" * 150, "en"), (96, "abcd" * 40 + "x" + "abcd" * 70, "en"), (92, "x" * 200, "en"), (93, "x" * 31, "en"), (94, "q" * 19, "en"), (95, "q" * 19, "en"), (2**60 + 1, passages[0] * 3, "en")]


@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "RUN_BYTES", 1 << 12)
    monkeypatch.setattr(suffixes, "RANGE_ITEMS", 50)
    monkeypatch.setattr(suffixes, "SEGMENT", 128)
    rows = suffix_rows(seed)
    got = seen(suffixes.remove_repeats(frame(spark, rows).repartition(3), 20))
    assert Counter(got) == Counter(brute_repeats(rows, 20))


def test_repeats_of_the_production_length(spark):
    picks = random.Random(8)
    text = lambda n: "".join(picks.choice("abcdefgh ") for _ in range(n))
    shared, boiler = text(900), text(390)
    rows = [(i, text(300) + shared[: 600 + i] + text(200), "en") for i in range(5)]
    rows += [(10 + i, text(250) + boiler + text(250), "en") for i in range(30)]  # too short a passage, wherever it stands
    rows += [(50, text(1200), "en"), (60, text(2000), "en")]
    rows += [(51, rows[-2][1][:500] + "!" + rows[-2][1][501:], "en"), (61, rows[-1][1], "en")]
    assert Counter(seen(suffixes.remove_repeats(frame(spark, rows)))) == Counter(brute_repeats(rows, 400))
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    assert suffixes.remove_repeats(frame(spark, [(1, None, "a"), (None, "short", None)])).count() == 2


def test_anchors_deal_out_every_window():
    picks = random.Random(3)
    for text in [bytes(picks.choice(b"ab") for _ in range(500)), b"a" * 300, b"abc" * 90, b"", b"x" * 19, b"x" * 20]:
        for apart in (False, True):
            start, windows, anchor, _ = suffixes.anchors(text, 20, apart)
            dealt = sorted(s + i for s, n in zip(start.tolist(), windows.tolist()) for i in range(n))
            assert dealt == list(range(max(0, len(text) - 19)))
            assert all(s + n - 1 <= a <= s + 15 for s, n, a in zip(start.tolist(), windows.tolist(), anchor.tolist()) if apart or a >= 0)


def brute_phrases(rows, least, longest):
    import re

    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().lower().decode()):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    return {k: v for k, v in f.items() if v >= least}, n, f


def phrase_rows():
    picks = random.Random(6)
    words = [f"w{i}" for i in range(12)] + ["Été", "NEW", "york"]
    rows = []
    for i in range(150):
        text = "".join(picks.choice(words) + picks.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for _ in range(picks.randint(0, 60)))
        rows.append((i, text + (" new york stock market" if i % 3 else " a b c d e"), picks.choice(["en", "de", None])))
    return rows + [(None, None, "en"), (None, "new york", "und"), (5, "", None), (6, "...,,", "xx"), (7, rows[7][1], rows[7][2])]


def test_phrase_counts_equal_brute_force(spark, monkeypatch):
    for name, value in (("BURST", 8), ("HELD", 200), ("BATCH_WORDS", 100), ("PARTITION_WORDS", 200), ("CHUNK", 40), ("FILTER_BITS", 2), ("SUMMED", 300)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows()
    got = phrases.count_phrases(frame(spark, rows).repartition(3), least=7).collect()
    want, n, _ = brute_phrases(rows, 7, 5)
    assert {(r.lang, *r.phrase.split(" ")): r.f for r in got if r.phrase is not None} == want
    assert {r.lang: r.f for r in got if r.phrase is None} == {lang: m for lang, m in n.items() if m}
    assert all(r.words == len(r.phrase.split(" ")) for r in got if r.phrase is not None)


def brute_collocations(rows, least, longest, top):
    found, n, f = brute_phrases(rows, least, longest)
    kept = defaultdict(list)
    candidates = {k: a for k, a in found.items() if len(k) > 2}
    for (lang, *w), a in candidates.items():
        inside = any(
            other[0] == lang and len(other) > len(w) + 1 and 100 * b >= 100 * a and any(list(other[1:][i : i + len(w)]) == w for i in range(len(other) - len(w)))
            for other, b in candidates.items()
        )
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            kept[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return [
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, all_of in kept.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(all_of)[:top], 1)
    ]


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows()
    got = [tuple(r) for r in phrases.collocations(frame(spark, rows), least=5, top=40).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, 5, 5, 40)) and len(got) > 60
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_polynomial_and_roots_are_exact(spark):
    draws = np.random.default_rng(2)
    b = draws.integers(-9, 10, (7, 5))
    matrix = (b @ b.T).tolist()  # rank 5
    found = whitening.characteristic_polynomial(spark, matrix)
    # Faddeev-LeVerrier in exact fractions.
    n, m, want = 7, np.zeros((7, 7), object), [Fraction(0)] * 7 + [Fraction(1)]
    a = np.array([[Fraction(x) for x in row] for row in matrix], object)
    for k in range(1, n + 1):
        m = a @ m + want[n - k + 1] * np.array([[Fraction(int(i == j)) for j in range(n)] for i in range(n)], object)
        want[n - k] = -sum((a @ m)[i, i] for i in range(n)) / k
    assert found == [int(c) for c in want]
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    assert whitening.roots_above(found, 0, 0) == 5
    got = whitening.largest_roots(found, 4, 60)
    assert [m for _, m in got] == [1] * 4 and np.allclose([r / 2**60 for r, _ in got], values[:4], rtol=1e-12)
    # (x - 3)^2 (x - 2)
    assert [(r / 2**40, m) for r, m in whitening.largest_roots([-18, 21, -8, 1], 3, 40)] == [(3.0, 2), (2.0, 1)]


def whitened(spark, vectors):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, n int, x string")
    return whitening.whiten(table).collect()


def test_whitening_equals_plain_arithmetic(spark):
    draws = np.random.default_rng(4)
    vectors = [(i, (draws.standard_normal(6) * [4, 3, 2, 1, 0.5, 0.1] + 40).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(200)] + [(None, vectors[1][1]), (5, vectors[5][1])]
    bad = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [1.0] * 5 + [math.nan]), (2003, [math.inf] * 6), (2004, []), (2005, [1.0, 2.0])]
    rows = whitened(spark, vectors + bad)
    assert {r.vec_id for r in rows} == {i for i, _ in vectors} and len(rows) == 4 * len(vectors)
    x = np.floor(256 * np.array([np.float32(v) for _, v in vectors], float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    want = (x - s / n) @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    expected, at = defaultdict(list), Counter()
    for (i, _), w, d in zip(vectors, want, deviation):
        expected[i].append((w, d))
    for r in rows:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-9)
        assert any(abs(abs(w[r.component - 1]) - abs(r.whitened)) < 1e-8 and d == r.deviation for w, d in expected[r.vec_id])
    for component in range(1, 5):
        signs = {np.sign(r.whitened * expected[r.vec_id][0][0][component - 1]) for r in rows if r.component == component and abs(r.whitened) > 1e-6 and len(expected[r.vec_id]) == 1}
        assert len(signs) == 1


def test_whitening_of_awkward_tables(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    rows = whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-0.0, 0.0])])
    assert {(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened)) for r in rows} == {(1, 1, 2, 65536, 1.0), (2, 1, 2, 65536, 1.0), (3, 1, 2, 65536, 1.0)}
    square = whitened(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])  # one eigenvalue, twice
    assert {r.component for r in square} == {1, 2} and all(r.identity_error < 1e-9 and r.explained == 0.5 for r in square)
    far = whitened(spark, [(1, [3e30, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 3.0])])
    assert {r.vec_id for r in far} == {1, 2, 3}


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    with scratch(spark) as keep:
        first = save(spark.range(5), "first")
        second = keep(first.selectExpr("id + 1 as id"), "second")
        gone = first.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and sorted(r.id for r in second.collect()) == [1, 2, 3, 4, 5]
