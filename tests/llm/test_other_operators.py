"""Forest, WAND, WARC, toxicity and preference formatting against brute force on awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import forest, preference, toxicity, wand, warc


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, q string, id int")


def brute_nearest(rows, k):
    sound = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        sound[i] = min(sound.get(i, v), v)
    size = max(Counter(map(len, sound.values())).items(), key=lambda x: (x[1], x[0]))[0]
    sound = {i: v for i, v in sound.items() if len(v) == size}
    out = {}
    for q in sound:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def nearest_rows(frame, k):
    out = defaultdict(list)
    for r in forest.nearest(frame, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def test_forest_on_awkward_rows(spark):
    picks = np.random.default_rng(1)
    rows = [(i, picks.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 8) for i in range(70)]  # copies beyond k
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0, None] + [1.0] * 6), (241, [math.nan] * 8), (242, [math.inf] * 8), (243, [1.0] * 3), (None, [1.0] * 8), (5, [9.0] * 8), (20, rows[20][1])]
    got, want = nearest_rows(vectors(spark, rows), 5), brute_nearest(rows, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[100] == [(i, pytest.approx(s)) for i, s in want[100]]  # ties by id
    for q, found in got.items():
        told = dict(brute_nearest(rows, 10**6)[q])
        assert all(s == pytest.approx(told[i], rel=1e-12, abs=1e-12) for i, s in found)
    few = rows[:3] + rows[40:41]
    assert nearest_rows(vectors(spark, few), 20) == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in brute_nearest(few, 20).items()}
    assert forest.nearest(vectors(spark, []), F.lit(True)).count() == 0


def test_forest_recall_and_pruning(spark, monkeypatch):
    """Many fragments; clustered vectors are found deep in the trees, lengths may differ."""
    monkeypatch.setattr(forest, "FRAGMENT_ROWS", 128)
    picks = np.random.default_rng(2)
    centres = picks.standard_normal((40, 16))
    rows = [(i, ((centres[i % 40] + 0.1 * picks.standard_normal(16)) * (1 + i % 3)).tolist()) for i in range(2000)]
    got, want = nearest_rows(vectors(spark, rows), 10), brute_nearest(rows, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert forest.expected_depth([0.99] * 10, 10) > 20 > forest.expected_depth([0.3] * 10, 10)
    assert forest.expected_depth([0.9] * 3, 10) == 0


def brute_bm25(questions, docs, k):
    docs = [(i, (t or "").encode().lower().split()) for i, t in docs if i is not None]
    mean = sum(len(w) for _, w in docs) / len(docs)
    df = Counter(x for _, w in docs for x in set(w))
    out = {}
    for q, text in questions:
        scores = []
        for i, w in docs:
            tf = Counter(w)
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in (text or "").encode().lower().split() if tf[t])
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v and q is not None}


@pytest.mark.parametrize("shard,block", [(4096, 64), (50, 8)])
def test_wand_equals_full_scoring(spark, monkeypatch, shard, block):
    monkeypatch.setattr(wand, "SHARD_DOCS", shard)
    monkeypatch.setattr(wand, "BLOCK_DOCS", block)
    monkeypatch.setattr(wand, "QUESTION_BLOCK", 5)
    picks = random.Random(6)
    vocabulary = [f"w{int(picks.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(picks.choice(vocabulary) for _ in range(picks.randint(0, 60)))) for i in range(400)]
    docs += [(1000, docs[3][1]), (1001, docs[3][1]), (3, docs[3][1]), (1002, None), (None, "w1 w2"), (1003, "")]
    questions = [(q, " ".join(picks.choice(vocabulary) for _ in range(8))) for q in range(12)] + [(50, None), (51, "absent"), (52, docs[3][1].upper()), (53, "w1 w1 w2"), (None, "w1")]
    left = spark.createDataFrame(questions, "query_id long, text string")
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int")
    found = defaultdict(list)
    for r in wand.top_documents(left, right, k=7).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    want = brute_bm25(questions, docs, 7)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-5 for q in want for a, b in zip(found[q], want[q]))
    assert wand.top_documents(left, right.limit(0)).count() == wand.top_documents(left.limit(0), right).count() == 0


def test_wand_skips_blocks():
    """Blocks whose bound stays below the k-th best score are never scored."""
    found = [[0] * 5 if i == 3 else [0] if i % 2 else [] for i in range(640)]
    shard = wand.Shard(found, [10] * 640, np.array([1.0]), 10.0)
    ids, scores = shard.best(np.array([0]), np.array([1.0]), 1, 0.0)
    assert ids.tolist() == [3] and scores[0] == pytest.approx(5 * 2.2 / 6.2)


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 2000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, "http://c/é", long), (4, None, "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\n" + "b" * 1000), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    rows += [(None, "n", long), (3, "http://c/é", long)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, bytes int, sha1 int")
    got = Counter(map(tuple, warc.archive_pages(frame).collect()))
    import hashlib

    owner = {long: 3}
    want = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = html in owner and i != owner[html]
        want[(i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, True)] += 1
    assert got == want
    path = warc.write_archive(frame, str(tmp_path))
    content = spark.read.parquet(f"{path}/content")
    assert content.count() == len({(r[2] or "") for r in rows})
    for r in warc.read_records(spark, path).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields[b"Content-Length"]) == len(block)
    target = str(tmp_path / "files")
    warc.export(spark, path, target)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    count = 0
    while data:  # read record after record by the stated lengths
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, count = rest[size + 4 :], count + 1
    assert count == len(rows)
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_warc_notices_a_changed_payload(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "z" * 1500)], "page_id long, url string, html string")
    path = warc.write_archive(frame, str(tmp_path))
    content = spark.read.parquet(f"{path}/content").withColumn("payload", F.lit(b"other")).cache()
    content.count()
    content.write.mode("overwrite").parquet(f"{path}/content2")
    (tmp_path / path.rsplit("/", 1)[1] / "content").rename(tmp_path / "kept")
    (tmp_path / path.rsplit("/", 1)[1] / "content2").rename(f"{path}/content")
    assert [r.verified for r in warc.parse_records(warc.read_records(spark, path)).collect()] == [False]


def planted(count, seed):
    """Toxic where an insult stands with a group; each alone is clean."""
    picks = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        text = [f"w{picks.randint(0, 300)}" for _ in range(picks.randint(5, 60))]
        insult, group = picks.random() < 0.5, picks.random() < 0.5
        text += ["Vermin!"] * insult + ["townsfolk,"] * group
        picks.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    rows, labels = planted(1500, 1)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows] + [(5000, None, "en", 1), (5001, "", "en", 1), (None, "Vermin townsfolk", "en", 1)], "doc_id long, text string, lang string, score int")
    told = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, told).collect()
    import zlib

    truth = {i: t for i, _, t in labels}
    right = [(r.predicted == truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(right) > 200 and sum(right) >= 0.97 * len(right)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    assert len(got) == len(rows) + 3
    blank = {r.doc_id: r for r in got}
    assert blank[5000].score == blank[5001].score and blank[5000].predicted == 0 and blank[None].predicted == 1
    kept = toxicity.reject_toxic(docs, told)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_toxicity_weighs_rare_terms(spark):
    """200 insults of some rows each: no bound on terms leaves any without a weight."""
    picks = random.Random(3)
    insults = ["".join(picks.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(200)]
    rows = []
    for i in range(5600):
        text = [f"w{picks.randint(0, 300)}" for _ in range(12)] + [insults[i // 2 % 200]] * (i % 2)
        rows.append((i, " ".join(text), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    told = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    truth = {i: t for i, _, t in rows}
    got = [(r.predicted, truth[r.doc_id]) for r in toxicity.score_documents(docs, told).collect() if r.held_out]
    assert sum(t for _, t in got) > 300
    assert sum(p and t for p, t in got) >= 0.95 * sum(t for _, t in got)
    assert sum(p and t for p, t in got) >= 0.95 * sum(p for p, _ in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs, none).collect()] == [0, 0] or [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.5, 0.5]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def brute_preferences(rows):
    """Segments by plain lists."""
    sides = defaultdict(lambda: defaultdict(list))
    for p, side, turn, role, text in rows:
        if p is not None and side in ("chosen", "rejected"):
            sides[p][side].append((math.inf if turn is None else turn, role or "", text or ""))
    out = Counter()
    for p, both in sides.items():
        placed = {}
        for side in ("chosen", "rejected"):
            seen, turns = Counter(), {}
            for turn, role, text in sorted(both[side]):
                seen[turn] += 1
                turns[turn, seen[turn]] = (role, text)
            placed[side] = turns
        places = sorted(set(placed["chosen"]) | set(placed["rejected"]))
        fork = next((x for x in places if placed["chosen"].get(x) != placed["rejected"].get(x)), (math.inf, math.inf))
        for x in places:
            for part, side in ([("prompt", "chosen")] if x < fork else [("chosen", "chosen"), ("rejected", "rejected")]):
                if x in placed[side]:
                    role, text = placed[side][x]
                    out[p, part, None if x[0] == math.inf else x[0], x[1], f"<|im_start|>{role}\n", f"{text}<|im_end|>\n", part != "prompt" and role == "assistant"] += 1
    return out


def test_preferences_equal_plain_lists(spark):
    picks = random.Random(8)
    rows = []
    for p in range(40):
        prompt = [(t, picks.choice(["user", "assistant", "system", None]), picks.choice(["same", None, ""])) for t in range(picks.randint(0, 5))]
        for side in ("chosen", "rejected"):
            tail = [(len(prompt) + t, picks.choice(["user", "assistant"]), picks.choice(["x", "y", None])) for t in range(picks.randint(0, 3))]
            rows += [(p, side, *turn) for turn in prompt + tail]
    rows += [(100, "chosen", 0, "user", "only one side"), (101, "chosen", None, "assistant", "late"), (101, "rejected", None, "assistant", "other"), (None, "chosen", 0, "user", "x"), (102, "third", 0, "user", "x"), (103, "chosen", 0, "user", "twice"), (103, "chosen", 0, "user", "twice"), (103, "rejected", 0, "user", "twice")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "pair_id long, side string, turn long, role string, text string, part int, nth string")
    found = preference.format_preferences(frame)
    got = Counter((r.pair_id, r.part, None if r.turn == (1 << 63) - 1 else r.turn, r.nth, r["head"], r.body, r.learn) for r in found.collect())
    assert got == brute_preferences(rows)
    whole, larger = preference.assemble(found, limit=10**6)
    assert larger.count() == 0
    for r in whole.collect():
        for part, spans in (("chosen", r.chosen_spans), ("rejected", r.rejected_spans)):
            learnt = "".join(r[part][s.start : s.stop] for s in spans)
            want = [(t, n, b) for (p, q, t, n, _, b, m) in got.elements() if p == r.pair_id and q == part and m]
            assert learnt == "".join(b for *_, b in sorted(want, key=lambda x: (math.inf if x[0] is None else x[0], x[1])))
    assert preference.assemble(found, limit=5)[1].count() > 0
    assert preference.format_preferences(frame.limit(0)).count() == 0


def test_own_reply_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "open"), (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "no reply"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, side string")
    got = {tuple(r) for r in preference.own_reply_pairs(frame).filter("side = 'rejected'").collect()}
    assert got == {(1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "a1"), (1, "rejected", 2, "user", "q2"), (1, "rejected", 3, "assistant", "a1"), (2, "rejected", 0, "user", "q"), (2, "rejected", 1, "assistant", "")}
    assert preference.own_reply_pairs(frame.limit(0)).count() == 0
