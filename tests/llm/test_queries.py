"""The registered queries against their SQL on the smallest tables, and the pipeline's stages against brute force."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lexatlas.llm import mixing, toxicity, wand
from lexatlas.llm.queries import ORACLES, QUERIES

from test_text_operators import brute_components, brute_lines, reference_ids

FOLDER = os.environ.get("LEXATLAS_DATA", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    sql = duckdb.connect()
    for t in TABLES:
        sql.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    cursor = sql.execute(ORACLES[name])
    found, names = [c[0] for c in cursor.description], sorted(frame.columns)
    assert sorted(found) == names
    want = Counter(tuple(r[found.index(c)] for c in names) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in frame.collect()) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("block", [1024, 3])
def test_documents_as_questions_match_sql(spark, monkeypatch, block):
    """The SQL of op9 with each document whose id is divisible by 20 as an item of its benchmark."""
    monkeypatch.setattr(wand, "QUESTION_BLOCK", block)
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    sql.execute("create view benchmark as select doc_id as item_id, text from documents where doc_id % 20 = 0")
    want = Counter(sql.execute(f"select query_id, rank, doc_id, score from ({ORACLES['op9_bm25_topk']})").fetchall())
    got = QUERIES["op9_bm25_documents"](spark, FOLDER).select("query_id", "rank", "doc_id", "score").collect()
    assert len({q for q, *_ in want}) == 10 and Counter(tuple(r) for r in got) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_near_duplicates_of_the_table(spark):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, FOLDER).collect()]
    assert [c for *_, c in got] == brute_components([(d, f) for d, f, _ in got])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_nearest_of_the_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = defaultdict(list)
    for r in QUERIES["op3_lsh_forest"](spark, FOLDER).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-float(v @ w), i) for i, w in rows if i != q)[:20]
            hits += len({i for _, i in best} & {i for _, i in found[q]})
            total += len(best)
            assert sorted(k for k, _ in found[q]) == list(range(1, len(best) + 1))
    assert hits >= 0.9 * total


def test_stages_equal_brute_force(spark, tmp_path):
    picks = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        text = [" ".join(picks.choice(vocabulary) for _ in range(30)) for _ in range(4)]
        toxic = i % 4 == 0
        if toxic:
            text[1] += " scum"
        if i > 150:
            text = rows[i - 100][1].split("\n")  # copies
        rows.append((i, "\n".join(text), "abc"[i % 3]))
        labels.append((i, 1, int(toxic)))
    rows += [(500, None, "a"), (501, "", None), (None, "no id at all in this one", "b")]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "extra") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    told.write.parquet(str(tmp_path / "labels.parquet"))
    folder, current, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in current.collect()]
        result = stage(spark, current, folder)
        if name != "packing":
            assert result.columns == docs.columns
        result.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        after = current.collect()
        kept[name] = after
        if name == "toxicity":
            scores = toxicity.score_documents(docs, told).collect()
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in scores if not r.predicted)
            assert not any("scum" in (r.text or "") for r in after) and len(after) >= 0.7 * len(rows)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in after} == brute_lines(before, 8) and len(after) == len(before)
        elif name == "simhash_near_dedup":
            from lexatlas.llm.simhash import fingerprint

            roots = brute_components([(i, f"{fingerprint(t) & (1 << 64) - 1:016x}") for i, t, _ in before])
            assert Counter(r.doc_id for r in after) == Counter(set(roots))
        elif name == "source_mixing":
            sizes = {i: len((t or "").split()) for i, t, _ in before}
            taken = Counter()
            for r in after:
                taken[r.doc_id] += len(r.text.split())
            plan = mixing.mix(spark.createDataFrame(before, "doc_id long, text string, source string"), block=mixing.TEXT_BLOCK)
            want = {r.source: r.target for r in plan.sources.collect()}
            by_source = Counter()
            for i, _, s in before:
                by_source[s] += taken[i]
            assert all(taken[i] <= 3 * sizes[i] for i in sizes)
            assert all(abs(by_source[s] - t) <= mixing.TEXT_BLOCK for s, t in want.items())
        else:
            ids = {(i, t): [*x, 1] for (i, t, _), x in zip(before, reference_ids([t for _, t, _ in before]))}
            want = Counter((i, at, zlib.crc32(np.array(v[at : at + 2048], "<u4").tobytes())) for (i, t, _) in before for v in [ids[i, t]] for at in range(0, len(v), 2048))
            assert Counter((r.doc_id, r.start, r.ids_crc32) for r in after) == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.ids_crc32) for r in kept["packing"])


def test_stage_links_at_five_word_similarity(spark):
    """Copies with words replaced: those at 0.8 or more go, also through others, and those below stay."""
    picks = random.Random(21)
    rows = []
    for g in range(40):
        base = [f"g{g}w{picks.randint(0, 9999)}" for _ in range(200)]
        for c in range(5):
            copy = list(base)
            for at in picks.sample(range(5, 195, 8), [0, 2, 4, 7, 10][c]):
                copy[at] = f"new{picks.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, " "), (902, "a few words"), (903, "A few  words"), (None, "no id"), (None, "no id"), (None, rows[0][1]), (902, "a few words")]

    def pieces(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [pieces(t) for _, t in rows], list(range(len(rows)))
    levels = set()
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                levels.add(round(both / either, 2) if either else 1.0)
                root = [root[j] if r == root[i] else r for r in root]
    assert any(0.8 <= x < 0.85 for x in levels) and any(0.85 <= x < 0.95 for x in levels)
    groups = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        groups[r].append(i)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("kept"))
    got = stage(spark, frame, "")
    assert got.columns == frame.columns and Counter(r.doc_id for r in got.collect()) == want
    assert stage(spark, frame.limit(0), "").count() == 0


def test_stage_compares_simhash_groups(spark):
    """Similar texts whose fingerprints differ by a few bits meet through their bits alone, without a common band."""
    from lexatlas.llm import similar

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(["new", *words[1:]]), " ".join(f"other{i}" for i in range(400))]
    assert (similar.simhash(similar.shingles(texts[0])) ^ similar.simhash(similar.shingles(texts[1]))).bit_count() <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = docs.select("doc_id", *similar.text_hashes(), similar._prints(F.col("text")).alias("s")).select("doc_id", "t1", "t2", "s.*").persist()
    apart = prints.drop("doc_id").withColumn("bands", F.array(F.col("fp")))
    of = {r.fp: r.doc_id for r in prints.collect()}
    assert [{of[r.a], of[r.b]} for r in similar.set_links(apart, docs).collect()] == [{0, 1}]
