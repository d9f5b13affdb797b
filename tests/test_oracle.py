"""Registered queries against their SQL on the smallest tables.

A representative set runs by default; LEXATLAS_ALL=1 runs every one.
"""

import os

import duckdb
import pytest

from lexatlas.plans import registry

FOLDER = os.environ.get("LEXATLAS_DATA", "/root/testdata/sf0.001")
TABLES = "events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.load()
SHORT = (
    "token_counts", "token_windows", "law_names_from_urls", "repeated_lines_dropped", "corpus_xor_hash", "review_buckets", "bm25_top100", "knn_filtered_topk",
    "knn_grid_topk", "aggregate_documents", "rrf_three_source_weighted", "macro_recall_precision", "candidate_depth_metrics", "failure_buckets", "fold_violations",
    "mine_negatives", "training_bands", "clean_documents", "page_edges_removed", "structure_nodes", "statute_parents", "sentence_scores", "citations_verified",
)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("LEXATLAS_ALL") else SHORT)
def test_query_matches_sql(spark, sql, name):
    frame = QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    cursor = sql.execute(ORACLES[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    rows = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)
    expected = sorted((tuple(r[found.index(c)] for c in names) for r in cursor.fetchall()), key=repr)
    assert rows == expected
