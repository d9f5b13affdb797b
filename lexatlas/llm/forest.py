"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree gives a vector a long string of bits, one per random hyperplane, and
keeps the strings in sorted arrays, cut into fragments by their first bits.
Vectors that share a long prefix are likely near. A question descends each
tree to its longest matches; the scores found there tell how near its k best
must be, hence how likely two such vectors share a prefix of any length. The
question then ascends all trees together to the longest prefix at which the
expected recall over all trees reaches the target, and everything under that
prefix is compared exactly. On clustered vectors this stops deep in the trees;
where all vectors are about equally far apart it climbs near the root, as any
exact enough search must.

Inner products are turned into angles by one more component that fills every
vector up to the largest norm. Copies of one vector are indexed once; only the
k + 1 smallest ids of a copied vector can be among anyone's k nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.llm.common import save

#: Trees, bits of a string, and the recall that ascending aims at.
TREES, BITS, RECALL = 16, 32, 0.95
#: Rows of a fragment, questions that meet one at once, and matches looked at on either side when descending.
FRAGMENT_ROWS, QUESTION_ROWS, NEIGHBOURS = 4096, 16384, 64
#: Vectors kept beyond k until scores are exact.
SPARE = 4


def usable(vectors: DataFrame) -> DataFrame:
    """One vector per vec_id (the smallest), finite, not zero, and of the commonest dimension (the larger of equals)."""
    real = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = real.filter(finite & F.exists("v", lambda x: x != 0))
    size = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return sound.filter(F.size("v") == (size["d"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _planes(dimension: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension + 1, trees * BITS))


def _codes(vectors: np.ndarray, longest: float, planes: np.ndarray, trees: int) -> np.ndarray:
    """Strings of each vector in each tree, as numbers of ``BITS`` bits."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)) if longest else np.zeros(len(vectors))
    bits = (np.column_stack([vectors, rest]) @ planes > 0).reshape(len(vectors), trees, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _hashed(frame: DataFrame, dimension: int, longest: float, trees: int, seed: int) -> DataFrame:
    """Rows (id, v, tree, code) of each vector and tree; ``longest`` 0 for questions, which need no filling up."""

    def hash_rows(batches):
        planes = _planes(dimension, trees, seed)
        for batch in batches:
            if len(batch):
                codes = _codes(np.stack(batch["v"].to_numpy()), longest, planes, trees)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "codes": list(codes)})

    hashed = frame.select("id", "v").mapInPandas(hash_rows, "id long, v array<double>, codes array<long>")
    return hashed.select("id", "v", F.posexplode("codes").alias("tree", "code"))


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > keep:
        part = np.argpartition(-scores, keep - 1)[:keep]
        ids, scores = ids[part], scores[part]
    return ids, scores


def _answers(question: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64", "score": "float64"})
    return pd.DataFrame(
        {"q": np.repeat(question, [len(i) for i, _ in found]), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])}
    )


class Forest:
    """An index over ``reps`` (id, v): fragments of the trees' sorted arrays."""

    def __init__(self, reps: DataFrame, dimension: int, longest: float, rows: int, trees: int = TREES, seed: int = 11):
        self.dimension, self.longest, self.trees, self.seed = dimension, longest, trees, seed
        self.top = max(0, math.ceil(math.log2(max(1, rows) / FRAGMENT_ROWS)))
        hashed = _hashed(reps, dimension, longest, trees, seed)
        self.rows = save(hashed.withColumn("bucket", F.shiftrightunsigned("code", BITS - self.top)), "forest")
        sizes = self.rows.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"))
        self.sizes = save(sizes.select("tree", "bucket", F.ceil(F.col("n") / FRAGMENT_ROWS).alias("parts")), "fragments")

    def hash_questions(self, questions: DataFrame) -> DataFrame:
        return _hashed(questions, self.dimension, 0.0, self.trees, self.seed)

    def visit(self, asked: DataFrame, search) -> DataFrame:
        """Meet questions (id, v, tree, code, depth, bucket) with the fragments of their bucket; ``search`` sees both as pandas.

        A bucket of many vectors is several fragments, and one asked by many
        questions meets them block by block.
        """
        asked = asked.join(self.sizes, ["tree", "bucket"])
        blocks = asked.groupBy("tree", "bucket").agg(F.ceil(F.count(F.lit(1)) / QUESTION_ROWS).alias("blocks"))
        asked = asked.join(blocks, ["tree", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        held = self.rows.join(self.sizes, ["tree", "bucket"]).join(blocks, ["tree", "bucket"])
        held = held.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        key = ["tree", "bucket", "part", "block"]
        left = asked.select(*key, "id", "v", "code", "depth").groupBy(*key)
        return left.cogroup(held.select(*key, "id", "v", "code").groupBy(*key)).applyInPandas(search, "q long, id long, score double")

    def descend(self, questions: DataFrame, keep: int) -> DataFrame:
        """Scores of the longest prefix matches of each question in each tree: (q, id, score)."""

        def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return _answers([], [])
            held = held.sort_values("code", kind="stable")
            codes, ids, vectors = held["code"].to_numpy(), held["id"].to_numpy(), np.stack(held["v"].to_numpy())
            at = np.searchsorted(codes, asked["code"].to_numpy())
            found = []
            for place, vector in zip(at, asked["v"], strict=True):
                near = slice(max(0, place - NEIGHBOURS), place + NEIGHBOURS)
                found.append(_best(ids[near], vectors[near] @ vector, keep))
            return _answers(asked["id"].tolist(), found)

        top = self.top
        own = self.hash_questions(questions).withColumn("bucket", F.shiftrightunsigned("code", BITS - top)).withColumn("depth", F.lit(top))
        return self.visit(own, search)

    def ascend(self, questions: DataFrame, depths: DataFrame, keep: int) -> DataFrame:
        """The best of all vectors that share a prefix of ``depth`` bits with the question in any tree: (q, id, score)."""
        top = self.top

        def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return _answers([], [])
            held = held.sort_values("code", kind="stable")
            codes, ids, vectors = held["code"].to_numpy(), held["id"].to_numpy(), np.stack(held["v"].to_numpy())
            numbers, found = [], []
            whole = asked[asked["depth"] <= top]
            for at in range(0, len(whole), 256):
                part = whole.iloc[at : at + 256]
                scores = np.stack(part["v"].to_numpy()) @ vectors.T
                numbers += part["id"].tolist()
                found += [_best(ids, row, keep) for row in scores]
            for row in asked[asked["depth"] > top].itertuples(index=False):
                shift = BITS - row.depth
                low, high = np.searchsorted(codes, [row.code >> shift << shift, ((row.code >> shift) + 1) << shift])
                numbers.append(row.id)
                found.append(_best(ids[low:high], vectors[low:high] @ row.v, keep))
            return _answers(numbers, found)

        asked = self.hash_questions(questions).join(depths.withColumnRenamed("q", "id"), "id")
        # All buckets below the prefix where it is shorter than a bucket's own, else the one bucket.
        prefix, below = f"shiftrightunsigned(code, {BITS} - least(depth, {top}))", f"{top} - least(depth, {top})"
        first, last = F.expr(f"shiftleft({prefix}, {below})"), F.expr(f"shiftleft({prefix} + 1, {below}) - 1")
        return self.visit(asked.withColumn("bucket", F.explode(F.sequence(first, last))), search)


def _best_per_question(found: DataFrame, keep: int) -> DataFrame:
    """A vector found in several trees counts once."""
    once = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return once.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank")


def expected_depth(cosines: list[float], k: int, trees: int = TREES, recall: float = RECALL) -> int:
    """Longest prefix at which vectors this near are found in some tree, on average, with probability ``recall``."""
    if len(cosines) < k:
        return 0
    agree = 1 - np.arccos(np.clip(np.array(cosines), -1, 1)) / np.pi
    depth = np.arange(BITS + 1)[:, None]
    met = (1 - (1 - agree[None, :] ** depth) ** trees).mean(axis=1)
    return int(np.flatnonzero(met >= recall)[-1])


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The k nearest by inner product of every row that ``is_query`` holds for: query_id, rank, vec_id, score.

    Candidates are all rows but the question's own. Rows with a null id, and
    vectors that are null, zero, hold null or non-finite components or have
    another than the commonest dimension, take no part; of rows that repeat an
    id the smallest vector counts; copies under other ids count each; ties go
    to the smaller id; other columns are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = save(usable(embeddings), "vectors")
    copies = Window.partitionBy("v").orderBy("vec_id")
    # Partial group limits keep a vector that a third of all rows repeat from being gathered.
    limited = vectors.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1)
    limited = save(limited.withColumn("rep", F.first("vec_id").over(copies)), "copies")
    reps = limited.filter("_n = 1").select(F.col("vec_id").alias("id"), "v")
    asked = save(vectors.filter(is_query).withColumn("q", F.min("vec_id").over(Window.partitionBy("v"))), "asked")
    questions = save(asked.filter("vec_id = q").select(F.col("q").alias("id"), "v"), "questions")
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.sqrt(dot(F.col("v"), F.col("v")))).alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(reps, facts["d"], facts["longest"], facts["n"], trees)
    longest, wanted = facts["longest"], min(k, facts["n"])

    seen = _best_per_question(forest.descend(questions, k), k).groupBy("q").agg(F.collect_list("score").alias("scores"))
    norms = questions.select(F.col("id").alias("q"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm"))

    @F.pandas_udf("int")
    def depth_for(scores: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series([0 if s is None else expected_depth([x / (n * longest) for x in s], wanted, trees, recall) for s, n in zip(scores, norm, strict=True)], dtype="int32")

    depths = save(norms.join(seen, "q", "left").select("q", depth_for("scores", "norm").alias("depth")), "depths")
    best = _best_per_question(forest.ascend(questions, depths, k + 1 + SPARE), k + 1 + SPARE)

    # Exact scores on the original vectors, then the copies' ids; bounded rows per question.
    pairs = best.select("q", F.col("id").alias("rep")).join(reps.select(F.col("id").alias("rep"), F.col("v").alias("found")), "rep")
    scored = pairs.join(questions.select(F.col("id").alias("q"), "v"), "q").select("q", "rep", dot(F.col("v"), F.col("found")).alias("score"))
    named = scored.join(limited.select("rep", "vec_id"), "rep").select("q", "vec_id", "score")
    shared = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    named = named.withColumn("_n", F.row_number().over(shared)).filter(F.col("_n") <= k + 1).drop("_n")
    answers = asked.select(F.col("vec_id").alias("query_id"), "q").join(named, "q").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
