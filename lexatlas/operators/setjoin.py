"""Set-similarity join: prefix index over rare tokens, size and position filters, verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.operators.joins import bounded_join

#: Slack of the bounds computed in doubles; a pair that passes by it is verified anyway.
SLACK = 1e-9
#: Right sets of one block, about; a left set is copied to each block that it has a pair in.
BLOCK_SETS = 256
#: Places of a set's tokens by their hashes; two sets differ in as many tokens as these differ in places, at least.
MARKS = 1024
#: Ranges of token hashes whose sizes order the tokens.
BUCKETS = 1 << 18


def _weights(hashes: DataFrame) -> np.ndarray:
    """How many tokens fall into each of ``BUCKETS`` ranges of their hash; the driver sees this one bounded list."""
    counted = hashes.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("f"))
    rows = counted.toPandas()
    weights = np.zeros(BUCKETS, np.int64)
    weights[rows["b"].to_numpy(np.int64)] = rows["f"].to_numpy(np.int64)
    return weights


def _prefix(weights: Broadcast, threshold: float) -> Callable[[Column], Column]:
    """The first n - ceil(threshold n) + 1 hashes of a set, from the least weight on, ties by hash."""

    @F.pandas_udf("array<long>")
    def first(sets: pd.Series) -> pd.Series:
        def one(hashes: np.ndarray) -> np.ndarray:
            kept = len(hashes) - math.ceil(threshold * len(hashes) - SLACK) + 1
            return hashes[np.lexsort((hashes, weights.value[hashes % BUCKETS]))[:kept]]

        return pd.Series([one(np.asarray(h, np.int64)) for h in sets], dtype=object)

    return first


@F.pandas_udf(T.ArrayType(T.LongType()))
def _marks(sets: pd.Series) -> pd.Series:
    """Whether an odd number of a set's hashes falls on each of ``MARKS`` places, as bits of longs."""

    def one(hashes: np.ndarray) -> np.ndarray:
        odd = np.bincount(np.asarray(hashes, np.int64) % MARKS, minlength=MARKS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    return pd.Series([one(h) for h in sets], dtype=object)


def similar_sets(
    left: DataFrame, right: DataFrame, threshold: float, scope: Sequence[str] = (), left_id: str = "left_id", right_id: str = "right_id"
) -> DataFrame:
    """Pairs whose token sets have a Jaccard index of ``threshold`` or more: scope, left_id, right_id, common, similarity.

    Both sides hold the columns of ``scope`` (pairs agree in them), an id that
    is unique within it and ``tokens`` (array of different strings). Tokens
    are ordered by how often the sets hold tokens of their hash's bucket, which
    takes no exchange of the sets. Two similar sets share a
    token among the first n - ceil(threshold n) + 1 of each, so only these
    few, rare tokens are joined, by hash; a pair met there goes on if sizes and the
    tokens left behind the place of meeting still allow the threshold, and is
    then verified on the whole sets, which travel to blocks of alike sets and not to each pair. Empty sets are similar to none.
    """
    one = left.select(*scope, F.col(left_id).alias("_id"), "tokens").where(F.size("tokens") > 0)
    two = right.select(*scope, F.col(right_id).alias("_id"), "tokens").where(F.size("tokens") > 0)
    # Kept as eight bytes a token, so that the tokens are made once for the buckets and the prefixes.
    hashed = [sets.select(*scope, "_id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")).withColumn("m", _marks("h")).persist() for sets in (one, two)]
    weights = _weights(hashed[0].select("h").unionByName(hashed[1].select("h")))
    first = _prefix(one.sparkSession.sparkContext.broadcast(weights), threshold)

    def prefix(sets: DataFrame, name: str) -> DataFrame:
        told = sets.select(*scope, F.col("_id").alias(name), F.size("h").alias(f"{name}_n"), first(F.col("h")).alias("h"))
        return told.select(*scope, name, f"{name}_n", F.posexplode("h").alias(f"{name}_at", "token"))

    a, b = prefix(hashed[0], left_id), prefix(hashed[1], right_id)
    na, nb = F.col(f"{left_id}_n"), F.col(f"{right_id}_n")
    sizes = (na >= nb * threshold - SLACK) & (nb >= na * threshold - SLACK)
    ahead = F.least(na - F.col(f"{left_id}_at"), nb - F.col(f"{right_id}_at"))  # tokens from the place of meeting on
    # The first common token of a pair is met with all of the overlap still ahead of both places.
    needed = F.ceil((na + nb) * (threshold / (1 + threshold)) - SLACK)
    met = a.join(b, [*scope, "token"]).where(sizes & (ahead >= needed)).select(*scope, left_id, right_id).distinct()
    # Most pairs that met are not similar; a few bytes of each set tell, before whole sets travel.
    marked = [sets.select(*scope, F.col("_id").alias(name), F.size("h").alias(f"{name}_n"), F.col("m").alias(f"{name}_m")) for sets, name in zip(hashed, (left_id, right_id), strict=True)]
    met = met.join(marked[0], [*scope, left_id]).join(marked[1], [*scope, right_id])
    unlike = sum(F.bit_count(F.col(f"{left_id}_m")[i].bitwiseXOR(F.col(f"{right_id}_m")[i])) for i in range(MARKS // 64))
    met = met.where((na + nb - unlike) / 2 >= needed).select(*scope, left_id, right_id).distinct().persist()

    def wanted(sets: DataFrame, name: str, tokens: str) -> DataFrame:
        """The sets that were met; where their ids fit a broadcast, no other set is exchanged."""
        named = sets.withColumnsRenamed({"_id": name, "tokens": tokens})
        return bounded_join(named, met.select(*scope, name).distinct(), [*scope, name], F.col(name), "left_semi")

    # Similar sets mostly have the same least hash, so a left set finds its partners in few blocks and is sent to each once, not to each partner.
    home = [*scope, "_home", "_part"]
    homes = hashed[1].select(*scope, F.col("_id").alias(right_id), F.array_min("h").alias("_home")).distinct()
    crowd = F.count(F.lit(1)).over(Window.partitionBy(*scope, "_home"))
    homes = homes.join(met.select(*scope, right_id).distinct(), [*scope, right_id], "left_semi")
    homes = homes.withColumn("_part", F.pmod(F.xxhash64(right_id), F.ceil(crowd / BLOCK_SETS)))
    least = F.array_min(F.transform("_b", lambda t: F.xxhash64(t)))
    beside = wanted(two, right_id, "_b").withColumn("_home", least).join(homes, [*scope, right_id, "_home"])
    partners = met.join(homes, [*scope, right_id]).groupBy(*scope, left_id, "_home", "_part").agg(F.collect_set(right_id).alias("_partners"))
    told = partners.join(wanted(one, left_id, "_a"), [*scope, left_id]).join(beside, home).where(F.array_contains("_partners", F.col(right_id)))
    common: Column = F.size(F.array_intersect("_a", "_b"))
    found = told.select(*scope, left_id, right_id, common.alias("common"), (common / (F.size("_a") + F.size("_b") - common)).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)
