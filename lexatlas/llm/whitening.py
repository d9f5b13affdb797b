"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Components become integers (256ths), so the scatter of the different vectors
is an exact integer matrix. Its characteristic polynomial is found modulo many
primes, each by reduction to Hessenberg form in a task of its own, and put
together by Chinese remaindering. As the matrix is symmetric, all roots are
real, and Descartes' rule counts those above any bound exactly; halving
intervals isolates the largest roots to many digits. A component is the null
space at a root, found by inverse iteration at the same precision.

Only the matrix, whose size depends on the dimension alone, reaches the driver.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.common import save, scratch

SCALE, COMPONENTS = 256, 4
#: Decimal digits of roots and null spaces, and bits of a limb of exact sums.
DIGITS, LIMB = 80, 30
#: Primes of one task, and the largest prime used: products of two stay below 2**62.
TASK_PRIMES, LARGEST = 16, (1 << 31) - 1
LONGEST = (1 << 63) - 1


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, x) of the sound vectors of the commonest dimension (the larger of equals): floor(256 c), held within 64 bits."""
    real = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    sound = real.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))
    size = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    bound = F.lit(float(1 << 62))

    def whole(c):
        scaled = c * F.lit(float(SCALE))
        return F.when(scaled >= bound, F.lit(1 << 62)).when(scaled <= -bound, F.lit(-(1 << 62))).otherwise(F.floor(F.greatest(F.least(scaled, bound), -bound))).cast("long")

    return sound.filter(F.size("v") == (size["d"] if size else 0)).select("vec_id", F.transform("v", whole).alias("x"))


def _exact(rows: np.ndarray) -> np.ndarray:
    """The rows as numbers that sums of products of two cannot overflow."""
    largest = int(np.abs(rows).max(initial=0))
    return rows if largest * largest * len(rows) < 1 << 62 else rows.astype(object)


def scatter(fit: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums, and sums of products of the rows' entries, as exact integers.

    Tasks sum their batches; Spark adds the tasks' sums limb by limb, so what
    comes to the driver depends on the dimension alone.
    """

    def batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = _exact(np.stack(batch["x"].iloc[at : at + 1024].to_numpy()))
                count += len(rows)
                sums = sums + rows.sum(axis=0).astype(object)
                products = products + (rows.T @ rows).astype(object)
        if count:
            cells = [count, *sums.tolist(), *[products[i, j] for i in range(dimension) for j in range(i, dimension)]]
            out = []
            for cell, value in enumerate(cells):
                sign, value = (-1, -value) if value < 0 else (1, value)
                limb = 0
                while value or not limb:
                    out.append((cell, limb, sign * (value & (1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
            yield pd.DataFrame(out, columns=["cell", "limb", "value"])

    cells: dict[int, int] = {}
    parts = fit.select("x").mapInPandas(batches_of, "cell int, limb int, value long")
    for row in parts.groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():  # dimension squared
        cells[row["cell"]] = cells.get(row["cell"], 0) + (row["value"] << LIMB * row["limb"])
    products = [[0] * dimension for _ in range(dimension)]
    cell = 1 + dimension
    for i in range(dimension):
        for j in range(i, dimension):
            products[i][j] = products[j][i] = cells.get(cell, 0)
            cell += 1
    return cells.get(0, 0), [cells.get(1 + i, 0) for i in range(dimension)], products


def primes_below(limit: int, bits: int) -> list[int]:
    """The largest primes below ``limit`` whose product has more than ``bits`` bits."""
    found, number, total = [], limit, 0.0
    while total <= bits + 1:
        if number % 2 and all(pow(a, (number - 1) // 2, number) in (1, number - 1) for a in (2, 3, 5, 7)) and _strong(number):
            found.append(number)
            total += math.log2(number)
        number -= 1
    return found


def _strong(number: int) -> bool:
    """Miller-Rabin to the bases that decide below 3.2 10**9."""
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, number)
        if x in (1, number - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % number
            if x == number - 1:
                break
        else:
            return False
    return True


def polynomial_modulo(matrix: np.ndarray, prime: int) -> list[int]:
    """Coefficients of det(x I - M) modulo a prime, lowest first, by reduction to Hessenberg form."""
    h, p = matrix.astype(np.int64) % prime, prime
    n = len(h)
    for m in range(1, n - 1):
        rows = np.flatnonzero(h[m:, m - 1])
        if not len(rows):
            continue
        pivot = m + int(rows[0])
        if pivot != m:
            h[[pivot, m]] = h[[m, pivot]]
            h[:, [pivot, m]] = h[:, [m, pivot]]
        inverse = pow(int(h[m, m - 1]), -1, p)
        factors = h[m + 1 :, m - 1] * inverse % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    known = np.zeros((n + 1, n + 1), np.int64)
    known[0, 0] = 1
    for k in range(1, n + 1):
        known[k, 1:] = known[k - 1, :-1]
        known[k] = (known[k] - h[k - 1, k - 1] * known[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            known[k] = (known[k] - below * int(h[k - i - 1, k - 1]) % p * known[k - i - 1]) % p
    return known[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first; primes are dealt to tasks, remainders come back."""
    n = len(matrix)
    trace = sum(matrix[i][i] for i in range(n))
    # Coefficients of a positive semidefinite matrix are at most binomials times powers of the trace's share of each root.
    bits = n + n * max(1, (abs(trace) + 1).bit_length()) + 2
    primes = primes_below(LARGEST, bits)
    shared = spark.sparkContext.broadcast(matrix)  # dimension squared

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array(shared.value, dtype=object)
        for batch in batches:
            found = [polynomial_modulo((whole % int(p)).astype(np.int64), int(p)) for p in batch["prime"]]
            yield pd.DataFrame({"prime": batch["prime"], "coefficients": found})

    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(max(1, len(primes) // TASK_PRIMES))
    product, found = 1, [0] * (n + 1)
    for row in dealt.mapInPandas(reduce, "prime long, coefficients array<long>").toLocalIterator():  # as many rows as primes
        prime = row["prime"]
        inverse = pow(product, -1, prime)
        found = [c + product * ((r - c) * inverse % prime) for c, r in zip(found, row["coefficients"], strict=True)]
        product *= prime
    return [c - product if c > product // 2 else c for c in found]


def roots_above(polynomial: list[int], bound: int, shift: int) -> int:
    """How many roots of a polynomial with real roots only exceed bound / 2**shift: sign changes of p(x + bound)."""
    n = len(polynomial) - 1
    moved = [c << shift * (n - i) for i, c in enumerate(polynomial)]  # roots times 2**shift
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            moved[j] += bound * moved[j + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def sign_at(polynomial: list[int], at: int, shift: int) -> int:
    """Sign of the polynomial at at / 2**shift."""
    n, value = len(polynomial) - 1, 0
    for i in range(n, -1, -1):
        value = value * at + (polynomial[i] << shift * (n - i))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int, bits: int) -> list[tuple[int, int]]:
    """The largest positive roots, times 2**bits and rounded up, with their multiplicity as far as this precision tells.

    An interval is halved by counting roots until it holds one simple root,
    from then on by the sign of the polynomial, which costs far less.
    """
    positive = roots_above(polynomial, 0, 0)
    top, found, seen = 2, [], 0
    while roots_above(polynomial, top, 0):
        top *= 2
    while seen < min(count, positive):
        low, high, inside = 0, top << bits, positive - seen  # root number seen + 1 lies in (low, high]
        # Halving at few bits first keeps the numbers small; each round refines the interval it is left with.
        for shift in [*range(0, bits, 64), bits]:
            step = bits - shift
            outer = (low, high, inside)
            low, high = low >> step, -(-high >> step)
            inside = roots_above(polynomial, low, shift) - seen if (low << step) != outer[0] else inside
            single = inside == 1 and (high << step == outer[1] or roots_above(polynomial, high, shift) == seen)
            while high - low > 1:
                middle = (low + high) // 2
                if single:
                    above = sign_at(polynomial, middle, shift) * (-1) ** seen < 0
                else:
                    here = roots_above(polynomial, middle, shift) - seen
                    above = here > 0
                    inside = here if above else inside
                    single = inside == 1
                low, high = (middle, high) if above else (low, middle)
            low, high = low << step, high << step
        many = inside if single else roots_above(polynomial, low, bits) - seen
        found.append((high, many))
        seen += many
        top = (high >> bits) + 2
    return found


def null_space(matrix: list[list[int]], root: decimal.Decimal, many: int) -> list[list[decimal.Decimal]]:
    """Unit vectors of the null space of M - root, by inverse iteration at the current precision."""
    n = len(matrix)
    a = [[decimal.Decimal(v) for v in row] for row in matrix]
    scale = max((abs(v) for row in a for v in row), default=decimal.Decimal(1)) or decimal.Decimal(1)
    tiny = scale.scaleb(-(decimal.getcontext().prec - 10))
    for i in range(n):
        a[i][i] -= root
    order = list(range(n))
    for c in range(n):
        pivot = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[pivot], order[c], order[pivot] = a[pivot], a[c], order[pivot], order[c]
        if abs(a[c][c]) < tiny:
            a[c][c] = tiny
        for r in range(c + 1, n):
            if a[r][c]:
                f = a[r][c] / a[c][c]
                top, row = a[c], a[r]
                row[c] = f
                for k in range(c + 1, n):
                    row[k] -= f * top[k]

    def solve(b: list[decimal.Decimal]) -> list[decimal.Decimal]:
        y = [b[i] for i in order]
        for i in range(n):
            y[i] -= sum(map(lambda p, q: p * q, a[i][:i], y[:i]), decimal.Decimal(0))
        for i in range(n - 1, -1, -1):
            y[i] = (y[i] - sum(map(lambda p, q: p * q, a[i][i + 1 :], y[i + 1 :]), decimal.Decimal(0))) / a[i][i]
        return y

    draws = np.random.default_rng(5)
    space = [[decimal.Decimal(v) for v in draws.integers(1, 1000, n).tolist()] for _ in range(many)]
    for _ in range(4):
        done: list[list[decimal.Decimal]] = []
        for vector in space:
            vector = solve(vector)
            for _ in range(2):
                for other in done:
                    f = sum(map(lambda p, q: p * q, vector, other), decimal.Decimal(0))
                    vector = [p - f * q for p, q in zip(vector, other, strict=True)]
            norm = sum((p * p for p in vector), decimal.Decimal(0)).sqrt()
            done.append([p / norm for p in vector])
        space = done
    return space


class Whitener:
    """Components of a fit: n, sums, and per component its unit vector and eigenvalue (of the covariance of x)."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, explained: np.ndarray):
        self.n, self.sums, self.vectors, self.values, self.explained = n, sums, vectors, values, explained

    def project(self, rows: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact deviation and whitened values of integer rows."""
        largest = max(int(np.abs(rows).max(initial=0)) * self.n + max(map(abs, self.sums), default=0), 1)
        safe = largest * largest * max(1, rows.shape[1]) < 1 << 62
        centred = (rows if safe else rows.astype(object)) * self.n - np.array(self.sums, dtype=np.int64 if safe else object)
        deviation = (centred * centred).sum(axis=1)
        exact = centred.astype(float) if safe else np.array([[v / self.n for v in row] for row in centred.tolist()], float).reshape(rows.shape)
        shares = exact / self.n if safe else exact
        return [min(int(d), LONGEST) for d in deviation.tolist()], shares @ self.vectors.T / np.sqrt(self.values)


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The components of the rows of ``fit`` (x), largest eigenvalue first; those with eigenvalue zero are left out."""
    spark = fit.sparkSession
    size = fit.select(F.size("x").alias("d")).first()
    dimension = size["d"] if size else 0
    n, sums, products = scatter(fit, dimension)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]  # n**2 times the covariance
    trace = sum(matrix[i][i] for i in range(dimension))
    if not trace:
        return Whitener(n, sums, np.empty((0, dimension)), np.empty(0), np.empty(0))
    polynomial = characteristic_polynomial(spark, matrix)
    bits = int(DIGITS * 3.33)
    vectors, values, explained = [], [], []
    with decimal.localcontext(prec=DIGITS + len(str(trace))):
        for root, many in largest_roots(polynomial, min(components, dimension), bits):
            exact = decimal.Decimal(root) / (1 << bits)
            for vector in null_space(matrix, exact, many):
                vectors.append([float(v) for v in vector])
                values.append(float(exact / n / n))
                explained.append(float(exact / trace))
    keep = slice(0, components)
    return Whitener(n, sums, np.array(vectors[keep]), np.array(values[keep]), np.array(explained[keep]))


def _identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, centred before multiplying."""
    many = len(model.values)
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def sums(mean: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(many if mean is None else many * many)
            for batch in batches:
                if len(batch):
                    white = shared.value.project(np.stack(batch["x"].to_numpy()))[1]
                    total += white.sum(axis=0) if mean is None else ((white - mean).T @ (white - mean)).ravel()
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

        rows = fit.select("x").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        return np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])]) / model.n

    mean = sums(None)
    return float(np.abs(sums(mean).reshape(many, many) - np.eye(many)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every sound row's vec_id per component: n, deviation, whitened, explained and identity_error.

    The fit list holds each different integer vector once. Rows whose vector
    is null or holds null or non-finite entries take no part, nor do empty
    vectors and those of another than the commonest dimension. Ids may be null
    or repeat; components of eigenvalue zero do not exist, so equal vectors
    alone give no rows, nor does an empty table; other columns are not read.
    Entries beyond 2**62 count as that, deviations beyond 64 bits as 2**63 - 1.
    """
    spark = embeddings.sparkSession
    with scratch(spark) as keep:
        rows = keep(integer_vectors(embeddings), "integers")
        fit = save(rows.select("x").distinct(), "fit")
        model = fit_whitener(fit, components)
        error = _identity_error(fit, model) if len(model.values) else 0.0
    shared = spark.sparkContext.broadcast(model)
    many = len(model.values)

    @F.pandas_udf("deviation long, whitened array<double>")
    def projected(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"deviation": pd.Series([], dtype="int64"), "whitened": []})
        deviation, white = shared.value.project(np.stack(vectors.to_numpy()))
        return pd.DataFrame({"deviation": deviation, "whitened": list(white)})

    if not many:
        rows = rows.filter(F.lit(False))
    placed = rows.select("vec_id", projected("x").alias("p")).select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]) if many else F.array(F.lit(0.0))
    return placed.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
