"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so the scatter M = n * sum(x x') - S S' is an integer matrix: n^2 times the
covariance. Tasks sum its parts exactly. The characteristic polynomial of M is found modulo one prime after the other,
each by a reduction to Hessenberg form in its own row of a Spark job, and put together by Chinese remainders; there are
enough primes for the largest coefficient that a matrix of this trace can have. All roots of the polynomial are
real, so the sign changes of its coefficients after a shift by `a` are exactly the number of roots above `a`, each as often
as it is repeated. Bisection with whole numbers isolates the largest roots, signs narrow each to `ROOT_BITS` bits, and
inverse iteration in fixed point gives the null space of M - root, which is the component.

Only the sums (a number for each pair of dimensions), the residues and the components pass through the driver; their size depends
on the dimension and not on the rows.

Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another
length than the most common one (ties: the longest). Repeated rows count as often as they come, a null id stays null. An empty
table and empty vectors give no rows. A direction without variance has `explained` 0 and null `whitened`, since nothing scales it to
one; fewer dimensions than components give as many components. Roots nearer than 2^-`GROUP_BITS` of their size count as one,
with any orthonormal basis of their space. Entries of 2^40 or more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.plans.shared import settle

COMPONENTS, UNITS = 8, 1024
ROOT_BITS, GROUP_BITS, FIXED = 160, 128, 640
EXACT, LARGEST = 1 << 53, 1 << 40


def usable(rows: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """Rows whose vector is complete and finite and of the most common length, and that length (0: no rows)."""
    double = F.transform(vec_col, lambda c: c.cast("double"))
    finite = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.where(F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    size = F.size(vec_col).alias("d")
    top = whole.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = top["d"] if top else 0
    return whole.where(F.size(vec_col) == d), d


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    """floor(UNITS * entry) as doubles, a row for each vector: a constant added to all would change no result."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    y = np.floor(flat * UNITS).reshape(len(column), d)
    if y.size and np.abs(y).max() >= LARGEST:
        raise ValueError(f"an embedding entry of {LARGEST // UNITS} or more: the sums would not be exact")
    return y


def exact_product(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers: doubles as long as no sum can pass 2^53, whole numbers beyond."""
    d, total = y.shape[1], 0
    top = int(np.abs(y).max(initial=0)) ** 2 or 1
    step = EXACT // top
    if step < 64:
        whole = y.astype(np.int64).astype(object)
        return whole.T @ whole if len(y) else np.zeros((d, d), object)
    for low in range(0, len(y), step):
        part = y[low : low + step]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total + np.zeros((d, d), object)


def moments(vectors: DataFrame, vec_col: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sums of products) of the whole numbers, exactly."""
    schema = "i int, j int, v decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = whole_numbers(batch.column(0), d)
            n += len(y)
            sums = sums + y.astype(np.int64).astype(object).sum(axis=0)
            products = products + exact_product(y)
        cells = [(-1, -1, n)] + [(-1, j, sums[j]) for j in range(d)] + [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
        i, j, v = zip(*cells)
        values = pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "v"])

    parts = vectors.select(vec_col).mapInArrow(run, schema)
    n, sums, products = 0, [0] * d, np.zeros((d, d), object)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row for each pair of dimensions
        if j < 0:
            n = int(v)
        elif i < 0:
            sums[j] = int(v)
        else:
            products[i, j] = products[j, i] = int(v)
    return n, sums, products


def primes_below(top: int, product: int) -> list[int]:
    """Primes from `top` downwards until their product is above `product`."""

    def prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough for all numbers below 3,215,031,751
            x = pow(base, odd, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, so_far, n = [], 1, top | 1
    while so_far <= product:
        n -= 2
        if prime(n):
            found.append(n)
            so_far *= n
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of the characteristic polynomial modulo a prime below 2^31."""
    a, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        rows = np.flatnonzero(a[k + 1 :, k])
        if not len(rows):
            continue
        pivot = k + 1 + int(rows[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(axis=1)) % p
    grown = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k by k block
    grown[0, 0] = 1
    for k in range(d):
        row = -a[k, k] % p * grown[k] % p
        row[1:] += grown[k, :-1]
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            row = (row - int(a[i, k]) * chain % p * grown[i]) % p
        grown[k + 1] = row % p
    return grown[d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) for a symmetric integer matrix without negative eigenvalue."""
    d = len(matrix)
    trace = sum(int(matrix[k, k]) for k in range(d))
    # without their signs, coefficients are at most those of d equal roots of the same sum
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below((1 << 31) - 1, bound)
    cells = matrix.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(cells, object)
        for batch in batches:
            some = batch.column(0).to_pylist()
            images = [polynomial_mod((whole % p).astype(np.int64), p).tolist() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(images, pa.list_(pa.int64()))], names=["p", "c"])

    few = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(few)
    images = table.mapInArrow(run, "p long, c array<long>").collect()  # as many rows as primes
    product = 1
    for r in images:
        product *= r["p"]
    coefficients = [0] * (d + 1)
    for p, image in images:
        rest = product // p
        weight = rest * pow(rest % p, -1, p)
        for k, c in enumerate(image):
            coefficients[k] += (c if (d - k) % 2 == 0 else -c) % p * weight
    return [c % product * (-1) ** (d - k) for k, c in enumerate(coefficients)]


def largest_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(numerator, bits, times): the `wanted` largest positive roots, near numerator / 2^bits, and how often each is there.

    The polynomial has real roots only, none negative. The last root may bring more than are wanted.
    """
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d = len(poly) - 1
    wanted = min(wanted, d)
    if not wanted:
        return []

    def above(at: int, bits: int) -> int:
        c = [a << bits * (d - k) for k, a in enumerate(poly)]
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += at * c[j + 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(at: int, bits: int) -> int:
        total = 0
        for k in range(d, -1, -1):
            total = total * at + (poly[k] << bits * (d - k))
        return (total > 0) - (total < 0)

    def narrow(low: int, high: int, bits: int, rank: int) -> tuple[int, int]:
        over = -1 if rank % 2 else 1  # sign just above the root
        while (high - low) << ROOT_BITS > high:
            if high - low < 2:
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            there = sign(middle, bits)
            if not there:
                return middle, bits
            low, high = (low, middle) if there == over else (middle, high)
        return low + high, bits + 1

    found = []
    open_parts = [(0, -(-abs(poly[-2]) // abs(poly[-1])), 0, 0, d)]  # (low, high, bits, roots above high, roots above low)
    while open_parts:
        low, high, bits, over, under = open_parts.pop()
        if over >= wanted or over == under:
            continue
        if under - over == 1:
            found.append((over, *narrow(low, high, bits, over), 1))
        elif (high - low) << ROOT_BITS <= low:
            found.append((over, low + high, bits + 1, under - over))
        else:
            if high - low < 2:
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            between = above(middle, bits)
            open_parts += [(low, middle, bits, between, under), (middle, high, bits, over, between)]
    joined: list[tuple[int, int, int]] = []
    for _, number, bits, times in sorted(found):
        if joined:
            before, had, often = joined[-1]
            top = max(bits, had)
            gap = (before << top - had) - (number << top - bits)
            if gap << GROUP_BITS <= before << top - had:
                joined[-1] = (before, had, often + times)
                continue
        joined.append((number, bits, times))
    return joined


def null_space(matrix: np.ndarray, number: int, bits: int, times: int) -> list[np.ndarray]:
    """`times` orthonormal vectors of the eigenspace at number / 2^bits, by inverse iteration in fixed point."""
    d = len(matrix)
    a = np.array([[int(x) << FIXED for x in row] for row in matrix], object)
    for k in range(d):
        a[k, k] -= (number << FIXED) >> bits
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda r: abs(a[r, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = 1  # the root itself: as near to singular as the fixed point goes
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) >> FIXED

    def solve(v: np.ndarray) -> np.ndarray:
        x = v[order].copy()
        for k in range(d - 1):
            x[k + 1 :] -= a[k + 1 :, k] * x[k] >> FIXED
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> FIXED)) << FIXED) // a[k, k]
        return x

    random = np.random.default_rng(d)
    basis = [np.array([int(r) << FIXED for r in random.integers(-1000, 1000, d)], object) for _ in range(times)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for v in (solve(b) for b in basis):
            for _ in range(2):  # once more takes off what rounding left
                size = isqrt(int((v * v).sum())) or 1
                v = (v << FIXED) // size
                for u in done:
                    v = v - (u * (int((u * v).sum()) >> FIXED) >> FIXED)
            size = isqrt(int((v * v).sum())) or 1
            done.append((v << FIXED) // size)
        basis = done
    out = []
    for v in basis:
        unit = np.array([int(x) / (1 << FIXED) for x in v])
        out.append(unit if unit[np.abs(unit).argmax()] > 0 else -unit)
    return out


def fit(vectors: DataFrame, vec_col: str, d: int, wanted: int) -> dict:
    """n, sums of the whole numbers, and (eigenvalue, explained, unit vector) of the components by falling eigenvalue."""
    n, sums, products = moments(vectors, vec_col, d)
    matrix = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    trace = sum(int(matrix[k, k]) for k in range(d))
    parts: list[tuple[float, float, np.ndarray | None]] = []
    if trace:
        for number, bits, times in largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), min(wanted, d)):
            for unit in null_space(matrix, number, bits, times):
                parts.append((number / (n * n << bits), number / (trace << bits), unit))
    parts += [(0.0, 0.0, None)] * (min(wanted, d) - len(parts))
    return {"n": n, "sums": sums, "parts": parts[: min(wanted, d)]}


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error), a row for each vector and component."""
    vectors, d = usable(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), w array<double>"
    model = fit(vectors, "vec", d, components) if d else {"n": 0, "sums": [], "parts": []}
    n, sums, parts = model["n"], model["sums"], model["parts"]
    k = len(parts)
    scaled = np.array([unit / np.sqrt(e) if e else np.zeros(d) for e, _, unit in parts]).reshape(k, d)
    flat = [not e for e, _, _ in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small = np.array(sums, object), n * LARGEST < EXACT
        for batch in batches:
            y = whole_numbers(batch.column(1), d)
            if small or (y.size and n * int(np.abs(y).max()) + max(map(abs, sums)) < 1 << 62):
                centred = n * y.astype(np.int64) - np.array(sums, np.int64)
                exact = centred if not y.size or d * int(np.abs(centred).max()) ** 2 < 1 << 63 else centred.astype(object)
            else:
                centred = exact = n * y.astype(np.int64).astype(object) - total
            squares = [Decimal(int(s)) for s in (exact * exact).sum(axis=1)]
            w = (centred.astype(np.float64) / n) @ scaled.T
            cells = [[None if f else x for x, f in zip(row, flat)] for row in w.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(squares, pa.decimal128(38, 0)), pa.array(cells, pa.list_(pa.float64()))], names=["id", "deviation", "w"]
            )

    done = settle(vectors.mapInArrow(run, schema) if k else vectors.sparkSession.createDataFrame([], schema))
    error = identity_error(done, [i for i, f in enumerate(flat) if not f])
    shares = F.array(*[F.lit(share) for _, share, _ in parts]) if k else F.array().cast("array<double>")
    each = done.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(done: DataFrame, used: list[int]) -> float:
    """Largest absolute entry of the covariance of `w` (over all rows, centred first) minus the identity."""
    if not used:
        return 0.0
    w = {i: F.get("w", F.lit(i)) for i in used}
    means = done.agg(*[F.avg(w[i]) for i in used]).first()
    centre = {i: w[i] - F.lit(m) for i, m in zip(used, means)}
    pairs = [(i, j) for i in used for j in used if i <= j]
    covariance = done.agg(*[F.avg(centre[i] * centre[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))


def op11_whitening(spark, sf_dir):
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
