"""Statistics on small or large tables of paired values: ranks and moments in Spark, tails of distributions here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binary_entropy(p: Column) -> Column:
    h = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return h(p) + h(1 - p)


def ir_to_d1(ir: Column) -> Column:
    return 1 - binary_entropy(1 / (1 + ir))


def ir_to_inverse(ir: Column) -> Column:
    return 1 - 1 / ir


def ir_to_log(ir: Column) -> Column:
    return F.log(ir) / F.max(F.log(ir)).over(Window.partitionBy(F.lit(1)))


def average_rank(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with the rank of col from 1; equal values share the mean of their ranks."""
    part = [F.col(c) for c in by or []] or [F.lit(1)]
    rank = F.rank().over(Window.partitionBy(*part).orderBy(col))
    peers = F.count("*").over(Window.partitionBy(*part, col))
    return df.withColumn(out, rank + (peers - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    ranked = average_rank(average_rank(df, x, "__rx", by), y, "__ry", by)
    return ranked.groupBy(*(by or [])).agg(F.corr("__rx", "__ry").alias("rho"))


def pearson_ci(r: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Bounds of the 95 % interval by Fisher's transformation."""
    at, half = F.atanh(r), z / F.sqrt(n - 3)
    return F.array(F.tanh(at - half), F.tanh(at + half))


def ols_residuals(df: DataFrame, x: str, y: str, out: str = "residual") -> DataFrame:
    """df with the absolute residual of the line y ~ x."""
    w = Window.partitionBy(F.lit(1))
    slope = F.covar_pop(x, y).over(w) / F.var_pop(x).over(w)
    return df.withColumn(out, F.abs(F.col(y) - (F.avg(y).over(w) + slope * (F.col(x) - F.avg(x).over(w)))))


def prediction_errors(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with four errors of predicting y, which falls as x grows: abs_ols and sq_ols (the line's residual), abs_direct
    (from 1 - y) and rank_err (between places of x, largest first, and of y, smallest first; equal values in order of x, y)."""
    w = Window.partitionBy(F.lit(1))
    down, up = F.row_number().over(w.orderBy(F.desc(x), y)), F.row_number().over(w.orderBy(y, x))
    lined = ols_residuals(df, x, y, "abs_ols")
    return lined.select("*", (F.col("abs_ols") * F.col("abs_ols")).alias("sq_ols"), F.abs(F.col(x) - (1 - F.col(y))).alias("abs_direct"), F.abs(down - up).cast("double").alias("rank_err"))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        k = i // 2
        num = 1.0 if i == 0 else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d) if i else 1.0
        c = 1 + num / c if i else 1.0
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * f


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees of freedom."""
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_fraction((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w_plus, w_minus, n) of the differences a - b; zero differences are left out."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_rank(d, "m", "r")
    return r.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"), F.count("*").alias("n"))


def wilcoxon_p(w_plus: float, n: int, alternative: str = "two-sided") -> float:
    """Exact p of the signed-rank sum, by counting the sign patterns of each sum (whole ranks 1 to n)."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    ways /= 2.0**n
    less, more = ways[: math.floor(w_plus) + 1].sum(), ways[math.ceil(w_plus) :].sum()
    return float({"less": less, "greater": more, "two-sided": min(1.0, 2 * min(less, more))}[alternative])


def monte_carlo_weights(dims: DataFrame, id_col: str, columns: list[str], y: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, rho): rank correlation with y of scores by weights drawn evenly from the simplex."""
    spark = dims.sparkSession
    raw = spark.range(draws).select(F.col("id").alias("draw"), *[(-F.log(F.rand(seed + i))).alias(f"g{i}") for i in range(len(columns))])
    total = sum((F.col(f"g{i}") for i in range(1, len(columns))), F.col("g0"))
    score = sum((F.col(f"g{i}") / total * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))
    scored = raw.crossJoin(F.broadcast(dims)).select("draw", id_col, y, score.alias("score"))  # dims: a row for each dataset studied
    return spearman(scored, "score", y, ["draw"])


def best_weights(d: np.ndarray, y: np.ndarray, starts: int = 21, seed: int = 42) -> tuple[np.ndarray, float]:
    """Weights of a small table's dimensions that make |rank correlation| largest: exchange search from many starts."""
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    ry = rank(y)
    value = lambda w: abs(np.corrcoef(rank(d @ w), ry)[0, 1]) if np.ptp(d @ w) > 0 else 0.0
    rng, k = np.random.default_rng(seed), d.shape[1]
    best = (np.full(k, 1 / k), value(np.full(k, 1 / k)))
    for w in [np.full(k, 1 / k), *rng.dirichlet(np.ones(k), starts - 1)]:
        now, step = value(w), 0.25
        while step > 1e-3:
            moved = False
            for i in range(k):
                for j in range(k):
                    t = w.copy()
                    gone = min(step, t[i])
                    t[i] -= gone
                    t[j] += gone
                    if value(t) > now + 1e-12:
                        w, now, moved = t, value(t), True
            step = step if moved else step / 2
        if now > best[1]:
            best = (w, now)
    return best


def compare(found: DataFrame, published: DataFrame, key: str, columns: list[str], tolerance: float = 0.10) -> DataFrame:
    """Per key and column whether found is within the tolerance of the published value."""
    joined = found.join(published.select(key, *[F.col(c).alias(f"{c}_published") for c in columns]), key)
    return joined.select(key, *[(F.abs(F.col(c) - F.col(f"{c}_published")) <= tolerance).alias(f"{c}_ok") for c in columns])
