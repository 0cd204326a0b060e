"""Several numeric columns together, by the machine-learning library: components, mixtures, cohorts, utility."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="features", withMean=True)])


def principal_components(df: DataFrame, columns: list[str], k: int) -> list[float]:
    """Shares of variance of the first k components of the standardised columns."""
    ready = scaled(df, columns).fit(df).transform(df)
    return [float(v) for v in PCA(k=k, inputCol="features", outputCol="pc").fit(ready).explainedVariance]


def cohorts(df: DataFrame, columns: list[str], k: int, seed: int = 7) -> DataFrame:
    """df with cohort: the cluster of its standardised columns; rows with nulls have none."""
    ready = scaled(df, columns).fit(df).transform(df)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cohort").fit(ready).transform(ready).drop("_x", "features")


def mixture(df: DataFrame, column: str, most: int = 4, seed: int = 7) -> list[dict]:
    """Gaussian mixtures of one to `most` parts with their criterion; the first has the smallest."""
    ready = VectorAssembler(inputCols=[column], outputCol="features", handleInvalid="skip").transform(df.select(F.col(column).cast("double")))
    n, out = ready.count(), []
    for k in range(1, most + 1):
        model = GaussianMixture(k=k, seed=seed).fit(ready)
        out.append({"k": k, "bic": (3 * k - 1) * math.log(n) - 2 * model.summary.logLikelihood, "weights": list(model.weights)})
    return sorted(out, key=lambda x: x["bic"])


def utility(train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 7) -> float:
    """Accuracy on test of a forest fitted on train: train on synthetic rows, test on real ones."""
    steps = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), RandomForestClassifier(labelCol="_label", featuresCol="features", seed=seed, numTrees=20)])
    out = steps.fit(train).transform(test)
    return MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy").evaluate(out)


def robust_center(x, share: float = 0.75, starts: int = 20, steps: int = 20, seed: int = 7):
    """Minimum covariance determinant of a sample (numpy rows): centre and covariance of the subset that is tightest."""
    import numpy as np

    rng, n, h = np.random.default_rng(seed), len(x), max(len(x[0]) + 1, int(share * len(x)))
    best = (math.inf, None, None)
    for _ in range(starts):
        pick = rng.choice(n, min(n, len(x[0]) + 1), replace=False)
        for _ in range(steps):
            m, c = x[pick].mean(0), np.cov(x[pick].T).reshape(len(x[0]), -1) + 1e-9 * np.eye(len(x[0]))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        det = float(np.linalg.det(c))
        if det < best[0]:
            best = (det, m, c)
    return best[1], best[2]


def outliers(df: DataFrame, columns: list[str], key: str, sample: int = 2000, cutoff: float = 0.975) -> DataFrame:
    """key, distance (squared, to the robust centre of a sample of that size), outlier. Rows with nulls have no distance.

    The distance is a Column: a quadratic form of the inverse covariance.
    """
    import numpy as np

    from ..functions.numbers import chi2_sf

    rows = df.select(*columns, F.xxhash64(key).alias("_h")).dropna().orderBy("_h").limit(sample).drop("_h").collect()
    x = np.array([[float(v) for v in r] for r in rows])
    m, c = robust_center(x)
    middle = float(np.median(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)))
    lo, hi = 0.0, 200.0
    while hi - lo > 1e-9:  # the chi-squared quantiles by bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, len(columns)) > 0.5 else (lo, mid)
    inverse = np.linalg.inv(c * middle / lo)
    a, b = 0.0, 400.0
    while b - a > 1e-9:
        mid = (a + b) / 2
        a, b = (mid, b) if chi2_sf(mid, len(columns)) > 1 - cutoff else (a, mid)
    e = [F.col(k).cast("double") - float(v) for k, v in zip(columns, m, strict=True)]
    distance = F.lit(0.0)
    for i in range(len(e)):
        for j in range(len(e)):
            distance = distance + e[i] * e[j] * float(inverse[i, j])
    return df.select(key, distance.alias("distance")).withColumn("outlier", F.col("distance") > a)


def subspace_angle(a: DataFrame, b: DataFrame, columns: list[str], k: int) -> float:
    """The largest principal angle, in degrees, between the first k components of two samples' standardised columns."""
    import numpy as np

    def directions(df: DataFrame):
        row = df.agg(*[F.corr(x, y).alias(f"{i}_{j}") for i, x in enumerate(columns) for j, y in enumerate(columns)]).first()
        r = np.array([[row[f"{i}_{j}"] for j in range(len(columns))] for i in range(len(columns))], float)
        return np.linalg.eigh(r)[1][:, -k:]

    s = np.linalg.svd(directions(a).T @ directions(b), compute_uv=False)
    return float(np.degrees(np.arccos(np.clip(s.min(), -1, 1))))


def match_cohorts(a: DataFrame, b: DataFrame, columns: list[str], cohort: str = "cohort") -> DataFrame:
    """Each cohort of a with the nearest of b by their means: cohort_a, cohort_b, distance. As many rows as cohorts meet."""
    means = lambda df, s: df.groupBy(F.col(cohort).alias(f"cohort_{s}")).agg(*[F.avg(c).alias(f"{s}_{c}") for c in columns])
    square = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0))
    both = means(a, "a").join(F.broadcast(means(b, "b")), F.lit(True)).withColumn("distance", F.sqrt(square))
    return both.groupBy("cohort_a").agg(F.min(F.struct("distance", "cohort_b")).alias("x")).select("cohort_a", "x.cohort_b", "x.distance")
