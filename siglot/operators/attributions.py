"""What each feature adds to the prediction of boosted trees: path-dependent Shapley values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglot.sources.files import scratch

#: A node's feature (-1: a leaf), threshold, children, value and cover (the weight of the rows that reached it in training).
Tree = dict[str, np.ndarray]


def fit_trees(train: DataFrame, features: list[str], y: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 1):
    """A gradient-boosted classifier over columns that are numbers, as a Spark ML model."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(featuresCol="_x", labelCol=y, maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=30, subsamplingRate=0.8, seed=seed).fit(packed(train, features))


def packed(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def trees_of(model) -> list[Tree]:
    """The trees of a boosted model, from the table of nodes that it is saved as. Leaves give log odds: a classifier's margin is half of them."""
    spark = SparkSession.getActiveSession()
    path = scratch(spark)
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*", F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.get("nodeData.impurityStats", F.lit(0)).alias("cover")).toPandas()
    out = []
    for k, weight in enumerate(model.treeWeights):
        t = nodes[nodes.treeID == k].sort_values("id")
        leaf = t.leftChild.to_numpy() < 0
        out.append({"feature": np.where(leaf, -1, t.feature.to_numpy()), "threshold": t.threshold.to_numpy(float), "left": t.leftChild.to_numpy(), "right": t.rightChild.to_numpy(), "value": 2 * weight * t.prediction.to_numpy(float), "cover": t.cover.to_numpy(float)})
    return out


def leaves(tree: Tree) -> Iterator[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(feature, low, high, share)]) of each leaf: the interval (low, high] of each feature on its path, once, and the share of the training rows that the path's splits on it let pass."""
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            yield float(tree["value"][node]), [(g, *v) for g, v in path.items()]
            continue
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        at, cover = float(tree["threshold"][node]), float(tree["cover"][node])
        for child, lo, hi in ((int(tree["left"][node]), low, min(high, at)), (int(tree["right"][node]), max(low, at), high)):
            passed = float(tree["cover"][child]) / cover if cover > 0 else 0.0
            todo.append((child, path | {f: (lo, hi, share * passed)}))


def shapley(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(attributions of the rows of x, the mean prediction that they add up from).

    A leaf's part in the value of a set of known features is its own value, times
    the share of each feature on its path that isn't known, and nothing if a known
    one leads elsewhere. So a leaf matters to the features on its path only, and the
    Shapley weights of all sets of the others of one size are a coefficient of the
    product of (share + passes t) over them.
    """
    out, base = np.zeros(x.shape), 0.0
    for tree in trees:
        for value, path in leaves(tree):
            k = len(path)
            base += value * math.prod(share for *_, share in path)
            passes = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
            for i, (f, _, _, share) in enumerate(path):
                coefficients = [np.ones(len(x))]
                for j, (*_, other) in enumerate(path):
                    if j != i:
                        longer = [c * other for c in coefficients] + [np.zeros(len(x))]
                        for size, c in enumerate(coefficients):
                            longer[size + 1] = longer[size + 1] + c * passes[j]
                        coefficients = longer
                weight = sum(c * (math.factorial(size) * math.factorial(k - 1 - size) / math.factorial(k)) for size, c in enumerate(coefficients))
                out[:, f] += value * (passes[i] - share) * weight
    return out, base


def attributed(df: DataFrame, trees: list[Tree], features: list[str]) -> DataFrame:
    """df with attributions (array<double>, one for each feature, in log odds) and margin (what they and the mean add up to). Trees go to the tasks: some thousands of nodes, whatever the rows. Rows with an unknown feature are left out."""
    keep = df.dropna(subset=features)
    names = keep.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]) if b.num_rows else np.zeros((0, len(features)))
            a, base = shapley(trees, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists, pa.array(a.sum(1) + base)], [*names, "attributions", "margin"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType([*keep.schema.fields]).add("attributions", ArrayType(DoubleType())).add("margin", DoubleType())
    return keep.mapInArrow(run, schema)


def importance(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs: from attributed(), in one pass; a column w says how many rows one stands for."""
    w = F.col("w") if "w" in df.columns else F.lit(1)
    means = df.agg(*[(F.sum(w * F.abs(F.get("attributions", F.lit(i)))) / F.sum(w)).alias(f) for i, f in enumerate(features)])
    return means.unpivot([], features, "feature", "mean_abs")


def dependence(df: DataFrame, features: list[str], top: int = 8, bins: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """feature, bin, low, high, n, mean: the mean attribution by value, for the features that matter most: by level where there are at most two, else by ranges of about equal numbers of rows (from approximate quantiles). If df has one row for equal ones, w is their number and `rows` has them all, for the quantiles."""
    w = F.col("w") if "w" in df.columns else F.lit(1)
    order = [r.feature for r in importance(df, features).orderBy(F.desc("mean_abs"), "feature").limit(top).collect()]
    cuts = (df if rows is None else rows).agg(*[F.percentile_approx(F.col(f).cast("double"), F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10_000)).alias(f) for f in order], *[F.approx_count_distinct(f).alias(f"_{i}") for i, f in enumerate(order)]).first()
    long = []
    for i, f in enumerate(order):
        v = F.col(f).cast("double")
        edges = sorted(set(cuts[f] or []))
        bin_of = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: v > e)).cast("double") if cuts[f"_{i}"] > 2 and edges else v
        long.append(F.struct(F.lit(f).alias("feature"), bin_of.alias("bin"), v.alias("v"), F.get("attributions", F.lit(features.index(f))).alias("a"), w.alias("w")))
    d = df.select(F.explode(F.array(*long)).alias("r")).select("r.*")
    return d.groupBy("feature", "bin").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("mean"))
