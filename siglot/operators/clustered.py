"""Outcomes of reports clustered by lot: exchangeable estimating equations, families of models, random intercepts, and what lot profiles add to a prediction."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglot.functions import special as S
from siglot.operators import models as R
from siglot.sources.files import stored

Z = 1.959963984540054


def totals(df: DataFrame, columns: list[str], f: Callable, size: int) -> np.ndarray:
    """The sum over all batches of rows of f(columns as numpy arrays), a vector of `size`: one partial sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(*(_numbers(b.column(c), b.num_rows) for c in columns))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in df.select(*columns).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    """A column of numbers, or of arrays of one length as a matrix."""
    return column.flatten().to_numpy().reshape(n, -1) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)


def patterns(d: DataFrame) -> DataFrame:
    """A design() with clusters, stored: rows that are equal within a cluster are one, with their number as weight."""
    return stored(d.groupBy("x", "y", "o", "cluster").agg(F.sum("w").alias("w")))


def counted(df: DataFrame, name: str = "w") -> DataFrame:
    """df's distinct rows, stored, with their number: models of reports need no more of those that agree."""
    return stored(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name)))


def exchangeable(d: DataFrame, p: int, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(coefficients, robust covariance, working correlation, clusters) of logistic estimating equations whose outcomes are equally correlated within a cluster. d: patterns().

    The inverse of an exchangeable correlation of n outcomes is known in closed form,
    (I - c J) / (1 - alpha) with c = alpha / (1 + (n - 1) alpha), so a cluster comes down
    to its sums of scaled rows and residuals, which Spark adds up before any shuffle;
    no cluster is gathered. Between two Newton steps the correlation is estimated
    anew from the residuals. The covariance is the sandwich without a small-sample
    factor.
    """
    b, alpha, at = np.zeros(p), 0.0, range(p)
    x = [F.get("x", F.lit(i)) for i in at]
    for _ in range(steps):
        eta = sum((x[i] * float(b[i]) for i in at), F.col("o"))
        mu = 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))
        rows = d.withColumn("mu", mu).withColumn("s", F.sqrt(F.col("mu") * (1 - F.col("mu")))).withColumn("e", (F.col("y") - F.col("mu")) / F.col("s"))
        w, e = F.col("w"), F.col("e")
        sums = [F.sum(w).alias("n"), F.sum(w * e).alias("se"), F.sum(w * e * e).alias("see")]
        vector = lambda c, name: [F.sum(w * F.col("s") * c * x[i]).alias(f"{name}{i}") for i in at]
        lots = rows.groupBy("cluster").agg(*sums, *vector(F.lit(1.0), "sx"), *vector(e, "u")).select("n", "se", "see", F.array(*[f"sx{i}" for i in at]).alias("sx"), F.array(*[f"u{i}" for i in at]).alias("u"))

        def by_lot(n, se, see, sx, u, alpha=alpha):
            c = alpha / (1 + (n - 1) * alpha)
            own = u - (c * se)[:, None] * sx
            return np.concatenate([own.sum(0), ((sx * c[:, None]).T @ sx).ravel(), (own.T @ own).ravel(), [((se * se - see) / 2).sum(), see.sum(), (n * (n - 1) / 2).sum(), n.sum(), len(n), n.max()]])

        got = totals(lots, ["n", "se", "see", "sx", "u"], by_lot, p + 2 * p * p + 6)
        info = totals(rows, ["x", "s", "w"], lambda x, s, w: ((x * (w * s * s)[:, None]).T @ x).ravel(), p * p).reshape(p, p)
        inverse = np.linalg.pinv(info - got[p : p + p * p].reshape(p, p))
        pairs, squares, n_pairs, n, clusters, _ = got[-6:]
        step = inverse @ got[:p]
        step *= min(1.0, 5.0 / max(abs(step).max(), 1e-12))
        cov = inverse @ got[p + p * p : p + 2 * p * p].reshape(p, p) @ inverse
        new = pairs / (squares / max(1.0, n - p)) / (n_pairs - p) if n_pairs > p else 0.0
        new = min(max(new, -0.1), 0.95)
        settled = abs(step).max() < 1e-8 and abs(new - alpha) < 1e-8
        b, alpha = b + step, new
        if settled:
            break
    return b, cov, alpha, int(clusters)


def expanded(df: DataFrame, covariates: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with 0/1 columns for the values, but for the first, of each covariate written C(name), and the columns that stand for each covariate."""
    columns: dict[str, list[str]] = {}
    for c in covariates:
        if c.startswith("C("):
            name = c[2:-1]
            values = sorted(r[0] for r in df.select(name).distinct().collect() if r[0] is not None)  # of a declared category
            columns[c] = [f"{name}_{v}" for v in values[1:]]
            df = df.withColumns({f"{name}_{v}": (F.col(name) == v).cast("double") for v in values[1:]})
        else:
            columns[c] = [c]
    return df, columns


def prune_collinear(df: DataFrame, covariates: list[str], exposures: list[str], tolerance: float = 1e-9) -> tuple[list[str], list[str]]:
    """(covariates that stay, those left out): covariates go until the constant, they and the exposures are independent.

    In each round the last covariate goes whose removal alone makes the rest
    independent, or else the last one of all; exposures never go. All ranks come
    from one aggregation of products.
    """
    df, columns = expanded(df, covariates)
    every = [c for t in covariates for c in columns[t]] + exposures
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in every])
    k = len(every) + 1
    gram = totals(df.select(x.alias("x")).where("not exists(x, v -> v is null)"), ["x"], lambda x: (x.T @ x).ravel(), k * k).reshape(k, k)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram = gram / np.outer(scale, scale)
    place = {c: i + 1 for i, c in enumerate(every)}

    def independent(terms: list[str]) -> bool:
        at = [0, *[place[c] for t in terms for c in columns[t]], *[place[e] for e in exposures]]
        return bool(np.linalg.eigvalsh(gram[np.ix_(at, at)])[0] > tolerance)

    stay, out = list(covariates), []
    while stay and not independent(stay):
        gone = next((t for t in reversed(stay) if independent([u for u in stay if u != t])), stay[-1])
        stay.remove(gone)
        out.append(gone)
    return stay, out


FAMILY = "outcome string, exposure string, model string, negative_control boolean, n bigint, n_events bigint, n_lots bigint, or_per_sd double, or_lo double, or_hi double, p_value double, working_corr double, note string, p_bh double"


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    order = np.argsort(-p)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1)))
    return out


def model_family(df: DataFrame, outcomes: dict[str, Column], exposures: list[str], covariates: list[str], cluster: str, correlation: str = "exchangeable", negative_controls: tuple[str, ...] = (), adjust_set: tuple[str, ...] | None = None, crude: bool = False, least_events: int = 10, weight: str | None = None) -> DataFrame:
    """A row for each outcome, model and exposure: a model with one exposure at a time, crude ones if asked, and one of all primary exposures together.

    outcomes maps a name to its column; rows where that is null weren't recorded and
    are left out. Covariates that aren't independent are pruned. Outcomes with fewer
    than least_events events, or others, are skipped, and estimates that aren't
    finite are noted instead of shown. p_bh adjusts the models with a single exposure
    that is no negative control; crude and joint models stay outside that family.
    weight: a column that says how many reports a row stands for.
    """
    spark, rows = df.sparkSession, []
    stay, _ = prune_collinear(df, covariates, exposures)
    wide, columns = expanded(df, stay)
    adjusted = [c for t in stay for c in columns[t]]
    primary = [e for e in exposures if e not in negative_controls and (adjust_set is None or e in adjust_set)]
    for name, y in outcomes.items():
        d = wide.withColumn("_y", y.cast("double")).where("_y is not null").groupBy("_y", cluster, *adjusted, *exposures)
        d = stored(d.agg(F.sum(weight if weight else F.lit(1)).alias("_w")))  # every model needs only how many reports agree
        n, events, lots = d.agg(F.sum("_w"), F.sum(F.col("_y") * F.col("_w")), F.countDistinct(cluster)).first()
        n, events = int(n or 0), int(events or 0)
        if events < least_events or n - events < least_events:
            rows.append((name, None, "skipped", None, n, events, lots, *[None] * 5, "too few events or non-events", None))
            continue
        models = [("single", [e], [e, *adjusted]) for e in exposures]
        models += [("crude", [e], [e]) for e in exposures] if crude else []
        models += [("mutually_adjusted", primary, [*primary, *adjusted])] if len(primary) > 1 else []
        for kind, shown, features in models:
            p = len(features) + 1
            design = patterns(R.design(d, features, "_y", weight="_w", cluster=cluster))
            if correlation == "exchangeable":
                b, cov, alpha, _ = exchangeable(design, p)
            else:
                b, inverse, _ = R.glm(design, p)
                cov, alpha = R.cluster_robust(design, b, inverse), 0.0
            variance = np.diag(cov)
            if not (np.isfinite(b).all() and np.isfinite(variance).all() and (variance > 0).all()):
                rows.append((name, "+".join(shown), kind, None, n, events, lots, *[None] * 5, "no finite estimates", None))
                continue
            for k, e in enumerate(shown, 1):
                se = math.sqrt(variance[k])
                ratio = [math.exp(min(max(v, -700.0), 700.0)) for v in (b[k], b[k] - Z * se, b[k] + Z * se)]
                rows.append((name, e, kind, e in negative_controls, n, events, lots, *ratio, float(2 * S.normal_sf(abs(b[k]) / se)), float(alpha), "", None))
    family = [i for i, r in enumerate(rows) if r[2] == "single" and r[3] is False]
    for i, q in zip(family, benjamini_hochberg(np.array([rows[i][10] for i in family])), strict=True):
        rows[i] = (*rows[i][:-1], float(q))
    return spark.createDataFrame(rows, FAMILY)


def random_intercepts(d: DataFrame, p: int, steps: int = 100, prior_sd: float = 2.0, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """(posterior means, their covariance, SD of the lots, the bound after each step) of a logistic model with a normal intercept for each cluster, by variational expectation maximisation. d: patterns().

    The logistic function is bounded by a quadratic in each row, tight at one point
    (xi). Given the points, coefficients and intercepts are normal: lots come down to
    a few sums each, their means are eliminated, and coefficients solve one small
    system; the lots stay a table, joined to the rows by key. Points, then
    both normals, then the lots' variance are each the best given the others, so the
    bound never falls.
    """
    spark = d.sparkSession
    m, s, tau2 = np.zeros(p), np.eye(p) * 0.1, 1.0
    kind = d.schema["cluster"].dataType.simpleString()
    lots = stored(d.select("cluster").distinct().withColumns({"mu": F.lit(0.0), "s2": F.lit(0.1)}))
    bounds: list[float] = []
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], m=m, s=s) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(p * p + p + 1)
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, w, o, mu, s2 = (_numbers(b.column(c), b.num_rows) for c in ("x", "y", "w", "o", "mu", "s2"))
                z = x @ m + o + mu
                xi = np.sqrt(z * z + np.einsum("ij,jk,ik->i", x, s, x) + s2)
                lam = w * np.tanh(xi / 2) / (4 * np.maximum(xi, 1e-9))
                whole += np.concatenate([((x * lam[:, None]).T @ x).ravel(), x.T @ (w * (y - 0.5) - 2 * lam * o), [(w * ((y - 0.5) * z - xi / 2 - np.log1p(np.exp(-xi)))).sum()]])
                names, group = np.unique(np.array(b.column("cluster").to_pylist(), object), return_inverse=True)
                sums = np.column_stack([lam, w * (y - 0.5) - 2 * lam * o, x * lam[:, None]])
                per = np.zeros((len(names), p + 2))
                np.add.at(per, group, sums)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), kind_arrow), pa.nulls(len(names), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(per.ravel()), p + 2).cast(pa.list_(pa.float64()))], ["cluster", "i", "v"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(whole), kind_arrow), pa.array(range(len(whole)), pa.int32()), pa.array([[v] for v in whole])], ["cluster", "i", "v"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind_arrow = to_arrow_type(d.schema["cluster"].dataType)
        parts = d.join(lots, "cluster").select("x", "y", "w", "o", "cluster", "mu", "s2").mapInArrow(run, f"cluster {kind}, i int, v array<double>")
        added = stored(parts.groupBy("cluster", "i").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(p + 2)]))
        whole = np.zeros(p * p + p + 1)
        for r in added.where("i is not null").select("i", "v0").collect():
            whole[r.i] = r.v0
        per = added.where("i is null").select("cluster", F.col("v0").alias("a"), F.col("v1").alias("t"), F.array(*[f"v{k + 2}" for k in range(p)]).alias("b"))

        # the bound at the points just chosen, before anything else moves
        normal = lambda mu, s2: np.array([(-0.5 * np.log(tau2) - (mu * mu + s2) / (2 * tau2) + 0.5 * np.log(s2) + 0.5).sum()])
        bound = whole[-1] + totals(lots, ["mu", "s2"], normal, 1)[0]
        bound += -p * math.log(prior_sd) - (m @ m + np.trace(s)) / (2 * prior_sd**2) + 0.5 * np.linalg.slogdet(s)[1] + p / 2
        bounds.append(float(bound))
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < tolerance * abs(bounds[-1]) / 100:
            break

        def eliminated(a, t, b, tau2=tau2):
            s2 = 1 / (1 / tau2 + 2 * a)
            return np.concatenate([((b * s2[:, None]).T @ b).ravel(), b.T @ (s2 * t)])

        got = totals(per, ["a", "t", "b"], eliminated, p * p + p)
        precision = np.eye(p) / prior_sd**2 + 2 * whole[: p * p].reshape(p, p)
        s = np.linalg.inv(precision)
        m = np.linalg.solve(precision - 4 * got[: p * p].reshape(p, p), whole[p * p : p * p + p] - 2 * got[p * p :])
        dot = sum((F.get("b", F.lit(k)) * float(m[k]) for k in range(p)), F.lit(0.0))
        s2 = 1 / (1 / tau2 + 2 * F.col("a"))
        lots = stored(per.select("cluster", (s2 * (F.col("t") - 2 * dot)).alias("mu"), s2.alias("s2")))
        tau2 = max(lots.select(F.avg(F.col("mu") * F.col("mu") + F.col("s2"))).first()[0], 1e-8)
    return m, s, math.sqrt(tau2), bounds


def balanced_folds(df: DataFrame, cluster: str, folds: int, packed: int = 10_000, weight: str | None = None) -> DataFrame:
    """cluster, fold: whole clusters, largest first into the fold that has fewest rows. Beyond the `packed` largest, each too small to matter, a hash decides."""
    sizes = df.groupBy(cluster).agg(F.sum(weight if weight else F.lit(1)).alias("n"))
    heap, put = [(0, k) for k in range(folds)], []
    for r in sizes.orderBy(F.desc("n"), cluster).limit(packed).collect():
        n, k = heapq.heappop(heap)
        put.append((r[0], k))
        heapq.heappush(heap, (n + r.n, k))
    chosen = df.sparkSession.createDataFrame(put, f"{cluster} {df.schema[cluster].dataType.simpleString()}, _fold int")
    rest = F.pmod(F.xxhash64(cluster), F.lit(folds)).cast("int")
    return sizes.join(chosen, cluster, "left").select(cluster, F.coalesce("_fold", rest).alias("fold"))


def incremental_value(df: DataFrame, y: str, base: list[str], profiles: DataFrame, attributes: list[str], cluster: str, folds: int = 5, permutations: int = 200, seed: int = 0, ridge: float = 1.0, newton: int = 8, bins: int = 4096, most_cells: int = 10_000_000, weight: str | None = None) -> DataFrame:
    """auc_base, auc_with, delta, null_q95, p, n, n_lots: whether the lots' attributes tell more about an outcome than base does.

    The area under the curve is that of predictions for lots that a fold's model
    hasn't seen. Under the null whole profiles are dealt anew between lots, which
    keeps what reports of one lot share: p = (1 + number of permutations that gain at
    least as much) / (1 + permutations). Models are ridge logistic regressions; one
    pass over the reports takes a Newton step of all permutations and folds at
    once, and one more bins the predictions (areas are exact to a bin's width).
    Reports that agree in everything are one weighted row; profiles, lots x
    attributes, go to tasks and may have at most most_cells numbers. weight: a column
    that says how many reports a row stands for.
    """
    spark = df.sparkSession
    lots = stored(profiles.join(balanced_folds(df, cluster, folds, weight=weight), cluster).select(cluster, "fold", *[F.col(a).cast("double").alias(a) for a in attributes]).dropna())
    size = lots.count()
    if size * len(attributes) > most_cells:
        raise ValueError(f"{size} lots x {len(attributes)} attributes are more than {most_cells} numbers")
    table = lots.toPandas().sort_values(cluster)
    keys, fold_of = table[cluster].tolist(), table["fold"].to_numpy()
    values = table[attributes].to_numpy(float)
    sd = values.std(0)
    values = (values - values.mean(0)) / np.where(sd > 0, sd, 1.0)
    k = (F.col(weight) if weight else F.lit(1)).cast("double")
    means = df.agg(*[F.sum(F.when(F.col(c).isNotNull(), k) * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), k)) for c in base]).first()
    spread = df.agg(*[F.sqrt(F.sum(F.when(F.col(c).isNotNull(), k) * F.pow(F.col(c) - F.lit(m), F.lit(2))) / F.sum(F.when(F.col(c).isNotNull(), k))) for c, m in zip(base, means, strict=True)]).first()
    moments = [v for pair in zip(means, spread, strict=True) for v in pair]
    scaled = [((F.col(c).cast("double") - moments[2 * i]) / (moments[2 * i + 1] or 1.0)) for i, c in enumerate(base)]
    x = F.array(F.lit(1.0), *scaled)
    d = stored(df.select(x.alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).alias("lot"), k.alias("k")).where("y is not null and not exists(x, v -> v is null)").groupBy("x", "y", "lot").agg(F.sum("k").alias("w")))
    # few bytes, but much work a row: dealt evenly over several tasks a core
    d = stored(d.join(lots.select(F.col(cluster).alias("lot")), "lot", "left_semi")).repartition(4 * spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast((keys, fold_of, values))
    p0, p = len(base) + 1, len(base) + 1 + len(attributes)
    runs = permutations + 2  # without attributes, with each lot's own, and the permutations

    def prepared() -> Callable:
        keys, fold_of, values = sent.value
        place, order = {k: i for i, k in enumerate(keys)}, [None, np.arange(len(keys))]
        order += [np.random.default_rng([seed, k]).permutation(len(keys)) for k in range(permutations)]

        def of(b: pa.RecordBatch) -> Iterator[tuple]:
            at = np.array([place[k] for k in b.column("lot").to_pylist()])
            x, y, w = (_numbers(b.column(c), b.num_rows) for c in ("x", "y", "w"))
            for k in range(runs):
                more = np.zeros((len(at), p - p0)) if order[k] is None else values[order[k][at]]
                yield k, np.hstack([x, more]), y, w, fold_of[at]

        return of

    coef = np.zeros((runs, folds, p))
    used = np.ones((runs, p), bool)
    used[0, p0:] = False
    for _ in range(newton):

        def step(batches: Iterator[pa.RecordBatch], coef=coef) -> Iterator[pa.RecordBatch]:
            of, total = prepared(), np.zeros((runs, folds, p + p * p))
            for b in batches:
                for k, x, y, w, fold in of(b) if b.num_rows else ():
                    mu = 1 / (1 + np.exp(-np.clip(x @ coef[k].T, -30, 30)))
                    train = (fold[:, None] != np.arange(folds)) * w[:, None]
                    total[k, :, :p] += ((y[:, None] - mu) * train).T @ x
                    v = mu * (1 - mu) * train
                    total[k, :, p:] += np.einsum("if,ij,ik->fjk", v, x, x, optimize=True).reshape(folds, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(runs), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), total[0].size).cast(pa.list_(pa.float64()))], ["k", "v"])

        cells = folds * (p + p * p)
        sums = d.mapInArrow(step, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
        got = np.zeros((runs, cells))
        got[sums["k"], sums["i"]] = sums["v"]
        got = got.reshape(runs, folds, p + p * p)
        new, shrink = coef.copy(), np.eye(p) * ridge
        shrink[0, 0] = 1e-9
        for k in range(runs):
            at = np.flatnonzero(used[k])
            for f in range(folds):
                h = got[k, f, p:].reshape(p, p) + shrink
                new[k, f, at] += np.linalg.solve(h[np.ix_(at, at)], (got[k, f, :p] - shrink @ coef[k, f])[at])
        moved, coef = abs(new - coef).max(), new
        if moved < 1e-6:
            break

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = prepared(), np.zeros((runs, bins, 2))
        for b in batches:
            for k, x, y, w, fold in of(b) if b.num_rows else ():
                eta = (x * coef[k][fold]).sum(1)
                at = np.clip((bins / (1 + np.exp(-np.clip(eta, -30, 30)))).astype(int), 0, bins - 1)
                np.add.at(total[k], (at, (y > 0.5).astype(int)), w)
        k, at = np.nonzero(total.sum(2))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(total[k, at, 1]), pa.array(total[k, at, 0])], ["k", "bin", "pos", "neg"])

    scored = d.mapInArrow(binned, "k int, bin int, pos double, neg double").groupBy("k", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("k").orderBy("bin")) - F.col("neg") / 2
    areas = scored.withColumn("u", F.col("pos") * below).groupBy("k").agg((F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc")).toPandas().set_index("k")["auc"]
    n = int(d.agg(F.sum("w")).first()[0] or 0)
    delta, null = float(areas[1] - areas[0]), (areas.loc[2:] - areas[0]).to_numpy()
    p_value = float((1 + (null >= delta - 1e-12).sum()) / (1 + permutations))
    return spark.createDataFrame([(float(areas[0]), float(areas[1]), delta, float(np.quantile(null, 0.95)) if permutations else None, p_value, n, size, permutations)], "auc_base double, auc_with double, delta double, null_q95 double, p double, n bigint, n_lots bigint, permutations int")


def linked_frame(reports: DataFrame, links: DataFrame | None, lots: DataFrame, attributes: list[str], levels: tuple[str, ...] = ("exact", "core", "fuzzy"), drop_implausible: bool = True, exclude: Column | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(reports with their lot and z_<attribute> columns, those columns, notes).

    Reports come with the lot that they link to at one of the levels; links whose
    dates rule the lot out go (unknown ones stay), and reports that `exclude` holds
    for. Attributes are standardised over the lots that are used, each once; one
    without variation between lots is left out, with a note. Without links, reports
    have a link's columns (lot_key, match_level, temporal_ok) themselves.
    """
    good = (reports if links is None else links).where(F.col("lot_key").isNotNull() & F.col("match_level").isin(*levels))
    good = good.where(F.coalesce("temporal_ok", F.lit(True))) if drop_implausible else good
    d = good if links is None else reports
    d = d.where(~F.coalesce(exclude, F.lit(False))) if exclude is not None else d
    d = d if links is None else d.join(good.select("record_id", "lot_key", "match_level"), "record_id")
    used = lots.join(d.select("lot_key"), "lot_key", "left_semi")
    s = used.agg(*[f(F.col(a).cast("double")) for a in attributes for f in (F.avg, F.stddev_samp)]).first()
    stats = {a: (s[2 * i], s[2 * i + 1]) for i, a in enumerate(attributes)}
    able = [a for a in attributes if stats[a][1]]
    z = used.select("lot_key", *[((F.col(a).cast("double") - stats[a][0]) / stats[a][1]).alias(f"z_{a}") for a in able])
    names = [f"z_{a}" for a in able]
    return d.join(z, "lot_key").dropna(subset=names), names, [f"{a} has no variation between lots" for a in attributes if a not in able]


def sensitivity(frames: dict[str, DataFrame], outcomes: dict[str, Column], exposures: list[str], covariates: list[str], cluster: str, **options) -> DataFrame:
    """The single-exposure models of a family over each frame, with the frame's name as `sensitivity`."""
    parts = [model_family(d, outcomes, exposures, covariates, cluster, adjust_set=(), **options).withColumn("sensitivity", F.lit(name)) for name, d in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def agreement(primary: DataFrame, others: DataFrame, alpha: float = 0.05) -> DataFrame:
    """n_tests, n_significant, n_compared, n_agree, n_negative_nominal: of the significant single models of the primary family, how many estimates of other analyses (outcome, exposure, or_per_sd) have the same direction; and how many negative controls come out below 0.05."""
    single = primary.where("model = 'single'")
    mine = single.where("not negative_control")
    significant = mine.where(F.col("p_bh") < alpha).select("outcome", "exposure", (F.col("or_per_sd") > 1).alias("up"))
    met = others.where("or_per_sd is not null").join(significant, ["outcome", "exposure"])
    compared = met.agg(F.count(F.lit(1)).alias("n_compared"), F.count_if((F.col("or_per_sd") > 1) == F.col("up")).alias("n_agree"))
    counts = single.agg(F.count_if(~F.col("negative_control")).alias("n_tests"), F.count_if(~F.col("negative_control") & (F.col("p_bh") < alpha)).alias("n_significant"), F.count_if(F.col("negative_control") & (F.col("p_value") < 0.05)).alias("n_negative_nominal"))
    return counts.join(F.broadcast(compared))  # one row each
