"""The reference pool: supplied, by signature, by lowest variance, or by a mixture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import communities, neighbour_graph, principal_components, two_gaussians
from ..functions.ranks import percentiles
from ..params import Params
from ..session import written
from ..sources.text import checked_signatures, signature_table


def supervised_pool(cells: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with is_ref, one row: n_supplied, n_matched, n_unmatched)."""
    supplied = names.select("cell_id").distinct()
    flagged = cells.join(supplied.withColumn("__in", F.lit(True)), "cell_id", "left").withColumn("is_ref", F.coalesce("__in", F.lit(False))).drop("__in")
    facts = supplied.join(cells.select("cell_id").distinct().withColumn("__in", F.lit(True)), "cell_id", "left").agg(F.count("*").alias("n_supplied"), F.count("__in").alias("n_matched"), F.count_if(F.col("__in").isNull()).alias("n_unmatched"))
    return flagged, facts


def ucell_scores(values: DataFrame, cells: DataFrame, signatures: DataFrame, max_rank: int = Params.ucell_max_rank) -> DataFrame:
    """cell_id, label_ix, label, score by capped descending ranks, ties averaged.

    Genes at zero or outside the matrix take the capped rank, so only positive
    values are ranked.
    """
    down = Window.partitionBy("cell_id").orderBy(F.col("value").desc())
    ties = F.count("*").over(Window.partitionBy("cell_id", "value"))
    key = "gene_ix" if "gene_ix" in values.columns else "gene"
    ranked = values.where("value > 0").select("cell_id", key, F.rank().over(down).alias("r"), ties.alias("t")).select("cell_id", key, (F.col("r") + (F.col("t") - 1) / 2).alias("rank")).where(F.col("rank") <= max_rank)
    sizes = signatures.groupBy("label_ix", "label").agg(F.count("*").alias("n"))
    found = ranked.join(F.broadcast(signatures), key).groupBy("cell_id", "label_ix").agg(F.count("*").alias("hits"), F.sum("rank").alias("s"))
    every = cells.select("cell_id").crossJoin(F.broadcast(sizes)).join(found, ["cell_id", "label_ix"], "left")
    n = F.col("n")
    total = F.coalesce("s", F.lit(0.0)) + (n - F.coalesce("hits", F.lit(0))) * (max_rank + 1)
    least = n * (n + 1) / 2
    return every.select("cell_id", "label_ix", "label", (1 - (total - least) / (n * max_rank - least)).alias("score"))


def signature_pool(scores: DataFrame, labels: list[str], threshold: float = Params.normal_score_threshold) -> DataFrame:
    """cell_id, top_label, top_score, is_ref: the first best label in order, if it is above the threshold and allowed."""
    best = scores.groupBy("cell_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", (-F.col("label_ix")).alias("o"))).alias("b"))
    return best.select("cell_id", F.col("b.label").alias("top_label"), F.col("b.score").alias("top_score")).withColumn("is_ref", (F.col("top_score") >= threshold) & F.col("top_label").isin(*labels))


def cell_variance(values: DataFrame, cells: DataFrame, n_genes: int) -> DataFrame:
    """cell_id, variance over all genes, zeros included (population)."""
    s = values.groupBy("cell_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.coalesce("s", F.lit(0.0)) / n_genes
    return cells.select("cell_id").join(s, "cell_id", "left").select("cell_id", (F.coalesce("q", F.lit(0.0)) / n_genes - mean * mean).alias("variance"))


def cluster_variance(values: DataFrame, labelled: DataFrame, n_genes: int) -> DataFrame:
    """cluster, n, variance: mean over genes of the population variance within a cluster; singletons are infinite."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    per = values.join(labelled, "cell_id").groupBy("cluster", "gene_ix").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    var = per.join(sizes, "cluster").withColumn("v", F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).groupBy("cluster").agg(F.sum("v").alias("total"))
    return sizes.join(var, "cluster", "left").select("cluster", "n", F.when(F.col("n") < 2, F.lit(float("inf"))).otherwise(F.coalesce("total", F.lit(0.0)) / n_genes).alias("variance"))


def lowest_cluster(variances: DataFrame) -> DataFrame:
    """The winning cluster: least variance, the first by name on ties."""
    return variances.orderBy("variance", F.col("cluster").cast("string")).limit(1)


def graph_clusters(vectors: DataFrame, n_comps: int, n_neighbors: int, resolution: float | tuple[float, ...], most: int = Params.max_graph_cells, accept=None) -> DataFrame:
    """cell_id, cluster (string) of rows (cell_id, values array<double>).

    Neighbours and communities are found among at most ``most`` cells, chosen by
    hash; every other cell takes the community of its nearest chosen cell, in
    Arrow batches against that bounded table. With several resolutions the first
    that ``accept`` takes is used, else the last.
    """
    n = vectors.count()
    chosen = vectors if n <= most else vectors.orderBy(F.xxhash64("cell_id"), "cell_id").limit(most)
    rows = chosen.toPandas().sort_values("cell_id", key=lambda s: s.astype(str)).reset_index(drop=True)
    x = np.array(rows["values"].tolist(), float).reshape(len(rows), -1)
    k = max(0, min(n_comps, x.shape[1] - 1, len(x) - 1)) if len(x) else 0
    if k == 0:
        own = np.zeros(len(x), int)
        reduced = x[:, :0]
    else:
        reduced = principal_components(x, k)
        graph = neighbour_graph(reduced, n_neighbors)
        for r in (resolution if isinstance(resolution, tuple) else (resolution,)):
            own = communities(graph, r)
            if accept is None or accept(len(set(own.tolist()))):
                break
    spark = vectors.sparkSession
    if n <= most:
        return spark.createDataFrame([(c, str(int(o))) for c, o in zip(rows["cell_id"], own, strict=True)], f"cell_id {vectors.schema['cell_id'].dataType.simpleString()}, cluster string")
    held = spark.sparkContext.broadcast((x, own))  # at most ``most`` rows

    def nearest(batches):
        marks, own = held.value
        norm = (marks * marks).sum(1)
        for b in batches:
            y = np.array(b["values"].tolist(), float)
            b = b[["cell_id"]].copy()
            b["cluster"] = [str(int(own[j])) for j in (norm[None, :] - 2 * y @ marks.T).argmin(1)]
            yield b

    return vectors.mapInPandas(nearest, f"cell_id {vectors.schema['cell_id'].dataType.simpleString()}, cluster string")


def cell_vectors(values: DataFrame, cells: DataFrame, n_genes: int, width: int = 256) -> DataFrame:
    """cell_id, values: dense for few genes, else folded by a signed hash of the gene into ``width`` places, which keeps distances on average."""
    if n_genes <= width:
        place, sign = F.col("gene_ix"), F.lit(1.0)
        width = max(1, n_genes)
    else:
        place = F.pmod(F.xxhash64(F.lit(1), "gene_ix"), F.lit(width)).cast("int")
        sign = F.when(F.pmod(F.xxhash64(F.lit(2), "gene_ix"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = values.groupBy("cell_id", place.alias("p")).agg(F.sum(F.col("value") * sign).alias("v")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(spread).alias("values"))


def variance_pool(values: DataFrame, cells: DataFrame, n_genes: int, params: Params = Params()) -> tuple[DataFrame, dict]:
    vectors = cell_vectors(values, cells, n_genes)
    labelled = written(graph_clusters(vectors, params.variance_comps, params.variance_neighbors, params.variance_resolution, params.max_graph_cells), "clusters")
    ranked = cluster_variance(values, labelled, n_genes)
    rows = {r["cluster"]: r["variance"] for r in ranked.collect()}  # one row a cluster
    winner = min(sorted(rows), key=rows.get) if rows else None
    return labelled.select("cell_id", (F.col("cluster") == F.lit(winner)).alias("is_ref")), {"n_clusters": len(rows), "winner_cluster": winner, "winner_variance": rows.get(winner), "all_variances": rows}


def finite_or_median(df: DataFrame, col: str) -> DataFrame:
    """Non-finite entries become the median of the others."""
    ok = ~F.isnan(col) & (F.abs(F.col(col)) != float("inf"))
    med = percentiles(df.where(ok), col, {"__med": 0.5}).select(F.coalesce("__med", F.lit(0.0)).alias("__med"))
    return df.crossJoin(F.broadcast(med)).withColumn(col, F.when(ok, F.col(col)).otherwise(F.col("__med"))).drop("__med")  # one row


def fitted_mixture(df: DataFrame, col: str, most: int = 2_000_000) -> tuple[list[float], list[float], list[float]]:
    """(weights, means, variances) of two Gaussians, the first with the smaller mean.

    Up to ``most`` rows the numbers are collected and fitted on the driver; beyond,
    every step is an aggregation over all of them. Both are the same fit.
    """
    if df.count() <= most:
        return tuple(x.tolist() for x in two_gaussians(np.array([r[0] for r in df.select(col).collect()], float)))
    return mixture_by_aggregates(written(df.select(F.col(col).cast("double").alias("x")), "mixture"))


def mixture_by_aggregates(df: DataFrame, steps: int = 100, tol: float = 1e-3, floor: float = 1e-6) -> tuple[list[float], list[float], list[float]]:
    """The fit of ``two_gaussians`` on column x, by sums over all rows; only a row of sums reaches the driver at each step."""
    x = F.col("x")
    a, b = percentiles(df, "x", {"a": 0.1, "b": 0.9}).first()
    centre, total = df.agg(F.avg("x"), F.count("*")).first()
    for _ in range(100):
        cut = (a + b) / 2
        r = df.agg(F.avg(F.when(x <= cut, x)), F.avg(F.when(x > cut, x))).first()
        if r[0] is None or r[1] is None:  # one value only
            cut = r[0] if r[1] is None else r[1]
            break
        if (r[0], r[1]) == (a, b):
            break
        a, b = r
    high = F.when(x <= cut, 0.0).otherwise(1.0)
    before, y = -np.inf, x - F.lit(centre)
    for step in range(steps + 1):
        sums = [F.sum(high), F.sum(high * y), F.sum(high * y * y), F.sum(y), F.sum(y * y)]
        told = df.agg(*sums, F.avg(like) if step else F.lit(0.0)).first()
        if step and (step == steps or abs(told[5] - before) < tol):
            break
        if step:
            before = told[5]
        n = np.array([total - told[0], told[0]]) + 10 * np.finfo(float).eps
        s, q = np.array([told[3] - told[1], told[1]]), np.array([told[4] - told[2], told[2]])
        w, m = n / total, s / n
        v = np.maximum(q / n - m * m, 0.0) + floor
        logs = [F.lit(float(np.log(w[i]) - 0.5 * np.log(2 * np.pi * v[i]))) - F.pow(y - float(m[i]), 2) / (2 * float(v[i])) for i in (0, 1)]
        top = F.greatest(*logs)
        like = top + F.log(F.exp(logs[0] - top) + F.exp(logs[1] - top))
        high = F.exp(logs[1] - like)
    o = np.argsort(m, kind="stable")
    return w[o].tolist(), (m[o] + centre).tolist(), v[o].tolist()


def mixture_pool(values: DataFrame, cells: DataFrame, n_genes: int) -> tuple[DataFrame, dict]:
    v = finite_or_median(cell_variance(values, cells, n_genes), "variance")
    v = written(v, "variance")
    w, m, s = fitted_mixture(v, "variance")
    high = F.log(F.lit(w[1])) - 0.5 * (F.log(F.lit(s[1])) + F.pow(F.col("variance") - m[1], 2) / s[1])
    low = F.log(F.lit(w[0])) - 0.5 * (F.log(F.lit(s[0])) + F.pow(F.col("variance") - m[0], 2) / s[0])
    return v.select("cell_id", (low >= high).alias("is_ref")), {"component_means": m, "low_component": 0}


def pick_pool(values: DataFrame, cells: DataFrame, axis: DataFrame, *, names: DataFrame | None = None, signatures: dict | None = None, labels: list[str] | None = None, params: Params = Params()) -> tuple[DataFrame, dict]:
    """(cells with is_ref, diagnostics). Which tier is used depends on counts, so each tier is one action."""
    spark = cells.sparkSession
    if names is not None:
        flagged, facts = supervised_pool(cells, names)
        flagged, d = written(flagged, "pool"), facts.first().asDict()
        n = flagged.where("is_ref").count()
        if n == 0:
            raise ValueError(f"the supplied reference matched 0 cells (supplied {d['n_supplied']}, unmatched {d['n_unmatched']})")
        return flagged, {"method": "supervised", "n_normal": n, "diagnostics": d}
    n_genes = axis.count()
    library, allowed = checked_signatures(signatures, labels) if signatures else ({}, [])
    tried: dict = {}
    if library:
        table = signature_table(spark, library)
        # names off the axis have no index and keep their capped rank
        indexed = table.join(axis.select("gene", "gene_ix"), "gene", "left").withColumn("gene_ix", F.coalesce("gene_ix", F.lit(-1)))
        pool = written(signature_pool(ucell_scores(values, cells, indexed, params.ucell_max_rank), allowed, params.normal_score_threshold), "signature")
        n = pool.where("is_ref").count()
        by_label = {r[0]: r[1] for r in pool.where(F.col("top_score") >= params.normal_score_threshold).groupBy("top_label").count().collect()}
        tried["signature"] = {"n_normal": n, "per_label": by_label, "median_top_score": pool.agg(F.median("top_score")).first()[0]}
        if n >= params.min_normal_cells:
            return cells.join(pool.select("cell_id", "is_ref"), "cell_id"), {"method": "signature", "n_normal": n, "diagnostics": tried["signature"]}
    pool, d = variance_pool(values, cells, n_genes, params)
    n = pool.where("is_ref").count()
    tried["variance"] = {**d, "n_normal": n}
    if n >= params.min_normal_cells:
        return cells.join(pool, "cell_id"), {"method": "variance", "n_normal": n, "diagnostics": tried}
    pool, d = mixture_pool(values, cells, n_genes)
    pool = written(pool, "mixture")
    n = pool.where("is_ref").count()
    return cells.join(pool, "cell_id"), {"method": "gmm_fallback", "n_normal": n, "diagnostics": {**tried, "gmm": d}}


