"""Deviation, template, score, mixture, gates and subclones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentiles
from ..params import Params
from ..session import written
from .m2 import fitted_mixture, graph_clusters
from .m3 import reference_baseline


def weighted_median_rows(cn: DataFrame, weights: DataFrame) -> DataFrame:
    """cell_id, med: least value whose cumulative weight reaches half the total, not interpolated; 0 without weight."""
    line = Window.partitionBy("cell_id").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    total = F.sum("w").over(Window.partitionBy("cell_id"))
    acc = cn.join(F.broadcast(weights.select("segment_id", F.col("n_genes").cast("double").alias("w"))), "segment_id").select("cell_id", "value", F.sum("w").over(line).alias("acc"), total.alias("total"))
    return acc.groupBy("cell_id").agg(F.coalesce(F.min(F.when((F.col("acc") >= F.col("total") / 2) & (F.col("total") > 0), F.col("value"))), F.lit(0.0)).alias("med"))


def deviation(cn: DataFrame, baseline: DataFrame, weights: DataFrame | None) -> DataFrame:
    """cn minus the segment's reference, minus the cell's weighted median (left out without weights)."""
    rel = cn.join(F.broadcast(baseline), "segment_id").select("cell_id", "segment_id", (F.col("value") - F.col("baseline")).alias("value"))
    if weights is None:
        return rel
    return rel.join(weighted_median_rows(rel, weights), "cell_id").select("cell_id", "segment_id", (F.col("value") - F.col("med")).alias("value"))


def burden(dev: DataFrame, weights: DataFrame | None) -> DataFrame:
    """cell_id, burden: weighted mean of absolute deviation; without weights its plain sum; 0 for no weight."""
    if weights is None:
        return dev.groupBy("cell_id").agg(F.sum(F.abs("value")).alias("burden"))
    w = dev.join(F.broadcast(weights.select("segment_id", F.col("n_genes").cast("double").alias("w"))), "segment_id")
    return w.groupBy("cell_id").agg(F.sum(F.col("w") * F.abs("value")).alias("s"), F.sum("w").alias("t")).select("cell_id", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("burden"))


def template_of(dev: DataFrame, burdens: DataFrame, excluded: DataFrame | None = None, quantile: float = Params.template_seed_quantile) -> DataFrame:
    """segment_id, t: mean of the seeds' deviations, each seed scaled to unit burden."""
    flagged = burdens.withColumn("out", F.lit(False)) if excluded is None else burdens.join(excluded.select("cell_id", F.col("low_complexity").alias("out")), "cell_id", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    counts = flagged.agg(F.count_if(~F.col("out")).alias("n_in"))
    eligible = flagged.crossJoin(F.broadcast(counts)).where((F.col("n_in") == 0) | ~F.col("out"))  # one row
    cut = percentiles(eligible, "burden", {"thr": quantile})
    seeds = eligible.crossJoin(F.broadcast(cut)).where((F.col("burden") >= F.col("thr")) & (F.col("burden") > 0)).select("cell_id", "burden")
    found = dev.join(seeds, "cell_id").groupBy("segment_id").agg(F.avg(F.col("value") / F.col("burden")).alias("t"))
    return dev.select("segment_id").distinct().join(found, "segment_id", "left").select("segment_id", F.coalesce("t", F.lit(0.0)).alias("t"))


def projection(dev: DataFrame, template: DataFrame, weights: DataFrame | None) -> DataFrame:
    """cell_id, score: signed deviation along the template, in units of deviation; 0 for a zero template."""
    w = template.join(weights.select("segment_id", F.col("n_genes").cast("double").alias("w")), "segment_id") if weights is not None else template.withColumn("w", F.lit(1.0))
    sums = dev.join(F.broadcast(w), "segment_id").groupBy("cell_id").agg(F.sum(F.col("w") * F.col("t") * F.col("value")).alias("s"), F.sum(F.abs(F.col("w") * F.col("t"))).alias("d"))
    return sums.select("cell_id", F.when(F.col("d") > 0, F.col("s") / F.col("d")).otherwise(0.0).alias("score"))


def low_complexity(detected: DataFrame, frac: float = Params.low_complexity_frac) -> DataFrame:
    """cell_id, low_complexity: fewer genes than ``frac`` of the median cell."""
    med = percentiles(detected, "detected", {"m": 0.5})
    return detected.crossJoin(F.broadcast(med)).select("cell_id", ((F.col("m") > 0) & (F.col("detected") < frac * F.col("m"))).alias("low_complexity"))  # one row


def coherent_fraction(dev: DataFrame, segments: DataFrame, window: int = Params.coherence_window) -> DataFrame:
    """cell_id, coherent: share of the deviation that its neighbours on the chromosome bear out."""
    sizes = segments.groupBy("chr").agg(F.count("*").cast("int").alias("n"))
    placed = dev.join(F.broadcast(segments.select("segment_id", "chr").join(sizes, "chr")), "segment_id")
    line = Window.partitionBy("cell_id", "chr").orderBy("segment_id")
    local = None
    for w in range(1, window + 1):
        mean = F.avg("value").over(line.rowsBetween(-(w // 2), w - w // 2 - 1))
        case = (F.col("n") >= w) if w == window else (F.col("n") == w)
        local = F.when(case, mean) if local is None else local.when(case, mean)
    placed = placed.withColumn("local", local)
    part = F.when(F.signum("value") == F.signum("local"), F.least(F.abs("value"), F.abs("local"))).otherwise(0.0)
    return placed.groupBy("cell_id").agg((F.sum(part) / (F.sum(F.abs("value")) + 1e-9)).alias("coherent"))


def altered_segments(dev: DataFrame, threshold: float = Params.altered_threshold) -> DataFrame:
    return dev.groupBy("cell_id").agg(F.count_if(F.abs("value") > threshold).alias("n_segments_altered"))


def winsor_and_fences(scores: DataFrame, mult: float = Params.outlier_fence_mult, gate: float = Params.coherence_gate) -> DataFrame:
    """scores (cell_id, score, is_ref, coherent) with clipped and fenced.

    Bounds are the 1st and 99th percentile of all scores. With at least 10
    reference cells and spread scores, what lies ``mult`` quartile ranges below
    the reference leaves the fit, and above it, where a cell is not of the
    reference and not coherent.
    """
    bounds = percentiles(scores, "score", {"lo": 0.01, "hi": 0.99})
    of_ref = percentiles(scores.where("is_ref"), "score", {"q25": 0.25, "q75": 0.75})
    p = bounds.crossJoin(of_ref).crossJoin(scores.agg(F.count_if("is_ref").alias("n_ref")))  # one row each
    clipped = scores.crossJoin(F.broadcast(p)).withColumn("clipped", F.least(F.greatest("score", "lo"), F.col("hi")))  # one row
    spread = clipped.agg(F.stddev_pop("clipped").alias("spread"))
    iqr = F.col("q75") - F.col("q25")
    low = F.col("score") < F.col("q25") - mult * iqr
    high = (~F.col("is_ref") & (F.col("score") > F.col("q75") + mult * iqr) & (F.col("coherent") < gate)) if gate and gate > 0 else F.lit(False)
    fenced = (F.col("n_ref") >= 10) & (F.col("spread") >= 1e-10) & F.coalesce(low | high, F.lit(False))
    return clipped.crossJoin(F.broadcast(spread)).withColumn("fenced", F.coalesce(fenced, F.lit(False))).select(*scores.columns, "clipped", "fenced")  # one row


def mixture_calls(scores: DataFrame, params: Params = Params()) -> tuple[DataFrame, int]:
    """(scores with class and confidence, number fenced). The fit sees one number a cell; posteriors are expressions."""
    prepared = written(winsor_and_fences(scores, params.outlier_fence_mult, params.coherence_gate), "scores")
    fit = prepared.where(~F.col("fenced"))
    spread = fit.agg(F.stddev_pop("clipped")).first()[0] or 0.0
    n_fenced = prepared.where("fenced").count()
    if spread < 1e-10:
        return prepared.select(*scores.columns, F.lit("normal").alias("class"), F.lit(1.0).alias("confidence")), n_fenced
    w, m, v = fitted_mixture(fit, "clipped")
    log = [F.lit(w[i]) * 0 + F.log(F.lit(w[i])) - 0.5 * (F.log(F.lit(v[i])) + F.pow(F.col("clipped") - m[i], 2) / v[i]) for i in (0, 1)]
    p = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log[0] - log[1]))))
    sure = F.greatest("p", 1 - F.col("p"))
    called = prepared.withColumn("p", p).withColumn("confidence", sure)
    label = F.when(F.col("confidence") < params.call_confidence, "uncertain").when(F.col("is_ref"), "normal").when(F.col("p") > 0.5, "tumor").otherwise("normal")
    return called.select(*scores.columns, label.alias("class"), "confidence"), n_fenced


def gates(calls: DataFrame, params: Params = Params()) -> DataFrame:
    """Low complexity, then coherence, then anti-alignment; a gated cell is uncertain with 1 - confidence.

    calls: cell_id, class, confidence, score, burden, coherent, low_complexity, is_ref.
    """
    one = calls.withColumn("class0", F.col("class")).withColumn("class", F.when((F.col("class") == "tumor") & F.col("low_complexity") & F.lit(params.complexity_gate), "uncertain").otherwise(F.col("class")))
    if params.coherence_gate and params.coherence_gate > 0:
        one = one.withColumn("class", F.when((F.col("class") == "tumor") & (F.col("coherent") < params.coherence_gate), "uncertain").otherwise(F.col("class")))
    tumor = F.col("class") == "tumor"
    scores, burdens = (percentiles(one.where(tumor), c, {c: 0.5}) for c in ("score", "burden"))
    refs = one.agg(F.count_if(tumor).alias("n_tumor")).crossJoin(scores.select((params.anti_aligned_frac * F.col("score")).alias("score_ref"))).crossJoin(burdens.select((params.anti_aligned_frac * F.col("burden")).alias("burden_ref")))  # one row each
    anti = (
        (F.col("n_tumor") >= params.anti_aligned_min_tumor) & (F.col("score_ref") > 0) & (F.col("class") == "normal") & ~F.col("low_complexity") & ~F.col("is_ref")
        & (F.col("score") <= -F.col("score_ref")) & (F.col("burden") >= F.col("burden_ref")) & (F.col("coherent") >= params.coherence_support)
    )
    two = one.crossJoin(F.broadcast(refs)).withColumn("anti_aligned", F.coalesce(anti, F.lit(False)))  # one row
    final = F.when(F.col("anti_aligned"), "uncertain").otherwise(F.col("class"))
    gated = F.col("class0") != final
    return two.select(*[c for c in calls.columns if c not in ("class", "confidence")], final.alias("class"), F.when(gated, 1 - F.col("confidence")).otherwise(F.col("confidence")).alias("confidence"), "anti_aligned")


def relabel_clusters(labelled: DataFrame, max_subclones: int = Params.max_subclones) -> DataFrame:
    """cell_id, subclone: the largest clusters keep apart, the rest joins the largest; subclone_1 is the largest."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "cluster")))
    largest = ranked.where("r = 1").select(F.col("cluster").alias("largest"))
    merged = labelled.join(ranked, "cluster").crossJoin(F.broadcast(largest)).select("cell_id", F.when(F.col("r") <= max_subclones, F.col("cluster")).otherwise(F.col("largest")).alias("cluster"))  # one row
    order = merged.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "cluster")))
    return merged.join(order, "cluster").select("cell_id", F.concat(F.lit("subclone_"), F.col("r").cast("string")).alias("subclone"))


def subclones(dev: DataFrame, calls: DataFrame, params: Params = Params()) -> DataFrame:
    """cell_id, subclone for all cells of ``calls``; empty for non-tumor cells, and for all if subclones aren't wanted."""
    if not params.subclones:
        return calls.select("cell_id", F.lit("").alias("subclone"))
    tumor = calls.where(F.col("class") == "tumor").select("cell_id")
    if (n := tumor.count()) < params.min_tumor_cells:
        return calls.select("cell_id", F.when(F.col("class") == "tumor", "subclone_1").otherwise("").alias("subclone"))
    del n
    vectors = dev.join(tumor, "cell_id", "left_semi").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "value"))), lambda x: x["value"]).alias("values"))
    found = graph_clusters(vectors, 30, 15, params.subclone_sweep, params.max_graph_cells, lambda k: k <= params.max_subclones)
    named = relabel_clusters(found, params.max_subclones)
    return calls.select("cell_id").join(named, "cell_id", "left").select("cell_id", F.coalesce("subclone", F.lit("")).alias("subclone"))


def classify_cells(cn: DataFrame, segments: DataFrame, cells: DataFrame, detected: DataFrame | None = None, params: Params = Params()) -> tuple[DataFrame, dict]:
    """(predictions, counters). cells: cell_id, is_ref; detected: cell_id, detected genes, or None."""
    weights = segments.select("segment_id", "n_genes")
    base = reference_baseline(cn, cells)
    dev = written(deviation(cn, base, weights), "deviation")
    b = written(burden(dev, weights), "burden")
    low = low_complexity(detected, params.low_complexity_frac) if detected is not None else cells.select("cell_id", F.lit(False).alias("low_complexity"))
    t = written(template_of(dev, b, low), "template")
    scored = cells.select("cell_id", "is_ref").join(projection(dev, t, weights), "cell_id").join(b, "cell_id").join(low, "cell_id", "left").join(coherent_fraction(dev, segments, params.coherence_window), "cell_id")
    scored = scored.withColumn("low_complexity", F.coalesce("low_complexity", F.lit(False)))
    calls, n_fenced = mixture_calls(scored, params)
    gated = written(gates(calls, params), "calls")
    clones = subclones(dev, gated, params)
    out = gated.join(clones, "cell_id").join(altered_segments(dev, params.altered_threshold), "cell_id")
    n_low = gated.where("low_complexity and class = 'uncertain'").count()
    return out.select("cell_id", "class", "confidence", F.col("score").alias("tumor_score"), "subclone", "n_segments_altered", "low_complexity", F.col("burden").alias("cn_burden")), {"n_outlier_fenced": n_fenced, "n_low_complexity_gated": n_low, "n_anti_aligned_gated": gated.where("anti_aligned").count()}


def share(condition: Column, of: Column) -> Column:
    return F.avg(F.when(of, condition.cast("double")))
