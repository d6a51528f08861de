"""Operators against numpy restatements, on seeded cohorts with planted answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ploidia.functions import kernels as k
from ploidia.functions.ranks import percentiles
from ploidia.operators import evaluate, m1, m2, m3, m4, outputs
from ploidia.params import Params
from ploidia.plans.pipeline import call_cnv, run_pipeline

WIDTH = 120


@pytest.fixture(scope="module")
def cohort(spark):
    """60 normal and 60 tumor cells, three chromosomes of 120 genes; chr2 gained, chr3's first half lost in tumors."""
    rng = np.random.default_rng(2026)
    x = rng.poisson(3, (120, 3 * WIDTH)).astype(float)
    x[60:, WIDTH : 2 * WIDTH] = np.floor(x[60:, WIDTH : 2 * WIDTH] * 2.5)
    x[60:, 2 * WIDTH : 2 * WIDTH + 60] = np.floor(x[60:, 2 * WIDTH : 2 * WIDTH + 60] * 0.3)
    counts = spark.createDataFrame([(f"c{i:03d}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([(f"c{i:03d}", "normal" if i < 60 else "tumor") for i in range(120)], "cell_id string, kind string")
    genes = spark.createDataFrame([(f"g{j}", j) for j in range(3 * WIDTH)], "gene string, orig_ix long")
    order = spark.createDataFrame([(f"g{j}", f"chr{1 + j // WIDTH}", j // WIDTH, 100 * (j % WIDTH), 100 * (j % WIDTH) + 50) for j in range(3 * WIDTH)], "gene_symbol string, chr string, chr_rank int, start long, end long")
    return x, counts.cache(), cells.cache(), genes.cache(), order.cache()


PARAMS = Params(min_genes=50, min_seg_genes=20)


@pytest.fixture(scope="module")
def projected(cohort):
    x, counts, cells, genes, order = cohort
    values, kept, axis = m1.filter_normalize_project(counts, cells, genes, order, params=PARAMS)
    return values.cache(), kept.withColumn("is_ref", F.col("kind") == "normal").cache(), axis.cache()


def dense(df, key="gene_ix"):
    p = df.toPandas().pivot(index="cell_id", columns=key, values="value")
    return p.sort_index().fillna(0.0).to_numpy()


def test_filters_and_normalisation(cohort, projected):
    x, *_ = cohort
    values, kept, axis = projected
    assert kept.count() == 120 and axis.count() == 3 * WIDTH
    want = np.log1p(x * 1e4 / x.sum(1, keepdims=True))
    assert np.allclose(dense(values), want)


def test_negative_tables_pass_unchanged(spark):
    d = spark.createDataFrame([("a", "g", -1.0), ("b", "g", 3.0)], "cell_id string, gene string, value double")
    assert sorted(r.value for r in m1.normalize_log1p(d).collect()) == [-1.0, 3.0]


def test_cells_without_counts_count_zero(spark, cohort):
    _, counts, *_ = cohort
    cells = spark.createDataFrame([("nobody",), ("c000",)], "cell_id string")
    assert [(r.cell_id, r.n_genes > 0) for r in m1.cell_filter(counts, cells, 0).orderBy("cell_id").collect()] == [("c000", True), ("nobody", False)]


@pytest.mark.parametrize("pool", [0, 1, 37, 60])
def test_gene_medians(projected, pool):
    values, kept, axis = projected
    cells = kept.withColumn("is_ref", F.col("cell_id") < f"c{pool:03d}")
    got = [r.med for r in m3.gene_medians(values, cells, axis).orderBy("gene_ix").collect()]
    v = dense(values)
    assert np.allclose(got, np.median(v[:pool] if pool else v, axis=0))


def test_smoothing_and_linear_path(projected):
    values, kept, axis = projected
    med = m3.gene_medians(values, kept, axis).cache()
    got = dense(m3.smoothed(m3.centered(values, kept, axis, med), axis, ["cell_id"], 30))
    c = dense(values) - np.median(dense(values)[:60], axis=0)
    want = np.concatenate([c[:, a : a + WIDTH] @ k.smoothing_matrix(WIDTH, 30).T for a in (0, WIDTH, 2 * WIDTH)], axis=1)
    assert np.allclose(got, want)
    segs = m3.segments_from_pooled(m3.pooled_signal(values, kept, axis, med, 30), axis, 1.0, 20).cache()
    kernel = m3.segment_kernel(axis, segs, 30)
    cn = dense(m3.segment_cn(values, kept, segs, kernel, med), "segment_id")
    bounds = [(r.start_idx, r.end_idx) for r in segs.orderBy("segment_id").collect()]
    assert np.allclose(cn, np.stack([want[:, a:b].mean(1) for a, b in bounds], 1))
    assert any(abs(a - (2 * WIDTH + 60)) < 20 for a, _ in bounds)  # the planted break


def test_breakpoints_minimise_the_objective():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 30), rng.normal(3, 1, 25), rng.normal(0, 1, 20)])
    cost = lambda ends: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 4.0 for a, b in zip([0, *ends[:-1]], ends, strict=True))
    got = k.breakpoints(x, 4.0, 5)
    assert all(cost(got) <= cost([a, b, 75]) + 1e-9 for a in range(5, 60) for b in range(a + 5, 71))
    assert k.segment_chromosome(np.zeros(10), 1, 25) == [] and k.segment_chromosome(np.zeros(60), 1, 25) == [(0, 60)]


def test_weighted_median_has_no_interpolation(spark):
    cn = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 1.0, 3.0, 2.0])], "cell_id string, segment_id int, value double")
    w = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 1, 2])], "segment_id int, n_genes int")
    assert m4.weighted_median_rows(cn, w).first()["med"] == 2.0
    assert m4.weighted_median_rows(cn, w.withColumn("n_genes", F.lit(0))).first()["med"] == 0.0


def test_coherence(spark):
    dev = spark.createDataFrame([(c, i, v) for c, vs in {"run": [0.5] * 6, "alternating": [0.5, -0.5] * 3}.items() for i, v in enumerate(vs)], "cell_id string, segment_id int, value double")
    segs = spark.createDataFrame([(i, "chr1", 30) for i in range(6)], "segment_id int, chr string, n_genes int")
    got = {r.cell_id: r.coherent for r in m4.coherent_fraction(dev, segs).collect()}
    assert got["run"] == pytest.approx(1.0, abs=1e-6) and got["alternating"] < 0.5


def test_mixture_recovers_planted_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, 300), rng.normal(1, 0.2, 100)])
    w, m, v = k.two_gaussians(x)
    assert m == pytest.approx([0, 1], abs=0.06) and w == pytest.approx([0.75, 0.25], abs=0.03)
    assert (k.posterior_high(x, (w, m, v)) > 0.5).sum() == pytest.approx(100, abs=4)


def test_degenerate_scores_are_normal(spark):
    s = spark.createDataFrame([(str(i), 0.0, True, 1.0) for i in range(20)], "cell_id string, score double, is_ref boolean, coherent double")
    calls, fenced = m4.mixture_calls(s)
    assert {(r["class"], r.confidence) for r in calls.collect()} == {("normal", 1.0)} and fenced == 0


def test_communities_and_ward():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (30, 4)) for c in (0, 3, 6)])
    own = k.communities(k.neighbour_graph(x, 10), 0.3)
    assert len(set(own.tolist())) == 3 and all(len(set(own[a : a + 30].tolist())) == 1 for a in (0, 30, 60))
    order = k.ward_order(x, 100)
    assert sorted(order.tolist()) == list(range(90))
    assert sum(a // 30 != b // 30 for a, b in zip(order[:-1], order[1:], strict=True)) == 2
    assert k.ward_order(x, 50).tolist() == list(range(90))


def test_run_finds_the_planted_events(cohort):
    _, counts, cells, genes, order = cohort
    out, qc = call_cnv(counts, cells, genes, order, reference_key="kind", reference_cat="normal", params=PARAMS)
    rows = out.collect()
    assert qc["baseline_method"] == "supervised" and qc["n_normal_reference"] == 60
    assert np.mean([r.cnv_class == "tumor" for r in rows if r.kind == "tumor"]) >= 0.8
    assert np.mean([r.cnv_class == "normal" for r in rows if r.kind == "normal"]) >= 0.8
    gain = lambda kind: np.mean([r.cnv_chr["chr2"] / r.cnv_chr["chr1"] for r in rows if r.kind == kind])
    assert gain("tumor") > gain("normal") + 0.2


def test_tiers_fall_through_without_a_reference(cohort):
    _, counts, cells, genes, order = cohort
    r = run_pipeline(counts, cells, genes, order, signatures={}, params=Params(min_genes=50, min_seg_genes=20, min_normal_cells=50))
    assert r.qc["baseline_method"] in ("variance", "gmm_fallback")
    ref = {x.cell_id for x in r.cells.where("is_ref").collect()}
    assert len([c for c in ref if c < "c060"]) > 0.9 * len(ref)


def test_errors(spark, cohort):
    _, counts, cells, genes, order = cohort
    with pytest.raises(ValueError, match="unique"):
        call_cnv(counts, cells.union(cells.limit(1)), genes, order)
    with pytest.raises(ValueError, match="no column"):
        call_cnv(counts, cells, genes, order, reference_key="nope", reference_cat="x")
    with pytest.raises(ValueError, match="matched 0"):
        run_pipeline(counts, cells, genes, order, names=spark.createDataFrame([("zz",)], "cell_id string"), params=PARAMS)
    with pytest.raises(ValueError, match="finite"):
        outputs.denoise(counts, cells, float("nan"))
    with pytest.raises(ValueError, match="finite"):
        Params(sd_amplifier=float("inf"))


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_partitions_do_not_matter(spark, projected, partitions):
    values, kept, axis = projected
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        v = values.repartition(partitions)
        got = {r.gene_ix: r.med for r in m3.gene_medians(v, kept, axis).collect()}
        assert got == {r.gene_ix: r.med for r in m3.gene_medians(values, kept, axis).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    s, p = rng.integers(0, 20, 300).astype(float), rng.random(300) < 0.4
    want = np.mean([(a > b) + (a == b) / 2 for a in s[p] for b in s[~p]])
    d = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, p, strict=True)], "score double, pos boolean")
    assert evaluate.auc(d, "score", "pos").first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize(
    "x, y", [([1.0, 2.0, 4.0, 8.0], [0.5, -1.0, 2.0, 3.0]), ([1.0, 2.0, 4.0], [0.1, 0.1, 0.1]), ([2.0, 2.0], [1.0, 3.0]), ([2.0], [1.0]), ([], [])]
)
def test_bulk_correlation_without_spread(spark, x, y):
    table = lambda v: spark.createDataFrame([(str(i), a) for i, a in enumerate(v)], "region string, value double")
    got = evaluate.bulk_correlation(table(x), table(y)).first()["pearson"]
    if not x:
        assert got is None
    elif len(set(x)) == 1 or len(set(y)) == 1:
        assert np.isnan(got)
    else:
        assert got == pytest.approx(np.corrcoef(np.log2(x), y)[0, 1])


def test_ucell(spark):
    values = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 4, 4, 1])], "cell_id string, gene_ix int, value double")
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    sig = spark.createDataFrame([(0, "top", 0), (0, "top", 1), (1, "off", 9)], "label_ix int, label string, gene_ix int")
    got = {(r.cell_id, r.label): r.score for r in m2.ucell_scores(values, cells, sig, 10).collect()}
    assert got[("a", "top")] == pytest.approx(1 - (1 + 2.5 - 3) / (20 - 3))
    assert got[("b", "off")] == pytest.approx(1 - (11 - 1) / (10 - 1)) and got[("a", "off")] == got[("b", "off")]


@pytest.mark.parametrize(("n", "accuracy"), [(0, 100), (1, 100), (2, 10), (5, 100), (10, 10_000), (19, 10), (20, 10), (21, 10), (997, 50), (3000, 10), (3000, 1500)])
def test_exact_percentiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    v = rng.normal(0, 1, n) if n == 3000 else np.round(rng.normal(0, 1, n), 1)  # with ties, and without
    rows = [(int(i % 3), float(x)) for i, x in enumerate(v)] + [(0, None), (2, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    wanted = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.99, "g_": 1.0}
    got = percentiles(df, "v", wanted, accuracy=accuracy, small=0).collect()
    assert got == percentiles(df, "v", wanted).collect() or got[0] == pytest.approx(tuple(percentiles(df, "v", wanted).first()))
    assert len(got) == 1
    assert list(got[0]) == ([None] * 7 if n == 0 else pytest.approx([np.quantile(v, p) for p in wanted.values()]))
    for r in percentiles(df, "v", wanted, ("g",), accuracy, 0).collect():
        own = v[np.arange(n) % 3 == r.g]
        assert [r[k] for k in wanted] == pytest.approx([np.quantile(own, p) for p in wanted.values()])


@pytest.mark.parametrize("shape", ["apart", "close", "one value"])
def test_mixture_by_sums_is_the_collected_fit(spark, shape):
    rng = np.random.default_rng(5)
    x = {"apart": np.concatenate([rng.normal(0, 0.1, 900), rng.normal(1, 0.2, 300)]), "close": np.concatenate([rng.normal(0, 1, 600), rng.normal(1.5, 0.5, 600)]), "one value": np.full(50, 2.5)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x], "score double").repartition(3)
    small, large = m2.fitted_mixture(df, "score", most=10), m2.fitted_mixture(df, "score")
    if shape == "one value":
        assert small[1] == pytest.approx([2.5, 2.5], abs=1e-6) and large[1] == pytest.approx([2.5, 2.5], abs=1e-6)
    else:
        for a, b in zip(small, large, strict=True):
            assert a == pytest.approx(b, rel=1e-6, abs=1e-9)


def test_neighbours_and_components_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 7)) * np.arange(1, 8)
    r = k.principal_components(x, 3)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c)
    assert np.allclose(np.abs(r), np.abs(c @ vectors[:, ::-1][:, :3]))
    graph = k.neighbour_graph(r, 5)
    apart = ((r[:, None] - r[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    near = [set(np.argsort(a, kind="stable")[:5].tolist()) for a in apart]
    assert [set(g) for g in graph] == [near[i] | {j for j in range(40) if i in near[j]} for i in range(40)]


def _modularity(graph, own, resolution):
    total = sum(sum(d.values()) for d in graph)
    degree = np.array([sum(d.values()) for d in graph])
    inside = sum(w for i, d in enumerate(graph) for j, w in d.items() if own[i] == own[j])
    return inside / total - resolution * sum((degree[own == c].sum() / total) ** 2 for c in set(own.tolist()))


def test_communities_by_brute_force():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(5):
        n = 8
        graph = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < (0.9 if i // 4 == j // 4 else 0.1):
                graph[i][j] = graph[j][i] = 1.0
        if not any(graph):
            continue
        got = _modularity(graph, k.communities(graph, 1.0), 1.0)
        best = max(_modularity(graph, np.array(p), 1.0) for p in itertools.product(range(3), repeat=n))
        assert got >= 0.95 * best - 1e-9


def test_variance_pool_by_numpy(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(1, 0.05, (40, 30)), rng.normal(3, 1.5, (30, 30))]).clip(0)
    values = spark.createDataFrame([(f"c{i:02d}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "cell_id string, gene_ix int, value double")
    cells = spark.createDataFrame([(f"c{i:02d}",) for i in range(70)], "cell_id string")
    pool, facts = m2.variance_pool(values, cells, 30)
    own = k.communities(k.neighbour_graph(k.principal_components(x, 29), 15), 1.0)
    variance = {str(c): x[own == c].var(0).mean() if (own == c).sum() > 1 else np.inf for c in set(own.tolist())}
    assert facts["all_variances"] == pytest.approx(variance)
    winner = min(sorted(variance), key=variance.get)
    assert {r.cell_id for r in pool.where("is_ref").collect()} == {f"c{i:02d}" for i in np.flatnonzero(own == int(winner))}


def test_panels_are_in_leaf_order(spark):
    rng = np.random.default_rng(4)
    n = 60
    x = rng.normal(0, 1, (n, 5))
    kind = ["normal"] * 20 + ["tumor"] * 30 + ["uncertain"] * 10
    clone = [""] * 20 + [f"subclone_{1 + i % 3}" for i in range(30)] + [""] * 10
    burden = rng.random(n)
    calls = spark.createDataFrame([(f"c{i:02d}", kind[i], clone[i], i % 7 == 0, float(burden[i])) for i in range(n)], "cell_id string, class string, subclone string, low_complexity boolean, cn_burden double")
    signal = spark.createDataFrame([(f"c{i:02d}", j, float(x[i, j])) for i in range(n) for j in range(5)], "cell_id string, segment_id int, value double")
    got = outputs.panels(signal, calls).orderBy("panel", "row").collect()
    clean = [i for i in range(n) if i % 7]
    cut = np.quantile([burden[i] for i in clean if i < 20], 0.5)
    want = []
    for panel, blocks in (("observations", [[i for i in clean if kind[i] == "tumor" and clone[i] == f"subclone_{c}"] for c in (1, 2, 3)]), ("references", [[i for i in clean if i < 20 and burden[i] <= cut]]), ("uncertain", [[i for i in clean if i >= 50]])):
        rows = [f"c{b[j]:02d}" for b in blocks for j in k.ward_order(x[b], 8000)]
        want += [(panel, r, c) for r, c in enumerate(rows)]
    assert [(r.panel, r.row, r.cell_id) for r in got] == want
    assert all(r["values"] == pytest.approx(x[int(r.cell_id[1:])].tolist()) for r in got)
    few = outputs.panels(signal, calls, n_ref=3, max_obs=6).groupBy("panel").count().collect()
    assert {r.panel: r["count"] for r in few} == {"references": 3, "observations": 6, "uncertain": 3}


def _ward_cost(x, order):
    """Sum of the merge costs of the best tree over a leaf order, by joining neighbours greedily."""
    blocks = [[i] for i in order]
    total = 0.0
    while len(blocks) > 1:
        cost = [len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() for a, b in zip(blocks, blocks[1:], strict=False)]
        i = int(np.argmin(cost))
        total += cost[i]
        blocks[i : i + 2] = [blocks[i] + blocks[i + 1]]
    return total


def _ward_brute(x):
    """Merges the cheapest of all pairs, again and again."""
    blocks, total = [[i] for i in range(len(x))], 0.0
    while len(blocks) > 1:
        cost, i, j = min((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(blocks) for j, b in enumerate(blocks) if i < j)
        total += cost
        blocks[i] = blocks[i] + blocks.pop(j)
    return total


def test_ward_order_by_brute_force():
    rng = np.random.default_rng(6)
    for n in (3, 5, 12, 25):
        x = rng.normal(0, 1, (n, 3))
        order = k.ward_order(x, 100)
        assert sorted(order.tolist()) == list(range(n))
        assert _ward_cost(x, order.tolist()) == pytest.approx(_ward_brute(x))
