"""SQL that restates whole steps: break points by dynamic programming, the mixture by its iterations, and the chain of calls.

Every function gives common table expressions, each beginning with a comma, over
the tables that its docstring names.
"""

from __future__ import annotations


def segments(min_genes: int, penalty: float = 1.0) -> str:
    """brk(chr, start_idx, end_idx): optimal break points of pooled(chr, gene_ix, value)."""
    least = max(min_genes, 2)
    return f""", pin AS (SELECT chr, min(gene_ix) AS first_ix, count(*)::INT AS n, median(value) AS md, stddev_pop(value) AS sd, {penalty} * ln(greatest(count(*), 2)) AS pen FROM pooled GROUP BY chr),
pre AS (SELECT chr, any_value(first_ix) AS first_ix, any_value(n) AS n, any_value(pen) AS pen, list_prepend(0.0, list(s ORDER BY gene_ix)) AS s, list_prepend(0.0, list(q ORDER BY gene_ix)) AS q
  FROM (SELECT chr, gene_ix, first_ix, n, pen, sum((value - md) / sd) OVER line AS s, sum(((value - md) / sd) ** 2) OVER line AS q FROM pooled JOIN pin USING (chr) WHERE n >= {2 * least} AND sd >= 1e-4 WINDOW line AS (PARTITION BY chr ORDER BY gene_ix ROWS UNBOUNDED PRECEDING)) GROUP BY chr),
dyn AS (WITH RECURSIVE d(chr, k, best, last) AS (
  SELECT chr, 0, [-pen], [0::BIGINT] FROM pre
  UNION ALL SELECT chr, k, list_append(best, coalesce(list_min(cost), 'inf'::DOUBLE)), list_append(last, coalesce(list_position(cost, list_min(cost)) - 1, 0)::BIGINT)
  FROM (SELECT d.chr, d.k + 1 AS k, best, last, list_transform(range(0, d.k + 1 - {least} + 1), lambda j: best[j + 1] + q[d.k + 2] - q[j + 1] - (s[d.k + 2] - s[j + 1]) ** 2 / (d.k + 1 - j) + pen) AS cost FROM d JOIN pre USING (chr) WHERE d.k < n))
  SELECT chr, last, first_ix, n FROM d JOIN pre USING (chr) WHERE k = n),
back AS (WITH RECURSIVE b(chr, first_ix, last, start, stop) AS (
  SELECT chr, first_ix, last, last[n + 1], n::BIGINT FROM dyn
  UNION ALL SELECT chr, first_ix, last, last[start + 1], start FROM b WHERE start > 0) SELECT chr, first_ix + start AS start_idx, first_ix + stop AS end_idx FROM b),
brk AS (SELECT * FROM back UNION ALL SELECT chr, first_ix, first_ix + n FROM pin WHERE (n < {2 * least} OR sd < 1e-4) AND n >= {min_genes})
"""


def _like(w: str, m: str, v: str) -> str:
    return f"{w} / sqrt(2 * pi() * {v}) * exp(-0.5 * (x - {m}) ** 2 / {v})"


def mixture(source: str) -> str:
    """mix(w0, m0, v0, w1, m1, v1): two Gaussians fitted to column x of ``source``, component 0 with the smaller mean."""
    both = lambda t: f"ln({_like(t + 'w0', t + 'm0', t + 'v0')} + {_like(t + 'w1', t + 'm1', t + 'v1')})"
    return f""", x0 AS ({source}), nx AS (SELECT count(*)::DOUBLE AS n FROM x0),
km AS (WITH RECURSIVE r(i, a, b, na, nb) AS (
  SELECT 0, a, b, (SELECT avg(x) FROM x0 WHERE x <= (a + b) / 2), (SELECT avg(x) FROM x0 WHERE x > (a + b) / 2) FROM (SELECT quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.9) AS b FROM x0)
  UNION ALL SELECT i + 1, na, nb, (SELECT avg(x) FROM x0 WHERE x <= (na + nb) / 2), (SELECT avg(x) FROM x0 WHERE x > (na + nb) / 2) FROM r WHERE i < 99 AND (na <> a OR nb <> b))
  SELECT (a + b) / 2 AS cut FROM r ORDER BY i DESC LIMIT 1),
em AS (WITH RECURSIVE e(i, w0, w1, m0, m1, v0, v1, ll, before) AS (
  SELECT 1, w0, w1, m0, m1, v0, v1, (SELECT avg({both('')}) FROM x0), NULL::DOUBLE
  FROM (SELECT count(*) FILTER (x <= cut) / max(n) AS w0, count(*) FILTER (x > cut) / max(n) AS w1, avg(x) FILTER (x <= cut) AS m0, avg(x) FILTER (x > cut) AS m1, var_pop(x) FILTER (x <= cut) + 1e-6 AS v0, var_pop(x) FILTER (x > cut) + 1e-6 AS v1 FROM x0 CROSS JOIN km CROSS JOIN nx)
  UNION ALL
  SELECT i + 1, s.w0, s.w1, s.m0, s.m1, s.v0, s.v1, (SELECT avg({both('s.')}) FROM x0), e.ll
  FROM e, LATERAL (SELECT sum(1 - r) / max(n) AS w0, sum(r) / max(n) AS w1, sum((1 - r) * x) / sum(1 - r) AS m0, sum(r * x) / sum(r) AS m1,
      sum((1 - r) * x * x) / sum(1 - r) - (sum((1 - r) * x) / sum(1 - r)) ** 2 + 1e-6 AS v0, sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) ** 2 + 1e-6 AS v1
    FROM (SELECT x, n, 1 / (1 + e.w0 / e.w1 * sqrt(e.v1 / e.v0) * exp(0.5 * (x - e.m1) ** 2 / e.v1 - 0.5 * (x - e.m0) ** 2 / e.v0)) AS r FROM x0 CROSS JOIN nx)) s
  WHERE i < 100 AND (e.before IS NULL OR abs(e.ll - e.before) >= 1e-3)) SELECT * FROM e),
mix AS (SELECT CASE WHEN m0 <= m1 THEN w0 ELSE w1 END AS w0, least(m0, m1) AS m0, CASE WHEN m0 <= m1 THEN v0 ELSE v1 END AS v0, CASE WHEN m0 <= m1 THEN w1 ELSE w0 END AS w1, greatest(m0, m1) AS m1, CASE WHEN m0 <= m1 THEN v1 ELSE v0 END AS v1 FROM (SELECT * FROM em ORDER BY i DESC LIMIT 1))
"""


def posterior(x: str) -> str:
    """Probability of the component with the larger mean at ``x``, over mix."""
    return f"1 / (1 + exp(greatest(-700, least(700, ln(w0) - 0.5 * (ln(v0) + ({x} - m0) ** 2 / v0) - ln(w1) + 0.5 * (ln(v1) + ({x} - m1) ** 2 / v1)))))"


def mixture_calls(mult: float = 12, gate: float = 0.45) -> str:
    """mcall: marks(cell_id, is_ref, score, coherent, ...) with class and confidence by the mixture of unfenced, clipped scores."""
    return (
        f""", wp AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi, count(*) FILTER (is_ref) AS n_ref, quantile_cont(score, 0.25) FILTER (is_ref) AS q25, quantile_cont(score, 0.75) FILTER (is_ref) AS q75 FROM marks),
wc AS (SELECT marks.*, wp.* , least(greatest(score, lo), hi) AS clipped FROM marks CROSS JOIN wp), ws AS (SELECT stddev_pop(clipped) AS spread FROM wc),
wf AS (SELECT wc.*, coalesce(n_ref >= 10 AND spread >= 1e-10 AND (score < q25 - {mult} * (q75 - q25) OR (NOT is_ref AND score > q75 + {mult} * (q75 - q25) AND coherent < {gate})), false) AS fenced FROM wc CROSS JOIN ws)
"""
        + mixture("SELECT clipped AS x FROM wf WHERE NOT fenced")
        + f""", mp AS (SELECT wf.*, {posterior('clipped')} AS p FROM wf CROSS JOIN mix),
mcall AS (SELECT *, greatest(p, 1 - p) AS confidence, CASE WHEN greatest(p, 1 - p) < 0.5 THEN 'uncertain' WHEN is_ref THEN 'normal' WHEN p > 0.5 THEN 'tumor' ELSE 'normal' END AS class FROM mp)
"""
    )


def marks(cn: str = "cn") -> str:
    """marks: burden, score, coherent of each cell, from who(cell_id, is_ref), ``cn`` (cell_id, segment_id, value), segs(segment_id, chr, n_genes) and low(cell_id, low_complexity)."""
    frames = {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (2, 1), 5: (2, 2)}
    local = " ".join(f"WHEN {w} THEN avg(value) OVER (PARTITION BY cell_id, chr ORDER BY segment_id ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)" for w, (a, b) in frames.items())
    return f""", bs AS (SELECT segment_id, median(value) AS baseline FROM {cn} JOIN who USING (cell_id) WHERE is_ref OR (SELECT count(*) FILTER (is_ref) FROM who) = 0 GROUP BY 1),
rl AS (SELECT cell_id, segment_id, chr, value - baseline AS value, n_genes::DOUBLE AS w FROM {cn} JOIN bs USING (segment_id) JOIN segs USING (segment_id)),
wmed AS (SELECT cell_id, min(value) FILTER (acc >= total / 2) AS med FROM (SELECT *, sum(w) OVER (PARTITION BY cell_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY cell_id) AS total FROM rl) GROUP BY 1),
dv AS (SELECT cell_id, segment_id, chr, value - med AS value, w FROM rl JOIN wmed USING (cell_id)),
bu AS (SELECT cell_id, sum(w * abs(value)) / sum(w) AS burden FROM dv GROUP BY 1),
el AS (SELECT * FROM bu JOIN low USING (cell_id) WHERE NOT low_complexity OR (SELECT count(*) FILTER (NOT low_complexity) FROM low) = 0),
te AS (SELECT segment_id, avg(value / burden) AS t FROM dv JOIN el USING (cell_id) WHERE burden >= (SELECT quantile_cont(burden, 0.75) FROM el) AND burden > 0 GROUP BY 1),
sc AS (SELECT cell_id, CASE WHEN sum(abs(w * t)) > 0 THEN sum(w * t * value) / sum(abs(w * t)) ELSE 0 END AS score FROM dv JOIN te USING (segment_id) GROUP BY 1),
ch AS (SELECT cell_id, sum(CASE WHEN sign(value) = sign(loc) THEN least(abs(value), abs(loc)) ELSE 0 END) / (sum(abs(value)) + 1e-9) AS coherent FROM (SELECT *, CASE least(k, 5) {local} END AS loc FROM dv JOIN (SELECT chr, count(*) AS k FROM segs GROUP BY 1) USING (chr)) GROUP BY 1),
marks AS (SELECT who.cell_id, is_ref, score, burden, coherent, low_complexity FROM who JOIN sc USING (cell_id) JOIN bu USING (cell_id) JOIN ch USING (cell_id) JOIN low USING (cell_id))
"""


def gated(min_tumor: int = 30, support: float = 0.45, gate: float = 0.45) -> str:
    """final: mcall with the gated class and confidence; alt(cell_id, n_segments_altered) from dv."""
    return f""", ga AS (SELECT *, CASE WHEN class = 'tumor' AND (low_complexity OR coherent < {gate}) THEN 'uncertain' ELSE class END AS c2 FROM mcall),
gr AS (SELECT count(*) FILTER (c2 = 'tumor') AS n_tumor, 0.5 * median(score) FILTER (c2 = 'tumor') AS sr, 0.5 * median(burden) FILTER (c2 = 'tumor') AS br FROM ga),
gf AS (SELECT ga.*, CASE WHEN coalesce(n_tumor >= {min_tumor} AND sr > 0 AND c2 = 'normal' AND NOT low_complexity AND NOT is_ref AND score <= -sr AND burden >= br AND coherent >= {support}, false) THEN 'uncertain' ELSE c2 END AS c3 FROM ga CROSS JOIN gr),
final AS (SELECT cell_id, c3 AS class, CASE WHEN c3 <> class THEN 1 - confidence ELSE confidence END AS confidence, score, burden, low_complexity FROM gf),
alt AS (SELECT cell_id, count(*) FILTER (abs(value) > 0.2) AS n_segments_altered FROM dv GROUP BY 1)
"""
