"""Statistics over pairs of graphs, as text that both engines read.

Ranks come from the counts of distinct values and their running sum, so that no window sees all pairs.  The tail of the normal
distribution is the usual rational approximation of erfc (error below 2e-7).
"""

from __future__ import annotations

from ringlet.plans.relations import pearson

#: Distinct values of both variables with the number of pairs, and their midranks.
_TABLE = """g AS (SELECT lev AS x, ub AS y, count(*) AS c FROM {pairs} GROUP BY lev, ub),
   gx AS (SELECT x, sum(c) OVER (PARTITION BY 1 ORDER BY x) - (c - 1) / 2.0 AS r, c FROM (SELECT x, sum(c) AS c FROM g GROUP BY x) z),
   gy AS (SELECT y, sum(c) OVER (PARTITION BY 1 ORDER BY y) - (c - 1) / 2.0 AS r, c FROM (SELECT y, sum(c) AS c FROM g GROUP BY y) z)"""


def weighted_corr(x: str, y: str, c: str) -> str:
    """Pearson's r of x and y, each row counted c times; null where one of them does not vary."""
    d = lambda e: f"CAST({e} AS DOUBLE)"
    n, sx, sy = f"sum({d(c)})", f"sum({d(x)} * {c})", f"sum({d(y)} * {c})"
    sxx, syy, sxy = f"sum({d(x)} * {x} * {c})", f"sum({d(y)} * {y} * {c})", f"sum({d(x)} * {y} * {c})"
    return f"({n} * {sxy} - {sx} * {sy}) / nullif(sqrt(greatest({n} * {sxx} - {sx} * {sx}, 0.0)) * sqrt(greatest({n} * {syy} - {sy} * {sy}, 0.0)), 0.0)"


def upper_tail(z: str) -> str:
    """P(Z > z) of the standard normal distribution."""
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(CAST(2 AS DOUBLE))))"
    half = f"0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2)"
    return f"CASE WHEN ({z}) >= 0 THEN {half} ELSE 1.0 - {half} END"


def _stratified(bins: str) -> str:
    """Spearman's rho in each quartile of a column b of p (lev, ub, b); bins under 10 pairs are left out."""
    return f"""WITH p AS (SELECT lev, ub, {bins} AS b FROM {{pairs}}), q AS (SELECT {{q25b}} AS a1, {{q50b}} AS a2, {{q75b}} AS a3 FROM p),
   s AS (SELECT CASE WHEN b < a1 THEN 0 WHEN b < a2 THEN 1 WHEN b < a3 THEN 2 ELSE 3 END AS bin, lev AS x, ub AS y, count(*) AS c FROM p CROSS JOIN q GROUP BY 1, lev, ub),
   sx AS (SELECT bin, x, sum(c) OVER (PARTITION BY bin ORDER BY x) - (c - 1) / 2.0 AS r FROM (SELECT bin, x, sum(c) AS c FROM s GROUP BY bin, x) z),
   sy AS (SELECT bin, y, sum(c) OVER (PARTITION BY bin ORDER BY y) - (c - 1) / 2.0 AS r FROM (SELECT bin, y, sum(c) AS c FROM s GROUP BY bin, y) z)
   SELECT s.bin, CAST(sum(s.c) AS BIGINT) AS n_pairs, round({weighted_corr("sx.r", "sy.r", "s.c")}, 6) AS rho FROM s JOIN sx ON s.bin = sx.bin AND s.x = sx.x JOIN sy ON s.bin = sy.bin AND s.y = sy.y GROUP BY s.bin HAVING sum(s.c) >= 10"""


_WILCOXON = """d AS (SELECT greatest(n_i, n_j) AS s, CAST(lev AS DOUBLE) - ub AS d, count(*) AS c FROM {pairs} GROUP BY 1, 2),
   a AS (SELECT s, abs(d) AS v, sum(c) AS c FROM d WHERE d <> 0 GROUP BY s, abs(d)), r AS (SELECT s, v, c, CAST(sum(c) OVER (PARTITION BY s ORDER BY v) - (c - 1) / 2.0 AS DOUBLE) AS r FROM a),
   u AS (SELECT d.s, sum(CASE WHEN d.d > 0 THEN r.r * d.c ELSE CAST(0 AS DOUBLE) END) AS plus, sum(CASE WHEN d.d < 0 THEN r.r * d.c ELSE CAST(0 AS DOUBLE) END) AS minus, sum(CAST(d.c AS DOUBLE)) AS n FROM d JOIN r ON d.s = r.s AND abs(d.d) = r.v GROUP BY d.s),
   t AS (SELECT s, sum(CAST(c AS DOUBLE) * c * c - c) / 48 AS tie FROM a GROUP BY s),
   w AS (SELECT u.s, plus, minus, n, CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tie > 0 THEN (plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie) ELSE 0.0 END AS z FROM u JOIN t ON u.s = t.s)"""

_SLOPES = """picks AS (SELECT r, idx, count(*) AS c FROM (SELECT r, {draw} % total AS idx FROM {reps} CROSS JOIN (SELECT count(*) AS total FROM {bindexed}) t2) z GROUP BY r, idx),
   xy AS (SELECT i, j, CAST(greatest(n_i, n_j) AS DOUBLE) AS x, CASE WHEN ub = 0 THEN 0.0 ELSE (ub - lb) / ub END AS y FROM {pairs}),
   sums AS (SELECT a.r, sum(CAST(a.c * b.c AS DOUBLE)) AS n, sum(a.c * b.c * x) AS sx, sum(a.c * b.c * y) AS sy, sum(a.c * b.c * x * x) AS sxx, sum(a.c * b.c * x * y) AS sxy
     FROM xy JOIN picks a ON a.idx = xy.i JOIN picks b ON b.idx = xy.j AND b.r = a.r GROUP BY a.r),
   slopes AS (SELECT r, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0.0) AS slope FROM sums)"""

#: Mean scores of each method in each size stratum.
_MEANS = """(SELECT greatest(n_i, n_j) AS dataset, method, avg(abs(CASE method WHEN 'lev' THEN CAST(lev AS DOUBLE) WHEN 'ham' THEN CAST(ham AS DOUBLE) ELSE lb END - ub)) AS score
   FROM {pairs} CROSS JOIN (VALUES ('lev'), ('ham'), ('lb')) AS m(method) GROUP BY 1, 2)"""

SHARED = {
    "pearson": "SELECT round(" + pearson("lev", "ub") + ", 6) AS r, count(*) AS n FROM {pairs}",
    "midranks": f"WITH {_TABLE} SELECT CAST(k AS BIGINT) AS k, round(CAST(gx.r AS DOUBLE), 1) AS midrank FROM {{pairs}} p JOIN gx ON p.lev = gx.x",
    "spearman": f"WITH {_TABLE} SELECT round({weighted_corr('gx.r', 'gy.r', 'g.c')}, 6) AS rho, CAST(sum(g.c) AS BIGINT) AS n FROM g JOIN gx ON g.x = gx.x JOIN gy ON g.y = gy.y",
    "kendall": f"""WITH {_TABLE}, t AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN CAST(a.c AS DOUBLE) * b.c WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN -CAST(a.c AS DOUBLE) * b.c ELSE 0.0 END) / 2 AS s FROM g a CROSS JOIN g b),
        n AS (SELECT sum(CAST(c AS DOUBLE)) AS n FROM g), tx AS (SELECT sum(CAST(c AS DOUBLE) * (c - 1)) / 2 AS t FROM gx), ty AS (SELECT sum(CAST(c AS DOUBLE) * (c - 1)) / 2 AS t FROM gy)
        SELECT round(s / nullif(sqrt(n * (n - 1) / 2 - tx.t) * sqrt(n * (n - 1) / 2 - ty.t), 0.0), 6) AS tau_b FROM t CROSS JOIN n CROSS JOIN tx CROSS JOIN ty""",
    "dense_codes": f"WITH {_TABLE} SELECT CAST(k AS BIGINT) AS k, CAST(code AS INT) AS code FROM {{pairs}} p JOIN (SELECT x, dense_rank() OVER (PARTITION BY 1 ORDER BY x) - 1 AS code FROM gx) d ON p.lev = d.x",
    "ols_fit": """SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n, round(sqrt((1 - r2) * syy / (n - 2)) / sqrt(sxx), 9) AS slope_error FROM
        (SELECT regr_slope(ub, x) AS slope, regr_intercept(ub, x) AS intercept, regr_r2(ub, x) AS r2, count(*) AS n, var_pop(ub) * count(*) AS syy, var_pop(x) * count(*) AS sxx FROM (SELECT CAST(lev AS DOUBLE) AS x, ub FROM {pairs}) z) y""",
    "lins_ccc": """SELECT round(2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))), 6) AS ccc
        FROM (SELECT CAST(lev AS DOUBLE) AS x, ub AS y FROM {pairs}) z""",
    "z_normalised_ccc": """SELECT round(2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))), 6) AS ccc FROM
        (SELECT (lev - ax) / (sx + 1e-12) AS x, (ub - ay) / (sy + 1e-12) AS y FROM {pairs} CROSS JOIN (SELECT avg(CAST(lev AS DOUBLE)) AS ax, stddev_pop(CAST(lev AS DOUBLE)) AS sx, avg(ub) AS ay, stddev_pop(ub) AS sy FROM {pairs}) m) z""",
    "cohens_d": """SELECT CASE WHEN n1 < 2 OR n2 < 2 OR (n1 - 1) * v1 + (n2 - 1) * v2 = 0 THEN 0.0 ELSE round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) END AS d, round(m1, 6) AS mean_between, round(m2, 6) AS mean_within
        FROM (SELECT count(CASE WHEN cls_i <> cls_j THEN 1 END) AS n1, count(CASE WHEN cls_i = cls_j THEN 1 END) AS n2, avg(CASE WHEN cls_i <> cls_j THEN ub END) AS m1, avg(CASE WHEN cls_i = cls_j THEN ub END) AS m2,
          var_samp(CASE WHEN cls_i <> cls_j THEN ub END) AS v1, var_samp(CASE WHEN cls_i = cls_j THEN ub END) AS v2 FROM {pairs}) z""",
    "class_distances": "SELECT cls_i, cls_j, count(*) AS n, round(avg(ub), 6) AS mean_ub, round(stddev_pop(ub), 6) AS sd_ub, round(avg(CAST(lev AS DOUBLE)), 6) AS mean_lev FROM {pairs} GROUP BY cls_i, cls_j",
    "safe_correlation": "SELECT n_i, n_j, count(*) AS n, CASE WHEN count(*) < 3 THEN NULL ELSE round(" + pearson("lev", "ub") + ", 4) END AS r FROM {pairs} GROUP BY n_i, n_j",
    "stratified_mean": """SELECT CAST(greatest(n_i, n_j) AS INT) AS n_max, count(*) AS n, round(avg(CAST(lev AS DOUBLE)), 9) AS mean_lev, round(coalesce(stddev_samp(CAST(lev AS DOUBLE)), 0.0), 6) AS sd_lev
        FROM {pairs} GROUP BY 1""",
    "size_stratified_rho": _stratified("greatest(n_i, n_j)"),
    "density_stratified_rho": _stratified("(CASE WHEN n_i < 2 THEN 0.0 ELSE 2.0 * m_i / (CAST(n_i AS DOUBLE) * (n_i - 1)) END + CASE WHEN n_j < 2 THEN 0.0 ELSE 2.0 * m_j / (CAST(n_j AS DOUBLE) * (n_j - 1)) END) / 2"),
    "quantile_summary": "SELECT round({q25}, 6) AS q25, round({q50}, 6) AS q50, round({q75}, 6) AS q75 FROM {pairs}",
    "error_stats": """SELECT round(avg(e), 6) AS mean, round({e50}, 6) AS median, round({e25}, 6) AS q25, round({e75}, 6) AS q75, round({e75} - {e25}, 6) AS iqr, round({e95}, 6) AS p95 FROM (SELECT ub - lb AS e FROM {pairs}) z""",
    "error_by_size": """SELECT CAST(n AS INT) AS n_max, count(*) AS n_pairs, round(avg(e), 6) AS mean, round({e25}, 6) AS q25, round({e50}, 6) AS median, round({e75}, 6) AS q75 FROM (SELECT greatest(n_i, n_j) AS n, ub - lb AS e FROM {pairs}) z
        GROUP BY n HAVING count(*) >= 10""",
    "cell_metrics": """SELECT cls_i AS cell, count(*) AS n, round(avg(CASE WHEN abs(ub - lb) <= 1e-9 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS certified, round(avg(ub - lb), 6) AS mean_gap, round(max(ub - lb), 6) AS worst_gap,
        round(avg(CASE WHEN ub = 0 THEN 0.0 ELSE (ub - lb) / ub END), 6) AS mean_width, count(CASE WHEN lb > ub + 1e-9 THEN 1 END) AS n_refuted, round(""" + pearson("lb", "ub") + """, 6) AS r_bounds, count(DISTINCT ub) AS n_values FROM {pairs} GROUP BY cls_i""",
    "defined_and_spread": """SELECT count(*) AS n, round(avg(CASE WHEN length(a.w) = length(b.w) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS hamming_defined, round(avg(CASE WHEN lev = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS zero_mass,
        round(stddev_pop(CAST(lev AS DOUBLE)) / avg(CAST(lev AS DOUBLE)), 9) AS cv FROM {pairs} p JOIN {bench} a ON p.id_i = a.id JOIN {bench} b ON p.id_j = b.id""",
    "distinct_values": "SELECT count(DISTINCT lev) AS n_lev, count(DISTINCT ham) AS n_ham, count(DISTINCT lb) AS n_lb, count(DISTINCT ub) AS n_ub FROM {pairs}",
    "size_null_correlation": "SELECT round(" + pearson("abs(n_i - n_j)", "ub") + ", 6) AS r FROM {pairs}",
    # Tests
    "wilcoxon": f"""WITH {_WILCOXON} SELECT CAST(s AS INT) AS n_max, round(CASE WHEN plus < minus THEN plus ELSE minus END, 1) AS statistic, CAST(n AS BIGINT) AS n_used, round(CASE WHEN plus + minus > 0 THEN (plus - minus) / (plus + minus) ELSE 0.0 END, 6) AS rank_biserial,
        round(z, 6) AS z, round(least(1.0, 2 * ({upper_tail('abs(z)')})), 6) AS p FROM w""",
    "holm_adjusted": f"""WITH {_WILCOXON}, p AS (SELECT CAST(s AS INT) AS n_max, round(least(1.0, 2 * ({upper_tail('abs(z)')})), 6) AS p FROM w), h AS (SELECT n_max, p, row_number() OVER (PARTITION BY 1 ORDER BY p, n_max) AS r, count(*) OVER (PARTITION BY 1) AS m FROM p)
        SELECT n_max, p, round(least(1.0, max(p * (m - r + 1)) OVER (PARTITION BY 1 ORDER BY p, n_max ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm FROM h""",
    "average_ranks": """WITH s AS (SELECT * FROM """ + _MEANS + """ z), r AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS r FROM s)
        SELECT method, round(avg(CAST(r AS DOUBLE)), 6) AS average_rank, count(*) AS n_datasets FROM r GROUP BY method""",
    "friedman": """WITH s AS (SELECT * FROM """ + _MEANS + """ z), r AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS r FROM s),
        a AS (SELECT method, sum(CAST(r AS DOUBLE)) AS total, count(*) AS n FROM r GROUP BY method)
        SELECT max(n) AS n_datasets, count(*) AS n_methods, round(12.0 / (max(n) * 3 * 4) * sum(total * total) - 3.0 * max(n) * 4, 6) AS chi2, round(2.343 * sqrt(3 * 4 / (6.0 * max(n))), 6) AS critical_difference FROM a""",
    "jonckheere": f"""WITH g AS (SELECT cls_i AS q, lev AS x, CAST(count(*) AS DOUBLE) AS c FROM {{pairs}} GROUP BY cls_i, lev), n AS (SELECT q, sum(c) AS n FROM g GROUP BY q),
        j AS (SELECT sum(CASE WHEN a.x > b.x THEN a.c * b.c WHEN a.x = b.x THEN a.c * b.c / 2 ELSE 0.0 END) AS j FROM g a JOIN g b ON a.q < b.q),
        t AS (SELECT sum(n) AS t, sum(n * n) AS t2, sum(n * n * (2 * n + 3)) AS t3 FROM n),
        z AS (SELECT j, (j - (t * t - t2) / 4) / sqrt((t * t * (2 * t + 3) - t3) / 72) AS z FROM j CROSS JOIN t) SELECT round(j, 1) AS statistic, round(z, 6) AS z, round({upper_tail('z')}, 6) AS p FROM z""",
    "monotone_medians": """SELECT CASE WHEN count(CASE WHEN m < before THEN 1 END) = 0 THEN 1 ELSE 0 END AS rising, count(*) AS n_groups FROM
        (SELECT n, m, lag(m) OVER (PARTITION BY 1 ORDER BY n) AS before FROM (SELECT greatest(n_i, n_j) AS n, {ub50} AS m FROM {pairs} GROUP BY 1) x) y""",
    # Resampling
    "bootstrap_picks": """SELECT r, CAST(idx AS INT) AS idx, count(*) AS c FROM (SELECT r, {draw} % total AS idx FROM {reps} CROSS JOIN (SELECT count(*) AS total FROM {bindexed}) t) z GROUP BY r, idx""",
    "bootstrap_slopes": f"WITH {_SLOPES} SELECT r, round(slope, 6) AS slope FROM slopes",
    "bootstrap_interval": f"WITH {_SLOPES} SELECT count(*) AS n_replicates, round({{lo}}, 6) AS lower_end, round({{hi}}, 6) AS upper_end FROM slopes",
    "mantel_test": """WITH perm AS (SELECT r, idx, row_number() OVER (PARTITION BY r ORDER BY md5(concat(CAST(r AS {text}), ':', CAST(idx AS {text}))), idx) - 1 AS t FROM {bindexed} CROSS JOIN {nineteen}),
        p AS (SELECT i, j, CAST(lev AS DOUBLE) AS x, ub AS y FROM {pairs}),
        moved AS (SELECT a.r, least(a.t, b.t) AS i, greatest(a.t, b.t) AS j, p.x FROM p JOIN perm a ON a.idx = p.i JOIN perm b ON b.idx = p.j AND b.r = a.r),
        each AS (SELECT m.r, round(""" + pearson("m.x", "p.y") + """, 9) AS rho FROM moved m JOIN p ON p.i = m.i AND p.j = m.j GROUP BY m.r), seen AS (SELECT round(""" + pearson("x", "y") + """, 9) AS rho FROM p)
        SELECT round(seen.rho, 6) AS r, CAST(count(CASE WHEN each.rho >= seen.rho THEN 1 END) + 1 AS DOUBLE) / (count(*) + 1) AS p, count(*) AS n_permutations FROM each CROSS JOIN seen GROUP BY seen.rho""",
    # Scaling
    "double_centred": """WITH d AS (SELECT q, o, CAST(lev * lev AS DOUBLE) AS d FROM {both}), n AS (SELECT count(*) AS n FROM {bindexed}), r AS (SELECT q, sum(d) AS s FROM d GROUP BY q), t AS (SELECT sum(s) AS s FROM r)
        SELECT CAST(d.q AS INT) AS q, CAST(d.o AS INT) AS o, round(-0.5 * (d - a.s / n - b.s / n + t.s / (CAST(n AS DOUBLE) * n)), 6) AS b FROM d JOIN r a ON d.q = a.q JOIN r b ON d.o = b.q CROSS JOIN n CROSS JOIN t""",
    "sanitised": """SELECT CAST(k AS BIGINT) AS k, coalesce(v, 2 * top) AS value, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS weight FROM (SELECT k, CASE WHEN k % 11 <> 0 THEN round(ub, 1) END AS v FROM {pairs}) p
        CROSS JOIN (SELECT max(round(ub, 1)) AS top FROM {pairs} WHERE k % 11 <> 0) t""",
    "weighted_stress": """SELECT round(sqrt(sum((lev - e) * (lev - e)) / sum(e * e)), 6) AS stress FROM (SELECT lev, CAST(abs(n_i - n_j) + abs(m_i - m_j) AS DOUBLE) AS e FROM {pairs}) z""",
    "log_log_exponent": "SELECT round(regr_slope(ln(y), ln(x)), 6) AS exponent, round(regr_r2(ln(y), ln(x)), 6) AS r2, count(*) AS n FROM (SELECT CAST(n AS DOUBLE) AS x, CAST(m AS DOUBLE) AS y FROM {bgraphs} WHERE n > 1 AND m > 0) z",
    "growth_model": """SELECT round(poly, 6) AS r2_polynomial, round(expo, 6) AS r2_exponential, CASE WHEN expo > poly + 0.05 THEN 'exponential' ELSE 'polynomial' END AS model FROM
        (SELECT regr_r2(ln(y), ln(x)) AS poly, regr_r2(ln(y), x) AS expo FROM (SELECT CAST(n AS DOUBLE) AS x, CAST(length(w) AS DOUBLE) AS y FROM {bgraphs} WHERE n > 1 AND length(w) > 0) z) u""",
    "median_by_size": "SELECT cls AS family, CAST(n AS INT) AS n_nodes, round({m50}, 6) AS median_edges, count(*) AS n_graphs FROM {bgraphs} GROUP BY cls, n",
    "median_iqr_by_size": "SELECT CAST(n AS INT) AS n_nodes, round({m50}, 6) AS median, round({m25}, 6) AS q25, round({m75}, 6) AS q75, count(*) AS n_graphs FROM {bgraphs} GROUP BY n HAVING count(*) >= 2",
    "crossover": """SELECT band, round({l50}, 6) AS median_a, round({h50}, 6) AS median_b, round(CASE WHEN {l50} = 0 THEN NULL ELSE {h50} / {l50} END, 6) AS ratio, min(CASE WHEN ham > lev THEN lo END) AS first_over FROM
        (SELECT lev, ham, lo, band FROM {pairs} JOIN (VALUES (1, 2, '1-2'), (3, 4, '3-4'), (5, 6, '5-6'), (7, 8, '7-8')) AS b(lo, hi, band) ON greatest(n_i, n_j) BETWEEN lo AND hi) z GROUP BY band""",
    "amortised_cost": """SELECT n, round(n * enc + n * (n - 1) / 2.0 * cheap, 6) AS by_strings, round(n * (n - 1) / 2.0 * dear, 6) AS by_graphs FROM (VALUES (10), (50), (100), (200), (500), (1000)) AS t(n)
        CROSS JOIN (SELECT avg(CAST(n_i AS DOUBLE) * n_i) AS enc, avg(CAST(lev AS DOUBLE)) AS cheap, avg(CAST(n_i AS DOUBLE) * n_j * n_j) AS dear FROM {pairs}) s""",
    "geometric_mean_ratio": "SELECT CAST(greatest(n_i, n_j) AS INT) AS n_max, round(exp(avg(ln((ub + 1) / (lb + 1)))), 6) AS ratio, count(*) AS n FROM {pairs} GROUP BY 1",
}
SPARK = {
    **{f"q{q}": f"percentile(lev, 0.{q})" for q in (25, 50, 75)}, **{f"q{q}b": f"percentile(b, 0.{q})" for q in (25, 50, 75)}, **{f"e{q}": f"percentile(e, 0.{q})" for q in (25, 50, 75, 95)},
    **{f"m{q}": f"percentile(m, 0.{q})" for q in (25, 50, 75)}, "l50": "percentile(lev, 0.5)", "h50": "percentile(ham, 0.5)", "ub50": "percentile(ub, 0.5)",
    "lo": "percentile(slope, 0.025)", "hi": "percentile(slope, 0.975)", "draw": "CAST(conv(substr(md5(concat(CAST(r AS STRING), ':', CAST(d AS STRING))), 1, 8), 16, 10) AS BIGINT)",
    "reps": "(SELECT r, d FROM (SELECT explode(sequence(1, 20)) AS r) a CROSS JOIN (SELECT idx AS d FROM {bindexed}) b)", "nineteen": "(SELECT explode(sequence(1, 19)) AS r)",
}
DUCK = {
    **{f"q{q}": f"quantile_cont(lev, 0.{q})" for q in (25, 50, 75)}, **{f"q{q}b": f"quantile_cont(b, 0.{q})" for q in (25, 50, 75)}, **{f"e{q}": f"quantile_cont(e, 0.{q})" for q in (25, 50, 75, 95)},
    **{f"m{q}": f"quantile_cont(m, 0.{q})" for q in (25, 50, 75)}, "l50": "quantile_cont(lev, 0.5)", "h50": "quantile_cont(ham, 0.5)", "ub50": "quantile_cont(ub, 0.5)",
    "lo": "quantile_cont(slope, 0.025)", "hi": "quantile_cont(slope, 0.975)", "draw": "CAST('0x' || substr(md5(concat(CAST(r AS VARCHAR), ':', CAST(d AS VARCHAR))), 1, 8) AS BIGINT)",
    "reps": "(SELECT r, d FROM (SELECT unnest(range(1, 21))::INT AS r) a CROSS JOIN (SELECT idx AS d FROM {bindexed}) b)", "nineteen": "(SELECT unnest(range(1, 20))::INT AS r)",
}
