"""Queries behind figures and tables of reports."""

from __future__ import annotations

from ringlet.plans.relations import pearson
from ringlet.plans.statistics import weighted_corr

_RANKS = """gx AS (SELECT x, sum(c) OVER (PARTITION BY 1 ORDER BY x) - (c - 1) / 2.0 AS r FROM (SELECT lev AS x, count(*) AS c FROM {pairs} GROUP BY lev) z),
   gy AS (SELECT y, sum(c) OVER (PARTITION BY 1 ORDER BY y) - (c - 1) / 2.0 AS r FROM (SELECT ub AS y, count(*) AS c FROM {pairs} GROUP BY ub) z)"""
_DENSITY = "CASE WHEN n_{s} < 2 THEN 0.0 ELSE 2.0 * m_{s} / (CAST(n_{s} AS DOUBLE) * (n_{s} - 1)) END"

SHARED = {
    "symmetric_matrix": "SELECT CAST(q AS INT) AS q, CAST(o AS INT) AS o, CAST(lev AS INT) AS lev FROM {both}",
    "per_class_subsample": """SELECT id, cls, CAST(n AS INT) AS n_nodes FROM (SELECT id, cls, n, row_number() OVER (PARTITION BY cls ORDER BY first_of_size, n, id) AS r FROM
        (SELECT id, cls, n, CASE WHEN row_number() OVER (PARTITION BY cls, n ORDER BY md5(CAST(id AS {text})), id) = 1 THEN 0 ELSE 1 END AS first_of_size FROM {bgraphs}) x) y WHERE r <= 7""",
    "knn_best_worst": """WITH ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY ub, o) AS a, row_number() OVER (PARTITION BY q ORDER BY lev, o) AS b FROM {both}),
        s AS (SELECT q, count(CASE WHEN a <= 5 AND b <= 5 THEN 1 END) AS n FROM ranked GROUP BY q)
        SELECT kind, CAST(q AS INT) AS q, n FROM (SELECT 'best' AS kind, q, n, row_number() OVER (PARTITION BY 1 ORDER BY n DESC, q) AS r FROM s UNION ALL SELECT 'worst', q, n, row_number() OVER (PARTITION BY 1 ORDER BY n, q) FROM s) z WHERE r = 1""",
    "concordant_pair": """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(score, 6) AS score FROM (SELECT i, j, abs(ub - 1) + 0.1 * lev + CASE WHEN cls_i <> cls_j THEN 10 ELSE 0 END AS score FROM {pairs} WHERE n_i BETWEEN 3 AND 10 AND n_j BETWEEN 3 AND 10) z
        ORDER BY score, i, j LIMIT 1""",
    "dissimilar_pair": "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(lev AS INT) AS lev, round(ub, 1) AS ub FROM {pairs} WHERE cls_i <> cls_j ORDER BY ub + lev DESC, i, j LIMIT 1",
    "discordant_pair": f"WITH {_RANKS} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CAST(abs(gx.r - gy.r) AS DOUBLE), 1) AS disagreement FROM {{pairs}} p JOIN gx ON p.lev = gx.x JOIN gy ON p.ub = gy.y ORDER BY abs(gx.r - gy.r) DESC, i, j LIMIT 1",
    "same_class_pair": "SELECT cls, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT cls_i AS cls, i, j, row_number() OVER (PARTITION BY cls_i ORDER BY abs(ub - 1), lev, i, j) AS r FROM {pairs} WHERE cls_i = cls_j AND n_i >= 3) z WHERE r = 1",
    "density_pair": "SELECT kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT i, j, 'dense' AS kind, row_number() OVER (PARTITION BY 1 ORDER BY {di} + {dj} DESC, lev, i, j) AS r FROM {pairs} WHERE n_i >= 4 AND n_j >= 4 UNION ALL "
    "SELECT i, j, 'sparse', row_number() OVER (PARTITION BY 1 ORDER BY {di} + {dj}, lev, i, j) FROM {pairs} WHERE n_i >= 4 AND n_j >= 4) z WHERE r = 1".replace("{di}", _DENSITY.replace("{s}", "i")).replace("{dj}", _DENSITY.replace("{s}", "j")),
    "shared_class": "SELECT n FROM (SELECT CAST(n AS INT) AS n FROM {bgraphs} WHERE cls = 0 INTERSECT SELECT CAST(n AS INT) FROM {bgraphs} WHERE cls = 1 INTERSECT SELECT CAST(n AS INT) FROM {bgraphs} WHERE cls = 2) z",
    "dataset_properties": """SELECT cls AS dataset, count(*) AS n_graphs, round(avg(CAST(m AS DOUBLE)), 6) AS mean_edges, round(avg(CASE WHEN n < 2 THEN 0.0 ELSE 2.0 * m / (CAST(n AS DOUBLE) * (n - 1)) END), 6) AS mean_density,
        CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM {bgraphs} GROUP BY cls""",
    "spearman_by_dataset": """WITH s AS (SELECT cls_i AS d, lev AS x, ub AS y, count(*) AS c FROM {pairs} WHERE cls_i = cls_j GROUP BY cls_i, lev, ub), sx AS (SELECT d, x, sum(c) OVER (PARTITION BY d ORDER BY x) - (c - 1) / 2.0 AS r FROM (SELECT d, x, sum(c) AS c FROM s GROUP BY d, x) z),
        sy AS (SELECT d, y, sum(c) OVER (PARTITION BY d ORDER BY y) - (c - 1) / 2.0 AS r FROM (SELECT d, y, sum(c) AS c FROM s GROUP BY d, y) z)
        SELECT s.d AS dataset, CAST(sum(s.c) AS BIGINT) AS n, round(""" + weighted_corr("sx.r", "sy.r", "s.c") + """, 6) AS rho FROM s JOIN sx ON s.d = sx.d AND s.x = sx.x JOIN sy ON s.d = sy.d AND s.y = sy.y GROUP BY s.d HAVING sum(s.c) >= 10""",
    "best_per_dataset": """WITH v AS (SELECT cls_i AS dataset, method, round(""" + pearson("CASE method WHEN 'lev' THEN lev WHEN 'ham' THEN ham ELSE lb END", "ub") + """, 6) AS r FROM {pairs} CROSS JOIN (VALUES ('lev'), ('ham'), ('lb')) AS m(method) GROUP BY 1, 2)
        SELECT dataset, method, r, CASE WHEN r = max(r) OVER (PARTITION BY dataset) THEN 1 ELSE 0 END AS best, CASE WHEN r = min(r) OVER (PARTITION BY dataset) THEN 1 ELSE 0 END AS worst, CASE WHEN r > 0.9 THEN '***' WHEN r > 0.7 THEN '**' WHEN r > 0.5 THEN '*' ELSE '' END AS stars FROM v""",
    "density_histogram": """SELECT CAST(lev AS INT) AS x, CAST(floor(ub / 2) AS INT) AS y, count(*) AS n FROM {pairs} GROUP BY 1, 2""",
    "median_of_medians": "SELECT cls AS family, CAST(n AS INT) AS n_nodes, round({med}, 6) AS median FROM (SELECT cls, n, part, {med_m} AS m FROM (SELECT cls, n, m, CAST(id % 1048576 AS INT) % 4 AS part FROM {bgraphs}) z GROUP BY cls, n, part) y GROUP BY cls, n",
    "censored_filter": "SELECT CAST(greatest(n_i, n_j) AS INT) AS n_max, count(*) AS n_all, count(CASE WHEN lev < 14 THEN 1 END) AS n_kept, round(avg(CASE WHEN lev < 14 THEN CAST(lev AS DOUBLE) END), 6) AS mean_kept FROM {pairs} GROUP BY 1",
    "pair_sizes": "SELECT CAST(k AS BIGINT) AS k, CAST(n_i + n_j AS INT) AS n_sum, round(sqrt(CAST((n_i - n_j) * (n_i - n_j) + (m_i - m_j) * (m_i - m_j) AS DOUBLE)), 9) AS distance FROM {pairs}",
    "best_worst_stress": """WITH s AS (SELECT cls_i AS dataset, round(sqrt(sum((lev - ub) * (lev - ub)) / sum(ub * ub)), 9) AS stress FROM {pairs} WHERE cls_i = cls_j GROUP BY cls_i)
        SELECT kind, dataset, stress FROM (SELECT 'best' AS kind, dataset, stress, row_number() OVER (PARTITION BY 1 ORDER BY stress, dataset) AS r FROM s UNION ALL SELECT 'worst', dataset, stress, row_number() OVER (PARTITION BY 1 ORDER BY stress DESC, dataset) FROM s) z WHERE r = 1""",
    "pivot_medians": "SELECT n_nodes, round(max(CASE WHEN cls = 0 THEN m END), 6) AS d0, round(max(CASE WHEN cls = 1 THEN m END), 6) AS d1, round(max(CASE WHEN cls = 2 THEN m END), 6) AS d2 FROM (SELECT CAST(n AS INT) AS n_nodes, cls, {med_m} AS m FROM {bgraphs} GROUP BY n, cls) z GROUP BY n_nodes",
    "method_selection": """WITH c AS (SELECT method, cost, avg(abs(CASE method WHEN 'lev' THEN CAST(lev AS DOUBLE) WHEN 'ham' THEN CAST(ham AS DOUBLE) ELSE lb END - ub)) AS score FROM {pairs} CROSS JOIN (VALUES ('lev', 1), ('ham', 2), ('lb', 3)) AS m(method, cost) GROUP BY 1, 2), b AS (SELECT min(score) AS best FROM c)
        SELECT method, CASE WHEN score <= best * 1.02 THEN 1 ELSE 0 END AS tied, CAST(row_number() OVER (PARTITION BY 1 ORDER BY CASE WHEN score <= best * 1.02 THEN 0 ELSE 1 END, cost, method) AS INT) AS place FROM c CROSS JOIN b""",
    "corpus_vote": """WITH v AS (SELECT cls_i AS corpus, cls_j AS dataset, avg(abs(lev - ub)) AS a, avg(abs(ham - ub)) AS b FROM {pairs} GROUP BY cls_i, cls_j) SELECT corpus, CASE WHEN a < b THEN 'lev' ELSE 'ham' END AS winner, count(*) AS n FROM v GROUP BY 1, 2""",
    "start_extremes": "SELECT cls, {first_min} AS smallest_id, {first_max} AS largest_id FROM {bgraphs} GROUP BY cls",
    "gate_attribution": """SELECT cls_i AS dataset, round(regr_slope(ub - lb, CAST(greatest(n_i, n_j) AS DOUBLE)), 6) AS slope_gap, round(regr_slope(abs(n_i - n_j) + ham - lb, CAST(greatest(n_i, n_j) AS DOUBLE)), 6) AS slope_plain,
        CASE WHEN regr_slope(abs(n_i - n_j) + ham - lb, CAST(greatest(n_i, n_j) AS DOUBLE)) > 0 THEN round(regr_slope(ub - lb, CAST(greatest(n_i, n_j) AS DOUBLE)) / regr_slope(abs(n_i - n_j) + ham - lb, CAST(greatest(n_i, n_j) AS DOUBLE)), 6) END AS ratio FROM {pairs} GROUP BY cls_i""",
}
SPARK = {
    "med": "percentile(m, 0.5)", "med_m": "percentile(m, 0.5)", "first_min": "min(struct(n, id)).id", "first_max": "max(struct(n, -id)).col2 * -1",
}
DUCK = {"med": "quantile_cont(m, 0.5)", "med_m": "quantile_cont(m, 0.5)", "first_min": "min({'n': n, 'id': id}).id", "first_max": "max({'n': n, 'id': -id}).id * -1"}
