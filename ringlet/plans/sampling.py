"""Queries that draw samples, number chunks and fill strata.  Draws are by md5 order, which both engines share."""

from __future__ import annotations

_BIN = "CASE WHEN {x} < 2 THEN 0 WHEN {x} < 4 THEN 1 WHEN {x} < 6 THEN 2 WHEN {x} < 8 THEN 3 WHEN {x} < 10 THEN 4 WHEN {x} < 12 THEN 5 WHEN {x} < 15 THEN 6 WHEN {x} < 20 THEN 7 WHEN {x} < 25 THEN 8 WHEN {x} < 30 THEN 9 ELSE 10 END"


def _bin(x: str) -> str:
    return _BIN.replace("{x}", x)


_ORDER = "md5(concat('42:', CAST(k AS {text}))), k"
#: Pairs with their size bin, and the place in it that the md5 order gives.
_DRAWN = f"drawn AS (SELECT k, bin, row_number() OVER (PARTITION BY bin ORDER BY {_ORDER}) AS r FROM (SELECT k, {_bin('greatest(n_i, n_j)')} AS bin FROM {{pairs}}) z)"
_STRATA = f"""strata AS (SELECT k, i, j, least(a, b) * 3 - CAST(floor(least(a, b) * (least(a, b) - 1) / 2) AS INT) + greatest(a, b) - least(a, b) AS cell FROM
   (SELECT k, i, j, CASE WHEN n_i < 4 THEN 0 WHEN n_i < 6 THEN 1 ELSE 2 END AS a, CASE WHEN n_j < 4 THEN 0 WHEN n_j < 6 THEN 1 ELSE 2 END AS b FROM {{pairs}}) z),
   core AS (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY 1 ORDER BY md5(concat('core:', CAST(idx AS {{text}}))), idx) AS r FROM {{bindexed}}) z WHERE r <= 20),
   halo AS (SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY c ORDER BY md5(concat('halo:', CAST(k AS {{text}}))), k) AS r FROM
     (SELECT q AS c, least(q, o) * total - CAST(floor(least(q, o) * (least(q, o) + 1) / 2) AS BIGINT) + greatest(q, o) - least(q, o) - 1 AS k FROM {{both}} CROSS JOIN (SELECT count(*) AS total FROM {{bindexed}}) t) y) z WHERE r <= 2),
   topup AS (SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY cell ORDER BY {_ORDER}) AS r FROM strata) z WHERE r <= 30),
   taken AS (SELECT CAST(s.k AS BIGINT) AS k, 'core' AS layer FROM strata s JOIN core a ON s.i = a.idx JOIN core b ON s.j = b.idx UNION ALL SELECT CAST(k AS BIGINT), 'halo' FROM halo UNION ALL SELECT CAST(k AS BIGINT), 'topup' FROM topup)"""

SHARED = {
    "random_sample": f"SELECT id, CAST(n AS INT) AS n_nodes FROM {{bgraphs}} ORDER BY md5(concat('42:', CAST(id AS {{text}}))), id LIMIT 50",
    "stratified_sample": """SELECT id, CAST(n AS INT) AS n_nodes FROM (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY md5(CAST(id AS {text})), id) AS r FROM {graphs}) x WHERE r <= 5""",
    "proportional_sample": """WITH q AS (SELECT n, count(*) AS c, sum(count(*)) OVER (PARTITION BY 1) AS total FROM {bgraphs} GROUP BY n),
        f AS (SELECT n, c, CAST(floor(CAST(100 * c AS DOUBLE) / total) AS BIGINT) AS base, 100 * c % total AS rest FROM q), g AS (SELECT n, base, row_number() OVER (PARTITION BY 1 ORDER BY rest DESC, n) AS place, 100 - sum(base) OVER (PARTITION BY 1) AS spare FROM f),
        quota AS (SELECT n, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS quota FROM g)
        SELECT x.id, CAST(x.n AS INT) AS n_nodes FROM (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY md5(CAST(id AS {text})), id) AS r FROM {bgraphs}) x JOIN quota ON x.n = quota.n WHERE r <= quota""",
    "largest_remainder_quota": """WITH q AS (SELECT n, count(*) AS c, sum(count(*)) OVER (PARTITION BY 1) AS total FROM {bgraphs} GROUP BY n),
        f AS (SELECT n, c, CAST(floor(CAST(100 * c AS DOUBLE) / total) AS BIGINT) AS base, 100 * c % total AS rest FROM q), g AS (SELECT n, c, base, row_number() OVER (PARTITION BY 1 ORDER BY rest DESC, n) AS place, 100 - sum(base) OVER (PARTITION BY 1) AS spare FROM f)
        SELECT CAST(n AS INT) AS stratum, c AS population, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g""",
    "even_allocation": """WITH c AS (SELECT cls, count(*) AS cap FROM {bgraphs} WHERE n > 3 GROUP BY cls), l AS (SELECT cls, cap, row_number() OVER (PARTITION BY 1 ORDER BY cap, cls) AS r, count(*) OVER (PARTITION BY 1) AS m, coalesce(sum(cap) OVER (PARTITION BY 1 ORDER BY cap, cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT cls, cap, CAST(least(cap, floor((120.0 - before) / (m - r + 1))) AS BIGINT) AS level FROM l WHERE before < 120""",
    "pair_draw": f"WITH {_DRAWN} SELECT CAST(k AS BIGINT) AS k, bin FROM drawn WHERE r <= 2000",
    "probe_draw": f"WITH {_DRAWN} SELECT CAST(k AS BIGINT) AS k, bin FROM drawn WHERE r > 2000 AND r <= 2100",
    "probe_overlap": f"WITH {_DRAWN} SELECT count(*) AS n_shared FROM (SELECT k FROM drawn WHERE r <= 2000) a JOIN (SELECT k FROM drawn WHERE r > 2000 AND r <= 2100) b ON a.k = b.k",
    "bin_codes": f"SELECT id, {_bin('n')} AS bin FROM {{graphs}}",
    "bin_pair_id": f"""SELECT CAST(k AS BIGINT) AS k, CAST(least(a, b) * 11 - floor(least(a, b) * (least(a, b) - 1) / 2) + greatest(a, b) - least(a, b) AS INT) AS pair_id FROM (SELECT k, {_bin('n_i')} AS a, {_bin('n_j')} AS b FROM {{pairs}}) z""",
    "bin_table_cube": f"""SELECT n_bin, len_bin, count(*) AS n FROM (SELECT {_bin('n')} AS n_bin, CASE WHEN length(w) < 24 THEN 'short' ELSE 'full' END AS len_bin FROM {{graphs}}) x GROUP BY CUBE (n_bin, len_bin)""",
    "pooled_strata": f"""WITH c AS (SELECT {_bin('greatest(n_i, n_j)')} AS bin, cls_i AS dataset, count(*) AS n, sum(ub - lb) AS gap FROM {{pairs}} GROUP BY 1, 2)
        SELECT bin, CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(gap) / sum(n), 6) AS mean_gap, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS largest_share, CASE WHEN max(n) >= 0.9 * sum(n) THEN 1 ELSE 0 END AS dominated FROM c GROUP BY bin""",
    "density_cells": """WITH d AS (SELECT cls_i AS dataset, ub - lb AS gap, (CASE WHEN n_i < 2 THEN 0.0 ELSE 2.0 * m_i / (CAST(n_i AS DOUBLE) * (n_i - 1)) END + CASE WHEN n_j < 2 THEN 0.0 ELSE 2.0 * m_j / (CAST(n_j AS DOUBLE) * (n_j - 1)) END) / 2 AS density FROM {pairs})
        SELECT dataset, CASE WHEN density < 0.25 THEN 0 WHEN density < 0.5 THEN 1 WHEN density < 0.75 THEN 2 ELSE 3 END AS cell, count(*) AS n, round(avg(gap), 6) AS mean_gap, CASE WHEN count(*) < 1000 THEN 1 ELSE 0 END AS dropped FROM d GROUP BY 1, 2""",
    "size_profile": f"""SELECT {_bin('greatest(n_i, n_j)')} AS stratum, count(*) AS n_pairs, round(avg(CASE WHEN ub = 0 THEN 0.0 ELSE (ub - lb) / ub END), 6) AS mean_width, round(avg(ub - lb), 6) AS mean_gap, round(avg(ub), 6) AS mean_ub FROM {{pairs}} GROUP BY 1""",
    "quantile_codes": """SELECT id, CASE WHEN m < a1 THEN 0 WHEN m < a2 THEN 1 WHEN m < a3 THEN 2 ELSE 3 END AS code FROM {bgraphs} CROSS JOIN (SELECT {q25} AS a1, {q50} AS a2, {q75} AS a3 FROM {bgraphs}) q""",
    "layered_sample": f"WITH {_STRATA} SELECT k, count(*) AS n_layers FROM taken GROUP BY k",
    "layer_counts": f"WITH {_STRATA} SELECT layer, count(*) AS n FROM taken GROUP BY layer",
    "layer_coverage": f"WITH {_STRATA} SELECT CAST(s.cell AS INT) AS cell, count(*) AS population, count(t.k) AS n_taken FROM strata s LEFT JOIN (SELECT DISTINCT k FROM taken) t ON s.k = t.k GROUP BY s.cell",
    "rung_sample": """WITH r AS (SELECT k, greatest(n_i, n_j) AS rung, cls_i AS dataset, row_number() OVER (PARTITION BY greatest(n_i, n_j), cls_i ORDER BY """ + _ORDER + """) AS r FROM {pairs}) SELECT CAST(rung AS INT) AS rung, dataset, CAST(k AS BIGINT) AS k FROM r WHERE r <= 20""",
    "timing_bins": """SELECT CAST(k AS BIGINT) AS k, band FROM (SELECT k, band, row_number() OVER (PARTITION BY band ORDER BY """ + _ORDER + """) AS r FROM {pairs} JOIN (VALUES (3, 4, '3-4'), (5, 6, '5-6'), (7, 8, '7-8'), (9, 10, '9-10')) AS b(lo, hi, band)
        ON greatest(n_i, n_j) BETWEEN lo AND hi) z WHERE r <= 50""",
    "hash_draw": "SELECT CAST(k AS BIGINT) AS k FROM {pairs} ORDER BY " + _ORDER + " LIMIT 200",
    "chunks": """SELECT CAST(chunk AS INT) AS chunk, min(idx) AS first_idx, max(idx) + 1 AS end_idx, count(*) AS n FROM (SELECT CAST(idx AS INT) AS idx, ntile(7) OVER (PARTITION BY 1 ORDER BY idx) AS chunk FROM {bindexed}) z GROUP BY chunk""",
    "row_starts": """SELECT CAST(idx AS INT) AS i, CAST(idx * total - floor(idx * (idx + 1) / 2) AS BIGINT) AS first_k FROM {bindexed} CROSS JOIN (SELECT count(*) AS total FROM {bindexed}) t""",
    "first_occurrence": """SELECT w, id, n_copies FROM (SELECT w, id, row_number() OVER (PARTITION BY w ORDER BY cls, id) AS r, count(*) OVER (PARTITION BY w) AS n_copies FROM {bgraphs}) z WHERE r = 1""",
    "split_union": "SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT w FROM {bgraphs} WHERE cls = 0 UNION ALL SELECT w FROM {bgraphs} WHERE cls = 1 UNION ALL SELECT w FROM {bgraphs} WHERE cls = 2) z GROUP BY w",
    "disjoint_difference": "SELECT w FROM {bgraphs} WHERE cls = 0 EXCEPT SELECT w FROM {bgraphs} WHERE cls <> 0",
    "shared_sizes": "SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m FROM {bgraphs} WHERE cls = 0 INTERSECT SELECT CAST(n AS INT), CAST(m AS INT) FROM {bgraphs} WHERE cls = 1 INTERSECT SELECT CAST(n AS INT), CAST(m AS INT) FROM {bgraphs} WHERE cls = 2",
}
SPARK = {f"q{q}": f"percentile(m, 0.{q})" for q in (25, 50, 75)}
DUCK = {f"q{q}": f"quantile_cont(m, 0.{q})" for q in (25, 50, 75)}
