"""Queries on pairs of graphs and strings: joins, bounds, checks of matrices, merging of shards, neighbours."""

from __future__ import annotations

from ringlet.plans.relations import pearson

#: The scores of each pair, one row for each method.
SCORES = """(SELECT k, method, CASE method WHEN 'lev' THEN CAST(lev AS DOUBLE) WHEN 'ham' THEN CAST(ham AS DOUBLE) WHEN 'lb' THEN lb ELSE ub END AS value
  FROM {pairs} CROSS JOIN (VALUES ('lev'), ('ham'), ('lb'), ('ub')) AS m(method))"""
_UND = "und AS (SELECT id, u, v FROM {bedges} WHERE u <> v UNION ALL SELECT id, v, u FROM {bedges} WHERE u <> v)"
_WL = (
    _UND
    + """, c0 AS (SELECT id, {nodes} AS u, 'b' AS c FROM {bgraphs}),
   c1 AS (SELECT a.id, a.u, md5(concat('1#', a.c, '|', coalesce({listed}, ''))) AS c FROM c0 a LEFT JOIN (SELECT e.id, e.u, b.c FROM und e JOIN c0 b ON e.id = b.id AND e.v = b.u) b ON a.id = b.id AND a.u = b.u GROUP BY a.id, a.u, a.c),
   c2 AS (SELECT a.id, a.u, md5(concat('2#', a.c, '|', coalesce({listed}, ''))) AS c FROM c1 a LEFT JOIN (SELECT e.id, e.u, b.c FROM und e JOIN c1 b ON e.id = b.id AND e.v = b.u) b ON a.id = b.id AND a.u = b.u GROUP BY a.id, a.u, a.c),
   f AS (SELECT id, r, c, count(*) AS n FROM (SELECT id, 0 AS r, c FROM c0 UNION ALL SELECT id, 1, c FROM c1 UNION ALL SELECT id, 2, c FROM c2) x GROUP BY id, r, c)"""
)
_CLASSES = _WL + """, s AS (SELECT id, md5({features}) AS s FROM f GROUP BY id), t AS (SELECT s, min(id) AS id FROM s GROUP BY s),
   fc AS (SELECT f.* FROM f JOIN t ON f.id = t.id),
   kern AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) AS kernel FROM fc a JOIN fc b ON a.r = b.r AND a.c = b.c AND a.id <= b.id GROUP BY a.id, b.id)"""

SHARED = {
    "levenshtein_pairs": "SELECT CAST(k AS BIGINT) AS k, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(lev AS INT) AS lev FROM {pairs}",
    "padded_hamming": "SELECT CAST(k AS BIGINT) AS k, CAST(ham AS BIGINT) AS ham FROM {pairs}",
    "hamming": """SELECT CAST(k AS BIGINT) AS k, CAST({hamming} AS INT) AS d FROM {pairs} p JOIN {bench} a ON p.id_i = a.id JOIN {bench} b ON p.id_j = b.id""",
    "size_null": "SELECT CAST(k AS BIGINT) AS k, CAST(abs(n_i - n_j) AS INT) AS d FROM {pairs}",
    "levenshtein_band": """SELECT CAST(k AS BIGINT) AS k, band, CAST(lev AS INT) AS lev FROM {pairs} JOIN (VALUES (1, 3, 'small'), (4, 5, 'middle'), (6, 8, 'large')) AS b(lo, hi, band)
        ON greatest(n_i, n_j) BETWEEN lo AND hi""",
    "branch_lower_bound": "SELECT CAST(k AS BIGINT) AS k, round(lb, 1) AS lb FROM {pairs}",
    "induced_upper_bound": "SELECT CAST(k AS BIGINT) AS k, round(ub, 1) AS ub FROM {pairs}",
    "induced_edit_cost": """WITH perm AS (SELECT id, u, row_number() OVER (PARTITION BY id ORDER BY md5(concat(CAST(id AS {text}), ':', CAST(u AS {text}))), u) - 1 AS t FROM (SELECT id, {nodes} AS u FROM {bgraphs}) x),
        one AS (SELECT DISTINCT id, u, v FROM {bedges} WHERE u < v),
        two AS (SELECT e.id, least(a.t, b.t) AS u, greatest(a.t, b.t) AS v FROM one e JOIN perm a ON e.id = a.id AND e.u = a.u JOIN perm b ON e.id = b.id AND e.v = b.u)
        SELECT g.id, coalesce(cost, 0) AS cost FROM {bgraphs} g LEFT JOIN (SELECT coalesce(one.id, two.id) AS id, count(CASE WHEN one.id IS NULL OR two.id IS NULL THEN 1 END) AS cost
          FROM one FULL OUTER JOIN two ON one.id = two.id AND one.u = two.u AND one.v = two.v GROUP BY 1) c ON g.id = c.id""",
    "relabelled_edges": """WITH perm AS (SELECT id, u, row_number() OVER (PARTITION BY id ORDER BY md5(concat(CAST(id AS {text}), ':', CAST(u AS {text}))), u) - 1 AS t FROM (SELECT id, {nodes} AS u FROM {bgraphs}) x)
        SELECT e.id, CAST(least(a.t, b.t) AS INT) AS u, CAST(greatest(a.t, b.t) AS INT) AS v FROM {bedges} e JOIN perm a ON e.id = a.id AND e.u = a.u JOIN perm b ON e.id = b.id AND e.v = b.u""",
    "edge_diff": """SELECT a.idx, count(CASE WHEN y.id IS NULL AND x.u IS NOT NULL THEN 1 END) AS n_dropped FROM {bindexed} a JOIN {bindexed} b ON b.idx = a.idx + 1
        LEFT JOIN (SELECT DISTINCT id, u, v FROM {bedges} WHERE u < v) x ON x.id = a.id LEFT JOIN (SELECT DISTINCT id, u, v FROM {bedges} WHERE u < v) y ON y.id = b.id AND y.u = x.u AND y.v = x.v GROUP BY a.idx""",
    # Brackets
    "bracket_width": """SELECT CAST(k AS BIGINT) AS k, round(lb, 1) AS lb, round(ub, 1) AS ub, CASE WHEN ub = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, (ub - lb) / ub)), 9) END AS width,
        round(greatest(ub - lb, 0.0), 1) AS gap FROM {pairs}""",
    "certified_rate": """SELECT CAST(greatest(n_i, n_j) AS INT) AS n_max, count(*) AS n_pairs, round(avg(CASE WHEN abs(ub - lb) <= 1e-9 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS certified
        FROM {pairs} GROUP BY 1""",
    "certified_pairs": "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(ub, 1) AS distance FROM {pairs} WHERE abs(ub - lb) <= 1e-9 AND cls_i = 0 AND cls_j = 0",
    "signed_error": """SELECT CAST(k AS BIGINT) AS k, e.side, round(CASE WHEN e.side = 'lower' THEN ub - lb ELSE ub - ham END, 1) AS error FROM {pairs} CROSS JOIN (VALUES ('lower'), ('upper')) AS e(side)
        WHERE abs(ub - lb) > 1e-9 OR e.side = 'lower'""",
    "validity_counts": """SELECT count(*) AS n_pairs, count(CASE WHEN lb > ub + 1e-9 THEN 1 END) AS n_refuted, count(CASE WHEN lb < 0 OR ub < 0 THEN 1 END) AS n_negative,
        count(CASE WHEN abs(ub - lb) <= 1e-9 THEN 1 END) AS n_certified, count(CASE WHEN ub = 0 THEN 1 END) AS n_zero FROM {pairs}""",
    "widest_examples": "SELECT CAST(k AS BIGINT) AS k, round(ub - lb, 1) AS gap FROM {pairs} ORDER BY ub - lb DESC, k LIMIT 10",
    "rung_population": "SELECT CAST(n AS INT) AS rung, count(*) AS n_pairs FROM (SELECT greatest(n_i, n_j) AS n FROM {pairs}) x GROUP BY n",
    "pair_density": """SELECT CAST(k AS BIGINT) AS k, round((CASE WHEN n_i < 2 THEN 0.0 ELSE 2.0 * m_i / (CAST(n_i AS DOUBLE) * (n_i - 1)) END + CASE WHEN n_j < 2 THEN 0.0 ELSE 2.0 * m_j / (CAST(n_j AS DOUBLE) * (n_j - 1)) END) / 2, 9) AS density FROM {pairs}""",
    # Joins of matrices
    "sub_matrix": """SELECT CAST(k AS BIGINT) AS k, CAST(lev AS INT) AS lev FROM {pairs} p WHERE EXISTS (SELECT 1 FROM {bindexed} a WHERE a.idx = p.i AND a.n BETWEEN 3 AND 5)
        AND EXISTS (SELECT 1 FROM {bindexed} b WHERE b.idx = p.j AND b.n BETWEEN 3 AND 5)""",
    "valid_pair_mask": """SELECT CAST(a.k AS BIGINT) AS k, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL AND a.value >= 0 AND b.value >= 0 THEN 1 ELSE 0 END AS valid FROM
        (SELECT k, CASE WHEN k % 7 <> 0 THEN lev END AS value FROM {pairs}) a JOIN (SELECT k, CASE WHEN k % 5 <> 0 THEN ham END AS value FROM {pairs}) b ON a.k = b.k""",
    "matrix_alignment": """SELECT coalesce(a.k, b.k) AS k, a.value AS ours, b.value AS theirs, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'missing' WHEN a.value = b.value THEN 'equal' ELSE 'differs' END AS status FROM
        (SELECT CAST(k AS BIGINT) AS k, CAST(ub AS DOUBLE) AS value FROM {pairs} WHERE k % 3 <> 0) a FULL OUTER JOIN (SELECT CAST(k AS BIGINT) AS k, CAST(ham AS DOUBLE) AS value FROM {pairs} WHERE k % 3 <> 1) b ON a.k = b.k""",
    "order_alignment": """SELECT count(*) AS n_rows, count(CASE WHEN a.id <> b.id THEN 1 END) AS n_misplaced FROM {bindexed} a JOIN (SELECT id, row_number() OVER (PARTITION BY 1 ORDER BY id) - 1 AS idx FROM {bench}) b ON a.idx = b.idx""",
    "strings_join_metadata": """SELECT s.id, CAST(length(s.w) AS INT) AS len, CAST(g.n AS INT) AS n_nodes, CAST(g.m AS INT) AS n_edges FROM {bench} s JOIN (SELECT * FROM {bgraphs} WHERE n > 2) g ON s.id = g.id""",
    "strings_without_metadata": "SELECT count(*) AS n_skipped FROM {bench} s WHERE NOT EXISTS (SELECT 1 FROM {bgraphs} g WHERE g.id = s.id AND g.n > 2)",
    "existing_ids": "SELECT id, CAST(length(w) AS INT) AS len FROM {strings} s WHERE EXISTS (SELECT 1 FROM (SELECT doc_id AS d FROM {labels} WHERE quality = 1) l WHERE l.d = CAST(floor(s.id / 1048576) AS BIGINT))",
    "common_ids": "SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}",
    "cross_split_null": "SELECT CAST(k AS BIGINT) AS k, CASE WHEN cls_i = cls_j THEN round(ub, 1) END AS distance FROM {pairs}",
    "method_pairs": """SELECT a.method AS method_a, b.method AS method_b, count(*) AS n, CASE WHEN count(*) < 3 THEN NULL ELSE round(""" + pearson("a.value", "b.value") + """, 4) END AS pearson, round(max(abs(a.value - b.value)), 6) AS max_abs,
        round(avg(abs(a.value - b.value)), 6) AS mean_abs, round(avg(CASE WHEN a.value = b.value THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS identical
        FROM """ + SCORES + " a JOIN " + SCORES + """ b ON a.k = b.k AND a.method < b.method GROUP BY a.method, b.method""",
    "proven_orderings": """SELECT a.method AS lower_method, b.method AS upper_method, count(CASE WHEN a.value > b.value + 1e-9 THEN 1 END) AS n_violations FROM """ + SCORES + " a JOIN " + SCORES
    + """ b ON a.k = b.k AND a.method IN ('lb') AND b.method IN ('ub', 'ham') GROUP BY a.method, b.method""",
    # Shards
    "shard_merge": """SELECT CAST(k AS BIGINT) AS k, count(*) AS copies, CAST(max(lev) AS INT) AS value, CASE WHEN min(lev) = max(lev) THEN 1 ELSE 0 END AS agree
        FROM (SELECT k, lev FROM {pairs} WHERE k % 3 <> 0 UNION ALL SELECT k, lev FROM {pairs} WHERE k % 3 <> 1) x GROUP BY k""",
    "resume_anti_join": """SELECT CAST(k AS BIGINT) AS k FROM {pairs} p WHERE NOT EXISTS (SELECT 1 FROM {pairs} d WHERE d.k = p.k AND d.lev <= 10)""",
    "crossfill": """SELECT CAST(a.k AS BIGINT) AS k, round(greatest(a.lb, coalesce(b.lb, 0.0)), 1) AS lb, round(least(a.ub, coalesce(b.ub, a.ub), coalesce(c.ub, a.ub)), 1) AS ub,
        CASE WHEN abs(least(a.ub, coalesce(b.ub, a.ub), coalesce(c.ub, a.ub)) - greatest(a.lb, coalesce(b.lb, 0.0))) <= 1e-9 THEN 1 ELSE 0 END AS certified FROM
        (SELECT k, CAST(abs(m_i - m_j) AS DOUBLE) AS lb, CAST(n_i + n_j + m_i + m_j AS DOUBLE) AS ub FROM {pairs}) a LEFT JOIN (SELECT k, lb, ub FROM {pairs} WHERE k % 2 = 0) b ON a.k = b.k
        LEFT JOIN (SELECT k, CAST(abs(n_i - n_j) + ham AS DOUBLE) AS ub FROM {pairs} WHERE k % 5 = 0) c ON a.k = c.k""",
    "subsample_completeness": """SELECT count(*) AS n_wanted, count(d.k) AS n_done, count(*) - count(d.k) AS n_missing FROM (SELECT k FROM {pairs} WHERE k % 10 = 3) s LEFT JOIN (SELECT k FROM {pairs} WHERE k % 4 <> 0) d ON s.k = d.k""",
    "pair_list": """SELECT DISTINCT CAST(least(a, b) * total - CAST(floor(least(a, b) * (least(a, b) + 1) / 2) AS BIGINT) + greatest(a, b) - least(a, b) - 1 AS BIGINT) AS k FROM
        (SELECT q AS a, o AS b FROM {both} WHERE (q + o) % 3 = 0) x CROSS JOIN (SELECT count(*) AS total FROM {bindexed}) t WHERE a <> b""",
    "orientation_summary": """SELECT CAST(n_i - n_j AS INT) AS size_gap, count(*) AS n, round(avg(CASE WHEN ub <> abs(n_i - n_j) + ham THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS differ,
        round(max(abs(n_i - n_j) + ham - ub), 1) AS largest FROM {pairs} GROUP BY 1""",
    # Checks of matrices
    "metric_axioms": """SELECT count(*) AS n_pairs, count(CASE WHEN lev < 0 OR ham < 0 THEN 1 END) AS n_negative, count(CASE WHEN lb < abs(m_i - m_j) / 2.0 THEN 1 END) AS n_below_bound,
        count(CASE WHEN lev = 0 AND ham <> 0 THEN 1 END) AS n_identity, count(CASE WHEN lev = 0 AND lb <> 0 THEN 1 END) AS n_zero_disagree FROM {pairs}""",
    "symmetry_check": """SELECT count(*) AS n_entries, count(CASE WHEN b.lev IS NULL THEN 1 END) AS n_missing, count(CASE WHEN a.lev <> b.lev OR a.ham <> b.ham THEN 1 END) AS n_asymmetric, count(CASE WHEN a.q = a.o THEN 1 END) AS n_diagonal
        FROM {both} a LEFT JOIN {both} b ON a.q = b.o AND a.o = b.q""",
    "triangle_violations": """SELECT count(*) AS n_triples, count(CASE WHEN a.lev > b.lev + c.lev OR b.lev > a.lev + c.lev OR c.lev > a.lev + b.lev THEN 1 END) AS n_violations
        FROM {pairs} a JOIN {pairs} b ON a.i = b.i AND a.j < b.j JOIN {pairs} c ON c.i = a.j AND c.j = b.j""",
    "structural_gate": """SELECT count(*) AS n_pairs, count(CASE WHEN lb IS NULL OR ub IS NULL THEN 1 END) AS n_null, count(CASE WHEN lb > ub + 1e-9 THEN 1 END) AS n_crossed,
        count(CASE WHEN ub = 0 AND lb > 0 THEN 1 END) AS n_uncertified_zeros, round(CAST(count(CASE WHEN ub = 0 THEN 1 END) AS DOUBLE) / count(*), 9) AS zero_fraction,
        CASE WHEN count(CASE WHEN lb > ub + 1e-9 THEN 1 END) = 0 AND count(CASE WHEN ub = 0 THEN 1 END) < 0.99 * count(*) THEN 'pass' ELSE 'fail' END AS verdict FROM {pairs}""",
    "gate_by_role": """SELECT role, count(*) AS n, count(CASE WHEN value IS NULL OR value < 0 THEN 1 END) AS n_bad, CASE WHEN count(CASE WHEN value > 0 THEN 1 END) = 0 THEN 1 ELSE 0 END AS all_zero FROM
        """ + SCORES.replace("method", "role") + """ x GROUP BY role""",
    "zero_implies_zero": "SELECT count(CASE WHEN ham = 0 AND n_i = n_j THEN 1 END) AS n_same, count(CASE WHEN ham = 0 AND n_i = n_j AND lb <> 0 THEN 1 END) AS n_incomplete FROM {pairs}",
    "dominance_check": "SELECT count(CASE WHEN ub > abs(n_i - n_j) + ham THEN 1 END) AS n_worse, count(CASE WHEN ub < abs(n_i - n_j) + ham THEN 1 END) AS n_better, count(*) AS n FROM {pairs}",
    "lower_bound_recomputed": """SELECT count(*) AS n_checked, count(CASE WHEN lb < abs(n_i - n_j) OR lb < abs(m_i - m_j) THEN 1 END) AS n_inconsistent FROM {pairs}""",
    "matrix_report": """SELECT test, CASE test WHEN 'nonnegative' THEN a WHEN 'ordered' THEN b WHEN 'bracketed' THEN c ELSE d END AS passed FROM (SELECT CASE WHEN min(lev) >= 0 THEN 1 ELSE 0 END AS a, CASE WHEN count(CASE WHEN i >= j THEN 1 END) = 0 THEN 1 ELSE 0 END AS b,
        CASE WHEN count(CASE WHEN lb > ub + 1e-9 THEN 1 END) = 0 THEN 1 ELSE 0 END AS c, CASE WHEN max(lev) <= 16 THEN 1 ELSE 0 END AS d FROM {pairs}) z CROSS JOIN (VALUES ('nonnegative'), ('ordered'), ('bracketed'), ('bounded')) AS t(test)""",
    "csr_invariants": """SELECT count(*) AS n_edges, count(CASE WHEN u > v THEN 1 END) AS n_unordered, count(CASE WHEN u = v THEN 1 END) AS n_loops, count(CASE WHEN v >= n THEN 1 END) AS n_out_of_range,
        count(*) - count(DISTINCT concat(CAST(e.id AS {text}), ':', CAST(u AS {text}), ':', CAST(v AS {text}))) AS n_repeated FROM {bedges} e JOIN {bgraphs} g ON e.id = g.id""",
    "expected_counts": """SELECT e.suite, e.expected, coalesce(a.n, 0) AS actual, CASE WHEN coalesce(a.n, 0) >= e.expected THEN 1 ELSE 0 END AS ok FROM (VALUES (0, 10), (1, 10), (2, 10)) AS e(suite, expected)
        LEFT JOIN (SELECT cls, count(*) AS n FROM {bgraphs} GROUP BY cls) a ON e.suite = a.cls""",
    # Neighbours
    "knn_topk": """SELECT CAST(q AS INT) AS q, CAST(o AS INT) AS o, CAST(r AS INT) AS r FROM (SELECT q, o, row_number() OVER (PARTITION BY q ORDER BY lev, o) AS r FROM {both}) y WHERE r <= 5""",
    "precision_at_k": """WITH ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY ub, o) AS a, row_number() OVER (PARTITION BY q ORDER BY lev, o) AS b, count(*) OVER (PARTITION BY q) AS n FROM {both}),
        each AS (SELECT t.k, q, CAST(count(CASE WHEN a <= t.k AND b <= t.k THEN 1 END) AS DOUBLE) / t.k AS p FROM ranked CROSS JOIN (VALUES (5), (10), (20)) AS t(k) WHERE n >= t.k GROUP BY t.k, q)
        SELECT k, round(avg(p), 9) AS precision_at_k, count(*) AS n_graphs FROM each GROUP BY k""",
    "knn_overlap": """WITH ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY ub, o) AS a, row_number() OVER (PARTITION BY q ORDER BY lev, o) AS b FROM {both})
        SELECT CAST(q AS INT) AS q, count(CASE WHEN a <= 5 AND b <= 5 THEN 1 END) AS n_shared FROM ranked GROUP BY q""",
    # Weisfeiler-Lehman
    "wl_colours": "WITH " + _WL + " SELECT id, CAST(u AS INT) AS node, 1 AS round, c AS colour FROM c1 UNION ALL SELECT id, CAST(u AS INT), 2, c FROM c2 UNION ALL SELECT id, CAST(u AS INT), 0, c FROM c0",
    "wl_features": "WITH " + _WL + " SELECT id, concat('h', CAST(r AS {text}), ':', c) AS feature, n FROM f",
    "wl_classes": "WITH " + _CLASSES + " SELECT s.id, t.id AS class_id FROM s JOIN t ON s.s = t.s",
    "wl_kernel": "WITH " + _CLASSES + " SELECT a, b, CAST(kernel AS BIGINT) AS kernel FROM kern",
    "wl_kernel_distance": "WITH " + _CLASSES
    + " SELECT x.a, x.b, round(sqrt(CAST(greatest(p.kernel + q.kernel - 2 * x.kernel, 0) AS DOUBLE)), 9) AS distance FROM kern x JOIN kern p ON p.a = x.a AND p.b = x.a JOIN kern q ON q.a = x.b AND q.b = x.b",
    "wl_kernel_checks": "WITH " + _CLASSES
    + """ SELECT count(*) AS n_entries, count(CASE WHEN x.kernel < 0 THEN 1 END) AS n_negative, count(CASE WHEN CAST(x.kernel AS DOUBLE) * x.kernel > CAST(p.kernel AS DOUBLE) * q.kernel THEN 1 END) AS n_not_psd,
        count(DISTINCT p.kernel + q.kernel - 2 * x.kernel) AS n_distinct FROM kern x JOIN kern p ON p.a = x.a AND p.b = x.a JOIN kern q ON q.a = x.b AND q.b = x.b""",
}
SPARK = {
    "nodes": "explode(sequence(0, n - 1))", "listed": "listagg(b.c, ',') WITHIN GROUP (ORDER BY b.c)",
    "features": "listagg(concat(CAST(r AS STRING), ':', c, ':', CAST(n AS STRING)), ',') WITHIN GROUP (ORDER BY r, c)",
    "hamming": "CASE WHEN length(a.w) = length(b.w) THEN aggregate(zip_with(split(a.w, ''), split(b.w, ''), (s, t) -> IF(s = t, 0, 1)), 0, (s, t) -> s + t) END",
}
DUCK = {
    "nodes": "unnest(range(0, n))", "listed": "string_agg(b.c, ',' ORDER BY b.c)",
    "features": "string_agg(concat(CAST(r AS VARCHAR), ':', c, ':', CAST(n AS VARCHAR)), ',' ORDER BY r, c)",
    "hamming": "CASE WHEN length(a.w) = length(b.w) THEN CASE WHEN a.w = '' THEN 0 ELSE hamming(a.w, b.w) END END",
}
