"""Queries on strings and the graphs they decode to, as text that both engines read."""

from __future__ import annotations

from ringlet.plans.relations import pearson

SHARED = {
    # Decoding
    "s2g_decode_stats": "SELECT id, CAST(length(w) AS INT) AS len, CAST(n AS INT) AS n_nodes, CAST(m AS BIGINT) AS n_edges FROM {graphs}",
    "s2g_edges": "SELECT id, CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {edges}",
    "s2g_directed_edges": "SELECT id, CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {arcs}",
    "s2g_self_loops": "SELECT id, count(*) AS n_loops FROM {edges} WHERE u = v GROUP BY id",
    "letters_covered": """SELECT id, CAST(n_letters AS BIGINT) AS n_letters, CAST(n_letters = in_parts AS INT) AS all_read FROM
        (SELECT doc_id AS id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''{all})) AS n_letters FROM {documents}) d
        JOIN (SELECT CAST(floor(id / 1048576) AS BIGINT) AS k, sum(length(w)) AS in_parts FROM {strings} GROUP BY 1) p ON d.id = p.k""",
    # Symbols of a string
    "instruction_histogram": "SELECT c AS instruction, count(*) AS n, count(DISTINCT id) AS n_strings FROM {chars} GROUP BY c",
    "instruction_counts": "SELECT id, "
    + ", ".join(f"CAST(length(w) - length(replace(w, '{c}', '')) AS INT) AS {'upper' if c.isupper() else 'lower'}_{c.lower()}" for c in "NnPpVvCcW")
    + " FROM {strings}",
    "instruction_fractions": """SELECT c AS instruction, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {chars}), 9) AS fraction FROM {chars} GROUP BY c""",
    "instruction_groups": """SELECT id, """
    + ", ".join(f"CASE WHEN length(w) = 0 THEN 0.0 ELSE round(CAST(length(w) - length(regexp_replace(w, '[{g}]', ''{{all}})) AS DOUBLE) / length(w), 9) END AS {name}_fraction"
                for name, g in (("node", "Vv"), ("edge", "Cc"), ("move", "NnPp"), ("noop", "W")))
    + " FROM {strings}",
    "string_entropy": """SELECT s.id, coalesce(bits, 0.0) AS bits_per_symbol FROM {strings} s LEFT JOIN
        (SELECT id, round(abs(sum(p * ln(p)) / ln(2)), 6) AS bits FROM
          (SELECT id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY id) AS p FROM {chars} GROUP BY id, c) x GROUP BY id) e ON s.id = e.id""",
    # Message lengths
    "message_lengths": """SELECT g.id, CAST(length(w) AS INT) AS len, round(length(w) * ln(9) / ln(2), 6) AS uniform_bits, round(length(w) * coalesce(h, 0.0), 6) AS entropy_bits,
        CAST(CASE WHEN n <= 1 THEN 0 ELSE m * 2 * length(bin(n - 1)) END AS DOUBLE) AS generous_bits,
        CAST(CASE WHEN n <= 1 THEN 0 ELSE n - 1 + m + m * 2 * length(bin(n - 1)) END AS DOUBLE) AS standard_bits,
        round(CASE WHEN n <= 1 THEN 0.0 ELSE (n - 1 + m) * ln(6) / ln(2) + m * 2 * length(bin(n - 1)) END, 6) AS full_bits FROM {graphs} g LEFT JOIN
        (SELECT id, abs(sum(p * ln(p)) / ln(2)) AS h FROM
          (SELECT id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY id) AS p FROM {chars} GROUP BY id, c) x GROUP BY id) e ON g.id = e.id""",
    "combinatorial_bound": """SELECT id, round(CASE WHEN n <= 1 OR m <= 0 OR n * (n - 1) / 2 <= m THEN 0.0 ELSE {log2_choose} END, 6) AS bits FROM {bgraphs}""",
    "iso_class_bits": """SELECT id, round(CASE WHEN n <= 1 THEN 0.0 ELSE greatest(CASE WHEN m <= 0 OR n * (n - 1) / 2 <= m THEN 0.0 ELSE {log2_choose} END - {log2_factorial}, 0.0) END, 6) AS bits FROM {bgraphs}""",
    "compression_ratio": """SELECT id, CASE WHEN length(w) = 0 THEN NULL ELSE round(CAST(m * 2 * length(bin(n - 1)) AS DOUBLE) / (length(w) * ln(9) / ln(2)), 6) END AS ratio FROM {graphs} WHERE n > 1""",
    "message_length_summary": """SELECT lang AS dataset, method, count(*) AS n_graphs, round(avg(string_bits), 6) AS mean_string_bits, round(avg(graph_bits), 6) AS mean_graph_bits,
        count(CASE WHEN string_bits < graph_bits THEN 1 END) AS n_wins, round(avg(CASE WHEN string_bits > 0 THEN graph_bits / string_bits END), 6) AS mean_ratio
        FROM (SELECT lang, 'generous' AS method, length(w) * ln(9) / ln(2) AS string_bits, CAST(CASE WHEN n <= 1 THEN 0 ELSE m * 2 * length(bin(n - 1)) END AS DOUBLE) AS graph_bits FROM {graphs}
          UNION ALL SELECT lang, 'standard', length(w) * ln(9) / ln(2), CAST(CASE WHEN n <= 1 THEN 0 ELSE n - 1 + m + m * 2 * length(bin(n - 1)) END AS DOUBLE) FROM {graphs}) x GROUP BY lang, method""",
    "message_length_ols": """SELECT lang AS dataset, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2
        FROM (SELECT lang, CAST(m * 2 * length(bin(n - 1)) AS DOUBLE) AS x, CAST(length(w) AS DOUBLE) * ln(9) / ln(2) AS y FROM {graphs} WHERE n > 1) z GROUP BY lang HAVING var_pop(x) > 0 AND var_pop(y) > 0""",
    "information_content": """SELECT lang AS dataset, count(*) AS n_graphs, round(avg(CAST(n AS DOUBLE)), 6) AS mean_nodes, round(avg(CAST(m AS DOUBLE)), 6) AS mean_edges,
        round(avg(CAST(length(w) AS DOUBLE)), 6) AS mean_length, round(""" + pearson("m", "length(w)") + """, 6) AS r FROM {graphs} WHERE length(w) > 0 GROUP BY lang""",
    "length_scaling": """SELECT id, CAST(n AS INT) AS n_nodes, CAST(length(w) AS INT) AS len, round(CAST(length(w) AS DOUBLE) / n, 9) AS per_node, round(CAST(length(w) AS DOUBLE) / (n * n), 9) AS per_cell,
        round(CAST(length(w) AS DOUBLE) / greatest(m, 1), 9) AS per_edge FROM {graphs}""",
    # Graphs
    "graph_json": """SELECT id, {json} AS graph FROM {gtext}""",
    "graph_density": "SELECT id, CASE WHEN n < 2 THEN 0.0 ELSE round(CAST(2 * m AS DOUBLE) / (n * (n - 1)), 9) END AS density FROM {bgraphs}",
    "node_count_histogram": "SELECT CAST(n AS INT) AS n_nodes, count(*) AS n_graphs FROM {graphs} GROUP BY n",
    "graph_stats": """SELECT source, count(*) AS n_graphs, round(avg(CAST(n AS DOUBLE)), 6) AS mean_nodes, CAST(min(n) AS INT) AS min_nodes, CAST(max(n) AS INT) AS max_nodes,
        round({median_n}, 6) AS median_nodes, round(avg(CAST(m AS DOUBLE)), 6) AS mean_edges, round(avg(CASE WHEN n < 2 THEN 0.0 ELSE 2.0 * m / (CAST(n AS DOUBLE) * (n - 1)) END), 6) AS mean_density FROM {graphs} GROUP BY source""",
    "degree_sequence": """SELECT id, node, CAST(sum(d) AS BIGINT) AS degree FROM (SELECT id, CAST(u AS INT) AS node, 1 AS d FROM {bedges} WHERE u <> v UNION ALL SELECT id, CAST(v AS INT), 1 FROM {bedges} WHERE u <> v
        UNION ALL SELECT id, CAST(k AS INT), 0 FROM (SELECT id, {nodes} AS k FROM {bgraphs}) y) x GROUP BY id, node""",
    "degree_array": "SELECT id, {degrees} AS degrees FROM {bgraphs}",
    "edge_toggles": """SELECT id, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CASE WHEN there = 1 THEN 'drop' ELSE 'add' END AS edit FROM
        (SELECT g.id, g.u, g.v, CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS there FROM {cells} g LEFT JOIN (SELECT DISTINCT id, u, v FROM {bedges} WHERE u < v) e ON g.id = e.id AND g.u = e.u AND g.v = e.v) x""",
    # Neighbourhood of a string
    "edit_neighbourhood": """WITH w AS (SELECT id, w, CAST(length(w) AS INT) AS l FROM {bench}), a AS (SELECT c FROM (VALUES ('N'), ('n'), ('P'), ('p'), ('V'), ('v'), ('C'), ('c'), ('W')) AS t(c)),
        p AS (SELECT id, w, l, {series} AS p FROM w),
        x AS (SELECT id, w, concat(substr(w, 1, CAST(p AS INT) - 1), substr(w, CAST(p AS INT) + 1)) AS y FROM p WHERE p <= l
          UNION SELECT id, w, concat(substr(w, 1, p - 1), c, substr(w, p + 1)) FROM p CROSS JOIN a WHERE p <= l
          UNION SELECT id, w, concat(substr(w, 1, p - 1), c, substr(w, p)) FROM p CROSS JOIN a)
        SELECT id, y AS neighbour FROM x WHERE y <> w""",
    # Cohorts
    "cohort_filter": """WITH s AS (SELECT id, n, {reached} AS reached FROM {thin_graphs})
        SELECT id, CAST(n AS INT) AS n_nodes, CASE WHEN n < 2 THEN 'trivial' WHEN n > 6 THEN 'too_large' WHEN reached < n THEN 'disconnected' END AS reason FROM s""",
    "filter_report": """WITH s AS (SELECT id, n, {reached} AS reached FROM {thin_graphs}), r AS (SELECT CASE WHEN n < 2 THEN 'trivial' WHEN n > 6 THEN 'too_large' WHEN reached < n THEN 'disconnected' ELSE 'kept' END AS reason FROM s)
        SELECT count(*) AS n_total, count(CASE WHEN reason = 'trivial' THEN 1 END) AS n_trivial, count(CASE WHEN reason = 'too_large' THEN 1 END) AS n_too_large,
        count(CASE WHEN reason = 'disconnected' THEN 1 END) AS n_disconnected, round(CAST(100 * count(CASE WHEN reason = 'kept' THEN 1 END) AS DOUBLE) / count(*), 1) AS pct_kept FROM r""",
    "cohort_audit": """SELECT cls AS suite, CASE WHEN n BETWEEN 2 AND 6 THEN 1 ELSE 0 END AS kept, count(*) AS n_graphs, round(avg(CAST(n AS DOUBLE)), 9) AS mean_nodes, CAST(min(n) AS INT) AS min_nodes,
        CAST(max(n) AS INT) AS max_nodes, round(avg(CAST(m AS DOUBLE)), 9) AS mean_edges, round(avg(CASE WHEN n < 2 THEN 0.0 ELSE 2.0 * m / (CAST(n AS DOUBLE) * (n - 1)) END), 9) AS mean_density FROM {bgraphs} GROUP BY 1, 2""",
    "size_bias": """SELECT cls AS suite, round(avg(CASE WHEN n BETWEEN 2 AND 6 THEN NULL ELSE CAST(n AS DOUBLE) END) / avg(CASE WHEN n BETWEEN 2 AND 6 THEN CAST(n AS DOUBLE) END), 6) AS bias FROM {bgraphs} GROUP BY cls""",
    "class_balance": """SELECT c.cls, coalesce(n, 0) AS n_graphs, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS present FROM (VALUES (0), (1), (2)) AS c(cls) LEFT JOIN
        (SELECT cls, count(*) AS n FROM {bgraphs} GROUP BY cls) g ON c.cls = g.cls""",
    "csr_offsets": """SELECT idx, CAST(m AS INT) AS n_edges, CAST(coalesce(sum(m) OVER (PARTITION BY 1 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS edge_offset FROM {bindexed}""",
    "padded_ids": """SELECT id, concat('bench_', CASE cls WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END, '_', lpad(CAST(row_number() OVER (PARTITION BY cls ORDER BY id) - 1 AS {text}), 4, '0')) AS graph_id FROM {bgraphs}""",
    "string_validity": """SELECT count(*) AS n_strings, count(CASE WHEN regexp_replace(w, '[NnPpVvCcW]', ''{all}) <> '' THEN 1 END) AS n_invalid, count(CASE WHEN length(w) > 24 THEN 1 END) AS n_too_long,
        count(CASE WHEN length(w) = 0 THEN 1 END) AS n_empty FROM {strings}""",
    # Graphs of other tables
    "user_transitions": """SELECT user_id, prev AS from_type, event_type AS to_type, count(*) AS n FROM
        (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x WHERE prev IS NOT NULL GROUP BY 1, 2, 3""",
    "order_supplier_graph": """SELECT a.s AS u, b.s AS v, count(*) AS n_orders FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) a
        JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM {lineitem}) b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2""",
    "conversation_paths": """SELECT conv_id, count(*) AS n_turns, count(next) AS n_edges FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next
        FROM {conversations}) x GROUP BY conv_id""",
    "random_strings": """SELECT CAST(s AS INT) AS s, {listed_letters} AS w FROM (SELECT s, p, substr('NnPpVvCcW', CAST({random} % 9 AS INT) + 1, 1) AS c FROM {cross}) x GROUP BY s""",
}

_CLOSURE = """size(aggregate(sequence(1, n), array(0), (r, i) -> array_union(r, transform(filter(flatten(transform(edges, e -> array(e, named_struct('u', e.v, 'v', e.u)))),
  e -> array_contains(r, e.u)), e -> e.v))))"""

SPARK = {
    "all": "", "log2_choose": "aggregate(sequence(1, m), 0D, (a, k) -> a + log2((n * (n - 1) / 2 - m + k) / k))",
    "log2_factorial": "aggregate(sequence(1, n), 0D, (a, k) -> a + log2(k))", "median_n": "percentile(n, 0.5)",
    "json": "graph", "nodes": "explode(sequence(0, n - 1))", "degrees": "array_join(d, ',')",
    "cells": "(SELECT id, u, v FROM (SELECT id, explode(flatten(transform(sequence(0, n - 1), a -> transform(filter(sequence(0, n - 1), b -> b > a), b -> struct(a AS u, b AS v))))) AS c FROM {bgraphs}) z LATERAL VIEW inline(array(c)) t AS u, v)",
    "reached": _CLOSURE, "listed_letters": "listagg(c, '') WITHIN GROUP (ORDER BY p)",
    "random": "CAST(conv(substr(md5(concat(CAST(s AS STRING), ':', CAST(p AS STRING))), 1, 8), 16, 10) AS BIGINT)",
    "cross": "(SELECT s, explode(sequence(1, 1 + s % 40)) AS p FROM (SELECT explode(sequence(0, 499)) AS s) y)",
}
DUCK = {
    "all": ", 'g'", "log2_choose": "(lgamma(n * (n - 1) / 2 + 1) - lgamma(m + 1) - lgamma(n * (n - 1) / 2 - m + 1)) / ln(2)",
    "log2_factorial": "lgamma(n + 1) / ln(2)", "median_n": "quantile_cont(n, 0.5)",
    "json": """concat('{"directed":false,"n":', n, ',"edges":[', array_to_string(list_transform(list_sort(l), lambda c: concat('[', c // 1048576, ',', c % 1048576, ']')), ','), ']}')""",
    "nodes": "unnest(range(0, n))", "degrees": "array_to_string(d, ',')",
    "cells": "(SELECT a.id, a.u, b.v FROM (SELECT id, unnest(range(0, n)) AS u FROM {bgraphs}) a JOIN (SELECT id, unnest(range(0, n)) AS v FROM {bgraphs}) b ON a.id = b.id AND a.u < b.v)",
    "reached": "(SELECT count(*) FROM reach WHERE reach.id = thin_graphs.id)",
    "listed_letters": "string_agg(c, '' ORDER BY p)", "random": "CAST('0x' || substr(md5(concat(CAST(s AS VARCHAR), ':', CAST(p AS VARCHAR))), 1, 8) AS BIGINT)",
    "cross": "(SELECT s, unnest(range(1, 2 + s % 40)) AS p FROM (SELECT unnest(range(0, 500)) AS s) y)",
}
