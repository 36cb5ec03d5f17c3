"""SQL for the registered queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

_ONE = "CAST(1 AS DOUBLE)"
_HALF = "CAST(0.5 AS DOUBLE)"


def edges(where: str = "true", name: str = "edges") -> str:
    return f"""{name}_one AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND {where} GROUP BY 1, 2),
{name} AS (SELECT src, dst, w FROM {name}_one UNION ALL SELECT dst, src, w FROM {name}_one)"""


NORMAL = """deg AS (SELECT src AS node, sum(w) AS d FROM edges GROUP BY 1),
normal AS (SELECT e.src, e.dst, e.w / (sqrt(a.d) * sqrt(b.d)) AS w FROM edges e JOIN deg a ON e.src = a.node JOIN deg b ON e.dst = b.node)"""

SEEDS = f"""positive AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node, p_brand AS label FROM part
  WHERE 'p' || CAST(p_partkey AS VARCHAR) IN (SELECT node FROM deg)),
counts AS (SELECT label, count(*) AS n FROM positive GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT node, label, {_ONE} / n AS r FROM positive JOIN counts USING (label))"""

CELLS = """users AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
types AS (SELECT DISTINCT event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
summed AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
counted AS (
  SELECT u.user_id AS gene, t.event_type AS label, CAST(coalesce(s.n, 0) AS DOUBLE) AS n, CAST(coalesce(s.v, 0) AS DOUBLE) AS v
  FROM users u CROSS JOIN types t LEFT JOIN summed s ON s.user_id = u.user_id AND s.event_type = t.event_type),
cells AS (
  SELECT gene, label, n, CASE WHEN n > avg(n) OVER (PARTITION BY label) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y,
    round(v / max(v) OVER (PARTITION BY label), 6) AS p FROM counted),
thresholds AS (SELECT label, round(avg(p), 4) AS t FROM cells GROUP BY 1)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) AS rn,
    sum(y) OVER (PARTITION BY label ORDER BY p DESC, gene ROWS UNBOUNDED PRECEDING) AS tp,
    sum(y) OVER (PARTITION BY label) AS total, count(*) OVER (PARTITION BY label) AS n_all,
    sum(CASE WHEN p >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY label) AS ones, sum(CASE WHEN p <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label) AS zeros
  FROM cells),
hits AS (SELECT label, gene, rn, n_all, total, tp / rn AS pr, tp / total AS re FROM ranked WHERE y = 1 AND ones <= floor(n_all * 0.99) AND zeros <= floor(n_all * 0.99)),
steps AS (SELECT *, lag(pr) OVER (PARTITION BY label ORDER BY rn) AS pr0, lag(re) OVER (PARTITION BY label ORDER BY rn) AS re0 FROM hits),
areas AS (
  SELECT label, CASE WHEN max(total) = 1 THEN max(pr * re) ELSE coalesce(sum((pr + pr0) * (re - re0)) / 2, 0) END AS aupr, max(total) / max(n_all) AS rate
  FROM steps GROUP BY 1)"""

TOP = """top{cut}_r AS (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p DESC, label) AS place, max(p) OVER (PARTITION BY gene) AS best FROM cells),
top{cut}_t AS (SELECT gene, p AS edge FROM top{cut}_r WHERE place = {cut} + 1),
top{cut} AS (
  SELECT c.gene, c.label, c.y, c.p, CAST(CASE WHEN c.p > greatest(CASE WHEN {cut} = 1 AND t.edge = c.best THEN t.edge - 0.000001 ELSE t.edge END, 0) THEN 1 ELSE 0 END AS DOUBLE) AS b
  FROM top{cut}_r c JOIN top{cut}_t t USING (gene))"""


def _walk(alpha: str, steps: int, restart: str = "") -> str:
    """So many unrolled steps of the walk, as CTEs p0.. with a suffix."""
    parts = [f"p{restart}0 AS (SELECT node, label, r AS p FROM r)"]
    for k in range(steps):
        parts.append(
            f"""p{restart}{k + 1} AS (SELECT node, label, sum(p) AS p FROM (
  SELECT e.src AS node, q.label, CAST({alpha} AS DOUBLE) * sum(e.w * q.p) AS p FROM normal e JOIN p{restart}{k} q ON e.dst = q.node GROUP BY 1, 2
  UNION ALL SELECT node, label, (1 - CAST({alpha} AS DOUBLE)) * r FROM r) x GROUP BY 1, 2)"""
        )
    return ",\n".join(parts)


TRANSITIONS = "moves AS (SELECT j AS src, k AS dst, CASE WHEN j_pos > 0 THEN both_ / j_pos ELSE 0 END AS w FROM pairs)"


def _smoothed(source: str, out: str, steps: int) -> str:
    """So many steps of smoothing of source (node, label, p) over `moves` as CTEs; nodes that have settled stay as they are. The last is `out`."""
    parts = [f"""{out}_n AS (SELECT count(DISTINCT label) - 1 AS others FROM {source}),
{out}_0 AS (
  SELECT n.node, l.label, coalesce(s.p, 0) AS start, coalesce(s.p, 0) AS p, true AS open
  FROM (SELECT DISTINCT node FROM {source}) n CROSS JOIN (SELECT DISTINCT label FROM {source}) l LEFT JOIN {source} s ON s.node = n.node AND s.label = l.label)"""]
    for k in range(steps):
        old, new = f"{out}_{k}", f"{out}_{k + 1}"
        parts.append(f"""{new}_g AS (SELECT s.node, m.dst AS label, sum(s.p * m.w) AS gain FROM {old} s JOIN moves m ON s.label = m.src GROUP BY 1, 2),
{new}_s AS (
  SELECT s.node, s.label, s.start, s.open, s.p AS o,
    CASE WHEN s.open THEN CAST(0.7 AS DOUBLE) * s.start + CAST(0.3 AS DOUBLE) / (SELECT others FROM {out}_n) * coalesce(g.gain, 0) ELSE s.p END AS p
  FROM {old} s LEFT JOIN {new}_g g ON g.node = s.node AND g.label = s.label),
{new} AS (SELECT node, label, start, p, open AND coalesce(sum(abs(p - o)) OVER (PARTITION BY node) / nullif(sum(p) OVER (PARTITION BY node), 0) > 0.001, false) AS open FROM {new}_s)""")
    return ",\n".join([*parts, f"{out} AS (SELECT node, label, p FROM {out}_{steps})"])


def _turns(turns: int, steps: int, smoothing: int) -> str:
    """Turns of walking and smoothing, from the seeds r; the last is `turn` and its number."""
    parts = ["r0 AS (SELECT node, label, r FROM r)"]
    for t in range(turns):
        parts.append(f"w{t}_0 AS (SELECT node, label, r AS p FROM r{t})")
        for k in range(steps):
            parts.append(f"""w{t}_{k + 1} AS (SELECT node, label, sum(p) AS p FROM (
  SELECT e.src AS node, q.label, CAST(0.2 AS DOUBLE) * sum(e.w * q.p) AS p FROM normal e JOIN w{t}_{k} q ON e.dst = q.node GROUP BY 1, 2
  UNION ALL SELECT node, label, CAST(0.8 AS DOUBLE) * r FROM r{t}) x GROUP BY 1, 2)""")
        parts.append(_smoothed(f"w{t}_{steps}", f"turn{t}", smoothing))
        parts.append(f"r{t + 1} AS (SELECT node, label, p / sum(p) OVER (PARTITION BY label) AS r FROM turn{t} WHERE p > 0)")
    return ",\n".join(parts)


def _newton(rounds: int) -> str:
    """So many steps of Newton's method for every label's sigmoid 1 / (1 + exp(a p + b)); the last is `fitted`."""
    parts = [
        f"""targets AS (SELECT label, (pos + 1) / (pos + 2) AS hi, 1 / (neg + 2) AS lo, ln((neg + 1) / (pos + 1)) AS b FROM (
  SELECT label, sum(y) AS pos, sum({_ONE} - y) AS neg FROM cells GROUP BY 1) x)""",
        "ab0 AS (SELECT label, CAST(0 AS DOUBLE) AS a, b FROM targets)",
    ]
    for k in range(rounds):
        parts.append(f"""ab{k + 1} AS (
  SELECT label, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
    SELECT label, a, b, sum(p * d) AS ga, sum(d) AS gb, sum(p * p * h) + 1e-12 AS haa, sum(h) + 1e-12 AS hbb, sum(p * h) AS hab FROM (
      SELECT label, a, b, p, t - q AS d, q * (1 - q) AS h FROM (
        SELECT c.label, n.a, n.b, c.p, CASE WHEN c.y = 1 THEN g.hi ELSE g.lo END AS t, 1 / (1 + exp(n.a * c.p + n.b)) AS q
        FROM cells c JOIN ab{k} n USING (label) JOIN targets g USING (label)) x) y GROUP BY 1, 2, 3) z)""")
    return ",\n".join([*parts, f"fitted AS (SELECT * FROM ab{rounds})"])


def _series(power: str, doublings: int) -> str:
    """The sum of all powers of a matrix (src, dst, w), as products of I + M^1, I + M^2, I + M^4, … ; the last is `series`."""
    parts = [f"m0 AS (SELECT src, dst, w FROM {power})", "s0 AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM m0 UNION ALL SELECT DISTINCT src, src, 1 FROM m0) x GROUP BY 1, 2)"]
    for k in range(doublings):
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM m{k} a JOIN m{k} b ON a.dst = b.src GROUP BY 1, 2)")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM s{k} UNION ALL SELECT a.src, b.dst, sum(a.w * b.w) FROM s{k} a JOIN m{k + 1} b ON a.dst = b.src GROUP BY 1, 2) x GROUP BY 1, 2)")
    return ",\n".join([*parts, f"series AS (SELECT * FROM s{doublings})"])


USERS = f"""edges AS (
  SELECT 'u' || CAST(gene AS VARCHAR) AS src, label AS dst, n AS w FROM cells WHERE n > 0
  UNION ALL SELECT label, 'u' || CAST(gene AS VARCHAR), n FROM cells WHERE n > 0),
{NORMAL},
positive AS (SELECT 'u' || CAST(gene AS VARCHAR) AS node, label FROM cells WHERE y = 1 AND 'u' || CAST(gene AS VARCHAR) IN (SELECT node FROM deg)),
r AS (SELECT node, label, {_ONE} / count(*) OVER (PARTITION BY label) AS r FROM positive QUALIFY count(*) OVER (PARTITION BY label) >= 2)"""


def _cells(body: str, *more: str) -> str:
    return f"WITH {', '.join([CELLS, *more])}\n{body}"


def _net(body: str, *more: str) -> str:
    return f"WITH {', '.join([edges(), *more])}\n{body}"


NET_TOPK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rk FROM edges),
least AS (SELECT src, coalesce(max(CASE WHEN rk = 11 THEN w END), 0) AS least FROM ranked GROUP BY 1)"""

RELATION = """totals AS (SELECT label, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1),
pairs AS (
  SELECT a.label AS k, b.label AS j, sum(a.y * b.y) AS both_, max(t.n) AS n, sum(a.y) AS k_pos, sum(b.y) AS j_pos
  FROM cells a JOIN cells b ON a.gene = b.gene AND a.label <> b.label JOIN totals t ON t.label = a.label GROUP BY 1, 2)"""

UNIT = """long AS (SELECT vec_id AS row, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""

SQL = {
    "net_dnorm": _net("SELECT src, dst, round(w, 6) AS w FROM normal", NORMAL),
    "net_edges_symmetric": """WITH one AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, l_quantity AS w,
    l_orderkey * 10 + l_linenumber AS line FROM lineitem),
two AS (SELECT src, dst, w, line FROM one UNION ALL SELECT dst, src, w, line FROM one)
SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY line DESC, w DESC) AS place FROM two) x WHERE place = 1""",
    "net_degree": _net("SELECT src AS node, sum(w) AS degree FROM edges GROUP BY 1"),
    "net_colnorm": _net("SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) AS w FROM edges"),
    "net_transition_topk": _net(
        """SELECT src, dst, round(w / total, 6) AS w FROM (
  SELECT r.src, r.dst, r.w, l.least, sum(CASE WHEN r.w >= l.least THEN r.w END) OVER (PARTITION BY r.src) AS total
  FROM ranked r JOIN least l USING (src)) x WHERE w > least""",
        NET_TOPK,
    ),
    "net_knn_prune": _net(
        """SELECT src, dst, round(sum(w) / 2, 6) AS w FROM (SELECT src, dst, w FROM kept UNION ALL SELECT dst, src, w FROM kept) x GROUP BY 1, 2""",
        NET_TOPK,
        "kept AS (SELECT r.src, r.dst, r.w FROM ranked r JOIN least l USING (src) WHERE r.w > l.least)",
    ),
    "net_row_scale": _net(
        f"""SELECT e.src, e.dst, round(e.w * n.n / (t.total * n.n), 6) AS w FROM edges e
JOIN (SELECT dst AS node, sum(w) AS total FROM edges GROUP BY 1) t ON e.src = t.node, (SELECT {_ONE} * count(DISTINCT src) AS n FROM edges) n"""
    ),
    "net_mean_overlay": f"""WITH {edges('l_quantity > 25', 'own')}, {edges('l_discount > 0.05', 'other')},
mean AS (SELECT src, dst, avg(w) AS w FROM (SELECT * FROM own UNION ALL SELECT * FROM other) x GROUP BY 1, 2)
SELECT coalesce(o.src, m.src) AS src, coalesce(o.dst, m.dst) AS dst, round(coalesce(o.w, m.w), 6) AS w
FROM own o FULL JOIN mean m ON o.src = m.src AND o.dst = m.dst""",
    "seed_availability": _net("SELECT label, count(*) AS n_seed FROM positive GROUP BY 1", NORMAL, SEEDS),
    "rwr_unrolled3": _net("SELECT node, label, round(p, 6) AS p FROM p3", NORMAL, SEEDS, _walk("0.2", 3)),
    "rwr_ratio_unrolled3": _net(
        """SELECT a.node, a.label, round(coalesce(a.p / b.p / max(a.p / b.p) OVER (PARTITION BY a.label), CASE WHEN a.p > 0 THEN 1 ELSE 0 END), 6) AS p
FROM p3 a LEFT JOIN (SELECT * FROM pf3 WHERE p > 0) b ON a.node = b.node AND a.label = b.label""",
        NORMAL, SEEDS, _walk("0.2", 3), _walk("1.0", 3, "f"),
    ),
    "feature_stack": _net(
        """SELECT g.gene, k.net_id, k.label, round(coalesce(s.p, 0), 6) AS x
FROM (SELECT DISTINCT 'p' || CAST(p_partkey AS VARCHAR) AS gene FROM part) g CROSS JOIN (SELECT DISTINCT net_id, label FROM scores) k
LEFT JOIN scores s ON s.node = g.gene AND s.net_id = k.net_id AND s.label = k.label""",
        NORMAL, SEEDS, _walk("0.2", 1), "scores AS (SELECT node, 0 AS net_id, label, p FROM p0 UNION ALL SELECT node, 1, label, p FROM p1)",
    ),
    "prior_seeds": _net(
        f"""SELECT node, label, round(r / max(r) OVER (PARTITION BY label), 6) AS r FROM gained
UNION ALL SELECT node, label, {_ONE} AS r FROM positive""",
        NORMAL,
        SEEDS,
        "near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rk FROM edges)",
        "cut AS (SELECT src, coalesce(max(CASE WHEN rk = 6 THEN w END), 0) AS e FROM near GROUP BY 1)",
        """gained AS (SELECT n.dst AS node, p.label, sum(n.w) AS r FROM near n JOIN cut c USING (src) JOIN positive p ON p.node = n.src
  WHERE n.w > c.e AND NOT EXISTS (SELECT 1 FROM positive q WHERE q.node = n.dst AND q.label = p.label) GROUP BY 1, 2)""",
    ),
    "label_relationship": _cells(
        """SELECT k, j, round(CASE WHEN k_pos > 0 THEN both_ / k_pos ELSE 0 END - j_pos / n, 6) + CAST(0 AS DOUBLE) AS positive,
  round(CASE WHEN n > k_pos THEN (j_pos - both_) / (n - k_pos) ELSE 0 END - j_pos / n, 6) + CAST(0 AS DOUBLE) AS negative,
  round(CASE WHEN j_pos > 0 THEN both_ / j_pos ELSE 0 END, 6) AS transition FROM pairs""",
        RELATION,
    ),
    "label_graph_smooth": _cells(
        "SELECT CAST(node AS BIGINT) AS gene, label, round(p, 6) AS p FROM settled",
        RELATION,
        TRANSITIONS,
        "given AS (SELECT gene AS node, label, p FROM cells)",
        _smoothed("given", "settled", 9),
    ),
    "two_graphs_unrolled": _cells(
        "SELECT node, label, round(p / max(p) OVER (PARTITION BY label), 6) AS p FROM turn1 WHERE p > 0",
        RELATION,
        TRANSITIONS,
        USERS,
        _turns(2, 3, 4),
    ),
    "label_graph_smooth_unrolled": _cells(
        """SELECT gene, label, round(sum(p), 6) AS p FROM (
  SELECT s.gene, t.dst AS label, sum(s.p * t.w) * CAST(0.7 AS DOUBLE) AS p FROM s1 s JOIN trans t ON s.label = t.src GROUP BY 1, 2
  UNION ALL SELECT gene, label, p * CAST(0.3 AS DOUBLE) FROM cells) x GROUP BY 1, 2""",
        RELATION,
        "trans AS (SELECT k AS src, j AS dst, CASE WHEN j_pos > 0 THEN both_ / j_pos ELSE 0 END AS w FROM pairs)",
        """s1 AS (SELECT gene, label, sum(p) AS p FROM (
  SELECT s.gene, t.dst AS label, sum(s.p * t.w) * CAST(0.7 AS DOUBLE) AS p FROM cells s JOIN trans t ON s.label = t.src GROUP BY 1, 2
  UNION ALL SELECT gene, label, p * CAST(0.3 AS DOUBLE) FROM cells) x GROUP BY 1, 2)""",
    ),
    "pearson_rows": f"""WITH {UNIT}, centred AS (SELECT row, pos, v - avg(v) OVER (PARTITION BY row) AS v FROM long),
unit AS (SELECT row, pos, v / sqrt(sum(v * v) OVER (PARTITION BY row)) AS v FROM centred)
SELECT a.row AS row_a, b.row AS row_b, round(sum(a.v * b.v), 6) + CAST(0 AS DOUBLE) AS r FROM unit a JOIN unit b ON a.pos = b.pos AND a.row <= b.row GROUP BY 1, 2""",
    "pearson_columns": f"""WITH {UNIT}
SELECT a.pos AS col_a, b.pos AS col_b, round(corr(a.v, b.v), 6) + CAST(0 AS DOUBLE) AS r FROM long a JOIN long b ON a.row = b.row AND a.pos <= b.pos GROUP BY 1, 2""",
    "ridge_gram": f"""WITH {UNIT}
SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 4) + CAST(0 AS DOUBLE) AS s_ij FROM long a JOIN long b ON a.row = b.row AND a.pos <= b.pos GROUP BY 1, 2""",
    "hassanat_topk": f"""WITH {UNIT}, d AS (
  SELECT a.row, b.row AS other, sum(1 - (1 + least(abs(a.v), abs(b.v))) / (1 + greatest(abs(a.v), abs(b.v)))) AS d
  FROM long a JOIN long b ON a.pos = b.pos AND a.row <> b.row GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, other) AS rank FROM d)
SELECT row, other, round(d, 6) AS d, rank FROM ranked WHERE rank <= 5""",
    "quantile_norm": _cells(
        """SELECT r.gene, r.label, round(CASE WHEN abs(r.s) > 1e-9 THEN q.q ELSE 0 END, 6) AS p FROM ranks r LEFT JOIN scaled q USING (rk)""",
        "ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) AS rk, sum(p) OVER (PARTITION BY label) AS s FROM cells)",
        "profile AS (SELECT rk, sum(p) AS v FROM ranks WHERE abs(s) > 1e-9 GROUP BY 1)",
        "scaled AS (SELECT rk, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS q FROM profile)",
    ),
    "quantile_norm_thresholds": _cells(
        """SELECT gene, label, round(CASE WHEN abs(s) > 1e-9 THEN q ELSE CASE WHEN gene = -1 THEN 1 ELSE 0 END END, 6) AS p FROM ranks LEFT JOIN scaled USING (rk)""",
        """entries AS (SELECT gene, label, p, 0 AS mark FROM cells UNION ALL SELECT -1, label, t, 1 FROM thresholds),
sums AS (SELECT label, sum(p) AS s FROM cells GROUP BY 1),
ranks AS (SELECT e.*, s.s, row_number() OVER (PARTITION BY e.label ORDER BY e.p DESC, e.mark, e.gene) AS rk FROM entries e JOIN sums s USING (label)),
profile AS (SELECT rk, sum(CASE WHEN mark = 0 AND abs(s) > 1e-9 THEN p ELSE 0 END) AS v FROM ranks GROUP BY 1),
scaled AS (SELECT rk, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS q FROM profile)""",
    ),
    "refilled_features": """WITH sums AS (
  SELECT l_linestatus AS status, l_partkey AS gene, l_suppkey AS feature, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND (l_suppkey % 50 <> 7 OR l_linestatus = 'F') AND l_linestatus IN ('F', 'O') GROUP BY 1, 2, 3),
lacking AS (
  SELECT s.status, f.feature FROM (VALUES ('F'), ('O')) s(status), (SELECT DISTINCT feature FROM sums) f
  WHERE NOT EXISTS (SELECT 1 FROM sums x WHERE x.status = s.status AND x.feature = f.feature))
SELECT status, gene, feature, round(x, 6) AS x FROM sums
UNION ALL SELECT g.status, g.gene, l.feature, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT status, gene FROM sums) g JOIN lacking l ON g.status = l.status""",
    "soft_threshold": _cells(
        f"""SELECT gene, label, round(CASE WHEN e >= 1 THEN {_HALF} * (e - 1) / (m - 1) + {_HALF} ELSE {_HALF} * e END, 6) AS p FROM (
  SELECT gene, label, p / t AS e, max(p / t) OVER (PARTITION BY label) AS m FROM cells JOIN thresholds USING (label)) x"""
    ),
    "mask_by_threshold": _cells("SELECT gene, label, CASE WHEN p >= t THEN p ELSE 0 END AS p FROM cells JOIN thresholds USING (label)"),
    "rank_scale": _cells(
        """SELECT gene, label, round(CASE WHEN t0 < 1 AND v >= t0 THEN (v - t0) / (1 - t0) ELSE -1 END, 6) AS p FROM (
  SELECT *, coalesce(min(CASE WHEN p > t THEN v END) OVER (PARTITION BY label), 1) AS t0 FROM (
    SELECT c.gene, c.label, c.p, h.t, CAST(count(*) OVER (PARTITION BY label) - row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) + 1 AS DOUBLE)
      / count(*) OVER (PARTITION BY label) AS v FROM cells c JOIN thresholds h USING (label)) x) y"""
    ),
    "zscore_minmax": _cells(
        """SELECT gene, label, round((z - min(z) OVER (PARTITION BY label)) / (max(z) OVER (PARTITION BY label) - min(z) OVER (PARTITION BY label)), 6) AS p
FROM (SELECT gene, label, (p - avg(p) OVER (PARTITION BY label)) / stddev_samp(p) OVER (PARTITION BY label) AS z FROM cells) x"""
    ),
    "row_max_scale": _cells("SELECT gene, label, round(CASE WHEN max(p) OVER (PARTITION BY gene) > 0 THEN p / max(p) OVER (PARTITION BY gene) ELSE p END, 6) AS p FROM cells"),
    "column_scale": _cells(
        """SELECT gene, label, round(CASE WHEN held > 0 THEN p / held ELSE p END, 6) AS p FROM (
  SELECT *, max(CASE WHEN rk = floor(2 * rate * n_all) THEN p END) OVER (PARTITION BY label) AS held FROM (
    SELECT *, avg(y) OVER (PARTITION BY label) AS rate, count(*) OVER (PARTITION BY label) AS n_all,
      row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) - 1 AS rk FROM cells) x) z"""
    ),
    "platt_scale_fixed_ab": _cells(
        """SELECT gene, label, round((s - min(s) OVER (PARTITION BY label)) / (max(s) OVER (PARTITION BY label) - min(s) OVER (PARTITION BY label)), 6) AS p
FROM (SELECT gene, label, 1 / (1 + exp(CAST(-2 AS DOUBLE) * p + CAST(0.5 AS DOUBLE))) AS s FROM cells) x"""
    ),
    "aupr_per_label": _cells("SELECT t.label, round(coalesce(a.aupr, 0), 6) AS aupr FROM (SELECT DISTINCT label FROM cells) t LEFT JOIN areas a USING (label)", RANKED),
    "aupr_micro": _cells(
        """SELECT round(coalesce(sum((pr + pr0) * (re - re0)) / 2, 0), 6) AS micro_aupr FROM (
  SELECT pr, re, lag(pr) OVER (ORDER BY rn) AS pr0, lag(re) OVER (ORDER BY rn) AS re0 FROM (SELECT rn, tp / rn AS pr, tp / total AS re FROM flat WHERE y = 1) h) s""",
        """flat AS (SELECT y, row_number() OVER (ORDER BY p DESC, gene, label) AS rn, sum(y) OVER (ORDER BY p DESC, gene, label ROWS UNBOUNDED PRECEDING) AS tp,
  sum(y) OVER () AS total FROM cells)""",
    ),
    "aupr_cost": _cells(
        """SELECT round(sum((pr + pr0) * (re - re0)) / 2, 6) AS cost_aupr FROM (
  SELECT pr, re, lag(pr) OVER (ORDER BY rn) AS pr0, lag(re) OVER (ORDER BY rn) AS re0 FROM (SELECT rn, tp / w AS pr, tp / total AS re FROM flat WHERE y = 1) h) s""",
        """costed AS (SELECT *, CASE WHEN y = 1 THEN (count(*) OVER (PARTITION BY label) - sum(y) OVER (PARTITION BY label)) / sum(y) OVER (PARTITION BY label)
  ELSE CAST(1 AS DOUBLE) END AS cost FROM cells)""",
        """flat AS (SELECT y, row_number() OVER (ORDER BY p DESC, gene, label) AS rn, sum(cost) OVER (ORDER BY p DESC, gene, label ROWS UNBOUNDED PRECEDING) AS w,
  sum(y * cost) OVER (ORDER BY p DESC, gene, label ROWS UNBOUNDED PRECEDING) AS tp, sum(y * cost) OVER () AS total FROM costed)""",
    ),
    "ag_fscore_threshold": _cells(
        """SELECT t.label, round(coalesce(b.ag, 0), 6) AS score, CASE WHEN b.ag > 0 AND a.aupr >= a.rate THEN b.p ELSE 1 END AS threshold
FROM (SELECT DISTINCT label FROM cells) t LEFT JOIN areas a USING (label)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ag DESC, rn) AS best FROM ag WHERE first_hit - 1 <= total) b ON b.label = t.label AND b.best = 1""",
        RANKED,
        """ag AS (SELECT label, p, rn, total, min(CASE WHEN y = 1 THEN rn END) OVER (PARTITION BY label) AS first_hit,
  sqrt(coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY label ORDER BY rn ROWS UNBOUNDED PRECEDING), 0)
    * coalesce(last_value(i IGNORE NULLS) OVER (PARTITION BY label ORDER BY rn ROWS UNBOUNDED PRECEDING), 0)) AS ag
  FROM (SELECT *, CASE WHEN y = 1 THEN 2 * (tp / rn) * (tp / total) / (tp / rn + tp / total) END AS f,
    CASE WHEN y = 0 AND rn < n_all THEN CASE WHEN n_all - total - (rn - tp) > 0 THEN
      2 * ((n_all - total - (rn - tp)) / (n_all - rn)) * ((n_all - total - (rn - tp)) / (n_all - total))
      / ((n_all - total - (rn - tp)) / (n_all - rn) + (n_all - total - (rn - tp)) / (n_all - total)) ELSE 0 END END AS i FROM ranked) x)""",
    ),
    "platt_fit": _cells(
        """SELECT gene, label, y, round(CASE WHEN high > low THEN (s - low) / (high - low) ELSE s END, 6) AS p FROM (
  SELECT *, min(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY label) AS low, max(s) OVER (PARTITION BY label) AS high FROM (
    SELECT c.gene, c.label, c.y, 1 / (1 + exp(f.a * c.p + f.b)) AS s FROM cells c JOIN fitted f USING (label)) x) y""",
        _newton(12),
    ),
    "closed_form_walk": f"""WITH {edges()},
one AS (SELECT * FROM edges WHERE src LIKE 's%'),
shared AS (SELECT a.src, b.src AS dst, sum(least(a.w, b.w)) AS w FROM one a JOIN one b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2),
degree AS (SELECT src AS node, sum(w) AS d FROM shared GROUP BY 1),
moved AS (SELECT e.src, e.dst, CAST(0.8 AS DOUBLE) * e.w / (sqrt(a.d) * sqrt(b.d)) AS w FROM shared e JOIN degree a ON e.src = a.node JOIN degree b ON e.dst = b.node),
{_series("moved", 7)}
SELECT src, dst, round(w * CAST(0.2 AS DOUBLE), 6) AS w FROM series""",
    "mlsmote_counts": """WITH classes AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1),
mean AS (SELECT avg(n) AS mean FROM classes)
SELECT CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS first_label, CAST(CASE WHEN n > 1 AND n < mean THEN floor(1 + mean - n) ELSE 0 END AS BIGINT) AS made FROM classes, mean""",
    "beta_for_precision": _cells(
        """SELECT label, round(CASE WHEN best < CAST(0.8 AS DOUBLE) THEN CASE WHEN best > 0 THEN top ELSE 0 END ELSE coalesce(enough, 0) END, 6) AS log_beta, round(best, 6) AS precision FROM (
  SELECT label, max(precision) AS best, max(CASE WHEN precision > CAST(0.8 AS DOUBLE) AND log_beta > 0 THEN log_beta END) AS enough,
    arg_min(log_beta, (-precision, log_beta)) AS top FROM tried GROUP BY 1) x""",
        RANKED,
        "betas AS (SELECT round(CAST(k AS DOUBLE) / 10 - 2, 1) AS log_beta FROM range(41) t(k))",
        """sided AS (SELECT label, p, rn, total, tp / rn AS pr, min(CASE WHEN y = 1 THEN rn END) OVER (PARTITION BY label) AS first_hit, ones, zeros, n_all,
    last_value(hp IGNORE NULLS) OVER w AS hp, last_value(hr IGNORE NULLS) OVER w AS hr, last_value(mp IGNORE NULLS) OVER w AS mp, last_value(mr IGNORE NULLS) OVER w AS mr
  FROM (SELECT *, CASE WHEN y = 1 THEN tp / rn END AS hp, CASE WHEN y = 1 THEN tp / total END AS hr,
      CASE WHEN y = 0 AND rn < n_all THEN (n_all - total - (rn - tp)) / (n_all - rn) END AS mp,
      CASE WHEN y = 0 AND rn < n_all THEN (n_all - total - (rn - tp)) / (n_all - total) END AS mr FROM ranked) x
  WINDOW w AS (PARTITION BY label ORDER BY rn ROWS UNBOUNDED PRECEDING))""",
        """measured AS (SELECT label, log_beta, rn, pr, first_hit - 1 > total OR first_hit IS NULL OR ones > floor(n_all * 0.99) OR zeros > floor(n_all * 0.99) AS lost,
    sqrt(CASE WHEN hp > 0 THEN (1 + pow(10, log_beta) * pow(10, log_beta)) * hp * hr / (pow(10, log_beta) * pow(10, log_beta) * hp + hr) ELSE 0 END
      * CASE WHEN mp > 0 THEN (1 + pow(10, -log_beta) * pow(10, -log_beta)) * mp * mr / (pow(10, -log_beta) * pow(10, -log_beta) * mp + mr) ELSE 0 END) AS ag FROM sided, betas)""",
        "tried AS (SELECT label, log_beta, CASE WHEN lost OR ag <= 0 THEN 0 ELSE pr END AS precision FROM (SELECT *, row_number() OVER (PARTITION BY label, log_beta ORDER BY ag DESC, rn) AS k FROM measured) x WHERE k = 1)",
    ),
    "bin_topk": _cells("SELECT gene, label, b FROM top3", TOP.format(cut=3)),
    "confusion_per_label": _cells(
        """SELECT label, tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1 FROM (
  SELECT label, CAST(sum(CASE WHEN y > 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y <= 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y > 0 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN y <= 0 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM cells GROUP BY 1) x"""
    ),
    "micro_f1": _cells(
        """SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(sqrt((2 * tp / (2 * tp + fp + fn)) * (2 * tn / (2 * tn + fn + fp))), 6) AS ag_micro_f1 FROM (
  SELECT sum(y * b) AS tp, sum((1 - y) * b) AS fp, sum(y * (1 - b)) AS fn, sum((1 - y) * (1 - b)) AS tn FROM top3) x""",
        TOP.format(cut=3),
    ),
    "accuracy_top1": _cells("SELECT round(least(1, sum(b * y) / count(DISTINCT CASE WHEN y = 1 THEN gene END)), 6) AS accuracy FROM top1", TOP.format(cut=1)),
    "topk_precision": _cells("SELECT label, round(sum(y) / count(*), 6) AS precision FROM ranked WHERE rn <= 10 GROUP BY 1", RANKED),
    "cross_entropy": _cells(
        "SELECT round(-sum(y * ln(q) + (1 - y) * ln(1 - q)), 4) AS cross_entropy FROM (SELECT y, greatest(least(p, 0.99999999::DOUBLE), 1e-8) AS q FROM cells) x"
    ),
    "cost_loss": _cells(
        """SELECT round(sum(CASE WHEN pos > 0 THEN missed * (n - pos) / pos ELSE 0 END + wrong), 6) AS cost_loss FROM (
  SELECT label, sum(y) AS pos, count(*) AS n, sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS missed,
    sum(CASE WHEN y = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS wrong FROM cells GROUP BY 1) x"""
    ),
    "mean_squared_error": _cells("SELECT label, round(avg(CASE WHEN p >= 1 THEN 0 ELSE (y - p) * (y - p) END), 6) AS mse FROM cells GROUP BY 1"),
    "label_rarity": _cells(
        f"""SELECT label, n, round(max(n) OVER () * {_ONE} / (n + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY label) > 1 THEN 1 ELSE 0 END), 6) AS rarity
FROM (SELECT label, count(*) AS n FROM cells WHERE y = 1 GROUP BY 1) x"""
    ),
    "label_pair_counts": _cells(
        "SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM cells a JOIN cells b ON a.gene = b.gene AND a.label < b.label WHERE a.y = 1 AND b.y = 1 GROUP BY 1, 2"
    ),
    "positive_labels": _cells("SELECT gene, label, y FROM cells WHERE label IN (SELECT label FROM cells WHERE y = 1)"),
    "fold_modulo": _cells("SELECT DISTINCT gene, CAST(gene % 5 AS BIGINT) AS fold FROM cells"),
    "nan_filter": "SELECT event_id, CASE WHEN value IS NULL OR isnan(value / nullif(value - 5, 0)) THEN 0 ELSE coalesce(round(value / nullif(value - 5, 0), 6), 0) END AS x FROM events",
}

_AREA_OF_ALL, _COSTS, _COUNTS = SQL["aupr_micro"], SQL["aupr_cost"], SQL["micro_f1"]

SQL |= {
    "report": f"""SELECT a.accuracy, f.micro_f1, f.ag_micro_f1, m.micro_aupr, x.macro_aupr, round(sqrt(e.micro_aupr * g.ag_micro_f1), 6) AS objective
FROM ({SQL["accuracy_top1"]}) a, ({_COUNTS}) f, ({_AREA_OF_ALL}) m, (SELECT round(avg(aupr), 6) AS macro_aupr FROM ({SQL["aupr_per_label"].replace("round(coalesce(a.aupr, 0), 6)", "coalesce(a.aupr, 0)")}) y) x,
  ({_AREA_OF_ALL.replace("round(coalesce(sum((pr + pr0) * (re - re0)) / 2, 0), 6)", "coalesce(sum((pr + pr0) * (re - re0)) / 2, 0)")}) e,
  ({_COUNTS.replace("round(sqrt((2 * tp / (2 * tp + fp + fn)) * (2 * tn / (2 * tn + fn + fp))), 6)", "sqrt((2 * tp / (2 * tp + fp + fn)) * (2 * tn / (2 * tn + fn + fp)))")}) g""",
    "objectives": f"""SELECT CAST(1 AS BIGINT) AS index, round(sqrt(m.micro_aupr * f.ag_micro_f1), 4) AS objective
FROM ({_AREA_OF_ALL.replace("round(coalesce(sum((pr + pr0) * (re - re0)) / 2, 0), 6)", "coalesce(sum((pr + pr0) * (re - re0)) / 2, 0)")}) m,
  ({_COUNTS.replace("round(sqrt((2 * tp / (2 * tp + fp + fn)) * (2 * tn / (2 * tn + fn + fp))), 6)", "sqrt((2 * tp / (2 * tp + fp + fn)) * (2 * tn / (2 * tn + fn + fp)))")}) f
UNION ALL SELECT 2, round(micro_aupr, 4) FROM ({_AREA_OF_ALL}) x
UNION ALL SELECT 3, round(ag_micro_f1, 4) FROM ({_COUNTS}) x
UNION ALL SELECT 4, round(cost_aupr, 4) FROM ({_COSTS}) x
UNION ALL SELECT 5, -cross_entropy FROM ({SQL["cross_entropy"]}) x
UNION ALL SELECT 6, round(-cost_loss, 4) FROM ({SQL["cost_loss"]}) x""",
    "rwr_converged": _net("SELECT node, label, round(p, 6) AS p FROM p12", NORMAL, SEEDS, _walk("0.2", 12)),
    "f1_with_threshold": _cells(
        """SELECT label, tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1 FROM (
  SELECT label, CAST(sum(CASE WHEN y > 0 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y <= 0 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y > 0 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN y <= 0 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM cells JOIN thresholds USING (label) GROUP BY 1) x"""
    ),
    "accuracy_with_threshold": f"WITH {CELLS.replace('cells AS (', 'plain AS (', 1).replace('FROM cells GROUP BY 1)', 'FROM plain GROUP BY 1)')}, cells AS (SELECT c.gene, c.label, c.n, c.y, CASE WHEN c.p >= h.t THEN c.p ELSE 0 END AS p FROM plain c JOIN thresholds h USING (label)), {TOP.format(cut=1)}"
    + " SELECT round(least(1, sum(b * y) / count(DISTINCT CASE WHEN y = 1 THEN gene END)), 6) AS accuracy FROM top1",
    "consistent_features": """WITH sums AS (
  SELECT l_linestatus, l_partkey AS gene, l_suppkey AS feature, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey % 7 <> 0 OR l_linestatus = 'F' GROUP BY 1, 2, 3)
SELECT l_linestatus, gene, feature, round(x, 6) AS x FROM sums
WHERE feature IN (SELECT feature FROM sums GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2)""",
    "feature_range_scale": _cells(
        """SELECT gene, label AS feature, round(CASE WHEN n >= low THEN (n - low) / CASE WHEN high > low THEN high - low ELSE 1 END ELSE n END, 6) AS x FROM (
  SELECT gene, label, n, least(coalesce(min(CASE WHEN n > 0 THEN n END) OVER (PARTITION BY label), 1), 1) AS low, max(n) OVER (PARTITION BY label) AS high FROM cells) x"""
    ),
    "chop_scale": _cells(
        """SELECT gene, label, round(CASE WHEN high > low THEN least((p - low) / (high - low), 1) ELSE p END, 6) AS p FROM (
  SELECT gene, label, p, min(p) OVER (PARTITION BY label) AS low, max(CASE WHEN y = 1 THEN least(p, 1) END) OVER (PARTITION BY label) AS high FROM cells) x"""
    ),
    "chop_scale_unseen": _cells(
        """SELECT gene, label, round(CASE WHEN p >= high THEN 1 WHEN high > low THEN (p - low) / (high - low) ELSE p END, 6) AS p FROM (
  SELECT c.gene, c.label, c.p, min(CASE WHEN c.p > 0 THEN c.p END) OVER (PARTITION BY c.label) AS low, least(b.high, max(c.p) OVER (PARTITION BY c.label)) AS high
  FROM cells c JOIN (SELECT label, max(CASE WHEN y = 1 THEN least(p, 1) END) AS high FROM cells WHERE p < 0.5 GROUP BY 1) b USING (label)) x"""
    ),
    "knn_recalibrate": _cells(
        """SELECT c.gene, c.label, c.y, round(greatest(0, coalesce(h.w, 1) * c.p + (1 - coalesce(h.w, 1)) * coalesce(s.said, 0) / greatest((SELECT count(*) - 1 FROM best), 1)), 6) AS p
FROM cells c LEFT JOIN hit h ON h.gene = c.gene AND h.label = c.label LEFT JOIN said s ON s.gene = c.gene AND s.label = c.label""",
        RANKED,
        RELATION,
        """relation AS (
  SELECT k, j, CASE WHEN k_pos > 0 THEN both_ / k_pos ELSE 0 END - j_pos / n AS positive, CASE WHEN n > k_pos THEN (j_pos - both_) / (n - k_pos) ELSE 0 END - j_pos / n AS negative
  FROM pairs)""",
        """vectors AS (SELECT gene, list(p ORDER BY label) AS x FROM cells GROUP BY 1)""",
        """distances AS (
  SELECT a.gene, b.gene AS other, list_sum(list_transform(list_zip(a.x, b.x), lambda v: 1 - (1 + least(v[1], v[2])) / (1 + greatest(v[1], v[2])))) AS d
  FROM vectors a JOIN vectors b ON a.gene <> b.gene)""",
        """near AS (SELECT gene, other FROM distances QUALIFY row_number() OVER (PARTITION BY gene ORDER BY d, other) <= 5)""",
        """hit AS (
  SELECT n.gene, c.label, avg(CASE WHEN (c.p > 0.5) = (c.y = 1) THEN 1 ELSE 0 END) AS w FROM near n JOIN cells c ON c.gene = n.other GROUP BY 1, 2)""",
        """best AS (
  SELECT k FROM (SELECT t.label AS k, row_number() OVER (ORDER BY coalesce(a.aupr, 0) DESC, t.label) AS place, count(*) OVER () AS size
    FROM (SELECT DISTINCT label FROM cells) t LEFT JOIN areas a USING (label)) x WHERE place <= floor(size * 0.5) + 1)""",
        """said AS (
  SELECT c.gene, r.j AS label, sum(c.p * r.positive + (1 - c.p) * r.negative) AS said
  FROM cells c JOIN best b ON b.k = c.label JOIN relation r ON r.k = c.label GROUP BY 1, 2)""",
    ),
    "over_threshold": _cells("SELECT gene, label, round(p / nullif(t, 0), 6) AS p FROM cells JOIN thresholds USING (label)"),
    "column_max_scale": _cells("SELECT gene, label, round(CASE WHEN max(p) OVER (PARTITION BY label) > 0 THEN p / max(p) OVER (PARTITION BY label) ELSE p END, 6) AS p FROM cells"),
    "labels_by_ratio": _cells(
        """SELECT label, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY ratio ASC NULLS LAST, label) AS place FROM (
  SELECT label, sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) / nullif(sum(y), 0) AS ratio FROM cells GROUP BY 1) x"""
    ),
    "pseudo_labels": _cells(
        """SELECT gene, label, CAST(CASE WHEN p >= edge THEN 1 ELSE 0 END AS DOUBLE) AS y FROM (
  SELECT *, max(CASE WHEN rk = n_pos THEN p END) OVER (PARTITION BY label) AS edge FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) AS rk, sum(y) OVER (PARTITION BY label) AS n_pos FROM cells) r) x"""
    ),
    "trim_scores": _cells(
        f"""SELECT gene, label, CASE WHEN max(y) OVER (PARTITION BY label) = 0 AND row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) = 1 THEN {_ONE} ELSE y END AS y, p
FROM (SELECT *, max(CASE WHEN rk = floor(n_all * {_ONE} * 0.1::DOUBLE) THEN p END) OVER (PARTITION BY label) AS edge FROM (
    SELECT gene, label, y, p, row_number() OVER (PARTITION BY label ORDER BY p DESC, gene) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n_all FROM cells) r) x
WHERE edge <= 0 OR p <= edge"""
    ),
}
