"""SQL for the registered queries, written for DuckDB."""

from __future__ import annotations

DAILY = """
ev AS (SELECT user_id AS id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, coalesce(sum(value), 0.0) AS v FROM events GROUP BY 1, 2),
bound AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
obs AS (SELECT g.id, CAST(g.t - g.lo AS INT) AS t, coalesce(ev.v, 0.0) AS v FROM (SELECT id, lo, unnest(range(lo, hi + 1)) AS t FROM (SELECT DISTINCT id FROM ev), bound) g LEFT JOIN ev ON ev.id = g.id AND ev.t = g.t)"""
NATION = """
ev AS (SELECT c_nationkey AS id, year(o_orderdate) * 12 + month(o_orderdate) AS t, CAST(sum(o_totalprice) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
bound AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
obs AS (SELECT g.id, CAST(g.t - g.lo AS INT) AS t, coalesce(ev.v, 0.0) AS v FROM (SELECT id, lo, unnest(range(lo, hi + 1)) AS t FROM (SELECT DISTINCT id FROM ev), bound) g LEFT JOIN ev ON ev.id = g.id AND ev.t = g.t)"""
Z = """,
z AS (SELECT id, t, CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0.0 END AS v FROM obs WINDOW w AS (PARTITION BY id)),
s AS (SELECT id, list(v ORDER BY t) AS x FROM z GROUP BY id)"""
LOWER = "SELECT a.id AS i, b.id AS j, a.x AS x, b.x AS y FROM s a JOIN s b ON a.id > b.id"
LOWER_SELF = LOWER.replace("a.id > b.id", "a.id >= b.id")


def dynamic(with_: str, pairs: str, cost: str, first: str, cell: str, allowed: str = "TRUE", outside: str = "'inf'::DOUBLE") -> str:
    """Row-major recursion over the cells of each pair: p is the row above, q the current one, a and b 0-based positions, c the local cost."""
    return f"""WITH RECURSIVE {with_}, pairs AS ({pairs}),
run AS (
  SELECT i, j, x, y, 0 AS k, []::DOUBLE[] AS p, []::DOUBLE[] AS q FROM pairs
  UNION ALL
  SELECT i, j, x, y, k + 1, p, list_append(q, CASE WHEN NOT ({allowed}) THEN {outside} WHEN k = 0 THEN {first} ELSE {cell} END) FROM (
    SELECT *, {cost} AS c, CASE WHEN a > 0 AND b > 0 THEN p[b] ELSE {outside} END AS diag, CASE WHEN b > 0 THEN q[b] ELSE {outside} END AS lft, CASE WHEN a > 0 THEN p[b + 1] ELSE {outside} END AS up FROM (
      SELECT i, j, x, y, k, k // len(y) AS a, k % len(y) AS b, CASE WHEN k % len(y) = 0 THEN q ELSE p END AS p, CASE WHEN k % len(y) = 0 THEN []::DOUBLE[] ELSE q END AS q FROM run WHERE k < len(x) * len(y)
    )
  )
), done AS (SELECT i, j, x, y, q[len(y)] AS d FROM run WHERE k = len(x) * len(y))
"""


ABS, SQUARE = "abs(x[a + 1] - y[b + 1])", "(x[a + 1] - y[b + 1]) ** 2"


def dtw(with_: str, pairs: str = LOWER, norm: str = "L1", step: int = 2, window: int | None = None) -> str:
    band = "TRUE" if window is None else f"(b + 1) >= ceil((a + 1) * len(y) / len(x) - {window}) AND (b + 1) <= floor((a + 1) * len(y) / len(x) + {window})"
    return dynamic(with_, pairs, ABS if norm == "L1" else SQUARE, "c", f"least(diag + {step} * c, lft + c, up + c)", band)


def asymmetric(with_: str, pairs: str, cost: str, anywhere: str = "FALSE") -> str:
    """Row by row: q is the row of x[a + 1]; a cell follows the cell above, its left neighbour or the one before that."""
    inf, at = "'inf'::DOUBLE", lambda k: f"CASE WHEN b >= {k} THEN q[b + 1 - {k}] ELSE 'inf'::DOUBLE END"
    cells = lambda cell: f"[{cell} FOR b IN range(0, len(y))]"
    first = cells(f"CASE WHEN b = 0 OR {anywhere} THEN {cost.replace('a + 1', '1')} ELSE {inf} END")
    return f"""WITH RECURSIVE {with_}, pairs AS ({pairs}),
run AS (
  SELECT i, j, x, y, 1 AS a, {first} AS q FROM pairs
  UNION ALL
  SELECT i, j, x, y, a + 1, {cells(f"least(q[b + 1], {at(1)}, {at(2)}) + {cost}")} FROM run WHERE a < len(x)
), done AS (SELECT i, j, x, y, q FROM run WHERE a = len(x))
"""


def paths(with_: str, pairs: str, cost: str = ABS, step: int = 2, window: int | None = None) -> str:
    """path (i, j, step, a, b): m is the matrix of a pair so far, row by row; the way back prefers the diagonal, then the same row."""
    inf = "'inf'::DOUBLE"
    band = "TRUE" if window is None else f"(b + 1) >= ceil((a + 1) * len(y) / len(x) - {window}) AND (b + 1) <= floor((a + 1) * len(y) / len(x) + {window})"
    ways = f"{cost} AS c, CASE WHEN a > 0 AND b > 0 THEN m[k - len(y)] ELSE {inf} END AS diag, CASE WHEN b > 0 THEN m[k] ELSE {inf} END AS lft, CASE WHEN a > 0 THEN m[k + 1 - len(y)] ELSE {inf} END AS up"
    return f"""WITH RECURSIVE {with_}, pairs AS ({pairs}),
run AS (
  SELECT i, j, x, y, 0 AS k, []::DOUBLE[] AS m FROM pairs
  UNION ALL
  SELECT i, j, x, y, k + 1, list_append(m, CASE WHEN NOT ({band}) THEN {inf} WHEN k = 0 THEN c ELSE least(diag + {step} * c, lft + c, up + c) END)
  FROM (SELECT *, {ways} FROM (SELECT *, k // len(y) AS a, k % len(y) AS b FROM run WHERE k < len(x) * len(y)))
), done AS (SELECT i, j, x, y, m FROM run WHERE k = len(x) * len(y)
), back AS (
  SELECT i, j, 0 AS n, len(x) - 1 AS a, len(y) - 1 AS b FROM done
  UNION ALL
  SELECT i, j, n + 1, CASE WHEN diag + {step} * c <= least(lft + c, up + c) OR lft > up THEN a - 1 ELSE a END, CASE WHEN diag + {step} * c <= least(lft + c, up + c) OR lft <= up THEN b - 1 ELSE b END
  FROM (SELECT i, j, n, a, b, {ways} FROM (SELECT i, j, n, a, b, a * len(y) + b AS k, x, y, m FROM back JOIN done USING (i, j) WHERE a > 0 OR b > 0))
), path AS (SELECT i, j, CAST(row_number() OVER (PARTITION BY i, j ORDER BY n DESC) - 1 AS INT) AS step, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM back)
"""


P1 = [(1, 2, [(0, 1, 2), (0, 0, 1)]), (1, 1, [(0, 0, 2)]), (2, 1, [(1, 0, 2), (0, 0, 1)])]
IIIC = [(1, 2, [(0, 0, 1)]), (1, 1, [(0, 0, 1)]), (2, 1, [(1, 0, 1), (0, 0, 1)]), (2, 2, [(1, 0, 1), (0, 0, 1)])]


def sloped(with_: str, pairs: str, ways: list = P1, cost: str = SQUARE) -> str:
    """Ways into a cell from one or two points of x before: q is the row of x[a], p the one before; costs passed on a way by how far back they lie."""
    inf, at = "'inf'::DOUBLE", lambda u, v: cost.replace("a + 1", f"a + 1 - {u}").replace("b + 1", f"b + 1 - {v}")
    ways = [f"CASE WHEN a >= {u} AND b >= {v} THEN {'qp'[u - 1]}[b + 1 - {v}] + {' + '.join(f'{w} * {at(s, t)}' for s, t, w in terms)} ELSE {inf} END" for u, v, terms in ways]
    return f"""WITH RECURSIVE {with_}, pairs AS ({pairs}),
run AS (
  SELECT i, j, x, y, 1 AS a, []::DOUBLE[] AS p, [CASE WHEN b = 0 THEN {cost.replace("a + 1", "1")} ELSE {inf} END FOR b IN range(0, len(y))] AS q FROM pairs
  UNION ALL
  SELECT i, j, x, y, a + 1, q, [least({", ".join(ways)}) FOR b IN range(0, len(y))] FROM run WHERE a < len(x)
), done AS (SELECT i, j, x, y, q FROM run WHERE a = len(x))
"""


MULTI = """
tp AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS var FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, event_type, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2, 3),
bound AS (SELECT min(day) AS lo, max(day) AS hi FROM ev),
mv AS (SELECT g.id, CAST(g.t AS INT) AS t, tp.var, coalesce(ev.v, 0.0) AS v FROM (SELECT id, lo, unnest(range(0, date_diff('day', lo, hi) + 1)) AS t FROM (SELECT DISTINCT id FROM ev), bound) g CROSS JOIN tp LEFT JOIN ev ON ev.id = g.id AND ev.event_type = tp.event_type AND date_diff('day', g.lo, ev.day) = g.t)"""
ACF = """
cen AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS v FROM obs), pw AS (SELECT id, sum(v * v) AS q FROM cen GROUP BY 1),
ac AS (SELECT a.id, CAST(k AS INT) AS t, CASE WHEN q > 0 THEN sum(a.v * b.v) / q WHEN k = 0 THEN 1.0 ELSE 0.0 END AS v FROM cen a JOIN (SELECT unnest(range(11)) AS k) ON TRUE JOIN cen b ON b.id = a.id AND b.t = a.t + k JOIN pw ON pw.id = a.id GROUP BY a.id, k, q)"""


EMB = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS t FROM e),
m AS (SELECT label AS c, t, avg(v) AS v FROM l GROUP BY 1, 2),
dc AS (SELECT id, c, sqrt(sum((l.v - m.v) ** 2)) AS d FROM l JOIN m USING (t) GROUP BY 1, 2),
lab AS (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM dc GROUP BY 1),
u AS (SELECT id, c, d, CASE WHEN bool_or(d = 0) OVER w THEN (d = 0)::INT / sum((d = 0)::INT) OVER w ELSE (1 / d ** 2) / sum(1 / d ** 2) OVER w END AS u FROM dc WINDOW w AS (PARTITION BY id))"""
DM = "dm AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.id <> b.id)"
BETWEEN = "bt AS (SELECT a.c AS i, b.c AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM m a JOIN m b ON a.t = b.t AND a.c <> b.c GROUP BY 1, 2)"
GLOBAL = "gm AS (SELECT t, avg(v) AS v FROM l GROUP BY 1), gc AS (SELECT c, sqrt(sum((m.v - gm.v) ** 2)) AS g FROM m JOIN gm USING (t) GROUP BY 1), gs AS (SELECT id, sqrt(sum((l.v - gm.v) ** 2)) AS g FROM l JOIN gm USING (t) GROUP BY 1)"
FLAGS = f"""WITH {DAILY}, sums AS (SELECT id, w, sum(v) FILTER (t < w) AS v FROM obs, (SELECT unnest([3, 5, 8, 12]) AS w) GROUP BY 1, 2),
labels AS (SELECT id, w, ((CAST(floor(round(v, 2) / 50) AS BIGINT) % 3) + 3) % 3 AS c FROM sums),
ids AS (SELECT DISTINCT id FROM obs), links AS (SELECT id AS i, id + 10 AS j, 1 AS type FROM ids UNION ALL SELECT id, id + 1, 0 FROM ids),
flags AS (SELECT i, j, type, a.w, (a.c = b.c) = (type = 1) AS ok FROM links JOIN labels a ON a.id = i JOIN labels b ON b.id = j AND a.w = b.w),
steps AS (SELECT *, coalesce((ok <> lag(ok) OVER o)::INT, 0) AS ch FROM flags WINDOW o AS (PARTITION BY i, j, type ORDER BY w)),
islands AS (SELECT *, sum(ch) OVER (PARTITION BY i, j, type ORDER BY w) AS g FROM steps),
runs AS (SELECT i, j, type, g, sum(ch) AS ch, count(*) FILTER (ok) AS run, count(*) AS n, min(w) FILTER (ok) AS first FROM islands GROUP BY ALL),
comp AS (SELECT i, j, type, CASE WHEN sum(n) <= 1 THEN 0.0 WHEN max(run) = 0 THEN 'inf'::DOUBLE ELSE sum(ch) / (sum(n) - 1) / max(run) END AS complexity, CAST(min(first) AS INT) AS first_ok FROM runs GROUP BY 1, 2, 3)"""
CELLS = "cells AS (SELECT a, b, count(*) AS n FROM {rows} GROUP BY 1, 2), ca AS (SELECT sum(n) AS n FROM cells GROUP BY a), cb AS (SELECT sum(n) AS n FROM cells GROUP BY b)"
COUNTS = """pc AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM cells) AS bth, (SELECT sum(n * (n - 1) / 2.0) FROM ca) AS pa, (SELECT sum(n * (n - 1) / 2.0) FROM cb) AS pb, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM cells) AS total, (SELECT sum(n) FROM cells) AS n)"""
PAIR_INDICES = "(total + 2 * bth - pa - pb) / total AS \"RI\", (bth - pa * pb / total) / ((pa + pb) / 2 - pa * pb / total) AS \"ARI\", bth / (pa + pb - bth) AS \"J\", bth / sqrt(pa * pb) AS \"FM\""


def _matrix(power: int) -> str:
    d = "sum(abs(a.v - b.v))" if power == 1 else "sqrt(sum((a.v - b.v) ** 2))"
    return f"WITH {DAILY} SELECT a.id AS i, b.id AS j, round({d}, 6) AS d FROM obs a JOIN obs b ON a.t = b.t AND a.id > b.id GROUP BY 1, 2"


def _external_of(rows: str) -> str:
    return f"{CELLS.format(rows=rows)}, {COUNTS}"


ORACLES = {
    "series_daily": f"WITH {DAILY} SELECT id AS series_id, t, round(v, 6) AS value FROM obs",
    "series_ragged": "SELECT user_id AS series_id, count(*) AS n, round(sum(value), 4) AS total, round(sqrt(sum(value * value)), 4) AS norm FROM events WHERE value IS NOT NULL GROUP BY 1",
    "series_multivariate": """WITH t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS var FROM (SELECT DISTINCT event_type FROM events)),
      n AS (SELECT user_id, var, CAST(ts AS DATE) AS day, count(*) AS n FROM events JOIN t USING (event_type) GROUP BY 1, 2, 3)
      SELECT u.user_id AS series_id, t.var, CAST(coalesce(sum(n), 0) AS DOUBLE) AS total, CAST(coalesce(max(n), 0) AS DOUBLE) AS most FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t LEFT JOIN n ON n.user_id = u.user_id AND n.var = t.var GROUP BY 1, 2""",
    "zscore": f"WITH {DAILY}{Z} SELECT id AS series_id, t, round(v, 6) AS value FROM z",
    "reinterpolate": f"""WITH {DAILY}, s AS (SELECT id, list(v ORDER BY t) AS x FROM obs GROUP BY id), p AS (SELECT id, x, k, k * (len(x) - 1) / 44.0 AS pos FROM s, (SELECT unnest(range(45)) AS k))
      SELECT id AS series_id, CAST(k AS INT) AS t, round(x[CAST(floor(pos) AS INT) + 1] + (pos - floor(pos)) * (x[CAST(least(floor(pos) + 1, len(x) - 1) AS INT) + 1] - x[CAST(floor(pos) AS INT) + 1]), 6) AS value FROM p""",
    "envelope": f"WITH {DAILY} SELECT id AS series_id, t, round(min(v) OVER w, 6) AS low, round(max(v) OVER w, 6) AS up FROM obs WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    "autocorrelation": f"""WITH {DAILY}, c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS v FROM obs), q AS (SELECT id, sum(v * v) AS q FROM c GROUP BY 1)
      SELECT a.id AS series_id, CAST(k AS INT) AS t, round(CASE WHEN q > 0 THEN sum(a.v * b.v) / q WHEN k = 0 THEN 1.0 ELSE 0.0 END, 6) AS value FROM c a JOIN (SELECT unnest(range(6)) AS k) ON TRUE JOIN c b ON b.id = a.id AND b.t = a.t + k JOIN q ON q.id = a.id GROUP BY a.id, k, q""",
    "characteristics": f"WITH {DAILY}{Z} SELECT count(*) AS n_series, FALSE AS multivariate, min(n) = max(n) AS same_length, bool_and(abs(m) < 1e-6) AS centered, bool_and(abs(sd - 1) < 1e-6) AS scaled FROM (SELECT id, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM z GROUP BY 1)",
    "l1_matrix": _matrix(1),
    "l2_matrix": _matrix(2),
    "lb_keogh": f"""WITH {DAILY}{Z}, env AS (SELECT id, t, min(v) OVER w AS lo, max(v) OVER w AS up FROM z WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
      SELECT a.id AS i, b.id AS j, round(sqrt(sum(greatest(a.v - up, lo - a.v, 0) ** 2)), 6) AS d FROM z a JOIN env b ON a.t = b.t GROUP BY 1, 2""",
    "lb_improved": f"""WITH {DAILY}{Z}, env AS (SELECT id, t, v, min(v) OVER w AS lo, max(v) OVER w AS up FROM z WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
      h AS (SELECT a.id AS i, b.id AS j, a.t, greatest(a.v - up, lo - a.v, 0) AS e, b.v AS y, least(greatest(a.v, lo), up) AS h FROM z a JOIN env b ON a.t = b.t),
      g AS (SELECT i, j, e, y, min(h) OVER w AS lo, max(h) OVER w AS up FROM h WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
      SELECT i, j, round(sum(e) + sum(greatest(y - up, lo - y, 0)), 6) AS d FROM g GROUP BY 1, 2""",
    "sbd_matrix": f"""WITH {DAILY}{Z}, n AS (SELECT id, sqrt(sum(v * v)) AS n FROM z GROUP BY 1), c AS (SELECT a.id AS i, b.id AS j, a.t - b.t AS k, sum(a.v * b.v) AS s FROM z a JOIN z b ON a.id > b.id GROUP BY 1, 2, 3)
      SELECT i, j, round(CASE WHEN p.n * q.n > 0 THEN 1 - max(s) / (p.n * q.n) ELSE 1.0 END, 6) AS d FROM c JOIN n p ON p.id = i JOIN n q ON q.id = j GROUP BY i, j, p.n, q.n""",
    "dtw_l1_matrix": dtw(NATION + Z) + "SELECT i, j, round(d, 6) AS d FROM done",
    "dtw_l2_sym1": dtw(NATION + Z, norm="L2", step=1) + "SELECT i, j, round(sqrt(d), 6) AS d FROM done",
    "dtw_window": dtw(NATION + Z, LOWER.replace("a.id > b.id", "TRUE"), norm="L2", window=5) + "SELECT i, j, round(sqrt(d), 6) AS d FROM done WHERE i > j",
    "dtw_normalized": dtw(NATION + Z) + "SELECT i, j, round(d / (len(x) + len(y)), 6) AS d FROM done",
    "dtw_asymmetric": asymmetric(NATION + Z, LOWER.replace("a.id > b.id", "TRUE"), ABS) + "SELECT i, j, round(q[len(y)] / len(x), 6) AS d FROM done",
    "dtw_sloped": sloped(NATION + Z, LOWER) + "SELECT i, j, round(sqrt(q[len(y)]) / (len(x) + len(y)), 6) AS d FROM done",
    "dtw_typed": sloped(NATION + Z, LOWER.replace("a.id > b.id", "TRUE"), IIIC, ABS) + "SELECT i, j, round(q[len(y)] / len(x), 6) AS d FROM done",
    "dtw_open_ends": asymmetric(NATION + Z, "SELECT a.id AS i, b.id AS j, a.x[-24:] AS x, b.x AS y FROM s a, s b", SQUARE, "TRUE") + "SELECT i, j, round(sqrt(list_min(q)), 6) AS d FROM done",
    "dtw_pairwise": dtw(NATION + Z, "SELECT id AS i, id AS j, x, list_reverse(x) AS y FROM s", norm="L2") + "SELECT i, j, round(sqrt(d), 6) AS d FROM done",
    "dtw_nn": dtw(DAILY + Z) + ", bth AS (SELECT i, j, round(d, 6) AS d FROM done UNION ALL SELECT j, i, round(d, 6) FROM done) SELECT i, arg_min(j, (d, j)) AS j, min(d) AS d FROM bth GROUP BY 1",
    "dtw_lb_nn": dtw(DAILY + Z + ", gr AS (SELECT g AS id, list(v ORDER BY t) AS x FROM (SELECT ((id % 10) + 10) % 10 AS g, t, avg(v) AS v FROM z GROUP BY 1, 2) GROUP BY 1)", "SELECT s.id AS i, gr.id AS j, s.x AS x, gr.x AS y FROM s, gr", window=3)
    + "SELECT i, arg_min(j, (d, j)) AS j, round(min(d), 6) AS d FROM done GROUP BY 1",
    "sdtw_matrix": dynamic(NATION + Z, LOWER_SELF, SQUARE, "c", "c + least(diag, lft, up) - ln(exp(least(diag, lft, up) - diag) + exp(least(diag, lft, up) - lft) + exp(least(diag, lft, up) - up))") + "SELECT i, j, round(d, 6) AS d FROM done",
    "ugak_matrix": dynamic(NATION + Z, LOWER_SELF, f"({SQUARE}) / -8.0 - ln(2 - exp(({SQUARE}) / -8.0))", "c", "greatest(diag, lft, up) + ln(exp(diag - greatest(diag, lft, up)) + exp(lft - greatest(diag, lft, up)) + exp(up - greatest(diag, lft, up))) + c", outside="-10000.0")
    + "SELECT i, j, round(d, 6) AS d FROM done",
    "gak_matrix": dynamic(NATION + Z, LOWER_SELF, f"({SQUARE}) / -8.0 - ln(2 - exp(({SQUARE}) / -8.0))", "c", "greatest(diag, lft, up) + ln(exp(diag - greatest(diag, lft, up)) + exp(lft - greatest(diag, lft, up)) + exp(up - greatest(diag, lft, up))) + c", outside="-10000.0")
    + "SELECT o.i, o.j, round(1 - exp(o.d - (p.d + q.d) / 2), 6) AS d FROM done o JOIN done p ON p.i = o.i AND p.j = o.i JOIN done q ON q.i = o.j AND q.j = o.j WHERE o.i > o.j",
    "distance_memo": f"WITH {NATION}{Z} SELECT a.id AS i, b.id AS j, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS d FROM z a JOIN z b ON a.t = b.t AND a.id > b.id GROUP BY 1, 2",
    "cent_mean": f"WITH {EMB} SELECT CAST(c AS INT) AS cluster, CAST(t AS INT) AS t, round(v, 6) AS value FROM m",
    "cent_median": f"WITH {EMB} SELECT CAST(label AS INT) AS cluster, CAST(t AS INT) AS t, round(median(v), 6) AS value FROM l GROUP BY 1, 2",
    "medoid": f"WITH {EMB}, {DM}, w AS (SELECT a.label AS c, i, sum(d) AS s FROM dm JOIN e a ON a.id = i JOIN e b ON b.id = j AND a.label = b.label GROUP BY 1, 2) SELECT CAST(c AS INT) AS cluster, arg_min(i, (s, i)) AS series_id FROM w GROUP BY 1",
    "assign": f"WITH {EMB} SELECT id AS series_id, CAST(c AS INT) AS cluster, round(d, 6) AS d FROM lab",
    "predict": f"WITH {EMB} SELECT id AS series_id, CAST(c AS INT) AS cluster, round(d, 6) AS d FROM lab",
    "kmeans_step": f"WITH {EMB} SELECT CAST(lab.c AS INT) AS cluster, CAST(t AS INT) AS t, round(avg(v), 6) AS value FROM l JOIN lab USING (id) GROUP BY 1, 2",
    "fuzzy_u": f"WITH {EMB} SELECT id AS series_id, CAST(c AS INT) AS cluster, round(u, 6) AS u FROM u",
    "fcm_step": f"WITH {EMB} SELECT CAST(u.c AS INT) AS cluster, CAST(t AS INT) AS t, round(sum(u ** 2 * v) / sum(u ** 2), 6) AS value FROM l JOIN u USING (id) GROUP BY 1, 2",
    "fcmdd_step": f"WITH {EMB}, {DM}, w AS (SELECT c, i, sum(dm.d * u ** 2) AS s FROM dm JOIN u ON u.id = j GROUP BY 1, 2) SELECT CAST(c AS INT) AS cluster, arg_min(i, (s, i)) AS series_id FROM w GROUP BY 1",
    "cvi_external": f"""WITH {EMB}, lr AS (SELECT lab.c AS a, e.label AS b FROM lab JOIN e USING (id)), {_external_of('lr')},
      h AS (SELECT (SELECT sum(n * log10(n)) FROM ca) AS ha, (SELECT sum(n * log10(n)) FROM cb) AS hb, (SELECT sum(n * log10(n)) FROM cells) AS hab)
      SELECT round("RI", 6) AS "RI", round("ARI", 6) AS "ARI", round("J", 6) AS "J", round("FM", 6) AS "FM", round(abs(ha + hb - 2 * hab) / n, 6) AS "VI" FROM (SELECT {PAIR_INDICES}, n FROM pc), h""",
    "cvi_soft_external": f"""WITH {EMB}, t AS (SELECT u.c AS a, e.label AS b, sum(u) AS t FROM u JOIN e USING (id) GROUP BY 1, 2), k AS (SELECT count(*)::DOUBLE AS n FROM e),
      v AS (SELECT (SELECT sum(t * t) FROM t) AS q, (SELECT sum(t) FROM t) AS s, (SELECT sum(s * s) FROM (SELECT sum(t) AS s FROM t GROUP BY a)) AS qa, (SELECT sum(s * s) FROM (SELECT sum(t) AS s FROM t GROUP BY b)) AS qb,
        (SELECT -sum(t / n * ln(t / n + 2.2e-16)) FROM t, k) AS hab, (SELECT -sum(s / n * ln(s / n + 2.2e-16)) FROM (SELECT sum(t) AS s FROM t GROUP BY a), k) AS ha, (SELECT -sum(s / n * ln(s / n + 2.2e-16)) FROM (SELECT sum(t) AS s FROM t GROUP BY b), k) AS hb, n FROM k),
      p AS (SELECT *, (q - s) / 2 AS bo, (n * n + q - qa - qb) / 2 AS ne, (qb - q) / 2 AS x, (qa - q) / 2 AS y FROM v), w AS (SELECT *, bo + ne + x + y AS tot FROM p)
      SELECT round((bo - (bo + x) * (bo + y) / tot) / ((2 * bo + x + y) / 2 - (bo + x) * (bo + y) / tot), 6) AS "ARI", round((bo + ne) / tot, 6) AS "RI", round(ha + hb - 2 * (ha + hb - hab), 6) AS "VI", round((ha + hb - hab) / greatest(ha, hb), 6) AS "NMIM" FROM w""",
    "cvi_silhouette": f"""WITH {EMB}, {DM}, n AS (SELECT c, count(*) AS n FROM lab GROUP BY 1), w AS (SELECT i, a.c AS ci, b.c AS cj, sum(dm.d) AS s, count(*) AS k FROM dm JOIN lab a ON a.id = i JOIN lab b ON b.id = j GROUP BY 1, 2, 3),
      p AS (SELECT i, n, sum(s / (n - 1)) FILTER (ci = cj) AS a, min(s / k) FILTER (ci <> cj) AS b FROM w JOIN n ON n.c = ci GROUP BY 1, 2) SELECT round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS "Sil" FROM p""",
    "cvi_dunn": f'WITH {EMB}, {DM} SELECT round(min(dm.d) FILTER (a.c <> b.c) / max(dm.d) FILTER (a.c = b.c), 6) AS "D" FROM dm JOIN lab a ON a.id = i JOIN lab b ON b.id = j',
    "cvi_cop": f"""WITH {EMB}, {DM}, far AS (SELECT c, min(f) AS f FROM (SELECT i, a.c, max(dm.d) AS f FROM dm JOIN lab a ON a.id = i JOIN lab b ON b.id = j AND a.c <> b.c GROUP BY 1, 2) GROUP BY 1)
      SELECT round(sum(s / f) / sum(n), 6) AS "COP" FROM (SELECT c, sum(d) AS s, count(*) AS n FROM lab GROUP BY 1) JOIN far USING (c)""",
    "cvi_davies_bouldin": f"""WITH {EMB}, {BETWEEN}, av AS (SELECT c, avg(d) AS s FROM lab GROUP BY 1)
      SELECT round(avg(r), 6) AS "DB", round(avg(q), 6) AS "DBstar" FROM (SELECT i, max((a.s + b.s) / d) AS r, max(a.s + b.s) / min(d) AS q FROM bt JOIN av a ON a.c = i JOIN av b ON b.c = j GROUP BY 1)""",
    "cvi_calinski_score": f"""WITH {EMB}, {GLOBAL}, o AS (SELECT c, avg(d) AS av, count(*) AS n, sum(d) AS s FROM lab GROUP BY 1), w AS (SELECT sum(n) AS n, count(*) AS k, sum(n * g) AS b, sum(s) AS w, sum(av) AS v FROM o JOIN gc USING (c))
      SELECT round((n - k) / (k - 1) * b / w, 6) AS "CH", round(1 - 1 / exp(exp(b / (n * k) - v)), 6) AS "SF" FROM w""",
    "cvi_fuzzy": f"""WITH {EMB}, {BETWEEN}, {GLOBAL}, a AS (SELECT count(DISTINCT id) AS n, count(DISTINCT c) AS k, sum(u * u) AS uu, sum(u * u * d * d) AS uudd, sum(u * u * d) AS umd FROM u),
      b AS (SELECT min(d * d) AS lo, max(d) AS hi, sum(d * d) AS bb FROM bt), g AS (SELECT sum(g * g) AS gg FROM gc), x AS (SELECT sum(g) AS e FROM gs), v AS (SELECT sum(v) AS comp FROM (SELECT sum(u * u * d * d) / sum(u) AS v FROM u GROUP BY c)),
      o AS (SELECT sum(o) AS over FROM (SELECT sum(least(p.u, q.u) ** 2) / sum(least(p.u, q.u)) AS o FROM u p JOIN u q ON p.id = q.id AND p.c < q.c GROUP BY p.c, q.c)), t AS (SELECT sum(w * w) / sum(w) AS top FROM (SELECT max(u) AS w FROM u GROUP BY id))
      SELECT round(1 - k / (k - 1) * (1 - uu / n), 6) AS "MPC", round((uudd + gg / k) / lo, 6) AS "K", round((uudd + bb / (k * (k - 1))) / (lo + 1 / k), 6) AS "T", round(gg / k / comp - over / top, 6) AS "SC", round((e / k / umd * hi) ** 2, 6) AS "PBMF" FROM a, b, g, x, v, o, t""",
    "cluster_sizes": f"WITH {EMB} SELECT CAST(c AS INT) AS cluster, count(*) AS size, round(avg(d), 6) AS av_dist FROM lab GROUP BY 1",
    "config_grid": f"""WITH {NATION}, w AS (SELECT share, ceil((SELECT count(DISTINCT t) FROM obs) * share / 100) AS w FROM (VALUES (5), (10)) s(share)), c AS (SELECT 'dtw_basic' AS distance, w AS window_distance FROM w UNION ALL SELECT 'sbd', NULL)
      SELECT k, preproc, distance, CAST(window_distance AS DOUBLE) AS window_distance FROM (VALUES (2), (3), (4)) a(k), (VALUES ('none'), ('zscore')) b(preproc), c""",
    "config_grid_shared": f"""WITH {NATION}, a AS (SELECT CASE share WHEN 5 THEN 'L1' ELSE 'L2' END AS norm, ceil((SELECT count(DISTINCT t) FROM obs) * share / 100) AS window_distance FROM (VALUES (5), (10)) s(share))
      SELECT norm, CAST(window_distance AS DOUBLE) AS window_distance, centroid FROM a FULL JOIN (VALUES ('L1', 'dba'), ('L3', 'pam')) b(norm, centroid) USING (norm)""",
    "consensus_partition": f"""WITH {EMB}, parts AS (SELECT 1 AS p, id, label AS c FROM e UNION ALL SELECT 2, id, c FROM lab UNION ALL SELECT 3, id, (x[1] > 0)::INT FROM e),
      ce AS (SELECT a.p AS pa, b.p AS pb, count(*) AS n FROM parts a JOIN parts b USING (id) GROUP BY a.p, b.p, a.c, b.c), s AS (SELECT pa, pb, sum(n * n) AS s FROM ce GROUP BY 1, 2), q AS (SELECT p, sum(n * n) AS q FROM (SELECT p, count(*) AS n FROM parts GROUP BY p, c) GROUP BY 1)
      SELECT arg_min(pa, (d, pa)) AS part FROM (SELECT pa, sum(a.q + b.q - 2 * s) AS d FROM s JOIN q a ON a.p = pa JOIN q b ON b.p = pb GROUP BY 1)""",
    "constraint_complexity": FLAGS + " SELECT i, j, type, round(complexity, 6) AS complexity, CAST(first_ok AS DOUBLE) AS first_ok FROM comp",
    "window_vote": FLAGS + """, votes AS (SELECT first_ok AS w, count(*) AS v FROM comp WHERE complexity > 0 AND complexity < 0.5 AND first_ok IS NOT NULL GROUP BY 1)
      SELECT coalesce((SELECT arg_min(w, (-v, w)) FROM votes), (SELECT min(first_ok) FROM comp)) AS window, coalesce((SELECT max(v) FROM votes), 0) AS votes""",
}
SBD = """n AS (SELECT id, sqrt(sum(v * v)) AS n FROM z GROUP BY 1), c AS (SELECT a.id AS i, b.id AS j, a.t - b.t AS k, sum(a.v * b.v) AS s FROM z a JOIN z b ON a.id > b.id GROUP BY 1, 2, 3),
sbd AS (SELECT i, j, CASE WHEN p.n * q.n > 0 THEN 1 - max(s) / (p.n * q.n) ELSE 1.0 END AS d FROM c JOIN n p ON p.id = i JOIN n q ON q.id = j GROUP BY i, j, p.n, q.n)"""
SHAPES = 18  # squarings of a matrix: its 2**18th power is of rank one
_square = lambda k: f"""q{k} AS (SELECT a.g, a.i, b.j, sum(a.m * b.m) AS m FROM w{k - 1} a JOIN w{k - 1} b ON a.g = b.g AND a.j = b.i GROUP BY 1, 2, 3),
w{k} AS (SELECT g, i, j, m / sum(m) FILTER (i = j) OVER (PARTITION BY g) AS m FROM q{k})"""  # noqa: E731
ORACLES |= {
    "zscore_multivariate": f"WITH {MULTI} SELECT id AS series_id, t, var, round(CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0.0 END, 6) AS value FROM mv WINDOW w AS (PARTITION BY id, var)",
    "reshape_multivariate": f"WITH {MULTI} SELECT id AS series_id, var, t, v AS value FROM mv",
    "cross_correlation": f"WITH {NATION}{Z}, n AS (SELECT id, sqrt(sum(v * v)) AS n FROM z GROUP BY 1) SELECT a.id AS series_id, a.t - b.t AS lag, round(sum(a.v * b.v) / any_value(p.n * q.n), 6) AS value FROM z a JOIN z b ON b.id = a.id + 1 JOIN n p ON p.id = a.id JOIN n q ON q.id = b.id GROUP BY 1, 2",
    "sbd_znorm": ORACLES["sbd_matrix"],
    "distance_table": f"WITH {NATION}{Z}, m AS (SELECT a.id AS i, b.id AS j, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS d FROM z a JOIN z b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2) SELECT i, " + ", ".join(f'max(d) FILTER (j = {j}) AS "{j}"' for j in range(25)) + " FROM m GROUP BY i",
    "dtw_ragged": dtw(NATION + Z, "SELECT a.id AS i, b.id AS j, a.x[1:40 + a.id] AS x, b.x[1:40 + b.id] AS y FROM s a JOIN s b ON a.id > b.id", norm="L2") + "SELECT i, j, round(sqrt(d), 6) AS d FROM done",
    "dtw_multivariate": dynamic(f"{MULTI}, s AS (SELECT id, list(p ORDER BY t) AS x FROM (SELECT id, t, list(v ORDER BY var) AS p FROM mv GROUP BY 1, 2) GROUP BY id)", LOWER, "list_sum(list_transform(range(1, len(x[a + 1]) + 1), lambda k: abs(x[a + 1][k] - y[b + 1][k])))",
        "c", "least(diag + 2 * c, lft + c, up + c)", "abs(a - b) <= 5") + "SELECT i, j, round(d, 6) AS d FROM done",
    "dtw_path": paths(NATION + ", s AS (SELECT id, list(round(v / 1000) ORDER BY t) AS x FROM obs GROUP BY id)", "SELECT a.id AS i, b.id AS j, a.x AS x, b.x AS y FROM s a JOIN s b ON b.id = a.id + 1") + "SELECT i AS series_id, step, a + 1 AS index1, b + 1 AS index2 FROM path",
    "gak_memo": ORACLES["gak_matrix"],
    "cent_multivariate": f"WITH {MULTI} SELECT CAST(id % 4 AS INT) AS cluster, t, var, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM mv GROUP BY 1, 2, 3",
    "dba_step": paths(f"{DAILY}{Z}, ce AS (SELECT g, list(v ORDER BY t) AS y FROM (SELECT id % 4 AS g, t, avg(v) AS v FROM z GROUP BY 1, 2) GROUP BY g)", "SELECT id AS i, g AS j, x, y FROM s JOIN ce ON g = id % 4", window=5)
    + "SELECT CAST(path.j AS INT) AS cluster, path.b AS t, round(avg(x[path.a + 1]), 6) AS value FROM path JOIN done USING (i, j) GROUP BY 1, 2",
    "shape_centroid": f"""WITH {DAILY}{Z}, m AS (SELECT id % 4 AS g, id, t, v FROM z), f AS (SELECT g, min(id) AS id FROM m GROUP BY 1), h AS (SELECT m.g, t, v FROM m JOIN f USING (id)),
      cc AS (SELECT m.id, h.t - m.t AS k, sum(h.v * m.v) AS c FROM m JOIN h USING (g) GROUP BY 1, 2), best AS (SELECT id, arg_max(k, (c, -k)) AS k FROM cc GROUP BY 1),
      al AS (SELECT m.g, m.id, m.t, coalesce(o.v, 0.0) AS v FROM m JOIN best USING (id) LEFT JOIN m o ON o.id = m.id AND o.t = m.t - best.k),
      y AS (SELECT g, id, t, CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0.0 END AS v FROM al WINDOW w AS (PARTITION BY id)),
      gr AS (SELECT a.g, a.t AS i, b.t AS j, sum(a.v * b.v) AS m FROM y a JOIN y b ON a.id = b.id GROUP BY 1, 2, 3),
      w0 AS (SELECT g, i, j, m - avg(m) OVER (PARTITION BY g, i) - avg(m) OVER (PARTITION BY g, j) + avg(m) OVER (PARTITION BY g) AS m FROM gr),
      {", ".join(_square(k) for k in range(1, SHAPES + 1))}, top AS (SELECT g, arg_max(j, m) AS j FROM w{SHAPES} WHERE i = j GROUP BY 1), v AS (SELECT g, i AS t, m AS v FROM w{SHAPES} JOIN top USING (g, j)),
      sg AS (SELECT v.g, CASE WHEN sum(v.v * al.v) > 0 THEN 1 ELSE -1 END AS s FROM v JOIN f USING (g) JOIN al ON al.id = f.id AND al.t = v.t GROUP BY 1)
      SELECT CAST(g AS INT) AS cluster, t, round(s * (v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS value FROM v JOIN sg USING (g) WINDOW w AS (PARTITION BY g)""",
    "pam_clustering": dtw(NATION + Z, LOWER, window=5) + """, fl AS (SELECT i, j, d FROM done UNION ALL SELECT j, i, d FROM done UNION ALL SELECT id, id, 0.0 FROM s),
      it AS (
        SELECT 0 AS n, row_number() OVER (ORDER BY id) AS c, id AS m FROM (SELECT id FROM s ORDER BY id LIMIT 4)
        UNION ALL
        SELECT n, c, arg_min(i, (w, i)) FROM (
          SELECT l.n, l.c, l.i, sum(fl.d) AS w FROM (SELECT n + 1 AS n, fl.i, arg_min(c, (CASE WHEN fl.i = m THEN -1 ELSE fl.d END, c)) AS c FROM it JOIN fl ON fl.j = m WHERE n < 99 GROUP BY 1, 2) l
          JOIN (SELECT n + 1 AS n, fl.i, arg_min(c, (CASE WHEN fl.i = m THEN -1 ELSE fl.d END, c)) AS c FROM it JOIN fl ON fl.j = m WHERE n < 99 GROUP BY 1, 2) r ON r.c = l.c JOIN fl ON fl.i = l.i AND fl.j = r.i GROUP BY 1, 2, 3
        ) GROUP BY 1, 2
      ) SELECT i AS series_id, CAST(arg_min(c, (CASE WHEN i = m THEN -1 ELSE d END, c)) AS INT) AS cluster, round(min(d), 6) AS d FROM it JOIN fl ON fl.j = m WHERE n = 99 GROUP BY 1""",
    "kmeans_clustering": """WITH RECURSIVE l AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS t FROM embeddings),
      st AS (SELECT id, row_number() OVER (ORDER BY id) AS c FROM (SELECT vec_id AS id FROM embeddings ORDER BY 1 LIMIT 10)),
      it AS (
        SELECT 0 AS n, c, t, v FROM st JOIN l USING (id)
        UNION ALL
        SELECT n, c, t, avg(l.v) FROM (SELECT n, id, arg_min(c, (d, c)) AS c FROM (SELECT n + 1 AS n, id, c, sqrt(sum((l.v - it.v) ** 2)) AS d FROM it JOIN l USING (t) WHERE n < 99 GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN l USING (id) GROUP BY 1, 2, 3
      ) SELECT id AS series_id, CAST(arg_min(c, (d, c)) AS INT) AS cluster, round(min(d), 6) AS d FROM (SELECT id, c, sqrt(sum((l.v - it.v) ** 2)) AS d FROM it JOIN l USING (t) WHERE n = 99 GROUP BY 1, 2) GROUP BY 1""",
    "fuzzy_clustering": f"""WITH RECURSIVE {DAILY}, {ACF}, st AS (SELECT id, row_number() OVER (ORDER BY id) AS c FROM (SELECT DISTINCT id FROM ac ORDER BY id LIMIT 4)),
      it AS (
        SELECT 1 AS n, c, t, v, NULL::DOUBLE AS obj, FALSE AS done FROM st JOIN ac USING (id)
        UNION ALL
        SELECT n + 1, c, t, sum(u * u * ac.v) / sum(u * u), any_value(val), any_value(coalesce(abs(val - obj) < 1e-3, FALSE))
        FROM (SELECT *, sum(u * u * d * d) OVER () AS val FROM (SELECT *, CASE WHEN bool_or(d = 0) OVER w THEN (d = 0)::INT / sum((d = 0)::INT) OVER w ELSE (1 / d ** 2) / sum(1 / d ** 2) OVER w END AS u
          FROM (SELECT n, id, c, any_value(obj) AS obj, sqrt(sum((ac.v - it.v) ** 2)) AS d FROM it JOIN ac USING (t) WHERE NOT done AND n < 101 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY id))) JOIN ac USING (id) GROUP BY n, c, t
      ), en AS (SELECT coalesce(min(n) FILTER (done), 101) - 1 AS n FROM it), fd AS (SELECT id, c, sqrt(sum((ac.v - it.v) ** 2)) AS d FROM it JOIN en USING (n) JOIN ac USING (t) GROUP BY 1, 2)
      SELECT id AS series_id, CAST(c AS INT) AS cluster, round(CASE WHEN bool_or(d = 0) OVER w THEN (d = 0)::INT / sum((d = 0)::INT) OVER w ELSE (1 / d ** 2) / sum(1 / d ** 2) OVER w END, 6) AS u FROM fd WINDOW w AS (PARTITION BY id)""",
    "hierarchical_clustering": f"""WITH RECURSIVE {DAILY}{Z}, {SBD}, fl AS MATERIALIZED (SELECT i, j, d FROM sbd UNION ALL SELECT j, i, d FROM sbd), nk AS (SELECT count(*) - 5 AS last FROM s),
      run AS (
        SELECT 1 AS n, last, i, j, d, 1.0::DOUBLE AS si, 1.0::DOUBLE AS sj FROM fl, nk
        UNION ALL
        SELECT n + 1, last, x, y, sum(d * w) / sum(w), CASE WHEN x = bi THEN sum(si) ELSE max(si) END, CASE WHEN y = bi THEN sum(sj) ELSE max(sj) END
        FROM (SELECT *, CASE WHEN x = bi THEN si WHEN y = bi THEN sj ELSE 1.0 END AS w FROM (
          SELECT n, last, d, si, sj, b['i'] AS bi, CASE WHEN i = b['j'] THEN b['i'] ELSE i END AS x, CASE WHEN j = b['j'] THEN b['i'] ELSE j END AS y
          FROM (SELECT *, min({{'d': d, 'i': i, 'j': j}}) FILTER (i < j) OVER () AS b FROM run WHERE n < last)
        ) WHERE x <> y) GROUP BY n, last, bi, x, y
      ), mg AS MATERIALIZED (SELECT n, min({{'d': d, 'i': i, 'j': j}}) FILTER (i < j) AS b FROM run GROUP BY n),
      res AS (SELECT 0 AS n, id, id AS root FROM s UNION ALL SELECT mg.n, id, CASE WHEN root = b['j'] THEN b['i'] ELSE root END FROM res JOIN mg ON mg.n = res.n + 1),
      lb AS (SELECT id, dense_rank() OVER (ORDER BY root) AS c FROM res WHERE n = (SELECT last FROM nk)),
      me AS (SELECT c, arg_min(id, (w, id)) AS m FROM (SELECT p.c, p.id, coalesce(sum(fl.d), 0) AS w FROM lb p LEFT JOIN lb q ON p.c = q.c AND p.id <> q.id LEFT JOIN fl ON fl.i = p.id AND fl.j = q.id GROUP BY 1, 2) GROUP BY 1)
      SELECT id AS series_id, CAST(c AS INT) AS cluster, round(coalesce(fl.d, 0), 6) AS d FROM lb JOIN me USING (c) LEFT JOIN fl ON fl.i = id AND fl.j = m""",
    "tadpole_clustering": dtw(DAILY + Z + f""", env AS (SELECT id, t, min(v) OVER w AS lo, max(v) OVER w AS up FROM z WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
      ke AS (SELECT a.id AS i, b.id AS j, sqrt(sum(greatest(a.v - up, lo - a.v, 0) ** 2)) AS d FROM z a JOIN env b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2),
      eu AS (SELECT a.id AS i, b.id AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM z a JOIN z b ON a.t = b.t AND a.id > b.id GROUP BY 1, 2)""", norm="L2", step=1, window=3)
    + """, one AS (SELECT done.i, done.j, sqrt(done.d) AS dtw, eu.d AS ub, greatest(p.d, q.d) AS lb FROM done JOIN eu ON eu.i = done.i AND eu.j = done.j JOIN ke p ON p.i = done.i AND p.j = done.j JOIN ke q ON q.i = done.j AND q.j = done.i),
      al AS (SELECT *, lb <= 6 AND ub > 6 AS known FROM (SELECT i, j, dtw, ub, lb FROM one UNION ALL SELECT j, i, dtw, ub, lb FROM one)),
      rh AS (SELECT s.id, count(i) AS r FROM s LEFT JOIN al ON i = s.id AND CASE WHEN known THEN dtw <= 6 ELSE lb <= 6 AND ub < 6 END GROUP BY 1),
      rs AS (SELECT id, CASE WHEN hi = lo THEN 1.0 ELSE (r - lo)::DOUBLE / (hi - lo) END AS rho FROM rh, (SELECT min(r) AS lo, max(r) AS hi FROM rh)),
      o1 AS (SELECT *, row_number() OVER (ORDER BY rho DESC, id) AS pos FROM rs),
      de AS (SELECT al.i AS id, min(CASE WHEN known THEN dtw ELSE ub END) AS delta FROM al JOIN o1 p ON p.id = i JOIN o1 q ON q.id = j AND q.pos < p.pos GROUP BY 1),
      o2 AS (SELECT id, rho, delta, row_number() OVER (ORDER BY rho * delta DESC, id) AS pos FROM (SELECT id, rho, coalesce(delta, (SELECT max(delta) FROM de)) AS delta FROM o1 LEFT JOIN de USING (id))),
      nn AS (SELECT al.i AS id, min({'d': CASE WHEN known OR lb <= p.delta THEN dtw ELSE ub END, 'pos': q.pos, 'j': j}) AS b FROM al JOIN o2 p ON p.id = i JOIN o2 q ON q.id = j AND q.pos < p.pos GROUP BY 1),
      sc AS (SELECT id, pos, rho, b['j'] AS nn, coalesce(b['d'], max(b['d']) OVER ()) AS d FROM o2 LEFT JOIN nn USING (id)),
      tp AS (SELECT id, row_number() OVER (ORDER BY id) AS c FROM (SELECT id FROM (SELECT id, pos, rho * CASE WHEN hi > lo THEN (d - lo) / (hi - lo) ELSE 1.0 END AS score FROM sc, (SELECT min(d) AS lo, max(d) AS hi FROM sc)) ORDER BY score DESC, pos LIMIT 4)),
      fo AS (SELECT id, id AS seen FROM s UNION ALL SELECT fo.id, sc.nn FROM fo JOIN sc ON sc.id = seen LEFT JOIN tp ON tp.id = seen WHERE tp.id IS NULL AND sc.nn IS NOT NULL)
      SELECT fo.id AS series_id, CAST(c AS INT) AS cluster FROM fo JOIN tp ON tp.id = seen""",
    "cvi_indices": None,
}
_parts = {n: ORACLES[n] for n in ("cvi_silhouette", "cvi_dunn", "cvi_cop", "cvi_davies_bouldin", "cvi_calinski_score")}
ORACLES["cvi_indices"] = "SELECT * FROM " + ", ".join(f"({q})" for q in _parts.values())
_PICK = f"""WITH {EMB}, l2 AS (SELECT lab.c AS a, e.label AS b FROM lab JOIN e USING (id)), l3 AS (SELECT (x[1] > 0)::INT AS a, label AS b FROM e),
 one AS (WITH {_external_of('l2')} SELECT 'config2' AS config_id, {PAIR_INDICES} FROM pc), two AS (WITH {_external_of('l3')} SELECT 'config3' AS config_id, {PAIR_INDICES} FROM pc),
 tall AS (UNPIVOT (SELECT * FROM one UNION ALL SELECT * FROM two) ON "RI", "ARI", "J", "FM" INTO NAME cvi VALUE score), best AS (SELECT cvi, arg_min(config_id, (-score, config_id)) AS config_id FROM tall GROUP BY 1)
 SELECT config_id, votes FROM (SELECT config_id, count(*) AS votes FROM best GROUP BY 1) ORDER BY votes DESC, config_id LIMIT 1"""
ORACLES["majority_pick"] = _PICK
_TREE = f"""{DAILY}{Z}, {SBD}, fl AS MATERIALIZED (SELECT i, j, d FROM sbd UNION ALL SELECT j, i, d FROM sbd),
prim AS (
  SELECT 1 AS n, [min(id)] AS done, {{'d': 0.0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'new': 0::BIGINT}} AS e FROM s
  UNION ALL
  SELECT n + 1, list_append(done, e['new']), e FROM (SELECT n, done, min({{'d': d, 'i': greatest(i, j), 'j': least(i, j), 'new': j}}) AS e FROM prim JOIN fl ON list_contains(done, i) AND NOT list_contains(done, j) GROUP BY n, done)
), tree AS MATERIALIZED (SELECT e['i'] AS i, e['j'] AS j, e['d'] AS d FROM prim WHERE n > 1)"""
ORACLES |= {
    "spanning_tree": f"WITH RECURSIVE {_TREE} SELECT i, j, round(d, 6) AS d FROM tree",
    "single_linkage": f"""WITH RECURSIVE {_TREE}, li AS (SELECT i, j FROM (SELECT *, row_number() OVER (ORDER BY d DESC, i DESC, j DESC) AS k FROM tree) WHERE k > 4),
      reach AS (SELECT id AS a, id AS b FROM s UNION SELECT a, CASE WHEN b = i THEN j ELSE i END FROM reach JOIN li ON b = i OR b = j),
      lb AS (SELECT a AS id, dense_rank() OVER (ORDER BY c) AS c FROM (SELECT a, min(b) AS c FROM reach GROUP BY 1)),
      me AS (SELECT c, arg_min(id, (w, id)) AS m FROM (SELECT p.c, p.id, coalesce(sum(fl.d), 0) AS w FROM lb p LEFT JOIN lb q ON p.c = q.c AND p.id <> q.id LEFT JOIN fl ON fl.i = p.id AND fl.j = q.id GROUP BY 1, 2) GROUP BY 1)
      SELECT id AS series_id, CAST(c AS INT) AS cluster, round(coalesce(fl.d, 0), 6) AS d FROM lb JOIN me USING (c) LEFT JOIN fl ON fl.i = id AND fl.j = m""",
    "dendrogram": f"""WITH RECURSIVE {NATION}{Z}, nr AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM s),
      fl AS MATERIALIZED (SELECT p.r AS i, q.r AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM z a JOIN z b ON a.t = b.t AND a.id <> b.id JOIN nr p ON p.id = a.id JOIN nr q ON q.id = b.id GROUP BY 1, 2), nk AS (SELECT count(*) AS last FROM s),
      run AS (
        SELECT 1 AS n, last, i, j, d, 1.0::DOUBLE AS si, 1.0::DOUBLE AS sj FROM fl, nk
        UNION ALL
        SELECT n + 1, last, x, y, sum(d * w) / sum(w), CASE WHEN x = bi THEN sum(si) ELSE max(si) END, CASE WHEN y = bi THEN sum(sj) ELSE max(sj) END
        FROM (SELECT *, CASE WHEN x = bi THEN si WHEN y = bi THEN sj ELSE 1.0 END AS w FROM (
          SELECT n, last, d, si, sj, b['i'] AS bi, CASE WHEN i = b['j'] THEN b['i'] ELSE i END AS x, CASE WHEN j = b['j'] THEN b['i'] ELSE j END AS y
          FROM (SELECT *, min({{'d': d, 'i': i, 'j': j}}) FILTER (i < j) OVER () AS b FROM run WHERE n < last)
        ) WHERE x <> y) GROUP BY n, last, bi, x, y
      ), mg AS MATERIALIZED (SELECT n, min({{'d': d, 'i': i, 'j': j}}) FILTER (i < j) AS b FROM run GROUP BY n),
      ro AS (SELECT n, b['i'] AS i, b['j'] AS j, b['d'] AS h FROM mg),
      nm AS (SELECT ro.n, ro.h, coalesce(max(p.n) FILTER (p.i = ro.i), -ro.i) AS a, coalesce(max(p.n) FILTER (p.i = ro.j), -ro.j) AS b FROM ro LEFT JOIN ro p ON p.n < ro.n AND (p.i = ro.i OR p.i = ro.j) GROUP BY ro.n, ro.h, ro.i, ro.j),
      me AS MATERIALIZED (SELECT n, h, CASE WHEN (a > 0, abs(a)) <= (b > 0, abs(b)) THEN a ELSE b END AS a, CASE WHEN (a > 0, abs(a)) <= (b > 0, abs(b)) THEN b ELSE a END AS b FROM nm),
      dn AS (SELECT n AS v, '' AS path FROM me WHERE n = (SELECT max(n) FROM me) UNION ALL SELECT unnest([a, b]), path || unnest(['0', '1']) FROM dn JOIN me ON me.n = dn.v),
      pl AS (SELECT v, row_number() OVER (ORDER BY path) AS x FROM dn WHERE v < 0),
      po AS (
        SELECT 0 AS n, v, CAST(x AS DOUBLE) AS x, 0.0::DOUBLE AS h FROM pl
        UNION ALL
        SELECT * FROM (SELECT k AS n, v, x, h FROM (SELECT po.*, po.n + 1 AS k FROM po WHERE po.n < (SELECT max(n) FROM me))
          UNION ALL SELECT k, k, avg(x), any_value(mh) FROM (SELECT po.*, me.n AS k, me.h AS mh FROM po JOIN me ON me.n = po.n + 1 AND (po.v = me.a OR po.v = me.b)) GROUP BY k)
      ), en AS (SELECT v, x, h FROM po WHERE n = (SELECT max(n) FROM me))
      SELECT CAST(me.n AS INT) AS merge, CAST(me.a AS INT) AS a, CAST(me.b AS INT) AS b, round(p.x, 6) AS left, round(q.x, 6) AS right, round(p.h, 6) AS left_height, round(q.h, 6) AS right_height, round(me.h, 6) AS height FROM me JOIN en p ON p.v = me.a JOIN en q ON q.v = me.b""",
    "kshape_step": f"""WITH {DAILY}{Z}, st AS (SELECT id, row_number() OVER (ORDER BY id) AS g FROM (SELECT id FROM s ORDER BY id LIMIT 4)), h AS (SELECT g, t, v FROM z JOIN st USING (id)), hn AS (SELECT g, sqrt(sum(v * v)) AS n FROM h GROUP BY 1), zn AS (SELECT id, sqrt(sum(v * v)) AS n FROM z GROUP BY 1),
      ca AS (SELECT z.id, h.g, h.t - z.t AS k, sum(h.v * z.v) AS c FROM z, h GROUP BY 1, 2, 3),
      dg AS (SELECT id, g, CASE WHEN zn.n * hn.n > 0 THEN 1 - max(c) / (zn.n * hn.n) ELSE 1.0 END AS d FROM ca JOIN zn USING (id) JOIN hn USING (g) GROUP BY id, g, zn.n, hn.n), lb AS (SELECT id, arg_min(g, (d, g)) AS g FROM dg GROUP BY 1),
      m AS (SELECT g, id, t, v FROM z JOIN lb USING (id)), f AS (SELECT g, min(id) AS id FROM m GROUP BY 1),
      best AS (SELECT ca.id, arg_max(k, (c, -k)) AS k FROM ca JOIN lb USING (id, g) GROUP BY 1),
      al AS (SELECT m.g, m.id, m.t, coalesce(o.v, 0.0) AS v FROM m JOIN best USING (id) LEFT JOIN m o ON o.id = m.id AND o.t = m.t - best.k),
      y AS (SELECT g, id, t, CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0.0 END AS v FROM al WINDOW w AS (PARTITION BY id)),
      gr AS (SELECT a.g, a.t AS i, b.t AS j, sum(a.v * b.v) AS m FROM y a JOIN y b ON a.id = b.id GROUP BY 1, 2, 3),
      w0 AS (SELECT g, i, j, m - avg(m) OVER (PARTITION BY g, i) - avg(m) OVER (PARTITION BY g, j) + avg(m) OVER (PARTITION BY g) AS m FROM gr),
      {", ".join(_square(k) for k in range(1, SHAPES + 1))}, top AS (SELECT g, arg_max(j, m) AS j FROM w{SHAPES} WHERE i = j GROUP BY 1), v AS (SELECT g, i AS t, m AS v FROM w{SHAPES} JOIN top USING (g, j)),
      sg AS (SELECT v.g, CASE WHEN sum(v.v * al.v) > 0 THEN 1 ELSE -1 END AS s FROM v JOIN f USING (g) JOIN al ON al.id = f.id AND al.t = v.t GROUP BY 1)
      SELECT CAST(g AS INT) AS cluster, t, round(s * (v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS value FROM v JOIN sg USING (g) WINDOW w AS (PARTITION BY g)""",
}
_CMP = {"L1": "sum(abs(l.v - it.v))", "L2": "sqrt(sum((l.v - it.v) ** 2))"}


def _kmeans(name: str, k: int, d: str) -> str:
    """Labels (id, a) of the 20th assignment of k-means from the k least ids."""
    return f"""{name}_it AS (
    SELECT 0 AS n, c, t, v FROM (SELECT id, row_number() OVER (ORDER BY id) AS c FROM (SELECT id FROM e ORDER BY 1 LIMIT {k})) JOIN l USING (id)
    UNION ALL
    SELECT n, c, t, avg(l.v) FROM (SELECT n, id, arg_min(c, (d, c)) AS c FROM (SELECT n + 1 AS n, id, c, {d} AS d FROM {name}_it it JOIN l USING (t) WHERE n < 19 GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN l USING (id) GROUP BY 1, 2, 3
  ), {name} AS (SELECT id, arg_min(c, (d, c)) AS a FROM (SELECT id, c, {d} AS d FROM {name}_it it JOIN l USING (t) WHERE n = 19 GROUP BY 1, 2) GROUP BY 1)"""


_CONFIGS = [(f"config{i}_{j}", m, k) for i, m in enumerate(("L1", "L2"), 1) for j, k in enumerate((5, 10), 1)]
_RUNS = ", ".join(_kmeans(n, k, _CMP[m]) for n, m, k in _CONFIGS)
_CELLS = " UNION ALL ".join(f"SELECT '{n}' AS config_id, '{m}' AS distance, {k} AS k, a, label AS b FROM {n} JOIN e USING (id)" for n, m, k in _CONFIGS)
ORACLES["compare_configs"] = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS t FROM e), {_RUNS},
 ce AS (SELECT config_id, distance, k, a, b, count(*) AS n FROM ({_CELLS}) GROUP BY ALL),
 pc AS (SELECT config_id, distance, k, sum(n * (n - 1) / 2.0) AS bth, sum(n) AS n, sum(n) * (sum(n) - 1) / 2.0 AS total, sum(n * log10(n)) AS hab FROM ce GROUP BY ALL),
 ca AS (SELECT config_id, sum(n * (n - 1) / 2.0) AS pa, sum(n * log10(n)) AS ha FROM (SELECT config_id, sum(n) AS n FROM ce GROUP BY config_id, a) GROUP BY 1), cb AS (SELECT config_id, sum(n * (n - 1) / 2.0) AS pb, sum(n * log10(n)) AS hb FROM (SELECT config_id, sum(n) AS n FROM ce GROUP BY config_id, b) GROUP BY 1),
 sc AS (SELECT config_id, distance, k, {PAIR_INDICES}, 1 / (abs(ha + hb - 2 * hab) / n) AS "VI" FROM pc JOIN ca USING (config_id) JOIN cb USING (config_id)),
 tall AS (SELECT config_id, unnest(['RI', 'ARI', 'J', 'FM', 'VI']) AS cvi, unnest(["RI", "ARI", "J", "FM", "VI"]) AS score FROM sc), votes AS (SELECT cvi, arg_min(config_id, (-score, config_id)) AS config_id FROM tall GROUP BY 1),
 pick AS (SELECT config_id FROM (SELECT config_id, count(*) AS v, min(cvi) AS f FROM votes GROUP BY 1) ORDER BY v DESC, f LIMIT 1)
 SELECT config_id, distance, CAST(k AS INT) AS k, round("RI", 6) AS "RI", round("ARI", 6) AS "ARI", round("J", 6) AS "J", round("FM", 6) AS "FM", round("VI", 6) AS "VI", config_id = (SELECT config_id FROM pick) AS best FROM sc"""
ORACLES["constraint_closure"] = f"""WITH RECURSIVE {DAILY}, lv AS (SELECT id, ((CAST(floor(round(sum(v), 2) / 50) AS BIGINT) % 3) + 3) % 3 AS l1, ((CAST(floor(round(sum(v) FILTER (t < 7), 2) / 50) AS BIGINT) % 3) + 3) % 3 AS l2 FROM obs GROUP BY 1),
 links AS (SELECT a.id AS i, b.id AS j, CASE b.id - a.id WHEN 1 THEN a.l1 = b.l1 ELSE a.l2 = b.l2 END AS must FROM lv a JOIN lv b ON b.id - a.id IN (1, 2)), ends AS (SELECT i AS id FROM links UNION SELECT j FROM links), bo AS (SELECT i, j FROM links WHERE must UNION ALL SELECT j, i FROM links WHERE must),
 reach AS (SELECT id AS a, id AS b FROM ends UNION SELECT a, j FROM reach JOIN bo ON b = i), co AS MATERIALIZED (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1),
 apart AS MATERIALIZED (SELECT least(p.c, q.c) AS a, greatest(p.c, q.c) AS b FROM links JOIN co p ON p.id = i JOIN co q ON q.id = j WHERE NOT must), bad AS (SELECT DISTINCT a AS c FROM apart WHERE a = b)
 SELECT l.id AS i, l.id + 5 AS j, CAST(CASE WHEN p.c = q.c THEN 1 WHEN EXISTS (SELECT 1 FROM apart WHERE a <> b AND a = least(p.c, q.c) AND b = greatest(p.c, q.c)) THEN 0 ELSE -1 END AS INT) AS type,
  coalesce(p.c IN (SELECT c FROM bad), FALSE) OR coalesce(q.c IN (SELECT c FROM bad), FALSE) AS contradicted
 FROM lv l LEFT JOIN co p ON p.id = l.id LEFT JOIN co q ON q.id = l.id + 5"""
# x is the prototype; r the matrix of soft costs row by row, e what each cell passes on to the end, from the last cell back.
_SOFT = "least(diag, lft, up) - ln(exp(least(diag, lft, up) - diag) + exp(least(diag, lft, up) - lft) + exp(least(diag, lft, up) - up))"
_PASS = lambda there, k, e: f"CASE WHEN {there} THEN exp(m[{k} + 1] - m[k + 1] - (x[({k}) // len(y) + 1] - y[({k}) % len(y) + 1]) ** 2) * e[{e}] ELSE 0 END"
ORACLES["sdtw_step"] = f"""WITH RECURSIVE {DAILY}{Z}, ce AS (SELECT g, list(v ORDER BY t) AS x FROM (SELECT id % 4 AS g, t, avg(v) AS v FROM z GROUP BY 1, 2) GROUP BY g), pairs AS (SELECT id AS i, g AS j, ce.x AS x, s.x AS y FROM s JOIN ce ON g = id % 4),
run AS (
  SELECT i, j, x, y, 0 AS k, []::DOUBLE[] AS m FROM pairs
  UNION ALL
  SELECT i, j, x, y, k + 1, list_append(m, c + CASE WHEN k = 0 THEN 0 ELSE {_SOFT} END) FROM (
    SELECT *, (x[a + 1] - y[b + 1]) ** 2 AS c, CASE WHEN a > 0 AND b > 0 THEN m[k - len(y)] ELSE 'inf'::DOUBLE END AS diag, CASE WHEN b > 0 THEN m[k] ELSE 'inf'::DOUBLE END AS lft, CASE WHEN a > 0 THEN m[k + 1 - len(y)] ELSE 'inf'::DOUBLE END AS up
    FROM (SELECT *, k // len(y) AS a, k % len(y) AS b FROM run WHERE k < len(x) * len(y)))
), done AS (SELECT i, j, x, y, m FROM run WHERE k = len(x) * len(y)
), back AS (
  SELECT i, j, x, y, m, 1 AS n, [1.0]::DOUBLE[] AS e FROM done
  UNION ALL
  SELECT i, j, x, y, m, n + 1, list_append(e, {_PASS("b + 1 < len(y)", "k + 1", "n")} + {_PASS("a + 1 < len(x)", "k + len(y)", "n + 1 - len(y)")} + {_PASS("a + 1 < len(x) AND b + 1 < len(y)", "k + len(y) + 1", "n - len(y)")})
  FROM (SELECT *, k // len(y) AS a, k % len(y) AS b FROM (SELECT *, len(x) * len(y) - 1 - n AS k FROM back WHERE n < len(x) * len(y)))
), gr AS (SELECT j, k // len(y) AS t, sum(e * 2 * (x[k // len(y) + 1] - y[k % len(y) + 1])) AS g FROM (SELECT i, j, x, y, unnest(e) AS e, len(x) * len(y) - generate_subscripts(e, 1) AS k FROM back WHERE n = len(x) * len(y)) GROUP BY 1, 2),
ob AS (SELECT j, sum(m[len(m)]) AS v FROM done GROUP BY 1)
SELECT CAST(j AS INT) AS cluster, CAST(t AS INT) AS t, round(v, 6) AS objective, round(ce.x[t + 1] - 0.001 * gr.g, 6) AS value FROM gr JOIN ob USING (j) JOIN ce ON ce.g = j"""
SEGMENT = NATION.replace("SELECT c_nationkey AS id, year", "SELECT c_nationkey * (SELECT count(DISTINCT c_mktsegment) FROM customer) + place AS id, year").replace("JOIN customer ON o_custkey = c_custkey", "JOIN customer ON o_custkey = c_custkey JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)")
ORACLES["hierarchical_segments"] = ORACLES["hierarchical_clustering"].replace(DAILY, SEGMENT).replace("count(*) - 5 AS last", "count(*) - 20 AS last")
ORACLES["fuzzy_nations"] = ORACLES["fuzzy_clustering"].replace(DAILY, NATION).replace("unnest(range(11))", "unnest(range(51))").replace("LIMIT 4)", "LIMIT 5)")
