"""The same queries for DuckDB: named parts and what they need, put together as WITH clauses."""

from __future__ import annotations

STEP, WINDOW, ROUNDS = 86_400, 172_800, 80

PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, text: str, columns: str = "") -> None:
    # a part with columns of its own is recursive
    PARTS[name] = (needs, f"{name}{columns} AS {'' if columns else 'MATERIALIZED '}({text})")


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in PARTS[n][0].split():
                visit(m)
            order.append(n)

    for n in " ".join(needs).split():
        visit(n)
    return ("WITH RECURSIVE " + ",\n".join(PARTS[n][1] for n in order) + "\n" if order else "") + final


part("e", "", "SELECT * FROM (SELECT user_id AS u, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS v, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS ord FROM events) WHERE v IS NOT NULL")
part("pl", "e", f"SELECT max(ts) + 1 - {WINDOW} - CAST(floor((max(ts) - min(ts)) / {STEP}) AS BIGINT) * {STEP} AS s0, CAST(floor((max(ts) - min(ts)) / {STEP}) AS BIGINT) + 1 AS n FROM e")
part("w", "pl", f"SELECT i AS window_index, s0 + i * {STEP} AS start_ts, s0 + i * {STEP} + {WINDOW} AS end_ts FROM pl, unnest(range(CAST((SELECT n FROM pl) AS BIGINT))) AS x(i)")
part("m0", "e w", "SELECT window_index, start_ts, end_ts, u, v, ts, ord FROM e JOIN w ON ts >= start_ts AND ts < end_ts")
part("wt", "m0", "SELECT CAST(dense_rank() OVER (ORDER BY window_index) - 1 AS INTEGER) AS t, window_index, start_ts, end_ts, count(*) AS edge_count FROM m0 GROUP BY 2, 3, 4")
part("m", "wt", "SELECT t, u, v FROM m0 JOIN wt USING (window_index)")
part("s", "m", "SELECT DISTINCT t, least(u, v) AS u, greatest(u, v) AS v FROM m WHERE u <> v")
part("nd", "m", "SELECT DISTINCT t, node FROM (SELECT t, u AS node FROM m UNION ALL SELECT t, v FROM m)")
part("nt", "wt", "SELECT CAST(count(*) AS INTEGER) AS n FROM wt")
part("adj", "s", "SELECT t, u AS a, v AS b FROM s UNION ALL SELECT t, v, u FROM s")
part("deg", "adj", "SELECT t, a AS node, count(*) AS x FROM adj GROUP BY 1, 2")
part("rec", "deg adj", f"SELECT 0 AS it, t, node, x FROM deg UNION ALL SELECT it + 1, t, a, count(*) FILTER (x >= rn) FROM (SELECT r.it, adj.t, adj.a, r.x, row_number() OVER (PARTITION BY adj.t, adj.a ORDER BY r.x DESC) AS rn FROM adj JOIN rec r ON adj.t = r.t AND adj.b = r.node WHERE r.it < {ROUNDS}) GROUP BY 1, 2, 3", "(it, t, node, x)")
part("core", "nd rec", f"SELECT nd.t, nd.node, CAST(coalesce(x, 0) AS INTEGER) AS core FROM nd LEFT JOIN (SELECT * FROM rec WHERE it = {ROUNDS}) r ON nd.t = r.t AND nd.node = r.node")
part("mc", "s core", "SELECT s.t, u, v, least(a.core, b.core) AS min_core FROM s JOIN core a ON a.t = s.t AND a.node = u JOIN core b ON b.t = s.t AND b.node = v")
part("ke", "mc", "SELECT t, CAST(k AS INTEGER) AS k, u, v FROM mc, (VALUES (3), (4), (5), (6), (7)) AS x(k) WHERE min_core >= k")
part("kadj", "ke", "SELECT t, k, u AS a, v AS b FROM ke UNION SELECT t, k, v, u FROM ke UNION SELECT t, k, u, u FROM ke UNION SELECT t, k, v, v FROM ke")
part("lab", "kadj", "SELECT 0 AS it, t, k, a, min(b) FROM kadj GROUP BY 2, 3, 4 UNION ALL SELECT it + 1, kadj.t, kadj.k, kadj.a, min(l.l) FROM kadj JOIN lab l ON kadj.t = l.t AND kadj.k = l.k AND kadj.b = l.a WHERE it < 25 GROUP BY 1, 2, 3, 4", "(it, t, k, a, l)")
part("kc", "lab", "SELECT t, k, l AS component_id, a AS node FROM lab WHERE it = 25")
for _level, _below in (("h1", "deg"), ("h2", "h1"), ("h3", "h2")):
    part(_level, f"adj {_below}", f"SELECT t, a AS node, count(*) FILTER (x >= rn) AS x FROM (SELECT adj.t, a, x, row_number() OVER (PARTITION BY adj.t, a ORDER BY x DESC) AS rn FROM adj JOIN {_below} d ON d.t = adj.t AND d.node = b) GROUP BY 1, 2")
part("ns", "core deg h1 h2 h3", "SELECT c.t, c.node, CAST(coalesce(d.x, 0) AS INTEGER) AS degree, CAST(coalesce(h1.x, 0) AS INTEGER) AS h1, CAST(coalesce(h2.x, 0) AS INTEGER) AS h2, CAST(coalesce(h3.x, 0) AS INTEGER) AS h3, core FROM core c LEFT JOIN deg d ON d.t = c.t AND d.node = c.node LEFT JOIN h1 ON h1.t = c.t AND h1.node = c.node LEFT JOIN h2 ON h2.t = c.t AND h2.node = c.node LEFT JOIN h3 ON h3.t = c.t AND h3.node = c.node")
part("mx", "ns", "SELECT max(core) AS kmax, max(h1) AS hmax FROM ns")
part("cn", "adj ns", "SELECT t, a, b FROM adj UNION ALL SELECT t, node, node FROM ns")
part("cv", "ns mx", "SELECT t, node, block, least(v, hmax) AS bucket FROM (SELECT t, node, unnest(['h1', 'h2', 'h3', 'core']) AS block, unnest([h1, h2, h3, core]) AS v FROM ns), mx")
part("sh", "cn cv", "SELECT cn.t, a AS node, block, bucket, count(*) / any_value(size) AS share FROM cn JOIN (SELECT t, a, count(*) AS size FROM cn GROUP BY 1, 2) z USING (t, a) JOIN cv ON cv.t = cn.t AND cv.node = cn.b GROUP BY 1, 2, 3, 4")
part("fs", "nd", "SELECT node, min(t) AS first_t FROM nd GROUP BY 1")
part("hist", "s", "SELECT u, v, min(t) AS first_t FROM s GROUP BY 1, 2")
part("bounds", "nt", "SELECT n, CAST(floor(n * 0.7) AS INTEGER) - 1 AS a, CAST(floor(n * 0.85) AS INTEGER) AS b FROM nt")
part("smp", "fs core bounds", "SELECT CASE WHEN time < a THEN 'train' WHEN time < b THEN 'val' ELSE 'test' END AS split, x.node, time, coalesce(c.core, 0) AS label FROM (SELECT node, CAST(unnest(range(first_t, n - 1)) AS INTEGER) AS time, a, b FROM fs, bounds) x LEFT JOIN core c ON c.node = x.node AND c.t = time + 1")
part("st", "kc core", "SELECT kc.t, k, kc.node, c.core, coalesce(x.core, 0) >= k AS stays FROM kc JOIN core c ON c.t = kc.t AND c.node = kc.node LEFT JOIN core x ON x.t = kc.t + 1 AND x.node = kc.node")
MD5_UNIT = "((concat('0x', substr(md5(concat_ws(':', {key})), 1, 13))::BIGINT + 1) / 4503599627370497.0)"
part(
    "co", "st bounds",
    "SELECT node AS query, k, t, NOT stays AS empty FROM (SELECT *, least(20, count(*) FILTER (stays) OVER (PARTITION BY t, k)) AS kept, row_number() OVER (PARTITION BY t, k, stays ORDER BY -ln("
    + MD5_UNIT.format(key="42, t, k, node")
    + ") / greatest(1, core - k + 1), node) AS r FROM st, bounds WHERE t >= b AND t < n - 1) WHERE r <= CASE WHEN stays THEN 20 WHEN kept > 0 THEN least(5, greatest(1, floor(kept / 4))) ELSE 0 END",
)
part("cand", "co kc", "SELECT DISTINCT co.query, co.k, co.t, y.node FROM co JOIN kc x ON x.k = co.k AND x.node = co.query AND x.t <= co.t JOIN kc y ON y.k = x.k AND y.t = x.t AND y.component_id = x.component_id")
part("ce", "cand hist", "SELECT x.query, x.k, x.t, h.u, h.v, first_t FROM cand x JOIN hist h ON x.node = h.u AND first_t <= x.t JOIN cand y ON y.query = x.query AND y.k = x.k AND y.t = x.t AND y.node = h.v")
part("sc", "ce s", "SELECT query, k, ce.t, ce.u, ce.v, 1 - pow(0.5, sum(pow(0.5, ce.t - s.t))) AS score FROM ce JOIN s ON s.u = ce.u AND s.v = ce.v AND s.t <= ce.t GROUP BY 1, 2, 3, 4, 5")
part("pe", "sc", "SELECT query, k, t, u, v FROM sc WHERE score >= 0.5")
part("pd", "pe", "SELECT query, k, t, u AS a, v AS b FROM pe UNION ALL SELECT query, k, t, v, u FROM pe")
part("pr", "pd", "SELECT 0, query, k, t, a, count(*) FROM pd GROUP BY 2, 3, 4, 5 UNION ALL SELECT it + 1, query, k, t, a, count(*) FILTER (x >= rn) FROM (SELECT r.it, pd.query, pd.k, pd.t, pd.a, r.x, row_number() OVER (PARTITION BY pd.query, pd.k, pd.t, pd.a ORDER BY r.x DESC) AS rn FROM pd JOIN pr r ON r.query = pd.query AND r.k = pd.k AND r.t = pd.t AND r.a = pd.b WHERE r.it < 40) GROUP BY 1, 2, 3, 4, 5", "(it, query, k, t, a, x)")
part("pin", "pr", "SELECT query, k, t, a FROM pr WHERE it = 40 AND x >= k")
part("prc", "pin pd", "SELECT query, k, t, query FROM pin WHERE a = query UNION SELECT r.query, r.k, r.t, pd.b FROM prc r JOIN pd ON pd.query = r.query AND pd.k = r.k AND pd.t = r.t AND pd.a = r.node JOIN pin i ON i.query = r.query AND i.k = r.k AND i.t = r.t AND i.a = pd.b", "(query, k, t, node)")
part("tr", "co kc", "SELECT co.query, co.k, co.t, y.node FROM co JOIN kc x ON x.t = co.t + 1 AND x.k = co.k AND x.node = co.query JOIN kc y ON y.t = x.t AND y.k = x.k AND y.component_id = x.component_id")
part("bf", "co core hist", "SELECT query, k, t, query, 1, coalesce((SELECT core FROM core c WHERE c.t = co.t AND c.node = co.query), 0) FROM co UNION SELECT f.query, f.k, f.t, x.b, 0, coalesce(c.core, 0) FROM bf f JOIN (SELECT u AS a, v AS b, first_t FROM hist UNION ALL SELECT v, u, first_t FROM hist) x ON x.a = f.node AND x.first_t <= f.t LEFT JOIN core c ON c.t = f.t AND c.node = x.b WHERE f.pred >= f.k", "(query, k, t, node, is_query, pred)")
part("bn", "bf", "SELECT DISTINCT query, k, t, node, pred FROM bf")

part("okk", "core", "SELECT t, CAST(k AS INTEGER) AS k, node FROM core, (VALUES (3), (4), (5), (6), (7)) AS x(k) WHERE core >= k")
part("oka", "okk hist", "SELECT a.t, a.k, a.node AS a, b.node AS b FROM hist JOIN okk a ON a.node IN (u, v) AND first_t <= a.t JOIN okk b ON b.t = a.t AND b.k = a.k AND b.node IN (u, v)")
part("okl", "okk oka", "SELECT 0 AS it, t, k, node, node AS l FROM okk UNION ALL SELECT it + 1, oka.t, oka.k, oka.a, min(l.l) FROM oka JOIN okl l ON l.t = oka.t AND l.k = oka.k AND l.node = oka.b WHERE it < 12 GROUP BY 1, 2, 3, 4", "(it, t, k, node, l)")
part("fe", "pe prc", "SELECT pe.* FROM pe JOIN prc a ON a.query = pe.query AND a.k = pe.k AND a.t = pe.t AND a.node = pe.u JOIN prc b ON b.query = pe.query AND b.k = pe.k AND b.t = pe.t AND b.node = pe.v")
part("te", "tr s", "SELECT a.query, a.k, a.t, s.u, s.v FROM s JOIN tr a ON a.t + 1 = s.t AND a.node = s.u JOIN tr b ON b.query = a.query AND b.k = a.k AND b.t = a.t AND b.node = s.v")


def influence_parts(n: int, alpha: float = 0.3, beta: float = 0.5, top: int = 20, least: float = 1e-8, x: str = "") -> str:
    """Parts for the streaming state after each of n snapshots; the name of the last state."""
    state, norm = "(SELECT CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS node, CAST(NULL AS INTEGER) AS time, CAST(NULL AS DOUBLE) AS score WHERE false)", "(SELECT CAST(NULL AS BIGINT) AS src, CAST(NULL AS DOUBLE) AS norm WHERE false)"
    needs = "adj"
    for t in range(n):
        part(f"a{x}{t}", needs, f"SELECT a, b FROM adj WHERE t = {t}")
        part(f"d{x}{t}", f"a{x}{t}", f"SELECT d.a AS src, coalesce(o.norm, 0) AS old, {beta} * coalesce(o.norm, 0) + d.d AS norm FROM (SELECT a, count(*) AS d FROM a{x}{t} GROUP BY 1) d LEFT JOIN {norm} o ON o.src = d.a")
        part(
            f"c{x}{t}", f"d{x}{t}",
            f"SELECT src, node, time, sum(score) AS score FROM (SELECT p.src, p.node, p.time, p.score * {beta} * d.old / d.norm AS score FROM {state} p JOIN d{x}{t} d ON d.src = p.src WHERE d.old > 0 "
            f"UNION ALL SELECT a.a, a.b, {t}, {alpha * (1 - alpha)} / d.norm FROM a{x}{t} a JOIN d{x}{t} d ON d.src = a.a "
            f"UNION ALL SELECT a.a, p.node, p.time, p.score * {1 - alpha} / d.norm FROM a{x}{t} a JOIN d{x}{t} d ON d.src = a.a JOIN {state} p ON p.src = a.b) GROUP BY 1, 2, 3 HAVING sum(score) > {least}",
        )
        part(f"st{x}{t}", f"c{x}{t}", f"SELECT src, node, time, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 14) DESC, time DESC, node) AS r FROM c{x}{t}) WHERE r <= {top} UNION ALL SELECT p.* FROM {state} p WHERE p.src NOT IN (SELECT src FROM d{x}{t})")
        part(f"no{x}{t}", f"d{x}{t}", f"SELECT src, norm FROM d{x}{t} UNION ALL SELECT p.* FROM {norm} p WHERE p.src NOT IN (SELECT src FROM d{x}{t})")
        state, norm, needs = f"st{x}{t}", f"no{x}{t}", f"st{x}{t} no{x}{t}"
    if x:
        return state
    part("ans", state, f"SELECT src, node, time, score, score / sum(score) OVER (PARTITION BY src) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 14) DESC, time DESC, node) AS r FROM {state}) WHERE r <= 20")
    part("mg", "ans", "SELECT src, node, sum(score) AS score FROM ans GROUP BY 1, 2")
    # the same after every snapshot
    each = (f"SELECT {t} AS t, src, node, time, score, score / sum(score) OVER (PARTITION BY src) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 14) DESC, time DESC, node) AS r FROM st{t}) WHERE r <= 20" for t in range(n))
    part("ansall", " ".join(f"st{t}" for t in range(n)), " UNION ALL ".join(each))
    part("mga", "ansall bounds", "SELECT t, src, node, sum(score) AS score FROM ansall, bounds WHERE t >= b GROUP BY 1, 2, 3")
    return state


WIDTH = "(5 + kmax + 4)"
part(
    "fv", "smp core mx ns ansall sh",
    f"""SELECT node, time, place, sum(value) AS value FROM (
SELECT s.node, s.time, CAST(l AS INTEGER) AS place, CAST(c.core AS DOUBLE) AS value FROM smp s CROSS JOIN range(5) AS x(l) JOIN core c ON c.node = s.node AND c.t = s.time - l
UNION ALL SELECT s.node, s.time, k + 4, pow(0.7, s.time - t) * CASE WHEN core <= k THEN core / k ELSE 2 - k / core END / ((1 - pow(0.7, s.time + 1)) / (1 - 0.7)) FROM smp s JOIN core c ON c.node = s.node AND c.t <= s.time, (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx)
UNION ALL SELECT s.node, s.time, kmax + 5 + i, CAST(v AS DOUBLE) FROM smp s JOIN (SELECT t, node, unnest([0, 1, 2, 3]) AS i, unnest([degree, h1, h2, h3]) AS v FROM ns) n ON n.node = s.node AND n.t = s.time, mx
UNION ALL SELECT s.node, s.time, {WIDTH} + (list_position(['h1', 'h2', 'h3', 'core'], block) - 1) * (hmax + 1) + bucket, weight * share FROM smp s JOIN ansall a ON a.src = s.node AND a.t = s.time JOIN sh ON sh.t = a.time AND sh.node = a.node, mx
UNION ALL SELECT s.node, s.time, {WIDTH} + 4 * (hmax + 1), weight * ln(1 + a.t - a.time) FROM smp s JOIN ansall a ON a.src = s.node AND a.t = s.time, mx) GROUP BY 1, 2, 3 HAVING sum(value) <> 0""",
)
