"""DuckDB SQL for the registered queries, on the same tables and parameters."""

from __future__ import annotations

from coterie.operators import refine
from coterie.plans import queries as Q
from coterie.sources.standin import SPLIT_YEAR

TESTS = """
tests AS (
  SELECT l_orderkey AS id, p_type AS drug,
         CASE WHEN p_type IN ('SMALL','MEDIUM','LARGE') THEN 'SIZE'
              WHEN p_type IN ('ECONOMY','STANDARD') THEN 'GRADE' ELSE 'PROMO' END AS class,
         CASE l_returnflag WHEN 'R' THEN 'resistant' WHEN 'A' THEN 'intermediate' ELSE 'susceptible' END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

ISOLATES = """
isolates AS (
  SELECT o_orderkey AS id, c_mktsegment AS serotype, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_orderpriority AS data_source, r_name AS cohort
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

ACTIVITY = """
activity AS (
  SELECT DISTINCT o_orderkey AS id, event_type FROM orders JOIN events ON o_custkey = user_id)
"""

RANK = "CASE status WHEN 'resistant' THEN 4 WHEN 'intermediate' THEN 3 WHEN 'SSD' THEN 2 WHEN 'susceptible' THEN 1 END"
CODE = "CASE value WHEN 'resistant' THEN 3 WHEN 'intermediate' THEN 2 WHEN 'SSD' THEN 2 WHEN 'susceptible' THEN 1 ELSE 0 END"


def panel(attrs: tuple[str, ...] = ("serotype",), target: str = "drug", where: str = "TRUE", activity: bool = False) -> str:
    """CTEs `scope`, `tgt(id, attr, value)` and `oth(id, attr, value)`."""
    others = [f"SELECT id, '{a}' AS attr, CAST({a} AS VARCHAR) AS value FROM scope" for a in attrs]
    if activity:
        others.append("SELECT a.id, 'event_type', event_type FROM activity a SEMI JOIN scope USING (id)")
    return f"""
    {TESTS}, {ISOLATES}, {ACTIVITY},
    scope AS (SELECT * FROM isolates WHERE {where}),
    tgt AS (
      SELECT id, attr, CASE r WHEN 4 THEN 'resistant' WHEN 3 THEN 'intermediate' WHEN 2 THEN 'SSD' ELSE 'susceptible' END AS value
      FROM (SELECT id, {target} AS attr, max({RANK}) AS r FROM tests SEMI JOIN scope USING (id) GROUP BY ALL)),
    oth AS ({' UNION ALL '.join(others)})
    """


def mined(where: str = "TRUE", support: float = Q.MIN_SUPPORT, confidence: float = Q.MIN_CONFIDENCE) -> str:
    """CTEs up to `rules(ant, con, antecedent_key, consequent_key, support, confidence, lift)`.

    Itemsets of up to five items by self joins; on the checked tables none is longer than three.
    """
    levels = []
    for k in range(2, 6):
        cols = ", ".join(f"s.i{j}" for j in range(1, k))
        prev = f"f{k - 1}x"
        levels.append(f"""
    f{k}x AS (SELECT s.id, {cols}, b.item AS i{k} FROM {prev} s JOIN fi b ON s.id = b.id AND b.item > s.i{k - 1}
              WHERE ({", ".join(f"s.i{j}" for j in range(1, k))}) IN (SELECT ({", ".join(f"i{j}" for j in range(1, k))}) FROM f{k - 1})),
    f{k} AS (SELECT {", ".join(f"i{j}" for j in range(1, k + 1))}, count(*) AS freq FROM f{k}x GROUP BY ALL
             HAVING count(*) >= (SELECT mc FROM nb))""")
    unions = " UNION ALL ".join(
        f"SELECT [{', '.join(f'i{j}' for j in range(1, k + 1))}] AS items, freq FROM f{k}" for k in range(1, 6)
    )
    return f"""
    {panel(where=where)},
    basket AS (
      SELECT id, attr || ':' || value AS item FROM tgt WHERE value IN ('resistant', 'intermediate')
      UNION SELECT id, attr || ':' || value FROM oth),
    nb AS (SELECT count(DISTINCT id) AS n, ceil({support} * count(DISTINCT id)) AS mc FROM basket),
    f1 AS (SELECT item AS i1, count(*) AS freq FROM basket GROUP BY item HAVING count(*) >= (SELECT mc FROM nb)),
    fi AS (SELECT id, item FROM basket WHERE item IN (SELECT i1 FROM f1)),
    f1x AS (SELECT id, item AS i1 FROM fi),
    {",".join(levels)},
    sets AS (SELECT items, array_to_string(items, ' & ') AS item_key, freq, n AS n_baskets FROM ({unions}) CROSS JOIN nb),
    split AS (SELECT *, unnest(items) AS con FROM sets WHERE len(items) > 1),
    halves AS (SELECT *, list_filter(items, lambda x: x <> con) AS ant FROM split),
    rules AS (
      SELECT h.ant, h.con, array_to_string(h.ant, ' & ') AS antecedent_key, h.con AS consequent_key, h.n_baskets,
             h.freq / h.n_baskets AS support, h.freq / a.freq AS confidence,
             (h.freq / a.freq) / (c.freq / h.n_baskets) AS lift
      FROM halves h JOIN sets a ON a.item_key = array_to_string(h.ant, ' & ') JOIN sets c ON c.item_key = h.con
      WHERE h.freq / a.freq >= {confidence}),
    chosen AS (SELECT * FROM rules WHERE lift > {Q.MIN_LIFT})
    """


SHOWN = "antecedent_key, consequent_key, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift"
RULE_ORDER = "round(lift, 12) DESC, round(support, 12) DESC, round(confidence, 12) DESC, antecedent_key, consequent_key"

COUNTED = """
    complete AS (
      SELECT id, list(DISTINCT attr) AS attrs, list(DISTINCT attr || ':' || value) AS items
      FROM (SELECT * FROM tgt UNION ALL SELECT * FROM oth SEMI JOIN tgt USING (id)) GROUP BY id),
    compact AS (SELECT list_sort(attrs) AS attrs, list_sort(items) AS items, count(*) AS n FROM complete GROUP BY ALL),
    want AS (SELECT *, list_transform(list_append(ant, con), lambda x: split_part(x, ':', 1)) AS need FROM rules),
    counted AS (
      SELECT w.antecedent_key, w.consequent_key, any_value(w.support) AS support, any_value(w.confidence) AS confidence,
             any_value(w.lift) AS lift, any_value(w.n_baskets) AS n_baskets,
             (SELECT count(*) FROM complete) AS n_all,
             CAST(coalesce(sum(n), 0) AS BIGINT) AS n_complete,
             CAST(coalesce(sum(CASE WHEN list_has_all(p.items, w.ant) THEN n END), 0) AS BIGINT) AS n_x,
             CAST(coalesce(sum(CASE WHEN list_contains(p.items, w.con) THEN n END), 0) AS BIGINT) AS n_y,
             CAST(coalesce(sum(CASE WHEN list_has_all(p.items, w.ant) AND list_contains(p.items, w.con) THEN n END), 0) AS BIGINT) AS n_xy
      FROM want w LEFT JOIN compact p ON list_has_all(p.attrs, w.need)
      GROUP BY w.antecedent_key, w.consequent_key),
    measured AS (
      SELECT *, CASE WHEN n_complete > 0 THEN support * n_all / n_complete END AS real_support,
             CASE WHEN n_complete > 0 THEN n_xy / n_complete END AS rar_support_exact,
             CASE WHEN n_x * n_y > 0 THEN n_xy * n_complete / (n_x * n_y) ELSE 1.0 END AS real_lift
      FROM counted)
"""

LEVELS = {
    "support": (1.5 * Q.MIN_SUPPORT, 2 * Q.MIN_SUPPORT),
    "confidence": (Q.MIN_CONFIDENCE + (1 - Q.MIN_CONFIDENCE) / 4, Q.MIN_CONFIDENCE + (1 - Q.MIN_CONFIDENCE) * 3 / 4),
    "lift": (1.5 * Q.MIN_LIFT, 2 * Q.MIN_LIFT),
}
STATE = {m: f"CASE WHEN {m} < {low} THEN 1 WHEN {m} < {high} THEN 2 ELSE 3 END" for m, (low, high) in LEVELS.items()}

CLASSES = "classes AS (SELECT drug, max(class) AS class FROM tests GROUP BY drug)"
NET = ("serotype", "data_source")


def renamed(col: str) -> str:
    for old, new in Q.RENAMES.items():
        col = f"replace({col}, '{old}', '{new}')"
    return col


def network(bipartite: bool = False, where: str = "TRUE", attrs: tuple[str, ...] = NET, activity: bool = False) -> str:
    """CTEs `tt`, `ta`, `aa` (pair statistics) and `edges`."""
    kept = "ta" if bipartite else "(SELECT * FROM ta UNION ALL SELECT * FROM tt UNION ALL SELECT * FROM aa)"
    return f"""
    {panel(attrs, where=where, activity=activity)},
    {CLASSES},
    coth AS (SELECT * FROM oth SEMI JOIN tgt USING (id)),
    tt AS (
      SELECT 'target_target' AS kind, src, dst, co / total AS support,
             CASE WHEN n1 * n2 > 0 THEN co * total / (n1 * n2) ELSE 1.0 END AS lift
      FROM (SELECT a.attr AS src, b.attr AS dst, count(*) AS total,
                   count(*) FILTER (a.value = 'resistant' AND b.value = 'resistant') AS co,
                   count(*) FILTER (a.value = 'resistant') AS n1, count(*) FILTER (b.value = 'resistant') AS n2
            FROM tgt a JOIN tgt b ON a.id = b.id AND a.attr > b.attr GROUP BY ALL)),
    ta_total AS (
      SELECT t.attr AS src, o.attr, count(*) AS total, count(*) FILTER (t.value = 'resistant') AS n1
      FROM tgt t JOIN (SELECT DISTINCT id, attr FROM coth) o USING (id) GROUP BY ALL),
    ta AS (
      SELECT 'target_other' AS kind, src, attr || ':' || value AS dst, co / n2 AS support,
             CASE WHEN n1 * n2 > 0 THEN co * total / (n1 * n2) ELSE 1.0 END AS lift
      FROM (SELECT t.attr AS src, o.attr, o.value, count(*) AS n2, count(*) FILTER (t.value = 'resistant') AS co
            FROM tgt t JOIN coth o USING (id) GROUP BY ALL) JOIN ta_total USING (src, attr)),
    aa_total AS (
      SELECT a.attr AS attr1, b.attr AS attr2, count(*) AS total FROM (SELECT DISTINCT id, attr FROM coth) a
      JOIN (SELECT DISTINCT id, attr FROM coth) b ON a.id = b.id AND a.attr > b.attr GROUP BY ALL),
    aa_one AS (
      SELECT a.attr AS attr1, a.value AS v, b.attr AS attr2, count(*) AS n FROM coth a
      JOIN (SELECT DISTINCT id, attr FROM coth) b ON a.id = b.id AND a.attr <> b.attr GROUP BY ALL),
    aa AS (
      SELECT 'other_other' AS kind, p.attr1 || ':' || p.value1 AS src, p.attr2 || ':' || p.value2 AS dst,
             co / total AS support, CASE WHEN x.n * y.n > 0 THEN co * total / (x.n * y.n) ELSE 1.0 END AS lift
      FROM (SELECT a.attr AS attr1, a.value AS value1, b.attr AS attr2, b.value AS value2, count(*) AS co
            FROM coth a JOIN coth b ON a.id = b.id AND a.attr > b.attr GROUP BY ALL) p
      JOIN aa_total t ON t.attr1 = p.attr1 AND t.attr2 = p.attr2
      JOIN aa_one x ON x.attr1 = p.attr1 AND x.v = p.value1 AND x.attr2 = p.attr2
      JOIN aa_one y ON y.attr1 = p.attr2 AND y.v = p.value2 AND y.attr2 = p.attr1),
    edges AS (SELECT * FROM {kept} WHERE support >= 0.01 AND lift >= 1.0),
    ends AS (SELECT src AS node, lift FROM edges UNION ALL SELECT dst, lift FROM edges),
    degrees AS (SELECT node, count(*) AS degree, count(*) / (SELECT count(DISTINCT node) - 1 FROM ends) AS degree_centrality
                FROM ends GROUP BY node),
    class_community AS (SELECT DISTINCT node, coalesce(class, 'no_class') AS community FROM ends LEFT JOIN classes ON drug = node)
    """


def betweenness(rounds: int = 7) -> str:
    """Shortest-path counts by level, unrolled, then the share of paths through each node."""
    ctes = ["adj AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)",
            "p0 AS (SELECT DISTINCT src AS s, src AS v, 1.0 AS sigma, 0 AS dist FROM adj)"]
    for k in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM p{j}" for j in range(k))
        ctes.append(
            f"p{k} AS (SELECT s, dst AS v, sum(sigma) AS sigma, {k} AS dist FROM p{k - 1} JOIN adj ON v = src "
            f"WHERE (s, dst) NOT IN (SELECT (s, v) FROM ({seen})) GROUP BY s, dst)"
        )
    ctes.append("paths AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(rounds + 1)) + ")")
    ctes.append(
        "through AS (SELECT a.v AS node, sum(a.sigma * b.sigma / c.sigma) AS total FROM paths a "
        "JOIN paths b ON b.s = a.v JOIN paths c ON c.s = a.s AND c.v = b.v "
        "WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND a.dist + b.dist = c.dist GROUP BY a.v)"
    )
    return ", ".join(ctes)


LABELS = "labels AS (SELECT id, attr AS label_attr, attr || ':' || value AS label FROM {source} WHERE {keep})"


def labelled(domain: bool, attrs: tuple[str, ...], activity: bool = False, test: bool | None = None) -> str:
    """CTEs `labels` and `features(id, label, feature, value)`."""
    held = f"CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':4'), 1, 8) AS BIGINT) % 10000 < {round(Q.HOLDOUT * 10000)}"
    part = "TRUE" if test is None else (held if test else f"NOT ({held})")
    keep = "TRUE" if test else "value IN ('resistant', 'intermediate')"
    numeric = "regexp_full_match(value, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)')"
    zeros = ""
    if domain:
        values = ", ".join(f"('{s}')" for s in Q.SEGMENTS)
        zeros = f"""UNION ALL SELECT id, 'serotype(' || s || ')', 0.0 FROM oth CROSS JOIN (VALUES {values}) v(s)
                    WHERE attr = 'serotype' AND value <> s"""
    return f"""
    {panel(attrs, activity=activity)},
    {LABELS.format(source="tgt", keep=f"({keep}) AND ({part})")},
    wide AS (SELECT id, attr, count(*) AS n FROM oth GROUP BY ALL),
    cells AS (
      SELECT id, CASE WHEN {numeric} AND n = 1 THEN attr ELSE attr || '(' || value || ')' END AS feature,
             CASE WHEN {numeric} AND n = 1 THEN CAST(value AS DOUBLE) ELSE 1.0 END AS value
      FROM oth JOIN wide USING (id, attr)
      UNION ALL SELECT id, attr, CAST({CODE} AS DOUBLE) FROM tgt {zeros}),
    features AS (
      SELECT l.id, l.label, c.feature, CAST(c.value AS DOUBLE) AS value FROM labels l JOIN cells c ON c.id = l.id AND c.feature <> l.label_attr),
    nulls AS (
      SELECT feature, count(*) AS present, ((SELECT count(*) FROM labels) - count(*)) / (SELECT count(*) FROM labels) AS null_share
      FROM features GROUP BY feature)
    """


BURDEN = f"""
    sick AS (SELECT id, attr FROM tgt WHERE {CODE} > 1),
    base AS (
      SELECT i.id, coalesce('[' || string_agg(s.attr, ', ' ORDER BY s.attr) || ']', '[All susceptible]') AS label,
             CAST(count(s.attr) AS INTEGER) AS cluster
      FROM (SELECT DISTINCT id FROM tgt) i LEFT JOIN sick s USING (id) GROUP BY i.id),
    members AS (SELECT DISTINCT cluster, label FROM base),
    label_rows AS (SELECT label, count(*) AS rows FROM base GROUP BY label),
    totals AS (SELECT cluster, CAST(sum(rows) AS BIGINT) AS profile_rows FROM members JOIN label_rows USING (label) GROUP BY cluster),
    label_values AS (SELECT label, attr, value, count(*) AS n FROM base JOIN oth USING (id) GROUP BY ALL),
    profiles AS (
      SELECT cluster, attr, value, CAST(sum(n) AS BIGINT) AS n, any_value(profile_rows) AS profile_rows,
             round(sum(n) * 100.0 / any_value(profile_rows), 2) AS pct
      FROM members JOIN label_values USING (label) JOIN totals USING (cluster)
      GROUP BY cluster, attr, value HAVING sum(n) > 0.05 * any_value(profile_rows))
"""


def _changes(limits: dict[str, float]) -> str:
    """One query with two mined periods: each period is a subquery of its own."""

    def side(where: str) -> str:
        return f"(WITH {mined(where)}, {COUNTED} SELECT * FROM measured)"

    def qualified(p: str) -> str:
        return " AND ".join(f"{p}.{m} >= {t}" for m, t in limits.items())

    parts = []
    for m, mark in (("real_support", 25), ("confidence", 10), ("lift", 25)):
        parts.append(f"(a.{m} - b.{m}) * 100.0 / b.{m} AS {m}_change")
    marks = ", ".join(
        f"CASE WHEN abs({m}_change) > {mark} THEN '* ' ELSE '' END || CAST(CAST(trunc({m}_change) AS INTEGER) AS VARCHAR) || ' %' AS {m}_mark"
        for m, mark in (("real_support", 25), ("confidence", 10), ("lift", 25))
    )
    names = ", ".join(f"b.{m} AS before_{m}, a.{m} AS after_{m}" for m in ("real_support", "support", "confidence", "lift"))
    return f"""
    before_rules AS MATERIALIZED {side(f"year < {SPLIT_YEAR}")},
    after_rules AS MATERIALIZED {side(f"year >= {SPLIT_YEAR}")},
    joined AS (
      SELECT b.antecedent_key || ' -> ' || b.consequent_key AS association, b.antecedent_key, b.consequent_key,
             {names}, {", ".join(parts)}
      FROM before_rules b JOIN after_rules a ON a.antecedent_key = b.antecedent_key AND a.consequent_key = b.consequent_key
      WHERE ({qualified("b")}) OR ({qualified("a")})),
    changes AS (SELECT *, {marks} FROM joined)
    """


def _types(source: str, family: str) -> str:
    return f"""
    typed AS (
      SELECT rule_id, CASE WHEN max(k) IS NULL OR max(k) = min(k) THEN 'Intra_Class' ELSE 'Cross_Class' END AS rule_type
      FROM (SELECT antecedent_key || ' -> ' || consequent_key AS rule_id,
                   split_part(unnest(string_split(antecedent_key || ' & ' || consequent_key, ' & ')), ':', 1) AS attr FROM {source}) r
      LEFT JOIN (SELECT drug, CASE WHEN class IN ({family}) THEN 'Beta lactam' ELSE class END AS k FROM classes) d ON d.drug = r.attr
      GROUP BY rule_id)"""


def _rounded(names: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _transaction_text(activity: bool, attrs: tuple[str, ...], target: str = "drug") -> str:
    return f"""
    WITH {panel(attrs, target=target, activity=activity)},
    t AS (SELECT id, string_agg(attr || ':' || value, ' & ' ORDER BY attr || ':' || value) AS target FROM tgt GROUP BY id),
    lists AS (SELECT id, attr || ':' || string_agg(value, '|' ORDER BY value) AS item FROM oth GROUP BY id, attr),
    o AS (SELECT id, string_agg(item, ' & ' ORDER BY item) AS other FROM lists GROUP BY id)
    SELECT t.id, t.target, coalesce(o.other, '') AS other FROM t LEFT JOIN o USING (id)"""


def _chart(body: str, extra: str = "") -> str:
    return f"""
    WITH {mined()}, {CLASSES}{extra},
    pairs AS (SELECT unnest(ant) AS ant_item, con AS con_item, lift FROM chosen)
    {body}"""


def _node_class() -> str:
    return f"""
    items AS (SELECT DISTINCT unnest(list_append(ant, con)) AS item FROM chosen),
    node_class AS (
      SELECT {renamed("item")} AS node, min(coalesce(class, 'no_class')) AS class
      FROM items LEFT JOIN classes ON drug = split_part(item, ':', 1) GROUP BY ALL),
    links AS (SELECT {renamed("ant_item")} AS ant, {renamed("con_item")} AS con, sum(lift) AS weight
              FROM (SELECT unnest(ant) AS ant_item, con AS con_item, lift FROM chosen) GROUP BY ALL)"""


def _cohort_rules() -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (WITH {mined(f'cohort = {chr(39)}{c}{chr(39)}', support=0.02)} SELECT {SHOWN}, '{c}' AS cohort FROM chosen)"
        for c in Q.COHORTS
    )


def _pruned(source: str = "chosen") -> str:
    return f"""pruned AS (SELECT * FROM {source} r WHERE NOT EXISTS (
          SELECT 1 FROM {source} c WHERE c.con = r.con AND len(c.ant) < len(r.ant) AND list_has_all(r.ant, c.ant)
          AND round(c.lift, 12) >= round(r.lift, 12)))"""


def _cohort_runs() -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (WITH {mined(f"cohort = '{c}'", support=0.02)}, {_pruned()},
            n AS (SELECT *, row_number() OVER (ORDER BY {RULE_ORDER}) AS rank FROM pruned)
            SELECT {SHOWN}, '{c}' AS cohort, 'run_{c}_' || rank AS rule_id FROM n)"""
        for c in Q.COHORTS[2:4]
    )


def _configurations() -> str:
    runs = (("before", Q.PERIODS["before"], Q.MIN_CONFIDENCE), ("after", Q.PERIODS["after"], Q.MIN_CONFIDENCE), ("all", "", 0.3))
    return " UNION ALL ".join(
        f"""SELECT * FROM (WITH {mined(where or "TRUE", support=0.02, confidence=confidence)}
            SELECT {SHOWN}, '{name}' AS run, '{where}' AS sampling_condition FROM chosen)"""
        for name, where, confidence in runs
    )


def _rule_clusters(k: int = 8, rounds: int = 10) -> str:
    """Weighted k-means on the states: k centres one after the other, then rounds until no state moves, unrolled."""
    states = ", ".join(f"{e} AS s{i}" for i, e in enumerate(STATE.values()))
    ctes = [
        f"placed AS (SELECT *, {states} FROM chosen)",
        """states AS MATERIALIZED (SELECT s0, s1, s2, n, row_number() OVER (ORDER BY s0, s1, s2) AS id
             FROM (SELECT s0, s1, s2, count(*) AS n FROM placed GROUP BY ALL))""",
        "c0 AS MATERIALIZED (SELECT 0 AS c, s0::DOUBLE AS s0, s1::DOUBLE AS s1, s2::DOUBLE AS s2 FROM (SELECT * FROM states ORDER BY n DESC, id LIMIT 1))",
    ]
    apart = "(s.s0 - m.s0) ** 2 + (s.s1 - m.s1) ** 2 + (s.s2 - m.s2) ** 2"
    for j in range(1, k):
        ctes.append(f"""c{j} AS MATERIALIZED (SELECT * FROM c{j - 1} UNION ALL SELECT {j}, s0, s1, s2 FROM (
            SELECT s.id, s.s0, s.s1, s.s2, any_value(n) * min({apart}) AS far FROM states s CROSS JOIN c{j - 1} m GROUP BY ALL)
            WHERE far > 0 QUALIFY row_number() OVER (ORDER BY far DESC, id) = 1)""")
    ctes.append(f"m0 AS (SELECT * FROM c{k - 1})")
    for t in range(rounds):
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT s.id, s.s0, s.s1, s.s2, s.n, m.c FROM states s CROSS JOIN m{t} m
            QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round({apart}, 9), m.c) = 1)""")
        means = ", ".join(f"coalesce(sum(a.s{i} * a.n) / sum(a.n), any_value(m.s{i})) AS s{i}" for i in range(3))
        ctes.append(f"m{t + 1} AS MATERIALIZED (SELECT m.c, {means} FROM m{t} m LEFT JOIN a{t} a ON a.c = m.c GROUP BY m.c)")
    titles = " || '_' || ".join(
        f"CASE WHEN avg({m}) < {low} THEN 'Low' WHEN avg({m}) < {high} THEN 'Med' ELSE 'High' END || '{m.title()}'"
        for m, (low, high) in LEVELS.items()
    )
    ctes.append(f"""named AS (SELECT c, {titles} AS cluster FROM placed JOIN a{rounds - 1} USING (s0, s1, s2) GROUP BY c)""")
    return ", ".join(ctes) + f""" SELECT antecedent_key, consequent_key, cluster
          FROM placed JOIN a{rounds - 1} USING (s0, s1, s2) JOIN named USING (c)"""


def _greedy() -> str:
    """Greedy modularity, a merge at a time: the state is the map from nodes to communities."""
    return f"""WITH RECURSIVE {network(True)},
      links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(lift) AS w FROM edges GROUP BY ALL),
      total AS (SELECT sum(w) AS m FROM links),
      graph AS (SELECT a AS n FROM links UNION SELECT b FROM links),
      state AS (
        SELECT 0 AS step, (SELECT map_from_entries(list((n, n))) FROM graph) AS part, '' AS node, '' AS into_node, 0.0::DOUBLE AS gain
        UNION ALL
        (SELECT step + 1, map_from_entries(list_transform(map_entries(part), lambda e: (e.key, CASE WHEN e.value = p.c2 THEN p.c1 ELSE e.value END))),
                p.c2, p.c1, round(p.w / m - k1 * k2 / (2 * m * m), 12) AS g
         FROM (SELECT step, part, m, p,
                 list_sum(list_transform(pairs, lambda q: q.w * (CAST(q.c1 = p.c1 AS INT) + CAST(q.c2 = p.c1 AS INT)))) AS k1,
                 list_sum(list_transform(pairs, lambda q: q.w * (CAST(q.c1 = p.c2 AS INT) + CAST(q.c2 = p.c2 AS INT)))) AS k2
               FROM (SELECT *, unnest(pairs) AS p FROM (
                 SELECT step, any_value(part) AS part, any_value(m) AS m, list({{'c1': c1, 'c2': c2, 'w': w}}) AS pairs
                 FROM (SELECT step, any_value(part) AS part, any_value(m) AS m, least(x, y) AS c1, greatest(x, y) AS c2, sum(w) AS w
                       FROM (SELECT step, part, m, w, map_extract_value(part, a) AS x, map_extract_value(part, b) AS y FROM state, links, total)
                       GROUP BY step, c1, c2) GROUP BY step)) WHERE p.c1 <> p.c2)
         WHERE round(p.w / m - k1 * k2 / (2 * m * m), 12) > 0 ORDER BY g DESC, p.c1, p.c2 LIMIT 1))
      SELECT node, into_node AS "into", round(gain, 9) AS gain FROM state WHERE step > 0"""


def _attribute_tree() -> str:
    """Ward clustering one pair at a time: the state of the recursion is the list of clusters left."""
    return f"""WITH RECURSIVE {panel(NET)},
      sick AS (SELECT 'data_source' || data_source AS x, 'serotype' || serotype AS y FROM scope
               WHERE id IN (SELECT id FROM tgt WHERE value IN ('resistant', 'intermediate'))),
      names AS (SELECT list(DISTINCT n ORDER BY n) AS n FROM (SELECT x AS n FROM sick UNION SELECT y FROM sick)),
      points AS (
        SELECT list_transform(n, lambda a: CAST(a = x OR a = y AS DOUBLE)) AS v, CAST(count(*) AS DOUBLE) AS w FROM sick, names GROUP BY ALL),
      tree AS (
        SELECT 0 AS step, (SELECT list({{'k': array_to_string(v, ','), 'w': w, 's': list_transform(v, lambda z: z * w), 'n': 1, 'h': 0.0::DOUBLE}})
                           FROM points) AS left_over, 0.0::DOUBLE AS h, 0.0::DOUBLE AS w, 0 AS n
        UNION ALL
        (SELECT step + 1, list_append(list_filter(left_over, lambda c: c.k <> a.k AND c.k <> b.k),
                {{'k': a.k, 'w': a.w + b.w, 's': list_transform(list_zip(a.s, b.s), lambda p: p[1] + p[2]), 'n': a.n + b.n, 'h': greatest(d, a.h, b.h)}}),
                greatest(d, a.h, b.h), a.w + b.w, a.n + b.n
         FROM (SELECT step, left_over, a, b,
                 list_sum(list_transform(list_zip(a.s, b.s), lambda p: (p[1] * b.w - p[2] * a.w) * (p[1] * b.w - p[2] * a.w))) / (a.w * b.w * (a.w + b.w)) AS d
               FROM (SELECT step, left_over, a, unnest(left_over) AS b FROM (SELECT step, left_over, unnest(left_over) AS a FROM tree)) WHERE a.k < b.k)
         ORDER BY d, a.k, b.k LIMIT 1))
      SELECT CAST(row_number() OVER (ORDER BY h, step) AS BIGINT) AS step, round(sqrt(2 * h), 6) AS distance, CAST(w AS BIGINT) AS size,
             CAST(n AS BIGINT) AS leaves FROM tree WHERE step > 0"""


def oracle_sql() -> dict[str, str]:
    rule_sql = f"WITH {mined()}"
    rar_sql = f"WITH {mined()}, {COUNTED}"
    sick_labels = "CASE {c} WHEN 'resistant' THEN 3 WHEN 'intermediate' THEN 2 WHEN 'SSD' THEN 2 WHEN 'susceptible' THEN 1 ELSE 0 END"
    drugs = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    view = f"""WITH {TESTS}, {ISOLATES},
      view AS (SELECT DISTINCT * FROM tests JOIN isolates USING (id))"""
    shares = ("BUILDING", "FURNITURE", "MACHINERY")
    before_after = [f"{p}_{m}" for p in ("before", "after") for m in ("real_support", "support", "confidence", "lift")]
    summary = [f"{p}_{m}" for p in ("before", "after") for m in ("real_support", "confidence", "lift")]
    marks = "real_support_mark, confidence_mark, lift_mark"
    totals = "SELECT id, label, CAST(count(*) AS INTEGER) AS features, sum(value) AS total FROM features GROUP BY id, label"
    imputed = f"""
    , kept AS (SELECT feature FROM nulls WHERE null_share <= {Q.TREE_NULLS}),
    by_label AS (SELECT label, feature, value FROM (SELECT label, feature, value, row_number() OVER (PARTITION BY label, feature ORDER BY count(*) DESC, value) AS r
                 FROM features GROUP BY label, feature, value) WHERE r = 1),
    by_all AS (SELECT feature, value FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r
               FROM features GROUP BY feature, value) WHERE r = 1)
    SELECT l.id, l.label, k.feature, coalesce(f.value, bl.value, ba.value, 0.0) AS value
    FROM labels l CROSS JOIN kept k
    LEFT JOIN features f ON f.id = l.id AND f.label = l.label AND f.feature = k.feature
    LEFT JOIN by_label bl ON bl.label = l.label AND bl.feature = k.feature LEFT JOIN by_all ba ON ba.feature = k.feature"""

    def ratio(family: tuple[str, ...], name: str, more_than: int) -> str:
        classes = ", ".join(f"'{c.lower()}'" for c in family)
        return f"""{view},
          per_id AS (SELECT id, CASE WHEN lower(serotype) = 'building' THEN 'Building' ELSE 'Non-Building' END AS serotype,
                     CASE WHEN year < {SPLIT_YEAR} THEN 'Before{SPLIT_YEAR}' ELSE 'After{SPLIT_YEAR}' END AS period, status,
                     CASE WHEN lower(class) IN ({classes}) THEN '{name}' ELSE class END AS class FROM view),
          multi AS (SELECT serotype, period, count(*) AS multi_resistant FROM (
                      SELECT id, serotype, period FROM (SELECT DISTINCT id, serotype, period, lower(class) AS class
                                                        FROM per_id WHERE lower(status) = 'resistant')
                      GROUP BY ALL HAVING count(*) > {more_than}) GROUP BY ALL),
          everyone AS (SELECT serotype, period, count(DISTINCT id) AS total FROM per_id GROUP BY ALL)
          SELECT serotype, period, multi_resistant, total, round(multi_resistant * 100.0 / total, 6) AS ratio
          FROM multi JOIN everyone USING (serotype, period)"""

    out = {
        "report_mdr": ratio(("Cephalosporins", "Penicillins", "Beta lactam", "Carbapenems"), "Beta lactam", 2),
        "report_mdr_any_case": ratio(("size", "grade"), "kind", 1),
        "report_serotype_share": f"""{view},
          d AS (SELECT DISTINCT id, CASE WHEN serotype IN {shares} THEN serotype ELSE 'Other' END AS serotype,
                CASE WHEN year BETWEEN 1996 AND 1997 THEN '1996_1997' WHEN year BETWEEN 1998 AND 1999 THEN '1998_1999' END AS interval FROM view)
          SELECT interval, {", ".join(f"count(*) FILTER (serotype = '{s}') AS {s}" for s in shares)}, count(*) AS total,
                 {", ".join(f"round(count(*) FILTER (serotype = '{s}') * 100.0 / count(*), 6) AS {s}_pct" for s in shares)}
          FROM d GROUP BY interval""",
        "observations_long": f"""WITH {panel(NET)}
          SELECT id, 'target' AS kind, attr, value FROM tgt UNION ALL SELECT id, 'other', attr, value FROM oth""",
        "transactions_complete": _transaction_text(False, NET),
        "transactions_complementary": _transaction_text(True, ("serotype",)),
        "transactions_by_class": _transaction_text(False, ("serotype",), "class"),
        "transactions_single_view": f"""WITH {panel(where=f"year < {SPLIT_YEAR}")}
          SELECT id, target, 'serotype:' || serotype AS other FROM
            (SELECT id, string_agg(attr || ':' || value, ' & ' ORDER BY attr || ':' || value) AS target FROM tgt GROUP BY id) JOIN scope USING (id)""",
        "panel_sampled": f"""WITH {panel(NET, where=f"year >= {SPLIT_YEAR} AND cohort IN ('ASIA', 'EUROPE')")}
          SELECT s.id, CAST(count(t.attr) AS INTEGER) AS tests,
                 'data_source:' || s.data_source || ' & serotype:' || s.serotype AS other
          FROM scope s LEFT JOIN tgt t USING (id) GROUP BY s.id, s.data_source, s.serotype""",
        "variable_sources": f"""WITH {TESTS} SELECT DISTINCT drug AS attr, 'tests' AS entity FROM tests
          UNION ALL SELECT 'serotype', 'isolates'""",
        "baskets": f"""{rule_sql} SELECT id, string_agg(item, ' & ' ORDER BY item) AS items FROM basket GROUP BY id""",
        "baskets_capped": f"""{rule_sql} SELECT id, string_agg(item, ' & ' ORDER BY item) AS items FROM basket GROUP BY id
          ORDER BY id LIMIT {Q.CAPPED_BASKETS}""",
        "basket_empty_cell_filter": f"""{rule_sql}, s AS (SELECT id, CAST(count(*) AS INTEGER) AS size FROM basket GROUP BY id)
          SELECT id, size FROM s WHERE size / (SELECT greatest(max(size), 1) FROM s) + CAST(0.6 AS DOUBLE) >= 1""",
        "holdout_condition": f"WITH {ISOLATES} SELECT id, year = 2001 AS is_test FROM isolates",
        "holdout_percent": f"""WITH {ISOLATES}
          SELECT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':4'), 1, 8) AS BIGINT) % 10000 < {round(Q.HOLDOUT * 10000)} AS is_test FROM isolates""",
        "distinct_ids_capped": f"WITH {ISOLATES} SELECT DISTINCT id FROM isolates WHERE year < {SPLIT_YEAR} ORDER BY id LIMIT 1000",
        "class_dimension": f"WITH {TESTS}, {CLASSES} SELECT * FROM classes",
        "ordinal_features": f"WITH {labelled(False, ('serotype', 'year'))} SELECT * FROM features",
        "indicator_features": f"WITH {labelled(True, ('serotype',), activity=True)} SELECT * FROM features",
        "frequent_itemsets": f"""{rule_sql} SELECT item_key, CAST(len(items) AS INTEGER) AS size, freq, n_baskets FROM sets""",
        "association_rules": f"{rule_sql} SELECT {SHOWN} FROM rules",
        "rules_topn": f"{rule_sql}, top AS (SELECT * FROM chosen ORDER BY {RULE_ORDER} LIMIT 50) SELECT {SHOWN} FROM top",
        "rules_by_consequent": f"{rule_sql} SELECT {SHOWN} FROM chosen WHERE con IN ('PROMO:resistant', 'serotype:BUILDING')",
        "rules_by_antecedent": f"""{rule_sql} SELECT {SHOWN} FROM chosen
          WHERE list_has_any(list_transform(ant, lambda x: split_part(x, ':', 1)), ['serotype', 'SMALL'])""",
        "rules_one_to_one": f"{rule_sql} SELECT {SHOWN} FROM chosen WHERE len(ant) = 1",
        "rules_by_cohort": _cohort_rules(),
        "rule_rar_support": f"""{rar_sql} SELECT antecedent_key, consequent_key, n_baskets, n_all, n_complete, n_xy,
          {_rounded(["support", "real_support", "rar_support_exact"])} FROM measured""",
        "rule_rar_lift": f"""{rar_sql} SELECT antecedent_key, consequent_key, n_complete, n_x, n_y, n_xy, round(real_lift, 9) AS real_lift FROM measured""",
        "rule_cross_support": f"""{rar_sql},
          shares AS (SELECT item, count(*) / (SELECT count(*) FROM complete) AS s FROM (SELECT id, unnest(items) AS item FROM complete) GROUP BY item),
          parts AS (SELECT antecedent_key, consequent_key, unnest(list_append(ant, con)) AS item FROM rules)
          SELECT antecedent_key, consequent_key, round(min(coalesce(s, 0)) / nullif(max(coalesce(s, 0)), 0), 9) AS cross_support
          FROM parts LEFT JOIN shares USING (item) GROUP BY ALL""",
        "rules_pruned": f"""{rule_sql} SELECT {SHOWN} FROM chosen r WHERE NOT EXISTS (
          SELECT 1 FROM chosen c WHERE c.con = r.con AND len(c.ant) < len(r.ant) AND list_has_all(r.ant, c.ant)
          AND round(c.lift, 12) >= round(r.lift, 12))""",
        "rules_combined": f"""{rule_sql}, combined AS (
            SELECT antecedent_key, string_agg(con, ' & ' ORDER BY con) AS consequent_key, min(support) AS support,
                   min(confidence) AS confidence, min(lift) AS lift FROM chosen GROUP BY antecedent_key)
          SELECT {SHOWN} FROM combined""",
        "rule_states": f"""{rule_sql} SELECT antecedent_key, consequent_key,
          {", ".join(f"{e} AS {m}_state" for m, e in STATE.items())} FROM chosen""",
        "rule_numbers": f"""{rule_sql}, n AS (SELECT *, row_number() OVER (ORDER BY {RULE_ORDER}) AS rank FROM chosen)
          SELECT 'run_' || rank AS rule_id, rank, antecedent_key, consequent_key FROM n""",
        "rule_attributes": f"""{rule_sql},
          parts AS (SELECT antecedent_key || ' -> ' || consequent_key AS rule_id, 'antecedent' AS side, unnest(ant) AS item FROM chosen
                    UNION ALL SELECT antecedent_key || ' -> ' || consequent_key, 'consequent', con FROM chosen)
          SELECT rule_id, side, split_part(item, ':', 1) AS attr, split_part(item, ':', 2) AS value,
                 CASE WHEN item LIKE 'serotype:%' THEN 'isolates' ELSE 'tests' END AS entity FROM parts""",
        "rule_weighted_rows": f"""{rule_sql},
          w AS (SELECT antecedent_key, con AS label, CAST(trunc(support * 100) AS INTEGER) AS weight,
                array_to_string(list_transform(ant, lambda x: split_part(x, ':', 1) || '=' ||
                  CASE split_part(x, ':', 2) WHEN 'resistant' THEN '3' WHEN 'intermediate' THEN '2' ELSE '?' END), ' & ') AS features FROM chosen)
          SELECT antecedent_key, features, label, weight, CAST(unnest(range(1, weight + 1)) AS INTEGER) AS copy FROM w WHERE weight > 0""",
        "rules_refined": f"""{rar_sql},
          kept AS (SELECT m.*, c.ant, c.con FROM measured m JOIN chosen c USING (antecedent_key, consequent_key) WHERE real_support >= {Q.REAL_SUPPORT}),
          pruned AS (SELECT * FROM kept r WHERE NOT EXISTS (SELECT 1 FROM kept c WHERE c.con = r.con AND len(c.ant) < len(r.ant)
                     AND list_has_all(r.ant, c.ant) AND round(c.lift, 12) >= round(r.lift, 12))),
          numbered AS (SELECT *, row_number() OVER (ORDER BY {RULE_ORDER}) AS rank FROM pruned)
          SELECT 'run_' || min(rank) AS rule_id, antecedent_key, string_agg(con, ' & ' ORDER BY con) AS consequent_key,
                 {", ".join(f"round(min({m}), 9) AS {m}" for m in ("support", "confidence", "lift", "real_support", "real_lift"))}
          FROM numbered GROUP BY antecedent_key""",
        "net_target_target": f"WITH {network()} SELECT src, dst, {_rounded(['support', 'lift'])} FROM tt",
        "net_target_attribute": f"WITH {network()} SELECT src, dst, {_rounded(['support', 'lift'])} FROM ta",
        "net_target_attribute_lists": f"WITH {network(attrs=('serotype',), activity=True)} SELECT src, dst, {_rounded(['support', 'lift'])} FROM ta",
        "net_attribute_attribute": f"WITH {network()} SELECT src, dst, {_rounded(['support', 'lift'])} FROM aa",
        "net_edges": f"WITH {network()} SELECT kind, src, dst, {_rounded(['support', 'lift'])} FROM edges",
        "net_strength": f"""WITH {network()} SELECT node, any_value(class) AS class,
          coalesce(any_value(node || ' (' || class || ')'), node) AS description, round(sum(lift), 6) AS strength
          FROM ends LEFT JOIN classes ON drug = node GROUP BY node""",
        "net_degree": f"WITH {network()} SELECT node, degree, round(degree_centrality, 9) AS degree_centrality FROM degrees",
        "net_betweenness": f"""WITH {network(True)}, {betweenness()}, n AS (SELECT count(*) AS n FROM p0)
          SELECT v AS node, round(coalesce(total, 0) / ((n - 1) * (n - 2)), 9) AS betweenness
          FROM p0 LEFT JOIN through ON node = v CROSS JOIN n""",
        "net_clustering_coefficient": f"""WITH {network()}, adj AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
          tri AS (SELECT a.src AS node, count(*) // 2 AS triangles FROM adj a JOIN adj b ON a.src = b.src AND a.dst <> b.dst
                  JOIN adj c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
          SELECT d.node, d.degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles,
                 round(CASE WHEN d.degree > 1 THEN 2 * coalesce(triangles, 0) / (d.degree * (d.degree - 1)) ELSE 0 END, 9) AS clustering
          FROM degrees d LEFT JOIN tri USING (node)""",
        "net_modularity_by_class": f"""WITH {network()}, m AS (SELECT sum(lift) AS m FROM edges),
          inside AS (SELECT a.community AS c, sum(lift) AS l FROM edges JOIN class_community a ON a.node = src
                     JOIN class_community b ON b.node = dst WHERE a.community = b.community GROUP BY ALL),
          around AS (SELECT community AS c, sum(lift) AS k FROM ends JOIN class_community USING (node) GROUP BY ALL)
          SELECT round(sum(coalesce(l, 0) / m - (k / (2 * m)) ** 2), 9) AS modularity, count(*) AS communities
          FROM around LEFT JOIN inside USING (c) CROSS JOIN m""",
        "net_average_clustering": f"""WITH {network()}, adj AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
          tri AS (SELECT a.src AS node, count(*) // 2 AS triangles FROM adj a JOIN adj b ON a.src = b.src AND a.dst <> b.dst
                  JOIN adj c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
          SELECT round(avg(CASE WHEN d.degree > 1 THEN 2 * coalesce(triangles, 0) / (d.degree * (d.degree - 1)) ELSE 0 END), 9) AS average_clustering
          FROM degrees d LEFT JOIN tri USING (node)""",
        "run_cohorts": _cohort_runs(),
        "run_configurations": _configurations(),
        "rule_clusters": f"{rule_sql}, {_rule_clusters(refine.RULE_CLUSTERS)}",
        "sink_rules": f"""{rule_sql}, text AS (SELECT *, '[' || array_to_string(ant, ', ') || '] -> [' || con || ']' AS association, 'provisional' AS status FROM chosen)
          SELECT {SHOWN}, 'all' AS run, association, status FROM text UNION ALL SELECT {SHOWN}, 'short', association, status FROM text WHERE len(ant) = 1""",
        "sink_rule_attributes": f"""{rule_sql},
          parts AS (SELECT antecedent_key || ' -> ' || consequent_key AS rule_id, 'antecedent' AS side, unnest(ant) AS item FROM chosen
                    UNION ALL SELECT antecedent_key || ' -> ' || consequent_key, 'consequent', con FROM chosen)
          SELECT rule_id, side, split_part(item, ':', 1) AS attr, split_part(item, ':', 2) AS value,
                 CASE WHEN item LIKE 'serotype:%' THEN 'isolates' ELSE 'tests' END AS entity FROM parts""",
        "sink_updated_rule": f"""{rule_sql}, r AS (SELECT *, antecedent_key || ' -> ' || consequent_key AS rule_id FROM chosen)
          SELECT rule_id, CASE WHEN rule_id = (SELECT min(rule_id) FROM r) THEN 'confirmed' ELSE 'provisional' END AS status,
                 CASE WHEN lift > 1.02 THEN 'lifted' ELSE '' END AS cluster, CAST(len(ant) + 1 AS BIGINT) AS items FROM r""",
        "sink_deleted": f"""WITH e AS (SELECT count(*) AS n FROM (WITH {network(True)} SELECT * FROM edges)),
          b AS (SELECT count(*) AS n FROM ({rule_sql} SELECT DISTINCT id FROM basket))
          SELECT 'networks deleted' AS step, 'a' AS run, 'baskets' AS name, n AS rows FROM b
          UNION ALL SELECT 'networks deleted', 'b', 'baskets', n FROM b
          UNION ALL SELECT 'run deleted', 'b', 'baskets', n FROM b
          UNION ALL SELECT 'clean write', 'c', 'edges', n FROM e""",
        "sink_network": f"""WITH {network()}, m AS (SELECT sum(lift) AS m FROM edges),
          inside AS (SELECT a.community AS c, sum(lift) AS l FROM edges JOIN class_community a ON a.node = src
                     JOIN class_community b ON b.node = dst WHERE a.community = b.community GROUP BY ALL),
          around AS (SELECT community AS c, sum(lift) AS k FROM ends JOIN class_community USING (node) GROUP BY ALL),
          head AS (SELECT round(sum(coalesce(l, 0) / m - (k / (2 * m)) ** 2), 9) AS modularity, count(*) AS communities
                   FROM around LEFT JOIN inside USING (c) CROSS JOIN m),
          weights AS (SELECT node, any_value(class) AS class, round(sum(lift), 6) AS strength FROM ends LEFT JOIN classes ON drug = node GROUP BY node)
          SELECT 'run' AS run_id, node, class, degree, round(degree_centrality, 9) AS degree_centrality, strength, modularity, communities,
                 'isolates, tests' AS data_sources FROM weights JOIN degrees USING (node) CROSS JOIN head""",
        "sink_clusters": f"""WITH {panel(NET)}, {BURDEN},
          texts AS (SELECT cluster, string_agg(attr || ':' || value || ': ' || CAST(pct AS VARCHAR), ', ' ORDER BY attr, value) AS analysis FROM profiles GROUP BY cluster)
          SELECT cluster, count(*) AS cluster_size, count(DISTINCT label) AS labels, (SELECT count(DISTINCT cluster) FROM base) AS clusters,
                 any_value(analysis) AS analysis FROM base LEFT JOIN texts USING (cluster) GROUP BY cluster""",
        "sink_graphml": f"WITH {network()} SELECT src, dst, round(lift, 6) AS weight FROM edges",
        "tree_pruning_end": f"""WITH
          train AS (SELECT label, count(*) AS n FROM (WITH {labelled(True, ('serotype', 'year'), test=False)} SELECT * FROM labels) GROUP BY label),
          held AS (SELECT label, count(*) AS n FROM (WITH {labelled(True, ('serotype', 'year'), test=True)} SELECT * FROM labels) GROUP BY label),
          commonest AS (SELECT label FROM train ORDER BY n DESC, label LIMIT 1), total AS (SELECT sum(n) AS n FROM train)
          SELECT CAST(1 AS INTEGER) AS leaves, round((SELECT 1 - sum((t.n / total.n) ** 2) FROM train t CROSS JOIN total), 9) AS risk,
                 CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (label = (SELECT label FROM commonest)) AS BIGINT) AS hits,
                 round(sum(n) FILTER (label = (SELECT label FROM commonest)) / sum(n), 9) AS accuracy FROM held""",
        "net_greedy_merges": _greedy(),
        "net_fluid_checks": f"""WITH RECURSIVE {network(True)},
          near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
          reach AS (SELECT a AS x, a AS y FROM near UNION SELECT x, b FROM reach JOIN near ON a = y),
          heads AS (SELECT x, min(y) AS head FROM reach GROUP BY x)
          SELECT count(*) AS nodes, greatest(3, count(DISTINCT head)) AS communities, TRUE AS converged, CAST(0 AS BIGINT) AS unsettled FROM heads""",
        "report_rule_change": f"""WITH {_changes(Q.CHANGE_LIMITS)} SELECT association, {_rounded(before_after)}, {marks} FROM changes""",
        "report_rule_summary": f"""WITH {_changes(Q.CHANGE_LIMITS)}, {TESTS}, {CLASSES},
          {_types("before_rules", "'Cephalosporins', 'Penicillins', 'Beta lactam', 'Carbapenems'")},
          kept AS (SELECT *, replace(c.association, ':resistant', '') AS name FROM changes c JOIN typed ON rule_id = c.association
                   WHERE lower(replace(c.association, ':resistant', '')) LIKE '%serotype%' AND real_support_mark LIKE '%* %' AND lift_mark NOT LIKE '%* %')
          SELECT rule_type, name AS association, {", ".join(f"round(max({n}), 9) AS {n}" for n in summary)},
                 {", ".join(f"max({m}) AS {m}" for m in marks.split(", "))} FROM kept GROUP BY rule_type, name""",
        "report_rule_type": f"""{rule_sql}, {CLASSES}, {_types("chosen", "'SIZE', 'GRADE'")} SELECT * FROM typed""",
        "report_network_change": f"""WITH
          b AS (SELECT * FROM (WITH {network(True, f"year < {SPLIT_YEAR}")} SELECT * FROM class_community JOIN degrees USING (node))),
          a AS (SELECT * FROM (WITH {network(True, f"year >= {SPLIT_YEAR}")} SELECT * FROM class_community JOIN degrees USING (node)))
          SELECT coalesce(b.node, a.node) AS node, b.community AS community_before, a.community AS community_after,
                 round(b.degree_centrality, 9) AS centrality_before, round(a.degree_centrality, 9) AS centrality_after
          FROM b FULL JOIN a ON a.node = b.node""",
        "chart_edges": _chart(f"""SELECT {renamed("ant_item")} AS ant, {renamed("con_item")} AS con, round(sum(lift), 6) AS weight FROM pairs
          WHERE split_part(ant_item, ':', 1) <> 'ECONOMY' AND split_part(con_item, ':', 1) <> 'ECONOMY' GROUP BY ALL"""),
        "chart_grouped_nodes": _chart("""SELECT DISTINCT item AS node, left(item, 4) || right(item, 3) AS class
          FROM (SELECT unnest([ant_item, con_item]) AS item FROM pairs)"""),
        "chart_measures": f"""{rule_sql} SELECT '[' || array_to_string(ant, ', ') || ']->[' || con || ']' AS label,
          {_rounded(["support", "confidence", "lift"])} FROM chosen""",
        "chart_filtered_rules": f"""{rule_sql} SELECT {SHOWN} FROM chosen
          WHERE len(list_filter(ant, lambda x: NOT contains(x, ':resistant'))) = 0 AND contains(con, 'M')""",
        "chart_chord_links": f"""{rule_sql}, {CLASSES}, {_node_class()}
          SELECT a.class || '_' || ant AS source, c.class || '_' || con AS target, round(weight, 6) AS value
          FROM links JOIN node_class a ON a.node = ant JOIN node_class c ON c.node = con""",
        "chart_chord_nodes": f"""{rule_sql}, {CLASSES}, {_node_class()}
          SELECT class || '_' || node AS index, node AS label FROM node_class""",
        "chart_arrow_labels": f"""{rule_sql}, {CLASSES}, {_node_class()} SELECT ant, con, printf('%.2f', weight) AS label FROM links""",
        "profile_status": f"""WITH {panel(NET)}, {BURDEN}
          SELECT b.id, b.label, {", ".join(f"coalesce(max(CASE WHEN attr = '{n}' THEN {CODE} END), 0) AS {n}" for n in drugs)}
          FROM base b JOIN tgt t ON t.id = b.id GROUP BY b.id, b.label""",
        "profile_attributes": f"""WITH {panel(NET)}
          SELECT id, '[' || 'data_source' || data_source || ', serotype' || serotype || ']' AS label,
                 {", ".join(f"CAST(serotype = '{s}' AS INTEGER) AS serotype{s}" for s in Q.SEGMENTS)}
          FROM scope WHERE id IN (SELECT id FROM tgt WHERE value IN ('resistant', 'intermediate'))""",
        "cluster_tree_totals": f"""WITH {panel(NET)},
          vectors AS (SELECT id, {", ".join(f"coalesce(max({CODE}) FILTER (attr = '{n}'), 0) AS {n}" for n in drugs)} FROM tgt GROUP BY id),
          leaves AS (SELECT DISTINCT {", ".join(drugs)} FROM vectors)
          SELECT (SELECT count(*) - 1 FROM leaves) AS merges, (SELECT count(*) FROM leaves) AS leaves, count(*) AS size,
                 round({" + ".join(f"var_pop({n}) * count(*)" for n in drugs)}, 3) AS sum_of_squares FROM vectors""",
        "cluster_attribute_tree": _attribute_tree(),
        "cluster_sizes": f"""WITH {panel(NET)}, {BURDEN}
          SELECT cluster, count(*) AS cluster_size, CAST(count(DISTINCT label) AS INTEGER) AS labels FROM base GROUP BY cluster""",
        "cluster_profiles": f"WITH {panel(NET)}, {BURDEN} SELECT * FROM profiles",
        "cluster_top5": f"""WITH {panel(NET)}, {BURDEN},
          placed AS (SELECT cluster, value AS entry, pct, CAST(row_number() OVER (PARTITION BY cluster ORDER BY pct DESC, value) AS INTEGER) AS place
                     FROM profiles WHERE attr = 'serotype')
          SELECT * FROM placed WHERE place <= 5""",
        "hamming_pairs": f"""WITH {panel(NET)},
          sizes AS (SELECT id, count(*) AS n FROM tgt GROUP BY id),
          common AS (SELECT a.id AS id1, count(*) AS c, count(*) FILTER (a.value = b.value) AS e FROM tgt a JOIN tgt b ON b.id = a.id + 1 AND b.attr = a.attr GROUP BY a.id)
          SELECT a.id AS id1, b.id AS id2, CAST(a.n + b.n - coalesce(c, 0) - coalesce(e, 0) AS INTEGER) AS distance
          FROM sizes a JOIN sizes b ON b.id = a.id + 1 LEFT JOIN common ON id1 = a.id""",
        "tree_rows": f"WITH {labelled(True, ('serotype', 'year'), test=False)} {totals}",
        "test_rows": f"WITH {labelled(True, ('serotype', 'year'), test=True)} {totals}",
        "tree_null_filter": f"""WITH {labelled(True, ('serotype', 'year'), test=False)}
          SELECT feature, present, round(null_share, 9) AS null_share, null_share <= {Q.TREE_NULLS} AS kept FROM nulls""",
        "tree_imputed": f"WITH {labelled(True, ('serotype', 'year'), test=False)} {imputed}",
    }
    return out
