"""Registry helpers: named query functions and SQL texts built from shared CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

CTES: dict[str, str] = {}
#: Shared CTEs that a query reads several times and that are dear to compute.
ONCE: set[str] = set()


def cte(name: str, body: str, once: bool = False) -> None:
    CTES[name] = body.strip()
    if once:
        ONCE.add(name)


def sql(body: str) -> str:
    """Prepend every shared CTE the text names, directly or through another CTE."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in CTES:
            if name in seen or name in order:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(CTES[name], seen + (name,))
                if name not in order:
                    order.append(name)

    visit(body, ())
    if not order:
        return body
    heads = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in ONCE)}(\n{CTES[n]}\n)" for n in order)
    return f"WITH {heads}\n{body}"


class Family:
    """Collects the queries and oracles of one family."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = sql(oracle)
            return fn

        return register


cte("tx", """
SELECT o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, o_orderkey AS order_id,
       o_orderdate AS ts, l_linenumber AS line_no, l_quantity AS qty,
       l_extendedprice / l_quantity AS unit_price, n_name AS country, p_name AS descr,
       p_type AS category, l_returnflag = 'R' AS cancelled
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
""")
cte("raw0", """
SELECT CASE WHEN cancelled THEN 'C' ELSE '' END || CAST(order_id AS VARCHAR) AS invoice_no,
       CASE WHEN line_no = 6 AND order_id % 11 = 0 THEN 'POST' ELSE item_id END AS item_id,
       descr,
       CASE WHEN order_id % 9 = 0 AND line_no = 5 THEN -qty
            WHEN order_id % 17 = 0 AND line_no = 4 THEN NULL ELSE qty END AS qty,
       ts,
       CASE WHEN order_id % 10 = 0 AND line_no = 3 THEN 0.0 ELSE unit_price END AS unit_price,
       CASE WHEN order_id % 7 = 0 THEN NULL ELSE user_id END AS user_id,
       country
FROM tx
""")
cte("dirty", """
SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE invoice_no LIKE '%3'
""")
cte("hist", "SELECT * FROM tx WHERE ts < TIMESTAMP '2001-06-01'")
cte("fut", "SELECT * FROM tx WHERE ts >= TIMESTAMP '2001-06-01'")
cte("pairs", "SELECT DISTINCT user_id, item_id FROM tx")
cte("hpairs", "SELECT DISTINCT user_id, item_id FROM hist")
cte("fpairs", "SELECT DISTINCT user_id, item_id FROM fut")
cte("cand", """
SELECT user_id, item_id FROM pairs
UNION
SELECT user_id, CAST(CAST(item_id AS BIGINT) + 1 AS VARCHAR) FROM pairs
WHERE CAST(item_id AS BIGINT) + 1 IN (SELECT p_partkey FROM part)
""")
cte("cuts", """
SELECT * FROM (VALUES (TIMESTAMP '2001-03-01'), (TIMESTAMP '2001-04-01'), (TIMESTAMP '2001-05-01'),
                      (TIMESTAMP '2001-06-01'), (TIMESTAMP '2001-07-01')) v(cut)
""")
cte("cut_item", """
SELECT cut, item_id, count(DISTINCT user_id) AS buyers, max(ts) AS last_ts
FROM cuts JOIN tx ON ts < cut GROUP BY cut, item_id
""")
cte("cut_user", "SELECT DISTINCT cut, user_id FROM cuts JOIN tx ON ts < cut")
cte("cut_pair", """
SELECT cut, user_id, item_id, count(DISTINCT order_id) AS n_ord
FROM cuts JOIN tx ON ts < cut GROUP BY cut, user_id, item_id
""")
cte("cut_label", """
SELECT DISTINCT cut, user_id, item_id FROM cuts JOIN tx ON ts >= cut AND ts < cut + INTERVAL 1 MONTH
""")
cte("replay", """
SELECT strftime(u.cut, '%Y-%m') AS ym, u.cut, c.user_id, c.item_id,
       CASE WHEN l.user_id IS NOT NULL THEN 1 ELSE 0 END AS label,
       CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END AS prior_bought,
       CASE WHEN l.user_id IS NOT NULL AND p.user_id IS NULL THEN 1 ELSE 0 END AS new_combo,
       i.buyers, i.last_ts, coalesce(p.n_ord, 0) AS n_ord
FROM cand c
JOIN cut_user u ON u.user_id = c.user_id
JOIN cut_item i ON i.cut = u.cut AND i.item_id = c.item_id
LEFT JOIN cut_label l ON l.cut = u.cut AND l.user_id = c.user_id AND l.item_id = c.item_id
LEFT JOIN cut_pair p ON p.cut = u.cut AND p.user_id = c.user_id AND p.item_id = c.item_id
""")
cte("preds", """
SELECT ym, cut, user_id, item_id, label, prior_bought,
       buyers / (buyers + 50.0) AS s_pop,
       1.0 / (1 + date_diff('day', last_ts, cut)) AS s_rec,
       n_ord + buyers / 1000.0 AS s_own
FROM replay
""")
