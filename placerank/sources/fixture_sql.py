"""DuckDB text of the stand-in views in ``fixtures`` (for the SQL oracle).

The driver registers only the raw tables, so each oracle query starts with
``ctes(...)`` which inlines the views it needs as common table expressions.
"""
from __future__ import annotations

from placerank.sources.fixtures import COMPLIMENT_COLUMNS, COMPLIMENT_MODULI
from placerank.sources.reference_values import BLOCKED_CATEGORIES, CATEGORY_GROUPS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CATS = """CASE WHEN p_partkey % 13 = 0 THEN NULL
            WHEN p_partkey % 11 = 0 THEN {tail}
            ELSE 'Restaurants, ' || {tail} END"""
_TAIL = """(CASE p_type WHEN 'PROMO' THEN 'Chinese, Tea Rooms' WHEN 'ECONOMY' THEN 'Mexican'
             WHEN 'MEDIUM' THEN 'Italian, Seafood' WHEN 'SMALL' THEN 'Coffee & Tea, Desserts'
             WHEN 'LARGE' THEN 'Steakhouses, Wine Bars' ELSE 'Automotive' END)"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "geo": ([], """SELECT n.n_nationkey, n.n_name AS city, r.r_name AS state
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "business": (["geo"], f"""SELECT p_partkey AS business_id, p_name AS name, g.city, g.state,
        CAST(25 + (p_partkey % 25) AS DOUBLE) AS latitude,
        CAST(-120 + 2 * (p_partkey % 25) AS DOUBLE) AS longitude,
        CAST(1 + (p_partkey % 5) AS DOUBLE) AS stars,
        CAST(p_size * 7 AS INTEGER) AS review_count,
        CAST(p_partkey % 2 AS INTEGER) AS is_open,
        {_CATS.format(tail=_TAIL)} AS categories,
        CASE p_size % 5 WHEN 0 THEN NULL WHEN 4 THEN 'None' ELSE CAST(p_size % 5 AS VARCHAR) END AS price_raw,
        CASE p_size % 4 WHEN 0 THEN '{{''garage'': False, ''street'': True}}'
             WHEN 1 THEN '{{''garage'': False, ''street'': False}}' WHEN 2 THEN 'u''free''' END AS attr_businessparking,
        CASE p_partkey % 6 WHEN 0 THEN '{{''dj'': False, ''live'': True}}' WHEN 1 THEN 'None' END AS attr_music,
        CASE p_partkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'None' END AS attr_outdoorseating,
        CASE WHEN p_partkey % 9 = 0 THEN '{{''casual'': True}}' WHEN p_partkey % 9 < 4 THEN '{{''casual'': False}}' END AS attr_ambience,
        CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS attr_dogsallowed,
        CASE WHEN p_partkey % 7 = 0 THEN 'True' ELSE 'False' END AS attr_open24hours,
        CASE p_size % 5 WHEN 0 THEN NULL WHEN 4 THEN 'None' ELSE CAST(p_size % 5 AS VARCHAR) END
            AS attr_restaurantspricerange2
        FROM part JOIN geo g ON p_partkey % 25 = g.n_nationkey"""),
    "users": (["geo"], """SELECT c_custkey AS user_id, c_name AS name, g.city,
        CASE c_custkey % 5 WHEN 0 THEN '2010,2011' WHEN 1 THEN '2015' ELSE '' END AS elite,
        CASE WHEN c_custkey % 4 = 0 THEN 'None'
             ELSE CAST(c_custkey + 1 AS VARCHAR) || ',' || CAST(c_custkey + 2 AS VARCHAR) END AS friends,
        c_custkey % 17 AS fans, c_custkey % 50 + 1 AS review_count,
        c_custkey % 23 AS useful, c_custkey % 19 AS funny, c_custkey % 29 AS cool,
        CAST(1 AS DOUBLE) + (c_custkey % 41) / CAST(10 AS DOUBLE) AS average_stars,
        CASE WHEN c_custkey % 53 = 0 THEN 'n/a'
             ELSE strftime(DATE '2004-10-01' + CAST((c_custkey * 7) % 5000 AS INTEGER), '%Y-%m-%d') END
            AS yelping_since,
        """ + ",\n        ".join(f"c_custkey % {m} AS {n}" for n, m in zip(COMPLIMENT_COLUMNS, COMPLIMENT_MODULI)) + """
        FROM customer JOIN geo g ON c_nationkey = g.n_nationkey"""),
    "reviews": ([], """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))
            AS review_id,
        o_custkey AS user_id, l_partkey AS business_id,
        1 + CAST(l_quantity AS INTEGER) % 5 AS stars, o_orderdate AS date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "tips": ([], """SELECT event_id % (SELECT max(p_partkey) + 1 FROM part) AS business_id, user_id, ts AS date
        FROM events WHERE event_type = 'click'"""),
    "checkins": ([], """SELECT event_id % (SELECT max(p_partkey) + 1 FROM part) AS business_id,
        CASE WHEN event_id % 3 = 0
             THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date
        FROM events WHERE event_type = 'view'"""),
    "review_texts": ([], "SELECT doc_id AS review_id, source AS business_id, text FROM documents"),
    "category_groups": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({_q(g)}, {_q(c)})" for g, cats in CATEGORY_GROUPS.items() for c in cats) + ") t(\"group\", category)"),
    "blocked_categories": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({_q(c)})" for c in BLOCKED_CATEGORIES) + ") t(category)"),
}


def ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named views (and their dependencies), then ``extra``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
