"""The registered queries restated as SQL over the same tables, written independently of the library."""

from __future__ import annotations

import random

from workload.queries import (FEW_BOOSTED, FEW_FOREST, GAP, HUBER_SHARE, K, LINEAR, MACROS, REPORTS, TEST_YEARS, WIDE, WIDE_NAMES)
from workload.tables import CHARACTERISTICS, FEATURES, FIRST_TARGET, LAST_TARGET

# raw text of the lenient-cast queries
CODED = """CASE l_linenumber
  WHEN 1 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '  '
  WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5'
  WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'd'
  WHEN 4 THEN CASE WHEN l_quantity < 25 THEN 'null' ELSE '.' END
  WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0'
  WHEN 6 THEN CASE WHEN l_quantity < 25 THEN 'NaN' ELSE 'Z' END
  ELSE '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e1' END"""

CTES = {
    "cells": """SELECT l_suppkey AS permno, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS month_id,
        count(*) AS n,
        CAST(sum(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS BIGINT) AS cents,
        max(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS top_cents,
        min(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS low_cents,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
        CAST(sum(CAST(round(l_discount * 100e0) AS BIGINT)) AS BIGINT) AS discount,
        CAST(sum(CAST(round(l_tax * 100e0) AS BIGINT)) AS BIGINT) AS tax,
        count(*) FILTER (WHERE l_returnflag = 'R') AS returned
      FROM lineitem GROUP BY 1, 2""",
    "author": """SELECT permno, make_date((month_id - 1) // 12, (month_id - 1) % 12 + 1, 1) AS month, month_id,
        CASE WHEN n % 19 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS sic2,
        CASE WHEN n % 17 <> 0 THEN cents / 1000000e0 END AS mvel1,
        CASE WHEN returned > 0 THEN discount / n END AS bm,
        CASE WHEN n % 7 <> 0 THEN qty / n END AS mom12m,
        CASE WHEN n % 5 <> 0 THEN tax / n END AS turn,
        CASE WHEN n <> 1 THEN (top_cents - low_cents) / 100e0 END AS retvol,
        CAST(qty AS DOUBLE) AS dolvol
      FROM cells JOIN supplier ON s_suppkey = permno""",
    "priced": """SELECT *, cents / 100e0 / qty AS prc0 FROM cells""",
    "security0": """SELECT permno, month_id, n,
        CASE WHEN n % 13 <> 0 THEN prc0 / lag(prc0) OVER (PARTITION BY permno ORDER BY month_id) - 1e0 END AS ret,
        CASE WHEN n % 11 = 0 THEN 0.01e0 * (n % 5) END AS dlret,
        prc0 AS price_abs, prc0 * qty AS mktcap,
        CASE WHEN n % 23 <> 0 THEN CAST(qty AS DOUBLE) END AS vol,
        CASE WHEN n % 6 <> 0 THEN 10 + n % 3 END AS shrcd, 1 + n % 3 AS exchcd,
        CASE WHEN n % 9 <> 0 THEN 100 * (n % 40) END AS siccd_crsp
      FROM priced""",
    "security": """SELECT permno, month_id, ret, dlret,
        CASE WHEN ret IS NOT NULL AND dlret IS NOT NULL THEN (1 + ret) * (1 + dlret) - 1
             WHEN dlret IS NOT NULL THEN dlret ELSE ret END AS ret_adj,
        price_abs, mktcap, lag(mktcap) OVER (PARTITION BY permno ORDER BY month_id) AS mktcap_lag,
        vol, shrcd, exchcd, siccd_crsp FROM security0""",
    "months": """SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month_id, count(*) AS n,
        CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS cents,
        count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p
      FROM orders GROUP BY 1""",
    "risk_free": "SELECT month_id, 0.001e0 * (n % 5) AS rf FROM months WHERE month_id % 12 <> 5",
    "macro": """SELECT month_id,
        CASE WHEN n_f > 0 THEN ln(n_f / (cents / 100e0 / n)) END AS macro_dp,
        CASE WHEN n_o > 0 THEN ln(n_o / (cents / 100e0 / n)) END AS macro_ep,
        n_p / n AS macro_bm, CASE WHEN n % 4 <> 0 THEN n_o / n END AS macro_ntis,
        0.01e0 * (n % 9) AS macro_tbl, 0.01e0 * (n % 7) - 0.01e0 * (n % 9) AS macro_tms,
        0.01e0 * (n % 8) - 0.01e0 * (n % 5) AS macro_dfy, cents % 1000 / 1000e0 AS macro_svar
      FROM months WHERE month_id % 10 <> 3""",
    "panel": """SELECT a.*, s.* EXCLUDE (permno, month_id), rf, m.* EXCLUDE (month_id), ret_adj - rf AS ret_excess
      FROM author a JOIN security s ON a.permno = s.permno AND a.month_id = s.month_id
      LEFT JOIN risk_free r ON a.month_id = r.month_id LEFT JOIN macro m ON a.month_id = m.month_id
      WHERE year(month) BETWEEN 1995 AND 2001""",
    "target": f"""SELECT p.*, q.ret_excess AS y, q.month AS target_month, q.month_id AS target_month_id,
        CAST(year(q.month) AS BIGINT) AS target_year, p.mktcap AS size_for_ranking
      FROM panel p JOIN panel q ON q.permno = p.permno AND q.month_id = p.month_id + 1
      WHERE q.ret_excess IS NOT NULL AND q.month_id BETWEEN {FIRST_TARGET} AND {LAST_TARGET}""",
}


def _filled(columns, source, kind="DOUBLE"):
    cols = ", ".join(
        f"CAST(coalesce({c}, median({c}) OVER (PARTITION BY month_id), 0e0) AS {kind}) AS {c}_filled" for c in columns)
    return f"SELECT *, count(*) OVER (PARTITION BY month_id) AS _n_month, {cols} FROM {source}"


def _ranked(columns, source, kind="DOUBLE"):
    def rank(c):
        v = f"{c}_filled"
        r = (f"(rank() OVER (PARTITION BY month_id ORDER BY {v}) "
             f"+ (count(*) OVER (PARTITION BY month_id, {v}) - 1) / 2e0)")
        return (f"CAST(CASE WHEN _n_month > 1 THEN 2e0 * ({r} - 1e0) / (_n_month - 1e0) - 1e0 ELSE 0e0 END "
                f"AS {kind}) AS {c}_rank")
    return f"SELECT *, {', '.join(rank(c) for c in columns)} FROM {source}"


CTES["filled"] = _filled(FEATURES, "target")
CTES["ranked"] = _ranked(FEATURES, "filled")
CTES["preds"] = """SELECT permno, month, target_month, month_id, target_month_id, target_year, y,
        CASE WHEN permno % 31 <> 0 THEN size_for_ranking END AS size_for_ranking,
        0.05e0 - 0.2e0 * bm_rank + 0.3e0 * mom12m_rank AS prediction FROM ranked"""
CTES["gappy"] = """SELECT * EXCLUDE (prediction), CASE WHEN permno % 29 = 0 THEN CAST('nan' AS DOUBLE)
        WHEN permno % 37 = 0 THEN CAST('inf' AS DOUBLE) WHEN permno % 41 <> 0 THEN prediction END AS prediction
      FROM preds"""
USABLE = "isfinite(y) AND prediction IS NOT NULL AND isfinite(prediction)"
R2 = (f"100e0 * (1e0 - sum((y - prediction) * (y - prediction)) FILTER (WHERE {USABLE}) "
      f"/ nullif(sum(y * y) FILTER (WHERE {USABLE}), 0))")
WINDOWS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({t}, {t - GAP})" for t in TEST_YEARS) + ") w(test_year, train_end)"
XS = [f"{c}_rank" for c in LINEAR]
TRAIN = f"""SELECT CAST(test_year AS BIGINT) AS test_year, CAST(train_end AS BIGINT) AS train_end, y,
        {', '.join(f'{x} AS x{i}' for i, x in enumerate(XS, 1))} FROM ranked JOIN windows ON target_year <= train_end"""


def rounded(columns, digits=9):
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in columns)


def with_ctes(final, extra=None):
    parts = [f"{name} AS ({body})" for name, body in {**CTES, **(extra or {})}.items()]
    return "WITH " + ",\n".join(parts) + "\n" + final


def _huber_steps(share, steps=7):
    """Newton steps on the Huber loss, unrolled: three features and an intercept, solved by cofactors of the covariances.

    A row inside the threshold weighs one and pulls with its target; one beyond weighs nothing and pulls with the signed threshold.
    """
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    cofactors = """c22 * c33 - c23 * c23 AS k11, c13 * c23 - c12 * c33 AS k12, c12 * c23 - c13 * c22 AS k13,
        c11 * c33 - c13 * c13 AS k22, c12 * c13 - c11 * c23 AS k23, c11 * c22 - c12 * c12 AS k33"""

    def solve(source, weight, pull):
        sums = ", ".join([f"sum(w * x{i}) AS s{i}, sum(v * x{i}) AS s{i}y" for i in (1, 2, 3)]
                         + [f"sum(w * x{i} * x{j}) AS s{i}{j}" for i, j in pairs])
        means = ", ".join(f"s{i} / w AS m{i}" for i in (1, 2, 3))
        spreads = ", ".join([f"s{i}{j} / w - m{i} * m{j} AS c{i}{j}" for i, j in pairs]
                            + [f"s{i}y / w - m{i} * my AS c{i}y" for i in (1, 2, 3)])
        return f"""SELECT test_year, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, b1, b2, b3, n, train_end, xi FROM (
            SELECT *, (k11 * c1y + k12 * c2y + k13 * c3y) / det AS b1, (k12 * c1y + k22 * c2y + k23 * c3y) / det AS b2,
                (k13 * c1y + k23 * c2y + k33 * c3y) / det AS b3 FROM (
            SELECT *, c11 * k11 + c12 * k12 + c13 * k13 AS det FROM (SELECT *, {cofactors} FROM (
            SELECT test_year, n, train_end, xi, m1, m2, m3, my, {spreads} FROM (
            SELECT *, {means}, sy / w AS my FROM (
            SELECT test_year, count(*) AS n, any_value(train_end) AS train_end, any_value(xi) AS xi, sum(w) AS w,
                sum(v) AS sy, {sums}
            FROM (SELECT *, {weight} AS w, {pull} AS v FROM {source}) GROUP BY test_year))))))"""

    parts = {
        "windows": WINDOWS_SQL, "train0": TRAIN,
        "xi": f"SELECT test_year, quantile_cont(abs(y), {share}) AS xi FROM train0 GROUP BY test_year",
        "train": "SELECT train0.*, xi FROM train0 JOIN xi USING (test_year)",
        "fit0": solve("train", "1e0", "y"),
    }
    for i in range(1, steps + 1):
        rows = (f"(SELECT train.*, y - b0 - b1 * x1 - b2 * x2 - b3 * x3 AS e FROM train "
                f"JOIN (SELECT test_year, b0, b1, b2, b3 FROM fit{i - 1}) USING (test_year))")
        parts[f"fit{i}"] = solve(rows, "CASE WHEN abs(e) <= xi THEN 1e0 ELSE 0e0 END", "CASE WHEN abs(e) <= xi THEN y ELSE xi * sign(e) END")
    return parts, f"fit{steps}"


# -- trees by plain search over long tables -------------------------------------------------

PRIME = (1 << 31) - 1
TREE_RANKS = [f"{c}_rank" for c in CHARACTERISTICS]
SPLIT_WINDOWS = "SELECT CAST(test_year AS BIGINT) AS test_year, CAST(train_end AS BIGINT) AS train_end FROM (" + WINDOWS_SQL + ")"


def _sampled(share, seed):
    mixed = f"((draw + ({seed}) * 7919773) % {PRIME})"
    return f"(({mixed} * {mixed} % {PRIME}) * 48271 + 12345) % {PRIME} < {int(share * PRIME)}"


def _tree_rows():
    """b: each row's bins, one line for each feature; r: rows of each window, its training years and its test year."""
    names, values = ", ".join(str(i) for i in range(len(TREE_RANKS))), ", ".join(f"CAST({c} AS DOUBLE)" for c in TREE_RANKS)
    return {
        "windows": SPLIT_WINDOWS, "tree_filled": _filled(CHARACTERISTICS, "target", "FLOAT"), "tree_ranked": _ranked(CHARACTERISTICS, "tree_filled", "FLOAT"),
        "b": f"""SELECT permno, month_id, f, CAST(greatest(0, least(31, ceil((x + 1e0) * 16e0) - 1)) AS BIGINT) AS bin
            FROM (SELECT permno, month_id, unnest([{names}]) AS f, unnest([{values}]) AS x FROM tree_ranked)""",
        "r": f"""SELECT test_year AS w, train_end, permno, month_id, target_year, y, target_year <= train_end AS train, (permno * 1000003 + month_id) % {PRIME} AS draw
            FROM tree_ranked JOIN windows ON target_year <= train_end OR target_year = test_year"""}


def _grow(name, first, depth, keys, columns, only, least, shrinkage):
    """Levels of splits from the table `first` (keys, row, used, g, h, node): tables {name}n1 ... with the rows' nodes, {name}p0 ... with the splits."""
    parts, rows = {}, first
    by = f"{keys}, node"
    for level in range(depth):
        parts[f"{name}h{level}"] = f"""SELECT {by}, f, bin, sum(g) AS g, sum(h) AS h FROM {rows} JOIN b USING (permno, month_id) {columns}
            WHERE {only} AND used AND node >= {1 << level} GROUP BY {by}, f, bin"""
        parts[f"{name}c{level}"] = f"""SELECT {by}, f, bin, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(g) OVER (PARTITION BY {by}, f) AS gt,
            sum(h) OVER (PARTITION BY {by}, f) AS ht FROM {name}h{level} WINDOW up AS (PARTITION BY {by}, f ORDER BY bin)"""
        parts[f"{name}p{level}"] = f"""SELECT {by}, f, bin FROM (SELECT *, max(gain) OVER (PARTITION BY {by}) AS top FROM (
            SELECT *, gl * gl / (hl + {shrinkage}) + (gt - gl) * (gt - gl) / (ht - hl + {shrinkage}) - gt * gt / (ht + {shrinkage}) AS gain
            FROM {name}c{level} WHERE bin < 31 AND hl >= {least} AND ht - hl >= {least}))
            WHERE top > 1e-6 AND gain >= top * (1 - 1e-9) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY f, bin) = 1"""
        parts[f"{name}n{level + 1}"] = f"""SELECT q.* REPLACE (CASE WHEN p.f IS NULL THEN q.node ELSE 2 * q.node + CASE WHEN b.bin > p.bin THEN 1 ELSE 0 END END AS node)
            FROM {rows} q LEFT JOIN {name}p{level} p USING ({by}) LEFT JOIN b ON b.permno = q.permno AND b.month_id = q.month_id AND b.f = p.f"""
        rows = f"{name}n{level + 1}"
    return parts, rows


def _boosted(settings):
    parts = _tree_rows()
    parts["s0"] = """SELECT r.*, base AS s FROM r JOIN (SELECT w, sum(y / sqrt(1 + y * y)) / sum(pow(1 + y * y, -1.5e0)) AS base FROM r WHERE train GROUP BY w) USING (w)"""
    nodes = []
    for t in range(settings.trees):
        drawn = sorted(random.Random(f"{settings.seed} {t}").sample(range(len(TREE_RANKS)), max(1, int(settings.column_share * len(TREE_RANKS)))))
        parts[f"t{t}g"] = f"""SELECT w, permno, month_id, train AND {_sampled(settings.row_share, settings.seed + t)} AS used, e / sqrt(1 + e * e) AS g,
            pow(1 + e * e, -1.5e0) AS h, 1 AS node FROM (SELECT *, s - y AS e FROM s{t})"""
        grown, last = _grow(f"t{t}", f"t{t}g", settings.depth, "w", "", f"f IN ({', '.join(map(str, drawn))})", settings.min_child_weight, settings.shrinkage)
        parts |= grown
        parts[f"t{t}l"] = f"SELECT w, node, -{settings.rate} * sum(g) / (sum(h) + {settings.shrinkage}) AS v FROM {last} WHERE used GROUP BY w, node"
        parts[f"s{t + 1}"] = f"SELECT s.* REPLACE (s.s + coalesce(v, 0) AS s) FROM s{t} s JOIN {last} n USING (w, permno, month_id) LEFT JOIN t{t}l l ON l.w = s.w AND l.node = n.node"
        nodes += [f"SELECT w, {t} AS t, node, f, bin, NULL AS v FROM t{t}p{level}" for level in range(settings.depth)] + [f"SELECT w, {t}, node, NULL, NULL, v FROM t{t}l"]
    return parts, nodes, f"SELECT w, train_end, permno, month_id, target_year, s AS prediction FROM s{settings.trees} WHERE NOT train"


def _forest(settings):
    parts, columns = _tree_rows(), []
    for t in range(settings.trees):
        own = sorted(random.Random(f"{settings.seed} {t}").sample(range(len(TREE_RANKS)), max(1, int(settings.column_share * len(TREE_RANKS)))))
        for node in range(1, 1 << settings.depth):
            columns += [f"({t}, {node}, {f})" for f in random.Random(f"{settings.seed} {t} {node}").sample(own, max(1, int(settings.node_share * len(own))))]
    parts["k"] = f"SELECT * FROM (VALUES {', '.join(columns)}) k(t, node, f)"
    parts["base"] = "SELECT w, avg(y) AS base FROM r WHERE train GROUP BY w"
    parts["g0"] = f"""SELECT w, t, permno, month_id, train AND {_sampled(settings.row_share, f'{settings.seed} + t')} AS used, base - y AS g, 1e0 AS h, 1 AS node
        FROM r JOIN base USING (w), (SELECT CAST(unnest(range({settings.trees})) AS BIGINT) AS t)"""
    grown, last = _grow("", "g0", settings.depth, "w, t", "JOIN k USING (t, node, f)", "true", settings.min_child_weight, settings.shrinkage)
    parts |= grown
    parts["l"] = f"SELECT w, t, node, base - sum(g) / (sum(h) + {settings.shrinkage}) AS v FROM {last} JOIN base USING (w) WHERE used GROUP BY w, t, node, base"
    nodes = [f"SELECT w, t, node, f, bin, NULL AS v FROM p{level}" for level in range(settings.depth)] + ["SELECT w, t, node, NULL, NULL, v FROM l"]
    final = f"""SELECT w, train_end, permno, month_id, target_year, avg(v) AS prediction FROM r JOIN (SELECT w, permno, month_id, v FROM {last} JOIN l USING (w, t, node))
        USING (w, permno, month_id) WHERE NOT train GROUP BY ALL"""
    return parts, nodes, final


def _tree_oracles(out, name, settings, grow):
    parts, nodes, final = grow(settings)
    held = [k for k in parts if k != "windows"]
    names = "[" + ", ".join(f"'{c}'" for c in TREE_RANKS) + "]"
    out[f"{name}_trees"] = _materialized(with_ctes(f"""SELECT w AS model, CAST(t AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, {names}[f + 1] AS feature,
        (bin + 1) / 16e0 - 1e0 AS threshold, round(coalesce(v, 0e0), 7) + 0e0 AS value FROM ({' UNION ALL '.join(nodes)})""", parts), held)
    out[f"{name}_forecasts"] = _materialized(with_ctes(f"""SELECT permno, month_id, target_year, CAST(train_end AS INTEGER) AS train_end_year,
        round(prediction, 7) + 0e0 AS prediction FROM ({final})""", parts), held)


def _materialized(sql, names):
    for n in names:
        sql = sql.replace(f"{n} AS (", f"{n} AS MATERIALIZED (", 1)
    return sql


def oracle_sql():
    out = {}
    out["null_tokens_trim"] = f"""SELECT l_linenumber,
        CASE WHEN trim(t) NOT IN ('', 'NA', 'NaN', 'NULL', 'null', '.') THEN trim(t) END AS text, count(*) AS n
        FROM (SELECT l_linenumber, {CODED} AS t FROM lineitem) GROUP BY 1, 2"""
    out["lenient_cast"] = f"""SELECT l_linenumber,
        CASE WHEN regexp_full_match(trim(t), '-?[0-9.]+(e[0-9]+)?') THEN TRY_CAST(trim(t) AS DOUBLE) END AS as_double,
        CASE WHEN regexp_full_match(trim(t), '-?[0-9]+([.]0)?')
             THEN TRY_CAST(split_part(trim(t), '.', 1) AS BIGINT) END AS as_long, count(*) AS n
        FROM (SELECT l_linenumber, {CODED} AS t FROM lineitem) GROUP BY 1, 2, 3"""
    out["strict_cast"] = """SELECT CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS BIGINT) END AS as_long,
        CASE WHEN l_linenumber <> 1 THEN l_quantity END AS as_double, count(*) AS n FROM lineitem GROUP BY 1, 2"""
    out["parse_dates"] = """SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) AS same_day,
        count(*) AS n FROM lineitem GROUP BY 1, 2"""
    out["month_index"] = """SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS month_id,
        CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day, count(*) AS n
        FROM lineitem GROUP BY 1"""
    out["yyyymm_split"] = """SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS yyyymm,
        count(*) AS n, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month_id
        FROM orders GROUP BY 1, 3"""
    out["csv_parquet_roundtrip"] = with_ctes("SELECT * FROM security")
    out["prediction_store"] = with_ctes(
        f"SELECT permno, month_id, target_year, {rounded(['prediction'])} FROM preds")
    out["prediction_concat"] = with_ctes(
        """SELECT target_year, count(*) AS n, round(sum(prediction), 6) + 0e0 AS total FROM preds GROUP BY 1""")
    out["delist_adjusted_return"] = with_ctes("SELECT permno, month_id, ret, dlret, ret_adj FROM security")
    out["market_cap"] = with_ctes("SELECT permno, month_id, price_abs, mktcap FROM security")
    out["security_codes"] = with_ctes(
        "SELECT shrcd, exchcd, siccd_crsp, count(*) AS n, sum(vol) AS vol FROM security GROUP BY ALL")
    out["lag_by_row"] = with_ctes("SELECT permno, month_id, mktcap, mktcap_lag FROM security")
    out["risk_free"] = with_ctes("SELECT month_id, rf FROM risk_free")
    macros = [f"macro_{m}" for m in MACROS]
    out["macro_predictors"] = with_ctes(f"SELECT month_id, {rounded(macros)} FROM macro")
    out["master_panel"] = with_ctes(f"""SELECT * EXCLUDE (macro_dp, macro_ep),
        {rounded(["macro_dp", "macro_ep"])} FROM panel""")
    out["excess_return"] = with_ctes("SELECT permno, month_id, ret_adj, rf, ret_excess FROM panel")
    out["macro_resolution"] = with_ctes("SELECT month_id, " + ", ".join(
        f"round(max(macro_{m}), 9) + 0e0 AS {m}" for m in MACROS) + " FROM panel GROUP BY month_id")
    out["key_uniqueness"] = """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1"""
    out["panel_qa"] = with_ctes("""SELECT count(*) AS n_rows, count(DISTINCT permno) AS n_permnos,
        min(month) AS min_month, max(month) AS max_month,
        count(*) FILTER (WHERE ret_excess IS NULL) AS missing_ret_excess,
        count(*) FILTER (WHERE mktcap_lag IS NULL) AS missing_mktcap_lag FROM panel""")
    out["panel_coverage"] = with_ctes("""SELECT CAST(year(month) AS BIGINT) AS year, count(*) AS n_rows,
        count(DISTINCT permno) AS n_stocks FROM panel GROUP BY 1""")
    out["next_month_target"] = with_ctes("""SELECT permno, month_id, target_month, target_month_id, target_year,
        y, size_for_ranking FROM target""")
    out["colocated_panel"], out["colocated_target"] = out["master_panel"], out["next_month_target"]
    out["same_month_target"] = with_ctes(f"""SELECT permno, month_id, month AS target_month,
        month_id AS target_month_id, CAST(year(month) AS BIGINT) AS target_year,
        ret_excess AS y, mktcap_lag AS size_for_ranking
        FROM panel WHERE ret_excess IS NOT NULL AND month_id BETWEEN {FIRST_TARGET} AND {LAST_TARGET}""")
    filled = [f"{c}_filled" for c in FEATURES]
    ranks = [f"{c}_rank" for c in FEATURES]
    out["month_median_fill"] = with_ctes(f"SELECT permno, month_id, _n_month, {rounded(filled)} FROM filled")
    out["rank_transform"] = with_ctes(f"SELECT permno, month_id, {rounded(ranks)} FROM ranked")
    out["rank_transform_split"] = out["rank_transform"]
    out["ranks_with_nulls"] = with_ctes("SELECT permno, month_id, " + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY month_id ORDER BY {c} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY month_id, {c}) - 1) / 2e0 END AS {c}_place" for c in FEATURES) + " FROM target")
    out["ranks_with_nulls_split"] = out["ranks_with_nulls"]
    narrow = {"narrow_filled": _filled(FEATURES, "target", "FLOAT"),
              "narrow": _ranked(FEATURES, "narrow_filled", "FLOAT")}
    out["rank_transform_float"] = with_ctes("SELECT permno, month_id, " + ", ".join(
        f"round(CAST({c} AS DOUBLE), 9) + 0e0 AS {c}" for c in ranks) + " FROM narrow", narrow)
    source = {"qty": "CAST(l_quantity AS BIGINT)", "price": "CAST(round(l_extendedprice * 100e0) AS BIGINT)",
              "discount": "CAST(round(l_discount * 100e0) AS BIGINT)", "tax": "CAST(round(l_tax * 100e0) AS BIGINT)"}
    sums = ", ".join(f"CAST(sum({source[m]}) FILTER (WHERE l_linenumber = {line} AND l_returnflag = '{flag}') "
                     f"AS BIGINT) AS {name}" for name, (line, flag, m) in zip(WIDE_NAMES, WIDE))
    wide = {"wide": f"""SELECT l_suppkey AS permno, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT)
        AS month_id, {sums} FROM lineitem GROUP BY 1, 2""",
            "wide_filled": _filled(WIDE_NAMES, "wide"), "wide_ranked": _ranked(WIDE_NAMES, "wide_filled")}
    out["wide_rank_transform"] = with_ctes(
        f"SELECT permno, month_id, {rounded([f'{c}_rank' for c in WIDE_NAMES])} FROM wide_ranked", wide)
    out["wide_rank_transform_split"] = out["wide_rank_transform"]
    out["macro_global_fill"] = with_ctes("SELECT permno, month_id, " + ", ".join(
        f"round(coalesce({m}, median({m}) OVER (), 0e0), 9) + 0e0 AS {m}" for m in macros) + " FROM target")
    running = {"series": "SELECT month_id, " + ", ".join(f"max({m}) AS {m}" for m in macros)
                         + " FROM target GROUP BY month_id",
               "running": "SELECT month_id, " + ", ".join(
                   f"median({m}) OVER (ORDER BY month_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_{m}"
                   for m in macros) + " FROM series"}
    out["macro_expanding_fill"] = with_ctes("SELECT permno, target.month_id, " + ", ".join(
        f"round(coalesce({m}, run_{m}, 0e0), 9) + 0e0 AS {m}" for m in macros)
        + " FROM target JOIN running USING (month_id)", running)
    crossed = ", ".join(f"round(CAST({c}_rank AS DOUBLE), 6) + 0e0 AS {c}_rank, " + ", ".join(
        f"round(CAST({c}_rank * CAST(coalesce(macro_{m}, run_macro_{m}, 0e0) AS FLOAT) AS DOUBLE), 6) + 0e0 "
        f"AS {c}_x_{m}" for m in MACROS) for c in LINEAR)
    out["macro_interactions"] = with_ctes(
        f"SELECT permno, narrow.month_id, {crossed} FROM narrow JOIN running USING (month_id)", {**narrow, **running})
    out["industry_dummies"] = with_ctes("SELECT permno, month_id, sic2, " + ", ".join(
        f"CASE WHEN sic2 = {k} THEN 1e0 ELSE 0e0 END AS sic_{k}" for k in range(25)) + " FROM panel")
    out["finite_pairs"] = with_ctes(f"""SELECT target_year, count(*) AS n,
        count(*) FILTER (WHERE {USABLE}) AS n_usable FROM gappy GROUP BY 1""")

    def ends(source):
        return f"""SELECT *, row_number() OVER (PARTITION BY target_month_id
            ORDER BY size_for_ranking DESC, permno) AS big, row_number() OVER (PARTITION BY target_month_id
            ORDER BY size_for_ranking, permno) AS small FROM {source} WHERE size_for_ranking IS NOT NULL"""

    out["top_bottom_k"] = with_ctes(f"""SELECT 'top' AS segment, target_month_id, big AS size_rank, permno,
        size_for_ranking FROM ends WHERE big <= {K} UNION ALL SELECT 'bottom', target_month_id,
        small, permno, size_for_ranking FROM ends WHERE small <= {K}""", {"ends": ends("preds")})

    def summary(source, model, digits, n_features, extra=None):
        extra = {**(extra or {}), "ends": ends(source)}
        return with_ctes(f"""SELECT '{model}' AS model, 'next_month' AS target_mode,
            (SELECT round({R2}, {digits}) + 0e0 FROM {source}) AS r2_all_pct,
            (SELECT round({R2}, {digits}) + 0e0 FROM ends WHERE big <= {K}) AS r2_top{K}_pct,
            (SELECT round({R2}, {digits}) + 0e0 FROM ends WHERE small <= {K}) AS r2_bottom{K}_pct,
            (SELECT count(*) FROM {source}) AS n_obs{n_features}""", extra)

    out["oos_r2_summary"] = summary("gappy", "ranks", 6, f", CAST({len(FEATURES)} AS BIGINT) AS n_features")
    out["summary_csv"] = out["oos_r2_summary"]
    out["yearly_r2"] = with_ctes(f"SELECT target_year, round({R2}, 6) + 0e0 AS r2_pct FROM gappy GROUP BY 1")
    out["yearly_diagnostics"] = with_ctes("""SELECT year, n, round(y_mean, 6) + 0e0 AS y_mean,
        round(pred_mean, 6) + 0e0 AS pred_mean, round(y_std, 6) + 0e0 AS y_std, round(pred_std, 6) + 0e0 AS pred_std,
        round(corr_y_pred, 6) + 0e0 AS corr_y_pred, round(sse, 6) + 0e0 AS sse, round(sst, 6) + 0e0 AS sst_zero,
        round(100e0 * (1e0 - sse / nullif(sst, 0)), 6) + 0e0 AS r2_pct
      FROM (SELECT CAST(year(target_month) AS BIGINT) AS year, count(*) AS n, avg(y) AS y_mean,
        avg(prediction) AS pred_mean, stddev_samp(y) AS y_std, stddev_samp(prediction) AS pred_std,
        corr(y, prediction) AS corr_y_pred, sum((y - prediction) ** 2) AS sse, sum(y ** 2) AS sst
        FROM preds GROUP BY 1)""")
    spots = [("y", "y"), ("prediction", "pred")]
    for name, function in (("forecast_quantiles_disc", "quantile_disc"), ("forecast_quantiles_linear", "quantile_cont")):
        out[name] = with_ctes("SELECT " + ", ".join(
            f"round({function}({c}, {p / 100}), 9) + 0e0 AS {short}_p{p:02d}" for c, short in spots
            for p in (1, 50, 99)) + " FROM preds")
    out["forecast_quantiles"] = with_ctes("SELECT " + ", ".join(
        f"(SELECT round({c}, 9) + 0e0 FROM placed WHERE {c}_row = CAST(floor({p / 100} * (n - 1) + 0.5) AS BIGINT)) AS {short}_p{p:02d}"
        for c, short in spots for p in (1, 50, 99)), {"placed": "SELECT *, count(*) OVER () AS n, " + ", ".join(
            f"row_number() OVER (ORDER BY {c}) - 1 AS {c}_row" for c, _ in spots) + " FROM preds"})
    out["forecast_quantiles_split"] = out["forecast_quantiles"]
    out["drift_table"] = with_ctes("""SELECT CAST(test_year AS BIGINT) AS test_year,
        CAST(train_end AS BIGINT) AS train_end,
        round(avg(y) FILTER (WHERE target_year <= train_end), 8) + 0e0 AS train_y_mean,
        round(stddev_pop(y) FILTER (WHERE target_year <= train_end), 8) + 0e0 AS train_y_std,
        round(avg(y) FILTER (WHERE target_year = test_year), 8) + 0e0 AS test_y_mean,
        round(stddev_pop(y) FILTER (WHERE target_year = test_year), 8) + 0e0 AS test_y_std,
        count(*) FILTER (WHERE target_year <= train_end) AS n_train,
        count(*) FILTER (WHERE target_year = test_year) AS n_test
        FROM target CROSS JOIN windows GROUP BY 1, 2""", {"windows": WINDOWS_SQL})
    out["huber_loss_terms"] = with_ctes("""SELECT target_year,
        round(sum(CASE WHEN abs(y) <= 0.5e0 THEN y * y ELSE abs(y) - 0.25e0 END), 6) + 0e0 AS loss,
        round(sum(CASE WHEN abs(y) <= 0.5e0 THEN y ELSE 0.5e0 * sign(y) END), 6) + 0e0 AS psi,
        round(sum(CASE WHEN abs(y) <= 0.5e0 THEN 1e0 ELSE 0.5e0 / abs(y) END), 6) + 0e0 AS weight
        FROM target GROUP BY 1""")

    steps, last = _huber_steps(HUBER_SHARE)
    held = ["ranked", *steps]
    coef = "round(b0, {0}) + 0e0 AS intercept, " + ", ".join(f"round(b{i}, {{0}}) + 0e0 AS {x}" for i, x in enumerate(XS, 1))
    ols = {k: steps[k] for k in ("windows", "train0", "xi", "train", "fit0")}
    out["expanding_window_ols"] = with_ctes(
        f"SELECT test_year, train_end, n AS n_train, {coef.format(8)} FROM fit0", ols)
    out["huber_thresholds"] = with_ctes("""SELECT test_year, round(quantile_cont(abs(y), 0.999), 9) + 0e0 AS xi
        FROM train0 GROUP BY 1""", {"windows": WINDOWS_SQL, "train0": TRAIN})
    out["huber_coefficients"] = _materialized(with_ctes(
        f"SELECT test_year, train_end, n AS n_train, round(xi, 7) AS xi, {coef.format(7)} FROM {last}", steps), held)
    scored = {**steps, "linear": f"""SELECT ranked.*, b0 + {' + '.join(f'b{i} * {x}' for i, x in enumerate(XS, 1))} AS prediction,
        f.train_end AS train_end_year FROM ranked JOIN {last} f ON target_year = f.test_year"""}
    out["huber_walkforward"] = _materialized(with_ctes(f"""SELECT permno, month_id, target_month_id, target_year,
        {rounded(['y', 'prediction'], 7)}, 'OLS3_Huber' AS model, CAST(train_end_year AS INTEGER) AS train_end_year
        FROM linear""", scored), held)
    out["huber_r2"] = _materialized(summary("linear", "OLS3_Huber", 4, "", scored), held)
    checked = """CAST(target_year AS BIGINT) AS target_year, count(*) AS n, max(w.train_end) AS train_end, count(*) AS n_finite,
        count(DISTINCT permno) AS n_entities"""
    tested = "FROM target JOIN windows w ON target_year = w.test_year GROUP BY target_year"
    windows = {"windows": "SELECT CAST(test_year AS BIGINT) AS test_year, CAST(train_end AS BIGINT) AS train_end FROM (" + WINDOWS_SQL + ")"}
    out["gbt_walkforward"] = with_ctes(f"SELECT {checked} {tested}", windows)
    out["forest_walkforward"] = with_ctes(f"SELECT {checked}, count(*) AS n_within {tested}", windows)
    out["gbt_base_value"] = with_ctes("""SELECT test_year, train_end,
        round(sum(y / sqrt(1 + y * y)) / sum(pow(1 + y * y, -1.5e0)), 9) + 0e0 AS base
        FROM target JOIN windows ON target_year <= train_end GROUP BY ALL""", windows)
    out["forest_features"] = with_ctes(f"""SELECT {len(CHARACTERISTICS) * 9} + count(*) OVER () AS n_features, sic2 AS code,
        count(*) AS n_rows FROM target WHERE sic2 IS NOT NULL GROUP BY sic2""")
    _tree_oracles(out, "gbt", FEW_BOOSTED, _boosted)
    _tree_oracles(out, "forest", FEW_FOREST, _forest)
    out["run_report"] = _run_report()
    return out


def _run_report():
    """Every number of a linear run's five reports, from the Newton fit of the default threshold."""
    steps, last = _huber_steps(0.999)
    scored = {**steps, "linear": f"""SELECT ranked.*, b0 + {' + '.join(f'b{i} * {x}' for i, x in enumerate(XS, 1))} AS prediction,
        f.train_end AS train_end_year FROM ranked JOIN {last} f ON target_year = f.test_year""",
              "ends": """SELECT *, row_number() OVER (PARTITION BY target_month_id ORDER BY size_for_ranking DESC, permno) AS big,
        row_number() OVER (PARTITION BY target_month_id ORDER BY size_for_ranking, permno) AS small FROM linear WHERE size_for_ranking IS NOT NULL""",
              "yearly": """SELECT target_year AS year, count(*) AS n, avg(y) AS y_mean, avg(prediction) AS pred_mean, stddev_samp(y) AS y_std,
        stddev_samp(prediction) AS pred_std, corr(y, prediction) AS corr_y_pred, sum((y - prediction) ** 2) AS sse, sum(y * y) AS sst_zero,
        100e0 * (1e0 - sum((y - prediction) ** 2) / nullif(sum(y * y), 0)) AS r2_pct FROM linear GROUP BY 1""",
              "drift": """SELECT test_year AS year, train_end, avg(y) FILTER (WHERE target_year <= train_end) AS train_y_mean,
        stddev_pop(y) FILTER (WHERE target_year <= train_end) AS train_y_std, avg(y) FILTER (WHERE target_year = test_year) AS test_y_mean,
        stddev_pop(y) FILTER (WHERE target_year = test_year) AS test_y_std, count(*) FILTER (WHERE target_year <= train_end) AS n_train,
        count(*) FILTER (WHERE target_year = test_year) AS n_test FROM target CROSS JOIN windows GROUP BY 1, 2""",
              "placed": "SELECT *, count(*) OVER () AS n, " + ", ".join(f"row_number() OVER (ORDER BY {c}) - 1 AS {c}_row" for c in ("y", "prediction")) + " FROM linear"}
    spots = {f"{short}_p{p:02d}": f"(SELECT {c} FROM placed WHERE {c}_row = CAST(floor({p / 100} * (n - 1) + 0.5) AS BIGINT))"
             for c, short in (("y", "y"), ("prediction", "pred")) for p in (1, 50, 99)}
    summary = {"r2_all_pct": f"(SELECT {R2} FROM linear)", "r2_top1000_pct": f"(SELECT {R2} FROM ends WHERE big <= 1000)",
               "r2_bottom1000_pct": f"(SELECT {R2} FROM ends WHERE small <= 1000)", "n_obs": "(SELECT count(*) FROM linear)"}

    def melted(name, source, year, values):
        names, numbers = ", ".join(f"'{c}'" for c in values), ", ".join(f"CAST({v} AS DOUBLE)" for v in values.values())
        return f"SELECT '{name}' AS report, {year} AS year, unnest([{names}]) AS measure, unnest([{numbers}]) AS value FROM {source}"

    parts = [melted("drift", "drift", "year", {c: c for c in REPORTS["drift"][1]}), melted("yearly", "yearly", "year", {c: c for c in REPORTS["yearly"][1]}),
             melted("yearly_r2", "yearly", "year", {"r2_pct": "r2_pct"}), melted("quantiles", "(SELECT 1)", "0", spots), melted("r2_summary", "(SELECT 1)", "0", summary)]
    return _materialized(with_ctes(f"SELECT report, CAST(year AS BIGINT) AS year, measure, round(value, 4) + 0e0 AS value FROM ({' UNION ALL '.join(parts)})", scored),
                         ["ranked", *steps, "linear", "ends", "yearly", "placed"])
