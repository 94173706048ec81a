"""The queries in ANSI SQL, where SQL can express them: closed forms over demeaned rows."""

from __future__ import annotations

LINES = "l AS (SELECT *, l_extendedprice / 1000 AS price FROM lineitem)"


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _demeaned(columns: dict[str, str], dims: tuple[str, ...], passes: int = 1, source: str = "l") -> str:
    """CTEs d0, d1, ...: each column less its level means, pass after pass; the last is ``d``."""
    keep = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag"
    grand = ", ".join(f"{e} - avg({e}) OVER () AS {c}" for c, e in columns.items())
    out, last = [f"d0 AS MATERIALIZED (SELECT {keep}, {grand} FROM {source})"], "d0"
    for i in range(passes):
        for j, dim in enumerate(dims):
            name = f"d{i}_{j}"
            means = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {dim}) AS {c}" for c in columns)
            out.append(f"{name} AS MATERIALIZED (SELECT {keep}, {means} FROM {last})")
            last = name
    return ", ".join([*out, f"d AS (SELECT * FROM {last})"])


_XY = {"y": "price", "a": "l_quantity", "b": "l_discount"}
#: Two regressors by Cramer's rule: products, determinant, coefficients, and the inverse of the cross products.
_SOLVE = """
p AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy FROM d),
s AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ba, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM p),
e AS (SELECT *, yy - ba * ay - b2 * byy AS rss, bb / det AS iaa, aa / det AS ibb, -ab / det AS iab FROM s)"""
_BETAS = f"SELECT 'l_quantity' AS term, {_r('ba')} AS estimate FROM e UNION ALL SELECT 'l_discount', {_r('b2')} FROM e"


def _coefficients(va: str, vb: str, source: str = "e") -> str:
    return (
        f"SELECT 'l_quantity' AS term, {_r('ba')} AS estimate, {_r(f'sqrt({va})')} AS std_error FROM {source} "
        f"UNION ALL SELECT 'l_discount', {_r('b2')}, {_r(f'sqrt({vb})')} FROM {source}"
    )


def _design(terms: list[tuple[str, str]], source: str = "l") -> str:
    parts = [f"SELECT '{name}' AS term, {_r(f'sum({value})', 4)} AS total FROM {source}" for name, value in terms]
    return f"WITH {LINES} " + " UNION ALL ".join(parts)


def _dummy(level: int) -> str:
    return f"CASE WHEN l_linenumber = {level} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _group_of(dims: tuple[str, ...]) -> str:
    """A name for the grouping set of a row."""
    return "concat_ws('*', " + ", ".join(f"CASE WHEN grouping({d}) = 0 THEN '{d}' END" for d in dims) + ")"


_THREE = ("l_suppkey", "l_partkey", "l_returnflag")
_MEAT_DIMS = ("l_suppkey", "l_linenumber", "l_returnflag")


def _sets(dims: tuple[str, ...]) -> str:
    from itertools import combinations

    return ", ".join(f"({', '.join(c)})" for k in range(1, len(dims) + 1) for c in combinations(dims, k))


def _iv(z: dict[str, str]) -> str:
    """Two-stage least squares with one endogenous (a), one exogenous (b) regressor and instruments z, by projecting a on (b, z)."""
    return "l AS (SELECT *, l_extendedprice / 1000 AS price, " + ", ".join(f"{e} AS {n}" for n, e in z.items()) + " FROM lineitem)"


_ONE = _demeaned(_XY, ("l_suppkey",))

SQL = {
    "fe_null_drop": f"WITH {LINES}, h AS (SELECT price, CASE WHEN l_linenumber <> 7 THEN l_tax END AS t, l_suppkey FROM l) "
    f"SELECT count(*) AS n, {_r('sum(price)', 3)} AS price FROM h WHERE t IS NOT NULL AND NOT isnan(t) AND price IS NOT NULL AND l_suppkey IS NOT NULL",
    "fe_group_sizes": " UNION ALL ".join(f"SELECT '{d}' AS dim, count(DISTINCT {d}) AS levels FROM lineitem" for d in _THREE),
    "fe_dense_ids": "SELECT o_custkey, row_number() OVER (ORDER BY o_custkey)::INTEGER AS level_id FROM (SELECT DISTINCT o_custkey FROM orders)",
    "fe_dense_ids_text": "SELECT p_brand, row_number() OVER (ORDER BY p_brand)::INTEGER AS level_id FROM (SELECT DISTINCT p_brand FROM part)",
    "fe_factor_levels": "SELECT 'p_size' AS variable, level FROM (SELECT DISTINCT p_size::INTEGER AS level FROM part ORDER BY 1 LIMIT 40) UNION ALL "
    "SELECT 'half', level FROM (SELECT DISTINCT (p_size / 2)::INTEGER AS level FROM part WHERE p_size % 2 = 0 ORDER BY 1 LIMIT 40)",
    "fe_categorical_terms": _design([(f"l_linenumber:{k}", _dummy(k)) for k in range(2, 8)]),
    "fe_categorical_base": _design([(f"l_linenumber:{k}", _dummy(k)) for k in (1, 2, 4, 5, 6, 7)]),
    "fe_interactions": _design([(f"l_discount&l_linenumber:{k}", f"l_discount * {_dummy(k)}") for k in range(2, 8)]),
    "fe_crossed_terms": _design(
        [("&".join(s), " * ".join(s)) for s in (("l_quantity",), ("l_discount",), ("l_tax",), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"), ("l_quantity", "l_discount", "l_tax"))]
    ),
    "fe_group_stats": f"WITH {LINES} SELECT l_suppkey, count(*) AS n, {_r('sum(price)', 4)} AS sum_price, {_r('avg(price)', 9)} AS mean_price, "
    f"{_r('sum(l_quantity)', 4)} AS sum_quantity, {_r('avg(l_quantity)', 9)} AS mean_quantity FROM l GROUP BY l_suppkey",
    "fe_demean_one": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {_r('price - avg(price) OVER w', 9)} AS price, {_r('l_quantity - avg(l_quantity) OVER w', 9)} AS quantity FROM l WINDOW w AS (PARTITION BY l_suppkey)",
    "fe_gram_matrix": f"WITH {LINES}, h AS (SELECT price / 100 AS price, l_quantity / 100 AS l_quantity, l_discount / 100 AS l_discount, l_tax / 100 AS l_tax FROM l) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'sum({a} * {b})', 4)} AS x FROM h"
        for i, a in enumerate(("price", "l_quantity", "l_discount", "l_tax"))
        for b in ("price", "l_quantity", "l_discount", "l_tax")[i:]
    ),
    "fe_ols_one": f"WITH {LINES}, {_ONE}, {_SOLVE}, g AS (SELECT count(DISTINCT l_suppkey) AS levels FROM d), "
    "v AS (SELECT e.*, rss / (n - (2 + levels - 1 + 1)) AS s2 FROM e, g) " + _coefficients("s2 * iaa", "s2 * ibb", "v"),
    "fe_ols_none": f"WITH {LINES}, d AS (SELECT price AS y, l_quantity AS a, l_discount AS b FROM l), {_SOLVE} {_BETAS}",
    "fe_fit_statistics": f"WITH {LINES}, {_ONE}, {_SOLVE}, g AS (SELECT count(DISTINCT l_suppkey) AS levels FROM d), "
    "t AS (SELECT var_pop(price) * count(*) AS tss FROM l), v AS (SELECT e.*, g.levels, t.tss, n - (2 + levels - 1 + 1) AS free FROM e, g, t) "
    f"SELECT n, free AS df, levels - 1 AS fe_dof, {_r('rss / 1000')} AS rss, {_r('tss / 1000')} AS tss, {_r('1 - rss / tss', 9)} AS r2, {_r('1 - rss / yy', 9)} AS r2_within, "
    f"{_r('greatest(0, 1 - rss * (n - 1) / (tss * free))', 9)} AS r2_adjusted, {_r('(tss - rss) / 2 / (rss / free)')} AS f_stat FROM v",
    "fe_ols_two": f"WITH {LINES}, {_demeaned(_XY, ('l_suppkey', 'l_partkey'), 8)}, {_SOLVE} {_BETAS}",
    "fe_ols_three": f"WITH {LINES}, {_demeaned(_XY, _THREE, 8)}, {_SOLVE} {_BETAS}",
    "fe_composite_clusters": f"SELECT dims, count(*) AS clusters FROM (SELECT {_group_of(_THREE)} AS dims FROM lineitem GROUP BY GROUPING SETS ({_sets(_THREE)})) GROUP BY dims",
    "fe_cluster_meats": f"WITH {LINES}, c AS (SELECT {_group_of(_MEAT_DIMS)} AS dims, sum(price / 100) AS s0, sum(l_quantity / 100) AS s1 FROM l GROUP BY GROUPING SETS ({_sets(_MEAT_DIMS)})) "
    f"SELECT dims, count(*) AS clusters, {_r('sum(s0 * s0) / 1000', 4)} AS m0_0, {_r('sum(s0 * s1) / 1000', 4)} AS m0_1, {_r('sum(s1 * s1) / 1000', 4)} AS m1_1 FROM c GROUP BY dims",
    "fe_cluster_one": f"WITH {LINES}, {_ONE}, {_SOLVE}, u AS (SELECT l_suppkey, sum((y - ba * a - b2 * b) * a) AS sa, sum((y - ba * a - b2 * b) * b) AS sb FROM d, e GROUP BY l_suppkey), "
    "m AS (SELECT count(*) AS g, sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb FROM u), "
    "v AS (SELECT e.*, m.*, (n - 1) / (n - 2 - 1) * (g / (g - 1)) AS k FROM e, m) "
    + _coefficients("k * (iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb)", "k * (iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb)", "v"),
    "fe_cluster_two": f"WITH {LINES}, {_demeaned({'y': 'price', 'a': 'l_quantity'}, ('l_suppkey',))}, p AS (SELECT count(*) AS n, sum(a * y) / sum(a * a) AS beta, sum(a * a) AS aa FROM d), "
    "u AS (SELECT grouping(l_suppkey) + grouping(l_linenumber) AS absent, grouping(l_suppkey) AS no_supp, sum((y - beta * a) * a) AS sa FROM d, p GROUP BY GROUPING SETS ((l_suppkey), (l_linenumber), (l_suppkey, l_linenumber))), "
    "m AS (SELECT sum(CASE WHEN absent = 1 THEN sa * sa ELSE -sa * sa END) AS meat, least(count(*) FILTER (absent = 1 AND no_supp = 0), count(*) FILTER (absent = 1 AND no_supp = 1)) AS g FROM u) "
    f"SELECT 'l_quantity' AS term, {_r('beta')} AS estimate, {_r('sqrt(greatest(0, (n - 1) / (n - 1 - 1) * (g / (g - 1)) * meat / (aa * aa)))')} AS std_error FROM p, m",
    "fe_cluster_three": f"WITH {LINES}, {_demeaned(_XY, _THREE, 12)}, {_SOLVE}, "
    + "u AS (SELECT "
    + " + ".join(f"grouping({d})" for d in _THREE)
    + f" AS absent, {_group_of(_THREE)} AS dims, sum((y - ba * a - b2 * b) * a) AS sa, sum((y - ba * a - b2 * b) * b) AS sb FROM d, (SELECT ba, b2 FROM e) GROUP BY GROUPING SETS ({_sets(_THREE)})), "
    "c AS (SELECT dims, any_value(absent) AS absent, count(*) AS g, sum(sa * sa) AS aa, sum(sa * sb) AS ab, sum(sb * sb) AS bb FROM u GROUP BY dims), "
    "m AS (SELECT min(g) FILTER (absent = 2) AS g, sum(CASE WHEN absent = 1 THEN -aa ELSE aa END) AS maa, sum(CASE WHEN absent = 1 THEN -ab ELSE ab END) AS mab, sum(CASE WHEN absent = 1 THEN -bb ELSE bb END) AS mbb FROM c), "
    "k AS (SELECT e.*, m.*, (n - 1) / (n - 2 - 1) * (g / (g - 1)) AS k FROM e, m), "
    "v AS (SELECT ba, b2, k * (iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb) AS va, k * (iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb) AS vb, "
    "k * (iaa * iab * maa + (iaa * ibb + iab * iab) * mab + iab * ibb * mbb) AS vab FROM k), "
    # the repair of a 2 x 2 matrix: of its eigenvalues the negative ones count as zero
    "w AS (SELECT *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + vab * vab) AS l1, (va + vb) / 2 - sqrt((va - vb) * (va - vb) / 4 + vab * vab) AS l2 FROM v) "
    + _coefficients(*(f"CASE WHEN l2 >= 0 THEN {x} WHEN l1 <= 0 THEN 0 ELSE l1 * ({x} - l2) / (l1 - l2) END" for x in ("va", "vb")), "w"),
    "fe_two_stage_clustered": f"WITH {_iv({'z1': 'l_quantity + l_orderkey % 7', 'z2': 'l_quantity + l_partkey % 5'})}, {_demeaned({**_XY, 'z1': 'z1', 'z2': 'z2'}, ('l_suppkey',))}, "
    "q AS (SELECT sum(b * a) / sum(b * b) AS ha, sum(b * y) / sum(b * b) AS hy, sum(b * z1) / sum(b * b) AS h1, sum(b * z2) / sum(b * b) AS h2 FROM d), "
    # everything less what the exogenous regressor explains
    "o AS (SELECT d.l_suppkey, d.a, d.b, d.y, a - ha * b AS ra, y - hy * b AS ry, z1 - h1 * b AS r1, z2 - h2 * b AS r2, ha, hy FROM d, q), "
    "t AS (SELECT sum(r1 * r1) AS s11, sum(r1 * r2) AS s12, sum(r2 * r2) AS s22, sum(r1 * ra) AS s1a, sum(r2 * ra) AS s2a FROM o), "
    "f AS (SELECT (s22 * s1a - s12 * s2a) / (s11 * s22 - s12 * s12) AS p1, (s11 * s2a - s12 * s1a) / (s11 * s22 - s12 * s12) AS p2 FROM t), "
    "h AS (SELECT o.*, p1 * r1 + p2 * r2 AS rh, p1 * r1 + p2 * r2 + ha * b AS hat FROM o, f), "
    "e AS (SELECT count(*) AS n, sum(rh * ry) / sum(rh * ra) AS ba, any_value(hy) - sum(rh * ry) / sum(rh * ra) * any_value(ha) AS b2, sum(hat * a) AS qaa, sum(a * b) AS qab, sum(b * b) AS qbb FROM h), "
    "i AS (SELECT *, qbb / (qaa * qbb - qab * qab) AS iaa, qaa / (qaa * qbb - qab * qab) AS ibb, -qab / (qaa * qbb - qab * qab) AS iab FROM e), "
    "u AS (SELECT l_suppkey, sum((y - ba * a - b2 * b) * hat) AS sa, sum((y - ba * a - b2 * b) * b) AS sb FROM h, (SELECT ba, b2 FROM i) GROUP BY l_suppkey), "
    "m AS (SELECT count(*) AS g, sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb FROM u), "
    "v AS (SELECT i.*, m.*, (n - 1) / (n - 2 - 1) * (g / (g - 1)) AS k FROM i, m) "
    + _coefficients("k * (iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb)", "k * (iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb)", "v"),
    # what the formula means, written out
    "fe_formula_terms": "SELECT kind, place::INTEGER AS place, name FROM (VALUES ('term', 0, 'a'), ('term', 1, 'i.b'), ('term', 2, 'e'), ('term', 3, 'i.f'), "
    "('interaction', 0, 'c&i.d'), ('interaction', 1, 'e&i.f'), ('endogenous', 0, 'a'), ('endogenous', 1, 'i.b'), ('instrument', 0, 'z1'), ('instrument', 1, 'i.z2'), "
    "('fe', 0, 'g'), ('fe', 1, 'h'), ('cluster', 0, 'g')) AS t(kind, place, name)",
    "fe_two_stage": f"WITH {_iv({'z': 'l_quantity + l_orderkey % 7'})}, {_demeaned({**_XY, 'z': 'z'}, ('l_suppkey',))}, "
    "q AS (SELECT count(*) AS n, sum(z * a) AS za, sum(z * b) AS zb, sum(z * y) AS zy, sum(b * a) AS ab, sum(b * b) AS bb, sum(b * y) AS byy, sum(z * z) AS zz FROM d), "
    "e AS (SELECT *, (zy * bb - byy * zb) / (za * bb - ab * zb) AS ba, (za * byy - ab * zy) / (za * bb - ab * zb) AS b2 FROM q), "
    "g AS (SELECT count(DISTINCT l_suppkey) AS levels FROM d), r AS (SELECT sum((y - ba * a - b2 * b) * (y - ba * a - b2 * b)) AS rss FROM d, e), "
    # the projected endogenous regressor is pz z + pb b; Q has its products
    "f AS (SELECT e.*, (za * bb - ab * zb) / (zz * bb - zb * zb) AS pz, (zz * ab - zb * za) / (zz * bb - zb * zb) AS pb FROM e), "
    "h AS (SELECT f.*, pz * za + pb * ab AS qaa, ab AS qab, bb AS qbb, rss / (n - (2 + levels - 1 + 1)) AS s2 FROM f, g, r) "
    + _coefficients("s2 * qbb / (qaa * qbb - qab * qab)", "s2 * qaa / (qaa * qbb - qab * qab)", "h"),
    "fe_effects": f"WITH {LINES}, {_ONE}, {_SOLVE}, u AS (SELECT l_suppkey, count(*) AS n, avg(price - ba * l_quantity - b2 * l_discount) AS m FROM l, (SELECT ba, b2 FROM e) GROUP BY l_suppkey), "
    f"c AS (SELECT sum(m * n) / sum(n) AS centre FROM u) SELECT l_suppkey, n, {_r('m - centre')} AS fe_value FROM u, c",
    "fe_effects_two": f"WITH {LINES}, {_demeaned({'y': 'price', 'a': 'l_quantity'}, ('l_suppkey', 'l_linenumber'), 8)}, p AS (SELECT sum(a * y) / sum(a * a) AS beta FROM d), "
    # residuals before absorption less those after it are the sum of both effects; its level means, centred and swept, give one of them
    "r AS (SELECT l.l_suppkey, l.l_linenumber, (price - beta * l_quantity) - (y - beta * a) AS u FROM l JOIN d ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber AND l.l_suppkey = d.l_suppkey AND l.l_partkey = d.l_partkey, p), "
    "k AS (SELECT l_suppkey, l_linenumber, avg(u) AS u FROM r GROUP BY 1, 2), "
    "f AS (SELECT a.l_linenumber, avg(a.u - b.u) AS v FROM k a JOIN k b ON a.l_suppkey = b.l_suppkey AND b.l_linenumber = 1 GROUP BY 1), "
    "n AS (SELECT l_linenumber, count(*) AS n FROM l GROUP BY 1), c AS (SELECT sum(v * n) / sum(n) AS centre FROM f JOIN n USING (l_linenumber)) "
    f"SELECT l_linenumber, n, {_r('v - centre', 5)} AS fe_value FROM f JOIN n USING (l_linenumber), c",
    "fe_tenure": "WITH t AS (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY user_id, ts), "
    "c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM c), "
    "k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts) - 1 AS tenure FROM r) "
    "SELECT user_id, count(*) AS n, sum(tenure)::BIGINT AS total, max(tenure)::BIGINT AS longest FROM k GROUP BY user_id",
    "fe_panel_file": "SELECT s_acctbal::DOUBLE AS s_acctbal, s_suppkey::DOUBLE AS s_suppkey, dense_rank() OVER (ORDER BY s_nationkey)::INTEGER AS s_nationkey FROM supplier",
    "fe_text_fixed_effects": "WITH o AS (SELECT o_orderpriority, o_totalprice / 1000 AS price, day(o_orderdate)::DOUBLE AS d FROM orders), "
    "w AS (SELECT price - avg(price) OVER p AS y, d - avg(d) OVER p AS x FROM o WINDOW p AS (PARTITION BY o_orderpriority)) "
    f"SELECT 'day' AS term, {_r('sum(x * y) / sum(x * x)')} AS estimate FROM w",
}
