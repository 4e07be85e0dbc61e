"""Plain-SQL statements (DuckDB dialect) that compute the same results as the catalog.

They are the independent side of the correctness check: each statement restates the
definitions (scan rules, score, gains, half-pass decision, compression) in SQL over the
raw tables, with no shared code path. Iterative results are written out as a fixed
number of unrolled half-passes, the number the loop takes on the sf0.01 tables.
"""

from __future__ import annotations

# Fixed value: supplier ids are shifted by this amount in the part-supplier graph.
SUPPLIER_OFFSET = 1_000_000_000
LONG_MAX = 9223372036854775807

# Graph definitions over the base tables.
PART_SUPP = (f"SELECT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey + {SUPPLIER_OFFSET} AS BIGINT) AS dst, "
             "CAST(count(*) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2")
COPART_ADJ = ("SELECT CAST(a.l_partkey AS BIGINT) AS src, CAST(b.l_partkey AS BIGINT) AS dst, CAST(1 AS BIGINT) AS weight "
              "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber")
NATION_TRADE = ("SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, "
                "CAST(count(*) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
BRAND = ("SELECT CAST(p_partkey AS BIGINT) AS id, "
         "CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS community FROM part")
REGION = "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS community FROM nation"

# Unrolled half-pass counts on the sf0.01 tables.
PART_SUPP_LEVEL0_HALF_PASSES_DEFAULT = 4      # (2000, 1)
PART_SUPP_MULTILEVEL_HALF_PASSES = (6, 6)     # (2000, 2): level 0, level 1


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def score(n: str, a: str, t: str, N: str) -> str:
    return (f"(CASE WHEN ({n}) <= 1 OR ({t}) = 0 THEN CAST(0 AS DOUBLE) ELSE "
            f"(CAST(2 AS DOUBLE) * {d(a)} * {d(a)}) / (({d(n)} - CAST(1 AS DOUBLE)) * {d(t)} * {d(N)}) END)")


def reported(n: str, a: str, t: str, N: str) -> str:
    return (f"(CASE WHEN ({n}) <= 1 OR (({a}) + ({t})) = 0 THEN CAST(0 AS DOUBLE) ELSE "
            f"(CAST(2 AS DOUBLE) * {d(a)} * {d(a)}) / (({d(n)} - CAST(1 AS DOUBLE)) * {d(f'({a}) + ({t})')} * {d(N)}) END)")


def round9(x: str) -> str:
    return f"(CAST(round(({x}) * CAST(1000000000 AS DOUBLE)) AS BIGINT) / CAST(1000000000 AS DOUBLE))"


def _with(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes) + "\n" + body


def level0_ctes(raw_sql: str) -> list[tuple[str, str]]:
    """raw -> merged edges e0, symmetric sym0, vertex constants v0, N."""
    return [
        ("raw", raw_sql),
        ("e0", "SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM raw GROUP BY src, dst"),
        ("sym0", "SELECT id, nbr, CAST(sum(w) AS BIGINT) AS w FROM (SELECT src AS id, dst AS nbr, weight AS w FROM e0 "
                 "UNION ALL SELECT dst, src, weight FROM e0) GROUP BY id, nbr"),
        ("v0", "SELECT id, CAST(sum(w) AS BIGINT) AS out_w, CAST(1 AS BIGINT) AS int_n, CAST(0 AS BIGINT) AS int_w "
               "FROM sym0 GROUP BY id"),
        ("nn", "SELECT CAST(count(*) AS BIGINT) AS n_total FROM v0"),
    ]


def inc_sql(sym: str, assign: str) -> str:
    return (f"SELECT s.id, x.community AS c, CAST(sum(s.w) AS BIGINT) AS inc_w FROM {sym} s "
            f"JOIN {assign} x ON s.nbr = x.id GROUP BY s.id, x.community")


def own_sql(inc: str, assign: str) -> str:
    return f"SELECT i.id, i.inc_w AS inc_own FROM {inc} i JOIN {assign} x ON i.id = x.id AND i.c = x.community"


def xv_sql(assign: str, vert: str) -> str:
    """Assignment with the vertex constants (one two-way join per CTE keeps DuckDB's join
    order fixed; its reordering of the longer chains does not finish)."""
    return (f"SELECT x.id, x.community, v.out_w, v.int_n, v.int_w FROM {assign} x JOIN {vert} v ON x.id = v.id")


def stats_ctes(ctes: list[tuple[str, str]], p: str, edges: str, xv: str) -> None:
    """``{p}_st``: statistics from the edges. a is the weight inside a community and inside its
    vertices, t adds every edge that leaves it, once for each of its two communities."""
    ctes.append((f"{p}_sa", f"SELECT x.community AS cs, e.dst, e.weight FROM {edges} e JOIN {xv} x ON e.src = x.id"))
    ctes.append((f"{p}_sb", f"SELECT s.cs, x.community AS cd, s.weight FROM {p}_sa s JOIN {xv} x ON s.dst = x.id"))
    ctes.append((f"{p}_sc", f"SELECT community, sum(inside) AS inside, sum(leaving) AS leaving FROM ("
                            f"SELECT cs AS community, CASE WHEN cs = cd THEN weight ELSE 0 END AS inside, "
                            f"CASE WHEN cs <> cd THEN weight ELSE 0 END AS leaving FROM {p}_sb UNION ALL "
                            f"SELECT cd, 0, weight FROM {p}_sb WHERE cs <> cd) GROUP BY community"))
    ctes.append((f"{p}_sv", f"SELECT community, sum(int_n) AS n, sum(int_w) AS w FROM {xv} GROUP BY community"))
    ctes.append((f"{p}_st", f"SELECT v.community, CAST(v.n AS BIGINT) AS n, "
                            f"CAST(v.w + coalesce(c.inside, 0) AS BIGINT) AS a, "
                            f"CAST(v.w + coalesce(c.inside, 0) + coalesce(c.leaving, 0) AS BIGINT) AS t "
                            f"FROM {p}_sv v LEFT JOIN {p}_sc c ON v.community = c.community"))


def edges_of(sym: str) -> str:
    """The edge CTE behind a symmetric one."""
    return {"sym0": "e0"}.get(sym) or sym.removesuffix("_sym") + "_e"


def initial_stats_sql(vert: str) -> str:
    return (f"SELECT id AS community, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS a, out_w AS t FROM {vert}")


def cand_rows_sql(inc: str, xv: str) -> str:
    return (f"SELECT i.id, i.c, i.inc_w, x.out_w, x.int_n, x.int_w FROM {inc} i JOIN {xv} x ON i.id = x.id "
            f"WHERE i.c <> x.community")


def cand_sql(rows: str, stats: str) -> str:
    N = "nn.n_total"
    after = score("s.n + i.int_n", "s.a + i.inc_w + i.int_w", "s.t + i.out_w - i.inc_w + i.int_w", N)
    before = score("s.n", "s.a", "s.t", N)
    return (f"SELECT i.id, i.c, i.inc_w, ({after} - {before}) AS gain FROM {rows} i "
            f"JOIN {stats} s ON s.community = i.c CROSS JOIN nn")


def best_sql(cand: str) -> str:
    return (f"SELECT id, c AS best_c, gain AS best_gain FROM (SELECT id, c, gain, row_number() OVER "
            f"(PARTITION BY id ORDER BY gain DESC, c DESC) AS rn FROM {cand}) WHERE rn = 1")


def own_stats_sql(xv: str, stats: str) -> str:
    return (f"SELECT x.id, x.community, x.out_w, x.int_n, x.int_w, s.n, s.a, s.t FROM {xv} x "
            f"JOIN {stats} s ON s.community = x.community")


def with_own_sql(xs: str, own: str) -> str:
    return f"SELECT x.*, o.inc_own FROM {xs} x LEFT JOIN {own} o ON x.id = o.id"


def decision_sql(xso: str, best: str) -> str:
    N = "nn.n_total"
    inc = "coalesce(x.inc_own, 0)"
    stay = (f"({score('x.n', 'x.a', 'x.t', N)} - "
            f"{score('x.n - x.int_n', f'x.a - x.int_w - {inc}', f'x.t - x.out_w - x.int_w + {inc}', N)})")
    return (f"SELECT x.id, x.community, b.best_c, b.best_gain, {stay} AS stay, "
            f"CASE WHEN x.inc_own IS NOT NULL THEN greatest({stay}, CAST(0 AS DOUBLE)) ELSE {stay} END AS own_value "
            f"FROM {xso} x LEFT JOIN {best} b ON x.id = b.id CROSS JOIN nn")


def half_pass_ctes(ctes: list[tuple[str, str]], p: str, sym: str, vert: str, prev: str,
                   stats: str | None) -> str:
    """CTEs of one half-pass from assignment ``prev``; returns the decision CTE name."""
    ctes.append((f"{p}_inc", inc_sql(sym, prev)))
    ctes.append((f"{p}_own", own_sql(f"{p}_inc", prev)))
    ctes.append((f"{p}_xv", xv_sql(prev, vert)))
    if stats is not None:
        ctes.append((f"{p}_st", stats))
    else:
        stats_ctes(ctes, p, edges_of(sym), f"{p}_xv")
    ctes.append((f"{p}_rows", cand_rows_sql(f"{p}_inc", f"{p}_xv")))
    ctes.append((f"{p}_cand", cand_sql(f"{p}_rows", f"{p}_st")))
    ctes.append((f"{p}_best", best_sql(f"{p}_cand")))
    ctes.append((f"{p}_xs", own_stats_sql(f"{p}_xv", f"{p}_st")))
    ctes.append((f"{p}_xso", with_own_sql(f"{p}_xs", f"{p}_own")))
    ctes.append((f"{p}_dec", decision_sql(f"{p}_xso", f"{p}_best")))
    return f"{p}_dec"


def target_expr() -> str:
    own_tb = f"(CASE WHEN own_value > 0 THEN community ELSE {LONG_MAX} END)"
    take = (f"(best_c IS NOT NULL AND (best_gain > own_value OR (best_gain = own_value AND best_c > {own_tb})))")
    return f"(CASE WHEN {take} THEN best_c ELSE community END)"


def next_assign_sql(dec: str, down: bool) -> str:
    tgt = target_expr()
    cmp = ">" if down else "<"
    move = f"({tgt} <> community AND community {cmp} {tgt})"
    return f"SELECT id, CASE WHEN {move} THEN {tgt} ELSE community END AS community, {move} AS changed FROM {dec}"


def unrolled_level(ctes: list[tuple[str, str]], tag: str, sym: str, vert: str, start_assign: str,
                   first_stats: str | None, half_passes: int) -> str:
    """Append CTEs for ``half_passes`` half-passes; returns the name of the final assignment."""
    prev = start_assign
    for k in range(1, half_passes + 1):
        p = f"{tag}h{k}"
        dec = half_pass_ctes(ctes, p, sym, vert, prev, first_stats if k == 1 else None)
        ctes.append((f"{p}_a", next_assign_sql(dec, down=(k % 2 == 1))))
        prev = f"{p}_a"
    return prev


def final_stats(ctes: list[tuple[str, str]], tag: str, sym: str, vert: str, assign: str) -> str:
    ctes.append((f"{tag}f_xv", xv_sql(assign, vert)))
    stats_ctes(ctes, f"{tag}f", edges_of(sym), f"{tag}f_xv")
    return f"{tag}f_st"


def compress_ctes(ctes: list[tuple[str, str]], tag: str, edges: str, assign: str, stats: str) -> tuple[str, str, str]:
    """Next level's edges, sym and vertices from a labelled level."""
    ctes.append((f"{tag}_e", f"SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, "
                             f"CAST(sum(e.weight) AS BIGINT) AS weight FROM {edges} e JOIN {assign} a ON e.src = a.id "
                             f"JOIN {assign} b ON e.dst = b.id WHERE a.community <> b.community GROUP BY 1, 2"))
    ctes.append((f"{tag}_sym", f"SELECT id, nbr, CAST(sum(w) AS BIGINT) AS w FROM (SELECT src AS id, dst AS nbr, weight AS w "
                               f"FROM {tag}_e UNION ALL SELECT dst, src, weight FROM {tag}_e) GROUP BY id, nbr"))
    ctes.append((f"{tag}_v", f"SELECT community AS id, t - a AS out_w, n AS int_n, a AS int_w FROM {stats}"))
    return f"{tag}_e", f"{tag}_sym", f"{tag}_v"


def singleton_sql(vert: str) -> str:
    return f"SELECT id, id AS community, false AS changed FROM {vert}"


# ---------------------------------------------------------------------------------------
# Statements per catalog key.

_SCAN_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def _scan_classify(lines_sql: str, delim: str, ip: bool) -> str:
    """Per line: tokens and reject reason, mirroring the scan rules."""
    toks = (f"list_transform(regexp_split_to_array(regexp_replace(line, '(?:{delim})+$', ''), '{delim}'), "
            f"lambda x: regexp_replace(x, {_SCAN_TRIM}, '', 'g'))")
    if ip:
        okid = ("(regexp_full_match(tk, '([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})') AND "
                "list_max(list_transform(string_split(tk, '.'), lambda o: CAST(o AS INTEGER))) <= 255)")
        id_reason = "'bad_address'"
    else:
        okid = "(regexp_full_match(tk, '[+-]?[0-9]+') AND TRY_CAST(tk AS BIGINT) IS NOT NULL)"
        id_reason = "'bad_integer'"
    ok0 = okid.replace("tk", "toks[1]")
    ok1 = okid.replace("tk", "toks[2]")
    return (f"SELECT line, toks, CASE WHEN len(toks) < 2 OR len(toks) > 3 THEN 'token_count' "
            f"WHEN NOT (coalesce({ok0}, false) AND coalesce({ok1}, false)) THEN {id_reason} "
            f"WHEN len(toks) = 3 AND NOT (regexp_full_match(toks[3], '[+-]?[0-9]+') AND TRY_CAST(toks[3] AS BIGINT) IS NOT NULL) "
            f"THEN 'bad_integer' END AS reason "
            f"FROM (SELECT line, {toks} AS toks FROM ({lines_sql}))")


def _ip_text(x: str) -> str:
    return (f"concat_ws('.', CAST(({x} >> 24) & 255 AS VARCHAR), CAST(({x} >> 16) & 255 AS VARCHAR), "
            f"CAST(({x} >> 8) & 255 AS VARCHAR), CAST({x} & 255 AS VARCHAR))")


def _ip_value(s: str) -> str:
    parts = [f"CAST(split_part({s}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return f"((({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]})"


# The multipliers spreading table keys over the address space.
IP_KEY_MULT_ORDERS = 2654435761
IP_KEY_MULT_CUSTOMER = 40503


def _rejects_lines() -> str:
    good = f"SELECT concat_ws(',', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), CAST(weight AS VARCHAR)) AS line FROM ({PART_SUPP})"
    bad = [
        "SELECT concat_ws(',', n_name, CAST(n_regionkey AS VARCHAR)) AS line FROM nation",
        "SELECT r_name AS line FROM region",
        "SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority) AS line FROM orders",
        "SELECT concat_ws(',', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), '1', '2') AS line FROM customer",
        "SELECT concat_ws(',', CAST(s_suppkey AS VARCHAR), '', CAST(s_nationkey AS VARCHAR)) AS line FROM supplier",
        "SELECT concat('99999999999999999999,', CAST(p_partkey AS VARCHAR)) AS line FROM part",
        "SELECT concat(CAST(p_partkey AS VARCHAR), ',2,-99999999999999999999') AS line FROM part",
    ]
    return " UNION ALL ".join([good] + bad)


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    L0 = level0_ctes

    # --- sources -----------------------------------------------------------------------
    scan_lines = (f"SELECT concat(' ', CAST(src AS VARCHAR), ' , ', CAST(dst AS VARCHAR), ',', CAST(weight AS VARCHAR), ',') "
                  f"AS line FROM ({PART_SUPP})")
    q["edge_scan"] = (f"SELECT CAST(toks[1] AS BIGINT) AS src, CAST(toks[2] AS BIGINT) AS dst, "
                      f"CASE WHEN len(toks) = 3 THEN CAST(toks[3] AS BIGINT) ELSE 1 END AS weight "
                      f"FROM ({_scan_classify(scan_lines, ',', False)}) WHERE reason IS NULL")
    q["edge_scan_files"] = PART_SUPP
    q["edge_scan_default_weight"] = f"SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM ({COPART_ADJ})"
    q["edge_scan_rejects"] = f"SELECT line, reason FROM ({_scan_classify(_rejects_lines(), ',', False)}) WHERE reason IS NOT NULL"
    q["edge_scan_ip"] = f"SELECT src, dst, weight FROM ({PART_SUPP})"
    okey = f"((o_orderkey * {IP_KEY_MULT_ORDERS} + o_custkey) % 4294967296)"
    q["ip_to_long"] = (f"SELECT o_orderkey AS key, ip, {_ip_value('ip')} AS value FROM "
                       f"(SELECT o_orderkey, {_ip_text(okey)} AS ip FROM orders)")
    ckey = f"(c_custkey * {IP_KEY_MULT_CUSTOMER} + c_nationkey)"
    q["long_to_ip"] = f"SELECT c_custkey AS key, {ckey} AS address, {_ip_text(ckey)} AS value FROM customer"

    # --- graph building ----------------------------------------------------------------
    q["vertices_from_edges"] = f"SELECT src AS id FROM ({COPART_ADJ}) UNION SELECT dst FROM ({COPART_ADJ})"
    q["graph_counts"] = (f"SELECT (SELECT count(*) FROM (SELECT src AS id FROM g UNION SELECT dst FROM g)) AS vertices, "
                         f"count(*) AS edges, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM g)) AS distinct_edges, "
                         f"count(*) FILTER (WHERE src = dst) AS self_loops FROM g").replace("FROM g", f"FROM ({COPART_ADJ}) g")
    q["weighted_degree"] = (f"SELECT id, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS id, weight FROM ({COPART_ADJ}) "
                            f"UNION ALL SELECT dst, weight FROM ({COPART_ADJ})) GROUP BY id")
    q["merge_edges"] = f"SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM ({COPART_ADJ}) GROUP BY src, dst"
    q["symmetrize"] = _with(L0(COPART_ADJ), "SELECT id, nbr, w FROM sym0")
    q["init_state"] = _with(L0(PART_SUPP), "SELECT id, id AS community, out_w, int_n, int_w, CAST(1 AS BIGINT) AS n, "
                                           "out_w AS t, CAST(0 AS BIGINT) AS a, false AS changed FROM v0")
    q["triplets"] = _with(L0(NATION_TRADE) + [("lab", REGION)],
                          "SELECT e.src, e.dst, e.weight, s.community AS src_community, t.community AS dst_community "
                          "FROM e0 e JOIN lab s ON e.src = s.id JOIN lab t ON e.dst = t.id")

    # --- single half-pass operators on a fixed labelling (brand of each part) -------------
    brand = L0(COPART_ADJ) + [("lab", f"SELECT b.id, b.community FROM ({BRAND}) b JOIN v0 ON b.id = v0.id")]
    brand += [("inc", inc_sql("sym0", "lab")), ("own", own_sql("inc", "lab")), ("xv", xv_sql("lab", "v0"))]
    stats_ctes(brand, "b", "e0", "xv")
    brand += [("st", "SELECT * FROM b_st")]
    q["incident"] = _with(brand, "SELECT id, c AS community, inc_w FROM inc")
    q["community_stats"] = _with(brand, "SELECT community, n, a, t FROM st")
    q["state_with_stats"] = _with(brand, "SELECT x.id, x.community, s.n, s.a, s.t FROM lab x JOIN st s ON x.community = s.community")
    N = "(SELECT n_total FROM nn)"
    q["community_score"] = _with(brand, f"SELECT community, {score('n', 'a', 't', N)} AS score FROM st")
    q["reported_score"] = _with(brand, f"SELECT community, {reported('n', 'a', 't', N)} AS reported_score FROM st")
    dec = brand + [("rows", cand_rows_sql("inc", "xv")), ("cand", cand_sql("rows", "st")), ("best", best_sql("cand")),
                   ("xs", own_stats_sql("xv", "st")), ("xso", with_own_sql("xs", "own")),
                   ("dec", decision_sql("xso", "best"))]
    q["join_gain"] = _with(dec, "SELECT id, c AS community, gain FROM cand")
    q["stay_gain"] = _with(dec, "SELECT id, community, stay AS gain FROM dec")
    q["best_move"] = _with(dec, f"SELECT id, community, {target_expr()} AS best_community FROM dec")
    comp = list(brand)
    e1, _, v1 = compress_ctes(comp, "c1", "e0", "lab", "st")
    q["compress_vertices"] = _with(comp, f"SELECT id, out_w, int_n, int_w FROM {v1}")
    q["compress_edges"] = _with(comp, f"SELECT src, dst, weight FROM {e1}")

    # --- iterative results on part_supp --------------------------------------------------
    def part_supp_half_passes(k: int) -> tuple[list[tuple[str, str]], str]:
        ctes = L0(PART_SUPP) + [("a0", singleton_sql("v0")), ("s0", initial_stats_sql("v0"))]
        last = unrolled_level(ctes, "l0", "sym0", "v0", "a0", "SELECT * FROM s0", k)
        return ctes, last

    for k in (1, 2):
        ctes, last = part_supp_half_passes(k)
        q[f"half_pass_{k}"] = _with(ctes, f"SELECT id, community, changed FROM {last}")

    k0 = PART_SUPP_LEVEL0_HALF_PASSES_DEFAULT
    ctes, last = part_supp_half_passes(k0)
    q["changed_count"] = _with(ctes, " UNION ALL ".join(
        f"SELECT {i} AS half_pass, CAST(count(*) FILTER (WHERE changed) AS BIGINT) AS moved FROM l0h{i}_a"
        for i in range(1, k0 + 1)))
    q["local_moving"] = _with(ctes, f"SELECT id, community FROM {last}")
    st = final_stats(ctes, "l0", "sym0", "v0", last)
    total_score = round9("sum(" + score("n", "a", "t", N) + ")")
    total_reported = round9("greatest(sum(" + reported("n", "a", "t", N) + "), 0)")
    q["level_scores"] = _with(ctes, (
        f"SELECT 0 AS level, {total_score} AS score, {total_reported} AS reported_score, "
        f"{k0 // 2} AS passes, CAST(count(*) AS BIGINT) AS communities FROM {st}"))
    q["level_state"] = _with(ctes, (
        f"SELECT 0 AS level, x.id, x.community, v.out_w, v.int_n, v.int_w, s.n, s.t, s.a, x.changed "
        f"FROM {last} x JOIN v0 v ON x.id = v.id JOIN {st} s ON x.community = s.community"))
    q["level_state_text"] = _with(ctes, (
        f"SELECT x.id, printf('(%d,{{ community: %d, communitySigmaTotal: %d, internalWeight: %d, nodeWeight: %d, "
        f"internalVertices: %d, communityVertices: %d, communityInternalWeight: %d }})', x.id, x.community, s.t, "
        f"v.int_w, v.out_w, v.int_n, s.n, s.a) AS line "
        f"FROM {last} x JOIN v0 v ON x.id = v.id JOIN {st} s ON x.community = s.community"))

    h0, h1 = PART_SUPP_MULTILEVEL_HALF_PASSES
    ctes = L0(PART_SUPP) + [("a0", singleton_sql("v0")), ("s0", initial_stats_sql("v0"))]
    a_l0 = unrolled_level(ctes, "l0", "sym0", "v0", "a0", "SELECT * FROM s0", h0)
    st0 = final_stats(ctes, "l0", "sym0", "v0", a_l0)
    _, sym1, v1 = compress_ctes(ctes, "c1", "e0", a_l0, st0)
    ctes.append(("a1", singleton_sql(v1)))
    a_l1 = unrolled_level(ctes, "l1", sym1, v1, "a1", None, h1)
    ctes.append(("m0", f"SELECT id AS vertex, community FROM {a_l0}"))
    ctes.append(("m1", f"SELECT m.vertex, x.community FROM m0 m JOIN {a_l1} x ON m.community = x.id"))
    ctes.append(("mem", "SELECT 0 AS level, vertex, community FROM m0 UNION ALL SELECT 1, vertex, community FROM m1"))
    # Two unrolled levels chained through the compression step.
    q["multilevel"] = _with(ctes, f"SELECT 0 AS level, id, community FROM {a_l0} UNION ALL SELECT 1, id, community FROM {a_l1}")
    q["level_hooks"] = _with(ctes, (
        f"SELECT 'level' AS hook, 0 AS level, id, community FROM {a_l0} UNION ALL "
        f"SELECT 'level', 1, id, community FROM {a_l1} UNION ALL "
        f"SELECT 'membership', level, vertex, community FROM mem UNION ALL "
        f"SELECT 'final', 1, id, community FROM {a_l1}"))
    q["membership"] = _with(ctes, "SELECT level, vertex, community FROM mem")
    q["community_members"] = _with(ctes, (
        "SELECT level, community, CAST(count(*) AS BIGINT) AS size, "
        "string_agg(CAST(vertex AS VARCHAR), ',' ORDER BY vertex) AS members FROM mem GROUP BY level, community"))
    return q
