"""Classification of text-line boxes and what follows from it, as layers of SQL.

Each layer selects from the one before and adds columns or drops rows, mostly
by windows over a page, so the optimizer needs one exchange by page_id for
nearly all of them. Pages are independent rows of work; nothing is collected.
"""

from __future__ import annotations

from ..config import Settings
from .dialect import Dialect

#: Page context of the box adapter.
PAGE = {"px1": 0, "py1": 0, "px2": 1000, "py2": 1560, "char_h": 20}
ORDER = "x1, y1, x2, y2, source, ink_px, contrast, headline, latin_ocr NULLS FIRST"
P = "PARTITION BY page_id"

# Reasons as they stand in results.
OUTSIDE = "text outside manuscript substrate"
LATIN = "English/Latin script"
PENCIL = "low-contrast (pencil/faint) strokes"
BLOB = "large non-text-like blob (decoration)"
VERTICAL = "vertical writing in margin"
BESIDE = "outside main text column"
ABOVE = "separated block above main text"
BELOW = "separated block below main text"
MAIN = "main text block"
TOP_MARK = "small mark in top margin (folio/number)"
BOTTOM_MARK = "small mark in bottom margin (page no./catchword)"
FRAGMENT = "fragment adjacent to "


def adapter(d: Dialect) -> str:
    """Line boxes made of lineitem."""
    n, fl = d.num, (lambda x: f"CAST(FLOOR({x}) AS BIGINT)")
    return f"""
SELECT page_id, source, x1, y1, x1 + w AS x2, y1 + h AS y2, CAST(FLOOR(w * h * {n(0.25)}) AS BIGINT) AS ink_px, CAST(contrast AS DOUBLE) AS contrast, headline, latin_ocr
FROM (
  SELECT {d.div("l_orderkey", "16")} AS page_id,
    CASE WHEN l_partkey % 97 = 0 THEN 'outside' ELSE 'page' END AS source,
    CASE kind WHEN 0 THEN 100 + l_suppkey % 10 WHEN 1 THEN 40 + l_suppkey % 9 ELSE 905 + l_suppkey % 9 END AS x1,
    60 + 44 * (CASE WHEN l_partkey % 26 = 0 THEN 0 WHEN l_partkey % 26 >= 24 THEN l_partkey % 26 + 7 ELSE l_partkey % 26 + 3 END) + l_suppkey % 5 AS y1,
    CASE kind WHEN 0 THEN 260 + 10 * qty WHEN 1 THEN 30 + qty ELSE 20 + qty END AS w,
    CASE WHEN kind = 1 AND l_suppkey % 4 = 0 THEN 215 ELSE 18 + l_partkey % 9 END AS h,
    {fl("l_extendedprice")} % 140 + 40 AS contrast,
    {fl(f"l_tax * 100 + {n(0.5)}")} / {n(10)} AS headline,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE {fl(f"l_discount * 100 + {n(0.5)}")} / {n(12)} END AS latin_ocr
  FROM (SELECT *, {fl("l_quantity")} AS qty, CASE WHEN l_linenumber < 7 THEN 0 WHEN l_partkey % 2 = 0 THEN 1 ELSE 2 END AS kind FROM lineitem) b) t"""


def context(d: Dialect, lines: str) -> str:
    cols = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in PAGE.items())
    return f"SELECT *, {cols} FROM ({lines}) z"


def featured(d: Dialect, lines: str) -> str:
    """Derived sizes, Latin score, and the total order of a page's lines."""
    n = d.num
    return f"""
SELECT *, CASE WHEN latin_ocr IS NULL OR w <= {n(1.5)} * h THEN {n(0.5)} * (1 - headline) ELSE latin_ocr * (1 - {n(0.6)} * headline) END AS latin,
  CAST(row_number() OVER ({P} ORDER BY {ORDER}) AS BIGINT) AS seq
FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / {n(2)} AS cx, (y1 + y2) / {n(2)} AS cy FROM ({lines}) z) z"""


def stats(d: Dialect, lines: str) -> str:
    flat = "source = 'page' AND w > 3 * h"
    return f"""
SELECT *, coalesce({d.pct(f"CASE WHEN {flat} THEN contrast END", 0.5, P)}, {d.num(0)}) AS med_contrast,
  coalesce({d.pct(f"CASE WHEN {flat} THEN h END", 0.5, P)}, {d.pct("h", 0.5, P)}) AS line_h
FROM ({lines}) z"""


def kept(d: Dialect, lines: str) -> str:
    """Without specks, and without faint or thin strips at the page's edge."""
    n = d.num
    e = f"greatest({n(3)}, {n(0.6)} * line_h)"
    touch = f"(x1 <= px1 + {e} OR y1 <= py1 + {e} OR x2 >= px2 - {e} OR y2 >= py2 - {e})"
    faint = f"(contrast < {n(0.45)} * med_contrast OR (h < {n(0.5)} * line_h AND w > 6 * h))"
    return f"""
SELECT * FROM ({lines}) z
WHERE (greatest(w, h) >= {n(0.7)} * char_h OR source = 'outside') AND NOT (source = 'page' AND med_contrast > 0 AND {touch} AND {faint})"""


def filler(d: Dialect, c: Settings, lines: str) -> str:
    n, ratio = d.num, d.num(c.pencil_contrast_ratio)
    rules = [
        ("source = 'outside'", n(0.9), OUTSIDE),
        (f"latin >= {n(c.latin_threshold)}", f"{n(0.5)} + {n(0.5)} * latin", LATIN),
        (f"med_contrast > 0 AND contrast < {ratio} * med_contrast AND h > {n(0.35)} * line_h", f"{n(0.55)} + {n(0.4)} * (1 - contrast / med_contrast / {ratio})", PENCIL),
        (f"h > 3 * line_h AND w > 3 * line_h AND ink_px / {n(1)} / greatest(1, w * h) < {n(0.12)} AND w < 3 * h", n(0.5), BLOB),
    ]
    conf = " ".join(f"WHEN {a} THEN {b}" for a, b, _ in rules)
    why = " ".join(f"WHEN {a} THEN '{x}'" for a, _, x in rules)
    return f"SELECT *, fill_reason IS NULL AS body FROM (SELECT *, CASE {conf} END AS fill_conf, CASE {why} END AS fill_reason FROM ({lines}) z) z"


def core(d: Dialect, c: Settings, lines: str) -> str:
    # engines interpolate in another order, so what is compared with a width is rounded to a millionth
    n = d.num
    return f"""
SELECT *, body AND (wide OR max(CASE WHEN wide THEN 1 ELSE 0 END) OVER ({P}) = 0) AS is_core
FROM (SELECT *, body AND w >= {n(c.core_width_frac)} * p90 AND w > 3 * h AS wide
      FROM (SELECT *, FLOOR({d.pct("CASE WHEN body THEN w END", 0.9, P)} * 1000000 + {n(0.5)}) / {n(1000000)} AS p90 FROM ({lines}) z) z) z"""


def extent(d: Dialect, lines: str) -> str:
    """page_id, core_l, core_r: first and last column that enough core lines cover, by a sweep over their ends."""
    return f"""
SELECT page_id, CAST(min(x) AS DOUBLE) AS core_l, CAST(max(nx) - 1 AS DOUBLE) AS core_r
FROM (SELECT *, max(cov) OVER ({P}) AS top
      FROM (SELECT page_id, x, sum(d) OVER ({P} ORDER BY x ROWS UNBOUNDED PRECEDING) AS cov, lead(x) OVER ({P} ORDER BY x) AS nx
            FROM (SELECT page_id, x, sum(d) AS d FROM (SELECT page_id, {d.edges(("x1", "1"), ("x2", "-1"))} FROM ({lines}) z WHERE is_core) z GROUP BY page_id, x) z) z) z
WHERE cov > 0 AND cov >= {d.num(0.25)} * greatest({d.num(1)}, top) GROUP BY page_id"""


def clip(x: str, d: Dialect) -> str:
    return f"greatest({d.num(0)}, least({d.num(1)}, {x}))"


def sides(d: Dialect, c: Settings, lines: str) -> str:
    n = d.num
    dist = "greatest(core_l - cx, cx - core_r)"
    tol = f"({n(c.side_margin_tol)} * char_h + {n(0.02)} * (core_r - core_l))"
    return f"""
SELECT *, body AND side_reason IS NULL AS rest FROM (
  SELECT *, CASE WHEN NOT body THEN NULL WHEN upright THEN '{VERTICAL}' WHEN beside THEN '{BESIDE}' END AS side_reason,
    CASE WHEN NOT body THEN NULL WHEN upright THEN {n(0.75)} WHEN beside THEN {n(0.55)} + {n(0.4)} * {clip(f"{dist} / (4 * char_h)", d)} END AS side_conf
  FROM (SELECT z.*, core_l, core_r, h > {n(2.5)} * w AND h > 3 * line_h AS upright, cx < core_l - {tol} OR cx > core_r + {tol} AS beside
        FROM ({lines}) z LEFT JOIN ({extent(d, lines)}) e ON z.page_id = e.page_id) z) z"""


def pitched(d: Dialect, c: Settings, lines: str) -> str:
    n = d.num
    return f"""
SELECT *, greatest({n(0.5)} * line_h, {n(c.gap_pitch_factor)} * pitch - line_h) AS gap_thr
FROM (SELECT *, coalesce({d.pct(f"CASE WHEN flat AND step > {n(0.6)} * line_h THEN step END", 0.5, P)}, {n(1.6)} * line_h) AS pitch
      FROM (SELECT *, cy - lag(cy) OVER (PARTITION BY page_id, flat ORDER BY cy) AS step FROM (SELECT *, rest AND w > 3 * h AS flat FROM ({lines}) z) z) z) z"""


def grouped(d: Dialect, lines: str) -> str:
    """Vertical groups of the remaining lines, their sizes and rows, and the dominant one."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    g = "PARTITION BY page_id, rest, gi"
    main = f"OVER ({P} ORDER BY CASE WHEN rest THEN 0 ELSE 1 END, g_w DESC, gi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
SELECT *, first_value(gi) {main} AS mi, first_value(g_top) {main} AS main_top, first_value(g_bot) {main} AS main_bot,
  max(CASE WHEN rest THEN 1 ELSE 0 END) OVER ({P}) AS any_rest
FROM (SELECT *, CAST(sum(CASE WHEN row_bottom IS NULL OR NOT (y1 < row_bottom - {d.num(0.4)} * h) THEN 1 ELSE 0 END) OVER ({g}) AS BIGINT) AS g_rows,
        CAST(sum(w) OVER ({g}) AS BIGINT) AS g_w, min(y1) OVER ({g}) AS g_top, max(y2) OVER ({g}) AS g_bot
      FROM (SELECT *, max(y2) OVER ({g} ORDER BY cy, seq {before}) AS row_bottom
            FROM (SELECT *, CAST(sum(CASE WHEN y1 - bottom > gap_thr THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, rest ORDER BY y1, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gi
                  FROM (SELECT *, max(y2) OVER (PARTITION BY page_id, rest ORDER BY y1, seq {before}) AS bottom FROM ({lines}) z) z) z) z) z"""


def labelled(d: Dialect, lines: str) -> str:
    """label, conf (to three places) and reason after the rules of blocks and corner marks."""
    n = d.num
    small = f"g_rows <= 3 AND g_bot - g_top < {n(0.25)} * greatest(1, py2 - py1)"
    head = f"gi < mi AND {small} AND g_bot - py1 < {n(0.4)} * greatest(1, py2 - py1)"
    foot = f"gi > mi AND {small} AND py2 - g_top < {n(0.4)} * greatest(1, py2 - py1)"
    away = lambda gap: f"{n(0.55)} + {n(0.35)} * {clip(f'(({gap}) / pitch - {n(0.5)}) / 2', d)} + CASE WHEN w < {n(0.5)} * (core_r - core_l) THEN {n(0.05)} ELSE {n(0)} END"
    mark = "side_reason IS NOT NULL AND any_rest = 1 AND w < 4 * line_h"
    rules = [
        ("fill_reason IS NOT NULL", "'filler'", "fill_conf", "fill_reason"),
        (f"{mark} AND y2 <= main_top", "'header'", n(0.6), f"'{TOP_MARK}'"),
        (f"{mark} AND y1 >= main_bot", "'footer'", n(0.6), f"'{BOTTOM_MARK}'"),
        ("side_reason IS NOT NULL", "'side_text'", "side_conf", "side_reason"),
        (head, "'header'", away("main_top - g_bot"), f"'{ABOVE}'"),
        (foot, "'footer'", away("g_top - main_bot"), f"'{BELOW}'"),
    ]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + f" ELSE {other} END"
    full = f"{n(0.7)} + {n(0.25)} * {clip('w / greatest(' + n(1) + ', core_r - core_l)', d)}"
    conf = f"FLOOR({clip(case(2, full), d)} * 1000 + {n(0.5)}) / {n(1000)}"
    main = "'main_text'"
    return f"SELECT *, {case(1, main)} AS label, {conf} AS conf, {case(3, f'{chr(39)}{MAIN}{chr(39)}')} AS reason FROM ({lines}) z"


def parents(d: Dialect, lines: str) -> str:
    """page_id, seq, parent: the row neighbour that a small fragment takes its label from."""
    n = d.num
    gap = "greatest(a.x1, b.x1) - least(a.x2, b.x2)"
    return f"""
SELECT page_id, seq, parent FROM (
  SELECT a.page_id, a.seq, b.seq AS parent, row_number() OVER (PARTITION BY a.page_id, a.seq ORDER BY {gap}, b.seq) AS k
  FROM (SELECT * FROM ({lines}) z WHERE any_rest = 1 AND source = 'page' AND w < 2 * line_h) a JOIN (SELECT page_id, seq, source, x1, y1, x2, y2, w FROM ({lines}) z WHERE source = 'page') b
    ON a.page_id = b.page_id AND a.seq <> b.seq AND b.w >= {n(1.5)} * a.w AND least(a.y2, b.y2) - greatest(a.y1, b.y1) >= {n(0.5)} * a.h AND {gap} < 2 * a.char_h) z
WHERE k = 1"""


def layers(d: Dialect, c: Settings | None = None, lines: str | None = None, own_context: bool = False) -> dict[str, str]:
    """All layers over `lines` (the box adapter by default); with own_context, the lines have their page's context as columns."""
    c = c or Settings()
    base = lines or adapter(d)
    out = {"featured": featured(d, base if own_context else context(d, base))}
    out["stats"] = stats(d, out["featured"])
    out["kept"] = kept(d, out["stats"])
    out["filler"] = filler(d, c, out["kept"])
    out["core"] = core(d, c, out["filler"])
    out["sides"] = sides(d, c, out["core"])
    out["pitched"] = pitched(d, c, out["sides"])
    out["grouped"] = grouped(d, out["pitched"])
    out["labelled"] = labelled(d, out["grouped"])
    return out
