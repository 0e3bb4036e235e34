"""The layout queries: name -> function(spark, sf_dir), and SQL for the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LABELS, Settings
from .operators import boxes as op
from .operators.annotate import COLOURS, thickness
from .operators.rows import merge_rows
from .plans import boxes as plan
from .plans import rasters
from .plans.dialect import DUCK, SPARK, Dialect

Query = Callable[[SparkSession, str], DataFrame]


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def milli(x: str, d: Dialect) -> str:
    """To three places, as an integer: sums in another order can't show."""
    return f"CAST(FLOOR({x} * 1000 + {d.num(0.5)}) AS BIGINT)"


KEY = "page_id, seq"


def _layered(name: str, select: Callable[[Dialect], str]) -> tuple[Query, str]:
    text = lambda d: f"{select(d)} FROM ({plan.layers(d)[name]}) z"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, "lineitem")
        return spark.sql(text(SPARK))

    return run, text(DUCK)


def _plain(text: Callable[[Dialect], str], *tables: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(text(SPARK))

    return run, text(DUCK)


# --- fragments and regions in the checking engine's SQL -------------------------------------------------------------


def _final(select: str) -> str:
    lab = plan.layers(DUCK)["labelled"]
    return f"""
WITH RECURSIVE lab AS MATERIALIZED ({lab}), par AS MATERIALIZED ({plan.parents(DUCK, "SELECT * FROM lab")}),
up AS (SELECT page_id, seq, parent AS top, 1 AS dist FROM par UNION ALL SELECT u.page_id, u.seq, p.parent, u.dist + 1 FROM up u JOIN par p ON u.page_id = p.page_id AND u.top = p.seq),
root AS (SELECT up.page_id, up.seq, arg_max(l.label, dist) AS root_label FROM up JOIN lab l ON up.page_id = l.page_id AND up.top = l.seq GROUP BY ALL),
near AS (SELECT up.page_id, up.seq, arg_min(l.conf, dist) AS c FROM up JOIN lab l ON up.page_id = l.page_id AND up.top = l.seq JOIN root r ON up.page_id = r.page_id AND up.seq = r.seq WHERE l.label = root_label GROUP BY ALL),
fin AS MATERIALIZED (SELECT lab.* EXCLUDE (label, conf, reason), CASE WHEN change THEN root_label ELSE label END AS label, CASE WHEN change THEN least(c, 0.7::DOUBLE) ELSE conf END AS conf,
    CASE WHEN change THEN '{plan.FRAGMENT}' || root_label ELSE reason END AS reason
  FROM (SELECT lab.*, root_label, c, root_label IS NOT NULL AND root_label <> label AS change FROM lab LEFT JOIN root r ON lab.page_id = r.page_id AND lab.seq = r.seq LEFT JOIN near n ON lab.page_id = n.page_id AND lab.seq = n.seq) lab
  ){select}"""


def _regions(select: str, rounds: int = 3) -> str:
    s = Settings()
    rank = "list_position(['" + "', '".join(LABELS) + "'], label)"
    out = f""",
pit AS (SELECT page_id, coalesce(quantile_cont(CASE WHEN step > 0.6::DOUBLE * (1.3::DOUBLE * char_h) THEN step END, 0.5), 1.6::DOUBLE * (1.3::DOUBLE * max(char_h))) AS rpitch
  FROM (SELECT page_id, char_h, CASE WHEN label = 'main_text' AND w > 3 * h THEN cy - lag(cy) OVER (PARTITION BY page_id, label = 'main_text' AND w > 3 * h ORDER BY cy) END AS step FROM fin) z GROUP BY page_id),
b0 AS MATERIALIZED (SELECT fin.page_id, label, seq AS id, x1, y1, x2, y2, CASE WHEN label = 'main_text' THEN 1 ELSE 2 END * {s.merge_dx_char}::DOUBLE * char_h AS dx,
    CASE WHEN label IN ('main_text', 'side_text') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * {s.merge_dy_pitch}::DOUBLE * rpitch / 2 AS dy FROM fin JOIN pit USING (page_id)),
m0 AS MATERIALIZED (SELECT page_id, id AS seq, id FROM b0)"""
    for r in range(rounds):
        out += f""",
e{r} AS MATERIALIZED (SELECT a.page_id, a.id AS a, b.id AS b FROM b{r} a JOIN b{r} b ON a.page_id = b.page_id AND a.label = b.label
  AND a.x1 - a.dx < b.x2 + b.dx AND b.x1 - b.dx < a.x2 + a.dx AND a.y1 - a.dy < b.y2 + b.dy AND b.y1 - b.dy < a.y2 + a.dy),
r{r} AS (SELECT page_id, id, id AS lo FROM b{r} UNION SELECT r{r}.page_id, e{r}.b, r{r}.lo FROM r{r} JOIN e{r} ON r{r}.page_id = e{r}.page_id AND r{r}.id = e{r}.a WHERE e{r}.b > r{r}.lo),
c{r} AS MATERIALIZED (SELECT page_id, id, min(lo) AS lo FROM r{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.page_id, label, lo AS id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(dx) AS dx, max(dy) AS dy FROM b{r} b JOIN c{r} c ON b.page_id = c.page_id AND b.id = c.id GROUP BY b.page_id, label, lo),
m{r + 1} AS MATERIALIZED (SELECT m.page_id, m.seq, c.lo AS id FROM m{r} m JOIN c{r} c ON m.page_id = c.page_id AND m.id = c.id)"""
    out += f""",
reg AS (SELECT f.page_id, f.label, m.id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS BIGINT) AS num_lines, list_sort(list_distinct(list(reason))) AS evidence, min(f.seq) AS first,
    floor(CAST(sum(greatest(1, w) * CAST(floor(conf * 1000 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / CAST(sum(greatest(1, w)) AS DOUBLE) + 0.5::DOUBLE) / 1000::DOUBLE AS confidence
  FROM fin f JOIN m{rounds} m ON f.page_id = m.page_id AND f.seq = m.seq GROUP BY f.page_id, f.label, m.id),
regions AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, {rank}, first) - 1 AS BIGINT) AS region_id FROM reg)"""
    return _final(out + f" {select}")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return op.classified(spark)


def _region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return op.classified_regions(spark)


def fragment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).selectExpr("page_id", "seq", "label", f"{milli('conf', SPARK)} AS conf", "reason")


def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_query(spark, sf_dir).selectExpr("page_id", "region_id", "label", "x1", "y1", "x2", "y2", f"{milli('confidence', SPARK)} AS confidence", "num_lines", "concat_ws('; ', evidence) AS evidence")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map label -> number of regions per page, as text."""
    n = _region_query(spark, sf_dir).groupBy("page_id", "label").agg(F.count("*").alias("n"))
    pages = n.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("m"))
    return pages.select("page_id", F.expr("concat_ws(',', transform(map_entries(m), e -> concat(e.key, '=', e.value)))").alias("regions"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _region_query(spark, sf_dir)
    return r.groupBy("label").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("regions"), F.sum("num_lines").alias("lines"))


def map_back(d: Dialect) -> str:
    """Line boxes turned by two degrees about the page's centre and put at scale 0.5: corners, floor and ceiling, clipped."""
    n = d.num
    cos, sin = n(0.9993908270190958), n(0.03489949670250097)
    x = lambda a, b: f"({cos} * ({a} - 500) - {sin} * ({b} - 780) + 500) / {n(0.5)}"
    y = lambda a, b: f"({sin} * ({a} - 500) + {cos} * ({b} - 780) + 780) / {n(0.5)}"
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    xs, ys = ", ".join(x(*c) for c in corners), ", ".join(y(*c) for c in corners)
    lim = lambda e, lo, hi: f"CAST(greatest({lo}, least({hi}, {e})) AS BIGINT)"
    return f"SELECT page_id, seq, {lim(f'FLOOR(least({xs}))', 0, 1999)} AS ox1, {lim(f'FLOOR(least({ys}))', 0, 3119)} AS oy1, {lim(f'CEIL(greatest({xs}))', 1, 2000)} AS ox2, {lim(f'CEIL(greatest({ys}))', 1, 3120)} AS oy2 FROM ({plan.layers(d)['featured']}) z"


def char_height(d: Dialect) -> str:
    """The area-weighted lower median of plausible component heights; a fortieth of the page where there are too few."""
    n = d.num
    ok = f"h >= 4 AND w >= 3 AND w < 25 * h AND h < 6 * w AND h < {n(0.25)} * 1560 AND w < {n(0.5)} * 1000"
    return f"""
SELECT p.page_id, CASE WHEN k >= 5 THEN CAST(char_h AS DOUBLE) ELSE {n(39)} END AS char_h FROM (SELECT DISTINCT page_id FROM ({plan.layers(d)["featured"]}) z) p LEFT JOIN (
  SELECT page_id, max(k) AS k, min(CASE WHEN 2 * cw >= total THEN h END) AS char_h
  FROM (SELECT page_id, h, sum(ink_px) OVER ({plan.P} ORDER BY h, seq ROWS UNBOUNDED PRECEDING) AS cw, sum(ink_px) OVER ({plan.P}) AS total, count(*) OVER ({plan.P}) AS k FROM ({plan.layers(d)["featured"]}) z WHERE {ok}) z
  GROUP BY page_id) m ON p.page_id = m.page_id"""


def skew(d: Dialect) -> str:
    """The width-weighted median angle of long rectangles; 0 with fewer than three."""
    n = d.num
    rects = f"SELECT page_id, seq, greatest(w, h) AS rw, least(w, h) AS rh, CASE WHEN w >= h THEN ang ELSE ang - 90 END AS a FROM (SELECT *, (ink_px * 7 + x1 * 3 + y1) % 181 - 90 AS ang FROM ({plan.layers(d)['featured']}) z) z"
    wrap = f"SELECT page_id, seq, rw, CASE WHEN a < -135 THEN a + 180 WHEN a < -45 THEN a + 90 WHEN a > 45 THEN a - 90 ELSE a END AS a FROM ({rects}) z WHERE rw >= 4 * greatest(rh, 1)"
    return f"""
SELECT p.page_id, CASE WHEN k >= 3 THEN CAST(a AS DOUBLE) ELSE {n(0)} END AS skew FROM (SELECT DISTINCT page_id FROM ({plan.layers(d)["featured"]}) z) p LEFT JOIN (
  SELECT page_id, max(k) AS k, min(CASE WHEN 2 * cw >= total THEN a END) AS a
  FROM (SELECT page_id, a, sum(rw) OVER ({plan.P} ORDER BY a, seq ROWS UNBOUNDED PRECEDING) AS cw, sum(rw) OVER ({plan.P}) AS total, count(*) OVER ({plan.P}) AS k FROM ({wrap}) z) z GROUP BY page_id) m ON p.page_id = m.page_id"""


def _drawn(d: Dialect) -> str:
    """What an annotated image shows, from regions: a frame, its colour and thickness, a caption (confidence to two places, half up) and the line on which that stands."""
    height, width = plan.PAGE["py2"], plan.PAGE["px2"]
    text = round(22 * max(0.45, max(height, width) / 2400))  # the caption's height: 22 units of the font
    rgb = " ".join(f"WHEN '{k}' THEN '{','.join(map(str, v))}'" for k, v in COLOURS.items())
    cents = f"({d.div(milli('confidence', d) + ' + 5', '10')})"
    pad = f"lpad(CAST({cents} % 100 AS {'STRING' if d.spark else 'VARCHAR'}), 2, '0')"
    return (
        f"SELECT page_id, region_id, x1, y1, x2, y2, CASE label {rgb} END AS rgb, CAST({thickness(height, width)} AS BIGINT) AS thickness, concat(label, ' ', {d.div(cents, '100')}, '.', {pad}) AS caption,"
        f" CASE WHEN y1 - {text} - 8 > 0 THEN y1 - 4 ELSE least({height - 2}, y1 + {text} + 6) END AS ty FROM regions"
    )


def draw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    _region_query(spark, sf_dir).createOrReplaceTempView("regions")
    return spark.sql(_drawn(SPARK))


def row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return merge_rows(spark.sql(plan.layers(SPARK)["featured"]))



def catalogue() -> dict[str, tuple[Query, str | None]]:
    m = milli
    out: dict[str, tuple[Query, str | None]] = {
        "latin_combine": _layered("featured", lambda d: f"SELECT {KEY}, {m('latin', d)} AS latin"),
        "page_stats": _layered("stats", lambda d: "SELECT DISTINCT page_id, med_contrast, line_h"),
        "speck_edge_filter": _layered("kept", lambda d: f"SELECT {KEY}"),
        "filler_rules": _layered("filler", lambda d: f"SELECT {KEY}, coalesce(fill_reason, '') AS fill_reason, coalesce({m('fill_conf', d)}, -1) AS conf, body"),
        "core_extent_sweep": _layered("sides", lambda d: "SELECT DISTINCT page_id, core_l, core_r"),
        "side_text": _layered("sides", lambda d: f"SELECT {KEY}, coalesce(side_reason, '') AS side_reason, coalesce({m('side_conf', d)}, -1) AS conf, rest"),
        "line_pitch": _layered("pitched", lambda d: "SELECT DISTINCT page_id, pitch, gap_thr"),
        "vertical_groups": _layered("grouped", lambda d: f"SELECT {KEY}, rest, gi"),
        "dominant_group": _layered("grouped", lambda d: "SELECT DISTINCT page_id, mi, main_top, main_bot"),
        "row_count": _layered("grouped", lambda d: "SELECT DISTINCT page_id, rest, gi, g_rows, g_w, g_top, g_bot"),
        "header_footer_main": _layered("labelled", lambda d: f"SELECT {KEY}, label, {m('conf', d)} AS conf, reason"),
        "corner_marks": (lambda f: (lambda s, x: f[0](s, x).where(F.col("reason").isin(plan.TOP_MARK, plan.BOTTOM_MARK)), f"SELECT * FROM ({f[1]}) q WHERE reason IN ('{plan.TOP_MARK}', '{plan.BOTTOM_MARK}')"))(_layered("labelled", lambda d: f"SELECT {KEY}, label, reason")),
        "fragment_parent": _plain(lambda d: plan.parents(d, plan.layers(d)["labelled"]), "lineitem"),
        "fragment_labels": (fragment_labels, _final(f" SELECT page_id, seq, label, {m('conf', DUCK)} AS conf, reason FROM fin")),
        "region_summary": (region_summary, _regions(f"SELECT page_id, region_id, label, x1, y1, x2, y2, {m('confidence', DUCK)} AS confidence, num_lines, array_to_string(evidence, '; ') AS evidence FROM regions")),
        "label_counts_map": (label_counts, _regions("SELECT page_id, string_agg(label || '=' || n, ',' ORDER BY label) AS regions FROM (SELECT page_id, label, count(*) AS n FROM regions GROUP BY ALL) z GROUP BY page_id")),
        "run_summary": (run_summary, _regions("SELECT label, count(DISTINCT page_id) AS pages, count(*) AS regions, CAST(sum(num_lines) AS BIGINT) AS lines FROM regions GROUP BY label")),
        "map_back_affine": _plain(map_back, "lineitem"),
        "char_height_wmedian": _plain(char_height, "lineitem"),
        "skew_wmedian": _plain(skew, "lineitem"),
        "draw_list": (draw_list, _regions(_drawn(DUCK))),
        "row_merge": (row_merge, None),
        "speck_filter": _layered("featured", lambda d: f"SELECT {KEY}, greatest(w, h) >= {d.num(6)} AND ink_px >= {d.num(5.76)} AND NOT ((x1 <= 1 OR y1 <= 1 OR x2 >= 999 OR y2 >= 1559) AND greatest(w, h) > 3 * least(w, h) AND greatest(w, h) > 40) AS stays"),
        "component_filter": _layered("featured", lambda d: f"SELECT {KEY}, ink_px >= 12 AND NOT (h > {d.num(0.2)} * 1560 AND w < {d.num(0.2)} * h) AS stays"),
        "outside_lines": _layered("featured", lambda d: f"SELECT {KEY}, source = 'outside' AND w > 3 * h AND w > 4 * char_h AS stays"),
        "strip_autocorr_pitch": _plain(rasters.pitch, "documents"),
        "ink_runs": _plain(rasters.runs, "documents"),
        "hclose_runs": _plain(lambda d: rasters.closed(d, 3), "documents"),
        "hopen_rulings": _plain(lambda d: rasters.opened(d, 12), "documents"),
        "row_profile": _plain(rasters.profile, "documents"),
        "headline_score": _plain(lambda d: f"SELECT page_id, {m('headline', d)} AS headline FROM ({rasters.headline(d)}) z", "documents"),
        "stroke_contrast": _plain(rasters.contrast, "embeddings"),
        "border_median_fullframe": _plain(rasters.border, "embeddings"),
        "otsu": _plain(rasters.otsu, "embeddings"),
        "latin_token_score": _plain(lambda d: f"SELECT page_id, {m('latin_ocr', d)} AS latin_ocr FROM ({rasters.latin(d)}) z", "documents"),
    }
    return out
