"""Rasters as relations: ink runs of text pages, gray pixels of vectors, tokens; the same text for both engines."""

from __future__ import annotations

from .dialect import Dialect

BLANK = "[ \\n\\t\\r]+"


def text_lines(d: Dialect) -> str:
    """page_id, y (from 1), line"""
    if d.spark:
        return "SELECT doc_id AS page_id, CAST(p + 1 AS BIGINT) AS y, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS p, line"
    return "SELECT doc_id AS page_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS y, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) z"


def ink_runs(d: Dialect) -> str:
    """Maximal runs of ink (what is no space) per row: page_id, y, x_start, x_end, both inclusive, from 1."""
    if d.spark:
        words = "SELECT page_id, y, pos, CAST(length(word) AS BIGINT) AS n FROM (" + text_lines(d) + ") z LATERAL VIEW posexplode(split(line, ' ')) t AS pos, word"
    else:
        words = "SELECT page_id, y, unnest(range(0, len(s))) AS pos, CAST(len(unnest(s)) AS BIGINT) AS n FROM (SELECT page_id, y, string_split(line, ' ') AS s FROM (" + text_lines(d) + ") z) z"
    return f"""
SELECT page_id, y, CAST(sum(n + 1) OVER (PARTITION BY page_id, y ORDER BY pos ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS x_start,
  CAST(sum(n + 1) OVER (PARTITION BY page_id, y ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS x_end, n
FROM ({words}) z"""


def runs(d: Dialect) -> str:
    return f"SELECT page_id, y, x_start, x_end FROM ({ink_runs(d)}) z WHERE n > 0"


def closed(d: Dialect, k: int) -> str:
    """Horizontal closing by k columns: gaps of at most k - 1 are filled."""
    return f"""
SELECT page_id, y, min(x_start) AS x_start, max(x_end) AS x_end
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page_id, y ORDER BY x_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
      FROM (SELECT *, CASE WHEN x_start - lag(x_end) OVER (PARTITION BY page_id, y ORDER BY x_start) - 1 <= {k - 1} THEN 0 ELSE 1 END AS fresh FROM ({runs(d)}) z) z) z
GROUP BY page_id, y, run"""


def opened(d: Dialect, k: int) -> str:
    """Horizontal opening by k columns: runs of at least k stay."""
    return f"SELECT page_id, y, x_start, x_end FROM ({runs(d)}) z WHERE x_end - x_start + 1 >= {k}"


def profile(d: Dialect) -> str:
    """Ink per row, besides the page's sums: the row profile."""
    return f"SELECT page_id, y, CAST(sum(x_end - x_start + 1) AS BIGINT) AS ink FROM ({runs(d)}) z GROUP BY page_id, y"


def headline(d: Dialect) -> str:
    """The headline score of each page taken as one line."""
    n = d.num
    return f"""
SELECT page_id, CASE WHEN total < 20 THEN {n(0)} ELSE greatest({n(0)}, least({n(1)}, (top / ({n(1)} * total / rows_n) - {n(1.8)}) / 2)) * greatest({n(0)}, least({n(1)}, top / ({n(1)} * width) / {n(0.35)})) END AS headline
FROM (SELECT r.page_id, max(ink) AS top, sum(ink) AS total, max(rows_n) AS rows_n, max(width) AS width
      FROM ({profile(d)}) r JOIN (SELECT page_id, max(y) AS rows_n, max(x_end) AS width FROM ({ink_runs(d)}) z GROUP BY page_id) s ON r.page_id = s.page_id GROUP BY r.page_id) z"""


def gray(d: Dialect) -> str:
    """page_id, y, x, g: vectors as pixel rows, 50 to a page."""
    if d.spark:
        cells = "SELECT vec_id, CAST(p AS BIGINT) AS x, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v"
    else:
        cells = "SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
    return f"SELECT {d.div('vec_id', '50')} AS page_id, vec_id % 50 AS y, x, CAST(greatest({d.num(0)}, least({d.num(255)}, FLOOR(v * 256 + 128))) AS BIGINT) AS g FROM ({cells}) z"


def contrast(d: Dialect) -> str:
    """Background less ink brightness by medians; ink is what is darker than 128."""
    return f"""
SELECT page_id, CASE WHEN ink < 10 OR paper < 10 THEN {d.num(0)} ELSE light - dark END AS contrast
FROM (SELECT page_id, count(CASE WHEN g < 128 THEN 1 END) AS ink, count(CASE WHEN g >= 128 THEN 1 END) AS paper,
        {d.pct("CASE WHEN g >= 128 THEN g END", 0.5)} AS light, {d.pct("CASE WHEN g < 128 THEN g END", 0.5)} AS dark FROM ({gray(d)}) z GROUP BY page_id) z"""


def border(d: Dialect) -> str:
    """Medians of the frame (corners twice) and of the middle third, and whether the page fills the image."""
    size = "SELECT *, max(x) OVER (PARTITION BY page_id) + 1 AS w, max(y) OVER (PARTITION BY page_id) + 1 AS h FROM (" + gray(d) + ") z"
    edge = f"SELECT *, greatest(2, CAST(FLOOR({d.num(0.02)} * least(w, h)) AS BIGINT)) AS b FROM ({size}) z"
    strips = f"SELECT page_id, g FROM ({edge}) z WHERE y < b OR y >= h - b UNION ALL SELECT page_id, g FROM ({edge}) z WHERE x < b OR x >= w - b"
    mid = f"SELECT page_id, {d.pct('g', 0.5)} AS middle FROM ({size}) z WHERE y >= {d.div('h', '3')} AND y < {d.div('2 * h', '3')} AND x >= {d.div('w', '3')} AND x < {d.div('2 * w', '3')} GROUP BY page_id"
    return f"SELECT f.page_id, frame, middle, abs(middle - frame) < {d.num(18)} AS is_full FROM (SELECT page_id, {d.pct('g', 0.5)} AS frame FROM ({strips}) z GROUP BY page_id) f JOIN ({mid}) m ON f.page_id = m.page_id"


def otsu(d: Dialect) -> str:
    """The gray level up to which a page is dark: largest variance between the classes, the lowest level on ties."""
    n = d.num
    hist = f"SELECT page_id, g, CAST(count(*) AS BIGINT) AS n FROM ({gray(d)}) z GROUP BY page_id, g"
    run = f"SELECT page_id, g, CAST(sum(n) OVER w AS BIGINT) AS n0, CAST(sum(n * g) OVER w AS BIGINT) AS s0, CAST(sum(n) OVER p AS BIGINT) AS nt, CAST(sum(n * g) OVER p AS BIGINT) AS st FROM ({hist}) z WINDOW w AS (PARTITION BY page_id ORDER BY g ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page_id)"
    gap = f"({n(1)} * s0 / n0 - {n(1)} * (st - s0) / (nt - n0))"
    between = f"CASE WHEN nt = n0 THEN {n(0)} ELSE {n(1)} * n0 * (nt - n0) * {gap} * {gap} END"
    return f"SELECT page_id, g AS threshold FROM (SELECT page_id, g, row_number() OVER (PARTITION BY page_id ORDER BY {between} DESC, g) AS k FROM ({run}) z) z WHERE k = 1"


def tokens(d: Dialect) -> str:
    """page_id, pos, tok, conf: the words of texts as recognised tokens."""
    if d.spark:
        words = f"SELECT doc_id AS page_id, pos, tok FROM (SELECT doc_id, filter(split(text, '{BLANK}'), x -> x <> '') AS a FROM documents) z LATERAL VIEW posexplode(a) t AS pos, tok".replace("\\", "\\\\")
    else:
        words = f"SELECT doc_id AS page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS tok FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '') AS a FROM documents) z"
    return f"SELECT page_id, CAST(pos AS BIGINT) AS pos, tok, (page_id * 31 + pos * 17) % 101 * {d.num(1)} AS conf FROM ({words}) z"


def latin(d: Dialect) -> str:
    """How sure a page's tokens are Latin: mean confidence, purity and support of its words of two letters or more."""
    n = d.num
    letters = "length(regexp_replace(tok, '[^A-Za-z]', ''))" if d.spark else "length(regexp_replace(tok, '[^A-Za-z]', '', 'g'))"
    match = "tok RLIKE '[A-Za-z]{2,}'" if d.spark else "regexp_matches(tok, '[A-Za-z]{2,}')"
    return f"""
SELECT page_id, CASE WHEN letters = 0 THEN {n(0)} ELSE greatest({n(0)}, least({n(1)}, weighted / 100 / letters * ({n(1)} * letters / total) * least({n(1)}, letters / {n(8)}))) END AS latin_ocr
FROM (SELECT page_id, CAST(sum(length(tok)) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN k >= 2 AND hit THEN k END), 0) AS BIGINT) AS letters, coalesce(sum(CASE WHEN k >= 2 AND hit THEN k * conf END), 0) AS weighted
      FROM (SELECT page_id, tok, conf, CAST({letters} AS BIGINT) AS k, {match} AS hit FROM ({tokens(d)}) z) z GROUP BY page_id) z"""


def pitch(d: Dialect, ch: int = 2) -> str:
    """Line distance of each page from the autocorrelation of its row profile, less a moving mean; in whole numbers, so both engines agree."""
    k = max(3, 3 * ch) | 1
    frame = f"OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"
    rows = f"SELECT page_id, y, CAST({k} * ink - sum(ink) {frame} AS BIGINT) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM ({profile(d)}) z"
    lo, hi = int(0.9 * ch), 4 * ch
    curve = f"SELECT a.page_id, b.y - a.y AS step, CAST(sum(a.r * b.r) AS BIGINT) AS v, max(a.n) AS n FROM ({rows}) a JOIN ({rows}) b ON a.page_id = b.page_id AND b.y - a.y BETWEEN 0 AND {hi - 1} GROUP BY a.page_id, b.y - a.y"
    near = "OVER (PARTITION BY page_id ORDER BY step)"
    seg = f"SELECT *, lag(v) {near} AS before, lead(v) {near} AS after FROM (SELECT *, max(CASE WHEN step = 0 THEN v END) OVER (PARTITION BY page_id) AS v0 FROM ({curve}) z) z WHERE step >= {lo} AND step < least(n - 1, {hi}) AND n >= {k}"
    peaks = f"SELECT *, max(v) OVER (PARTITION BY page_id) AS top FROM ({seg}) z WHERE v >= before AND v >= after AND 20 * v > v0"
    return f"""
SELECT p.page_id, coalesce(CAST(step AS DOUBLE), {d.num(1.6 * ch)}) AS pitch FROM (SELECT DISTINCT page_id FROM ({profile(d)}) z) p
LEFT JOIN (SELECT page_id, min(step) AS step FROM ({peaks}) z WHERE 10 * v >= 6 * top GROUP BY page_id) q ON p.page_id = q.page_id"""
