"""Box-level operators as DataFrames: labels of lines, fragments, regions, roll-ups.

What depends on several lines of a page and isn't a window (parents of
fragments, the chain of their labels, clusters) is computed by Arrow functions
over whole pages, many pages at a time: one exchange by page_id deals them out,
and a worker holds the pages of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LABELS, Settings
from ..plans import boxes as plan
from ..plans.dialect import SPARK

#: Pairs of lines that are compared at once.
PAIRS = 1 << 20
REGIONS = "page_id long, region_id long, label string, x1 long, y1 long, x2 long, y2 long, confidence double, num_lines long, evidence array<string>"
_NEEDED = ["page_id", "seq", "source", "x1", "y1", "x2", "y2", "w", "h", "cy", "char_h", "line_h", "any_rest", "label", "conf", "reason"]


def by_pages(lines: DataFrame, f: Callable[[pa.Table], pa.Table | None], schema) -> DataFrame:
    """f(whole pages, sorted by page_id and seq) over all pages. A page's lines are never divided."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            last = batch.column("page_id")[-1]
            ids = batch.column("page_id").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ids, last.as_py())) if last.is_valid else 0
            if cut or (held and held[-1].column("page_id")[-1].as_py() != ids[0]):
                yield from f(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from f(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return lines.repartition("page_id").sortWithinPartitions("page_id", "seq").mapInArrow(run, schema)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def _pages(t: pa.Table) -> np.ndarray:
    """First line of each page, and the number of lines."""
    ids = t.column("page_id").to_numpy()
    return np.append(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), len(ids)) if len(ids) else np.zeros(1, np.int64)


def parents_of(t: pa.Table) -> np.ndarray:
    """The row of each line's parent, -1 without: the nearest line of its row that is half as wide again."""
    n = t.num_rows
    out = np.full(n, -1, np.int64)
    x1, y1, x2, y2, w, h, ch, lh, rest = _columns(t, "x1", "y1", "x2", "y2", "w", "h", "char_h", "line_h", "any_rest")
    paper = np.asarray(t.column("source").to_pylist(), object) == "page" if n else np.zeros(0, bool)
    first = _pages(t)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    small = np.flatnonzero((rest == 1) & paper & (w < 2 * lh))
    many = np.diff(first)[own[small]]
    stop = np.cumsum(many)
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + PAIRS, side="right")))
        k = many[at:to]
        a = np.repeat(small[at:to], k)
        b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[own[small[at:to]]], k)
        gap = np.maximum(x1[a], x1[b]) - np.minimum(x2[a], x2[b])
        ok = (a != b) & paper[b] & (w[b] >= 1.5 * w[a]) & (np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]) >= 0.5 * h[a]) & (gap < 2 * ch[a])
        a, b, gap = a[ok], b[ok], gap[ok]
        order = np.lexsort((b, gap, a))  # rows are in the order of seq
        a, b = a[order], b[order]
        new = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
        out[a[new]] = b[new]
        at = to
    return out


def inherit(t: pa.Table) -> pa.Table:
    """Whole pages with label, conf and reason after fragments took over their root's label.

    The root's label wins for the whole chain; the confidence is that of the
    nearest ancestor that had this label already, at most 0.7. A parent is
    wider than its child, so chains end.
    """
    parent = parents_of(t)
    child = parent >= 0
    if not child.any():
        return t
    code = {x: i for i, x in enumerate(LABELS)}
    label = np.array([code[x] for x in t.column("label").to_pylist()])
    conf, reason = t.column("conf").to_numpy(), t.column("reason").to_pylist()
    top = np.where(child, parent, np.arange(len(parent)))
    while (top[top] != top).any():
        top = top[top]
    root = label[top]
    near = np.where(child, parent, np.arange(len(parent)))
    while (far := child & (label[near] != root)).any():
        near[far] = parent[near[far]]
    change = child & (root != label)
    out = np.where(change, root, label)
    for i in np.flatnonzero(change).tolist():
        reason[i] = plan.FRAGMENT + LABELS[root[i]]
    new = {"label": pa.array([LABELS[i] for i in out]), "conf": pa.array(np.where(change, np.minimum(conf[near], 0.7), conf)), "reason": pa.array(reason, pa.string())}
    for name, column in new.items():
        at = t.schema.get_field_index(name)
        t = t.set_column(at, t.schema.field(at), column)
    return t


def _labelled(spark: SparkSession, lines: str | None, settings: Settings | None, own_context: bool) -> DataFrame:
    return spark.sql(plan.layers(SPARK, settings, lines, own_context)["labelled"])


def classified(spark: SparkSession, lines: str | None = None, settings: Settings | None = None, own_context: bool = False) -> DataFrame:
    """Labelled lines of `lines` (SQL; the box adapter by default, which needs the view lineitem)."""
    rows = _labelled(spark, lines, settings, own_context)
    return by_pages(rows, inherit, rows.schema)


def classified_regions(spark: SparkSession, lines: str | None = None, settings: Settings | None = None, own_context: bool = False) -> DataFrame:
    """regions() of classified() with one exchange."""
    rows = _labelled(spark, lines, settings, own_context).select(*_NEEDED)
    return by_pages(rows, lambda t: region_rows(inherit(t), settings or Settings()), REGIONS)


def cluster(x1, y1, x2, y2, dx: float, dy: float) -> np.ndarray:
    """Cluster number of each box: boxes, grown by (dx, dy), that intersect merge into their union box, until none do."""
    home = np.arange(len(x1))
    box = np.stack([x1, y1, x2, y2], axis=1).astype(float)
    while len(box) > 1:
        lo, hi = box[:, :2] - (dx, dy), box[:, 2:] + (dx, dy)
        meet = (lo[:, None, 0] < hi[None, :, 0]) & (lo[:, None, 1] < hi[None, :, 1])
        meet &= meet.T
        label = np.arange(len(box))
        while True:
            low = np.where(meet, label[None, :], len(box)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        names, at = np.unique(label, return_inverse=True)
        if len(names) == len(box):
            break
        new = np.full((len(names), 4), [np.inf, np.inf, -np.inf, -np.inf])
        np.minimum.at(new[:, :2], at, box[:, :2])
        np.maximum.at(new[:, 2:], at, box[:, 2:])
        home, box = at[home], new
    return home


def pitch_of(cy: np.ndarray, char_h: float) -> float:
    """The median distance of main text lines, by 1.3 character heights."""
    step = np.diff(np.sort(cy))
    step = step[step > 0.6 * (1.3 * char_h)]
    return float(np.median(step)) if len(step) else 1.6 * (1.3 * char_h)


def region_rows(t: pa.Table, c: Settings) -> pa.Table:
    """The regions of whole pages."""
    x1, y1, x2, y2, w, h, cy, ch, seq, conf = _columns(t, "x1", "y1", "x2", "y2", "w", "h", "cy", "char_h", "seq", "conf")
    label = np.array([LABELS.index(x) for x in t.column("label").to_pylist()], np.int64)
    reason, page = t.column("reason").to_pylist(), t.column("page_id").to_pylist()
    main, side = LABELS.index("main_text"), LABELS.index("side_text")
    mass = np.maximum(1, w)
    score = mass * np.floor(conf * 1000 + 0.5).astype(np.int64)
    out = []
    first = _pages(t).tolist()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        kind = label[lo:hi]
        pitch = pitch_of(cy[lo:hi][(kind == main) & (w[lo:hi] > 3 * h[lo:hi])], ch[lo])
        dx, dy = c.merge_dx_char * ch[lo], c.merge_dy_pitch * pitch / 2
        rows = []
        for k in np.unique(kind).tolist():
            i = lo + np.flatnonzero(kind == k)
            home = cluster(x1[i], y1[i], x2[i], y2[i], dx if k == main else 2 * dx, dy if k in (main, side) else dy / 2)
            for name in np.unique(home).tolist():
                j = i[home == name]
                mean = int(score[j].sum()) / int(mass[j].sum())
                rows.append((int(y1[j].min()), int(x1[j].min()), k, int(seq[j].min()), int(x2[j].max()), int(y2[j].max()), float(np.floor(mean + 0.5) / 1000), len(j), sorted({reason[x] for x in j.tolist()})))
        for n, (b, a, k, _, e, f, confidence, lines, why) in enumerate(sorted(rows)):
            out.append((page[lo], n, LABELS[k], a, b, e, f, confidence, lines, why))
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.list_(pa.string())]
    cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
    return pa.table([pa.array(x, ty) for x, ty in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in REGIONS.split(", ")])


def regions(lines: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, region_id, label, box, confidence, num_lines, evidence of labelled lines."""
    slim = lines.select(*(F.col(x) for x in _NEEDED if x not in ("source", "line_h", "any_rest")))
    return by_pages(slim, lambda t: region_rows(t, settings or Settings()), REGIONS)
