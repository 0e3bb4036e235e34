"""Merging of line boxes that stand on one row; the order of merges is part of the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, seq long, source string, x1 long, y1 long, x2 long, y2 long, ink_px long"


def _fit(a: list, b: list, room: float) -> bool:
    """Whether two boxes stand on one row, are about as tall, and are near enough."""
    ha, hb = a[4] - a[2], b[4] - b[2]
    low = min(ha, hb)
    return a[0] == b[0] and min(a[4], b[4]) - max(a[2], b[2]) >= 0.6 * low and max(ha, hb) <= 1.8 * low and max(a[1], b[1]) - min(a[3], b[3]) <= room


def merge_page(boxes: list[list], char_h: float, gap: float) -> list[list]:
    """boxes: [source, x1, y1, x2, y2, ink], ordered by x1. A box takes in the next later one on its row; after each merge all earlier boxes are looked at again, in order.

    The first `done` boxes are known to have no partner among later ones. A
    merge changes one box, so earlier boxes need to look at that one only.
    """
    room, done = gap * char_h, 0

    def absorb(i: int, j: int) -> None:
        nonlocal done
        a, b = boxes[i], boxes.pop(j)
        a[1:] = [min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]
        done -= j < done

    while done < len(boxes):
        i = done
        while (j := next((j for j in range(i + 1, len(boxes)) if _fit(boxes[i], boxes[j], room)), 0)) > 0:
            absorb(i, j)
            while (k := next((k for k in range(i) if _fit(boxes[k], boxes[i], room)), -1)) >= 0:
                absorb(k, i)
                i = k
        done += i == done
    return boxes


def merge_rows(lines: DataFrame, gap: float = 2.0) -> DataFrame:
    """The merged boxes of all pages, numbered in order."""
    from .boxes import _pages, by_pages

    def f(t: pa.Table) -> pa.Table:
        names = ["source", "x1", "y1", "x2", "y2", "ink_px"]
        boxes = [list(x) for x in zip(*(t.column(n).to_pylist() for n in names), strict=True)]
        page, ch, first = t.column("page_id").to_pylist(), t.column("char_h").to_numpy(), _pages(t).tolist()
        got = [merge_page(boxes[a:b], float(ch[a]), gap) for a, b in zip(first[:-1], first[1:], strict=True)]
        flat = [x for g in got for x in g]
        cols = [pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(zip(*flat, strict=True))] if flat else [pa.array([], pa.string() if i == 0 else pa.int64()) for i in range(6)]
        number = [n for g in got for n in range(1, len(g) + 1)]
        return pa.table([pa.array(np.repeat([page[a] for a in first[:-1]], [len(g) for g in got]), pa.int64()), pa.array(number, pa.int64()), *cols], names=["page_id", "seq", *names])

    return by_pages(lines.select("page_id", "seq", "source", "x1", "y1", "x2", "y2", "ink_px", "char_h"), f, SCHEMA)
