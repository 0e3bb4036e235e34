"""Drawing of regions onto page images."""

from __future__ import annotations

import numpy as np

# Colours of labels (red, green, blue), and of any other label.
COLOURS = {"header": (255, 140, 0), "footer": (190, 40, 190), "main_text": (40, 170, 40), "side_text": (0, 120, 255), "filler": (220, 40, 40)}
OTHER = (128, 128, 128)


def thickness(height: int, width: int) -> int:
    return max(2, round(max(height, width) / 700))


def frame(img: np.ndarray, box: list[int], rgb: tuple[int, int, int], thick: int) -> None:
    """A rectangle whose strokes are centred on the box's edges, the last row and column of a half-open box being x2 and y2."""
    h, w = img.shape[:2]
    x1, y1, x2, y2 = box
    before, after = thick // 2, thick - thick // 2
    span = lambda a, b, most: slice(max(0, min(a, most)), max(0, min(b, most)))
    rows, cols = span(y1 - before, y2 + after, h), span(x1 - before, x2 + after, w)
    for y in (y1, y2):
        img[span(y - before, y + after, h), cols] = rgb[::-1]
    for x in (x1, x2):
        img[rows, span(x - before, x + after, w)] = rgb[::-1]


def draw(bgr: np.ndarray, regions: list[dict], lines: list[dict] | None = None) -> np.ndarray:
    """A copy of the image with a frame for each line, if given, and for each region. Captions aren't drawn: they are in the draw list and in the result document."""
    out = bgr.copy()
    for x in lines or []:
        frame(out, x["bbox"], COLOURS.get(x["label"], OTHER), 1)
    for x in regions:
        frame(out, x["bbox"], COLOURS.get(x["label"], OTHER), thickness(*bgr.shape[:2]))
    return out
