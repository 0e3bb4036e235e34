"""Recognition of Latin text on line crops, and lines of other detectors: functions that are passed in.

A recogniser takes a gray crop, dark on light, and gives (token, confidence of
0 to 100) pairs. A detector takes a page in blue, green, red and the mask of the
paper, and gives the outline of each line as points (x, y).
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

Recogniser = Callable[[np.ndarray], Iterable[tuple[str, float]]]
Detector = Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]]

# Fixed values of the crop and the score.
LEAST_HEIGHT, TEXT_HEIGHT, BORDER, ASPECT, SUPPORT = 8, 48, 10, 1.5, 8.0
_WORD = re.compile(r"[A-Za-z]{2,}")
_LETTER = re.compile(r"[A-Za-z]")


def enlarge(gray: np.ndarray, scale: float) -> np.ndarray:
    """Bicubic, each axis by a matrix of four weights a row."""
    out = gray.astype(np.float64)
    for axis in (0, 1):
        n = gray.shape[axis]
        at = (np.arange(round(n * scale)) + 0.5) / scale - 0.5
        base = np.floor(at).astype(int)
        matrix = np.zeros((len(at), n))
        for tap in range(-1, 3):
            d = np.abs(at - base - tap)
            w = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3)
            np.add.at(matrix, (np.arange(len(at)), np.clip(base + tap, 0, n - 1)), w)
        out = matrix @ out if axis == 0 else out @ matrix.T
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def crop(gray: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray | None:
    """A line as a recogniser gets it: padded, 48 pixels high at least, dark on light, with a border. None for lines that aren't read."""
    x1, y1, x2, y2 = box
    if x2 - x1 <= ASPECT * max(1, y2 - y1):
        return None
    pad = max(2, int(0.15 * (y2 - y1)))
    part = gray[max(0, y1 - pad) : y2 + pad, max(0, x1 - pad) : x2 + pad]
    if not part.size or part.shape[0] < LEAST_HEIGHT:
        return None
    if part.shape[0] < TEXT_HEIGHT:
        part = enlarge(part, TEXT_HEIGHT / part.shape[0])
    return np.pad(255 - part if part.mean() < 127 else part, BORDER, mode="edge")


def latin_score(tokens: Iterable[tuple[str, float]]) -> float:
    """How sure the tokens are Latin: mean confidence of the letters of words, their share of all characters, and whether there are enough."""
    kept = [(t.strip(), float(c)) for t, c in tokens if (t or "").strip() and float(c) >= 0]
    words = [(len(_LETTER.findall(t)), c) for t, c in kept if _WORD.search(t)]
    letters = sum(n for n, _ in words)
    if not letters:
        return 0.0
    mean = sum(n * c / 100 for n, c in words) / letters
    return float(np.clip(mean * letters / sum(len(t) for t, _ in kept) * min(1.0, letters / SUPPORT), 0, 1))


def latin_ocr(gray: np.ndarray, box: tuple[int, int, int, int], read: Recogniser | None) -> float | None:
    """The score of a line, None where there is no recogniser, the line isn't read, or the recogniser fails."""
    part = crop(gray, box) if read else None
    if part is None:
        return None
    try:
        return latin_score(read(part))
    except Exception:  # a recogniser's failure on one line leaves that line without a score
        return None


def recogniser() -> Recogniser | None:
    """The installed recogniser of English lines, if there is one."""
    try:
        module = importlib.import_module("pytesseract")
        module.get_tesseract_version()
    except Exception:  # the wrapper or the program is missing
        return None

    def read(part: np.ndarray) -> list[tuple[str, float]]:
        got = module.image_to_data(part, lang="eng", config="--psm 7", output_type=module.Output.DICT)
        return list(zip(got["text"], map(float, got["conf"]), strict=True))

    return read


@lru_cache(1)
def _network(path: str):
    """The segmentation model in a file, by whichever loader this release of the library has."""
    errors = []
    for module, name in (("kraken.lib.vgsl", "TorchVGSLModel.load_model"), ("kraken.models", "load_models")):
        try:
            load = importlib.import_module(module)
            for part in name.split("."):
                load = getattr(load, part)
            return load(path)
        except Exception as e:  # another release keeps its loader elsewhere
            errors.append(f"{module}: {e}")
    raise RuntimeError(f"no loader reads {path}: {'; '.join(errors)}")


def neural(model: str | None = None, device: str = "cpu") -> Detector:
    """The baseline segmenter of the library kraken as a detector; each worker loads its model once. An ImportError where the library isn't installed."""
    importlib.import_module("kraken.blla")

    def find(bgr: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        image = importlib.import_module("PIL.Image").fromarray(bgr[:, :, ::-1])
        found = importlib.import_module("kraken.blla").segment(image, device=device, **({"model": _network(model)} if model else {}))
        lines = found["lines"] if isinstance(found, dict) else found.lines
        outlines = (x.get("boundary") if isinstance(x, dict) else getattr(x, "boundary", None) for x in lines)
        return [np.asarray(x, float) for x in outlines if x is not None and len(x)]

    return find


def detected(outlines: Iterable[np.ndarray], mask: np.ndarray, ink: np.ndarray) -> list[dict]:
    """Lines of a detector's outlines whose box has its centre on the paper, with the ink in the box."""
    out = []
    for points in outlines:
        p = np.asarray(points, float).reshape(-1, 2)
        if not len(p):
            continue
        (x1, y1), (x2, y2) = p.min(axis=0).astype(int).tolist(), np.ceil(p.max(axis=0)).astype(int).tolist()
        cy, cx = (min(max((a + b) // 2, 0), n - 1) for a, b, n in ((y1, y2, mask.shape[0]), (x1, x2, mask.shape[1])))
        if mask[cy, cx]:
            out.append({"source": "page", "box": [x1, y1, x2, y2], "ink": int(np.count_nonzero(ink[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)])), "rect": None})
    return out
