import sys
import types

import numpy as np
import pytest

from inkloom import layout
from inkloom.config import Settings
from inkloom.operators import pages, script
from inkloom.sources.images import encode_png
from test_pages import draw


def test_score():
    assert script.latin_score([]) == script.latin_score([("", 90), ("a", 99), ("12", 80), ("words", -1)]) == 0
    assert script.latin_score([("English", 90.0), ("text", 80.0)]) == (7 * 0.9 + 4 * 0.8) / 11
    assert abs(script.latin_score([("ab", 50.0), ("!!", 50.0)]) - 0.5 * 0.5 * 2 / 8) < 1e-12
    assert script.latin_score([("a1b2", 90.0)]) == 0  # no two letters together


def test_crop():
    page = np.full((100, 300), 200, np.uint8)
    page[40:60, 50:250] = 30
    part = script.crop(page, (50, 40, 250, 60))
    assert part.shape == (48 + 20, round(206 * 48 / 26) + 20) and part.mean() > 127  # padded by 3, enlarged, inverted, with a border
    assert script.crop(page, (50, 40, 78, 60)) is None and script.crop(page[:5], (0, 1, 90, 4)) is None
    tall = np.full((90, 300), 220, np.uint8)
    assert script.crop(tall, (10, 10, 290, 80)).shape[0] == 110
    flat = np.full((10, 20), 77, np.uint8)
    assert (script.enlarge(flat, 3.0) == 77).all()


def test_failures_leave_no_score():
    page = np.full((60, 300), 200, np.uint8)

    def fails(part):
        raise RuntimeError

    assert script.latin_ocr(page, (10, 10, 200, 40), fails) is None and script.latin_ocr(page, (10, 10, 200, 40), None) is None
    assert script.latin_ocr(page, (10, 10, 200, 40), lambda part: [("recognised", 100.0)]) == 1


def test_lines_of_a_detector():
    mask = np.zeros((50, 100), bool)
    mask[:, :60] = True
    got = script.detected([np.array([[5, 5], [40.2, 14.5]]), [[70, 5], [99, 20]], []], mask, mask)
    assert got == [{"source": "page", "box": [5, 5, 41, 15], "ink": 360, "rect": None}]
    rows = pages.lines_of(encode_png(draw()), Settings(), detector=lambda bgr, paper: [[[120, 170], [580, 184]], [[120, 206], [580, 220]]])
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows] == [(120, 170, 580, 184), (120, 206, 580, 220)] and all(r["ink_px"] > 0 for r in rows)


def test_a_segmenter_that_is_installed(monkeypatch):
    calls = []

    def segment(image, device, model=None):
        calls.append((image.shape, device, model))
        return types.SimpleNamespace(lines=[types.SimpleNamespace(boundary=[(1, 2), (30, 9)]), types.SimpleNamespace(boundary=None)])

    fake = {"kraken": types.ModuleType("kraken"), "kraken.blla": types.SimpleNamespace(segment=segment), "kraken.models": types.SimpleNamespace(load_models=lambda path: f"net of {path}"), "PIL": types.ModuleType("PIL"), "PIL.Image": types.SimpleNamespace(fromarray=lambda a: a)}
    with pytest.raises(ImportError):
        layout.main(["-i", "x", "-o", "y", "--line-backend", "kraken"])
    for name, module in fake.items():
        monkeypatch.setitem(sys.modules, name, module)
    page = np.zeros((10, 40, 3), np.uint8)
    (outline,) = script.neural("m.bin", "gpu")(page, page[..., 0])
    assert outline.tolist() == [[1, 2], [30, 9]] and calls == [((10, 40, 3), "gpu", "net of m.bin")]
    with pytest.raises(RuntimeError):
        monkeypatch.delitem(sys.modules, "kraken.models")
        script._network("other.bin")


def test_documents_with_a_recogniser(spark):
    images = spark.createDataFrame([("a.png", encode_png(draw()))], "path string, content binary")
    read = lambda part: [("Printed", 95.0), ("English", 95.0)]
    (doc,) = layout.layout(images, read=read).collect()
    assert doc.ocr_script_check and {x.label for x in doc.lines} >= {"filler"} and max(x.features.latin_ocr for x in doc.lines) == 0.95
    (doc,) = layout.layout(images, Settings(use_ocr_script_check=False), read=read).collect()
    assert not doc.ocr_script_check and all(x.features.latin_ocr is None for x in doc.lines)
