import json

import numpy as np
import pytest

from inkloom import layout, session
from inkloom.config import LABELS, Settings
from inkloom.functions import kernels as k
from inkloom.operators import annotate
from inkloom.operators import pages as p
from inkloom.sources.images import decode, encode_png


def draw(seed=0):
    """A page of strokes: a header, fourteen lines of text, a footer."""
    r = np.random.default_rng(seed)
    img = np.full((900, 700, 3), 235, np.uint8)

    def text(x, y, w):
        end = x + w - 12
        while x < end:
            n = int(r.integers(6, 11))
            img[y : y + 14, x : x + 2] = img[y : y + 3, x : x + n] = img[y + 11 : y + 14, x : x + n] = 40
            x += n + (3 if r.random() < 0.8 else 10)

    text(250, 50, 200)
    for i in range(14):
        text(120, 170 + 36 * i, 460)
    text(300, 840, 90)
    return img


def test_lines_and_skew():
    img = draw()
    got = p.lines_of(encode_png(img), Settings())
    assert len(got) == 16 and got[0]["skew"] == 0 and abs(got[0]["char_h"] - 14) <= 1
    turned = p.lines_of(encode_png(k.rotate(img, 3.0, 235)), Settings())
    assert abs(abs(turned[0]["skew"]) - 3) < 0.3 and len(turned) == 16
    assert all(x["y2"] - x["y1"] < 26 for x in turned)  # straight again


def test_skew_is_within_45_degrees_of_level():
    assert p.skew([(100, 10, 80.0)] * 3) == -10 and p.skew([(10, 100, -87.0)] * 3) == 3 and p.skew([(100, 10, 3.0)] * 2) == 0
    assert p.skew([None, (100, 10, 1.0), (90, 10, 2.0), (500, 10, 4.0), (10, 9, 44.0)]) == 4


def test_tall_blobs_are_cut_between_lines():
    ink = np.zeros((60, 80), bool)
    for y in (2, 22, 42):
        ink[y : y + 14, 5:75] = True
    ink[:, 40] = True  # what ties the lines
    parts = p.split_tall(ink, (5, 2, 75, 56), 20.0)
    assert len(parts) == 3 and all(b - a <= 20 for _, a, _, b in parts) and parts[0][:2] == (5, 2) and parts[2][2:] == (75, 56)
    assert p.split_tall(ink, (5, 2, 75, 16), 20.0) == [(5, 2, 75, 16)]
    small = Settings(min_component_px=400)
    assert p.blobs(ink, 14.0, Settings(), "page") and all(x["ink"] >= 800 for x in p.blobs(ink, 14.0, small, "page"))


def test_line_pitch_finds_the_distance_of_lines():
    for step in (22, 30, 41):
        ink = np.zeros((400, 300), bool)
        for y in range(10, 390, step):
            ink[y : y + 12, 10:290] = True
        assert abs(p.line_pitch(ink, 12.0) - step) <= 1
    assert p.line_pitch(np.zeros((50, 50), bool), 10.0) == 16


def test_tiny_images_and_any_error():
    for shape in ((1, 1, 3), (2, 3, 3), (7, 900, 3)):
        (row,) = p.lines_of(encode_png(np.full(shape, 9, np.uint8)), Settings())
        assert row["seq"] is None and (row["w0"], row["h0"]) == (shape[1], shape[0])


def test_frames():
    img = annotate.draw(np.zeros((100, 1400, 3), np.uint8), [{"label": "header", "bbox": [10, 20, 60, 50]}, {"label": "footer", "bbox": [0, 0, 1400, 100]}], [{"label": "filler", "bbox": [30, 30, 40, 40]}])
    assert img[20, 30].tolist() == [0, 140, 255] and img[30, 35].tolist() == [40, 40, 220] and img[99, 99].tolist() == [190, 40, 190] and not img[35, 35].any() and not img[70, 70].any()
    assert annotate.thickness(900, 700) == 2 and annotate.thickness(3000, 100) == 4


def test_a_cluster_needs_a_shared_folder(spark):
    assert session.shared_folder(spark) != session.shared_folder(spark)

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster)


def test_decoding():
    img = draw()[:50, :60]
    assert (decode(encode_png(img)) == img).all()
    for bad in (b"", b"\x89PNG\r\n\x1a\nxx", encode_png(img)[:80], b"GIF89a"):
        with pytest.raises(ValueError):
            decode(bad)


def test_components_and_morphology():
    r = np.random.default_rng(1)
    for _ in range(20):
        m = r.random((12, 15)) < 0.35
        labels, stats = k.components(m)
        seen, parts = set(), []
        for y, x in zip(*np.nonzero(m), strict=True):
            if (y, x) not in seen:
                todo, part = [(y, x)], set()
                while todo:
                    a = todo.pop()
                    if a not in part:
                        part.add(a)
                        todo += [(a[0] + i, a[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= a[0] + i < 12 and 0 <= a[1] + j < 15 and m[a[0] + i, a[1] + j]]
                seen |= part
                parts.append(part)
        assert len(parts) == len(stats) and (labels > 0).tolist() == m.tolist()
        for part in parts:
            assert len({int(labels[a]) for a in part}) == 1
        assert sorted(stats[:, 4]) == sorted(map(len, parts))
        d = k.dilate(m, 3, 5)
        assert all(d[y, x] == m[max(0, y - 2) : y + 3, max(0, x - 1) : x + 2].any() for y in range(12) for x in range(15))
        assert (k.erode(m, 3, 5) == ~k.dilate(~m, 3, 5)).all()


def test_from_files_to_documents(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(encode_png(draw()))
    (src / "B.PNG").write_bytes(encode_png(np.full((60, 60, 3), 200, np.uint8)))
    (src / "c.png").write_bytes(b"broken")
    (src / "note.txt").write_text("x")
    (src / "a_annotated.jpg").write_bytes(b"")
    images = layout.list_images(spark, str(src))
    got = {r.path.rpartition("/")[2]: r for r in layout.layout(images).collect()}
    assert set(got) == {"a.png", "B.PNG", "c.png"} and got["c.png"].error
    page = got["a.png"]
    assert page.image_size == [700, 900] and page.page_is_full_frame and page.error is None
    assert len(page.lines) == 16 and {r.label for r in page.regions} <= set(LABELS)
    main = max(page.regions, key=lambda r: r.num_lines)
    assert main.label == "main_text" and main.num_lines == 14 and [r.id for r in page.regions] == list(range(len(page.regions)))
    assert all(0 <= b[0] < b[2] <= 700 and 0 <= b[1] < b[3] <= 900 for b in (r.bbox for r in page.regions))
    assert got["B.PNG"].regions == [] and got["B.PNG"].lines == []
    assert layout.main(["-i", str(src), "-o", str(tmp_path / "out")]) == 2
    doc = json.loads((tmp_path / "out/a.json").read_text())
    assert doc["image"] == "a.png" and doc["runtime_s"] > 0 and len(doc["lines"]) == 16 and set(doc["regions"][0]["bbox"]) and not (tmp_path / "out/c.json").exists()
    total = json.loads((tmp_path / "out/summary.json").read_text())
    assert (total["processed"], total["failed"], total["backend"], total["config"]) == (2, 1, "cv", Settings().to_dict())
    assert [x["image"] for x in total["images"]] == ["B.PNG", "a.png"] and total["images"][1]["regions"]["main_text"] == 1
    drawn = decode((tmp_path / "out/a_annotated.png").read_bytes())
    x1, y1, x2, y2 = next(r["bbox"] for r in doc["regions"] if r["label"] == "main_text")
    assert drawn.shape == draw().shape and drawn[(y1 + y2) // 2, x1].tolist() == [40, 170, 40]
    (src / "sub").mkdir()
    (src / "sub/a.png").write_bytes(encode_png(draw(1)))
    assert layout.main(["-i", str(src), "-o", str(tmp_path / "deep"), "--recursive", "--draw-lines"]) == 2
    assert sorted(x.relative_to(tmp_path / "deep").as_posix() for x in (tmp_path / "deep").rglob("*.json")) == ["B.json", "a.json", "sub/a.json", "summary.json"]
    assert layout.main(["-i", str(tmp_path / "in/note.txt"), "-o", str(tmp_path / "x")]) == 1
