import random

import pyarrow as pa
import pytest

from inkloom.config import LABELS, Settings
from inkloom.operators import boxes as op
from inkloom.operators.rows import merge_page, merge_rows
from inkloom.plans import boxes as plan


def frame(spark, rows):
    """rows: (page, source, x1, y1, x2, y2, ink, contrast, headline, latin_ocr)"""
    schema = "page_id long, source string, x1 long, y1 long, x2 long, y2 long, ink_px long, contrast double, headline double, latin_ocr double"
    spark.createDataFrame(rows, schema).createOrReplaceTempView("boxes_in")
    return "SELECT * FROM boxes_in"


def line(page, x1, y1, w, h=20, source="page", contrast=100.0, headline=0.9, latin=None, ink=None):
    return (page, source, x1, y1, x1 + w, y1 + h, w * h // 4 if ink is None else ink, contrast, headline, latin)


def page(n):
    """A page with a header, eleven lines of text, a note beside them, a footer, and a fragment."""
    rows = [line(n, 400, 100, 150)] + [line(n, 200, 300 + 44 * i, 600) for i in range(11)]
    return rows + [line(n, 40, 500, 80), line(n, 420, 1400, 150), line(n, 830, 344, 30), line(n, 10, 900, 400, source="outside")]


def labels(spark, rows):
    got = op.classified(spark, frame(spark, rows)).collect()
    return {(r.page_id, r.x1, r.y1): (r.label, round(r.conf, 3), r.reason) for r in got}


def test_all_classes(spark):
    got = labels(spark, page(1))
    assert got[1, 400, 100][0] == "header" and got[1, 420, 1400][0] == "footer" and got[1, 40, 500][0] == "side_text"
    assert got[1, 10, 900] == ("filler", 0.9, plan.OUTSIDE)
    assert all(got[1, 200, 300 + 44 * i] == ("main_text", 0.95, plan.MAIN) for i in range(11))
    assert got[1, 830, 344] == ("main_text", 0.7, plan.FRAGMENT + "main_text")


def test_pages_of_one_class(spark):
    rows = [line(2, 100, 100 * i, 300, latin=0.9, headline=0.0) for i in range(1, 5)]  # all filler
    rows += [line(3, 100 + 60 * i, 300, 20, 300) for i in range(3)]  # all upright
    rows += [line(4, 300, 300, 400), line(4, 300, 350, 10, 8)]  # a speck
    rows += [line(5, 200, 200 + 44 * i, 500) for i in range(6)] + [line(5, 200, 700, 500, contrast=30.0), line(5, 0, 800, 200, contrast=20.0)]
    got = labels(spark, rows)
    assert {v[0] for k, v in got.items() if k[0] == 2} == {"filler"} and got[2, 100, 100][2] == plan.LATIN
    assert sorted(k for k in got if k[0] == 4) == [(4, 300, 300)]
    assert got[5, 200, 700][2] == plan.PENCIL and (5, 0, 800) not in got
    assert all(v[0] in LABELS for v in got.values())


def test_regions(spark):
    lines = op.classified(spark, frame(spark, page(1) + page(2)))
    got = sorted(op.regions(lines).collect(), key=lambda r: (r.page_id, r.region_id))
    one = [r for r in got if r.page_id == 1]
    assert [r.region_id for r in one] == list(range(len(one))) and {r.label for r in one} == set(LABELS)
    main = next(r for r in one if r.label == "main_text")
    assert (main.x1, main.y1, main.y2, main.num_lines) == (200, 300, 760, 12) and main.evidence == sorted(main.evidence)
    assert [(r.label, r.x1, r.y1) for r in one] == [(r.label, r.x1, r.y1) for r in got if r.page_id == 2]


def greedy(boxes, dx, dy):
    clusters = [[i] for i in range(len(boxes))]
    boxes = [list(b) for b in boxes]
    while True:
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[0] - dx < b[2] + dx and b[0] - dx < a[2] + dx and a[1] - dy < b[3] + dy and b[1] - dy < a[3] + dy:
                    boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    clusters[i] += clusters.pop(j)
                    del boxes[j]
                    break
            else:
                continue
            break
        else:
            return sorted(map(sorted, clusters))


def test_clusters_do_not_depend_on_order():
    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        boxes = [(x, y, x + r.randint(1, 60), y + r.randint(1, 20)) for x, y in ((r.randint(0, 400), r.randint(0, 300)) for _ in range(r.randint(1, 30)))]
        home = op.cluster(*np.array(boxes).T, 7.0, 4.5)
        by = {}
        for i, h in enumerate(home.tolist()):
            by.setdefault(h, []).append(i)
        assert sorted(by.values()) == greedy(boxes, 7.0, 4.5)


def test_row_merge():
    boxes = [["page", 0, 0, 50, 20, 5], ["page", 60, 2, 120, 22, 6], ["outside", 125, 2, 190, 22, 7], ["page", 150, 0, 200, 50, 8], ["page", 155, 1, 220, 21, 9]]
    assert merge_page([list(b) for b in boxes], 20, 2.0) == [["page", 0, 0, 220, 22, 20], ["outside", 125, 2, 190, 22, 7], ["page", 150, 0, 200, 50, 8]]
    assert merge_page([], 20, 2.0) == []


def restarting(boxes, char_h, gap):
    """Brute force: after each merge, begin again with the first box."""
    while True:
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                ha, hb = a[4] - a[2], b[4] - b[2]
                tall = max(ha, hb) <= 1.8 * min(ha, hb) and min(a[4], b[4]) - max(a[2], b[2]) >= 0.6 * min(ha, hb)
                if a[0] == b[0] and tall and max(a[1], b[1]) - min(a[3], b[3]) <= gap * char_h:
                    boxes[i] = [a[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]
                    del boxes[j]
                    break
            else:
                continue
            break
        else:
            return boxes


def test_row_merge_brute_force(spark):
    r = random.Random(7)
    pages, want = [], []
    for n in range(150):
        boxes = sorted(([r.choice(["page", "page", "outside"]), x, y, x + r.randint(5, 80), y + r.randint(8, 40), r.randint(1, 99)] for x, y in ((r.randint(0, 500), r.randint(0, 120)) for _ in range(r.randint(1, 25)))), key=lambda b: b[1])
        char_h = r.choice([5.0, 10.0, 20.0])
        out = restarting([list(b) for b in boxes], char_h, 2.0)
        assert merge_page([list(b) for b in boxes], char_h, 2.0) == out
        pages += [(n, i, *b, char_h) for i, b in enumerate(boxes)]
        want += [(n, i + 1, *b) for i, b in enumerate(out)]
    df = spark.createDataFrame(pages, "page_id long, seq long, source string, x1 long, y1 long, x2 long, y2 long, ink_px long, char_h double").repartition(5)
    assert sorted(map(tuple, merge_rows(df).collect())) == sorted(want)


def test_parents_brute_force():
    r = random.Random(8)
    rows = []
    for n in range(60):
        for seq in range(r.randint(1, 20)):
            x, y, w, h = r.randint(0, 300), r.randint(0, 60), r.randint(1, 120), r.randint(5, 30)
            rows.append({"page_id": n, "seq": seq, "source": r.choice(["page", "page", "outside"]), "x1": x, "y1": y, "x2": x + w, "y2": y + h, "w": w, "h": h, "char_h": 20.0, "line_h": 25.0, "any_rest": n % 5 > 0})
    t = pa.Table.from_pylist([x | {"any_rest": int(x["any_rest"])} for x in rows])
    want = []
    for a in rows:
        best = None
        if a["any_rest"] and a["source"] == "page" and a["w"] < 50:
            for i, b in enumerate(rows):
                gap = max(a["x1"], b["x1"]) - min(a["x2"], b["x2"])
                if b is not a and b["page_id"] == a["page_id"] and b["source"] == "page" and b["w"] >= 1.5 * a["w"] and min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) >= 0.5 * a["h"] and gap < 40:
                    best = min(best or (gap, b["seq"], i), (gap, b["seq"], i))
        want.append(best[2] if best else -1)
    assert op.parents_of(t).tolist() == want and max(want) > 0


def test_settings():
    assert Settings.from_json('{"smear_x": 2, "deskew": false}').deskew is False
    with pytest.raises(KeyError):
        Settings.from_json('{"to_dict": 1}')
    with pytest.raises(TypeError):
        Settings.from_json('{"deskew": 1}')
