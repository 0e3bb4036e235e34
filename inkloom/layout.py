"""The whole way: image files to result documents, one row per page, and to files."""

from __future__ import annotations

import argparse
import json
import logging
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import annotate, boxes, pages, script
from .session import ship, staged
from .sources.images import decode, encode_png, list_images

log = logging.getLogger("inkloom")

_DOCUMENT = "image_size page_bbox page_is_full_frame skew_deg char_height_px ocr_script_check regions lines runtime_s".split()


def _back(box: tuple[str, str, str, str]) -> str:
    """A box in pixels of the original image, as SQL: turned back about the centre, enlarged, floor and ceiling, clipped."""
    cx, cy = "(w0 * scale / 2)", "(h0 * scale / 2)"
    c, s = "cos(radians(skew))", "sin(radians(skew))"
    x1, y1, x2, y2 = box
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    xs = ", ".join(f"({c} * ({a} - {cx}) - {s} * ({b} - {cy}) + {cx}) / scale" for a, b in corners)
    ys = ", ".join(f"({s} * ({a} - {cx}) + {c} * ({b} - {cy}) + {cy}) / scale" for a, b in corners)
    clip = lambda e, lo, hi: f"CAST(greatest({lo}, least({hi}, {e})) AS BIGINT)"
    near = lambda e: f"round({e}, 6)"
    return f"array({clip(f'floor({near(f"least({xs})")})', 0, 'w0 - 1')}, {clip(f'floor({near(f"least({ys})")})', 0, 'h0 - 1')}, {clip(f'ceil({near(f"greatest({xs})")})', 1, 'w0')}, {clip(f'ceil({near(f"greatest({ys})")})', 1, 'h0')})"


def layout(images: DataFrame, settings: Settings | None = None, lines: DataFrame | None = None, read: script.Recogniser | None = None, detector: script.Detector | None = None) -> DataFrame:
    """path, error, and the result document of each image (path, content). read: a recogniser of line crops; detector: of lines on page images; lines: of lines in the columns of pages.LINES, found elsewhere."""
    spark = ship(images.sparkSession)
    c = settings or Settings()
    found = staged(pages.read_lines(images, c, read, detector)) if lines is None else lines
    found.createOrReplaceTempView("inkloom_lines")
    cols = ", ".join(x for x in found.columns if x not in ("seq", "path", "error"))
    boxed = staged(boxes.classified(spark, f"SELECT {cols} FROM inkloom_lines WHERE error IS NULL AND seq IS NOT NULL", c, own_context=True))
    ctx = found.groupBy("path", "page_id").agg(F.first("error").alias("error"), *(F.first(x).alias(x) for x in ("px1", "py1", "px2", "py2", "char_h", "scale", "skew", "full", "w0", "h0", "runtime_s")))
    half = lambda x: F.expr(f"floor({x} * 1000 + 0.5D) / 1000D")
    feats = F.struct(half("headline").alias("headline"), half("contrast").alias("contrast"), half("latin_ocr").alias("latin_ocr"), half("latin").alias("latin"))
    line = F.struct("seq", "label", F.expr(_back(("x1", "y1", "x2", "y2"))).alias("bbox"), F.col("conf").alias("confidence"), "reason", feats.alias("features"))
    per_line = boxed.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("line_list"))
    region = boxes.regions(boxed, c).join(ctx.select("page_id", "scale", "skew", "w0", "h0"), "page_id")
    entry = F.struct(F.col("region_id").alias("id"), "label", F.expr(_back(("x1", "y1", "x2", "y2"))).alias("bbox"), "confidence", "num_lines", "evidence")
    per_region = region.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("regions"))
    out = ctx.join(per_region, "page_id", "left").join(per_line, "page_id", "left")
    return out.select(
        "path", "error", F.array("w0", "h0").alias("image_size"), F.expr(_back(("px1", "py1", "px2", "py2"))).alias("page_bbox"), F.col("full").alias("page_is_full_frame"),
        half("skew").alias("skew_deg"), F.expr("floor(char_h / scale * 10 + 0.5D) / 10D").alias("char_height_px"), F.lit(bool(read) and c.use_ocr_script_check).alias("ocr_script_check"),
        F.coalesce("regions", F.expr("CAST(array() AS array<struct<id:bigint,label:string,bbox:array<bigint>,confidence:double,num_lines:bigint,evidence:array<string>>>)")).alias("regions"),
        F.expr("transform(coalesce(line_list, array()), x -> struct(x.label AS label, x.bbox AS bbox, x.confidence AS confidence, x.reason AS reason, x.features AS features))").alias("lines"), "runtime_s",
    )


def _named(results: DataFrame, base: str) -> DataFrame:
    """results with image: the path below `base`, a folder."""
    root = re.sub(r"^file:/+", "/", base).rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/+", "/")
    return results.withColumn("image", F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(F.regexp_extract("path", r"([^/]*)$", 1)))


def summary(results: DataFrame) -> DataFrame:
    """A row per image that was read: image or path, number of regions by label, runtime_s; and error of those that weren't."""
    counts = F.expr("map_from_entries(transform(array_distinct(transform(regions, r -> r.label)), l -> struct(l, CAST(size(filter(regions, r -> r.label = l)) AS BIGINT))))")
    name = F.col("image") if "image" in results.columns else F.col("path").alias("image")
    return results.select(name, counts.alias("regions"), "runtime_s", "error")


def write_documents(results: DataFrame, images: DataFrame, output: str, base: str, draw_lines: bool = False) -> None:
    """For each image that was read, <output>/<its path below base, without suffix>.json and ..._annotated.png, written by the tasks under a temporary name and moved."""
    named = _named(results.where("error IS NULL"), base)
    rows = images.join(named.select("path", "image", F.to_json(F.struct("image", *_DOCUMENT), {"ignoreNullFields": "false"}).alias("document")), "path")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(output if "://" in output else Path(output).absolute().as_uri())
        attempt = TaskContext.get().taskAttemptId()

        def put(name: str, data: bytes) -> None:
            to = f"{root}/{name}"
            fs.create_dir(to.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{to}.{attempt}") as f:
                f.write(data)
            fs.move(f"{to}.{attempt}", to)

        for batch in it:
            for row in batch.to_pylist():
                doc, stem = json.loads(row["document"]), row["image"].rpartition(".")[0]
                put(f"{stem}.json", json.dumps(doc, indent=2, ensure_ascii=False).encode())
                put(f"{stem}_annotated.png", encode_png(annotate.draw(decode(row["content"]), doc["regions"], doc["lines"] if draw_lines else None)))
                yield pa.RecordBatch.from_pydict({"image": [row["image"]]})

    rows.select("content", "image", "document").mapInArrow(run, "image string").write.format("noop").mode("overwrite").save()


def write_summary(spark: SparkSession, results: DataFrame, output: str, base: str, settings: Settings, backend: str) -> int:
    """<output>/summary.json, streamed row by row through the driver; returns the number of failed images."""
    rows = summary(_named(results, base))
    failed = rows.where("error IS NOT NULL").count()
    good = rows.where("error IS NULL")
    fs, root = pafs.FileSystem.from_uri(output if "://" in output else Path(output).absolute().as_uri())
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/summary.json") as f:
        head = json.dumps({"config": settings.to_dict(), "backend": backend, "processed": good.count(), "failed": failed}, indent=2)
        f.write((head[:-2] + ',\n  "images": [').encode())
        for i, r in enumerate(good.orderBy("image").toLocalIterator()):
            f.write(("," * (i > 0) + "\n    " + json.dumps({"image": r.image, "regions": r.regions, "runtime_s": r.runtime_s}, ensure_ascii=False)).encode())
        f.write(b"\n  ]\n}\n")
    return failed


def parse_args(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="inkloom")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--line-backend", choices=["cv", "kraken"], default="cv")
    p.add_argument("--kraken-model")
    p.add_argument("--device", default="cpu")
    p.add_argument("--no-ocr", action="store_true")
    p.add_argument("--no-deskew", action="store_true")
    p.add_argument("--draw-lines", action="store_true")
    p.add_argument("--config")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(argv)


#: Flags that turn a setting off.
_OFF = {"no_ocr": "use_ocr_script_check", "no_deskew": "deskew"}


def build_settings(args: argparse.Namespace) -> Settings:
    values = json.loads(Path(args.config).read_text(encoding="utf-8")) if args.config else {}
    return Settings.from_json(json.dumps(values | {name: False for flag, name in _OFF.items() if getattr(args, flag)}))


def main(argv: list[str] | None = None) -> int:
    """0 if all images were read, 1 without images, 2 if one failed."""
    args = parse_args(argv)
    detector = None if args.line_backend == "cv" else script.neural(args.kraken_model, args.device)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    images = list_images(spark, args.input, args.recursive)
    if images.select("path").isEmpty():
        return 1
    settings = build_settings(args)
    results = staged(layout(images, settings, read=script.recogniser() if settings.use_ocr_script_check else None, detector=detector))
    base = args.input if "://" in args.input else str(Path(args.input).absolute())
    base = base.rpartition("/")[0] if images.select("path").where(F.col("path").endswith(base)).count() else base
    write_documents(results, images, args.output, base, args.draw_lines)
    failed = write_summary(spark, results, args.output, base, settings, args.line_backend)
    log.info("%s: results in %s, %d failed", args.input, args.output, failed)
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
