"""Fusion of detector outputs: greedy clustering of boxes, decisions, suppression, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, box
from ..functions.lineage import paired
from .detect import clamp_confidence
from .rules import REDACT, REVIEW

#: Fixed values.
OVERLAP, CONTAINED_RATIO, AGREEMENT, CELL, BRUTE = 0.40, 0.5, 0.15, 120, 30
APART = ("face", "identity_document")
SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("cand_seq", pa.int64()), ("type", pa.string()), ("sources", pa.list_(pa.string())), ("text", pa.string()), ("tokens", pa.list_(pa.string())), ("confidence", pa.float64()), ("reason", pa.string()),
    ("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("members", pa.list_(pa.int64())),
])
FUSED = "page_id long, cand_seq long, type string, sources array<string>, text string, tokens array<string>, confidence double, reason string, x int, y int, width int, height int, members array<long>"


def meets(a: list[int], b: list[int]) -> bool:
    """Boxes [x, y, right, bottom] overlap by more than OVERLAP, or one holds the other at a fair area ratio."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return False
    sizes = sorted(((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])))
    return w * h > OVERLAP * (sum(sizes) - w * h) or (w * h == sizes[0] and sizes[0] >= CONTAINED_RATIO * sizes[1])


def cells_of(b: list[int]) -> tuple[int, int, int, int]:
    return b[0] // CELL, b[1] // CELL, b[2] // CELL, b[3] // CELL


def fuse_page(rows: list[dict]) -> list[dict]:
    """Greedy: the most confident free candidate absorbs later ones in order; its box grows as it does."""
    rows = sorted((r for r in rows if r["width"] > 0 and r["height"] > 0), key=lambda r: (-r["confidence"], r["cand_seq"]))
    boxes = [[r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]] for r in rows]
    kinds = [r["type"] if r["type"] in APART else "" for r in rows]
    used, out, many = [False] * len(rows), [], len(rows) > BRUTE
    for i, r in enumerate(rows):
        if used[i]:
            continue
        cur = {**r, "sources": list(r["sources"]), "tokens": list(r["tokens"]), "members": [r["cand_seq"]]}
        box, seed = list(boxes[i]), cells_of(boxes[i])
        for j in range(i + 1, len(rows)):
            # a crowded page is searched in the cells of the seed's first box only; kinds follow the current type
            if used[j] or kinds[j] != (cur["type"] if cur["type"] in APART else ""):
                continue
            if many:
                c = cells_of(boxes[j])
                if c[0] > seed[2] or c[2] < seed[0] or c[1] > seed[3] or c[3] < seed[1]:
                    continue
            if not meets(box, boxes[j]):
                continue
            o, used[j] = rows[j], True
            box = [min(box[0], boxes[j][0]), min(box[1], boxes[j][1]), max(box[2], boxes[j][2]), max(box[3], boxes[j][3])]
            cur["tokens"] += [t for t in dict.fromkeys(o["tokens"]) if t not in cur["tokens"]]
            cur["sources"] += [s for s in dict.fromkeys(o["sources"]) if s not in cur["sources"]]
            most = max(cur["confidence"], o["confidence"])
            cur["confidence"] = min(1.0, most + AGREEMENT) if len(cur["sources"]) > 1 else most
            if o["text"] and not cur["text"] and o["confidence"] > cur["confidence"] - 0.05:
                cur["text"] = o["text"]
            if cur["type"] == "other":
                cur["type"] = o["type"]
            cur["members"].append(o["cand_seq"])
        out.append(cur | {"x": box[0], "y": box[1], "width": box[2] - box[0], "height": box[3] - box[1]})
    return out


def fuse(candidates: DataFrame) -> DataFrame:
    """candidates(page_id, cand_seq, type, sources, text, tokens, confidence, reason, bbox) to detections with decision and final box.

    Pages are independent and bounded by what a screen shows: partitions are ordered by page, and a task holds one page at a time.
    """
    flat = candidates.select(
        "page_id", "cand_seq", F.coalesce("type", F.lit("other")).alias("type"), F.coalesce("sources", F.array(F.lit("dom"))).alias("sources"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("tokens", F.expr("cast(array() as array<string>)")).alias("tokens"), clamp_confidence(F.col("confidence")).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), "bbox.x", "bbox.y", "bbox.width", "bbox.height",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for r in batch.to_pylist():
                if page and r["page_id"] != page[0]["page_id"]:
                    done += fuse_page(page)
                    page = []
                page.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, SCHEMA)
        if page:
            yield pa.RecordBatch.from_pylist(fuse_page(page), SCHEMA)

    ordered = flat.repartition("page_id").sortWithinPartitions("page_id")
    return decided(ordered.mapInArrow(run, FUSED).withColumn("bbox", box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).drop("x", "y", "width", "height"))


def shield(kind: Column, reason: Column) -> Column:
    return (kind == "identity_document") | F.startswith(reason, F.lit("document_shield:"))


def giant(kind: Column, reason: Column, b: Column) -> Column:
    """A container too large to be one datum."""
    exempt = (kind == "face") | shield(kind, reason) | F.startswith(reason, F.lit("form_field_anchor:")) | F.startswith(reason, F.lit("ocr_regex:")) | (kind == "apiToken") | (b["height"] <= 55)
    return ~exempt & (((b["width"] > 550) & (b["height"] > 120)) | ((area(b) > 50000) & (b["height"] > 80)))


def decided(df: DataFrame) -> DataFrame:
    """decision from type, reason, confidence and bbox; redacted signatures get room around them."""
    kind, reason, c, b = F.col("type"), F.col("reason"), F.col("confidence"), F.col("bbox")
    sure = (kind == "face") | shield(kind, reason) | (c >= REDACT)
    out = df.withColumn("decision", F.when(giant(kind, reason, b), "KEEP").when(sure, "REDACT").when(c >= REVIEW, "REVIEW").otherwise("KEEP"))
    top = F.least(b["y"], F.lit(45))
    room = box(b["x"], b["y"] - top, b["width"] + 25, b["height"] + top + 10)
    return out.withColumn("bbox", F.when((kind == "signature") & (F.col("decision") == "REDACT"), room).otherwise(b))


def summaries(found: DataFrame) -> DataFrame:
    """(page_id, total, by_type, by_source): sources count by their first."""
    n = found.groupBy("page_id").agg(F.count("*").alias("total"))
    by = lambda c, name: found.groupBy("page_id", c.alias("k")).count().groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "count")))).alias(name))
    return paired(paired(n, by(F.col("type"), "by_type"), "page_id"), by(F.get("sources", F.lit(0)), "by_source"), "page_id")


def suppress(boxes: Column, threshold: float = 0.30) -> Column:
    """Greedy suppression over array<struct<score, x, y, width, height>>: by descending score, those that overlap no kept one by the threshold or more."""
    from ..functions.geometry import iou

    order = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("k"), i.alias("i"), b.alias("b"))))
    plain = F.transform(order, lambda o: o["b"])
    return F.aggregate(plain, F.slice(plain, 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) >= threshold), acc).otherwise(F.concat(acc, F.array(b))))
