"""Page images: ink, rules, layout, figures; the boundary to rasterisers and recognisers.

An image is a grey numpy array.  Decoding a file and recognising text are injected functions; portable grey maps
are decoded here, so that tests need no image library.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pages import PAGE

INK = 140


def decode_pgm(raw: bytes) -> np.ndarray:
    """A binary portable grey map."""
    kind, width, height, most, pixels = raw.split(maxsplit=4) if raw[:2] == b"P5" else (b"", 0, 0, 0, b"")
    if kind != b"P5":
        raise ValueError("not a grey map")
    return np.frombuffer(pixels, np.uint8, int(width) * int(height)).reshape(int(height), int(width)) * (255 // int(most))


def ink(grey: np.ndarray) -> np.ndarray:
    return grey < INK


def runs(mask: np.ndarray, least: int, vertical: bool) -> list[tuple[int, int, int]]:
    """(position, start, end) of straight runs of ink of a least length, by column if vertical, else by row."""
    lines = mask.T if vertical else mask
    edge = np.diff(np.pad(lines.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    at, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    long = end - start >= least
    return list(zip(at[long].tolist(), start[long].tolist(), end[long].tolist()))


def clusters(positions: list[int], gap: int = 8) -> list[int]:
    """The truncated mean of each group of positions at most ``gap`` apart."""
    x = np.sort(np.array(positions, int))
    return [int(g.mean()) for g in np.split(x, np.flatnonzero(np.diff(x) > gap) + 1)] if len(x) else []


def detect(mask: np.ndarray) -> dict:
    """A table (three vertical rules or more), columns (one rule in the middle), or neither; and the rules."""
    h, w = mask.shape
    vertical = clusters([p for p, _, _ in runs(mask[int(h * 0.10) : int(h * 0.93)], int(h * 0.20), True)])
    horizontal = clusters([p for p, _, _ in runs(mask, int(w * 0.45), False)])
    middle = [x for x in vertical if 0.42 * w < x < 0.58 * w]
    kind = "table" if len(vertical) >= 3 else "columns" if len(middle) == 1 else "single"
    return {"kind": kind, "split_x": middle[0] if kind == "columns" else None, "vertical_rules": vertical, "horizontal_rules": horizontal}


def figures(mask: np.ndarray, cell: int = 20, least: int = 260, filled: float = 0.02) -> list[list[int]]:
    """Boxes of connected areas of ink, on a grid of cells, of a least side and share of inked cells."""
    h, w = (n // cell for n in mask.shape)
    grid = mask[: h * cell, : w * cell].reshape(h, cell, w, cell).any(axis=(1, 3))
    label = np.where(grid, np.arange(1, grid.size + 1).reshape(grid.shape), 0)
    while True:  # the greatest label of each cell and its neighbours, until nothing changes
        pad = np.pad(label, 1)
        grown = np.where(grid, np.max([pad[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0), 0)
        if (grown == label).all():
            break
        label = grown
    out = []
    for k in np.unique(label[label > 0]):
        y, x = np.nonzero(label == k)
        box = [int(x.min()) * cell, int(y.min()) * cell, (int(x.max()) + 1) * cell, (int(y.max()) + 1) * cell]
        area = (box[2] - box[0]) * (box[3] - box[1]) / cell**2
        if min(box[2] - box[0], box[3] - box[1]) >= least and len(x) / area >= filled:
            out.append(box)
    return sorted(out)


def corner_group(mask: np.ndarray, gap: int = 40, least: int = 40) -> tuple[int, int] | None:
    """The last group of inked rows of a corner, tall enough to be a number."""
    rows = np.flatnonzero(mask.any(axis=1))
    groups = [g for g in np.split(rows, np.flatnonzero(np.diff(rows) > gap) + 1) if len(g) and g[-1] - g[0] + 1 >= least]
    return (int(groups[-1][0]), int(groups[-1][-1]) + 1) if groups else None


def recognise(files: DataFrame, engine: Callable[[np.ndarray, dict], list[dict]], decode: Callable[[bytes], np.ndarray] = decode_pgm, partitions: int | None = None) -> DataFrame:
    """Pages of the recognised schema from (pdf_page, content).  engine gets a page's grey image and layout and gives its lines.
    Pages are dealt out evenly, as recognition costs far more than a shuffle of file contents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for number, content in zip(part["pdf_page"], part["content"]):
                grey = decode(bytes(content))
                mask = ink(grey)
                layout = detect(mask) | {"figures": figures(mask)}
                lines = engine(grey, layout)
                conf = float(np.mean([x["conf"] for x in lines])) if lines else 0.0
                rows.append(json.dumps({"pdf_page": int(number), "engine": getattr(engine, "__name__", "engine"), "size": [grey.shape[1], grey.shape[0]], "layout": layout, "lines": lines, "words": [], "mean_conf": round(conf, 1)}))
            yield pd.DataFrame({"page": rows})

    dealt = files.select("pdf_page", "content").repartition(partitions or files.sparkSession.sparkContext.defaultParallelism, "pdf_page")
    return dealt.mapInPandas(run, "page string").select(F.from_json("page", PAGE).alias("p")).select("p.*")


def unread(files: DataFrame, done: DataFrame) -> DataFrame:
    """Pages for which there is no result yet."""
    return files.join(done.select("pdf_page"), "pdf_page", "left_anti")


def best_footer(footers: DataFrame) -> DataFrame:
    """(pdf_page, label): of both corners the reading with the greatest confidence that is a label; of equal ones the greater."""
    sides = footers.select("pdf_page", F.explode(F.array("left", "right")).alias("s")).select("pdf_page", F.replace("s.text", F.lit(" "), F.lit("")).alias("text"), "s.conf")
    return sides.where(F.col("text").rlike(r"^\d{1,2}-\d{1,3}$")).groupBy("pdf_page").agg(F.max_by("text", F.struct("conf", "text")).alias("label"))
