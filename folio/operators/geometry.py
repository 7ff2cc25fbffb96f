"""Boxes, lines, paragraphs, columns and tables of pages. What depends on the order of a page's boxes is folded page by page inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]
# fixed values: least determinant, overlap and distance of one line, gap of a space, spread of an alignment
SINGULAR, SAME_LINE, NEAR_LINE, SPACE, SPREAD = 1e-12, 0.55, 0.35, (1.5, 0.18), 0.75
# fixed values: width and table limits of a flow, overlap and left edges of a column
WIDEST, IN_TABLE, COLUMN, EDGE = 0.78, 0.25, 0.7, (28, 0.22)
# fixed values: tolerance of grids, sizes of tables, overlap of one table
TOLERANCE, CELL_SLACK, MOST_ROWS, MOST_COLUMNS, LEAST_TABLE, ONE_TABLE = 2.75, 1.0, 80, 30, (40, 20), 0.88

#: Pairs of boxes that are looked at together.
PAIRS = 1 << 20


def viewport_matrix(width: Column, height: Column, zoom: Column, rotation: Column) -> list[Column]:
    """a to f of the matrix that sets a page's points on a screen; a size or zoom that is not positive, and other rotations, give nulls."""
    zero = F.lit(0.0)
    by = {0: (zoom, zero, zero, -zoom, zero, height * zoom), 90: (zero, zoom, zoom, zero, zero, zero), 180: (-zoom, zero, zero, zoom, width * zoom, zero), 270: (zero, -zoom, -zoom, zero, height * zoom, width * zoom)}
    good = (width > 0) & (height > 0) & (zoom > 0)
    out = []
    for k in range(6):
        value = F.when(good & (rotation == 0), by[0][k])
        for turn in (90, 180, 270):
            value = value.when(good & (rotation == turn), by[turn][k])
        out.append(value)
    return out


def inverse_matrix(m: list[Column]) -> list[Column]:
    """The inverse of a matrix a to f; nulls where it has none."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    det = F.when(F.abs(det) >= SINGULAR, det)
    return [d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det]


def transform_boxes(boxes: DataFrame, pages: DataFrame, inverse: bool = False) -> DataFrame:
    """boxes(doc_id, page_number, object_id, x0, y0, x1, y1) in the coordinates of the screen (or back) of pages(doc_id, page_number, width, height, zoom, rotation); error where a page has no such matrix."""
    m = viewport_matrix(*(F.col(c).cast(t) for c, t in (("width", "double"), ("height", "double"), ("zoom", "double"), ("rotation", "int"))))
    names = list("abcdef")
    placed = pages.select(*PAGE, *(c.alias(f"_{n}") for c, n in zip(inverse_matrix(m) if inverse else m, names, strict=True)))
    a, b, c, d, e, f = (F.col(f"_{n}") for n in names)
    rows = boxes.join(placed, PAGE, "left")
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [a * x + c * y + e for x, y in corners], [b * x + d * y + f for x, y in corners]
    error = F.when(a.isNull(), "Page dimensions, zoom or rotation are not possible.")
    return rows.select(*PAGE, "object_id", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), error.alias("error"))


def _by_page(df: DataFrame, columns: list[str], fold: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """fold over the rows of each page (lists of Row-like tuples in columns' order, sorted by them); the results of several pages are given out together."""
    names = [part.split()[0] for part in schema.split(", ")]
    held = df.groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, page, rows in zip(frame["doc_id"], frame["page_number"], frame["_rows"], strict=True):
                out += [(doc, page, *row) for row in fold([tuple(r[c] for c in columns) for r in rows])]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "page_number", *names])

    return held.mapInPandas(run, f"doc_id long, page_number int, {schema}")


def _vertical_overlap(a: tuple, b: tuple) -> float:
    """Common height of boxes (y, h) in parts of the lower one, which counts as 1 at least."""
    return max(0.0, min(a[0] + a[1], b[0] + b[1]) - max(a[0], b[0])) / max(1.0, min(a[1], b[1]))


def _rows_of(keys: list[tuple], same: Callable[[tuple, tuple], bool], gone: Callable[[tuple, tuple], bool]) -> list[list[int]]:
    """Numbers of boxes, in order, that go to the first row with a member they match; keys are what matching depends on.

    gone says that a member can match neither this box nor a later one. A row is asked once for equal keys, and only for
    those in reach, so rows of very many boxes cost no more than short ones.
    """
    rows: list[list[int]] = []
    reach: dict[int, dict[tuple, None]] = {}
    for i, key in enumerate(keys):
        found = None
        for n, own in list(reach.items()):
            for k in [k for k in own if gone(k, key)]:
                del own[k]
            if not own:
                del reach[n]
            elif found is None and any(same(k, key) for k in own):
                found = n
                break
        if found is None:
            found = len(rows)
            rows.append([])
            reach[found] = {}
        rows[found].append(i)
        reach[found][key] = None
    return rows


def visual_lines(spans: DataFrame) -> DataFrame:
    """doc_id, page_number, line (from 0, in order of y, x), text, x, y, w, h, spans (their ids) of spans(doc_id, page_number, span_id, text, x, y, w, h, size).

    Spans in order of y, x join the first line with a member that overlaps by 0.55 or lies within 0.35 of the height.
    A space goes between spans that are farther apart than 1.5 or 0.18 of the size. Where spans have a column
    writing_mode, those with 1 are vertical: they join lines of their own kind, whose members share 0.55 of the
    width, and go from top to bottom.
    """

    def found(rows: list[tuple]) -> list[list[tuple]]:
        tallest = max((r[3] for r in rows), default=0.0)
        same = lambda a, b: _vertical_overlap(a, b) >= SAME_LINE or abs(a[0] - b[0]) <= max(a[1], b[1]) * NEAR_LINE
        gone = lambda a, b: a[0] + a[1] <= b[0] and b[0] - a[0] > max(a[1], tallest) * NEAR_LINE
        across, down = ([r for r in rows if (r[7] == 1) == vertical] for vertical in (False, True))
        lines = [sorted((across[i] for i in row), key=lambda r: r[1]) for row in _rows_of([(r[0], r[3]) for r in across], same, gone)]
        columns = _rows_of([(r[1], r[2]) for r in down], lambda a, b: _vertical_overlap(a, b) >= SAME_LINE, lambda a, b: False)
        return lines + [sorted((down[i] for i in row), key=lambda r: r[0]) for row in columns]

    def fold(rows: list[tuple]) -> list[tuple]:
        lines = []
        for own in found(rows):
            text, last = "", None
            for r in own:
                if not r[5]:
                    continue
                if last is not None and not text[-1:].isspace() and not r[5][:1].isspace() and r[1] - (last[1] + last[2]) > max(SPACE[0], min(last[4], r[4]) * SPACE[1]):
                    text += " "
                text, last = text + r[5], r
            x, y = min(r[1] for r in own), min(r[0] for r in own)
            lines.append((y, x, text.strip(), max(r[1] + r[2] for r in own) - x, max(r[0] + r[3] for r in own) - y, [r[6] for r in own]))
        lines.sort(key=lambda r: r[:2])
        return [(n, text, x, y, w, h, ids) for n, (y, x, text, w, h, ids) in enumerate(lines)]

    mode = F.col("writing_mode") if "writing_mode" in spans.columns else F.lit(0)
    rows = spans.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("y", "x", "w", "h", "size")), "text", F.col("span_id").cast("string").alias("span_id"), mode.cast("int").alias("writing_mode"))
    return _by_page(rows, ["y", "x", "w", "h", "size", "text", "span_id", "writing_mode"], fold, "line int, text string, x double, y double, w double, h double, spans array<string>")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, block, x, y, w, h, font, size, line_count, line_height, align of lines(doc_id, page_number, block, line, x, y, w, h, font, size).

    The font is the most frequent one (of several the first by name), the size the median; the line height is the
    median advance above 0.1, without one the larger of the median height and 1.2 sizes. The alignment is that of the
    edges with the smaller spread, by 0.75 at least: centre, then right, else left.
    """
    key = [*PAGE, "block"]
    order = Window.partitionBy(key).orderBy("y", "x", "line")
    every = Window.partitionBy(key)
    rows = lines.withColumn("_step", F.abs(F.col("y") - F.lag("y").over(order)))
    rows = rows.withColumn("_x0", F.min("x").over(every)).withColumn("_x1", F.max(F.col("x") + F.col("w")).over(every))
    left, right = F.col("x") - F.col("_x0"), F.col("_x1") - F.col("x") - F.col("w")
    centre = F.col("x") + F.col("w") / 2 - (F.col("_x0") + F.col("_x1")) / 2
    found = rows.groupBy(key).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_x"), F.max(F.col("y") + F.col("h")).alias("_y"), F.mode("font", True).alias("font"),
        F.median(F.when(F.col("size") > 0, F.col("size"))).alias("size"), F.count("*").alias("line_count"), F.median(F.when(F.col("_step") > 0.1, F.col("_step"))).alias("_advance"), F.median("h").alias("_height"),
        F.stddev_pop(left).alias("_l"), F.stddev_pop(right).alias("_r"), F.stddev_pop(centre).alias("_c"),
    )
    height = F.coalesce("_advance", F.greatest("_height", F.col("size") * 1.2))
    align = F.when(F.col("line_count") < 2, "left").when(F.col("_c") + SPREAD < F.least("_l", "_r"), "center").when(F.col("_r") + SPREAD < F.col("_l"), "right").otherwise("left")
    return found.select(*key, "x", "y", (F.col("_x") - F.col("x")).alias("w"), (F.col("_y") - F.col("y")).alias("h"), "font", "size", "line_count", height.alias("line_height"), align.alias("align"))


def _area(a: tuple, b: tuple) -> float:
    """Common area of boxes (x, y, w, h)."""
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def text_flows(blocks: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_number, object_id, flow, position, gap_before, gap_after of blocks(doc_id, page_number, object_id, x, y, w, h, direction) that flow in a column with others.

    Only left-to-right blocks of 0.78 of the width of pages(doc_id, page_number, width) at most count, less than a
    quarter of which lies in one of tables(doc_id, page_number, x, y, w, h). In order of x, y a block joins the column
    it overlaps most, by 0.7 or more, with left edges near each other.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        columns: list[list] = []  # box, members
        for x, y, w, h, name in rows:
            best, most = None, 0.0
            for column in columns:
                cx, _, cw, _ = column[0]
                share = max(0.0, min(cx + cw, x + w) - max(cx, x)) / max(1.0, min(cw, w))
                if share >= COLUMN and abs(cx - x) <= max(EDGE[0], min(cw, w) * EDGE[1]) and (best is None or share > most):
                    best, most = column, share
            if best is None:
                columns.append([(x, y, w, h), [(y, x, h, name)]])
                continue
            cx, cy, cw, ch = best[0]
            left, top = min(cx, x), min(cy, y)
            best[0] = (left, top, max(cx + cw, x + w) - left, max(cy + ch, y + h) - top)
            best[1].append((y, x, h, name))
        out = []
        for n, (_, own) in enumerate(sorted((c for c in columns if len(c[1]) > 1), key=lambda c: c[0][0])):
            own.sort(key=lambda r: r[:2])
            gaps = [max(0.0, b[0] - (a[0] + a[2])) for a, b in zip(own, own[1:], strict=False)]
            out += [(name, n, i, gaps[i - 1] if i else None, gaps[i] if i < len(gaps) else None) for i, (*_, name) in enumerate(own)]
        return out

    box = lambda s: [F.col(f"{s}.{c}") for c in ("x", "y", "w", "h")]
    (bx, by, bw, bh), (tx, ty, tw, th) = box("b"), box("t")
    common = F.greatest(F.lit(0.0), F.least(bx + bw, tx + tw) - F.greatest(bx, tx)) * F.greatest(F.lit(0.0), F.least(by + bh, ty + th) - F.greatest(by, ty))
    same = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_number") == F.col("t.page_number"))
    free = blocks.alias("b").join(tables.alias("t"), same & (common / F.greatest(F.lit(1.0), F.least(bw * bh, tw * th)) >= IN_TABLE), "left_anti")
    safe = free.join(pages.select(*PAGE, "width"), PAGE).where((F.col("direction") == "ltr") & (F.col("w") > 2) & (F.col("h") > 2) & (F.col("w") <= F.col("width") * WIDEST))
    rows = safe.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), F.col("object_id").cast("string").alias("object_id"))
    return _by_page(rows, ["x", "y", "w", "h", "object_id"], fold, "object_id string, flow int, position int, gap_before double, gap_after double")


def clusters(values: list[float], tolerance: float = TOLERANCE) -> list[float]:
    """Means of sorted values, each with the group before it while it lies within tolerance of its mean so far."""
    sums: list[list[float]] = []
    for value in sorted(v for v in values if np.isfinite(v)):
        if sums and abs(value - sums[-1][0] / sums[-1][1]) <= tolerance:
            sums[-1][0] += value
            sums[-1][1] += 1
        else:
            sums.append([value, 1])
    return [total / n for total, n in sums]


def cluster_values(values: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, page_number, axis, position, value: means of the clusters of values(doc_id, page_number, axis, value)."""

    def fold(rows: list[tuple]) -> list[tuple]:
        by: dict[str, list[float]] = {}
        for axis, value in rows:
            by.setdefault(axis, []).append(value)
        return [(axis, n, mean) for axis, own in by.items() for n, mean in enumerate(clusters(own, tolerance))]

    return _by_page(values.where("value is not null").select(*PAGE, "axis", F.col("value").cast("double").alias("value")), ["axis", "value"], fold, "axis string, position int, value double")


def aligned_text_tables(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, row, column, text, x, y, w, h, confidence of the table that lines(doc_id, page_number, text, x, y, w, h) of a page form.

    Lines that overlap by 0.55 are a row. Rows of two cells or more count whose number is within one of the largest;
    two of them make a table.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 4:
            return []
        found = _rows_of([(r[0], r[3]) for r in rows], lambda a, b: _vertical_overlap(a, b) >= SAME_LINE, lambda a, b: a[0] + a[1] <= b[0])
        wide = [sorted((rows[i] for i in row), key=lambda r: r[1]) for row in found if len(row) > 1]
        columns = max(map(len, wide), default=0)
        kept = [row for row in wide if columns - len(row) <= 1]
        if len(kept) < 2:
            return []
        confidence = max(0.6, min(0.94, 0.72 + len(kept) * 0.025 + columns * 0.02))
        return [(r, c, cell[4], cell[1], cell[0], cell[2], cell[3], confidence) for r, row in enumerate(kept) for c, cell in enumerate(row)]

    rows = lines.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("y", "x", "w", "h")), "text")
    return _by_page(rows, ["y", "x", "w", "h", "text"], fold, "row int, column int, text string, x double, y double, w double, h double, confidence double")


class _Sets:
    """Items joined into sets; the least item of a set stands for it."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low, high = np.minimum(self.up[a], self.up[b]), np.maximum(self.up[a], self.up[b])
            if not (low < high).any():
                return
            np.minimum.at(self.up, high, low)
            while ((above := self.up[self.up]) != self.up).any():
                self.up = above

    def groups(self) -> list[np.ndarray]:
        """The sets, by their least item."""
        order = np.argsort(self.up, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.up[order])) + 1) if len(order) else []


def _meeting(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes with TOLERANCE at most between them, PAIRS of them looked at together: in order of x0 a box meets those that begin before it ends."""
    order = np.argsort(x0, kind="stable")
    upto = np.searchsorted(x0[order], x1[order] + TOLERANCE, side="right")
    many = np.maximum(0, upto - np.arange(1, len(order) + 1))
    cuts = np.unique(np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS))).tolist() if len(order) else []
    low = 0
    for high in [*(min(c + 1, len(order)) for c in cuts), len(order)]:
        size = many[low:high]
        if size.sum():
            first = np.repeat(np.arange(low, high), size)
            other = first + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, b = order[first], order[other]
            near = (x0[b] <= x1[a] + TOLERANCE) & (x1[b] >= x0[a] - TOLERANCE) & (x0[a] <= x1[b] + TOLERANCE) & (y0[a] <= y1[b] + TOLERANCE) & (y0[b] <= y1[a] + TOLERANCE)
            yield a[near], b[near]
        low = high


def _edges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the items whose high lies more than 2 and TOLERANCE at most above the low of another, wherever they are otherwise.

    In order of low the others of an item follow one another, so one pair with the first of them and pairs of neighbours join all.
    """
    order = np.argsort(low, kind="stable")
    begins = low[order]
    left, right = np.searchsorted(begins, high - TOLERANCE - 1e-6), np.searchsorted(begins, high - 2 + 1e-6)
    at = np.arange(len(low))
    for _ in range(len(low)):  # rounding: the ends of a range are tried as the condition has it
        out = (left < right) & (high - begins[np.minimum(left, len(low) - 1)] > TOLERANCE)
        if not out.any():
            break
        left = left + out
    for _ in range(len(low)):
        out = (left < right) & (high - begins[np.maximum(right - 1, 0)] <= 2)
        if not out.any():
            break
        right = right - out
    some = left < right
    inner = np.zeros(len(low) + 1, dtype=np.int64)
    np.add.at(inner, left[some], 1)
    np.add.at(inner, right[some] - 1, -1)
    linked = np.flatnonzero(np.cumsum(inner)[:-1] > 0)
    return np.concatenate([at[some], order[linked]]), np.concatenate([order[left[some]], order[np.minimum(linked + 1, len(low) - 1)]])


def _grids(boxes: np.ndarray, kinds: list[str]) -> list[dict]:
    """Grids of a page's rectangles, then of its crossing lines, as xs, ys and the numbers of their boxes."""
    x0, y0, w, h = boxes.T
    x1, y1 = x0 + w, y0 + h
    rect = np.flatnonzero(np.array([k == "rect" for k in kinds]) & (w >= 12) & (h >= 6))
    found = []
    if len(rect):
        sets, box = _Sets(len(rect)), (x0[rect], x1[rect], y0[rect], y1[rect])
        common = lambda a0, a1, a, b: np.minimum(a1[a], a1[b]) - np.maximum(a0[a], a0[b])
        for a, b in _meeting(*box):
            close = (common(box[2], box[3], a, b) > 2) | (common(box[0], box[1], a, b) > 2)
            sets.join(a[close], b[close])
        sets.join(*_edges(box[0], box[1]))
        sets.join(*_edges(box[2], box[3]))
        for group in sets.groups():
            own = rect[group]
            if len(own) >= 4:
                found.append({"xs": clusters([*x0[own], *x1[own]]), "ys": clusters([*y0[own], *y1[own]]), "own": own, "rects": own})
    flat = (w >= 36) & (h <= np.maximum(3, w * 0.035)) & (w >= h * 5)
    tall = (h >= 24) & (w <= np.maximum(3, h * 0.035)) & (h >= w * 5)
    if flat.sum() >= 3 and tall.sum() >= 3:
        lines = np.flatnonzero(flat | tall)
        sets = _Sets(len(lines))
        for a, b in _meeting(x0[lines], x1[lines], y0[lines], y1[lines]):
            cross = flat[lines[a]] != flat[lines[b]]
            sets.join(a[cross], b[cross])
        for group in sets.groups():
            own = lines[group]
            up, across = own[tall[own] & ~flat[own]], own[flat[own]]
            found.append({"xs": clusters((x0[up] + w[up] / 2).tolist()), "ys": clusters((y0[across] + h[across] / 2).tolist()), "own": own, "rects": own[:0]})
    return [g for g in found if len(g["xs"]) >= 3 and len(g["ys"]) >= 3]


def grid_tables(vectors: DataFrame) -> DataFrame:
    """doc_id, page_number, table_id, x, y, w, h, xs, ys, rows, columns, merged, complex, confidence of the grids of vectors(doc_id, page_number, vector_id, kind, x, y, w, h).

    kind is rect for a closed rectangle, image for an image, anything else for other art. Four connected rectangles
    or three crossing lines each way make a grid, of 2 to 80 rows and 2 to 30 columns, 40 by 20 at least. merged
    counts rectangles over several cells that do not overlap smaller ones. A table with an image or other art in it is
    complex. Tables that cover 0.88 of a smaller one found before are left out.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        boxes, kinds = np.array([r[:4] for r in rows], dtype=float), [r[4] for r in rows]
        out = []
        for grid in _grids(boxes, kinds):
            xs, ys = np.array(grid["xs"]), np.array(grid["ys"])
            n_rows, n_columns, w, h = len(ys) - 1, len(xs) - 1, xs[-1] - xs[0], ys[-1] - ys[0]
            if not (2 <= n_rows <= MOST_ROWS and 2 <= n_columns <= MOST_COLUMNS) or w < LEAST_TABLE[0] or h < LEAST_TABLE[1]:
                continue
            box = (xs[0], ys[0], w, h)
            if any(_area(box, t[1:5]) / max(1.0, min(w * h, t[3] * t[4])) > ONE_TABLE for t in out):
                continue
            nearest = lambda edges, v: int(np.abs(edges - v).argmin())
            spans = sorted(((c1 - c0) * (r1 - r0), c0, c1, r0, r1) for x, y, bw, bh in boxes[grid["rects"]] for c0, c1, r0, r1 in [(nearest(xs, x), nearest(xs, x + bw), nearest(ys, y), nearest(ys, y + bh))])
            covered, merged = np.zeros((n_rows, n_columns), dtype=bool), 0
            for area, c0, c1, r0, r1 in spans:
                if c1 > c0 and r1 > r0 and 1 < area < n_rows * n_columns and not covered[r0:r1, c0:c1].any():
                    covered[r0:r1, c0:c1] = True
                    merged += 1
            inside = (boxes[:, 0] <= box[0] + w) & (boxes[:, 0] + boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[1] + h) & (boxes[:, 1] + boxes[:, 3] >= box[1])
            inside[grid["own"]] = False
            bw, bh = boxes[:, 2], boxes[:, 3]
            line = ((bw >= 36) & (bh <= np.maximum(3, bw * 0.035)) & (bw >= bh * 5)) | ((bh >= 24) & (bw <= np.maximum(3, bh * 0.035)) & (bh >= bw * 5))
            image = np.array([k == "image" for k in kinds])
            complex_ = bool((inside & (image | (~line & (bw * bh > 9)))).any())
            confidence = max(0.76, min(0.97, 0.86 + min(n_rows * n_columns, 12) * 0.007 - (0.08 if complex_ else 0)))
            out.append((len(out), *map(float, box), xs.tolist(), ys.tolist(), n_rows, n_columns, merged, complex_, confidence))
        return out

    rows = vectors.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), F.coalesce("kind", F.lit("")).alias("kind"))
    schema = "table_id int, x double, y double, w double, h double, xs array<double>, ys array<double>, rows int, columns int, merged int, complex boolean, confidence double"
    return _by_page(rows, ["x", "y", "w", "h", "kind"], fold, schema)


def assign_cells(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_number, table_id, row, column, text of the cells of tables(doc_id, page_number, table_id, xs, ys) that hold spans(doc_id, page_number, span_id, text, x, y, w, h).

    A span belongs where its centre is, with a slack of 1 at the edges of the table; one wider than 1.35 columns with
    two words or more, but no more than there are columns, gives each column a word. Texts of a cell are joined in
    order of y, x.
    """
    columns, rows = F.size("xs") - 1, F.size("ys") - 1
    held = spans.select(*PAGE, "span_id", "text", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h"))).join(tables.select(*PAGE, "table_id", "xs", "ys"), PAGE)
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    first, last = (lambda c: F.get(c, F.lit(0))), (lambda c: F.element_at(c, -1))
    touches = (F.col("x") <= last("xs") + 1) & (F.col("x") + F.col("w") >= first("xs") - 1) & (F.col("y") <= last("ys") + 1) & (F.col("y") + F.col("h") >= first("ys") - 1)
    held = held.where(touches & cy.between(first("ys") - CELL_SLACK, last("ys") + CELL_SLACK))
    cell = lambda edges, v, n: F.greatest(F.lit(0), F.least(n - 1, F.size(F.filter(edges, lambda e: e <= v)) - 1))
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    wide = (F.col("w") > (last("xs") - first("xs")) / F.greatest(F.lit(1), columns) * 1.35) & (F.size(words) >= 2) & (F.size(words) <= columns)
    inside = cx.between(first("xs") - CELL_SLACK, last("xs") + CELL_SLACK)
    one = F.struct(cell("xs", cx, columns).alias("column"), F.col("text").alias("text"))
    spread = F.transform(words, lambda w, i: F.struct(i.alias("column"), w.alias("text")))
    parts = F.when(wide, spread).when(inside, F.array(one))
    rows_ = held.select(*PAGE, "table_id", cell("ys", cy, rows).alias("row"), "y", "x", "span_id", F.explode(parts).alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "span_id", F.col("_p.text").alias("text"))))
    found = rows_.groupBy(*PAGE, "table_id", "row", F.col("_p.column").alias("column")).agg(ordered.alias("_all"))
    return found.select(*PAGE, "table_id", "row", "column", F.trim(F.array_join(F.transform("_all", lambda s: s["text"]), " ")).alias("text"))


def dedupe_tables(tables: DataFrame) -> DataFrame:
    """doc_id, page_number, table_id of tables(doc_id, page_number, table_id, x, y, w, h) that do not cover 0.88 of the smaller of them and one kept before, in order of table_id."""

    def fold(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in rows:
            if not any(_area(row[1:], k[1:]) / max(1.0, min(row[3] * row[4], k[3] * k[4])) > ONE_TABLE for k in kept):
                kept.append(row)
        return [row[:1] for row in kept]

    rows = tables.select(*PAGE, F.col("table_id").cast("int").alias("table_id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))
    return _by_page(rows, ["table_id", "x", "y", "w", "h"], fold, "table_id int")
