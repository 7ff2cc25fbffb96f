"""Fingerprints, differences and preparation of images (RGBA bytes, a row after the other), in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.storage import written

# fixed values of the fingerprint: samples across and down, weights of the colours, ink limit, weights and spread of the similarity
ACROSS, DOWN, LUMA, INK = 9, 8, (0.2126, 0.7152, 0.0722), 236
W_HASH, W_INK, W_ASPECT, INK_SPREAD = 0.78, 0.14, 0.08, 0.35
# fixed values of the hybrid similarity and of the pixel difference
W_TEXT, W_VISUAL, RELIABLE, CHANGED = 0.76, 0.24, 24, 45
# fixed values of the grey of recognition
GREY = (0.299, 0.587, 0.114)
BANDS, LEAST = 4, 0.92


def _pixels(raw: bytes | None, width: int, height: int) -> np.ndarray | None:
    """height x width x 4, or None if the size is not possible."""
    if raw is None or width is None or height is None or width < 1 or height < 1 or len(raw) < width * height * 4:
        return None
    return np.frombuffer(raw, dtype=np.uint8, count=int(width) * int(height) * 4).reshape(int(height), int(width), 4)


def visual_fingerprint(images: DataFrame) -> DataFrame:
    """image_id, bits (64, as a long), ink, aspect, error of images(image_id, rgba, width, height).

    A bit tells whether a sample is lighter than the one to its right. An image without a possible size has an
    error and null figures.
    """

    def one(raw, width, height):
        p = _pixels(raw, width, height)
        if p is None:
            return None, None, None, "Invalid image size."
        rows = np.minimum(height - 1, ((np.arange(DOWN) + 0.5) / DOWN * height).astype(np.int64))
        columns = np.minimum(width - 1, ((np.arange(ACROSS) + 0.5) / ACROSS * width).astype(np.int64))
        s = p[rows[:, None], columns[None, :], :3].astype(np.float64)
        luma = s[..., 0] * LUMA[0] + s[..., 1] * LUMA[1] + s[..., 2] * LUMA[2]
        single = luma.astype(np.float32)
        packed = np.packbits((single[:, :-1] > single[:, 1:]).ravel()).tobytes()
        return int.from_bytes(packed, "big", signed=True), float((luma < INK).mean()), width / height, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(*row) for row in frame[["rgba", "width", "height"]].itertuples(index=False)]
            out = pd.DataFrame(found, columns=["bits", "ink", "aspect", "error"], dtype=object)
            yield out.assign(bits=pd.array(out["bits"], dtype="Int64"), ink=out["ink"].astype(float), aspect=out["aspect"].astype(float), image_id=frame["image_id"].to_numpy())[["image_id", "bits", "ink", "aspect", "error"]]

    return images.select("image_id", "rgba", "width", "height").mapInPandas(run, "image_id long, bits long, ink double, aspect double, error string")


def visual_similarity(a: str, b: str) -> Column:
    """Similarity of two struct columns (bits, ink, aspect)."""
    c = lambda s, n: F.col(f"{s}.{n}")
    hash_ = 1 - F.bit_count(c(a, "bits").bitwiseXOR(c(b, "bits"))) / 64
    ink = 1 - F.least(F.lit(1.0), F.abs(c(a, "ink") - c(b, "ink")) / INK_SPREAD)
    aspect = F.least(c(a, "aspect"), c(b, "aspect")) / F.greatest(c(a, "aspect"), c(b, "aspect"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), hash_ * W_HASH + ink * W_INK + aspect * W_ASPECT))


def hybrid_similarity(a: str, b: str, text: Column) -> tuple[Column, Column]:
    """Similarity and basis (text, visual, hybrid) of two struct columns (length of the normal text, visual), where text is their text similarity."""
    both = F.col(f"{a}.visual").isNotNull() & F.col(f"{b}.visual").isNotNull()
    reliable = (F.col(f"{a}.length") >= RELIABLE) & (F.col(f"{b}.length") >= RELIABLE)
    visual = visual_similarity(f"{a}.visual", f"{b}.visual")
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), text * W_TEXT + visual * W_VISUAL))
    basis = F.when(~both, "text").when(reliable, "hybrid").otherwise("visual")
    return F.when(~both, text).when(reliable, mixed).otherwise(visual), basis


def similar_images(prints: DataFrame, threshold: float = LEAST) -> DataFrame:
    """a, b, a_copies, b_copies, similarity of all pairs of different fingerprints(image_id, bits, ink, aspect) at the threshold or above; a and b are the first images with them.

    Images of equal fingerprint are one: a row of an image with itself where it has copies. At 0.92 fingerprints
    differ in 6 bits at most, so one of four parts of 16 bits differs in one bit or none: the parts of one side
    meet those of the other with any one bit turned. Lower thresholds would lose pairs and are refused.
    """
    if threshold < LEAST:
        raise ValueError(f"similar_images: the threshold must be {LEAST} or more")
    kinds = prints.where("bits is not null").groupBy("bits", "ink", "aspect").agg(F.min("image_id").alias("id"), F.count("*").alias("copies"))
    kinds = written(kinds)
    part = lambda i: F.shiftrightunsigned("bits", 16 * i).bitwiseAND(F.lit(0xFFFF))
    flips = F.array(F.lit(0), *(F.lit(1 << k) for k in range(16)))
    row = F.struct("id", "copies", "bits", "ink", "aspect")
    left = kinds.select(row.alias("x"), F.posexplode(F.array(*map(part, range(BANDS)))).alias("_band", "_key"))
    right = kinds.select(row.alias("y"), F.posexplode(F.array(*map(part, range(BANDS)))).alias("_band", "_part"))
    right = right.select("y", "_band", F.explode(F.transform(flips, lambda f: F.col("_part").bitwiseXOR(f))).alias("_key"))
    # merged: a table of fingerprints is small enough to be broadcast, with all their turned parts it is not
    met = left.hint("merge").join(right, ["_band", "_key"]).where("x.id < y.id").select("x", "y")
    found = met.withColumn("similarity", visual_similarity("x", "y")).where(F.col("similarity") >= threshold).distinct()
    found = found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.copies").alias("a_copies"), F.col("y.copies").alias("b_copies"), "similarity")
    alike = kinds.where("copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("copies").alias("a_copies"), F.col("copies").alias("b_copies"), F.lit(1.0).alias("similarity"))
    return found.unionByName(alike)


def pixel_diff(pairs: DataFrame) -> DataFrame:
    """pair_id, changed, changed_ratio of pairs(pair_id, left, left_width, left_height, right, right_width, right_height); the smaller image is padded with white, transparency lies on white."""

    def on_white(p: np.ndarray, width: int, height: int) -> np.ndarray:
        out = np.full((height, width, 3), 255.0)
        alpha = p[..., 3:].astype(float) / 255
        out[: p.shape[0], : p.shape[1]] = np.floor(p[..., :3] * alpha + 255 * (1 - alpha) + 0.5)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, l, lw, lh, r, rw, rh in frame[["pair_id", "left", "left_width", "left_height", "right", "right_width", "right_height"]].itertuples(index=False):  # noqa: E741
                a, b = _pixels(l, lw, lh), _pixels(r, rw, rh)
                if a is None or b is None:
                    out.append((key, None, None))
                    continue
                width, height = max(lw, rw), max(lh, rh)
                changed = int((np.abs(on_white(a, width, height) - on_white(b, width, height)).sum(-1) > CHANGED).sum())
                out.append((key, changed, changed / (width * height)))
            yield pd.DataFrame(out, columns=["pair_id", "changed", "changed_ratio"]).astype({"changed": "Int64", "changed_ratio": float})

    return pairs.mapInPandas(run, "pair_id long, changed long, changed_ratio double")


def preprocess_images(images: DataFrame, grayscale: bool = False, contrast: float = 1.0, brightness: float = 0.0, threshold: float | None = None, invert: bool = False) -> DataFrame:
    """image_id, rgba of images prepared for recognition: grey, contrast about 128, brightness, threshold of the mean, inversion; alpha stays, an image of impossible size is null."""
    contrast, brightness = max(0.1, contrast), max(-255, min(255, brightness))
    half_up = lambda x: np.floor(x + 0.5)

    def one(raw, width, height) -> bytes | None:
        p = _pixels(raw, width, height)
        if p is None:
            return None
        c = p[..., :3].astype(np.float64)
        if grayscale or threshold is not None:
            c = np.repeat(half_up(c[..., :1] * GREY[0] + c[..., 1:2] * GREY[1] + c[..., 2:] * GREY[2]), 3, axis=2)
        c = (c - 128) * contrast + 128 + brightness
        if threshold is not None:
            c = np.repeat(np.where((c[..., :1] + c[..., 1:2] + c[..., 2:]) / 3 >= threshold, 255.0, 0.0), 3, axis=2)
        if invert:
            c = 255 - c
        return np.concatenate([np.clip(half_up(c), 0, 255).astype(np.uint8), p[..., 3:]], axis=2).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"image_id": frame["image_id"], "rgba": [one(*row) for row in frame[["rgba", "width", "height"]].itertuples(index=False)]})

    return images.select("image_id", "rgba", "width", "height").mapInPandas(run, "image_id long, rgba binary")


def histogram(images: DataFrame) -> DataFrame:
    """level, pixels: how many pixels of all images have each level of red."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = np.zeros(256, dtype=np.int64)
            for raw in frame["rgba"].dropna():
                counts += np.bincount(np.frombuffer(raw, dtype=np.uint8)[::4], minlength=256)
            yield pd.DataFrame({"level": np.arange(256), "pixels": counts})

    levels = images.select("rgba").mapInPandas(run, "level int, pixels long")
    return levels.groupBy("level").agg(F.sum("pixels").alias("pixels")).where("pixels > 0")
