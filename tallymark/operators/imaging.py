"""Image kernels on Spark's ``image`` rows: fingerprints, perceptual hashes, copied blocks, compression error, similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.anomaly import quartiles


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Luminance, rows first, from Spark's channel order (blue, green, red[, alpha])."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else np.round(0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2])


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the area that each new pixel covers."""
    rows = np.minimum(np.arange(h + 1) * a.shape[0] / h, a.shape[0])
    cols = np.minimum(np.arange(w + 1) * a.shape[1] / w, a.shape[1])
    table = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    along = lambda t, x: t[np.floor(x).astype(int)] + (x - np.floor(x))[:, None] * (t[np.minimum(np.floor(x).astype(int) + 1, len(t) - 1)] - t[np.floor(x).astype(int)])
    s = along(along(table, rows).T, cols).T
    return np.diff(np.diff(s, axis=0), axis=1) / np.outer(np.diff(rows), np.diff(cols))


def fingerprint(g: np.ndarray) -> np.ndarray:
    """256 numbers of unit length: moments, 16 runs of pixels, 64-bin histogram, gradients; the rest 0."""
    x = resize(g, 128, 128) / 255
    run = x.reshape(16, -1)
    hist = np.bincount(np.minimum((x * 64).astype(int), 63).reshape(-1), minlength=64) / x.size
    dx, dy = np.abs(np.diff(x, axis=1)), np.abs(np.diff(x, axis=0))
    f = np.concatenate([[x.mean(), x.std(), np.median(x)], run.mean(1), run.std(1), hist, [dx.mean(), dx.std(), dy.mean(), dy.std()]])
    f = np.pad(f, (0, 256 - len(f)))
    n = np.linalg.norm(f)
    return f / n if n > 0 else f


def hashes(g: np.ndarray) -> str:
    """Average, difference and cosine-transform hash of 256 bits each, in hex, joined by colons."""
    bits = lambda b: np.packbits(b.reshape(-1)).tobytes().hex()
    small = resize(g, 16, 16)
    k = np.arange(64)
    dct = np.cos(np.pi * np.outer(np.arange(16), 2 * k + 1) / 128)
    low = dct @ resize(g, 64, 64) @ dct.T
    return ":".join([bits(small > small.mean()), bits(np.diff(resize(g, 16, 17), axis=1) > 0), bits(low > np.median(low))])


def copied_blocks(g: np.ndarray, block: int = 16, step: int = 8, least: float = 32.0) -> list[tuple[int, int, int, int]]:
    """(y, x, first y, first x) of blocks equal to an earlier one farther than ``least`` pixels away."""
    first: dict[str, tuple[int, int]] = {}
    out = []
    for y in range(0, g.shape[0] - block + 1, step):
        for x in range(0, g.shape[1] - block + 1, step):
            h = hashlib.md5(g[y : y + block, x : x + block].astype(np.uint8).tobytes()).hexdigest()
            fy, fx = first.setdefault(h, (y, x))
            if (y - fy) ** 2 + (x - fx) ** 2 > least**2:
                out.append((y, x, fy, fx))
    return out


def compression_error(g: np.ndarray, step: float = 10.0) -> tuple[float, float]:
    """(score, share of marked pixels) after quantising 8x8 cosine transforms; an approximation of a re-encoding."""
    h, w = (s // 8 * 8 for s in g.shape)
    k = np.arange(8)
    c = np.cos(np.pi * np.outer(k, 2 * k + 1) / 16) * np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None]
    b = g[:h, :w].reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    back = c.T @ (np.round(c @ b @ c.T / step) * step) @ c
    d = np.abs(back - b)
    mask = d > d.mean() + 2 * d.std()
    share = float(mask.mean()) if mask.size else 0.0
    return (min(100.0, share * 500 + float(d.max() if d.size else 0) / 255 * 30), share)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity with an 11x11 Gaussian window."""
    x = np.arange(11) - 5
    w = np.exp(-(x**2) / (2 * 1.5**2))
    w /= w.sum()

    def blur(v: np.ndarray) -> np.ndarray:
        v = np.pad(v, 5, mode="reflect")
        v = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 1, v)
        return np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 0, v)

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def clusters(mask: DataFrame, cell: int = 64, least: float = 0.05, k: int = 20) -> DataFrame:
    """Cells of ``mask`` (image_id, y, x, hit) whose share of hits exceeds ``least``: the first k of each image in raster order."""
    from pyspark.sql import Window

    g = mask.groupBy("image_id", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx")).agg(F.avg(F.col("hit").cast("int")).alias("ratio"))
    return g.where(F.col("ratio") > least).withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("cy", "cx"))).where(F.col("rank") <= k)


def font_consistency(chars: DataFrame, least: int = 5) -> DataFrame:
    """Per image of ``chars`` (image_id, height): characters, the range of usual heights, outliers, score and suspicion.

    Usual is within 1.5 quartile ranges (at least 1) of the quartiles; fewer than ``least`` characters tell nothing.
    Heights are counted first, so that the quartiles come from one row a height.
    """
    by = chars.where("height IS NOT NULL").groupBy("image_id", "height").agg(F.count("*").alias("n"))
    edge = quartiles(by, "image_id", "height").withColumnRenamed("n", "characters")
    reach = 1.5 * F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0))
    edge = edge.withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})
    odd = by.join(edge, "image_id").groupBy("image_id").agg(F.sum(F.when((F.col("height") < F.col("lower")) | (F.col("height") > F.col("upper")), F.col("n")).otherwise(0)).alias("outliers"))
    score = F.when(F.col("characters") >= least, F.least(F.lit(100.0), F.round(300 * F.col("outliers") / F.col("characters"), 2))).otherwise(0.0)
    return edge.join(odd, "image_id").select("image_id", "characters", "lower", "upper", "outliers", score.alias("score"), (score > 35).alias("suspicious"))


def font_score(heights: Column, least: int = 5) -> Column:
    """The score of ``font_consistency`` of one image's heights, an array without nulls, where an image has few."""
    sorted_, n = F.sort_array(heights), F.size(heights)

    def quartile(q: float) -> Column:
        place = q * (n - 1)
        lo = F.floor(place).cast("int")
        below, above = F.get(sorted_, lo), F.get(sorted_, F.least(lo + 1, n - 1))
        return below + (above - below) * (place - lo)

    edges = F.transform(F.array(F.struct(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))), lambda e: F.struct(e["q1"], e["q3"], (1.5 * F.greatest(e["q3"] - e["q1"], F.lit(1.0))).alias("reach")))
    outliers = F.aggregate(edges, F.lit(0), lambda _, e: F.size(F.filter(sorted_, lambda x: (x < e["q1"] - e["reach"]) | (x > e["q3"] + e["reach"]))))
    return F.when(n >= least, F.least(F.lit(100.0), F.round(300 * outliers / n, 2))).otherwise(0.0)


def template_score(page: np.ndarray, template: np.ndarray) -> tuple[float, bool]:
    """(0 to 100, match): likeness of a page's upper quarter to a vendor's template, both as 150 by 400 pixels."""
    head = page[: max(1, int(page.shape[0] * 0.25))]
    score = max(0.0, min(100.0, 100 * similarity(resize(head, 150, 400), resize(template, 150, 400))))
    return round(score, 2), score >= 70


def heat(marks: DataFrame) -> DataFrame:
    """(image_id, cy, cx, heat): the strongest mark of each cell.

    ``marks`` is (image_id, cy, cx, kind, ratio): error regions weigh 3 * ratio up to 1, fonts 0.7, copied blocks 0.85.
    """
    strength = F.when(F.col("kind") == "ela", F.least(F.lit(1.0), 3 * F.col("ratio"))).when(F.col("kind") == "font", 0.7).when(F.col("kind") == "copy", 0.85)
    return marks.groupBy("image_id", "cy", "cx").agg(F.max(strength).alias("heat")).where("heat IS NOT NULL")


def analyse(images: DataFrame) -> DataFrame:
    """origin, fingerprint, phash, copied, copy_paste score, ela score of Spark ``image`` rows; undecodable rows are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for origin, h, w, n, data in zip(f.origin, f.height, f.width, f.nChannels, f.data, strict=True):
                if h <= 0:
                    rows.append((origin, None, None, None, None, None))
                    continue
                g = gray(h, w, n, data)
                fit = min(1.0, 512 / max(g.shape))
                found = copied_blocks(resize(g, max(1, int(g.shape[0] * fit)), max(1, int(g.shape[1] * fit))) if fit < 1 else g)
                rows.append((origin, fingerprint(g).astype(float).tolist(), hashes(g), len(found), min(100.0, 5.0 * len(found)), compression_error(g)[0]))
            yield pd.DataFrame(rows, columns=["origin", "fingerprint", "phash", "copied", "copy_paste", "ela"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "origin string, fingerprint array<double>, phash string, copied int, copy_paste double, ela double")
