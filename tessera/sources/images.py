"""Images as a Spark source: statistics of each image, linked to rows by file name.

JPEG, PNG, BMP, GIF and TIFF files are decoded by Spark's own image source, inside the JVM; PGM and PPM, which it doesn't know, are read from their
bytes. What comes to Python is an Arrow batch of pixel buffers, what leaves it a row of numbers an image. An image that can't be decoded has null statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.running import exact_percentiles
from tessera.operators.submit import numbered

# fixed values: file endings, ends of the share of matching rows, names of image files
DECODED = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff")
PLAIN = ("pgm", "ppm")
LEAST_HINTED, LEAST_LINKED = 0.06, 0.10
PANEL_NAME, NUMBER_NAME = r"^[A-Z]{2,3}_[A-Za-z0-9]{6,12}\.\w+$", r"(?i)^img_\d+\.\w+$"


def _glob(endings: tuple[str, ...]) -> str:
    return "*.{" + ",".join([*endings, *(e.upper() for e in endings)]) + "}"


def decode_pnm(raw: bytes) -> np.ndarray:
    """A binary PGM or PPM of up to 255 levels."""
    m = re.match(rb"P([56])\s+(?:#.*\n)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not m or int(m[4]) > 255:
        raise ValueError("no binary PGM or PPM")
    n = 3 if m[1] == b"6" else 1
    return np.frombuffer(raw, np.uint8, int(m[2]) * int(m[3]) * n, m.end()).reshape(int(m[3]), int(m[2]), n)


STATISTICS = [
    *(f"img_{s}" for s in ("mean", "std", "p01", "median", "p99", "iqr")),
    *(f"img_{q}_{s}" for q in ("tl", "tr", "bl", "br") for s in ("mean", "std")),
    *(f"img_{s}" for s in ("center", "edge", "center_to_edge", "bright", "dark", "bright_x", "bright_y", "channel_range", "channel_variance")),
]


def _spread(counts: np.ndarray) -> float:
    """The deviation of positions, given how many lie at each."""
    n = counts.sum()
    at = np.arange(len(counts))
    mean = (counts * at).sum() / max(n, 1)
    return float(np.sqrt((counts * (at - mean) ** 2).sum() / n)) if n > 1 else 0.0


def statistics(image: np.ndarray, dark: float = 0.25, bright: float = 0.75) -> dict[str, float | None]:
    """Levels, quadrants, middle against rim, bright and dark shares and their spread; of colours also how channels differ.

    Every pixel has a label, twice its quadrant and whether it is in the middle half; counts, sums and sums of squares by label give all means.
    """
    planes = np.moveaxis(image[:, :, : 3 if image.shape[2] >= 3 else 1].astype(float) / 255, 2, 0)
    luma = (0.299, 0.587, 0.114) if len(planes) == 3 else (1.0,)
    level = np.tensordot(luma, planes, 1)
    h, w = level.shape
    y, x = np.ogrid[:h, :w]
    inner = [(p >= max(1, n // 4)) & (p < n - max(1, n // 4)) for p, n in ((y, h), (x, w))]
    label = (4 * (y >= h // 2) + 2 * (x >= w // 2) + (inner[0] & inner[1])).ravel()
    n, total, squares = (np.bincount(label, v, 8).reshape(4, 2) for v in (None, level.ravel(), level.ravel() ** 2))
    ratio = lambda a, b: float(a / b) if b else 0.0
    found: dict[str, float | None] = dict.fromkeys(STATISTICS)
    for i, q in enumerate(("tl", "tr", "bl", "br")):
        mean = ratio(total[i].sum(), n[i].sum())
        found[f"img_{q}_mean"], found[f"img_{q}_std"] = mean, max(0.0, ratio(squares[i].sum(), n[i].sum()) - mean**2) ** 0.5
    found["img_center"], found["img_edge"] = ratio(total[:, 1].sum(), n[:, 1].sum()), ratio(total[:, 0].sum(), n[:, 0].sum())
    found["img_center_to_edge"] = found["img_center"] / (found["img_edge"] + 1e-9)
    found["img_mean"] = ratio(total.sum(), h * w)
    found["img_std"] = max(0.0, ratio(squares.sum(), h * w) - found["img_mean"] ** 2) ** 0.5
    quarters = dict(zip(("p01", "p25", "median", "p75", "p99"), np.quantile(level, (0.01, 0.25, 0.5, 0.75, 0.99)).tolist(), strict=True))
    found |= {f"img_{k}": quarters[k] for k in ("p01", "median", "p99")} | {"img_iqr": quarters["p75"] - quarters["p25"]}
    lit = level > bright
    found |= {"img_bright": float(lit.mean()), "img_dark": float((level < dark).mean()), "img_bright_x": _spread(lit.sum(0)), "img_bright_y": _spread(lit.sum(1))}
    if len(planes) == 3:
        means = planes.mean((1, 2))
        found |= {"img_channel_range": float(means.max() - means.min()), "img_channel_variance": float(((planes - planes.mean(0)) ** 2).mean())}
    return found


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, name of every image below root. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(DECODED + PLAIN)).load(root)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def image_folders(spark: SparkSession, root: str, least: int = 10) -> DataFrame:
    """folder, n, role (train, val or flat, by the parts of its path below root) and pattern (panel, number or generic, by half of its names) of folders with at least ``least`` images, the fullest first."""
    f = image_files(spark, root)
    below = F.split(F.regexp_replace("folder", r"^.*" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]), ""), "/")
    role = F.when(F.array_contains(below, "train"), "train").when(F.array_contains(below, "val"), "val").otherwise("flat")
    share = lambda pattern: F.avg(F.col("name").rlike(pattern).cast("int")) >= 0.5
    pattern = F.when(share(PANEL_NAME), "panel").when(share(NUMBER_NAME), "number").otherwise("generic")
    out = f.groupBy("folder", role.alias("role")).agg(F.count("*").alias("n"), pattern.alias("pattern"))
    return out.where(F.col("n") >= least).select("folder", "n", "role", "pattern").orderBy(F.desc("n"), "folder")


def _pixels(raw, height: int, width: int, channels: int) -> np.ndarray:
    """Rows, columns and channels, red first, of a buffer of the image source; a file's own bytes have no height."""
    if height == 0:
        return decode_pnm(bytes(raw))
    image = np.frombuffer(raw, np.uint8).reshape(height, width, channels)
    return image[:, :, 2::-1] if channels >= 3 else image


def image_features(spark: SparkSession, root: str, dark: float = 0.25, bright: float = 0.75) -> DataFrame:
    """stem and the statistics of each image below root; ``dark`` and ``bright`` as brightness_levels() gives them."""
    below = lambda kind, endings: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", _glob(endings))
    shown = below("image", DECODED).option("dropInvalid", False).load(root).select("image.*")
    plain = below("binaryFile", PLAIN).load(root)
    none = F.lit(0)
    files = shown.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("content"))
    files = files.unionByName(plain.select("path", none.alias("height"), none.alias("width"), none.alias("channels"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw, *size in zip(b["content"], b["height"], b["width"], b["channels"], strict=True):
                try:
                    rows.append(statistics(_pixels(raw, *size), dark, bright))
                except (ValueError, IndexError):
                    rows.append(dict.fromkeys(STATISTICS))
            yield pd.concat([b[["stem"]].reset_index(drop=True), pd.DataFrame(rows, columns=STATISTICS)], axis=1)

    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("stem")
    return files.select(stem, "height", "width", "channels", "content").mapInPandas(run, "stem string, " + ", ".join(f"{c} double" for c in STATISTICS))


def brightness_levels(features: DataFrame) -> tuple[float, float]:
    """(dark, bright): the quarters of the training images' mean levels, over all of them."""
    r = exact_percentiles(features, "img_mean", {"dark": 0.25, "bright": 0.75}).first()
    return (0.25, 0.75) if r["dark"] is None else (r["dark"], r["bright"])


def _stem(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"^.*[/\\\\]", ""), r"\.\w+$", "")


def link_forms(df: DataFrame, hint: str | None = None, panel: list[str] | None = None, index: str | None = None) -> list[tuple[str, Column]]:
    """The ways in which a row may name its image, most telling first: (form, stem). A hinted column, each text column, pairs of the panel's columns, the row's number."""
    forms = [(f"hint:{hint}", _stem(hint))] if hint in df.columns else []
    forms += [(f"column:{f.name}", _stem(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != hint]
    forms += [(f"pair:{a}+{b}", F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string"))) for a, b in combinations([c for c in panel or [] if c in df.columns], 2)]
    return forms + ([(f"index:{index}", F.concat(F.lit("img_"), F.lpad(F.col(index).cast("string"), 4, "0")))] if index else [])


def link_shares(df: DataFrame, stems: DataFrame, forms: list[tuple[str, Column]]) -> DataFrame:
    """place, form, share: how many of all rows name an image in each form. Keys are counted before they are joined, so one that many rows share is joined once."""
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("form"), key.alias("stem")) for i, (name, key) in enumerate(forms)))
    keys = df.select(F.inline(cells)).groupBy("place", "form", "stem").agg(F.count("*").alias("n"))
    hit = keys.join(stems.select("stem").distinct().withColumn("_hit", F.lit(1)), "stem", "left")
    return hit.groupBy("place", "form").agg((F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def choose_link(df: DataFrame, stems: DataFrame, forms: list[tuple[str, Column]]) -> str | None:
    """The first form by which enough rows name an image: 6 % for a hint, 10 % for others."""
    if not forms:
        return None
    least = F.when(F.col("form").startswith("hint:"), LEAST_HINTED).otherwise(LEAST_LINKED)
    found = link_shares(df, stems, forms).where(F.col("share") >= least).orderBy("place").first()
    return found["form"] if found else None


def link_images(df: DataFrame, images: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of rows with the image whose stem is their columns' values, joined by underscores."""
    return _linked(df, images, F.concat_ws("_", *(F.col(c).cast("string") for c in columns)))


def _linked(df: DataFrame, images: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_stem", key).join(images.withColumnRenamed("stem", "_stem"), "_stem", "left").drop("_stem")


def with_images(df: DataFrame, images: DataFrame, hint: str | None = None, panel: list[str] | None = None, order: list[str] | None = None) -> tuple[DataFrame, str | None]:
    """(rows with their image's statistics, the form by which they are linked); rows as they are and None where no form links enough. ``order``: keys by which rows are numbered for img_0000, img_0001 ..."""
    rows = numbered(df, order).withColumnRenamed("row_id", "_row") if order else df
    forms = link_forms(rows, hint, panel, "_row" if order else None)
    form = choose_link(rows, images, forms)
    if form is None:
        return df, None
    return _linked(rows, images, dict(forms)[form]).drop("_row"), form
