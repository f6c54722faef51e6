"""Image steps on numpy arrays, the named chains of steps, and metrics that need contours.

Arrays are grey (h x w) or blue-green-red (h x w x 3), of bytes. Point-wise steps also exist on pixel
relations (pixels.py); tests hold the two against each other. Bicubic scaling uses Keys' kernel with -0.75,
denoising non-local means; both follow the published algorithms and are not bit-exact to any library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recommend import reasons, recommended
from ..functions.scoring import document_type, image_quality, is_inverted

Image = np.ndarray


def saturated(a: Image) -> Image:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def gray(a: Image) -> Image:
    return a if a.ndim == 2 else saturated(a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299)


def invert(a: Image) -> Image:
    return 255 - a


def contrast(a: Image, alpha: float = 1.2, beta: float = 10.0) -> Image:
    return saturated(np.abs(alpha * a.astype(float) + beta))


def keys(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def along(a: np.ndarray, n: int) -> np.ndarray:
    """The first axis resampled to n."""
    at = (np.arange(n) + 0.5) * len(a) / n - 0.5
    first = np.floor(at).astype(int)
    out = 0.0
    for k in range(-1, 3):
        weight = keys(at - (first + k)).reshape(-1, *[1] * (a.ndim - 1))
        out = out + weight * a[np.clip(first + k, 0, len(a) - 1)]
    return out


def scale(a: Image, factor: float = 2.5) -> Image:
    h, w = int(a.shape[0] * factor), int(a.shape[1] * factor)
    return saturated(np.swapaxes(along(np.swapaxes(along(a.astype(float), h), 0, 1), w), 0, 1))


#: Pixels that denoise() works on at once.
STRIP = 1 << 20


def denoise(a: Image, strength: float = 10.0, patch: int = 3, reach: int = 10) -> Image:
    """Non-local means: each pixel is the mean of those around it, weighed by how alike their patches are. In strips of rows."""
    g = gray(a)
    edge = reach + patch
    wide = np.pad(g, edge, mode="reflect" if min(g.shape) > edge else "edge").astype(np.float32)
    step = max(1, STRIP // max(1, g.shape[1]))
    out = [means(wide[i : i + step + 2 * edge], strength, patch, reach) for i in range(0, g.shape[0], step)]
    return saturated(np.concatenate(out)) if out else g


def means(wide: np.ndarray, strength: float, patch: int, reach: int) -> np.ndarray:
    """The means of the pixels that are reach + patch from all edges."""
    h, w = (n - 2 * (reach + patch) for n in wide.shape)
    core = wide[reach : reach + h + 2 * patch, reach : reach + w + 2 * patch]
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    side = 2 * patch + 1
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = wide[reach + dy : reach + dy + h + 2 * patch, reach + dx : reach + dx + w + 2 * patch]
            sums = np.pad(((core - other) ** 2).cumsum(0, dtype=float).cumsum(1), ((1, 0), (1, 0)))
            distance = (sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]) / side**2
            weight = np.exp(-np.maximum(distance, 0) / strength**2)
            total += weight * other[patch : patch + h, patch : patch + w]
            weights += weight
    return total / weights


def border(a: Image, width: int = 50) -> Image:
    return np.pad(a, ((width, width), (width, width), *([(0, 0)] if a.ndim == 3 else [])), constant_values=255)


def binarize(a: Image, threshold: int = 127) -> Image:
    return np.where(gray(a) > threshold, 255, 0).astype(np.uint8)


def otsu_threshold(a: Image) -> int:
    n = np.bincount(gray(a).ravel(), minlength=256).astype(float)
    low, low_sum = n.cumsum(), (n * np.arange(256)).cumsum()
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (low_sum / low - (low_sum[-1] - low_sum) / high) ** 2
    return int(np.argmax(np.round(np.nan_to_num(between), 3)))


def auto_threshold(a: Image) -> Image:
    return binarize(a, otsu_threshold(a))


def center(a: Image) -> Image:
    h, w = a.shape[:2]
    return a[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4]


STEPS: dict[str, Callable[..., Image]] = {
    "direct": lambda a: a,
    "gray": gray,
    "invert": invert,
    "scale": scale,
    "contrast": contrast,
    "denoise": denoise,
    "threshold": auto_threshold,
    "binarize": binarize,
    "border": border,
}


def register(name: str, step: Callable[..., Image]) -> None:
    """Makes a further step known."""
    STEPS[name] = step


# The named chains of steps with their parameters.
PIPELINES: dict[str, list[tuple]] = {
    "direct": [("direct",)],
    "minimal": [("invert",), ("scale", 2.5)],
    "light": [("scale", 2.0), ("gray",), ("border", 50)],
    "standard": [("gray",), ("scale", 2.5), ("contrast", 1.2, 10), ("border", 30)],
    "enhanced": [("gray",), ("scale", 3.0), ("contrast", 1.3, 15), ("denoise", 10), ("threshold",), ("border", 40)],
    "fraktur_traditional": [("gray",), ("invert",), ("scale", 3.0), ("contrast", 1.3, 20), ("border", 50)],
    "fraktur_enhanced": [("gray",), ("invert",), ("scale", 2.5), ("denoise", 10), ("contrast", 1.2, 15), ("border", 40)],
    "modern_german": [("gray",), ("scale", 2.0), ("contrast", 1.2, 10), ("border", 30)],
    "german_italic": [("gray",), ("scale", 2.5), ("contrast", 1.3, 15), ("border", 40)],
    "official_document": [("gray",), ("scale", 2.0), ("contrast", 1.1, 5), ("border", 25)],
    "mixed_period": [("gray",), ("scale", 2.2), ("contrast", 1.15, 8), ("threshold",), ("border", 35)],
    "newspaper": [("gray",), ("scale", 2.0), ("contrast", 1.1, 5), ("binarize", 127), ("border", 30)],
    "high_quality": [("gray",), ("scale", 1.5), ("contrast", 1.1, 5), ("border", 20)],
}


def step_name(step: tuple) -> str:
    """A step with its parameters, for display."""
    return f"{step[0]}({', '.join(map(str, step[1:]))})" if len(step) > 1 else step[0]


def run_pipeline(a: Image, name: str, each: Callable[[int, str, Image], None] | None = None) -> Image:
    """The image after all steps; each() is called with the number, name and result of every step."""
    if name not in PIPELINES:
        raise ValueError(f"Unknown approach: {name}")
    out = a.copy()
    for i, (step, *parameters) in enumerate(PIPELINES[name], 1):
        out = STEPS[step](out, *parameters)
        if each:
            each(i, step, out)
    return out


def labelled(on: np.ndarray, diagonal: bool) -> np.ndarray:
    """The number of each pixel's connected region, from 1 on; 0 where `on` is false. Runs of a row are joined to those above."""
    h, w = on.shape
    edges = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    first = np.searchsorted(row, np.arange(h + 1))
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    starts, ends, more = start.tolist(), end.tolist(), int(diagonal)
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        above, below = j, int(first[y + 1])
        while i < above and j < below:
            if starts[i] < ends[j] + more and starts[j] < ends[i] + more:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(up))], int)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(h * w + 1, np.int64)
    np.add.at(out, row * w + start, names)
    np.add.at(out, row * w + end, -names)
    return out[:-1].cumsum().reshape(h, w)


def shapes(binary: Image) -> tuple[np.ndarray, np.ndarray]:
    """Areas within the outer outlines, and heights, of the 8-connected regions that no other region encloses.

    An outline runs through the centres of its pixels, so every square of four centres within it adds 1, and every
    triangle of three 1/2.
    """
    on = np.pad(binary > 0, 1)
    back = labelled(~on, diagonal=False)
    filled = back != back[0, 0]
    names = labelled(filled, diagonal=True)
    n = int(names.max())
    corners = [filled[:-1, :-1], filled[:-1, 1:], filled[1:, :-1], filled[1:, 1:]]
    held = sum(c.astype(int) for c in corners)
    whose = np.maximum(np.maximum(names[:-1, :-1], names[:-1, 1:]), np.maximum(names[1:, :-1], names[1:, 1:]))
    areas = np.bincount(whose[held > 2], np.where(held[held > 2] == 4, 1.0, 0.5), n + 1)[1:]
    y, x = np.nonzero(names)
    top, bottom = np.full(n + 1, names.shape[0]), np.zeros(n + 1, int)
    np.minimum.at(top, names[y, x], y)
    np.maximum.at(bottom, names[y, x], y)
    return areas, (bottom - top + 1)[1:]


def text_shape(a: Image) -> tuple[float, str]:
    """Share of the image within outlines, at most 1, and the text's size by the mean height of those over 50 pixels."""
    g = gray(a)
    if not g.size:
        return 0.0, "medium"
    areas, heights = shapes(auto_threshold(g))
    own = heights[areas > 50]
    mean = float(own.mean()) if len(own) else 30.0
    return min(float(areas.sum()) / g.size, 1.0), "small" if mean < 20 else "large" if mean > 40 else "medium"


def noise_level(a: Image) -> float:
    g = gray(a).astype(float)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return min(float(laplacian.var()) / 1000, 1.0)


def decoded(image) -> Image | None:
    """The array behind a row of Spark's image source; None if it could not be read. One channel becomes three."""
    if pd.isna(image["height"]) or image["height"] < 0:
        return None
    h, w, c = (int(image[n]) for n in ("height", "width", "nChannels"))  # beside a missing image pandas makes them floats
    a = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)
    return np.repeat(a, 3, 2) if c == 1 else a[..., :3]


MEASURED = "brightness double, contrast double, noise_level double, text_density double, estimated_text_size string, width int, height int, color_mode string, error string"
#: Bytes of an Arrow batch of images; pages go on one by one.
BATCH_BYTES = 64 << 20


def few_images(pages: DataFrame) -> None:
    """Bounds the session's Arrow batches to BATCH_BYTES, if they are not bounded more closely."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = pages.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, None) or "0")
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


METRICS = f"doc_id string, page_num int, {MEASURED}"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def measured(a: Image | None, doc_id: str) -> tuple:
    """A page's MEASURED values."""
    if a is None:
        return (None,) * 8 + (f"Cannot load image: {doc_id}",)
    g = gray(a)
    return (float(g.mean()), float(g.std()), noise_level(g), *text_shape(g), g.shape[1], g.shape[0], "color", None)


def metrics(pages: DataFrame) -> DataFrame:
    """Metrics of each page's image. pages: doc_id, page_num, image (as Spark's image source gives it)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame([(r.doc_id, r.page_num, *measured(decoded(r.image), r.doc_id))], columns=names_of(METRICS))

    few_images(pages)
    return pages.select("doc_id", "page_num", "image").mapInPandas(run, METRICS)


def analysis(measured: DataFrame, sample: str | None = None) -> DataFrame:
    """Adds quality, type, recommendations and reasons to metrics. sample: the column with the text of the page's centre."""
    kind = document_type(F.col(sample) if sample else F.lit(""))
    out = measured.withColumns(
        {
            "image_quality": image_quality(F.col("contrast"), F.col("width").cast("long") * F.col("height")),
            "has_inverted_text": is_inverted(F.col("brightness")),
            "_type": kind,
        }
    )
    out = out.withColumns({"document_type": F.col("_type.type"), "confidence": F.col("_type.confidence")}).drop("_type")
    given = [F.col(c) for c in ("document_type", "image_quality", "has_inverted_text", "contrast", "noise_level")]
    return out.withColumns({"recommended": recommended(*given), "reasoning": reasons(*given)})


def processed(pages: DataFrame, approach: str, steps: bool = False) -> DataFrame:
    """doc_id, page_num, approach, step, name, height, width, data: images after a chain, or after each of its steps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "page_num", "approach", "step", "name", "height", "width", "channels", "data"]
        yield pd.DataFrame([], columns=columns)
        for frame in frames:
            for r in frame.itertuples(index=False):
                if (a := decoded(r.image)) is None:
                    continue
                mine: list[tuple] = []
                run_pipeline(a, approach, lambda i, name, x, r=r, mine=mine: mine.append((r.doc_id, r.page_num, approach, i, name, x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], x.tobytes())))
                yield pd.DataFrame(mine if steps else mine[-1:], columns=columns)

    few_images(pages)
    schema = "doc_id string, page_num int, approach string, step int, name string, height int, width int, channels int, data binary"
    return pages.select("doc_id", "page_num", "image").mapInPandas(run, schema)
