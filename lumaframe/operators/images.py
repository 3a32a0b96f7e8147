"""Image rows and kernels: the boundary between Spark's image struct and NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaframe.errors import FormatError
from lumaframe.schema import BGR, BGRA, FORMATS, GRAY, IMAGE, format_of

Kernel = Callable[[np.ndarray], np.ndarray]
BY_MODE = {f.mode: f for f in (GRAY, BGR, BGRA, FORMATS["Float32"], FORMATS["Float32C3"], FORMATS["Flow"])}


def decode(row: dict) -> np.ndarray:
    """The pixels of an image struct."""
    fmt = format_of(row["fmt"]) if row.get("fmt") else BY_MODE.get(row["mode"])
    if fmt is None or row["height"] is None or row["height"] < 1:
        raise FormatError(f"not an image: mode {row['mode']}, height {row['height']}")
    a = np.frombuffer(bytes(row["data"]), fmt.element).reshape(row["height"], row["width"], fmt.channels)
    return a[..., 0] if fmt.channels == 1 else a


def encode(a: np.ndarray, origin: str | None = None, fmt: str | None = None) -> dict:
    a = np.ascontiguousarray(a)
    channels = 1 if a.ndim == 2 else a.shape[2]
    found = format_of(fmt) if fmt else next((f for f in BY_MODE.values() if f.channels == channels and f.integer == (a.dtype == np.uint8)), None)
    if found is None or found.channels != channels:
        raise FormatError(f"no format for {channels} channels of {a.dtype}")
    return {"origin": origin, "height": a.shape[0], "width": a.shape[1], "nChannels": channels, "mode": found.mode, "data": a.astype(found.element).tobytes(), "fmt": found.name}


def apply(df: DataFrame, *kernels: Kernel, column: str = "image", fmt: str | None = None, keep_errors: bool = True) -> DataFrame:
    """The kernels, fused into one UDF, on an image column. A row that fails has a null image and says why in ``error``."""
    result = T.StructType([T.StructField("image", IMAGE), T.StructField("error", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            images, errors = [], []
            for row in part.to_dict("records"):
                try:
                    a = decode(row)
                    for k in kernels:
                        a = k(a)
                    images.append(encode(a, row["origin"], fmt))
                    errors.append(None)
                except (ValueError, IndexError, np.linalg.LinAlgError) as e:
                    images.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"image": images, "error": errors})

    made = F.pandas_udf(run, result)
    out = df.withColumn("_out", made(F.col(column)))
    return out.withColumn(column, F.col("_out.image")).withColumn("error", F.col("_out.error")).drop("_out")


def measured(df: DataFrame, f: Callable[..., object], result: str, *columns: str) -> DataFrame:
    """``value``: what f gives for the images of the columns; null where it fails."""

    def run(parts: Iterator[tuple[pd.DataFrame, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            part = part if isinstance(part, tuple) else (part,)
            values = []
            for rows in zip(*[p.to_dict("records") for p in part], strict=True):
                try:
                    values.append(f(*map(decode, rows)))
                except (ValueError, IndexError, np.linalg.LinAlgError):
                    values.append(None)
            yield pd.Series(values, dtype=object)

    if len(columns) == 1:
        def single(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            yield from run(parts)

        return df.withColumn("value", F.pandas_udf(single, result)(F.col(columns[0])))

    def several(parts: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        yield from run(parts)

    return df.withColumn("value", F.pandas_udf(several, result)(*[F.col(c) for c in columns]))


def on_pixels(f: Kernel, pixels: Column, width: int, result: str = "array<double>") -> Column:
    """f on images held as arrays of gray pixels of the given width, as flat arrays again."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if v is None else np.asarray(f(np.asarray(v, np.uint8).reshape(-1, width))).ravel().tolist() for v in part], dtype=object)

    return F.pandas_udf(run, result)(pixels)


def to_pixels(df: DataFrame, column: str = "image") -> DataFrame:
    """img_id, y, x, c, v from rows (img_id, image): one row a value. For small images; kernels otherwise."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([decode(r).astype(float).ravel().tolist() for r in part.to_dict("records")], dtype=object)

    flat = df.select("img_id", F.col(f"{column}.width").alias("w"), F.col(f"{column}.nChannels").alias("n"), F.pandas_udf(run, "array<double>")(F.col(column)).alias("p"))
    flat = flat.select("img_id", "w", "n", F.posexplode("p").alias("i", "v"))
    return flat.select("img_id", F.floor(F.col("i") / (F.col("w") * F.col("n"))).cast("int").alias("y"), F.floor(F.col("i") / F.col("n") % F.col("w")).cast("int").alias("x"), (F.col("i") % F.col("n")).cast("int").alias("c"), "v")
