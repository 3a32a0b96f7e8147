"""Formats of images and the row types of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from lumaframe.errors import FormatError


@dataclass(frozen=True)
class Format:
    """A pixel format: its channels, the code in Spark's image rows, and the element type."""

    name: str
    channels: int
    mode: int
    element: str

    @property
    def integer(self) -> bool:
        return self.element == "u1"


GRAY, BGR, BGRA = Format("Gray", 1, 0, "u1"), Format("BGR", 3, 16, "u1"), Format("BGRA", 4, 24, "u1")
FLOAT32, FLOAT32C3, FLOW = Format("Float32", 1, 5, "<f4"), Format("Float32C3", 3, 21, "<f4"), Format("Flow", 2, 13, "<f4")
HSV, LAB, YCRCB = Format("HSV", 3, 16, "u1"), Format("LAB", 3, 16, "u1"), Format("YCrCb", 3, 16, "u1")
FORMATS = {f.name: f for f in (GRAY, BGR, BGRA, FLOAT32, FLOAT32C3, FLOW, HSV, LAB, YCRCB)}

#: The legal conversions between formats.
CONVERSIONS = frozenset(
    [("BGR", "Gray"), ("Gray", "BGR"), ("BGR", "BGRA"), ("BGRA", "BGR"), ("Gray", "Float32"), ("Float32", "Gray"), ("BGR", "Float32C3"), ("Float32C3", "BGR")]
    + [("BGR", "HSV"), ("HSV", "BGR"), ("BGR", "LAB"), ("LAB", "BGR"), ("BGR", "YCrCb"), ("YCrCb", "BGR")]
)


def format_of(name: str) -> Format:
    if name not in FORMATS:
        raise FormatError(f"no format {name}")
    return FORMATS[name]


def check_conversion(source: str, target: str) -> None:
    format_of(source), format_of(target)
    if source != target and (source, target) not in CONVERSIONS:
        raise FormatError(f"no conversion from {source} to {target}")


IMAGE = T.StructType([T.StructField(n, t) for n, t in [("origin", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("nChannels", T.IntegerType()), ("mode", T.IntegerType()), ("data", T.BinaryType()), ("fmt", T.StringType())]])
BBOX = T.StructType([T.StructField(n, t) for n, t in [("x", T.FloatType()), ("y", T.FloatType()), ("w", T.FloatType()), ("h", T.FloatType()), ("class_id", T.IntegerType()), ("label", T.StringType())]])
DETECTION = T.StructType([*BBOX.fields[:4], T.StructField("class_id", T.IntegerType()), T.StructField("confidence", T.FloatType()), T.StructField("label", T.StringType())])
KEYPOINT = T.StructType([T.StructField(n, T.FloatType()) for n in ("x", "y", "size", "angle", "response")] + [T.StructField("octave", T.IntegerType()), T.StructField("class_id", T.IntegerType())])
TRACK = "source_id string, frame long, track_id int, x double, y double, w double, h double, confidence double, age int, is_confirmed boolean"
ANNOTATED = T.StructType([T.StructField("image", IMAGE), T.StructField("boxes", T.ArrayType(BBOX))])
SEGMENTED = T.StructType([T.StructField("image", IMAGE), T.StructField("class_mask", IMAGE), T.StructField("instance_mask", IMAGE)])
FRAME = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("rgb", IMAGE), T.StructField("depth", IMAGE)])
