"""Frames from cameras and videos: contracts, a source over extracted frames, and what a device would need."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lumaframe.errors import require
from lumaframe.schema import FRAME


class CameraUnavailable(RuntimeError):
    """No device, or none that this build can open."""


def frame_folder(spark: SparkSession, path: str) -> DataFrame:
    """source_id, frame, rgb: a folder for each source with its extracted frames, numbered by their sorted names."""
    from pyspark.sql import Window

    from lumaframe.sources.folders import from_dir

    df = from_dir(spark, f"{path}/*").withColumn("source_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return df.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("path")) - 1).cast("long").alias("frame"), F.col("image").alias("rgb"))


class FrameSource(DataSource):
    """Frames of a Python callable: ``spark.read.format("frames")``; ``open`` (module:function) and ``sources`` are options.

    The callable gets a source id and yields dictionaries of the frame's columns but source_id and frame. Each source is a
    partition; a lost one is read again from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self):
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FrameStream(self.options)


def opened(spec: str) -> Callable[[str], Iterator[dict[str, Any]]]:
    import importlib

    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def rows_of(source: str, start: int, frames: Iterator[dict[str, Any]]) -> Iterator[tuple]:
    for k, f in enumerate(frames, start):
        yield source, k, f.get("ts"), f.get("rgb"), f.get("depth")


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        require("open" in options and "sources" in options, "the options open and sources are needed")
        self.spec, self.sources = options["open"], options["sources"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.sources]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from rows_of(partition.value, 0, opened(self.spec)(partition.value))


class FrameStream(SimpleDataSourceStreamReader):
    """Offsets count the frames read of each source; at most ``batch`` frames a source and trigger, none twice, and an end is an end."""

    def __init__(self, options: dict[str, str]):
        self.spec, self.sources, self.batch = options["open"], options["sources"].split(","), int(options.get("batch", "10"))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.sources, 0)

    def between(self, start: dict, end: dict) -> Iterator[tuple]:
        from itertools import islice

        for s in self.sources:
            yield from rows_of(s, start[s], islice(opened(self.spec)(s), start[s], end[s]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self.between(start, {s: start[s] + self.batch for s in self.sources}))
        end = {s: start[s] + sum(r[0] == s for r in rows) for s in self.sources}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.between(start, end)

    def commit(self, end: dict) -> None:
        pass


def device(kind: str, address: str | int):
    """Webcams, network cameras, depth cameras and video files need drivers or codecs that are not installed."""
    require(kind in ("webcam", "ip", "oak_d", "video"), "kind must be webcam, ip, oak_d or video")
    raise CameraUnavailable(f"{kind} {address}: register a callable that yields frames as the source instead")


def depth_in_metres(raw: DataFrame, column: str = "mm") -> DataFrame:
    return raw.withColumn("m", F.col(column) / 1000.0)


def frame_pipeline(frames: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs process on every micro-batch, in order of source and frame; Spark's checkpoint replaces a result queue."""
    ordered = lambda df, epoch: process(df.orderBy("source_id", "frame"), epoch)
    writer = frames.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
