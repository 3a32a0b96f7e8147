"""Trackers over streams: one tracker per source in Spark's state store."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumaframe.operators.tracking import OUT, rows_of, tracker_of


class Tracking(StatefulProcessor):
    """Updates a source's tracker with each frame, in order of frame number within a micro-batch.

    The state holds the tracker and the last frame; a frame that is not after it is an error, as no rule says what late
    frames mean.
    """

    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", "last long, tracker binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, tracker = -1, tracker_of(self.kind, self.options)
        if self.state.exists():
            last, held = self.state.get()
            tracker = pickle.loads(held)
        out = []
        for frame, part in pd.concat(list(rows)).sort_values(["frame", "k"]).groupby("frame"):
            if frame <= last:
                raise ValueError(f"frame {frame} of source {key[0]} comes after frame {last}")
            part, last = part[part.x.notna()], int(frame)
            out += rows_of(key[0], frame, tracker.update(part[["x", "y", "w", "h"]].to_numpy(float), part.confidence.to_numpy(float)))
        self.state.update((last, pickle.dumps(tracker)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, kind: str, **options) -> DataFrame:
    """The tracks of a stream of detections; the query needs the RocksDB state store provider."""
    tracker_of(kind, options)
    return detections.groupBy("source_id").transformWithStateInPandas(Tracking(kind, options), OUT, "append", "none")


def frames(spark, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Frames or detections arriving as Parquet files in a folder, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
