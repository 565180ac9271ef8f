"""Point ingest as a stream: arriving points are tiled, tile counts and boxes are kept current, late data is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolith.operators.tiling import cell_coordinates, cell_id, inside
from geolith.schema import Box


def tiled_stream(points: DataFrame, box: Box, side: int) -> DataFrame:
    """A stream of points with their grid cell; points outside the box go."""
    return points.where(inside(box)).withColumns(cell_coordinates(box, side)).withColumn("cell", cell_id(side, box.axes))


def running_counts(tiled: DataFrame) -> DataFrame:
    """Points and height range of each cell so far: an update stream whose state is one row for each cell."""
    return tiled.groupBy("cell").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


def windowed_counts(tiled: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Points by cell and window of time; a window is final once the watermark has passed it."""
    return tiled.withWatermark(time, late).groupBy(F.window(time, width), "cell").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "cell", "n")


def sweeps(points: DataFrame, time: str, gap: str, late: str, sweep: str = "sweep") -> DataFrame:
    """Sweeps as sessions: a sweep's points with no gap longer than `gap`."""
    return points.withWatermark(time, late).groupBy(F.session_window(time, gap), sweep).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), sweep, "n")


def write_tiles(tiled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append points to a table partitioned by cell; a restart goes on from the checkpoint without losing or repeating rows."""
    return tiled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("cell").outputMode("append").trigger(availableNow=True).start()
