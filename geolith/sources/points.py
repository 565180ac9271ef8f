"""Other point sources: xyz text, uncompressed LAS, graphs as text, base64 records, and generators."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.schema import Box
from geolith.sources.ply import read_ply


def read_points(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Points of a folder by kind: ply, xyz, las, parquet."""
    readers = {"ply": read_ply, "xyz": read_xyz, "las": read_las, "parquet": lambda s, p: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError(f"unknown kind of points {kind!r}; known are {', '.join(readers)}")
    return readers[kind](spark, path)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of text files with numbers between blanks, commas or semicolons; other lines are passed over."""
    f = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).withColumn("f", f)
    return rows.select(*[F.expr(f"try_cast(get(f, {k}) AS double)").alias(a) for k, a in enumerate("xyz")]).where("x is not null and y is not null and z is not null")


def write_xyz(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", "x", "y", "z")).write.mode("overwrite").text(path)


def _las(data: bytes) -> pd.DataFrame:
    """Points of a LAS 1.0 to 1.4 file, formats 0 to 10, not compressed."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, begin = data[25], struct.unpack_from("<I", data, 96)[0]
    form, size, count = data[104], *struct.unpack_from("<HI", data, 105)
    if form & 0x80:
        raise ValueError("compressed LAS (LAZ) can't be read here; decompress it first")
    if minor >= 4 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, offset = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    raw = np.frombuffer(data, np.uint8, count * size, begin).reshape(count, size)
    at = lambda k, t: np.ascontiguousarray(raw[:, k : k + np.dtype(t).itemsize]).view(t)[:, 0]
    xyz = {a: at(4 * k, "<i4") * scale[k] + offset[k] for k, a in enumerate("xyz")}
    angle = at(18, "<i2") * 0.006 if form >= 6 else at(16, "i1").astype(float)
    source = at(20, "<u2") if form >= 6 else at(18, "<u2")
    return pd.DataFrame(xyz | {"intensity": at(12, "<u2").astype(np.int32), "scan_angle": angle.astype(float), "point_source_id": source.astype(np.int32)})


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, intensity, scan_angle (degrees), point_source_id, file. LAZ is refused: there is no codec here."""

    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                yield _las(bytes(data)).assign(file=file)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.la[sz]").load(path)
    return files.select("path", "content").repartition("path").mapInPandas(run, "x double, y double, z double, intensity int, scan_angle double, point_source_id int, file string")


def file_boxes(points: DataFrame) -> DataFrame:
    """Count and box of each file."""
    return points.groupBy("file").agg(F.count("*").alias("n"), *[f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def read_base64(spark: SparkSession, path: str) -> DataFrame:
    """One record for each line: (content binary)."""
    return spark.read.text(path).select(F.unbase64("value").alias("content"))


def read_pairwise_graph(spark: SparkSession, vertices: str, edges: str, states: int) -> tuple[DataFrame, DataFrame]:
    """Text graphs: lines 'id p0 p1 ...', and 'src dst f00 f10 ...' with the source's state running fastest."""
    v = spark.read.text(vertices).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("w"))
    v = v.select(F.col("w")[0].cast("long").alias("id"), *[F.col("w")[1 + s].cast("double").alias(f"p{s}") for s in range(states)])
    e = spark.read.text(edges).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("w"))
    weights = [F.col("w")[2 + j * states + i].cast("double").alias(f"f{i}{j}") for j in range(states) for i in range(states)]
    return v, e.select(F.col("w")[0].cast("long").alias("src"), F.col("w")[1].cast("long").alias("dst"), *weights)


def uniform_points(spark: SparkSession, n: int, box: Box, seed: int = 0, partitions: int = 8) -> DataFrame:
    """n points spread evenly over the box: pid, x, y, z."""
    axes = [(F.lit(lo) + F.rand(seed + k) * (hi - lo)).alias(a) for k, (a, lo, hi) in enumerate(zip(box.axes, box.low, box.high))]
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("pid"), *axes)


def clustered_points(spark: SparkSession, n: int, box: Box, per_tile: int = 10_000, seed: int = 0) -> DataFrame:
    """About n points in random normal clusters within the box: kernel, pid, x, y, z; the same for the same seed.

    There are 3 kernels for each per_tile points, one at least. A kernel's deviation is between a ten-thousandth and a fiftieth of
    the longest side, its centre three deviations inside the box (as far as the box allows), its size at most half of what is left. Points outside are cut off.
    """
    kernels = max(1, 3 * (n // per_tile))
    low, high = np.array(box.low), np.array(box.high)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                rng = np.random.default_rng([seed, int(k)])
                side = float((high - low).max())
                sd = rng.uniform(side / 10_000, side / 50 + side / 10_000)
                margin = np.minimum(3 * sd, (high - low) / 2)
                centre = rng.uniform(low + margin, high - margin)
                share = max(1, n // kernels)
                p = rng.normal(centre, sd, (share, len(low)))
                p = p[((p >= low) & (p <= high)).all(axis=1)]
                yield pd.DataFrame({"kernel": k, "pid": int(k) * share + np.arange(len(p))} | {a: p[:, i] for i, a in enumerate(box.axes)})

    schema = "kernel long, pid long, " + ", ".join(f"{a} double" for a in box.axes)
    return spark.range(0, kernels, 1, max(1, n // per_tile)).mapInPandas(run, schema)
