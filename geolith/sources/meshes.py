"""Mesh and cloud files besides PLY: pcd, a3d, stl, npts; soups of triangles and cells; CSV tables of a triangulation."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.sources.ply import ply_bytes, read_elements


def _numbers(text: str, columns: int) -> np.ndarray:
    rows = [line.split() for line in text.splitlines()]
    return np.array([r[:columns] for r in rows if len(r) >= columns], float).reshape(-1, columns)


def parse_pcd(data: bytes) -> pd.DataFrame:
    """A point cloud with FIELDS, SIZE, TYPE, COUNT and POINTS, ascii or binary (not compressed)."""
    at, head = 0, {}
    while True:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0].upper()] = words[1:]
            if words[0].upper() == "DATA":
                break
    names, n = head["FIELDS"], int(head["POINTS"][0])
    if head["DATA"][0] == "ascii":
        return pd.DataFrame(_numbers(data[at:].decode("ascii"), len(names))[:n], columns=names)
    if head["DATA"][0] != "binary":
        raise ValueError("compressed pcd is not read")
    kinds = [(f, f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t] }{s}") for f, t, s in zip(names, head["TYPE"], head["SIZE"])]
    return pd.DataFrame(np.frombuffer(data, np.dtype(kinds), n, at)).astype(float)


def pcd_text(points: pd.DataFrame) -> str:
    n = len(points)
    head = f"VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA ascii\n"
    return head + "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in points[["x", "y", "z"]].astype(float).itertuples(index=False))


def parse_stl(data: bytes) -> pd.DataFrame:
    """The corners of the triangles of an ascii or binary file, in order."""
    if data[:5] == b"solid" and b"facet" in data[:1000]:
        rows = [line.split()[1:4] for line in data.decode("ascii", "replace").splitlines() if line.strip().startswith("vertex")]
        return pd.DataFrame(np.array(rows, float).reshape(-1, 3), columns=list("xyz"))
    n = struct.unpack_from("<I", data, 80)[0]
    got = np.frombuffer(data, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"][:, 3:].reshape(-1, 3)
    return pd.DataFrame(got.astype(float), columns=list("xyz"))


def parse_cloud(data: bytes, kind: str) -> pd.DataFrame:
    """Points of a file: ply, pcd, stl, xyz (x y z), npts (x y z and a normal), a3d (x y z)."""
    if kind == "ply":
        return read_elements(data)["vertex"]
    if kind == "pcd":
        return parse_pcd(data)
    if kind == "stl":
        return parse_stl(data)
    if kind == "npts":
        return pd.DataFrame(_numbers(data.decode("ascii"), 6), columns=["x", "y", "z", "nx", "ny", "nz"])
    if kind in ("xyz", "a3d"):
        return pd.DataFrame(_numbers(data.decode("ascii"), 3), columns=list("xyz"))
    raise ValueError(f"unknown kind of cloud {kind!r}")


def cloud_bytes(points: pd.DataFrame, kind: str) -> bytes:
    """A file of points: ply, pcd, xyz or a3d."""
    if kind == "ply":
        return ply_bytes(points, [(c, "double") for c in ("x", "y", "z")], binary=False)
    if kind == "pcd":
        return pcd_text(points).encode()
    if kind in ("xyz", "a3d"):
        return "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in points[["x", "y", "z"]].astype(float).itertuples(index=False)).encode()
    raise ValueError(f"points can't be written as {kind!r}")


def convert(data: bytes, source: str, target: str, reach: float | None = None) -> bytes:
    """From one kind of file to another; with `reach`, points that have normals are moved to point + reach * normal."""
    p = parse_cloud(data, source)
    if reach is not None and {"nx", "ny", "nz"} <= set(p.columns):
        p = p.assign(**{a: p[a] + reach * p[f"n{a}"] for a in "xyz"})
    return cloud_bytes(p, target)


def read_clouds(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """x, y, z, file of all files of a kind in a folder."""

    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                yield parse_cloud(bytes(data), kind)[["x", "y", "z"]].astype(float).assign(file=file)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    return files.repartition("path").mapInPandas(run, "x double, y double, z double, file string")


def dataset_rows(points: DataFrame) -> DataFrame:
    """Points with their tile in the id columns of a dataset: vtid and ctid."""
    return points.withColumns({"vtid": F.col("tile_id"), "ctid": F.col("tile_id")})


def soup(corners: DataFrame, tile: str = "tile", most: int = 1_000_000) -> DataFrame:
    """corners (tile, p: array of structs x, y, z) -> (tile, part, content): PLY files of separate cells or triangles, coordinates at three decimals, at most `most` in
    a file. Rows are dealt to parts by number within the tile, and a part is one group."""
    part = F.floor((F.row_number().over(Window.partitionBy(tile).orderBy("p")) - 1) / most).cast("long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.array([[[q["x"], q["y"], q["z"]] for q in p] for p in pdf["p"]], float).round(3)
        n, k = at.shape[:2]
        faces = np.arange(n * k).reshape(n, k).tolist()
        content = ply_bytes(pd.DataFrame(at.reshape(-1, 3), columns=list("xyz")), [(a, "double") for a in "xyz"], True, faces=faces)
        return pd.DataFrame({tile: [pdf[tile].iloc[0]], "part": [pdf["part"].iloc[0]], "content": [content]})

    return corners.withColumn("part", part).groupBy(tile, "part").applyInPandas(run, f"{tile} long, part long, content binary")


def csv_tables(cells: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """Tables for CSV: vertices, cells and facets with well-known text of their geometry."""
    at = places.select("pid", F.concat_ws(" ", "x", "y", "z").alias("w"))
    ring = lambda col: cells.where(~F.col("infinite")).select("tile", F.col("pids").alias("key"), F.posexplode(col).alias("k", "pid")).join(at, "pid")
    text = lambda df: df.groupBy("tile", "key").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("s")).select("tile", F.concat_ws("-", F.transform("key", lambda x: x.cast("string"))).alias("cell"), F.concat(F.lit("POLYGON Z(("), F.concat_ws(",", "s.w"), F.lit(","), F.col("s.w")[0], F.lit("))")).alias("wkt"))
    return {"vertices": places.select("pid", "tile", F.concat(F.lit("POINT Z("), F.concat_ws(" ", "x", "y", "z"), F.lit(")")).alias("wkt")), "cells": text(ring("pids"))}
