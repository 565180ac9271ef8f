"""PLY files: any element with scalar properties, ascii or binary, as DataFrames; and back.

Unsigned types are widened, so no value overflows. Files are read whole by one task each, through Spark's own
reader, so any file system Spark knows will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of the format, their numpy codes, and the Spark types that hold them.
NUMPY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "long": "i8", "int64": "i8"}
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double", "i8": "bigint"}
NAMES = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double"}
HEADER_BYTES = 1 << 16


def parse_header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str, str | None]]]], int, list[str]]:
    """-> format, elements (name, count, properties (name, type, type of the length if it is a list)), where the data begin, comments."""
    end = re.search(rb"end_header[ \t]*\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise ValueError("not a PLY file")
    form, elements, comments = "", [], []
    for line in data[: end.start()].decode("ascii", "replace").splitlines()[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            form = words[1]
        elif words[0] == "comment":
            comments.append(line.partition(" ")[2].strip())
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            elements[-1][2].append((words[4], words[3], words[2]) if words[1] == "list" else (words[2], words[1], None))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY format {form!r}")
    return form, elements, end.end(), comments


def read_elements(data: bytes) -> dict[str, pd.DataFrame]:
    """All elements of a file."""
    form, elements, at, _ = parse_header(data)
    out = {}
    if form == "ascii":
        lines = iter(data[at:].decode("ascii").split("\n"))
        for name, count, props in elements:
            rows = []
            while len(rows) < count:
                words = next(lines).split()
                if not words:
                    continue
                row, k = [], 0
                for _, kind, size in props:
                    if size:
                        n = int(words[k])
                        row.append(np.array(words[k + 1 : k + 1 + n], NUMPY[kind]).tolist())
                        k += n + 1
                    else:
                        row.append(np.array(words[k], NUMPY[kind]).item())
                        k += 1
                rows.append(row)
            out[name] = pd.DataFrame(rows, columns=[p[0] for p in props])
        return out
    order = "<" if form == "binary_little_endian" else ">"
    for name, count, props in elements:
        if not any(size for *_, size in props):
            kind = np.dtype([(p, order + NUMPY[t]) for p, t, _ in props])
            got = np.frombuffer(data, kind, count, at)
            out[name] = pd.DataFrame({p: got[p].astype(NUMPY[t]) for p, t, _ in props})
            at += kind.itemsize * count
            continue
        rows = []
        for _ in range(count):
            row = []
            for _, kind, size in props:
                n = 1
                if size:
                    n = int(np.frombuffer(data, order + NUMPY[size], 1, at)[0])
                    at += np.dtype(NUMPY[size]).itemsize
                got = np.frombuffer(data, order + NUMPY[kind], n, at)
                at += got.nbytes
                row.append(got.tolist() if size else got[0].item())
            rows.append(row)
        out[name] = pd.DataFrame(rows, columns=[p[0] for p in props])
    return out


def spark_schema(props: list[tuple[str, str, str | None]]) -> str:
    return ", ".join(f"`{p}` " + (f"array<{SPARK[NUMPY[t]]}>" if size else SPARK[NUMPY[t]]) for p, t, size in props)


def read_ply(spark: SparkSession, path: str, element: str = "vertex", glob: str = "*.ply") -> DataFrame:
    """An element of all files of a folder, with file (its path) and tile_id (the last number in its name; null without one).

    Columns are those of the first file, by path; a file that lacks one has nulls there, further ones are passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    first = files.select("path", F.substring("content", 1, HEADER_BYTES).alias("head")).orderBy("path").first()
    if first is None:
        raise FileNotFoundError(f"no {glob} under {path}")
    props = next((p for name, _, p in parse_header(bytes(first["head"]))[1] if name == element), None)
    if props is None:
        raise ValueError(f"{first['path']} has no element {element!r}")
    names = [p[0] for p in props]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                got = read_elements(bytes(data)).get(element, pd.DataFrame(columns=names))
                yield got.reindex(columns=names).assign(file=file)

    # One file at a time in a worker: a batch of whole files may be large.
    rows = files.select("path", "content").repartition("path").mapInPandas(run, spark_schema(props) + ", file string")
    return rows.withColumn("tile_id", F.when(F.col("file").rlike(r"\d[^/\d]*$"), F.regexp_extract("file", r"(\d+)[^/\d]*$", 1).cast("long")))


def header(kinds: list[tuple[str, str]], count: int, binary: bool, element: str = "vertex", box: list[float] | None = None) -> str:
    lines = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0"]
    if box:
        lines.append("comment bbox " + " ".join(f"{v:g}" for v in box))
    lines.append(f"element {element} {count}")
    lines += [f"property {NAMES[k] if k in NAMES else 'double'} {n}" for n, k in kinds]
    return "\n".join([*lines, "end_header", ""])


def ply_bytes(pdf: pd.DataFrame, kinds: list[tuple[str, str]], binary: bool = True, box: list[float] | None = None, faces: list | None = None) -> bytes:
    """A file with one vertex element, and a face element if faces (lists of vertex numbers) are given."""
    codes = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}
    head = header(kinds, len(pdf), binary, box=box)
    if faces is not None:
        head = head.replace("end_header\n", f"element face {len(faces)}\nproperty list uchar int vertex_index\nend_header\n")
    if binary:
        rows = np.zeros(len(pdf), [(n, "<" + codes[k]) for n, k in kinds])
        for n, _ in kinds:
            rows[n] = pdf[n].to_numpy()
        tail = b"".join(bytes([len(f)]) + np.array(f, "<i4").tobytes() for f in faces or [])
        return head.encode() + rows.tobytes() + tail
    text = "".join(" ".join(repr(v.item() if hasattr(v, "item") else v) for v in row) + "\n" for row in pdf[[n for n, _ in kinds]].itertuples(index=False))
    return (head + text + "".join(" ".join(map(str, [len(f), *f])) + "\n" for f in faces or [])).encode()


def ply_files(points: DataFrame, tile: str = "tile_id", binary: bool = True) -> DataFrame:
    """A file for each tile: (tile, content binary). A tile is one group; tiling bounds its size."""
    kinds = [(f.name, f.dataType.simpleString()) for f in points.schema if f.name != tile]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        box = [f(pdf[a]) for a in "xyz" if a in pdf for f in (min, max)]
        return pd.DataFrame({tile: [pdf[tile].iloc[0]], "content": [ply_bytes(pdf, kinds, binary, box)]})

    return points.groupBy(tile).applyInPandas(run, f"{tile} long, content binary")


def write_ply(points: DataFrame, path: str, tile: str = "tile_id", binary: bool = True) -> None:
    """A folder of files named by tile, written through Hadoop's file system by the executors' rows.

    Contents are gathered by tile on the executors and handed to the driver one at a time, never together.
    """
    spark = points.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    fs.mkdirs(base)
    for row in ply_files(points, tile, binary).toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(base, f"tile_{row[tile]}.ply"), True)
        out.write(bytearray(row["content"]))
        out.close()


def box_comment(data: bytes) -> list[float] | None:
    """The numbers of 'comment bbox ...', if the header has one."""
    for c in parse_header(data)[3]:
        if c.startswith("bbox"):
            return [float(v) for v in c.split()[1:]]
    return None
