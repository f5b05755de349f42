"""Readers and writers: seed lists, path and contour XML, MetaImage volumes, legacy polydata text."""

from __future__ import annotations

import json
import math
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_SCHEMA = "file string, path_id int, id int, x double, y double, z double, tx double, ty double, tz double, rx double, ry double, rz double"
# Element types of the volume format and their numpy names.
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A seed list: case, seed, old point, point, radius.  Its rows mix arrays and numbers, so they are parsed as text."""
    rows = spark.read.text(path, wholetext=True)

    def run(batches):
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                for case in json.loads(value):
                    for i, (old, new, radius) in enumerate(case["seeds"]):
                        out.append((case["name"], i, *map(float, old), *map(float, new), float(radius)))
            yield pd.DataFrame(out, columns=["case", "seed", "old_x", "old_y", "old_z", "x", "y", "z", "radius"])

    return rows.mapInPandas(run, "case string, seed int, old_x double, old_y double, old_z double, x double, y double, z double, radius double")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """The samples of path files: file, path_id, id, position, tangent, rotation."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                text = content.decode("utf-8")
                body = text[text.index("<path") :] if text.lstrip().startswith("<?xml") else text
                root = ET.fromstring(f"<all>{body}</all>")
                for p in root.iter("path"):
                    for q in p.iter("path_point"):
                        v = [float(q.find(part).get(c)) for part in ("pos", "tangent", "rotation") for c in "xyz"]
                        out.append((name, int(p.get("id", 0)), int(q.get("id")), *v))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PATH_SCHEMA.split(", ")])

    return files.mapInPandas(run, PATH_SCHEMA)


def _number(x: float) -> str:
    return f"{x:.15g}"


def path_document(points: pd.DataFrame, path_id: int, controls: pd.DataFrame | None = None) -> str:
    """A path file's text from samples (x .. rz) and control points (x, y, z)."""
    root = ET.Element("path", id=str(path_id), method="0", calculation_number=str(len(points)), spacing="0")
    step = ET.SubElement(ET.SubElement(root, "timestep", id="0"), "path_element")
    block = ET.SubElement(step, "control_points")
    for i, r in enumerate((points if controls is None else controls).itertuples()):
        ET.SubElement(block, "point", id=str(i), x=_number(r.x), y=_number(r.y), z=_number(r.z))
    block = ET.SubElement(step, "path_points")
    for i, r in enumerate(points.itertuples()):
        q = ET.SubElement(block, "path_point", id=str(i))
        for part, names in (("pos", "xyz"), ("tangent", ("tx", "ty", "tz")), ("rotation", ("rx", "ry", "rz"))):
            ET.SubElement(q, part, **{c: _number(getattr(r, n)) for c, n in zip("xyz", names, strict=True)})
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8" ?>\n<format version="1.0" />\n' + ET.tostring(root, encoding="unicode") + "\n"


def path_documents(samples: DataFrame, by: str = "path_id") -> DataFrame:
    """One text per path; paths are written by as many tasks as there are partitions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        return pd.DataFrame({by: [rows[by].iloc[0]], "document": [path_document(rows, int(rows[by].iloc[0]))]})

    return samples.groupBy(by).applyInPandas(run, f"{by} int, document string")


def contour_document(path_name: str, path_id: int, loops: list[np.ndarray], positions: pd.DataFrame) -> str:
    """A contour group's text; loops of under three points are left out, and a group without any raises."""
    root = ET.Element("contourgroup", path_name=path_name, path_id=str(path_id))
    step = ET.SubElement(root, "timestep", id="0")
    n = 0
    for loop, p in zip(loops, positions.itertuples(), strict=True):
        if loop is None or len(loop) < 3:
            continue
        c = ET.SubElement(step, "contour", id=str(n), type="Contour", method="Manual", closed="true")
        q = ET.SubElement(c, "path_point", id=str(p.id))
        for part, names in (("pos", "xyz"), ("tangent", ("tx", "ty", "tz")), ("rotation", ("rx", "ry", "rz"))):
            ET.SubElement(q, part, **{a: _number(getattr(p, m)) for a, m in zip("xyz", names, strict=True)})
        for tag in ("control_points", "contour_points"):
            block = ET.SubElement(c, tag)
            for i, v in enumerate(loop):
                ET.SubElement(block, "point", id=str(i), **{a: _number(float(b)) for a, b in zip("xyz", v, strict=True)})
        n += 1
    if not n:
        raise ValueError("no contour has three points")
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8" ?>\n<format version="1.0" />\n' + ET.tostring(root, encoding="unicode") + "\n"


def meta_image(block: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), direction=(1, 0, 0, 0, 1, 0, 0, 0, 1)) -> bytes:
    """A volume file of a dense block (x, y, z), header and raw data in one."""
    kind = next(k for k, v in META_TYPES.items() if np.dtype(v) == block.dtype)
    lines = ["ObjectType = Image", "NDims = 3", "BinaryData = True", "BinaryDataByteOrderMSB = False", "CompressedData = False", f"TransformMatrix = {' '.join(f'{d:g}' for d in direction)}", f"Offset = {' '.join(map(_number, origin))}", "CenterOfRotation = 0 0 0", f"ElementSpacing = {' '.join(map(_number, spacing))}", f"DimSize = {' '.join(map(str, block.shape))}", f"ElementType = {kind}", "ElementDataFile = LOCAL"]
    return ("\n".join(lines) + "\n").encode() + block.astype(block.dtype.newbyteorder("<")).tobytes(order="F")


def parsed_meta_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """(header, dense block) of a volume file; compressed or detached data aren't supported."""
    mark = b"ElementDataFile = LOCAL\n"
    at = data.index(mark) + len(mark)
    header = dict(line.split(" = ", 1) for line in data[:at].decode().strip().split("\n"))
    if header.get("CompressedData", "False") == "True":
        raise ValueError("compressed volumes aren't supported")
    shape = tuple(map(int, header["DimSize"].split()))
    return header, np.frombuffer(data[at:], np.dtype(META_TYPES[header["ElementType"]]).newbyteorder("<"), math.prod(shape)).reshape(shape, order="F")


def read_volumes(spark: SparkSession, path: str, foreground_only: bool = False) -> DataFrame:
    """The voxels of volume files: file, x, y, z, v; ``foreground_only`` leaves zeros out before they reach Spark."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                _, block = parsed_meta_image(content)
                for x in range(block.shape[0]):  # a slice at a time
                    y, z = np.nonzero(block[x]) if foreground_only else np.indices(block[x].shape).reshape(2, -1)
                    yield pd.DataFrame({"file": name, "x": np.int32(x), "y": y.astype(np.int32), "z": z.astype(np.int32), "v": block[x][y, z].astype(float)})

    return files.mapInPandas(run, "file string, x int, y int, z int, v double")


def polydata_text(points: pd.DataFrame, cells: pd.DataFrame) -> str:
    """A legacy polydata file's text of a triangle mesh."""
    place = {p: i for i, p in enumerate(points["pid"])}
    head = ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET POLYDATA", f"POINTS {len(points)} double"]
    body = [" ".join(map(_number, r)) for r in points[["x", "y", "z"]].to_numpy()]
    tri = [f"3 {place[a]} {place[b]} {place[c]}" for a, b, c in cells[["a", "b", "c"]].to_numpy()]
    return "\n".join([*head, *body, f"POLYGONS {len(cells)} {4 * len(cells)}", *tri]) + "\n"


def file_stem(path):
    """The name of a file without its folder and image extension (.nii.gz counts as one)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.nii\.gz|\.[^.]+)$", "")
