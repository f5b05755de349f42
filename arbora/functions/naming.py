"""Column builders for names, display sizes and choices that depend on units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """The name of a file without folder and extension; .nii.gz counts as one extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.nii\.gz|\.[^.]+)$", "")


def case_of_segmentation(path: Column) -> Column:
    """The case of a segmentation file's name: what stands before ``_segmentation_``."""
    return F.substring_index(file_stem(path), "_segmentation_", 1)


def dataset_name(name: Column, number: Column, modality: Column) -> Column:
    """``Dataset`` with the number at four digits, then the name and the modality in capitals."""
    return F.concat(F.lit("Dataset"), F.lpad(number.cast("string"), 4, "0"), F.lit("_"), name, F.upper(modality))


def dataset_number(name: Column) -> Column:
    """The number in a data set's name; null where there's none."""
    n = F.regexp_extract(name, r"^Dataset(\d+)_", 1)
    return F.when(n != "", n.cast("int"))


def unit_scale(unit_name: Column) -> Column:
    """Millimetres 1, other units 0.1."""
    return F.when(unit_name == "mm", F.lit(1.0)).otherwise(F.lit(0.1))


def size_text(value: Column) -> Column:
    """A number as text, whole numbers without a point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def reslice_size(unit_name: Column) -> Column:
    return F.when(unit_name == "mm", F.lit("50")).otherwise(F.lit("5"))


def contour_stride(path_points: Column, steps: Column, base: int = 1) -> Column:
    """Every how many path points a contour is made: their number over the branch's steps, rounded half to even."""
    return F.greatest(F.lit(base), F.rint(F.try_divide(path_points, steps)).cast("int"))


def decimated(n: Column, most: int) -> Column:
    """At most ``most`` even indices of 0 .. n - 1, ends included, without repeats."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (n - 1) / F.lit(max(most - 1, 1))).cast("int")))
    return F.when(n <= most, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(many)
