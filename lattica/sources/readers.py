"""File sources and sinks. Bytes come through Spark's binaryFile reader, so any file system that Spark reads will do."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import labels as L
from lattica.plans.staging import staged
from lattica.sources import formats


def _files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def read_streamlines(spark: SparkSession, path: str | list[str], *, space: str = "world") -> DataFrame:
    """(path, curve, points): the curves of all .tck and .trk files under path; a file of another kind that is named raises an error."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                if not name.endswith((".tck", ".trk")):
                    raise ValueError(f"{name} is neither .tck nor .trk")
                curves = formats.parse_tck(data) if name.endswith(".tck") else formats.parse_trk(data, space)
                rows = [[{"x": x, "y": y, "z": z} for x, y, z in c.tolist()] for c in curves]
                kind = pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, kind)], names=["path", "curve", "points"])
    return _files(spark, path, "*.t[cr]k").mapInArrow(run, "path string, curve long, points array<struct<x:double,y:double,z:double>>")


def read_voxels(spark: SparkSession, path: str | list[str], *, threshold: float | None = None) -> DataFrame:
    """(path, i, j, k, value, m): voxels of all NIfTI files that are not 0, or above threshold, with the file's affine rows.

    A volume with a fourth axis longer than 1 raises an error.
    """
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                volume, affine = formats.parse_nifti(content.as_buffer().to_pybytes())
                if volume.ndim > 3 and volume.size != np.prod(volume.shape[:3]):
                    raise ValueError(f"{name} has more than three axes: {volume.shape}")
                volume = volume.reshape((*volume.shape, 1, 1)[:3])
                at = np.argwhere(volume != 0 if threshold is None else volume > threshold).astype(np.int32)
                values = volume[tuple(at.T)].astype(float)
                m = pa.array([affine.tolist()], pa.list_(pa.list_(pa.float64())))
                for a in range(0, len(at), 10_000):
                    cut = slice(a, a + 10_000)
                    n = len(values[cut])
                    yield pa.record_batch([pa.array([name] * n, pa.string()), *(pa.array(at[cut, d]) for d in range(3)), pa.array(values[cut]), m.take(pa.array([0] * n))], names=["path", "i", "j", "k", "value", "m"])
    return _files(spark, path, "*.nii*").mapInArrow(run, "path string, i int, j int, k int, value double, m array<array<double>>")


def read_gifti(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, array, row, v): rows of the data arrays of all GIFTI files; a surface has points in array 0 and faces in array 1."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for k, x in enumerate(formats.parse_gifti(content.as_buffer().to_pybytes())[0]):
                    rows = x.reshape(len(x), -1).astype(float)
                    yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["path", "array", "row", "v"])
    return _files(spark, path, "*.gii").mapInArrow(run, "path string, array int, row long, v array<double>")


def read_npy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row, col, x): entries other than 0 of all .npy matrices; a vector is one row."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                x = np.atleast_2d(formats.parse_npy(content.as_buffer().to_pybytes()))
                row, col = np.nonzero(x)
                for a in range(0, len(row), 10_000):
                    cut = slice(a, a + 10_000)
                    yield pa.record_batch([pa.array([name] * len(row[cut]), pa.string()), pa.array(row[cut]), pa.array(col[cut]), pa.array(x[row[cut], col[cut]].astype(float))], names=["path", "row", "col", "x"])
    return _files(spark, path, "*.npy").mapInArrow(run, "path string, row long, col long, x double")


def write_npy(matrix: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """Writes a matrix ``(row, col, x)`` as one .npy file of float64, entries left out being 0, to any file system of Spark's.

    Rows come to the driver one after the other, sorted, so one of them is in memory at a time.
    """
    spark = matrix.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    rows = matrix.groupBy("row").agg(F.collect_list(F.struct("col", "x")).alias("e")).orderBy("row")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(formats.npy_head(shape)))
        done = 0
        for r in itertools.chain(rows.toLocalIterator(), [None]):
            upto = shape[0] if r is None else r["row"]
            for _ in range(done, upto):
                out.write(bytearray(8 * shape[1]))
            if r is not None:
                line = np.zeros(shape[1], "<f8")
                line[[e["col"] for e in r["e"]]] = [e["x"] for e in r["e"]]
                out.write(bytearray(line.tobytes()))
            done = upto + 1
    finally:
        out.close()


def folders(files: DataFrame, base: str, name: str | None = None) -> DataFrame:
    """(folder): of the files ``(path)`` under base, the folders right below it; with name, the folders at any depth whose name matches
    that pattern of *, ? and [...]."""
    root = base.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/*", "/") if root.startswith("/") else F.col("path")
    own = files.select(plain.alias("path")).where(F.startswith("path", F.lit(root)))
    parts = own.select(F.slice(F.split(F.substring("path", len(root) + 1, 1 << 30), "/"), 1, 1 << 20).alias("parts")).where("size(parts) > 1")
    if name is None:
        return parts.select(F.concat(F.lit(root), F.col("parts")[0]).alias("folder")).distinct()
    pieces = re.findall(r"\*|\?|\[!?\]?[^\]]*\]|.", name, re.S)
    said = {"*": ".*", "?": "."}
    pattern = "".join(said.get(x) or ("[^" + x[2:] if x.startswith("[!") else x if len(x) > 1 else re.escape(x)) for x in pieces)
    up = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.struct(F.element_at("parts", n).alias("name"), F.concat(F.lit(root), F.array_join(F.slice("parts", F.lit(1), n), "/")).alias("folder")))
    return parts.select(F.explode(up).alias("f")).where(F.rlike("f.name", F.lit(f"^(?:{pattern})$"))).select("f.folder").distinct()


def read_folders(spark: SparkSession, base: str, name: str | None = None) -> DataFrame:
    """``folders`` of the files that are there; their contents are not read."""
    return folders(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path"), base, name)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child_pos, child) of a JSON object of parent -> list of children."""
    return catalog(spark.read.text(path, wholetext=True).select("value"))


def catalog(rows: DataFrame) -> DataFrame:
    """The same from rows ``(value)`` of JSON text."""
    whole = rows.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("parent", "children"))
    return whole.select("parent", F.posexplode("children").alias("child_pos", "child"))


def numbered_clusters(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(cluster, parent, child): numbers in the order of ``parents (parent_pos, parent)``, then of the children."""
    from pyspark.sql import Window

    # a catalog of some ten thousand names
    return parents.join(children, "parent").select((F.row_number().over(Window.orderBy("parent_pos", "child_pos")) - 1).alias("cluster"), "parent", "child")


def label_table(labels: DataFrame, seed: int = 0) -> DataFrame:
    """(key, r, g, b, a, name): white and clear for 0, a colour by hash and opaque for the others."""
    keys = labels.select(F.col("label").alias("key")).distinct()
    shade = lambda n: F.when(F.col("key") == 0, 1.0).otherwise(F.pmod(F.xxhash64("key", F.lit(seed), F.lit(n)), F.lit(1000)) / 1000.0)
    return keys.select("key", shade(1).alias("r"), shade(2).alias("g"), shade(3).alias("b"), F.when(F.col("key") == 0, 0.0).otherwise(1.0).alias("a"), F.concat(F.lit("Label_"), F.col("key").cast("string")).alias("name"))


def gifti_labels(labels: DataFrame, side: str, *, seed: int = 0, colours: DataFrame | None = None) -> Column | DataFrame:
    """(value): one row with the GIFTI file of a label map ``(unit, label)``; units are rows 0.. of one surface. Write it with ``.write.text``."""
    table = (label_table(labels, seed) if colours is None else colours).groupBy().agg(F.collect_list(F.struct("key", "name", "r", "g", "b", "a")).alias("table"))
    rows = labels.groupBy().agg(F.array_sort(F.collect_list(F.struct("unit", "label"))).alias("rows"))
    structure = {"L": "CortexLeft", "R": "CortexRight"}[side]

    def run(batches):
        for batch in batches:
            for table_, rows_ in zip(batch.column("table").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                flat = np.array([r["label"] for r in rows_], "<i4")
                names = {t["key"]: (t["name"], t["r"], t["g"], t["b"], t["a"]) for t in table_}
                yield pa.record_batch([pa.array([formats.make_gifti([("NIFTI_INTENT_LABEL", flat)], names, structure).decode()])], names=["value"])
    return table.crossJoin(rows).mapInArrow(run, "value string")  # one row each


def gifti_pair(left: DataFrame, right: DataFrame, side: str, *, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two label maps after merging and matching, background kept, as GIFTI files with shared colours of both maps' labels."""
    to_left, to_right = L.joined_maps(left, right)
    pairs = staged(L.joined_pairs(to_left, to_right))
    one = staged(L.mask_background(L.renamed(to_left, pairs, "u"), left))
    two = staged(L.mask_background(L.renamed(to_right, pairs, "v"), right))
    colours = label_table(one.select("label").union(two.select("label")), seed)
    return gifti_labels(one, side, colours=colours), gifti_labels(two, side, colours=colours)
