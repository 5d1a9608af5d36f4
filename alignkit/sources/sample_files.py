"""Sample sets as files by name, ``{label}.aligned.spwNN.npz``: a data source that plans one partition for each
file of the bands that are wanted, and a sink that puts whole files in place when all tasks are done.

A file is a zip of arrays as numpy stores them. Matrices are read and written a few rows at a time, so a
task's memory doesn't grow with a file. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

# The name of a sample set's file, and the arrays in it.
NAME = re.compile(r"^(?P<label>.+)\.aligned\.spw(?P<spw>\d+)\.npz$")
ARRAYS = ("matrix", "cube_shape", "time_grid", "lst_grid", "blp_lens", "dlys", "kperps", "kparas", "group_reps")

SCHEMAS = {
    "samples": "label string, spw int, time_pos int, time_jd double, lst_rad double, values array<double>",
    "features": "label string, spw int, feature int, group_id int, dly_pos int, group_len double, group_rep long, dly double, kperp double, kpara double",
}
#: Bytes of a matrix that are read at a time, a row at least.
STEP_BYTES = 1 << 20


def file_name(label: str, spw: int) -> str:
    return f"{label}.aligned.spw{spw:02d}.npz"


def _at(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


@dataclass
class SampleFile(InputPartition):
    path: str
    label: str
    spw: int

    def __init__(self, path: str, label: str, spw: int):
        super().__init__((path, label, spw))
        self.path, self.label, self.spw = path, label, spw


def _member(z: zipfile.ZipFile, name: str) -> np.ndarray:
    return np.load(io.BytesIO(z.read(f"{name}.npy")))


class SampleReader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.root, self.label, self.table = options["path"], options.get("label"), table
        named = options.get("bands")
        self.bands = None if named is None else {int(b) for b in named.split(",") if b}

    def partitions(self) -> list[SampleFile]:
        """Files in order of name; only names are looked at. No file is an error, no wanted band gives no rows."""
        system, root = _at(self.root)
        names = sorted(posixpath.basename(f.path) for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File)
        found = [(n, m) for n in names if (m := NAME.match(n)) and self.label in (None, m["label"])]
        if not found:
            raise FileNotFoundError(f"no samples for {self.label or 'any label'} under {self.root}")
        return [SampleFile(n, m["label"], int(m["spw"])) for n, m in found if self.bands is None or int(m["spw"]) in self.bands]

    def read(self, part: SampleFile):
        if part is None:  # no file is wanted
            return
        system, root = _at(self.root)
        with system.open_input_file(posixpath.join(root, part.path)) as f, zipfile.ZipFile(f) as z:
            yield from (self._samples if self.table == "samples" else self._features)(z, part)

    def _samples(self, z: zipfile.ZipFile, part: SampleFile):
        times, lsts = _member(z, "time_grid"), _member(z, "lst_grid")
        with z.open("matrix.npy") as m:
            version = np.lib.format.read_magic(m)
            (n, p), fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            if fortran:
                raise ValueError(f"{part.path}: a matrix by columns is not read")
            step = max(1, STEP_BYTES // max(1, p * kind.itemsize))
            for at in range(0, n, step):
                rows = min(step, n - at)
                flat = np.frombuffer(m.read(rows * p * kind.itemsize), kind).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * p, pa.int32()), pa.array(flat))
                same = lambda v, t, k=rows: pa.array([v] * k, t)
                yield pa.RecordBatch.from_arrays([same(part.label, pa.string()), same(part.spw, pa.int32()), pa.array(np.arange(at, at + rows), pa.int32()), pa.array(times[at : at + rows]), pa.array(lsts[at : at + rows]), lists], names=["label", "spw", "time_pos", "time_jd", "lst_rad", "values"])

    def _features(self, z: zipfile.ZipFile, part: SampleFile):
        _, groups, delays = _member(z, "cube_shape").tolist()
        feature = np.arange(groups * delays)
        group, delay = feature // max(delays, 1), feature % max(delays, 1)
        of = {"group_len": _member(z, "blp_lens")[group], "group_rep": _member(z, "group_reps")[group], "dly": _member(z, "dlys")[delay], "kperp": _member(z, "kperps")[group], "kpara": _member(z, "kparas")[delay]}
        same = lambda v, t: pa.array([v] * len(feature), t)
        yield pa.RecordBatch.from_arrays([same(part.label, pa.string()), same(part.spw, pa.int32()), *[pa.array(x, pa.int32()) for x in (feature, group, delay)], *[pa.array(v) for v in of.values()]], names=["label", "spw", "feature", "group_id", "dly_pos", *of])


class PruningReader(SampleReader):
    """Takes conditions on ``spw`` and ``label`` from the query; the files they leave out are never opened. Needs the
    session's setting for filters of Python data sources."""

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("spw",):
                self.bands = values if self.bands is None else self.bands & values
            elif values is not None and f.attribute == ("label",) and len(values) == 1 and self.label in (None, *values):
                self.label = next(iter(values))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class SampleWriter(DataSourceArrowWriter):
    """Rows ``spw, time_pos, time_jd, lst_rad, n_times, features, values, groups, delays``, a band's together and in
    order of time. Files are made in a folder of this write's own; ``commit`` moves them to their names,
    ``abort`` removes the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.label, self.overwrite = options["path"], options["label"], overwrite
        self.attempt = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        system, root = _at(self.root)
        folder = posixpath.join(root, self.attempt, uuid.uuid4().hex)  # a task that runs again writes elsewhere
        done, out = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and row["spw"] != out.spw:
                    out.close()
                    out = None
                if out is None:
                    if not done:
                        system.create_dir(folder, recursive=True)
                    path = posixpath.join(folder, file_name(self.label, row["spw"]))
                    out = _File(system, path, row)
                    done.append(path)
                out.add(row)
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        system, root = _at(self.root)
        made = [p for m in messages if m is not None for p in m.names]
        names = [posixpath.basename(p) for p in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("the rows of a band came in several tasks")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                own = NAME.match(posixpath.basename(f.path))
                if own and own["label"] == self.label:
                    system.delete_file(f.path)
        for path, name in zip(made, names, strict=True):
            system.move(path, posixpath.join(root, name))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _at(self.root)
        if system.get_file_info(posixpath.join(root, self.attempt)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(root, self.attempt))


class _File:
    """One sample set that is being written."""

    def __init__(self, system: fs.FileSystem, path: str, row: dict):
        self.spw, self.n, self.next, self.times, self.lsts = row["spw"], row["n_times"], 0, [], []
        self.groups, self.delays = row["groups"], row["delays"]
        self.p = len(self.groups) * len(self.delays)
        self.sink = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED)
        self.matrix = self.zip.open("matrix.npy", "w", force_zip64=True)
        np.lib.format.write_array_header_1_0(self.matrix, {"descr": "<f8", "fortran_order": False, "shape": (self.n, self.p)})

    def add(self, row: dict) -> None:
        if row["time_pos"] != self.next:
            raise ValueError(f"band {self.spw}: time {row['time_pos']} came where {self.next} is due")
        x = np.zeros(self.p)
        x[row["features"]] = row["values"]
        self.matrix.write(x.astype("<f8").tobytes())
        self.times.append(row["time_jd"])
        self.lsts.append(row["lst_rad"])
        self.next += 1

    def close(self) -> None:
        if self.next != self.n:
            raise ValueError(f"band {self.spw}: {self.next} of {self.n} times came")
        self.matrix.close()
        of = lambda rows, key, kind=float: np.array([r[key] for r in rows], kind)
        rest = {"cube_shape": np.array([self.n, len(self.groups), len(self.delays)]), "time_grid": np.array(self.times, float), "lst_grid": np.array(self.lsts, float), "blp_lens": of(self.groups, "group_len"), "dlys": of(self.delays, "dly"), "kperps": np.full(len(self.groups), np.nan), "kparas": of(self.delays, "kpara"), "group_reps": of(self.groups, "group_rep", np.int64)}
        for name, array in rest.items():
            with self.zip.open(f"{name}.npy", "w") as m:
                np.lib.format.write_array(m, array)
        self.zip.close()
        self.sink.close()


class SampleFiles(DataSource):
    """Options: ``path``; ``table`` (samples or features); ``label``; ``bands``, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "samplefiles"

    def _table(self) -> str:
        return self.options.get("table", "samples")

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> SampleReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else SampleReader
        return kind(dict(self.options), self._table())

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        return SampleWriter(dict(self.options), overwrite)


def read_sample_files(spark: SparkSession, root: str, label: str | None = None, bands: list[int] | None = None, table: str = "samples") -> DataFrame:
    """``samples`` (``label, spw, time_pos, time_jd, lst_rad, values``) or ``features`` (their coordinates) of the sample
    sets under ``root``; a label without files is an error, and files of other bands are not opened."""
    spark.dataSource.register(SampleFiles)
    reader = spark.read.format("samplefiles").option("table", table).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if label is not None:
        reader = reader.option("label", label)
    return (reader if bands is None else reader.option("bands", ",".join(map(str, bands)))).load(root)


def write_sample_files(run, root: str, label: str, mode: str = "append") -> None:
    """A run's bands as files by name. Cells that a time doesn't have are 0, as in the matrix; kperp is NaN.

    A file is written by one task, as it is one file: it holds the matrix a row at a time.
    """
    spark = run.samples.sparkSession
    spark.dataSource.register(SampleFiles)
    groups = run.groups.agg(F.sort_array(F.collect_list(F.struct("group_id", "group_len", F.col("group_rep").cast("long").alias("group_rep")))).alias("groups"))
    delays = run.delays.groupBy("spw").agg(F.sort_array(F.collect_list(F.struct("dly_pos", "dly", "kpara"))).alias("delays"))
    n = run.times.agg(F.count(F.lit(1)).cast("int").alias("n_times"))
    cells = run.samples.groupBy("spw", "time_pos").agg(F.collect_list(F.struct(F.col("feature").cast("int").alias("feature"), "value")).alias("cells"))
    # Each band has a row for each time of the run, with cells or without.
    every = run.delays.select("spw").distinct().crossJoin(run.times.select("time_pos", "time_jd", "lst_rad"))
    rows = every.join(cells, ["spw", "time_pos"], "left").join(delays, "spw").crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(n))
    none = F.array().cast("array<struct<feature:int,value:double>>")
    held = rows.withColumn("cells", F.coalesce("cells", none)).select(F.col("spw").cast("int").alias("spw"), F.col("time_pos").cast("int").alias("time_pos"), "time_jd", "lst_rad", "n_times", F.col("cells.feature").alias("features"), F.col("cells.value").alias("values"), "groups", "delays")
    held.repartition("spw").sortWithinPartitions("spw", "time_pos").write.format("samplefiles").option("label", label).mode(mode).save(root)
