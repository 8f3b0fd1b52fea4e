"""Event files: numpy, npz, feather and HDF5 beside Spark's own Parquet and CSV.

Readers split a file into row ranges, one partition each. npy and npz are written by the tasks, each at the places of its
rows; feather and HDF5, whose places depend on what stands before them, are written on the driver, Arrow batch by Arrow
batch, so that it holds one partition's batches at most. All get their name when they are whole. Pickled arrays are refused."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..plans.staging import discard, staged

ROWS = 1_000_000


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, source, schema):
        self.source, self.schema = source, schema

    def partitions(self):
        n, size = self.source.length(), int(self.source.options.get("rows", ROWS))
        return [Rows(i, min(n, i + size)) for i in range(0, n, size)] or [Rows(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        got = self.source.batch(partition.lo, partition.hi)
        want = to_arrow_schema(self.schema)
        yield pa.RecordBatch.from_arrays([got.column(f.name).cast(f.type) for f in want], schema=want)


class _File(DataSource):
    def path(self) -> str:
        return self.options["path"]

    def schema(self):
        return from_arrow_schema(self.batch(0, 0).schema)

    def reader(self, schema):
        return _Reader(self, schema)


def _plain(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    if a.dtype.kind == "u":  # Spark has signed integers only
        a = a.astype(np.int64)
    return pa.array(a)


class EventNpy(_File):
    """A structured array."""

    @classmethod
    def name(cls):
        return "eventnpy"

    def _load(self):
        a = np.load(self.path(), mmap_mode="r", allow_pickle=False)
        if not a.dtype.names:
            raise ValueError("not a structured array")
        return a

    def length(self) -> int:
        return len(self._load())

    def batch(self, lo: int, hi: int) -> pa.RecordBatch:
        a = self._load()[lo:hi]
        return pa.RecordBatch.from_arrays([_plain(a[n]) for n in a.dtype.names], names=list(a.dtype.names))


class EventNpz(_File):
    """The arrays Et_<kind>, Epix_<kind>, Epol_<kind>; options kind and width (pixels of a row)."""

    @classmethod
    def name(cls):
        return "eventnpz"

    def _rows(self, column: str, lo: int, hi: int | None = None) -> np.ndarray | int:
        """Rows lo to hi of an array, read past the others without holding them; without hi the array's length."""
        with zipfile.ZipFile(self.path()) as z, z.open(f"{column}_{self.options.get('kind', 'patch')}.npy") as f:
            read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
            (n, *more), _, kind = read(f)
            if more or kind.hasobject:
                raise ValueError("not a plain array of one dimension")
            if hi is None:
                return n
            f.seek(lo * kind.itemsize, os.SEEK_CUR)
            return np.frombuffer(f.read(max(0, min(n, hi) - lo) * kind.itemsize), kind)

    def length(self) -> int:
        return self._rows("Et", 0)

    def batch(self, lo: int, hi: int) -> pa.RecordBatch:
        t, pix, pol = (self._rows(c, lo, hi).astype(np.int64) for c in ("Et", "Epix", "Epol"))
        w = int(self.options["width"])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(t))), pa.array(t), pa.array((pix % w).astype(np.int32)), pa.array((pix // w).astype(np.int32)), pa.array(pol.astype(np.int32))], ["seq", "t", "x", "y", "pol"])


class EventFeather(_File):
    @classmethod
    def name(cls):
        return "eventfeather"

    def _open(self):
        return pa.ipc.open_file(pa.memory_map(self.path()))

    def length(self) -> int:
        f = self._open()
        return sum(f.get_batch(i).num_rows for i in range(f.num_record_batches))

    def batch(self, lo: int, hi: int) -> pa.RecordBatch:
        f = self._open()
        out, at = [], 0
        for i in range(f.num_record_batches):
            b = f.get_batch(i)
            if at < hi and at + b.num_rows > lo:
                out.append(b.slice(max(0, lo - at), min(hi, at + b.num_rows) - max(lo, at)))
            at += b.num_rows
        t = pa.Table.from_batches(out, f.schema).combine_chunks()
        return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_arrays([pa.array([], x.type) for x in f.schema], schema=f.schema)


class EventH5(_File):
    """A group of equally long datasets (scalars are repeated) or one compound dataset; option key, else the first."""

    @classmethod
    def name(cls):
        return "eventh5"

    def _columns(self, lo, hi):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("reading HDF5 needs h5py") from e
        with h5py.File(self.path(), "r") as f:
            node = f[self.options.get("key") or next(iter(f))]
            if isinstance(node, h5py.Dataset):
                n = len(node)
                part = node[lo : n if hi is None else hi]
                return n, {c: part[c] for c in part.dtype.names}
            n = max((len(d) for d in node.values() if d.shape), default=1)
            stop = n if hi is None else hi
            return n, {c: (d[lo:stop] if d.shape else np.full(max(0, stop - lo), d[()])) for c, d in node.items()}

    def length(self) -> int:
        return self._columns(0, 0)[0]

    def batch(self, lo: int, hi: int) -> pa.RecordBatch:
        cols = self._columns(lo, hi)[1]
        return pa.RecordBatch.from_arrays([_plain(v) for v in cols.values()], names=list(cols))


FORMATS = {".parquet": "parquet", ".csv": "csv", ".npy": "eventnpy", ".npz": "eventnpz", ".feather": "eventfeather", ".h5": "eventh5", ".hdf5": "eventh5"}


def register(spark: SparkSession) -> None:
    for source in (EventNpy, EventNpz, EventFeather, EventH5):
        spark.dataSource.register(source)


def format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported suffix {suffix!r}; supported: {', '.join(sorted(FORMATS))}")
    return FORMATS[suffix]


def read_events(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Reads by suffix. CSV has a header; give its schema to save the pass that infers it."""
    kind = format_of(path)
    r = spark.read
    if kind == "parquet":
        return (r.schema(schema) if schema else r).parquet(path)
    if kind == "csv":
        return r.csv(path, header=True, schema=schema) if schema else r.csv(path, header=True, inferSchema=True)
    register(spark)
    r = r.format(kind).options(**{k: str(v) for k, v in options.items()})
    return (r.schema(schema) if schema else r).load(path)


def batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of df in order as Arrow batches, fetched partition by partition, compressed by the tasks."""

    def pack(parts):
        for part in parts:
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["b"])

    for r in df.mapInArrow(pack, "b binary").toLocalIterator():
        yield from pa.ipc.open_stream(r["b"])


def _npy_header(kind: np.dtype, n: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (n,)})
    return out.getvalue()


def write_npy(df: DataFrame, files: dict[str, np.dtype], arrays: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> None:
    """One .npy file or more of the rows of df in their order, written by the tasks: `arrays` makes each file's rows of columns.

    Rows are numbered first (staged, so that numbers stay, with the counts of the partitions before them); each task then writes
    its rows at their places in a file of full length, so a repeated task writes the same bytes again and no row passes
    the driver. The files get the names given once all rows are counted in them."""
    numbered = staged(df.withColumn("__m", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__m", 33)
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).orderBy("__p").collect()  # one row a partition
    known, held = (np.array([r[c] for r in sizes], np.int64) for c in ("__p", "n"))
    total, before = int(held.sum()), np.cumsum(held) - held
    heads = {path: _npy_header(kind, total) for path, kind in files.items()}
    hidden = {path: f"{path}.{uuid.uuid4().hex}.part" for path in files}

    def write(found):
        out = {path: os.open(hidden[path], os.O_WRONLY) for path in files}
        try:
            for batch in found:
                m = batch.column("__m").to_numpy()
                at = before[np.searchsorted(known, m >> 33)] + (m & (1 << 33) - 1)
                made = arrays({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "__m"})
                cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for path, kind in files.items():
                    rows = np.ascontiguousarray(made[path], kind)
                    for i, j in zip(cuts, cuts[1:]):
                        if j > i:
                            data, place = memoryview(rows[i:j].tobytes()), len(heads[path]) + int(at[i]) * kind.itemsize
                            while data:
                                done = os.pwrite(out[path], data, place)
                                data, place = data[done:], place + done
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
            for f in out.values():
                os.fsync(f)
        finally:
            for f in out.values():
                os.close(f)

    try:
        for path, kind in files.items():
            with open(hidden[path], "wb") as f:
                f.write(heads[path])
                f.truncate(len(heads[path]) + total * kind.itemsize)
        written = numbered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != total:
            raise OSError(f"{written} of {total} rows were written")
        for path in files:
            os.replace(hidden[path], path)
    finally:
        for path in hidden.values():
            if os.path.exists(path):
                os.remove(path)
        discard(numbered)


def write_events(df: DataFrame, path: str, h5_key: str = "data", mode: str = "errorifexists", kind: str = "patch", width: int | None = None) -> None:
    """Writes by suffix."""
    form = format_of(path)
    if form == "parquet":
        return df.write.mode(mode).parquet(path)
    if form == "csv":
        return df.write.mode(mode).csv(path, header=True)
    if mode == "errorifexists" and os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    schema = to_arrow_schema(df.schema)
    if form == "eventnpy":
        kind = np.dtype([(f.name, np.dtype(f.type.to_pandas_dtype())) for f in schema])
        return write_npy(df, {path: kind}, lambda c: {path: np.rec.fromarrays([c[n] for n in kind.names], dtype=kind)})
    hidden = f"{path}.{uuid.uuid4().hex}.part"
    try:
        if form == "eventfeather":
            with pa.OSFile(hidden, "wb") as f, pa.ipc.new_file(f, schema) as w:
                for batch in batches(df):
                    w.write_batch(batch.cast(schema))
        elif form == "eventnpz":
            wide = width or (df.agg({"x": "max"}).first()[0] or 0) + 1
            names = {c: f"{hidden}.{c}" for c in ("Et", "Epix", "Epol")}
            whole = lambda v: v.astype(np.int64)
            try:
                write_npy(df.select("t", "x", "y", "pol"), {f: np.dtype(np.int64) for f in names.values()}, lambda c: {names["Et"]: c["t"], names["Epix"]: whole(c["x"]) + whole(c["y"]) * wide, names["Epol"]: c["pol"]})
                with zipfile.ZipFile(hidden, "w") as z:  # the finished files are copied; no rows are read
                    for c, f in names.items():
                        z.write(f, f"{c}_{kind}.npy")
            finally:
                for f in names.values():
                    if os.path.exists(f):
                        os.remove(f)
        else:
            _write_h5(df, hidden, h5_key, schema)
        os.replace(hidden, path)
    finally:
        if os.path.exists(hidden):
            os.remove(hidden)
    return None


def _write_h5(df: DataFrame, path: str, key: str, schema: pa.Schema) -> None:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("writing HDF5 needs h5py") from e
    with h5py.File(path, "w") as f:
        g = f.create_group(key)
        sets = {x.name: g.create_dataset(x.name, shape=(0,), maxshape=(None,), dtype=np.dtype(x.type.to_pandas_dtype()), chunks=True) for x in schema}
        n = 0
        for batch in batches(df):
            for c in batch.schema.names:
                v = batch.column(c).to_numpy(zero_copy_only=False)
                sets[c].resize((n + len(v),))
                sets[c][n : n + len(v)] = v
            n += batch.num_rows


def convert(spark: SparkSession, source: str, target: str, **options) -> None:
    write_events(read_events(spark, source, **options), target)
