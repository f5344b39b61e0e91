"""Headerless shards of raw vectors as a Spark data source that is split inside a shard.

``spark.read.format("raw_vectors").option("dim", 64).load(path)`` reads ``path/vectors/<shard>.fp16`` beside the ids in
``path/ids/<shard>.parquet``.  A partition is a byte range of ``rangeRows`` vectors of one shard with the ids of those rows,
so a shard of any size is read by many tasks, each of which reads its own range only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Endings of a raw vector shard and of its ids; vectors of one range (fixed values).
VECTORS, IDS, RANGE_ROWS = ".fp16", ".parquet", 131_072
_COLUMNS = pa.schema([("shard", pa.string()), ("row_index", pa.int64()), ("id", pa.int64()), ("vec", pa.list_(pa.float32()))])


def _files(folder: str, kind: str, ending: str) -> dict[str, int]:
    """Sizes of the files of one ending, by name; none where the folder does not exist."""
    system, root = pa.fs.FileSystem.from_uri(folder)
    found = system.get_file_info(pa.fs.FileSelector(f"{root}/{kind}", allow_not_found=True))
    return {f.base_name.removesuffix(ending): f.size for f in found if f.base_name.endswith(ending)}


class ShardRange(InputPartition):
    def __init__(self, folder: str, shard: str, start: int, rows: int, size: int):
        self.folder, self.shard, self.start, self.rows, self.size = folder, shard, start, rows, size


class RawVectors(DataSource):
    """Options: ``path``, ``dim``, ``dtype`` (numpy's name, ``<f2``), ``rangeRows``, ``chunkRows`` (of one Arrow batch) and
    ``shards``, a JSON list of [folder, shard] that is read in the place of all shards of ``path``."""

    @classmethod
    def name(cls) -> str:
        return "raw_vectors"

    def schema(self) -> str:
        return "shard string, row_index long, id long, vec array<float>"

    def reader(self, schema) -> RawVectorsReader:
        return RawVectorsReader(dict(self.options))


class RawVectorsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dim = options["path"].rstrip("/"), int(options["dim"])
        self.shards = json.loads(options["shards"]) if "shards" in options else None
        self.kind = np.dtype(options.get("dtype", "<f2"))
        self.range_rows, self.chunk = int(options.get("rangerows", options.get("rangeRows", RANGE_ROWS))), int(options.get("chunkrows", options.get("chunkRows", 4096)))

    def partitions(self) -> list[ShardRange]:
        """Names and sizes of files are all that the driver reads."""
        wanted: dict[str, set[str] | None] = {self.path: None}
        if self.shards is not None:
            wanted = {}
            for folder, shard in self.shards:
                wanted.setdefault(folder, set()).add(shard)
        return [part for folder, shards in wanted.items() for part in self._ranges(folder, shards)]

    def _ranges(self, folder: str, only: set[str] | None) -> list[ShardRange]:
        vectors, ids = (_files(folder, *kind) for kind in (("vectors", VECTORS), ("ids", IDS)))
        if only is not None:
            if gone := sorted(only - set(vectors)):
                raise ValueError(f"{gone[0]}: named, but not in {folder}")
            vectors, ids = ({k: v for k, v in found.items() if k in only} for found in (vectors, ids))
        if lonely := sorted(set(vectors) ^ set(ids)):
            raise ValueError(f"{lonely[0]}: vectors but no ids, or ids but no vectors")
        row = self.dim * self.kind.itemsize
        out = []
        for shard, size in sorted(vectors.items()):
            rows = -(-size // row)
            out += [ShardRange(folder, shard, start, min(self.range_rows, rows - start), size) for start in range(0, max(rows, 1), self.range_rows)]
        return out

    def read(self, part: ShardRange) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(part.folder)
        row = self.dim * self.kind.itemsize
        end = part.start + part.rows
        with system.open_input_file(f"{root}/ids/{part.shard}{IDS}") as file:
            named = pq.ParquetFile(file).metadata.num_rows
        if part.size != named * row:
            raise ValueError(f"{part.shard}: {part.size / row:g} vectors but {named} ids")
        inside = (pc.field("row_index") >= part.start) & (pc.field("row_index") < end)
        ids = pq.read_table(f"{root}/ids/{part.shard}{IDS}", columns=["row_index", "id"], filters=inside, filesystem=system).sort_by("row_index")
        if ids["row_index"].to_pylist() != list(range(part.start, end)):
            raise ValueError(f"{part.shard}: rows {part.start} to {end - 1} have missing or repeated ids")
        with system.open_input_file(f"{root}/vectors/{part.shard}{VECTORS}") as file:
            file.seek(part.start * row)
            for at in range(part.start, end, self.chunk):
                n = min(self.chunk, end - at)
                x = np.frombuffer(file.read(n * row), self.kind).reshape(n, self.dim).astype(np.float32)
                if not np.isfinite(x).all():
                    bad = at + int(np.flatnonzero(~np.isfinite(x).all(axis=1))[0])
                    raise ValueError(f"{part.shard}: vector row {bad} is not finite")
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, self.dim, dtype=np.int32)), pa.array(x.ravel()))
                known = ids.slice(at - part.start, n)
                columns = [pa.array([part.shard] * n), known["row_index"].combine_chunks().cast(pa.int64()), known["id"].combine_chunks().cast(pa.int64()), vec]
                yield pa.record_batch(columns, schema=_COLUMNS)


def read_raw_vectors(spark: SparkSession, path: str, dim: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Headerless shards with their ids → (shard, row_index, id, vec).

    Fails, naming the shard and the row, where vectors and ids differ in number or a part is not finite."""
    spark.dataSource.register(RawVectors)
    return spark.read.format("raw_vectors").option("dim", dim).option("rangeRows", range_rows).load(path)


def write_raw_vectors(df: DataFrame, path: str, shard_rows: int = 10_000_000, dtype: str = "<f2", prefix: str = "part") -> None:
    """``df(id, vec)`` as headerless shards ``path/vectors/<shard>.fp16``, each with its ids as ``path/ids/<shard>.parquet``
    (row_index, id) in row groups of one range; names begin with ``prefix``.  Rows are written as they come, so a shard is never held; a task that
    is run again writes the same names anew."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        system, root = pa.fs.FileSystem.from_uri(path)
        for folder in ("vectors", "ids"):
            system.create_dir(f"{root}/{folder}", recursive=True)
        vectors = ids = None
        for batch in batches:
            while batch.num_rows:
                if vectors is None:
                    name = f"{prefix}{part:06d}-{number:04d}"
                    vectors = system.open_output_stream(f"{root}/vectors/{name}{VECTORS}")
                    ids = pq.ParquetWriter(f"{root}/ids/{name}{IDS}", pa.schema([("row_index", pa.int64()), ("id", pa.int64())]), filesystem=system)
                piece = batch.slice(0, min(shard_rows - at, RANGE_ROWS - at % RANGE_ROWS))
                vectors.write(piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes())
                ids.write_batch(pa.record_batch({"row_index": pa.array(range(at, at + piece.num_rows), pa.int64()), "id": piece.column(0)}))
                at, batch = at + piece.num_rows, batch.slice(piece.num_rows)
                if at == shard_rows:
                    vectors.close(), ids.close()
                    yield pa.record_batch({"shard": [name], "rows": [at]})
                    vectors, number, at = None, number + 1, 0
        if vectors is not None:
            vectors.close(), ids.close()
            yield pa.record_batch({"shard": [name], "rows": [at]})

    df.select(F.col("id").cast("long"), F.col("vec").cast("array<float>")).mapInArrow(shards, "shard string, rows long").count()


def assemble_index(bases: list[str], added: DataFrame, out: str, leave_out: tuple[str, ...] = (), shard_rows: int = 10_000_000, prefix: str = "added", dtype: str = "<f2") -> None:
    """An index at ``out`` of the shards of ``bases`` as they lie there, but those named in ``leave_out``, and of ``added(id,
    vec)`` as new shards.  Shards that stay are referred to and not copied; ``out/manifest`` lists folder and name of each.
    Two shards of one name, and a name to leave out that no base has, are errors."""
    spark = added.sparkSession
    linked = [(base.rstrip("/"), shard) for base in bases for shard in sorted(_files(base, "vectors", VECTORS))]
    if unknown := set(leave_out) - {shard for _, shard in linked}:
        raise ValueError(f"no shard {min(unknown)} to leave out")
    write_raw_vectors(added, out, shard_rows, dtype, prefix)
    own = [(out.rstrip("/"), shard) for shard in sorted(_files(out, "vectors", VECTORS))]
    every = [(folder, shard) for folder, shard in linked if shard not in leave_out] + own
    if len({shard for _, shard in every}) < len(every):
        raise ValueError("two shards of one name")
    spark.createDataFrame(every, "folder string, shard string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")


def read_assembled(spark: SparkSession, path: str, dim: int, range_rows: int = RANGE_ROWS, dtype: str = "<f2") -> DataFrame:
    """(shard, row_index, id, vec) of an assembled index; the driver reads the names of its shards."""
    spark.dataSource.register(RawVectors)
    shards = [[r["folder"], r["shard"]] for r in spark.read.schema("folder string, shard string").json(f"{path}/manifest").collect()]
    return spark.read.format("raw_vectors").option("dim", dim).option("rangeRows", range_rows).option("dtype", dtype).option("shards", json.dumps(shards)).load(path)
