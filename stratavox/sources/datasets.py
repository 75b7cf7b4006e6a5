"""A catalogue of datasets: a Parquet table (name, dim, block, dtype, resolution, offset) beside a store of chunks.

Each entry is a file of its own partition, so entries are written and replaced one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators.volume import XYZ, Grid, window
from stratavox.plans.checkpoints import cut

from . import chunks

SCHEMA = "dim array<long>, block array<int>, dtype string, resolution array<double>, offset array<double>, name string"


class Store:
    """A folder with chunks and their catalogue, anywhere that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def datasets(self) -> DataFrame:
        """Rows (name, dim, block, dtype, resolution, offset): all datasets of the store."""
        if not self._exists("datasets"):
            return self.spark.createDataFrame([], SCHEMA).select("name", "dim", "block", "dtype", "resolution", "offset")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/datasets").select("name", "dim", "block", "dtype", "resolution", "offset")

    def names(self) -> list[str]:
        return sorted(r.name for r in self.datasets().select("name").collect())

    def describe(self, name: str) -> tuple[Grid, str]:
        """(grid, dtype) of a dataset."""
        r = self.datasets().where(F.col("name") == name).first()
        if r is None:
            raise KeyError(name)
        return Grid(tuple(r.dim), tuple(r.block), tuple(r.resolution), tuple(r.offset)), r.dtype

    def create(self, name: str, grid: Grid | None = None, dtype: str | None = None, like: str | None = None, block: tuple[int, int, int] | None = None) -> tuple[Grid, str]:
        """An entry from a grid and a type, or like another dataset with what is given changed."""
        old, old_dtype = self.describe(like) if like else (None, "uint64")
        grid, dtype = grid or old, dtype or old_dtype
        if block:
            grid = Grid(grid.dim, block, grid.resolution, grid.offset)
        row = [(list(grid.dim), list(grid.block), dtype, list(map(float, grid.resolution)), list(map(float, grid.offset)), name)]
        entry = self.spark.createDataFrame(row, SCHEMA)
        entry.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(f"{self.path}/datasets")
        return grid, dtype

    def write(self, name: str, volume: DataFrame) -> None:
        """The voxels of a dataset that is in the catalogue; what it held is replaced."""
        grid, dtype = self.describe(name)
        chunks.write_volume(volume, grid, f"{self.path}/chunks", name, dtype)

    def read(self, name: str) -> DataFrame:
        _, dtype = self.describe(name)
        rows = self.spark.read.schema(chunks.SCHEMA).parquet(f"{self.path}/chunks").where(F.col("dataset") == name)
        return chunks.from_chunks(rows, dtype)

    def window(self, name: str, offset: tuple[int, int, int], dim: tuple[int, int, int]) -> DataFrame:
        """The voxels of a dataset in a box; only chunks that meet it are decoded."""
        grid, dtype = self.describe(name)
        rows = chunks.stored_chunks(self.spark, f"{self.path}/chunks", name, grid, offset, dim)
        return window(chunks.from_chunks(rows, dtype), offset, dim)

    def blocks(self, name: str, pad: int = 0) -> DataFrame:
        """Rows (bx, by, bz, ox, oy, oz, dx, dy, dz) of the blocks that a dataset has chunks for, grown by pad on each side; no chunk is read."""
        own = chunks.stored_chunks(self.spark, f"{self.path}/chunks", name)
        return own.select(*(F.col(f"g{c}").cast("long").alias(f"b{c}") for c in XYZ), *((F.col(f"o{c}") - pad).alias(f"o{c}") for c in XYZ), *((F.col(f"d{c}") + 2 * pad).cast("long").alias(f"d{c}") for c in XYZ))

    def copy(self, name: str, to: str, dtype: str = "uint64") -> None:
        """A dataset under another name and type; floats become integers by dropping what is behind the point, and zeros are background."""
        self.create(to, like=name, dtype=dtype)
        volume = self.read(name)
        if not dtype.startswith("float"):
            volume = volume.withColumn("v", F.col("v").cast("long")).where("v <> 0")
        self.write(to, cut(volume))
