"""Tables that a computation writes for itself in the shared folder, and a scope that removes them.

They cut the lineage with files that outlive any executor. A scope that the caller closes removes its tables then; tables of
the process's own scope go when it ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from normlens.session import remove_folder, shared_dir
from normlens.sources.tables import save_by_key


class Scratch:
    """``with Scratch(spark) as s: s.table(df, "name")``: the tables go at the end, also if the block fails."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written as Parquet and read back; an empty table keeps its columns."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder of the shared one that does not exist yet; it goes with the tables."""
        self.paths.append(f"{shared_dir(self.spark)}/normlens-{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def by_key(self, df: DataFrame, name: str, key: str, buckets: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
        """``df`` as a bucketed table of the catalog, dropped with the others."""
        self.names.append(f"normlens_{name}_{uuid.uuid4().hex}")
        return save_by_key(df, self.names[-1], key, buckets, order)

    def remove(self, path: str) -> None:
        self.paths.remove(path)
        remove_folder(self.spark, path)

    def close(self) -> None:
        while self.paths:
            remove_folder(self.spark, self.paths.pop())
        while self.names and self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_own: dict[str, Scratch] = {}


def process_scratch(spark: SparkSession) -> Scratch:
    """The scope of this application, which ends with the process."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = Scratch(spark)
        atexit.register(_own[app].close)
    return _own[app]
