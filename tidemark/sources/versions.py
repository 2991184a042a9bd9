"""Tables in versions: bucket folders that are written once, and a small manifest per version that names them.

A version lists, for each table and bucket, the folder that holds its rows, and facts such as a watermark. It becomes the
current one when its manifest is renamed into place, all tables and facts at once; before that nobody sees it, and a job
that dies half-way leaves folders that no manifest names. Later versions name the folders of buckets they did not touch
again, so those keep their files, and readers of an older version keep reading its rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import exists, file_system


@dataclass(frozen=True)
class Version:
    """number 0 is the empty one before the first commit. tables: table -> bucket -> folder."""

    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def bucket_of(*columns: str, buckets: int):
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class VersionedTables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number}.json"

    def version(self, number: int) -> Version:
        if not number:
            return Version()
        text = "\n".join(r.value for r in self.spark.read.text(self._manifest(number)).collect())
        return Version(number, **json.loads(text))

    def current(self) -> Version:
        place, fs = file_system(self.spark, f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return self.version(max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0))

    def read(self, version: Version, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        folders = version.tables.get(table, {})
        wanted = [p for b, p in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, bucket: str, buckets: list[int]) -> dict[str, str]:
        """Writes rows by the column ``bucket``, one folder per bucket of ``buckets``; the folders without rows are left out.
        Gives bucket -> folder, for commit()."""
        at = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.repartition(bucket).write.partitionBy(bucket).parquet(at)
        folders = {str(b): f"{at}/{bucket}={b}" for b in buckets}
        return {b: p for b, p in folders.items() if exists(self.spark, p)}

    def commit(self, before: Version, changed: dict[str, tuple[list[int], dict[str, str]]], facts: dict) -> Version:
        """The next version: of each table, ``changed`` gives the buckets that were written again and their folders now. It fails
        if another writer has committed a version after ``before``."""
        tables = {t: dict(p) for t, p in before.tables.items()}
        for name, (buckets, folders) in changed.items():
            kept = {b: p for b, p in tables.get(name, {}).items() if int(b) not in buckets}
            tables[name] = kept | folders
        number, path = before.number + 1, self._manifest(before.number + 1)
        aside, fs = file_system(self.spark, f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps({"tables": tables, "facts": {**before.facts, **facts}}).encode()))
        out.close()
        place, _ = file_system(self.spark, path)
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise RuntimeError(f"version {number} is there already: another writer came first")
        return self.version(number)
