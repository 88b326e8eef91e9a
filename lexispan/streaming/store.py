"""A table whose versions belong to micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


class VersionedStore:
    """Versions of a table under one folder; a pointer file for each batch names the version it made.

    A version is written in full before its pointer appears by a rename, which
    either happens or does not. A batch that is run again after its pointer is
    there changes nothing; one that failed before leaves files that no pointer
    names. A batch reads what stood before it, so that running it again gives
    the same version.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark).rstrip('/')}/lexispan/{uuid.uuid4().hex}").rstrip("/")

    def _files(self, path: str):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(context._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches that have made a version."""
        where, files = self._files(f"{self.folder}/pointers")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where)) if files.exists(where) else []

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest that was there before a batch; null where there is none."""
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return None
        where, files = self._files(f"{self.folder}/pointers/{known[-1]:020d}")
        pointer = files.open(where)
        version = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(pointer, "UTF-8")
        pointer.close()
        return self.spark.read.parquet(f"{self.folder}/versions/{version}")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id not in self.batches():
            self.commit(batch_id, self.prepare(rows))

    def prepare(self, rows: DataFrame) -> str:
        """Write a version that nothing points to yet."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/versions/{version}")
        return version

    def commit(self, batch_id: int, version: str) -> None:
        """Make a written version the one of a batch."""
        draft, files = self._files(f"{self.folder}/drafts/{version}")
        out = files.create(draft)
        out.writeBytes(version)
        out.close()
        final, _ = self._files(f"{self.folder}/pointers/{batch_id:020d}")
        files.mkdirs(final.getParent())
        if files.exists(final) or not files.rename(draft, final):
            raise OSError(f"batch {batch_id} has a version already")
