"""Parsed records that are kept between scans, by the path, size and time of their file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import children, remove
from tessera.sources import files

KEYS = ["workspace", "path", "size", "mtime"]
SCHEMA = "workspace string, path string, size long, mtime timestamp, kind string, parsed string"


class ParseCache:
    """Generations of a table: a row for each file and reader, and one without a kind for each file that has nothing.

    A scan parses the files that the last generation doesn't have as they are
    now, and writes the next one; the last but one stays for readers that still use it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _generations(self) -> list[int]:
        return sorted(int(n.removeprefix("generation=")) for n in children(self.spark, self.folder) if n.startswith("generation="))

    def rows(self) -> DataFrame:
        at = self._generations()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/generation={at[-1]}") if at else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        at = self._generations()
        rows.select(*[F.col(c) for c in self.spark.createDataFrame([], SCHEMA).columns]).write.parquet(f"{self.folder}/generation={at[-1] + 1 if at else 0}")
        for n in at[:-1]:
            remove(self.spark, f"{self.folder}/generation={n}")

    def scan(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame], relist: Callable[[], DataFrame] | None = None) -> DataFrame:
        """Parsed records (workspace, path, kind, parsed) of all listed files.

        ``read`` gives the text of listed files, ``parse`` the records of texts,
        ``relist`` the listing after the scan: records of files that changed
        meanwhile are given but not kept, so the next scan reads them again.
        """
        old = self.rows()
        fresh = files.changed(listing, old)
        records = parse(read(fresh))
        new = fresh.select(*KEYS).join(records, ["workspace", "path"], "left")
        whole = files.unchanged(old, listing).select(*KEYS, "kind", "parsed").unionByName(new.select(*KEYS, "kind", "parsed"))
        self._write(whole)
        out = self.rows()
        if relist is not None:
            kept = files.unchanged(out, relist())
            if kept.count() < out.count():
                self._write(kept)
        return out.where("kind IS NOT NULL").select("workspace", "path", "kind", "parsed")
