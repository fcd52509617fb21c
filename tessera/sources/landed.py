"""A Python data source for rows that collectors leave as JSON lines: ``spark.read.format("tessera_landed")``."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Source(InputPartition):
    def __init__(self, name: str, path: str):
        self.name, self.path = name, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.sources = [s for s in options.get("sources", "").split(",") if s]

    def partitions(self):
        """One partition for each file of each source folder; only names are listed on the driver."""
        from pathlib import Path

        folders = [Path(self.root) / s for s in self.sources] if self.sources else sorted(p for p in Path(self.root).iterdir() if p.is_dir())
        return [_Source(f.name, str(file)) for f in folders if f.is_dir() for file in sorted(f.glob("*.jsonl"))]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as lines:
            for pos, line in enumerate(lines):
                if line.strip():
                    yield partition.name, pos, line.rstrip("\n")


class LandedSource(DataSource):
    """Options: ``path`` (a folder all executors can read, with one folder per source), ``sources`` (names, optional)."""

    @classmethod
    def name(cls):
        return "tessera_landed"

    def schema(self):
        return "source string, pos long, payload string"

    def reader(self, schema):
        return _Reader(self.options)
