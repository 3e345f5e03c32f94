"""A table of parts that is replaced part by part, with a manifest for each version.

A write makes new copies of the parts that it touches, in a folder of its own, and then a
manifest that says which copy of every part is the newest; the manifest appears at once
and whole, by a rename. A read takes the newest manifest and opens just the files that it
names: as many as there are parts, however many writes there have been. Copies that the
last ``keep`` manifests do not name are removed, and so are older manifests.

A write that failed half-way left copies that no manifest names; the same version written
again replaces them, and reads the manifest before it, so it comes to the same rows.
"""

import json

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._at = hadoop.fs.Path
        self._utils = hadoop.io.IOUtils
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions that have a manifest, ascending."""
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, version: int) -> dict[str, int]:
        """The version that wrote the newest copy of each part."""
        stream = self._fs.open(self._at(f"{self.path}/manifests/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _newest(self, before: int | None = None) -> dict[str, int]:
        known = [v for v in self.versions() if before is None or v < before]
        return self.manifest(known[-1]) if known else {}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """The table as the newest manifest (of a version under ``before``) has it, or these ``parts`` of it; None if that is nothing."""
        named = {p: v for p, v in self._newest(before).items() if parts is None or int(p) in parts}
        if not named:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}/part={p}" for p, v in sorted(named.items())])

    def replace(self, rows: DataFrame, version: int) -> None:
        """``rows`` have a ``part`` column and are all rows of the parts that they touch, which get new copies."""
        folder = f"{self.path}/data/version={version}"
        rows.repartition("part").write.partitionBy("part").mode("overwrite").parquet(folder)
        written = {n.removeprefix("part="): version for n in self._names(f"data/version={version}") if n.startswith("part=")}
        text = json.dumps(self._newest(version) | written).encode()
        draft, last = self._at(f"{self.path}/manifests/{version}.draft"), self._at(f"{self.path}/manifests/{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text))
        out.close()
        self._fs.delete(last, False)
        self._fs.rename(draft, last)
        self._remove_old()

    def _remove_old(self) -> None:
        versions = self.versions()
        for v in versions[: -self.keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{v}"), False)
        named = {(p, v) for m in versions[-self.keep :] for p, v in self.manifest(m).items()}
        used = {v for _, v in named}
        for name in self._names("data"):
            v = int(name.removeprefix("version=")) if name.startswith("version=") else None
            if v is None or v > versions[-1]:
                continue
            if v not in used:
                self._fs.delete(self._at(f"{self.path}/data/{name}"), True)
                continue
            for part in self._names(f"data/{name}"):
                if part.startswith("part=") and (part.removeprefix("part="), v) not in named:
                    self._fs.delete(self._at(f"{self.path}/data/{name}/{part}"), True)
