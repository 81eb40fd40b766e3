"""A store of keyed rows that is merged when it is read: batches append, a manifest names what is live."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caselode.operators.incremental import last_wins
from caselode.sources import shared


class Conflict(RuntimeError):
    """Another writer swapped the manifest first; read it again and repeat."""


class VersionedStore:
    """The last row of each key, kept as deltas.

    path/data holds folders of rows, path/manifests one small file a version:
    the live folders, and the last batch number that is in them. A version
    becomes visible when its manifest is renamed into place, which fails if
    that version is there; what a writer that died left in path/data is in no
    manifest, so nobody reads it, and `vacuum` removes it.

    - `append` writes a batch's rows and no others, so its cost follows the
      batch. A batch number that is in already changes nothing.
    - `read` is the last row of each key over the live folders.
    - `compact` folds the live folders into one.
    - `vacuum` removes folders and manifests that only older versions name.

    Rows of null key are one key; rows that tie in key and order differ in
    nothing that the order knows, and any one of them stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, order: list[str]):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        found = [int(m[1]) for n in shared.names(self.spark, f"{self.path}/manifests") if (m := re.fullmatch(r"(\d+)\.json", n))]
        return max(found, default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"live": [], "batch": -1}
        return json.loads(shared.read_text(self.spark, f"{self.path}/manifests/{version:012d}.json"))

    def _swap(self, version: int, manifest: dict) -> None:
        if not shared.create_text(self.spark, f"{self.path}/manifests/{version:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {version} is there already")

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self.schema.fields]).write.parquet(f"{self.path}/data/{name}")
        return name

    def append(self, batch: DataFrame, number: int | None = None) -> bool:
        """Add a batch's rows; False if a batch of this number or a later one is in the store."""
        at = self.version()
        now = self.manifest(at)
        if number is not None and number <= now["batch"]:
            return False
        name = self._write(last_wins(batch, self.key, self.order), "delta")
        self._swap(at + 1, {"live": [*now["live"], name], "batch": now["batch"] if number is None else number})
        return True

    def read(self, version: int | None = None) -> DataFrame:
        live = self.manifest(version)["live"]
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in live]) if live else self.spark.createDataFrame([], self.schema)
        return last_wins(rows, self.key, self.order).select(*[f.name for f in self.schema.fields])

    def compact(self) -> None:
        at = self.version()
        now = self.manifest(at)
        if len(now["live"]) > 1:
            self._swap(at + 1, {"live": [self._write(self.read(at), "base")], "batch": now["batch"]})

    def vacuum(self) -> list[str]:
        """Remove what the newest version doesn't name. Only when no reader uses an older one and no writer is at work."""
        at = self.version()
        gone = sorted(set(shared.names(self.spark, f"{self.path}/data")) - set(self.manifest(at)["live"]))
        for name in gone:
            shared.remove(self.spark, f"{self.path}/data/{name}")
        for name in shared.names(self.spark, f"{self.path}/manifests"):
            if name != f"{at:012d}.json":
                shared.remove(self.spark, f"{self.path}/manifests/{name}")
        return gone


def upsert_stream(stream: DataFrame, store: VersionedStore, checkpoint: str, compact_every: int = 20) -> None:
    """Run a stream over all there is into the store: a delta each micro-batch, folded after each `compact_every` deltas.

    A micro-batch that runs again after a failure finds its number in the
    manifest, or writes anew what no manifest names.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.append(batch, number)
        if len(store.manifest()["live"]) > compact_every:
            store.compact()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
