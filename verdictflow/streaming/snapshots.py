"""A sink of versioned snapshots (J2): readers see one whole version or the one before, never a mixture.

Each version is a folder of its own, written before anything refers to it. The file ``_pointer`` in the
sink names the batch that is current and the folders that hold it; it is replaced in one rename. A
micro-batch that Spark repeats after a crash finds its number in the pointer and changes nothing; one
that crashed before the rename left a folder that nothing refers to, which a later version removes.
Folders of superseded versions stay for ``keep`` further versions, for readers that are bound to them.

The pointer needs a file system whose rename replaces the target at once (HDFS, local disks). There is one
writer, the streaming query that owns the checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_AFTER = 32  # folders of changed groups that a reader merges at most


class SnapshotSink:
    """The sink in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def pointer(self) -> dict | None:
        """{batch, folders, old}: what is current; None before the first version."""
        fs, at = self._fs(), self._path("_pointer")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _replace_pointer(self, pointer: dict) -> None:
        fs, new = self._fs(), self._path(f"_pointer-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        how = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        replace = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 1)
        replace[0] = self.spark._jvm.java.lang.Enum.valueOf(how, "OVERWRITE")
        context = self.hadoop.FileContext.getFileContext(new.toUri(), self.conf)
        context.rename(context.makeQualified(new), context.makeQualified(self._path("_pointer")), replace)

    def commit(self, batch_id: int, write: Callable[[str], None], extend: bool = False,
               merge: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Makes the folder that ``write`` fills version ``batch_id``; False if it is known already.

        With ``extend`` the version holds the earlier folders, too; after ``COMPACT_AFTER`` of them
        ``merge`` (rows with ``batch_id`` -> rows) gives one folder in their place.
        """
        now = self.pointer() or {"batch": -1, "folders": [], "old": []}
        if batch_id <= now["batch"]:
            return False
        folder = f"v-{batch_id}-{uuid.uuid4().hex[:8]}"
        write(f"{self.path}/{folder}")
        folders = [*now["folders"], [batch_id, folder]] if extend else [[batch_id, folder]]
        if extend and merge is not None and len(folders) > COMPACT_AFTER:
            whole = f"v-{batch_id}-{uuid.uuid4().hex[:8]}"
            merge(self.rows(folders)).write.parquet(f"{self.path}/{whole}")
            folders = [[batch_id, whole]]
        held = {f for _, f in folders}
        dropped = [f for _, f in now["folders"] if f not in held]
        old = [*now["old"], *([[batch_id, dropped]] if dropped else [])]
        self._replace_pointer({"batch": batch_id, "folders": folders, "old": old[-self.keep:]})
        self._clean(held | {f for _, some in old[-self.keep:] for f in some}, batch_id)
        return True

    def _clean(self, held: set[str], batch_id: int) -> None:
        """Removes folders of this sink that no version refers to any more."""
        fs = self._fs()
        for status in fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in held and int(name.split("-")[1]) <= batch_id:
                fs.delete(status.getPath(), True)

    def rows(self, folders: Sequence | None = None) -> DataFrame:
        """The current version with ``batch_id`` (of the folder), bound to its folders when called."""
        if folders is None:
            now = self.pointer()
            if now is None:
                raise FileNotFoundError(f"{self.path} holds no version yet")
            folders = now["folders"]
        number = F.create_map(*[F.lit(x) for b, f in folders for x in (f, int(b))])
        found = self.spark.read.parquet(*[f"{self.path}/{f}" for _, f in folders])
        name = F.regexp_extract(F.input_file_name(), "/(v-[0-9]+-[0-9a-f]+)/", 1)
        return found.withColumn("batch_id", F.element_at(number, name).cast("long"))
