"""Files through the file system that Spark itself uses: local, distributed or a store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    """Operations on paths of any scheme that the session's Hadoop classes know."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        """Rename; what is at `to` goes."""
        fs, p = self._at(path)
        _, q = self._at(to)
        fs.delete(q, True)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"{path} can't become {to}")

    def copy(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        gs, q = self._at(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, gs, q, False, True, self._conf)

    def time(self, path: str) -> float:
        """Seconds since 1970 of the last change."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str) -> list[str]:
        """Full paths of all files below a folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out, each = [], fs.listFiles(p, True)
        while each.hasNext():
            out.append(each.next().getPath().toString())
        return sorted(out)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        data = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(data))
        finally:
            data.close()

    def write(self, path: str, content: bytes) -> None:
        """Write beside and rename, so readers see the old content or the new."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}")
        data = fs.create(p, True)
        data.write(bytearray(content))
        data.close()
        self.move(p.toString(), path)

    def put_new(self, path: str, content: bytes) -> None:
        """Write beside and rename onto a name that must be free, else FileExistsError.
        Distributed file systems refuse a rename onto what exists; on a local one it is
        looked for just before."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}")
        _, q = self._at(path)
        data = fs.create(p, True)
        data.write(bytearray(content))
        data.close()
        if fs.exists(q) or not fs.rename(p, q):
            fs.delete(p, False)
            raise FileExistsError(path)


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors see: below the session's folder of checkpoints
    or, on a local master without one, a temporary one."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a shared folder")
    return f"{shared or tempfile.mkdtemp(prefix='gridlark-')}/work-{uuid.uuid4().hex}"
