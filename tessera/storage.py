"""Files of any store: on the driver by Hadoop's file systems, in tasks by Arrow's."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Files of a tree from which on copies run side by side.
SIDE_BY_SIDE = 2
META = "zarr.json"


class Store:
    """Driver-side file operations; every path may name its own file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def read(self, path: str) -> bytes:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        """Without overwrite an existing file raises FileExistsError; the store decides who of several is first."""
        fs, target = self._at(path)
        try:
            stream = fs.create(target, overwrite)
        except Exception as problem:
            if not overwrite and fs.exists(target):
                raise FileExistsError(path) from problem
            raise
        stream.write(bytearray(data))
        stream.close()

    def delete(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.delete(target, True)

    def rename(self, old: str, new: str) -> None:
        fs, target = self._at(old)
        if not fs.rename(target, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def replace(self, new: str, path: str) -> None:
        """Puts a finished file or directory in the place of another."""
        old = f"{path}._old"
        if self.exists(path):
            self.rename(path, old)
        self.rename(new, path)
        self.delete(old)

    def files(self, root: str, recursive: bool = True) -> Iterator[tuple[str, int]]:
        """Path below root and size of each file."""
        if not self.exists(root):
            return
        fs, target = self._at(root)
        base = fs.resolvePath(target).toUri().getPath().rstrip("/")
        found = fs.listFiles(target, recursive)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toUri().getPath()[len(base) + 1 :], status.getLen()

    def folders(self, path: str) -> list[str]:
        """Names of the directories in a directory."""
        if not self.exists(path):
            return []
        fs, target = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())

    def copy(self, source: str, target: str) -> None:
        """One file from any store to any other."""
        (fs_a, a), (fs_b, b) = self._at(source), self._at(target)
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, self._conf):
            raise OSError(f"{source} could not be copied to {target}")

    def preflight(self, path: str) -> None:
        """An error unless a file can be made and removed beside the path."""
        probe = f"{path.rstrip('/')}._probe"
        self.write(probe, b"x")
        self.delete(probe)

    def upload_tree(self, source: str, target: str, keep_metadata: bool = True, workers: int = 4) -> int:
        """Copies a finished directory; returns the number of files copied.

        With keep_metadata an array's metadata stay where the target's first dimension is as long or longer, so an older
        part that arrives late doesn't shorten the array.
        """
        names = [n for n, _ in self.files(source)]
        wanted = [n for n in names if not (keep_metadata and n.rsplit("/", 1)[-1] == META and self._longer(f"{target}/{n}", f"{source}/{n}"))]
        with ThreadPoolExecutor(workers if len(wanted) > SIDE_BY_SIDE else 1) as pool:
            list(pool.map(lambda n: self.copy(f"{source}/{n}", f"{target}/{n}"), wanted))
        return len(wanted)

    def _longer(self, stored: str, new: str) -> bool:
        if not self.exists(stored):
            return False
        a, b = (json.loads(self.read(p)).get("shape") for p in (stored, new))
        return bool(a and b and a[0] >= b[0])

    def complete_output(self, built: str, target: str) -> dict:
        """Brings finished output to where it belongs: nothing to do in place, a rename in one file system, else a copy."""
        if built.rstrip("/") == target.rstrip("/"):
            return {"route": "in place", "files": 0}
        if self._at(built)[0].getUri().toString() == self._at(target)[0].getUri().toString() and not self.exists(target):
            n = sum(1 for _ in self.files(built))
            self.rename(built, target)
            return {"route": "renamed", "files": n}
        n = self.upload_tree(built, target)
        self.delete(built)
        return {"route": "copied", "files": n}


def arrow_file(path: str):
    """Arrow's file system and path for a task; s3a: and local paths included."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
