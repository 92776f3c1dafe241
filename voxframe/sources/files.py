"""Small files on whatever file system a path names: documents, logs, listings (SK-05, SK-07, API-08)."""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Calls to a file system under way at once; each is waiting most of its time.
AT_ONCE = 16


def _write_local(data: bytes, path: str) -> None:
    """On the driver's own disk, where Hadoop would start a command for the permissions of each file and for the state of each it moves."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as out:
        out.write(data)
    folder, name = os.path.split(path)
    with contextlib.suppress(FileNotFoundError):  # a checksum of what was there before
        os.remove(f"{folder}/.{name}.crc")
    os.replace(f"{path}.part", path)


class Files:
    """Hadoop's file systems, as the session is set up for them; a path without a scheme is on the default one."""

    def __init__(self, spark: SparkSession):
        self._conf = spark._jsc.hadoopConfiguration()
        hadoop = spark._jvm.org.apache.hadoop.fs  # looking a class up by its name takes several calls
        self._path, self._context, self._utils = hadoop.Path, hadoop.FileContext, spark._jvm.org.apache.commons.io.IOUtils
        rename = hadoop.Options.Rename
        self._overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._overwrite[0] = rename.OVERWRITE
        self._default_own = hadoop.FileSystem.getDefaultUri(self._conf).getScheme() == "file"

    def _at(self, path: str) -> tuple[object, object]:
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def _own(self, path: str) -> str | None:
        """The absolute path, where it is on the driver's own disk."""
        if local := re.fullmatch(r"file:(?://)?(/.*)", path):
            return local[1]
        return os.path.abspath(path) if self._default_own and not re.match(r"[A-Za-z][\w+.-]*:", path) else None

    def exists(self, path: str) -> bool:
        if own := self._own(path):
            return os.path.exists(own)
        fs, p = self._at(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        if own := self._own(path):
            with open(own, encoding="utf-8", newline="") as f:
                return f.read()
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str, path: str) -> None:
        """Written beside and moved into place, so a reader never sees half of it."""
        if own := self._own(path):
            return _write_local(text.encode("utf-8"), own)
        _, target = self._at(path)
        fs, p = self._at(f"{path}.part")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self._context.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(p), fs.makeQualified(target), self._overwrite)

    def write_json(self, document: object, path: str) -> None:
        """SK-05."""
        self.write_text(json.dumps(document, ensure_ascii=False, indent=1, sort_keys=True), path)

    def read_json(self, path: str) -> object:
        return json.loads(self.read_text(path))

    def append_jsonl(self, document: object, path: str) -> None:
        """SK-07: one line more; the log of one dataset, so it is rewritten where a file system cannot append."""
        before = self.read_text(path) if self.exists(path) else ""
        self.write_text(before + json.dumps(document, ensure_ascii=False, sort_keys=True) + "\n", path)

    def each(self, act: Callable[..., object], calls: Iterable[tuple]) -> list:
        """What ``act(*call)`` gives for every call, ``AT_ONCE`` at a time; an error is raised.  No two calls may write one file."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [done.result() for done in [pool.submit(act, *call) for call in calls]]

    def matching(self, pattern: str) -> list[str]:
        """What a pattern of paths finds, in one listing."""
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def folders(self, path: str) -> list[str]:
        """Names of the folders right below."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def walk(self, path: str) -> list[tuple[str, int]]:
        """Every file below with its size; checksum files are not listed."""
        fs, p = self._at(path)
        out = []
        if fs.exists(p):
            each = fs.listFiles(p, True)
            while each.hasNext():
                s = each.next()
                if not s.getPath().getName().endswith(".crc"):
                    out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def modified(self, path: str) -> int:
        """Milliseconds of the last change below a path, 0 where there is nothing."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return 0
        newest, each = fs.getFileStatus(p).getModificationTime(), fs.listFiles(p, True)
        while each.hasNext():
            newest = max(newest, each.next().getModificationTime())
        return newest

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
