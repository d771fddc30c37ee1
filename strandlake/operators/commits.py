"""The log of a collection: one small file per commit, made only if it is not there yet.

A writer reads the latest state, writes its data under a name of its own, and then tries to create the next file of the log.
Whoever creates it first has committed; all others find it there, read the new state and start again from that. Data of
a name that no commit lists is never read. Each file holds the whole state, so opening a collection reads one file.

Creation is atomic where the file system has it: a hard link on local and mounted folders, else a rename, which must
refuse an existing target, as that of HDFS does.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_NAME = re.compile(r"(\d{10})\.json$")


class Log:
    """The commits of a collection under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = f"{path.rstrip('/')}/_log"

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self._conf), path

    def numbers(self) -> list[int]:
        fs, folder = self._at(self.folder)
        if not fs.exists(folder):
            return []
        return sorted(int(m[1]) for x in fs.listStatus(folder) if (m := _NAME.search(x.getPath().getName())))

    def read(self, number: int) -> dict:
        fs, path = self._at(f"{self.folder}/{number:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """Number and state of the last commit; -1 and nothing where there is none."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (-1, None)

    def commit(self, number: int, state: dict) -> bool:
        """Make ``state`` that of commit ``number``; false if another writer has made it already."""
        fs, draft = self._at(f"{self.folder}/_{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        _, target = self._at(f"{self.folder}/{number:010d}.json")
        try:
            uri = fs.makeQualified(target).toUri().toString()
            if uri.startswith("file:"):
                os.link(_local(fs.makeQualified(draft).toUri().toString()), _local(uri))
                return True
            return not fs.exists(target) and bool(fs.rename(draft, target))
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)

    def remove(self, path: str) -> None:
        """Delete data that no commit lists."""
        fs, folder = self._at(path)
        fs.delete(folder, True)


def _local(uri: str) -> str:
    return unquote(urlparse(uri).path)
