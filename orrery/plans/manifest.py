"""A loop's finished passes, so that a restarted driver goes on from the last (ITR7, SRC7).

A folder that outlives the driver holds the passes' tables and a file per finished pass, which is renamed into place when
all that it names has been written.  A pass that was cut short leaves no file, and is done again.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """The files pass-N.json of a folder that all machines share; what they say is the loop's own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _name(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def last(self) -> tuple[int, dict] | None:
        """(number, what it said) of the last finished pass."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._name("."))]
        done = [int(n[5:-5]) for n in names if n.startswith("pass-") and n.endswith(".json")]
        if not done:
            return None
        text = self._spark.read.text(f"{self.folder}/pass-{max(done)}.json", wholetext=True).first()[0]
        return max(done), json.loads(text)

    def finish(self, number: int, what: dict) -> None:
        """Pass number is done; all that ``what`` names is written."""
        part = self._name(f".pass-{number}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        self._fs.delete(self._name(f"pass-{number}.json"), False)
        if not self._fs.rename(part, self._name(f"pass-{number}.json")):
            raise OSError(f"pass {number} couldn't be written to {self.folder}")
