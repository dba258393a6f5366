"""Small files in a folder of any store that Spark reaches, through Hadoop's file system layer."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder below; nothing if it is not there."""
        at, fs = self._at(name)
        try:
            return sorted(s.getPath().getName() for s in fs.listStatus(at))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception.getClass()):
                return []
            raise

    def read(self, name: str) -> str | None:
        at, fs = self._at(name)
        try:
            stream = fs.open(at)
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception.getClass()):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is.  Of several writers one succeeds.

        Stores with a name node create without overwriting in one step.  A local folder does not (it
        looks, then creates), so there a finished file is linked to the name."""
        at, fs = self._at(name)
        fs.mkdirs(at.getParent())
        if fs.getUri().getScheme() == "file":
            path = at.toUri().getPath()
            draft = f"{path}.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)
