"""Files that only one writer can create, by what each kind of store offers.

A commit is a small file with a number as its name. Of several writers that
make the same number exactly one succeeds; the others see :class:`Taken`. No
store's rename has to be atomic for this, except where a rename is the means.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has created the file."""


def hadoop(spark: SparkSession, path: str):
    """The path as Hadoop's, and its filesystem."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    found, fs = hadoop(spark, path)
    stream = fs.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, stream, text: str) -> None:
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()  # object stores create the file here


def by_link(spark: SparkSession, path: str, text: str) -> None:
    """Local and mounted folders: a hard link to a complete file fails if its name exists."""
    target = re.sub("^file:/*", "/", path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
    with open(draft, "x", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, target)
    except FileExistsError:
        raise Taken(path) from None
    finally:
        os.unlink(draft)


def by_rename(spark: SparkSession, path: str, text: str) -> None:
    """HDFS: the name node renames a complete file only onto a free name."""
    target, fs = hadoop(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    _write(spark, fs.create(draft, False), text)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Exception:
        fs.delete(draft, False)
        raise


def by_condition(spark: SparkSession, path: str, text: str) -> None:
    """S3: the upload carries the condition that the key does not exist (Hadoop 3.4.2 and later)."""
    target, fs = hadoop(spark, path)
    builder = fs.createFile(target).must("fs.option.create.conditional.overwrite", True)
    _write(spark, builder.build(), text)


def by_create(spark: SparkSession, path: str, text: str) -> None:
    """Stores whose connector creates without overwriting by a condition that the store itself checks."""
    target, fs = hadoop(spark, path)
    _write(spark, fs.create(target, False), text)


Publisher = Callable[[SparkSession, str, str], None]
PUBLISHERS: dict[str, Publisher] = {
    "file": by_link, "hdfs": by_rename, "s3a": by_condition, "abfs": by_create, "abfss": by_create, "gs": by_create,
}


def register_publisher(scheme: str, publisher: Publisher) -> None:
    """Teach the library a further store; ``publisher(spark, path, text)`` must be exclusive."""
    PUBLISHERS[scheme] = publisher


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Create the file with this text, or raise :class:`Taken`; ``text`` differs from what any other writer would write.

    A store that is not known to create exclusively is refused.
    """
    target, fs = hadoop(spark, path)
    scheme = target.toUri().getScheme() or fs.getUri().getScheme()
    if scheme == "viewfs":  # a mount table: what lies behind decides
        parent = target.getParent()
        fs.mkdirs(parent)
        path = f"{fs.resolvePath(parent).toString()}/{target.getName()}"
        scheme = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getScheme()
    if scheme not in PUBLISHERS:
        raise ValueError(f"no way is known to create files exclusively on {scheme}; see register_publisher")
    try:
        PUBLISHERS[scheme](spark, path, text)
    except Taken:
        raise
    except Exception as error:
        # An answer can be lost after the file was made, so what lies there counts.
        try:
            there = read_text(spark, path)
        except Exception:  # noqa: BLE001 - nothing there, so the first error is the one to tell
            raise error from None
        if there != text:
            raise Taken(path) from error
