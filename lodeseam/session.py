"""Sessions, and tables that cut lineage.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all executors share, so that a lost executor
costs only the tasks it ran. Where the setting is missing, a session on one machine (local[...]) takes a temporary
folder; a cluster is refused, as its machines would each write to a folder of their own.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeseam")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is named."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not there:
        there = getattr(spark.sparkContext, "_lodeseam_dir", None) or tempfile.mkdtemp(prefix="lodeseam-")
        spark.sparkContext._lodeseam_dir = there
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodeseam/{name}-{uuid.uuid4().hex[:12]}"
    getattr(_scopes, "open", [_made])[-1].append((spark, path))
    return path


@contextmanager
def released() -> Iterator[None]:
    """Within it, scratch paths of this thread are removed at the end: for work whose results are collected or written there."""
    own: list[tuple[SparkSession, str]] = []
    before = getattr(_scopes, "open", [_made])
    _scopes.open = [*before, own]
    try:
        yield
    finally:
        _scopes.open = before
        for spark, path in own:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a plan without history."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where the folder is missing."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all (written beside, then renamed)."""
    fs, p = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole, unless one of that name is there: then False. The file system decides between two at once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part = f"{path}.{uuid.uuid4().hex}.part"
    put_text(spark, part, text)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path), none)
    except Py4JJavaError:
        remove(spark, part)
        if exists(spark, path):
            return False
        raise
    return True


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session may be gone
            pass


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodeseam_shipped", False):
        sc._lodeseam_shipped = True
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lodeseam-zip-")) / "lodeseam.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
    return spark
