"""The shared folder: tables cut from their lineage, and files that tasks write and map.

The folder is the one ``spark.checkpoint.dir`` names. Only where that is unset, as in
tests on one machine, is a temporary folder made and put there.
"""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """The address of a new folder for ``what``."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="scanloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(table: DataFrame, what: str = "table") -> DataFrame:
    """``table``, computed once and read again from the shared folder."""
    path = shared_folder(table.sparkSession, what)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete what :func:`stored` wrote for ``table``, which nothing reads any more."""
    spark = table.sparkSession
    for folder in {os.path.dirname(name) for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _local(address: str) -> str | None:
    return address.removeprefix("file://") if address.startswith(("file://", "/")) else None


def put(address: str, content: bytes) -> None:
    """Write a file in one step: a task that runs twice leaves the same whole file."""
    path = _local(address)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(content)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(address)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, inner)


def mapped(address: str, dtype) -> np.ndarray:
    """A file of the shared folder as a read-only memory-mapped array; empty if there is no such file.

    From a store that cannot be mapped it is copied to a local file first, which has
    no name any more once it is mapped and so goes with the process.
    """
    path = _local(address)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(address)
        if store.get_file_info(inner).type == fs.FileType.NotFound:
            return np.empty(0, dtype)
        with store.open_input_stream(inner) as source, tempfile.NamedTemporaryFile() as copy:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy.name, dtype, "r") if copy.tell() else np.empty(0, dtype)
    return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, dtype)


def must_be_free(table: DataFrame, names) -> None:
    """Refuse names of new columns that ``table`` has already."""
    taken = {c.lower() for c in table.columns} & {name.lower() for name in names}
    if taken:
        raise ValueError(f"the table has columns named {sorted(taken)}; give others for the new ones")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session; theirs need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "scanloom_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="scanloom-")  # the driver's own; executors fetch the file from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/scanloom", "zip", os.path.dirname(package), os.path.basename(package)))
        context.scanloom_shipped = True
    return spark


def free(table: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it as long as ``table`` has such a column."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
