"""Making the library known to the Python workers, and the folder that all nodes share."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of this process; they go with it.
_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def own_folder(what: str) -> str:
    if what not in _OWN:
        _OWN[what] = tempfile.TemporaryDirectory(prefix="fathom-")
    return _OWN[what].name


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application; the driver serves the archive."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    path = os.path.join(own_folder("code"), "fathom.zip")
    if not os.path.exists(path):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where none is named, as in tests, one of this machine that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"file:{own_folder('shared')}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: what follows doesn't work them out again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
