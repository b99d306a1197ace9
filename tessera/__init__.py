"""A versioned, ordered key-value engine on Spark DataFrames."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-code-")  # the driver's; Spark hands the archive to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, here)))
    sc.addPyFile(path)
