"""Sends the package to the Python workers, which need not share the driver's folders."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application; not needed where the package is installed or passed by --py-files."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        target = str(Path(tempfile.mkdtemp(prefix="offerlens-zip-")) / PACKAGE.name)
        spark.sparkContext.addPyFile(
            shutil.make_archive(target, "zip", PACKAGE.parent, PACKAGE.name)
        )
        _shipped.add(application)
