"""Send this package to the executors.

Python functions that Spark runs on executors are pickled by module name, so
the workers must be able to import the package although no executor has the
folder of the driver.
"""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import SparkSession

#: Rows that cross between Spark and Python at once where they hold texts or sets of shingles.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as an archive to the session's Python files, once per application.

    The archive lies in a folder of the driver only until Spark has taken it:
    executors fetch it from the driver's file server.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(os.path.realpath(tempfile.mkdtemp())) / f"{package.name}.zip"
    with ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """From now on, this session's batches for Python hold BATCH_ROWS rows, or fewer if it says so.

    Spark's default of 10,000 texts, or pairs of sets, takes 30 to 60 MB, in the
    executor's native memory as well as in its worker.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
