"""Where jobs may put intermediate files."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A folder for ``name`` that every executor can reach.

    ``base`` names the shared folder; else it is the one in ``spark.checkpoint.dir``, or the one that the context was
    given by ``setCheckpointDir``.  Only a session on a local master may have none of them: it gets a
    temporary folder, which is removed when Python ends.  The session's settings are never changed.
    """
    context = spark.sparkContext
    shared = base or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local["):
            raise ValueError("name a shared folder: spark.checkpoint.dir is not set")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="castwright-")
            atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
        shared = _LOCAL[context.applicationId]
    return f"{shared.rstrip('/')}/castwright-{context.applicationId}/{name}"
