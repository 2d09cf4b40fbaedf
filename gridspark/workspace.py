"""Files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a new local folder where that is unset and all run on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="gridspark-")
    return at.rstrip("/")


def new_file(spark: SparkSession, name: str, sheets: dict[str, dict[str, Any]]) -> str:
    """Writes a workbook below `spark.checkpoint.dir` (unset: a local folder, in tests) and gives its path."""
    from pyarrow import fs

    from gridspark.sources.xlsx_builder import workbook

    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    data = workbook(sheets)
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(data)
    return path
