"""Session settings the operators are planned for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime (not static) settings: AQE decides join strategy from real sizes and
# splits partitions of a hot key, also where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Files are packed many times over, so that their sizes alone would have tables broadcast that
    # fill the driver; the size of rows decides, once a stage has made them.
    "spark.sql.sources.fileCompressionFactor": "32",
    # Text work is heavy per byte, so small shuffles keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Whole pages and tables go to Python, so a batch holds few of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Java's letters; ICU takes several times as long for texts that are not ASCII.
    "spark.sql.icu.caseMappings.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "corpusmill", memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import it by name; a zip that Spark distributes serves them wherever the
    driver found it.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusmill-code-"), "corpusmill.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


_shipped: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names a folder every executor can reach in that setting. Only a
    local master without the setting (tests) falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="corpusmill-")
    return os.path.join(base, f"{name}-{spark.sparkContext.applicationId}-{os.urandom(4).hex()}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, to cut its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
