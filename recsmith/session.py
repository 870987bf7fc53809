"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A folder of our own is set only when the
setting is absent and the master is local (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "recsmith") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECSMITH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset and Spark runs in local mode (tests) a scratch folder is
    created; on a cluster an unset value is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="recsmith-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def size_shuffle_partitions(spark: SparkSession, input_bytes: int, target_bytes: int = 256 * 1024 * 1024,
                            min_partitions: int | None = None, expansion: float = 3.0,
                            max_partitions: int = 200_000) -> int:
    """Size ``spark.sql.shuffle.partitions`` from the input volume.

    Parquet expands in memory (``expansion``); aim for ``target_bytes`` of shuffle data
    per reducer so partitions fit executor memory without spilling, never fewer than
    the cluster's cores.  AQE then coalesces small partitions and splits skewed ones
    around the same advisory size.
    """
    cores = spark.sparkContext.defaultParallelism
    want = int(input_bytes * expansion // target_bytes) + 1
    # most plans aggregate map-side before the shuffle; the cap keeps the reducer count
    # (and the driver's task bookkeeping) sane at 100 TB, AQE splits what is still large
    n = min(max(want, min_partitions or cores), max_partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(target_bytes, 128 * 1024 * 1024)))
    return n


def folder_bytes(path: str) -> int:
    """Total size of the files under a local or mounted folder."""
    total = 0
    for root, _, files in os.walk(path):
        for f in files:
            total += os.path.getsize(os.path.join(root, f))
    return total


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``recsmith`` importable in the Python workers (the ``--py-files`` mechanism).

    Arrow UDFs and ``mapInPandas`` functions reference helpers of this package, so the
    executors need it on their path whatever the caller's working directory is.  The
    package is zipped once per driver process and added once per SparkContext.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="recsmith-pyfiles-"), "recsmith.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
