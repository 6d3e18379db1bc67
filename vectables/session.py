"""Session helpers: a local session for tests and the bench, and the shared storage root."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vectables") -> SparkSession:
    """A local session configured like the cluster one, minus the cluster.

    AQE stays on so broadcast decisions are taken from runtime sizes, not guesses.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # coalesce shuffles by size, not down to one task per core: row-heavy but byte-light
        # shuffles (aggregated runs, hits) keep several tasks
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VECTABLES_DRIVER_MEMORY", "16g"))
        # numpy kernels run one per task: keep BLAS single-threaded so workers do not oversubscribe
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.MKL_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class _Inline:
    """Stand-in for a broadcast variable where the session has no SparkContext (Spark Connect):
    the value travels inside the task closure instead."""

    def __init__(self, value):
        self.value = value


def ship(spark: SparkSession, value):
    """Broadcast ``value`` (a parameter-bounded object: a query chunk, pivots) to the executors;
    ``.value`` reads it inside a task."""
    try:
        return spark.sparkContext.broadcast(value)
    except Exception:  # noqa: BLE001 - no SparkContext in this session
        return _Inline(value)


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect
        return None


def parallelism(spark: SparkSession) -> int:
    """Tasks that the session runs at once, as far as it knows (Spark Connect: its number of shuffle partitions)."""
    sc = _context(spark)
    return sc.defaultParallelism if sc is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))


def storage_root(spark: SparkSession) -> str:
    """Shared folder for tables, versions, snapshots and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared folder there),
    then the context's checkpoint directory. Only a local-mode session with neither gets a fresh
    temporary folder, as in tests; on a cluster that is an error, never a machine-local folder.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        master = (sc.master if sc else spark.conf.get("spark.master", "")) or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="vectables-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)   # Dataset.checkpoint() writes below the same root
    return root.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vectables`` importable on the executors' Python workers (they unpickle the kernels
    of mapInArrow / applyInPandas / foreachBatch by reference), once per application: the package
    is zipped on the driver and distributed with ``addPyFile`` (``addArtifacts`` on Spark Connect).
    Not needed where the package is installed on every worker."""
    sc = _context(spark)
    key = sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")
    if key in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="vectables-code-"), "vectables")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="vectables")
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(key)
