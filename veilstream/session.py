"""Session helpers: a local session for tests, and the folder that executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()

#: Bytes of rows that go to a Python worker at once, unless the session says otherwise. Spark's own bound is 64 MB.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, which are held twice in the JVM and once in Python; an explicit setting stays."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="veilstream-")) / "veilstream_package.zip"  # the driver serves it from here
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package on the executors and bounded Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return query(spark, *args)

    return run


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veilstream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_OWN: set[str] = set()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the application's own one in the shared folder, which goes when the driver's process ends."""
    own = f"{shared_root(spark)}/veilstream/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; what is left is in a folder of its own
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` returned. Nothing that is still to be computed may read them."""
    for df in written:
        context = df.sparkSession.sparkContext
        _delete(context._jvm, context._jsc.hadoopConfiguration(), df._written)
