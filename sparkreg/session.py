"""Session helpers: building a local session for tests and finding the
shared scratch folder for lineage cuts and file round trips."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkreg`` importable on executors (pandas UDFs and
    mapInPandas closures reference its functions): zip the package into
    the shared scratch folder once per application and ``addPyFile`` it."""
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # the archive only has to exist on the driver: addPyFile serves it to
    # every executor through Spark's own file server
    dest = tempfile.mkdtemp(prefix="sparkreg-pyfiles-")
    zpath = os.path.join(dest, "sparkreg.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def local_session(cores: str = "*", driver_memory: str = "8g", app: str = "sparkreg") -> SparkSession:
    """A local session for tests and the bench; clusters pass their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    b = b.config("spark.driver.memory", driver_memory)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


RUNTIME_CONF = {                      # applied only where the session left them unset
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune_session(spark: SparkSession) -> None:
    """AQE with skew-join splitting on (a hot class on the big side of a
    lookup join is split across tasks); never overrides an explicit choice."""
    for k, v in RUNTIME_CONF.items():
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 -- static confs cannot change at runtime
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; we only invent one
    (under /tmp) when the session runs in local mode and nothing is set.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="sparkreg-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file through the Hadoop FileSystem of ``path``
    (works for local, HDFS or object-store paths alike)."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Replace ``dst`` by ``src`` in one step (the last of a pointer swap):
    a reader finds the old file or the new one, never none."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, d = _fs(spark, dst)
    _, s_ = _fs(spark, src)
    ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = next(x for x in kind.getEnumConstants() if x.name() == "OVERWRITE")
    ctx.rename(fs.makeQualified(s_), fs.makeQualified(d), how)


def list_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(relative path, bytes) of every file under ``root``, any file system."""
    fs, p = _fs(spark, root)
    it = fs.listFiles(p, True)
    base = str(fs.makeQualified(p).toString()).rstrip("/") + "/"
    out = []
    while it.hasNext():
        st = it.next()
        full = str(st.getPath().toString())
        out.append((full[len(base):] if full.startswith(base) else full, int(st.getLen())))
    return sorted(out)


def cut_lineage(df: DataFrame, written: list | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: later
    passes read only the columns and rows they need, and nothing is lost with
    an executor.  The folder is added to ``written`` for ``remove``."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for tables of
    few but large rows that many jobs go through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def remove(spark: SparkSession, paths: list) -> None:
    """Delete intermediate folders that nothing reads any more."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    paths.clear()
