"""Session settings and the checkpoint folder every job shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: they may be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark's default; queries with very long generated code lower it (see ``compiled``)
    "spark.sql.codegen.hugeMethodLimit": "65535",
    # session windows are merged before the shuffle, so a busy key ships
    # sessions and not its single events
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def compiled(spark: SparkSession) -> SparkSession:
    """For the next query, up to the next ``tune``: stages with long generated code run operator by operator.

    HotSpot never compiles a method of more than 8,000 bytes, so such a stage would be interpreted.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def build_session(app: str = "docketlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Used where a frame is read several times (ordered ranks, iterations), so
    the work before it runs once and survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


_staged: list[str] = []


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    For frames that are read several times: the work before runs once, each reader
    takes only its columns, and lost executors cost the tasks that read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what ``staged`` has written in this process so far; frames that read it end with this call."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    count = len(_staged)
    while _staged:
        path = hadoop(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


class Rounds:
    """A table that grows by one part in every round of an iteration; no part is written twice."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema, self.last = spark, schema, -1
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _staged.append(self.path)

    def add(self, part: DataFrame) -> None:
        self.last += 1
        part.write.parquet(f"{self.path}/round={self.last}")

    def read(self) -> DataFrame:
        """All parts, with the number of their ``round``, as one scan."""
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)
