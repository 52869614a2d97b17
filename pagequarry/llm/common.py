"""What several operators share: shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_scratch: dict[str, str] = {}
#: Folders made by this program, and the configuration of the file system that holds them.
_made: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local master gets a
    temporary folder (one machine, removed at exit) and any other master the
    warehouse, which is shared by definition.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local-") and spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _own_scratch:
            _own_scratch[app] = tempfile.mkdtemp(prefix="pagequarry-")
            atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
        return f"file://{_own_scratch[app]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder; what is in it goes when the program ends."""
    if not _made:
        atexit.register(remove_made)
    path = f"{shared_dir(spark)}/pagequarry-{label}-{uuid.uuid4().hex}"
    _made[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return path


def remove_made(folders: list[str] | None = None) -> None:
    """Delete folders of :func:`new_folder`, all by default."""
    jvm = SparkContext._jvm
    for name in list(_made) if folders is None else folders:
        conf = _made.pop(name, None)
        if jvm is None or conf is None:
            continue
        try:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        except (Py4JError, OSError):  # the gateway has ended before the program
            return


@contextmanager
def shuffle_files_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end, not at some later collection."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors: the commit is
    atomic and every executor can read the files.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with shuffle_files_end_with_query(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a :func:`stage_table` that nothing reads any more."""
    files = {name.rsplit("/", 1)[0].rsplit("/", 1)[-1] for name in df.inputFiles()}
    remove_made([name for name in _made if name.rsplit("/", 1)[-1] in files])


def _smallest_of_each(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph with the given ``src``/``dst`` long columns.

    Returns ``node, component`` for every node on an edge, ``component`` being
    the smallest node reachable.  Alternating large-star and small-star rounds:
    each round is two aggregations with map-side partial results and two joins
    whose large side adaptive execution may split, so a node with very many
    links is no single task's work.  The edge list is rewritten to the shared
    folder each round; nothing is collected but one checksum.
    """
    def star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_smallest_of_each(both), "u")
            .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: every node points to smaller ones only
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = low.join(low.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        return small.distinct().select(F.col("u").alias("src"), F.col("v").alias("dst"))

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.max("dst")).first())

    current = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    current = stage_table(current, "edges")
    seen = mark(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        previous, current = current, stage_table(star(current), "edges")
        drop_stage(previous)
        now = mark(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
