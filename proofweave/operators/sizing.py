"""Size checks before broadcasts, and lineage cuts through written tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofweave.session import ensure_checkpoint_dir

#: Spark drops an execution's shuffle files when it ends, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Chunk rows that blocks of questions may meet at once, whatever the number of chunks.
COPIES_AT_ONCE = 2_000_000

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_dropping: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


def broadcast_if_small(frame: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows`` + 1 rows.

    Larger inputs are returned unhinted, which leaves an ordinary shuffled
    join. Use it on narrow frames whose rows have a bounded width.
    """
    if frame.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(frame)
    return frame


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside leave no shuffle files; the session's setting is restored.

    Several threads may be inside at once. Another's execution begun meanwhile drops its
    files too; where it is run again Spark makes them anew.
    """
    key = spark.sparkContext.applicationId
    with _lock:
        inside, before = _dropping.get(key, (0, spark.conf.get(DROP_SHUFFLES, None)))
        _dropping[key] = (inside + 1, before)
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = _dropping.pop(key)
            if inside > 1:
                _dropping[key] = (inside - 1, before)
            elif before is None:
                spark.conf.unset(DROP_SHUFFLES)
            else:
                spark.conf.set(DROP_SHUFFLES, before)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` below the shared checkpoint folder and read it back.

    Unlike a cache it survives lost executors, and unlike an RDD checkpoint it
    keeps column pruning and filter pushdown. Zstandard takes about a third less
    disk than the default. Nobody reads the shuffles of the write again, so they go with it.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/proofweave/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        frame.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(frame.schema).parquet(path)
    _written[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, so that the disk holds only what is read again.

    No frame that is still to be run may read them.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def blocks_at_once(held: list[tuple[int, int]]) -> int:
    """Blocks of a tenant that meet its chunks at once, for ``held`` (blocks of a tenant, chunks of such tenants).

    As many as make two copies of all chunks together, or COPIES_AT_ONCE if that is more.
    """
    room = max(COPIES_AT_ONCE, 2 * sum(chunks for _, chunks in held))
    at_once = max((blocks for blocks, _ in held), default=1)
    while at_once > 1 and sum(chunks * min(blocks, at_once) for blocks, chunks in held) > room:
        at_once -= 1
    return at_once


def in_slices(
    blocks: DataFrame,
    chunks: DataFrame,
    rows_of: Callable[[Column], tuple[DataFrame, ...]],
    run: Callable[..., DataFrame],
    name: str,
) -> DataFrame:
    """``run`` over the rows of all ``blocks`` (enterprise_id, their number), some of a tenant's at a time.

    ``rows_of`` maps a column, the array of the block numbers that take part, to the frames
    that ``run`` takes. What one slice shuffles ends before the next, so the disk never holds a
    copy of its ``chunks`` for each block of a large tenant.
    """
    counts = chunks.groupBy("enterprise_id").agg(F.count(F.lit(1)).alias("chunks"))
    held = blocks.join(counts, "enterprise_id").groupBy("blocks").agg(F.sum("chunks").alias("chunks")).collect()
    held = [(row["blocks"], row["chunks"]) for row in held]  # a row for each number of blocks
    at_once, most = blocks_at_once(held), max((number for number, _ in held), default=1)

    def part(low: int) -> DataFrame:
        last = F.least(F.col("blocks") - 1, F.lit(low + at_once - 1))
        numbers = F.when(last >= low, F.sequence(F.lit(low).cast("long"), last.cast("long")))
        return run(*rows_of(numbers))

    if most <= at_once:
        return part(0)
    return reduce(DataFrame.unionByName, [materialize(part(low), name) for low in range(0, most, at_once)])


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Use every core when a scan fills fewer partitions than the cluster has cores.

    A file of one row group fills one partition, however many it is split into;
    row counts come from footers alone. Inputs of cluster size pass unchanged.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    filled = frame.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return frame.repartition(cores, *keys) if filled < cores else frame


def together(*actions: Callable[[], None]) -> None:
    """Run independent Spark actions at once, so that small jobs share the cores.

    Returns when all have ended; the first failure is raised then.
    """
    with ThreadPoolExecutor(len(actions)) as pool:
        running = [pool.submit(inheritable_thread_target(action)) for action in actions]
    for action in running:
        action.result()
