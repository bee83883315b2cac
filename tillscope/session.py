"""Spark session settings for local runs and tests.

On a cluster the platform's own settings win: ``local_session`` is for
development, tests and the bench.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    # AQE: coalesce small shuffle partitions, split skewed join partitions,
    # and switch to a broadcast join when a side's measured size is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark's own broadcasts for tiny sides only; larger ones are explicit,
    # behind measured sizes (plans.joins)
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    # partitions under this size are joined by a hash table instead of a sort
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call site for every column expression: a quarter of the time of building a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g",
                  app_name: str = "tillscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 executor_memory_gb: float = 16.0) -> dict[str, str]:
    """Settings sized for a cluster run over ``input_bytes`` of Parquet input.

    * File splits of 512 MiB: about 200,000 scan tasks for 100 TiB, large
      enough to amortise task start-up, small enough to stay in memory.
    * Initial shuffle partitions: one per GiB of input (the largest shuffle
      is the column-pruned item side of the payment join, well under the
      input size), at least 3 waves of the cluster's cores and at most
      200,000 so that map × reduce block counts stay manageable.  AQE then
      coalesces towards 256 MiB and splits skewed partitions.
    * Broadcast limit: 1/64 of executor memory, at most 1 GiB — the cap that
      ``plans.joins.checked_broadcast`` applies to measured sizes.
    """
    slots = max(1, executors * cores_per_executor)
    partitions = min(200_000, max(3 * slots, -(-input_bytes // 1024 ** 3)))
    broadcast = int(min(1024 ** 3, executor_memory_gb * 1024 ** 3 / 64))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "1MB",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "256MB",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
        "spark.tillscope.broadcastMaxBytes": str(broadcast),
    }
