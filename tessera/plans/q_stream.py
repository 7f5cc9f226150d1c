"""The streaming panel: days that the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources.shared import own_path
from tessera.streaming.daily import daily_stream, run_available, stream_of


def _daily(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    own = own_path(spark, "stream")
    run_available(daily_stream(stream_of(spark, f"{sf_dir}/events.parque[t]", schema)), f"{own}/sink", f"{own}/checkpoint")
    return spark.read.parquet(f"{own}/sink").withColumn("y", F.round("y", 4))


QUERIES["stream_daily_closed"] = _daily
# a day is closed once the watermark, a day behind the latest event, has passed its end
ORACLES["stream_daily_closed"] = "select event_type, cast(ts as date) as day, count(*) as n, round(sum(value), 4) as y from events where cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2"
