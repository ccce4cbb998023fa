"""Plans that run as streams over the tables' files, each against a batch rule of its own."""

from pyspark.sql import functions as F

from offerloom.operators import tables
from offerloom.plans.dialect import OFFER, frame, run_text
from offerloom.streaming import alerts, offers

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sightings(spark, sf_dir):
    """lineitem's file as a stream of sightings: product_id, seen_at, cents."""
    path = f"{sf_dir}/lineitem.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since a stream's path must be a folder or a pattern
    return rows.selectExpr("l_partkey as product_id", "cast(l_shipdate as timestamp) as seen_at", "cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) as cents")


def _drained(spark, stream, name):
    """All that a stream gives of what is there now, written to the shared folder and read again."""
    path, before = f"{tables.scratch(spark, name)}", spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


#: A day is told once the watermark, two days behind the last sighting, has passed it.
_CLOSED = "(SELECT CAST(max(l_shipdate) AS DATE) - INTERVAL 3 DAY FROM lineitem)"
_SEEN = "SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS day, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS cents FROM lineitem"


@frame("k01_daily_low_stream", f"SELECT product_id, day AS observed_on, min(cents) AS cents, CAST(count(*) AS BIGINT) AS sightings FROM ({_SEEN}) s WHERE day <= {_CLOSED} GROUP BY product_id, day")
def k01(spark, sf_dir):
    return _drained(spark, offers.daily_low(_sightings(spark, sf_dir)), "daily-low")


ALERTS = """SELECT c_custkey AS alert_id, c_custkey % 2000 + 1 AS product_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(90000 + floor(c_acctbal * 10) AS BIGINT) END AS target, CASE WHEN c_custkey % 3 = 1 THEN CAST(95000 + c_custkey AS BIGINT) END AS reference,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(150000 AS BIGINT) END AS notified, CASE WHEN c_custkey % 5 > 0 THEN CAST(o.day AS DATE) END AS confirmed_on FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS day FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey"""
#: A price is told if it is worth it and no earlier one that was worth it, nor the one told before, is as low.
_TOLD = f"""WITH a AS ({ALERTS}), p AS (SELECT product_id, day, min(cents) AS cents FROM ({_SEEN}) s GROUP BY product_id, day), w AS (SELECT a.alert_id, p.day, p.cents, a.notified FROM a JOIN p ON p.product_id = a.product_id AND p.day BETWEEN a.confirmed_on AND a.confirmed_on + INTERVAL 183 DAY
  WHERE CASE WHEN a.target IS NOT NULL THEN p.cents <= a.target WHEN a.reference IS NOT NULL THEN p.cents < a.reference ELSE TRUE END)
SELECT alert_id, day, cents FROM w WHERE (notified IS NULL OR cents < notified) AND NOT EXISTS (SELECT 1 FROM w e WHERE e.alert_id = w.alert_id AND e.day < w.day AND e.cents <= w.cents)"""


@frame("k02_alert_messages", _TOLD)
def k02(spark, sf_dir):
    """Messages of price alerts over all days."""
    prices = run_text(spark, sf_dir, f"WITH {OFFER} SELECT product_id, CAST(seen AS TIMESTAMP) AS seen_at, wide AS cents FROM offer")
    return alerts.told(prices, run_text(spark, sf_dir, ALERTS))


@frame("k02_alert_stream", f"{_TOLD} AND day <= {_CLOSED}")
def k02_stream(spark, sf_dir):
    """The same by a stream with state and timers, up to the day that its watermark has passed."""
    return _drained(spark, alerts.tell(_sightings(spark, sf_dir), run_text(spark, sf_dir, ALERTS)), "alerts").select("alert_id", "day", F.col("cents"))
