"""Plans that read and write files: feeds made of the driver's tables, staging, replacement, reports (survey section 2.1)."""

import os
import zipfile

from pyspark.sql import functions as F

from offerloom.operators import listing, tables
from offerloom.plans.dialect import frame, plan, run_text
from offerloom.sources import archives, feeds

_COLUMNS = "p_partkey AS id, concat(p_name, chr(10), '\"', p_brand, '\"; ', p_type) AS title, concat('https://shop.example/', p_partkey) AS link, p_type AS product_type, p_brand AS brand"
SPEC = feeds.FeedSpec("shop", rejected_paths="^small$", rejected_titles="misty")


def _path(spark, name):
    return f"{tables.shared_dir(spark)}/offerloom/{name}-{os.urandom(8).hex()}"


def _feed(spark, sf_dir):
    """part as a feed: semicolons, quoted fields that hold line feeds, quotes and semicolons."""
    path = _path(spark, "feed")
    run_text(spark, sf_dir, f"SELECT {_COLUMNS} FROM part").write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(path)
    return feeds.read_feed(spark, path, SPEC)


@frame("a02_delimited_feed", f"SELECT CAST(id AS VARCHAR) AS id, title, link FROM (SELECT {_COLUMNS} FROM part) x")
def a02(spark, sf_dir):
    row = F.col("row")
    return _feed(spark, sf_dir).select(*[row[c].alias(c) for c in ("id", "title", "link")])


@frame("a03_ragged_rows", "SELECT 'shop' AS merchant, count(*) AS rows, count(*) FILTER (WHERE p_partkey % 7 IN (3, 5)) AS ragged FROM part")
def a03(spark, sf_dir):
    """Records with a field too few or too many are read on and counted."""
    path = _path(spark, "ragged")
    lines = run_text(spark, sf_dir, "SELECT concat_ws(';', p_partkey, p_name, CASE WHEN p_partkey % 7 <> 3 THEN 'x' END, CASE WHEN p_partkey % 7 = 5 THEN 'more' END) AS line FROM part")

    def headed(frames):
        first = True
        for frame_ in frames:
            lines = list(frame_["line"])
            yield frame_.__class__({"line": (["id;title;link"] if first else []) + lines})
            first = False

    lines.mapInPandas(headed, "line string").write.text(path)
    return feeds.ragged(feeds.read_feed(spark, path, SPEC))


def _archives(spark, rows, name, head):
    """Rows (member, line) as archives in the shared folder, one for each task, written by the tasks."""
    folder = _path(spark, name)

    def write(frames):
        members = {}
        for frame_ in frames:
            for member, line in zip(frame_["member"], frame_["line"]):
                members.setdefault(member, []).append(line)
        if members:
            path = f"{folder}/{os.urandom(8).hex()}.zip"
            with archives.opened(path, "w") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
                for member, lines in sorted(members.items()):
                    archive.writestr(f"{member}.csv", "\n".join([head, *lines, ""]))
            yield frame_.__class__({"path": [path]})

    return [r.path for r in rows.mapInPandas(write, "path string").collect()]  # a path for each archive


@frame("a04_zipped_feed", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title FROM nation")
def a04(spark, sf_dir):
    """Archives that executors write and read."""
    rows = run_text(spark, sf_dir, "SELECT concat('feed', n_nationkey % 2) AS member, concat_ws(';', n_nationkey, n_name, 'x') AS line FROM nation")
    return archives.read_archives(spark, _archives(spark, rows, "zip", "id;title;link"), SPEC).where("reason is null").select(F.col("sku").alias("id"), "title")


@frame("a04_archive_members", """WITH f AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'ragged' WHEN lower(p_type) = 'small' THEN 'category' WHEN contains(lower(p_name), 'misty') THEN 'title' WHEN p_partkey % 17 = 0 THEN 'incomplete' ELSE 'kept' END AS reason, p_partkey FROM part)
SELECT concat('feed', p_partkey % 3) AS member, reason, CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN reason = 'kept' THEN p_partkey ELSE 0 END) AS BIGINT) AS ids FROM f GROUP BY 1, 2""")
def a04_members(spark, sf_dir):
    """Records of archives' members that are in scope, and those left out by reason."""
    rows = run_text(spark, sf_dir, "SELECT concat('feed', p_partkey % 3) AS member, concat_ws(';', p_partkey, concat('\"', p_name, '\n', p_brand, '\"'), CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'x' END, p_type, CASE WHEN p_partkey % 13 = 0 THEN 'more' END) AS line FROM part").repartition(4)
    read = archives.read_archives(spark, _archives(spark, rows, "members", "id;title;link;product_type"), SPEC)
    read = read.select(F.regexp_extract("member", "#(.*)[.]csv$", 1).alias("member"), F.coalesce("reason", F.lit("kept")).alias("reason"), "records", F.coalesce(F.col("sku").cast("long"), F.lit(0)).alias("id"))
    return read.groupBy("member", "reason").agg(F.sum("records").alias("records"), F.sum("id").alias("ids"))


@frame("a06_scope_at_the_door", f"SELECT CASE WHEN lower(product_type) = 'small' THEN 'category' WHEN contains(lower(title), 'misty') THEN 'title' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT {_COLUMNS} FROM part) x GROUP BY 1")
def a06(spark, sf_dir):
    return feeds.in_scope(_feed(spark, sf_dir), SPEC).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@frame("a07_staging_by_merchant", "SELECT l_suppkey % 10 AS merchant_id, count(*) AS n, sum(l_orderkey) AS keys FROM lineitem WHERE NOT (l_suppkey % 10 < 3 AND l_linenumber > 1) GROUP BY 1")
def a07(spark, sf_dir):
    """Staged rows of ten merchants, three of which are then replaced as wholes."""
    path = _path(spark, "staging")
    rows = run_text(spark, sf_dir, "SELECT l_suppkey % 10 AS merchant_id, l_orderkey, l_linenumber FROM lineitem")
    tables.replace_partitions(rows, path, "merchant_id")
    tables.replace_partitions(rows.where("merchant_id < 3 and l_linenumber = 1"), path, "merchant_id")
    return spark.read.parquet(path).groupBy(F.col("merchant_id").cast("bigint").alias("merchant_id")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


plan("a08_staging_scan")(lambda d: "SELECT l_suppkey AS merchant_id, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7")


@frame("a22_replaced_table", "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 = 0")
def a22(spark, sf_dir):
    path, rows = _path(spark, "replaced"), run_text(spark, sf_dir, "SELECT p_partkey, p_brand FROM part")
    tables.replace_table(rows, path)
    tables.replace_table(rows.where("p_partkey % 3 = 0"), path)
    return spark.read.parquet(path)


@frame("a23_csv_report", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_size = 7")
def a23(spark, sf_dir):
    path = _path(spark, "report")
    tables.csv_report(run_text(spark, sf_dir, "SELECT p_partkey, p_name FROM part WHERE p_size = 7"), path)
    return spark.read.option("sep", ";").option("header", True).csv(path, schema="p_partkey string, p_name string")


@frame("b19_active_filters", """WITH r AS (SELECT c_custkey AS id, c_mktsegment AS brand, c_nationkey, c_acctbal FROM customer)
SELECT id, CASE WHEN c_nationkey % 3 = 0 THEN 'brands' END AS c1, CASE WHEN c_nationkey % 4 = 0 THEN 'categories' END AS c2, CASE WHEN c_acctbal > 0 THEN 'high' END AS c3, CASE WHEN c_nationkey % 5 = 0 THEN concat('word ', lower(brand)) END AS c4, CASE WHEN c_acctbal > 5000 THEN 'merchants' END AS c5 FROM r""")
def b19(spark, sf_dir):
    """The names of each request's active criteria, as a page lists them; a request for each customer."""
    asked = run_text(spark, sf_dir, "SELECT c_custkey AS id, c_mktsegment AS brand, c_nationkey, c_acctbal FROM customer").select(
        "id",
        F.expr("CASE WHEN c_nationkey % 3 = 0 THEN array('x') END").alias("brands"), F.expr("CASE WHEN c_nationkey % 4 = 0 THEN array('y') END").alias("categories"),
        F.expr("CASE WHEN c_acctbal > 0 THEN 9 END").alias("high"), F.expr("CASE WHEN c_nationkey % 5 = 0 THEN array(lower(brand)) END").alias("words"), F.expr("CASE WHEN c_acctbal > 5000 THEN 2 END").alias("merchants"),
    )
    chips = asked.withColumn("chips", listing.active_chips(asked.columns))
    known = {"c1": "chip = 'brands'", "c2": "chip = 'categories'", "c3": "chip = 'high'", "c4": "startswith(chip, 'word ')", "c5": "chip = 'merchants'"}
    return chips.select("id", *(F.expr(f"get(filter(chips, chip -> {e}), 0)").alias(c) for c, e in known.items()))
