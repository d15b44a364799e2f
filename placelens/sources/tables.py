"""Readers with fixed schemas, and the place and event views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a canonical place file, in order: a fixed format.
CANONICAL_COLUMNS = [
    "Global_ID", "Alias_Global_IDs", "City_ID", "Entity_Type", "RestaurantID", "Source_IDs", "Restaurant Name", "District", "District_Raw", "Admin_Normalization_Status",
    "Address_Raw", "Address_Current", "Category", "Category_Normalized", "Lat", "Lon", "Overall Rating", "Rating_Scale", "Rating_Count", "Review_Sample_Count", "Google_Rating",
    "Google_Rating_Count", "Foody_Rating_10", "Foody_Review_Sample_Count", "Primary_Rating_Source", "Price", "Price_Min_VND", "Price_Max_VND", "Opening_Hours_Raw", "Image_URL",
    "LLM_Input_Text", "Source", "Merge_Status", "Data_Quality_Flags",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_canonical_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. The header must be the canonical one, but for a byte order mark and outer white space."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    found = [c.lstrip("﻿").strip() for c in df.columns]
    if found != CANONICAL_COLUMNS:
        raise ValueError(f"unexpected header: {found}")
    return df.toDF(*found)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document; an empty table where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")


def read_metrics(spark: SparkSession, path: str, version: str) -> DataFrame:
    if version not in ("v1", "v2", "v3", "v4"):
        raise ValueError(f"unknown version {version}")
    return spark.read.schema("epoch int, train_loss double, test_loss double, recall double").csv(f"{path}/{version}", header=True)


def read_places(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    """csv, parquet or jdbc."""
    if source == "csv":
        return read_canonical_csv(spark, path)
    if source == "jdbc":
        return spark.read.format("jdbc").options(url=path, **options).load()
    return spark.read.parquet(path)


def row_checksum(df: DataFrame) -> DataFrame:
    return df.withColumn("checksum", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))


def file_checksum(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: category from the segment, position from the key, reviews from the orders, text from the documents."""
    t = lambda n: table(spark, sf_dir, n)
    reviews = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("review_count"))
    segment = F.col("c_mktsegment")
    category = F.when(segment == "AUTOMOBILE", "Cafe").when(segment == "BUILDING", "Hải sản").when(segment == "FURNITURE", "Quán ăn").when(segment == "HOUSEHOLD", "Quán nhậu").otherwise("Bảo tàng")
    key = F.col("c_custkey")
    spread = lambda base, prime: base + ((key * prime) % 1000 - 500) * 2e-4
    return (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(reviews, key == F.col("o_custkey"), "left")
        .join(t("documents").select("doc_id", F.col("text").alias("doc_text")), key == F.col("doc_id"), "left")
        .select(
            key.alias("poi_id"), F.col("c_name").alias("name"), category.alias("category"),
            F.when(F.col("c_nationkey") % 3 == 0, "foody").when(F.col("c_nationkey") % 3 == 1, "google_maps").otherwise("google_maps+foody").alias("source"),
            F.col("n_name").alias("district"), F.col("r_name").alias("city_id"), spread(16.0544, 7919).alias("lat"), spread(108.2022, 104729).alias("lon"),
            F.when(F.col("c_acctbal") >= 0, 1.0 + F.col("c_acctbal") / 2000.0).alias("rating"), "review_count", F.coalesce("doc_text", F.lit("")).alias("text"),
        )
    )


PLACES_SQL = """rc as (select o_custkey, count(*) as n from orders group by o_custkey),
poi as (select c.c_custkey as poi_id, c.c_name as name,
  case c.c_mktsegment when 'AUTOMOBILE' then 'Cafe' when 'BUILDING' then 'Hải sản' when 'FURNITURE' then 'Quán ăn' when 'HOUSEHOLD' then 'Quán nhậu' else 'Bảo tàng' end as category,
  case c.c_nationkey % 3 when 0 then 'foody' when 1 then 'google_maps' else 'google_maps+foody' end as source,
  n.n_name as district, r.r_name as city_id,
  16.0544e0 + (((c.c_custkey * 7919) % 1000) - 500) * 2e-4 as lat, 108.2022e0 + (((c.c_custkey * 104729) % 1000) - 500) * 2e-4 as lon,
  case when c.c_acctbal >= 0 then 1e0 + c.c_acctbal / 2000e0 end as rating, rc.n as review_count, coalesce(d.text, '') as text
from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
left join rc on rc.o_custkey = c.c_custkey left join documents d on d.doc_id = c.c_custkey)"""


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as visits, reviews, feedback and route segments, each at a place."""
    e = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_poi"))
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        e.crossJoin(F.broadcast(n))  # one row
        .select(
            "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", ((F.col("event_id") * 31) % F.col("n_poi")).alias("poi_id"),
            F.when(kind == "view", "poi_visit").when(kind == "click", "add_to_itinerary").when(kind == "purchase", "review").when(kind == "error", "poi_not_fit").otherwise("route_segment").alias("kind"),
            F.when(kind == "purchase", (1 + F.col("event_id") % 5).cast("double")).alias("rating"), F.when(kind == "view", F.col("value")).alias("dwell"),
            F.element_at(F.array(F.lit("walking"), F.lit("cycling"), F.lit("car")), (F.col("event_id") % 3 + 1).cast("int")).alias("transport"),
            F.element_at(F.array(F.lit("calm"), F.lit("happy"), F.lit("tired")), k % 3 + 1).alias("mood"),
            F.element_at(F.array(F.lit("work"), F.lit("date"), F.lit("family"), F.lit("food")), k % 4 + 1).alias("purpose"),
        )
    )


EVENTS_SQL = """ev as (select event_id, user_id, ts, value, (event_id * 31) % (select count(*) from customer) as poi_id,
  case event_type when 'view' then 'poi_visit' when 'click' then 'add_to_itinerary' when 'purchase' then 'review' when 'error' then 'poi_not_fit' else 'route_segment' end as kind,
  case when event_type = 'purchase' then (1 + event_id % 5)::double end as rating, case when event_type = 'view' then value end as dwell,
  ['walking', 'cycling', 'car'][(event_id % 3 + 1)::int] as transport,
  ['calm', 'happy', 'tired'][(json_extract_string(props, '$.k')::int % 3) + 1] as mood,
  ['work', 'date', 'family', 'food'][(json_extract_string(props, '$.k')::int % 4) + 1] as purpose from events)"""
