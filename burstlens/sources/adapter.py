"""Projection of the driver's test tables onto the camera-event model.

The driver ships a generic ``events(event_id, ts, user_id, event_type, value,
props)`` table and a ``nation`` table.  These deterministic projections turn
them into the 43-column raw camera ``events`` fact and the 8-column
``dim_devices`` dimension.  Both are pure row-wise projections (no shuffle),
so they scale with the input and keep parquet column pruning and filter
pushdown on ``ts``.

The same text is used by the DuckDB oracle (see ``duckdb_dialect``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_SQL = """
with s as (
  select event_id as e, event_id - event_id % 3 as g, ts, value as v, event_type as et,
         cast(get_json_object(props, '$.k') as int) as k
  from {src}),
t as (
  select *, case when e % 11 = 0 then null else ts + interval '1' minute * (k * 2) end as created0 from s)
select
  cast(e as string) as id,
  case when g % 24 = 21 then concat('alt-', cast(g % 24 as string)) else null end as name,
  concat('mac-', lpad(cast(g % 24 as string), 2, '0')) as mac,
  case when e % 10 = 9 then ' ' when e % 300 < 30 then concat('big-', cast(e - e % 15 as string))
       else concat('grp-', cast(g as string)) end as event,
  ts as utc_timestamp,
  case when e % 97 = 0 then null else ts end as `timestamp`,
  cast(e % 3 + 1 as int) as sequence,
  case e % 4 when 0 then 'F' when 1 then 'B' when 2 then 'L' else 'R' end as sensor,
  concat('loc-', cast(g % 24 as string)) as location,
  case when k = 97 then 123e0 else 40e0 + (g % 24) * 0.1e0 end as latitude,
  case when k = 96 then -200e0 else -110e0 - (g % 24) * 0.1e0 end as longitude,
  v - 60 as temperature,
  k * 1.02e0 as humidity,
  850e0 + k * 4 as pressure,
  case when k = 50 then 19e0 else 10.5e0 + (k % 20) * 0.1e0 end as voltage,
  cast(case when k = 98 then 400 else (e % 4) * 90 end as int) as bearing,
  cast(k + 10 as double) as `batteryPercentage`,
  case when k % 5 = 0 then null else cast(k + 10 as double) end as battery_percentage,
  case when k = 99 then -5 else k % 50 end as lux,
  k + 5 as `heatLevel`,
  case when k % 7 = 0 then null else k + 5 end as heat_level,
  'camera' as `fileType`,
  case when e % 3 = 0 then null else 'camera' end as file_type,
  concat(cast(e as string), '.jpg') as filename,
  concat('https://example.invalid/', cast(e as string)) as image_blob_url,
  case when k = 42 then null else e % 11 <> 0 end as uploaded,
  case when e % 15 = 0 then '' when e % 4 = 0 then 'true' else null end as upload,
  created0 as created,
  e % 7 <> 0 as ai_processed,
  case when e % 7 = 0 then null else created0 + interval '1' second * (k * 30) end as ai_timestamp,
  case when e % 13 = 0 then null else e % 9 <> 0 end as json_processed,
  case when e % 9 = 0 then null else created0 + interval '1' second * (k * 40) end as json_timestamp,
  case when e % 97 = 0 then ts + interval '1' hour else ts end as utc_timestamp_off,
  case when e % 20 = 0 then null else '-7' end as timezone,
  concat(lower(et), '_') as tag,
  case when e % 6 = 0 then null else concat('{{"title":"T', cast(k as string), '","summary":"a ', et, ' near the wolf den","details":{{"main_subject":"wolf"}}}}') end as analysis,
  case when e % 12 = 0 then 'not json' when e % 6 = 0 then concat('{{"title":"D', cast(k as string), '","keywords":{{"Animals":"bear"}}}}') else null end as ai_description,
  case when e % 4 = 0 then null else concat('Title ', et) end as analysis_title,
  case when e % 5 = 0 then ' ' when e % 8 = 0 then concat('stored, ', et) else null end as analysis_summary,
  case when k % 13 = 0 then null when k % 17 = 0 then 'Fox Coyote' when et = 'click' then 'elk'
       when et = 'view' then 'hiker' when et = 'purchase' then 'vehicle'
       when et = 'error' then 'empty_landscape' else 'bird' end as subject_class,
  case when k % 3 = 0 then null when k % 13 = 0 or k % 17 = 0 then 'wildlife'
       when et in ('click', 'signup') then 'wildlife' when et = 'view' then 'human'
       when et = 'purchase' then 'vehicle' else 'empty_scene' end as subject_category,
  case when e % 2 = 0 then null when extract(hour from ts) between 6 and 11 then 'morning'
       when extract(hour from ts) between 12 and 16 then 'afternoon'
       when extract(hour from ts) between 17 and 21 then 'evening' else 'night' end as time_of_day_bucket,
  case when g % 24 = 21 then '' else concat('cam-', lpad(cast(g % 24 as string), 2, '0')) end as camera_name
from t
"""

DEVICES_SQL = """
select concat('mac-', lpad(cast(n_nationkey as string), 2, '0')) as mac,
       concat('cam-', lpad(cast(n_nationkey as string), 2, '0')) as camera_name,
       n_name as location_name, concat('R', cast(n_regionkey as string)) as location_code,
       40e0 + n_nationkey * 0.1e0 as latitude, -110e0 - n_nationkey * 0.1e0 as longitude,
       concat('profile ', n_name) as camera_profile, '' as notes
from {src}
"""


def duckdb_dialect(spark_sql: str, src: str) -> str:
    """The same statement for DuckDB (double-quoted identifiers, JSON function)."""
    text = spark_sql.format(src=src)
    return text.replace("`", '"').replace("get_json_object(", "json_extract_string(")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def camera_events_from(spark: SparkSession, driver_events: DataFrame) -> DataFrame:
    """Raw camera events (43 columns) from a driver-shaped events DataFrame."""
    return spark.sql(_spark_text(EVENTS_SQL), src_df=driver_events)


def devices_from(spark: SparkSession, nation: DataFrame) -> DataFrame:
    return spark.sql(_spark_text(DEVICES_SQL), src_df=nation)


def _spark_text(template: str) -> str:
    # ``spark.sql`` formats ``{src_df}`` with the DataFrame and keeps ``{{``/``}}``
    # as literal braces, so the template's doubled braces pass through unchanged.
    return template.replace("{src}", "{src_df}")


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_events_from(spark, read_table(spark, sf_dir, "events"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stated schema saves the job that would read it from a footer
    nation = spark.read.schema("n_nationkey bigint, n_name string, n_regionkey bigint").parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    return devices_from(spark, nation)
