import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from burstlens.session import get_session
    return get_session(cores=4, shuffle_partitions=4)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


RAW_SCHEMA = (
    "id string, name string, mac string, event string, utc_timestamp timestamp_ntz, `timestamp` timestamp_ntz, "
    "sequence int, sensor string, location string, latitude double, longitude double, temperature double, "
    "humidity double, pressure double, voltage double, bearing int, batteryPercentage double, "
    "battery_percentage double, lux int, heatLevel int, heat_level int, fileType string, file_type string, "
    "filename string, image_blob_url string, uploaded boolean, upload string, created timestamp_ntz, "
    "ai_processed boolean, ai_timestamp timestamp_ntz, json_processed boolean, json_timestamp timestamp_ntz, "
    "utc_timestamp_off timestamp_ntz, timezone string, tag string, analysis string, ai_description string, "
    "analysis_title string, analysis_summary string, subject_class string, subject_category string, "
    "time_of_day_bucket string, camera_name string"
)
RAW_FIELDS = [f.strip().split(" ")[0].strip("`") for f in RAW_SCHEMA.split(", ")]


def raw_frame(spark, rows):
    """Raw events from dicts (missing keys are null)."""
    data = [tuple(r.get(k) for k in RAW_FIELDS) for r in rows]
    return spark.createDataFrame(data, RAW_SCHEMA)
