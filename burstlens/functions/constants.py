"""Fixed values of the camera-event model.

FIXED VALUES: every literal below must keep exactly this value for results to
match the specification (range bounds, keyword ladder, thresholds, scoring
weights, labels and text formats).  They are listed plainly and in the order
the rules apply them.
"""

# ---------------------------------------------------------------- FIXED VALUES
DEFAULT_TIMEZONE = "America/Denver"

# Valid ranges of telemetry (inclusive); a value outside is treated as missing.
RANGE_BATTERY = (0, 100)
RANGE_HEAT = (0, 100)
RANGE_VOLTAGE = (0, 18)
RANGE_TEMPERATURE = (-60, 160)
RANGE_HUMIDITY = (0, 100)
RANGE_PRESSURE = (800, 1200)
RANGE_LUX = (0, 200000)
RANGE_BEARING = (0, 360)
RANGE_LATITUDE = (-90, 90)
RANGE_LONGITUDE = (-180, 180)

# Subject-class ladder: first class whose any keyword is a substring of the
# lower-cased subject signal wins, in this order.
CLASS_LADDER = [
    ("wolf", ["wolf"]),
    ("bison", ["bison"]),
    ("elk", ["elk"]),
    ("deer", ["deer", "antler"]),
    ("bear", ["bear"]),
    ("fox_coyote", ["fox", "coyote", "canid"]),
    ("bird", ["bird", "waterfowl"]),
    ("ranger", ["ranger"]),
    ("hiker", ["hiker", "visitor", "person", "people", "human"]),
    ("vehicle", ["truck", "vehicle", "pickup", "car", "jeep", "atv"]),
    ("empty_landscape", ["empty", "landscape", "no active subject", "still meadow", "quiet valley"]),
]

# Category derived from the class, in this order; then the threat keyword.
WILDLIFE_CLASSES = ["elk", "bison", "deer", "wolf", "bear", "fox_coyote", "bird"]
HUMAN_CLASSES = ["hiker", "ranger"]
VEHICLE_CLASS = "vehicle"
EMPTY_CLASS = "empty_landscape"
THREAT_KEYWORD = "threat"
UNKNOWN_CATEGORY = "unknown"
MAIN_CATEGORIES = ["wildlife", "human", "vehicle", "empty_scene"]

# Time-of-day bucket by hour (inclusive bounds); anything else is night.
BUCKET_HOURS = [("morning", 6, 11), ("afternoon", 12, 16), ("evening", 17, 21)]
BUCKET_OTHER = "night"
BUCKET_ORDER = ["morning", "afternoon", "evening", "night"]

# Daypart by hour (different cut points); anything else is night.
DAYPART_HOURS = [("dawn", 5, 7), ("day", 8, 16), ("dusk", 17, 20)]
DAYPART_OTHER = "night"

# KPI hour sets.
NIGHT_HOURS = [(22, 23), (0, 5)]
DAWN_DUSK_HOURS = [(6, 11), (17, 21)]

LOW_LIGHT_LUX = 15
LOW_LIGHT_NULL_LUX = 999999
LOW_VOLTAGE = 11.5
LOW_VOLTAGE_FLAG = 11.4
LOW_BATTERY = 20
UPLOAD_LAG_LIMIT = 3600
PROCESSING_LAG_LIMIT = 7200
STALE_HOURS = 48
BURST_CAP = 6
TOP_CAMERAS = 8
NOTABLE_EVENTS = 8
STALE_CAMERAS = 6
DAY_EVENTS = 50
EVENT_PAGE_SIZE = 25
EVENT_PAGE_MAX = 200

# Camera health score.
CAM_HEALTH_PENALTIES = dict(upload_pct_below_95=18, ai_pct_below_90=12, json_pct_below_90=10,
                            upload_lag_over_3600=12, proc_lag_over_7200=14, voltage_below_11_5=18,
                            stale_over_48h=20)
CAM_ANOMALY = dict(upload_pct_ref=98, upload_weight=1.5, ai_pct_ref=95, ai_weight=0.8,
                   upload_lag_div=900, upload_lag_cap=18, proc_lag_div=1200, proc_lag_cap=18,
                   low_voltage=16, stale_div=2, stale_cap=25)
STATUS_ALERT_ANOMALY = 65
STATUS_ALERT_HEALTH = 45
STATUS_WARN_ANOMALY = 35
STATUS_WARN_HEALTH = 70
ALERT_REASONS = ["Camera is stale", "Under-voltage trend", "Processing lag spike",
                 "AI completion is below target"]

# Event health score (R2) and event anomaly score.
EVENT_HEALTH_PENALTIES = dict(upload_failed=28, ai_false=12, json_false=10, upload_lag_over_3600=12,
                              proc_lag_over_7200=14, voltage_below_11_5=16, battery_below_20=10)
EVENT_ANOMALY = dict(upload_failed=32, ai_false=12, json_false=10, upload_lag_div=900, upload_lag_cap=18,
                     proc_lag_div=1200, proc_lag_cap=16, ai_lag_div=1200, ai_lag_cap=12,
                     low_voltage=14, low_battery=12, ai_without_summary=8, low_light=4)
ANOMALY_FLAG = 45
UNPROCESSED_SUMMARY = "Unprocessed"
UNKNOWN_SENSOR = "unknown"

# Data-quality flags (R5), in output order.
QUALITY_FLAGS = ["missing_analysis", "ai_without_summary", "json_pending", "upload_failed",
                 "low_voltage", "low_battery", "low_light", "missing_temperature",
                 "missing_humidity", "missing_pressure"]

# Anomaly timeline row score.
TIMELINE_SCORE = dict(upload_failed=30, low_voltage=18, lag_div=1200.0, lag_cap=20, suspicious=12)

# Analysis windows (W4) and lab algorithms (L1-L4).
RECENT_MIN_DAYS = 5
RECENT_MAX_DAYS = 14
BASELINE_MAX_DAYS = 28
TRAILING_DAYS = 7
SHIFT_TOP = 36
NOVEL_TOP = 12
LEADERS_TOP = 10
NOVELTY_THRESHOLD = 70
NOVELTY_WEIGHTS = dict(combo=0.45, category_hour=0.25, deviation=0.2, shift=0.1)
SHIFT_SCORE_DIV = 25
LIFT_NEW = 4
LIFT_NONE = 1
NOVELTY_EXCLUDED = "empty_scene"

# Camera clusters (R7): first rule that holds, else Balanced.
CLUSTER_RULES = [
    ("Operational Risk", "ops anomaly", "Lag, stale behavior, or low-voltage conditions are driving the profile."),
    ("Nocturnal Wildlife", "wildlife corridor", "High wildlife share with strong low-light activity."),
    ("Human Interaction", "human-exposed", "Human detections make up an elevated share of this camera's events."),
    ("Diverse Habitat", "high diversity", "The camera sees a wider variety of categories and species than peers."),
    ("Balanced", "mixed profile", "Balanced traffic, category mix, and telemetry profile."),
]
CLUSTER_ANOMALY = 55
CLUSTER_WILDLIFE_PCT = 70
CLUSTER_LOW_LIGHT_PCT = 40
CLUSTER_HUMAN_PCT = 35
CLUSTER_DIVERSITY = 4

# Text formats.
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
CSV_SECONDS = "yyyy-MM-dd HH:mm:ss"
MONTH_FORMAT = "yyyy-MM"
# ------------------------------------------------------------ END FIXED VALUES

# ---------------------------------------------------------------- FIXED VALUES
# Insight texts ({} marks the inserted value, in order).
INSIGHT_CAMERA_ALERT = ("{} needs attention", "This camera has the highest operational anomaly score in the fleet.")
INSIGHT_LAG = ("Processing lag is elevated", "Average processing lag is {} minutes across the current slice.")
INSIGHT_BUSIEST = ("{} is the busiest camera", "It generated {} grouped events in the selected range.")
INSIGHT_LOW_LIGHT = ("Wildlife activity is skewing toward low light", "{}% of grouped events occurred in low-light conditions.")
INSIGHT_STALE = ("{} stale cameras detected",
                 "At least one camera has not reported recently and should be checked for power, connectivity, or upload backlog.")
INSIGHT_LOW_LIGHT_PCT = 35
INSIGHT_LAG_SECONDS = 3600
INSIGHT_MAX = 4
INSIGHT_HOT = ("{} is running hot", "Actual activity is {}% above expected on {}.")
INSIGHT_QUIET = ("{} is quieter than expected", "Actual activity is {}% below expected on {}.")
INSIGHT_NOVEL = ("Novel {} activity is emerging", "{} at {}:00 carries the highest novelty score in the current slice.")
INSIGHT_SHIFT = ("{} has a category shift", "{} share moved by {} points against baseline.")
NOVEL_NARRATIVE = "{} is showing an unusual {} pattern near {}:00. Recent count {}, baseline {} per day."
# ------------------------------------------------------------ END FIXED VALUES
