"""Fixed values of the three tables: columns, types, domains, defaults and view names."""

from __future__ import annotations

from pyspark.sql import types as T

ONBOARDING = "onboarding"
TOOL_USAGE = "tool_usage"
SUPPORT_REQUESTS = "support_requests"
TABLE_NAMES = (ONBOARDING, TOOL_USAGE, SUPPORT_REQUESTS)

# Fixed values. Timestamps hold UTC without a zone; the surrogate keys exist only in the database shape.
SCHEMAS = {
    ONBOARDING: T.StructType(
        [
            T.StructField("onboarding_id", T.LongType()),
            T.StructField("employee_id", T.StringType()),
            T.StructField("onboarding_stage", T.StringType()),
            T.StructField("stage_status", T.StringType()),
            T.StructField("start_date", T.DateType()),
            T.StructField("completion_date", T.DateType()),
        ]
    ),
    TOOL_USAGE: T.StructType(
        [
            T.StructField("usage_id", T.LongType()),
            T.StructField("employee_id", T.StringType()),
            T.StructField("tool_name", T.StringType()),
            T.StructField("usage_date", T.TimestampNTZType()),
            T.StructField("usage_activity", T.StringType()),
            T.StructField("usage_status", T.StringType()),
        ]
    ),
    SUPPORT_REQUESTS: T.StructType(
        [
            T.StructField("request_id", T.StringType()),
            T.StructField("employee_id", T.StringType()),
            T.StructField("request_category", T.StringType()),
            T.StructField("request_date", T.TimestampNTZType()),
            T.StructField("request_status", T.StringType()),
            T.StructField("resolution_time", T.DoubleType()),
        ]
    ),
}

# Fixed values.
PRIMARY_KEYS = {ONBOARDING: "onboarding_id", TOOL_USAGE: "usage_id", SUPPORT_REQUESTS: "request_id"}
SURROGATE_KEYS = {ONBOARDING: "onboarding_id", TOOL_USAGE: "usage_id"}
EVENT_DATE = {ONBOARDING: "start_date", TOOL_USAGE: "usage_date", SUPPORT_REQUESTS: "request_date"}

# Columns an upload must have.
REQUIRED_COLUMNS = {
    ONBOARDING: ["employee_id", "onboarding_stage", "start_date"],
    TOOL_USAGE: ["employee_id", "tool_name", "usage_date"],
    SUPPORT_REQUESTS: ["employee_id", "request_category", "request_date"],
}

# What a whole absent column is filled with.
OPTIONAL_DEFAULTS = {
    ONBOARDING: {"completion_date": None, "stage_status": "In Progress"},
    TOOL_USAGE: {"usage_status": "Success", "usage_activity": "General Activity"},
    SUPPORT_REQUESTS: {"resolution_time": None, "request_status": "Pending"},
}

# Allowed states.
STAGE_STATUSES = ["Completed", "In Progress", "Delayed", "Not Started"]
USAGE_STATUSES = ["Success", "Failed", "Timeout", "Permission Denied"]
REQUEST_STATUSES = ["Resolved", "Pending", "In Progress", "Closed"]

# Declared NOT NULL columns and VARCHAR lengths.
NOT_NULL = {
    ONBOARDING: ["employee_id", "onboarding_stage", "stage_status", "start_date"],
    TOOL_USAGE: ["employee_id", "tool_name", "usage_date", "usage_activity"],
    SUPPORT_REQUESTS: ["request_id", "employee_id", "request_category", "request_date", "request_status"],
}
MAX_LENGTH = {
    ONBOARDING: {"employee_id": 50, "onboarding_stage": 100, "stage_status": 50},
    TOOL_USAGE: {"employee_id": 50, "tool_name": 100, "usage_activity": 100, "usage_status": 50},
    SUPPORT_REQUESTS: {"request_id": 50, "employee_id": 50, "request_category": 100, "request_status": 50},
}

# Fixed value: the first month is Day 0 to Day 30, both included.
WINDOW_DAYS = 30

# Names under which the SQL views are registered.
VIEW_START_DATES = "vw_employee_start_dates"
VIEW_ONBOARDING = "vw_first_30_days_onboarding"
VIEW_TOOL_USAGE = "vw_first_30_days_tool_usage"
VIEW_SUPPORT = "vw_first_30_days_support"
