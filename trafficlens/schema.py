"""Column layouts shared by every operator."""

from pyspark.sql import types as T

# The session vector, in model order.
FEATURES = [
    "time_since_last_request",
    "requests_per_minute_1m",
    "requests_per_minute_5m",
    "inter_request_time_cv",
    "time_since_session_start",
    "endpoint_count",
    "endpoint_sequence_entropy",
    "unique_endpoint_ratio",
    "method_mismatch_count",
    "header_consistency_score",
    "has_accept_language",
    "ua_category",
    "payload_entropy",
    "status_code_entropy",
    "same_endpoint_hits",
    "error_rate",
    "image_ratio",
    "night_ratio",
    "max_sustained_click_rate",
]
UA_FEATURES = ["ua_category", "has_accept_language", "header_consistency_score"]
STATUS_FEATURES = ["status_code_entropy", "error_rate"]

# Ties in time are broken by where the request stands in its source.
SOURCE_ORDER = ["src_file", "src_block", "line_no"]

REQUEST = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("local_hour", T.IntegerType()),
        T.StructField("local_date", T.DateType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("src_file", T.StringType()),
        T.StructField("src_block", T.LongType()),
        T.StructField("line_no", T.LongType()),
    ]
)

SIGNALS = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("tor_exit", T.BooleanType()),
        T.StructField("hosting_range", T.BooleanType()),
        T.StructField("abuse_score", T.DoubleType()),
        T.StructField("fp_resolved", T.BooleanType()),
        T.StructField("fingerprint_hash", T.StringType()),
        T.StructField("shared_hash_ips", T.LongType()),
        T.StructField("promoted", T.ArrayType(T.StringType())),
    ]
)

ARCHIVE = T.StructType(
    [
        T.StructField("decision_id", T.StringType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("model_score", T.DoubleType()),
        T.StructField("heuristic_label", T.StringType()),
        T.StructField("heuristic_reason", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("blocked", T.BooleanType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

CORRECTION = T.StructType(
    [
        T.StructField("decision_id", T.StringType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
