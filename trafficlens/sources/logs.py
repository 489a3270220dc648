"""Access logs as REQUEST tables: nginx combined text and JSON lines."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import once
from ..schema import REQUEST

# The combined format. Unicode classes, since \s and \S must treat non-ASCII blanks as blanks.
_COMBINED = (
    r"(?Us)^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+\"(\S+)\s+(\S+)\s+\S+\"\s+"
    r"([0-9]{3})\s+(\S+)\s+\"([^\"]*)\"\s+\"([^\"]*)\".*$"
)
_SEP = "\x01"
NGINX_PATTERN = _COMBINED
# All white space that a line may begin or end with.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The accepted names of each field, first truthy one wins.
JSON_ALIASES = {
    "ip": ("remote_addr", "ip", "client_ip"),
    "method": ("method", "request_method"),
    "url": ("url", "request_uri", "uri"),
    "status": ("status", "response_code"),
    "size": ("body_bytes_sent", "bytes", "size"),
    "referer": ("http_referer", "referer"),
    "user_agent": ("http_user_agent", "user_agent", "ua"),
    "time": ("time_local", "timestamp", "@timestamp"),
}


def read_log_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of plain or gzipped files with their place in the source.

    Order inside a file is (src_block, line_no): the start of the read split and a counter
    that grows along it.  It needs no shuffle and no numbering pass.
    """
    counter = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        counter.alias("line_no"),
    )


def _log_time(text: Column) -> Column:
    """'24/Mar/2023:17:07:41 +0530'; without a usable zone it is UTC; else NULL."""
    zoned = F.try_to_timestamp(text, F.lit("d/MMM/yyyy:H:m:s [XXX][XX]"))
    bare = F.concat(F.split(text, r"\s+")[0], F.lit(" +0000"))
    return F.coalesce(zoned, F.try_to_timestamp(bare, F.lit("d/MMM/yyyy:H:m:s XX")))


def _log_hour(text: Column) -> Column:
    return F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("int")


def _log_date(text: Column) -> Column:
    day = F.substring_index(text, ":", 1)
    return F.to_date(F.try_to_timestamp(day, F.lit("d/MMM/yyyy")))


def stripped(line: Column) -> Column:
    """Without the white space at either end."""
    return F.btrim(line, F.lit(_BLANKS))


def _fields(line: Column) -> Column:
    """The eight fields of a line in the combined format, NULL for other lines.

    One pass puts a separator between the fields. A line that itself holds the separator, which a
    client may send, gets its fields one by one instead.
    """
    groups = _SEP.join(f"${i}" for i in range(1, 9))
    cut = F.split(F.regexp_replace(line, _COMBINED, groups), _SEP)
    each = F.array(*[F.regexp_extract(line, _COMBINED, i) for i in range(1, 9)])
    return F.when(~line.contains(_SEP), cut).when(line.rlike(_COMBINED), each)


def parse_nginx(lines: DataFrame) -> DataFrame:
    """REQUEST rows of the lines that match; others, and undated ones, are dropped."""
    parts = (
        lines.withColumn("raw_line", stripped(F.col("value")))
        .withColumn("fields", once(_fields(F.col("raw_line"))))
        .filter(F.size("fields") == 8)
    )
    field = lambda i: F.col("fields")[i]
    stamp = field(1)
    return (
        parts.withColumn("ts", once(_log_time(stamp)))
        .filter(F.col("ts").isNotNull())
        .select(
            field(0).alias("ip"),
            "ts",
            # Hour and day as the log writes them, in its own offset.
            _log_hour(stamp).alias("local_hour"),
            _log_date(stamp).alias("local_date"),
            F.upper(field(2)).alias("method"),
            field(3).alias("url"),
            field(4).cast("int").alias("status"),
            F.coalesce(field(5).try_cast("bigint"), F.lit(0)).alias("size"),
            field(6).alias("referer"),
            field(7).alias("user_agent"),
            "raw_line",
            "src_file",
            "src_block",
            "line_no",
        )
    )


def _truthy(value: Column) -> Column:
    """Whether a JSON value counts as present: not null, false, 0, '' or empty."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
    )


def _first_truthy(names) -> Column:
    options = [F.try_variant_get("doc", f"$['{n}']", "variant") for n in names]
    return reduce(lambda acc, v: acc.when(_truthy(v), v), options[1:], F.when(_truthy(options[0]), options[0]))


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _whole_number(value: Column, fallback: int) -> Column:
    """int(): numbers are cut towards zero, texts must be whole numbers."""
    text = _text_of(value)
    cut = F.try_variant_get(value, "$", "double").try_cast("bigint")
    return F.when(value.isNull(), fallback).otherwise(
        F.coalesce(
            F.when(
                F.schema_of_variant(value) == "STRING",
                F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint")),
            ).otherwise(cut),
            F.lit(fallback),
        )
    )


def _json_time(text: Column) -> Column:
    iso = F.try_to_timestamp(text, F.lit("yyyy-M-d'T'H:m:s[XXX][XX]"))
    plain = F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"),
        F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit("yyyy-M-d H:m:s XX")),
    )
    zoned_log = F.try_to_timestamp(text, F.lit("d/MMM/yyyy:H:m:s [XXX][XX]"))
    has_zone = text.rlike(r"([zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.coalesce(F.when(has_zone, zoned_log), F.when(has_zone, iso), plain)


def parse_json(lines: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """REQUEST rows of the JSON objects among the lines.

    A missing or unreadable time becomes ``default_ts`` (now, unless given).
    """
    fallback = F.current_timestamp() if default_ts is None else default_ts
    docs = (
        lines.withColumn("raw_line", stripped(F.col("value")))
        .withColumn("doc", once(F.try_parse_json("raw_line")))
        .filter(F.schema_of_variant("doc").startswith("OBJECT"))
    )
    picked = docs.select(
        "*", *[_first_truthy(names).alias(f"v_{f}") for f, names in JSON_ALIASES.items()]
    ).withColumn("stamp", once(_text_of(F.col("v_time"))))
    text = lambda f, default: F.coalesce(_text_of(F.col(f"v_{f}")), F.lit(default))
    stamp = F.col("stamp")
    is_log_style = stamp.contains("/")
    hour = F.when(is_log_style, _log_hour(stamp)).otherwise(
        F.regexp_extract(stamp, r"[T ]([0-9]{1,2}):", 1).try_cast("int")
    )
    date = F.when(is_log_style, _log_date(stamp)).otherwise(
        F.to_date(F.try_to_timestamp(F.regexp_extract(stamp, r"^[0-9-]+", 0), F.lit("yyyy-M-d")))
    )
    return (
        picked.withColumn("parsed_ts", once(_json_time(stamp)))
        .withColumn("ts", F.coalesce("parsed_ts", fallback))
        .select(
            text("ip", "").alias("ip"),
            "ts",
            F.when(F.col("parsed_ts").isNull(), F.hour("ts")).otherwise(hour).alias("local_hour"),
            F.when(F.col("parsed_ts").isNull(), F.to_date("ts")).otherwise(date).alias("local_date"),
            F.upper(text("method", "GET")).alias("method"),
            text("url", "/").alias("url"),
            _whole_number(F.col("v_status"), 200).cast("int").alias("status"),
            _whole_number(F.col("v_size"), 0).alias("size"),
            text("referer", "-").alias("referer"),
            text("user_agent", "").alias("user_agent"),
            "raw_line",
            "src_file",
            "src_block",
            "line_no",
        )
    )


def detect_formats(lines: DataFrame) -> DataFrame:
    """(src_file, fmt): the format of the first recognisable line among the first ten.

    ``unknown`` when none is.  The rank limit is applied before the shuffle, so only a few
    lines per split travel.
    """
    order = Window.partitionBy("src_file").orderBy("src_block", "line_no")
    head = (
        lines.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= 10)
        .withColumn("line", stripped(F.col("value")))
    )
    kind = F.when(
        F.col("line").startswith("{") & F.try_parse_json("line").isNotNull(), "json"
    ).when(F.col("line").rlike(_COMBINED), "nginx")
    return head.groupBy("src_file").agg(
        F.coalesce(
            F.min_by(kind, F.when(kind.isNotNull(), F.col("rank"))), F.lit("unknown")
        ).alias("fmt")
    )


def read_access_log(
    spark: SparkSession, paths, fmt="auto", default_ts: Column | None = None
) -> DataFrame:
    """Requests of one or many files (rotated, gzipped, globs).

    ``auto`` decides per file and costs a pass over the text; name the format when known.
    """
    lines = read_log_lines(spark, paths)
    if fmt == "nginx":
        return parse_nginx(lines)
    if fmt == "json":
        return parse_json(lines, default_ts)
    if fmt != "auto":
        raise ValueError(f"unknown format {fmt!r}")
    # Whether the few rows of this side are broadcast is left to their measured size.
    marked = lines.join(detect_formats(lines), "src_file")
    as_json = parse_json(marked.filter(F.col("fmt") == "json"), default_ts)
    return parse_nginx(marked.filter(F.col("fmt") != "json")).unionByName(as_json)


def to_request_json(requests: DataFrame) -> DataFrame:
    """One JSON text per request, with its place in the source kept beside it."""
    names = ["ip", "ts", "local_hour", "local_date", "method", "url", "status", "size",
             "referer", "user_agent", "raw_line"]
    return requests.select(
        *[c for c in ("src_file", "src_block", "line_no") if c in requests.columns],
        F.to_json(
            F.struct(*names), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        ).alias("value"),
    )


def from_request_json(lines: DataFrame) -> DataFrame:
    """The inverse; ``raw_line`` may be absent."""
    body = F.from_json(
        "value", REQUEST, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    )
    place = [c for c in ("src_file", "src_block", "line_no") if c in lines.columns]
    return lines.withColumn("r", body).select(
        *[F.col(f"r.{f.name}") for f in REQUEST.fields if f.name not in ("raw_line", *place)],
        F.coalesce("r.raw_line", F.lit("")).alias("raw_line"),
        *place,
    )
