"""The queries over the driver's tables, with the same in SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import Section, Settings, overridden
from sawmill.functions import masking, parsing
from sawmill.operators import alerts, anomaly, clustering, correlate, diff, mining, tags, timeseries
from sawmill.operators.ordering import ranked
from sawmill.plans import analyze as plans
from sawmill.plans import reports
from sawmill.plans.stored import dropped, new_path, stored
from sawmill.sources import lines as line_source

YEAR = 2024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Log lines made from events; the expressions are the same in both engines but for the time formats.
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' WHEN 'click' THEN 'INFO' ELSE 'FATAL' END"
MESSAGE = "concat(event_type, ' by user ', user_id, ' value ', CAST(floor(value) AS BIGINT), ' from 10.0.', user_id % 250, '.', event_id % 250, ' at /api/v', user_id % 3, '/', event_type)"
_FORMATS = {"text": f"concat({{ts}}, ' ', {LEVEL}, ' svc', user_id % 5, ' ', {MESSAGE})", "json": f"concat('{{{{\"timestamp\":\"', {{tz}}, 'Z\",\"level\":\"', lower({LEVEL}), '\",\"service\":\"svc', user_id % 5, '\",\"message\":\"', {MESSAGE}, '\"}}}}')", "rfc5424": f"concat('<', event_id % 192, '>1 ', {{tz}}, 'Z host', user_id % 7, CASE WHEN user_id % 3 = 0 THEN ' -' ELSE ' app' END, ' ', event_id, ' ID', event_id % 5, ' ', CASE WHEN event_id % 2 = 0 THEN {LEVEL} ELSE 'note' END, ' ', {MESSAGE})", "rfc3164": f"concat({{bsd}}, ' host', user_id % 7, ' svc: ', {LEVEL}, ' ', {MESSAGE})"}
_SPARK_TIMES = {"ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "tz": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "bsd": "date_format(ts, 'MMM dd HH:mm:ss')"}
_DUCK_TIMES = {"ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "tz": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "bsd": "strftime(ts, '%b %d %H:%M:%S')"}


def event_lines(spark: SparkSession, sf: str, kind: str = "text") -> DataFrame:
    """(seq, value): a log line per event."""
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr(_FORMATS[kind].format(**_SPARK_TIMES)).alias("value"))


def duck_lines(kind: str = "text") -> str:
    return f"(SELECT event_id AS seq, {_FORMATS[kind].format(**_DUCK_TIMES)} AS value FROM events)"


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kinds = list(_FORMATS)
    line = F.expr("CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {_FORMATS[k].format(**_SPARK_TIMES)}" for i, k in enumerate(kinds)) + " END")
    return e.select(F.col("event_id").alias("seq"), line.alias("value"))


_DUCK_MIXED = "(SELECT event_id AS seq, CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {_FORMATS[k].format(**_DUCK_TIMES)}" for i, k in enumerate(_FORMATS)) + " END AS value FROM events)"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed plain lines of the events."""
    return line_source.parsed(event_lines(spark, sf), Section(Settings().input), YEAR)


def templated(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines that have their template: its id is the event type."""
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), "ts", F.expr(LEVEL).alias("level"), F.concat(F.lit("svc"), F.col("user_id") % 5).alias("source"), F.col("event_type").alias("template_id"))


_TEMPLATED = f"(SELECT event_id AS seq, ts, {LEVEL} AS level, concat('svc', user_id % 5) AS source, event_type AS template_id FROM events)"


def documents_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "value"))


_DOC_LINES = "(SELECT doc_id, n - 1 AS n, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"
_WORDS = "WARNING|CRITICAL|DEBUG|ERROR|FATAL|INFO|WARN"


def duck_level(text: str) -> str:
    """P12 for ASCII text."""
    near = rf"upper(regexp_extract(substr({text}, 1, 60), '(?i)(?:^|[^\pL])({_WORDS})(?:$|[^\pL])', 1))"
    far = rf"upper(regexp_extract({text}, '(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b', 1))"
    return f"CASE WHEN {near} <> '' THEN replace(replace({near}, 'WARNING', 'WARN'), 'CRITICAL', 'FATAL') WHEN {far} <> '' THEN {far} ELSE 'INFO' END"


def _fields(df: DataFrame, **options: str) -> DataFrame:
    return parsing.parse_lines(df, "value", Section(Settings().input | options), YEAR).select("seq", "ts", "level", "source", "message")


# --- scans and parsing


@query("SELECT CAST(f AS INT) AS file_idx, value, count(*) AS n, count(DISTINCT seq) AS n_seq FROM (SELECT *, row_number() OVER () AS seq FROM (SELECT doc_id % 3 AS f, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE NOT contains(value, chr(13))) GROUP BY 1, 2")
def scan_lines(spark, sf):
    """The documents' lines written as text to three folders of files and scanned from there."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value")).where(~F.contains("value", F.lit("\r")))
    paths = [new_path(spark, f"lines-{k}") for k in range(3)]
    for k, path in enumerate(paths):
        d.where(F.col("doc_id") % 3 == k).select("value").write.text(path)
    return line_source.scan_lines(spark, paths).groupBy("file_idx", "value").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_seq"))


@query(r"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE regexp_matches(value, '[^\s]') GROUP BY doc_id")
def blank_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return line_source.not_blank(d).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(rf"SELECT seq, CASE WHEN value LIKE '{{%}}' THEN 'json' WHEN regexp_matches(value, '^<\d{{1,3}}>\d\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+') THEN 'rfc5424' WHEN regexp_matches(value, '^[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\S+\s+') THEN 'rfc3164' ELSE 'text' END AS format FROM {_DUCK_MIXED}")
def detect_format(spark, sf):
    return mixed_lines(spark, sf).select("seq", parsing.detect_format(F.col("value")).alias("format"))


@query(f"SELECT seq, CAST(replace(json_extract_string(value, '$.timestamp')[1:19], 'T', ' ') AS TIMESTAMP) AS ts, json_extract_string(value, '$.level') AS level, json_extract_string(value, '$.service') AS source, json_extract_string(value, '$.message') AS message FROM {duck_lines('json')}")
def parse_json(spark, sf):
    return _fields(event_lines(spark, sf, "json"), format="json")


_M5424 = r"regexp_extract(value, '^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$', %d)"


@query(f"""WITH f AS (SELECT seq, CAST({_M5424 % 1} AS INT) AS pri, {_M5424 % 3} AS t, {_M5424 % 4} AS host, {_M5424 % 5} AS app, {_M5424 % 8} AS message FROM {duck_lines('rfc5424')})
SELECT seq, CAST(replace(t[1:19], 'T', ' ') AS TIMESTAMP) AS ts, CASE WHEN {duck_level('message')} = 'INFO' THEN ['FATAL','FATAL','FATAL','ERROR','WARN','INFO','INFO','DEBUG'][pri % 8 + 1] ELSE {duck_level('message')} END AS level,
CASE WHEN app = '-' THEN host ELSE host || ':' || app END AS source, message FROM f""")
def parse_syslog5424(spark, sf):
    return _fields(event_lines(spark, sf, "rfc5424"), format="syslog")


_M3164 = r"regexp_extract(value, '^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$', %d)"


@query(f"WITH f AS (SELECT seq, {_M3164 % 1} AS t, {_M3164 % 2} AS source, {_M3164 % 3} AS message FROM {duck_lines('rfc3164')}) SELECT seq, strptime('{YEAR} ' || t, '%Y %b %d %H:%M:%S') AS ts, {duck_level('message')} AS level, source, message FROM f")
def parse_syslog3164(spark, sf):
    return _fields(event_lines(spark, sf, "rfc3164"), format="syslog")


@query(rf"SELECT seq, CAST(value[1:19] AS TIMESTAMP) AS ts, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 1) AS level, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 2) AS source, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 3) AS message FROM {duck_lines('text')}")
def parse_text(spark, sf):
    return _fields(event_lines(spark, sf), format="text")


@query(" UNION ALL ".join(f"SELECT * FROM ({SQL[q]}) WHERE seq % 4 = {k}" for k, q in enumerate(("parse_text", "parse_json", "parse_syslog5424", "parse_syslog3164"))))
def parse_dispatch(spark, sf):
    return _fields(mixed_lines(spark, sf))


_HEADS = "concat(CASE event_id % 5 WHEN 0 THEN 'warning svc1 started ' WHEN 1 THEN '[svc2] ERROR in ' WHEN 2 THEN 'svc3: fatal at ' WHEN 3 THEN 'INFO [svc4] got ' ELSE 'no level word ' END, event_type)"


@query(f"SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'INFO' ELSE CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END END AS level, CASE event_id % 5 WHEN 0 THEN 'svc1' WHEN 1 THEN 'svc2' WHEN 2 THEN 'svc3' WHEN 3 THEN 'svc4' ELSE '' END AS source, concat(CASE event_id % 5 WHEN 0 THEN ' started ' WHEN 1 THEN ' ERROR in ' WHEN 2 THEN ' fatal at ' WHEN 3 THEN ' got ' ELSE 'no level word ' END, event_type) AS rest FROM events")
def level_source_split(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr(_HEADS).alias("value"))
    return parsing.split_level_source(e, "value").select("seq", "level", "source", "rest")


@query(rf"SELECT seq, CAST(value[1:19] AS TIMESTAMP) AS ts, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 1) AS level, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 2) AS source, regexp_extract(value, '^.{{20}}(\S+) (\S+) (.*)$', 3) AS message FROM {duck_lines('text')}")
def parse_custom(spark, sf):
    return _fields(event_lines(spark, sf), format="custom", custom_regex=r"(?P<timestamp>\S+ \S+) (?P<level>\S+) (?P<source>\S+) (?P<message>.*)")


@query("SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN make_timestamp(epoch_us(ts) // 1000000 * 1000000) ELSE date_trunc('second', ts) END AS ts FROM events")
def parse_timestamp(spark, sf):
    e = table(spark, sf, "events")
    text = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), 'Z') WHEN 2 THEN cast(unix_seconds(cast(ts AS timestamp)) AS string) ELSE concat('[', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0800]') END")
    return e.select(F.col("event_id").alias("seq"), text.alias("text")).select("seq", parsing.parse_timestamp(F.col("text"), YEAR).alias("ts"))


# Dates within texts, by event_id % 12: (text in Spark, what it reads as in DuckDB)
_DATES = [
    ("concat('seen on ', date_format(ts, 'd MMM yyyy HH:mm:ss'), ' by the gate')", "date_trunc('second', ts)"),
    ("date_format(ts, 'MMM d, yyyy h:mm:ss a')", "date_trunc('second', ts)"),
    ("date_format(ts, 'yyyy/MM/dd HH:mm')", "date_trunc('minute', ts)"),
    ("date_format(ts, 'MM/dd/yyyy HH:mm:ss')", "date_trunc('second', ts)"),
    ("date_format(ts, \"yyyyMMdd'T'HHmmss\")", "date_trunc('second', ts)"),
    ("concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')", "date_trunc('second', ts)"),
    ("date_format(ts, 'MMMM d yyyy')", "date_trunc('day', ts)"),
    ("date_format(ts, 'yyyy-MM-dd')", "date_trunc('day', ts)"),
    ("'no date in here'", "NULL"),
    ("date_format(ts, 'dd.MM.yyyy')", "make_timestamp(year(ts), CASE WHEN day(ts) <= 12 THEN day(ts) ELSE month(ts) END, CASE WHEN day(ts) <= 12 THEN month(ts) ELSE day(ts) END, 0, 0, 0)"),
    ("date_format(ts, 'MM/dd/yy h a')", "date_trunc('hour', ts)"),
    ("date_format(ts, 'MMM d HH:mm:ss.SSS')", f"CAST(date_trunc('millisecond', ts) AS TIMESTAMP) + to_years(CAST({YEAR} - year(ts) AS INTEGER))"),
]


@query("SELECT event_id, CAST(CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {x[1]}" for k, x in enumerate(_DATES)) + " END AS TIMESTAMP) AS ts FROM events")
def parse_fuzzy_dates(spark, sf):
    text = F.expr("CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {x[0]}" for k, x in enumerate(_DATES)) + " END")
    return table(spark, sf, "events").select("event_id", parsing.parse_timestamp(text, YEAR).alias("ts"))


@query(f"SELECT seq, {duck_level('value')} AS level FROM {duck_lines('text')}")
def extract_level(spark, sf):
    return event_lines(spark, sf).select("seq", parsing.extract_level(F.col("value")).alias("level"))


@query("SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'WARN' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'DEBUG' ELSE 'WARN' END AS level FROM events")
def normalize_level(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr("CASE event_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'Critical' WHEN 2 THEN 'debug' ELSE 'WARN' END").alias("l"))
    return e.select("seq", parsing.normalize_level(F.col("l")).alias("level"))


# --- masking

_PATTERNS = {p["name"]: p["regex"] for p in Settings().preprocess.patterns}
_IP = r"CASE WHEN contains({x}, '.') AND regexp_matches(substr({x}, 1, 30), '[0-9]') THEN regexp_replace({x}, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b', '<IP>', 'g') ELSE {x} END"
_UUID = r"regexp_replace({x}, '\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\b', '<UUID>', 'g')"
_PATH = r"regexp_replace({x}, '(?:/[\w\-.~]+)+\.?(?:[\w\-]+)?', '<PATH>', 'g')"
_NUM = r"regexp_replace({x}, '\b\d+\b', '<NUM>', 'g')"
# letters beyond ASCII are word characters too; a neighbour that two numbers share needs a second pass
_NUM_UNICODE = r"regexp_replace({x}, '(^|[^\pL\pN\pM_])\p{{Nd}}+($|[^\pL\pN\pM_])', '\1<NUM>\2', 'g')"
_EMAIL = r"regexp_replace({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '<EMAIL>', 'g')"


def _mask(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("value", masking.mask(F.col("value"), name, _PATTERNS[name]))


def _doc(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("n").cast("bigint").alias("n"), "value")


@query(f"SELECT seq, {_IP.format(x='value')} AS value FROM {duck_lines('text')}")
def mask_ip(spark, sf):
    return _mask(event_lines(spark, sf), "IP")


@query("SELECT event_id AS seq, concat('key <UUID> end ', event_type) AS value FROM events")
def mask_uuid(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr("concat('key ', regexp_replace(md5(cast(event_id AS string)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'), ' end ', event_type)").alias("value"))
    return _mask(e, "UUID")


@query(f"SELECT page_id AS seq, {_PATH.format(x='url')} AS value FROM pages")
def mask_path(spark, sf):
    return _mask(table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("value")), "PATH")


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n, {_NUM_UNICODE.format(x=_NUM_UNICODE.format(x='value'))} AS value FROM {_DOC_LINES}")
def mask_num(spark, sf):
    return _doc(_mask(documents_lines(spark, sf), "NUM"))


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n, {_EMAIL.format(x='value')} AS value FROM {_DOC_LINES}")
def mask_email(spark, sf):
    return _doc(_mask(documents_lines(spark, sf), "EMAIL"))


def _nest(*forms: str) -> str:
    x = "value"
    for f in forms:
        x = f.format(x=x)
    return x


_ALL = f"(SELECT seq, {_EMAIL.format(x=_NUM.format(x=_PATH.format(x=_UUID.format(x='v1'))))} AS value FROM (SELECT seq, {_IP.format(x='value')} AS v1 FROM {duck_lines('text')}))"


@query(f"SELECT seq, value FROM {_ALL}")
def mask_all(spark, sf):
    return masking.mask_all(event_lines(spark, sf), "value", Settings().preprocess)


@query(rf"SELECT doc_id, CAST(n AS BIGINT) AS n, array_to_string(t, '~') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM (SELECT doc_id, n, CASE WHEN len(regexp_extract_all(value, '[^\s]+')) = 0 THEN ['<EMPTY>'] ELSE regexp_extract_all(value, '[^\s]+') END AS t FROM {_DOC_LINES})")
def tokenize(spark, sf):
    t = _doc(documents_lines(spark, sf)).withColumn("t", masking.tokenize(F.col("value")))
    return t.select("doc_id", "n", F.array_join("t", "~").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


# --- mining


_PARTS = "(SELECT concat('T', lpad(CAST(min(p_partkey) AS VARCHAR), 6, '0')) AS template_id, string_split(t, ' ') AS tokens FROM (SELECT p_partkey, concat(p_name, ' ', p_type, ' ', p_brand) AS t FROM part) GROUP BY t)"


def part_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Short token lists that stand for templates: the distinct texts of the parts, under the least key of each."""
    p = table(spark, sf, "part").groupBy(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("template")).agg(F.min("p_partkey").alias("k"))
    return p.select(F.concat(F.lit("T"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("template_id"), "template", F.split("template", " ").alias("tokens"))


def mining_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plans.masked_lines(entries(spark, sf), Settings())


# Messages of many shapes, by event_id % 10: first words that differ in one word, words that vary within a leaf, other
# lengths.  (message, what masking makes of it, its template's name, the name of what its template is merged into).
_SHAPES = [
    ("concat(event_type, ' request by user ', user_id, ' took ', event_id % 997, ' ms')", "concat(event_type, ' request by user <NUM> took <NUM> ms')", "event_type", "<*> request by user <NUM> took <NUM> ms"),
    ("concat('Connection opened to 10.0.', user_id % 250, '.', event_id % 250, ' after ', event_id % 97, ' ms')", "'Connection opened to <IP> after <NUM> ms'", "'opened'", "Connection <*> to <IP> after <NUM> ms"),
    ("concat('Connection closed to 10.0.', user_id % 250, '.', event_id % 250, ' after ', event_id % 97, ' ms')", "'Connection closed to <IP> after <NUM> ms'", "'closed'", "Connection <*> to <IP> after <NUM> ms"),
    ("concat('Cache refresh of region ', event_type, ' finished')", "concat('Cache refresh of region ', event_type, ' finished')", "'cache'", ""),
    ("concat('GET /api/v', user_id % 3, '/', event_type, ' returned ', 200 + event_id % 5)", "'GET <PATH> returned <NUM>'", "'get'", ""),
    ("concat('Payment of ', event_id % 1009, ' for order ', event_id, ' declined by gateway code ', user_id % 9)", "'Payment of <NUM> for order <NUM> declined by gateway code <NUM>'", "'payment'", ""),
    ("concat('Job ', event_id, ' started')", "'Job <NUM> started'", "'job'", ""),
    ("concat('Job ', event_id, ' stopped')", "'Job <NUM> stopped'", "'job'", ""),
    ("'Timeout'", "'Timeout'", "'timeout'", ""),
    ("concat('Session of user ', user_id, ' expired in zone z', user_id % 40)", "concat('Session of user <NUM> expired in zone z', user_id % 40)", "'session'", ""),
]


def _shaped(k: int) -> str:
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(_SHAPES)) + " END"


def mining_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed plain lines of the events, with messages of many shapes."""
    line = f"concat({_SPARK_TIMES['ts']}, ' ', {LEVEL}, ' svc', user_id % 5, ' ', {_shaped(0)})"
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.expr(line).alias("value"))
    return line_source.parsed(e, Section(Settings().input), YEAR)


# g: the template of a line before merging; f: after it, where that has another text
_INTO = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{x[3]}'" for i, x in enumerate(_SHAPES) if x[3]) + f" ELSE {_shaped(2)} END"
_MINED = f"(SELECT event_id AS seq, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, {LEVEL} AS level, concat('svc', user_id % 5) AS source, {_shaped(1)} AS masked, {_shaped(2)} AS g, {_INTO} AS f FROM events)"
_MADE = f"(SELECT f, g, arg_min(masked, seq) AS template, row_number() OVER (ORDER BY min(seq)) AS k FROM {_MINED} GROUP BY f, g)"
# j: the place of a template among the m that become one; those get the next ids, by their first
_FAMILIES = f"(SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) AS j, count(*) OVER (PARTITION BY f) AS m, min(k) OVER (PARTITION BY f) AS k1, max(k) OVER () AS last FROM {_MADE})"
_FINAL = f"(SELECT f, g, k, j, m, CASE WHEN m = 1 THEN template ELSE f END AS template, CASE WHEN m = 1 THEN k ELSE last + dense_rank() OVER (ORDER BY m = 1, k1) END AS id FROM {_FAMILIES})"


def _mined_stats(keys: str, more: str) -> str:
    return f"SELECT printf('T%06d', x.id) AS template_id, x.template AS template, count(*) AS count, {more} FROM {_MINED} l JOIN {keys} x ON l.g = x.g GROUP BY 1, 2"


_RAW = f"(SELECT *, k AS id FROM {_MADE})"
_SEEN = "min(ts) AS first_seen, max(ts) AS last_seen, bool_or(level IN ('ERROR', 'FATAL')) AS is_error"


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Natural lines: all sentences of the turns."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("source"), F.posexplode(F.split("text", r"[.\n]")).alias("k", "message"))
    seq = (F.col("conv_id") * 1000 + F.col("turn")) * 100_000 + F.col("k")
    return plans.masked_lines(c.select(seq.alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("INFO").alias("level"), "source", "message"), Settings())


_LISTS = r"(SELECT p AS line, min(seq) AS first_seq, string_split(p, ' ') AS tokens FROM (SELECT seq, array_to_string(regexp_extract_all(event_type || ' ' || props || ' u' || (user_id % 40), '[^\s]+'), ' ') AS p FROM (SELECT event_id AS seq, * FROM events)) GROUP BY p)"


def routing_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), masking.tokenize(F.concat("event_type", F.lit(" "), "props", F.lit(" u"), (F.col("user_id") % 40).cast("string"))).alias("tokens"))
    return mining.distinct_lists(e)


@query(f"""WITH l AS (SELECT line, first_seq, tokens, len(tokens) AS n, tokens[1] AS t0, tokens[2] AS t1 FROM {_LISTS}),
a AS (SELECT n, t0, row_number() OVER (PARTITION BY n ORDER BY min(first_seq), t0) AS k FROM l GROUP BY n, t0),
l0 AS (SELECT l.*, CASE WHEN k <= 3 THEN a.t0 ELSE '<*>' END AS r0 FROM l JOIN a ON l.n = a.n AND l.t0 = a.t0),
b AS (SELECT n, r0, t1, row_number() OVER (PARTITION BY n, r0 ORDER BY min(first_seq), t1) AS k FROM l0 GROUP BY n, r0, t1)
SELECT line, l0.n AS n, l0.r0 AS r0, CASE WHEN k <= 3 THEN b.t1 ELSE '<*>' END AS r1 FROM l0 JOIN b ON l0.n = b.n AND l0.r0 = b.r0 AND l0.t1 = b.t1""")
def leaf_routing(spark, sf):
    return mining.leaf_routing(routing_lists(spark, sf), 4, 3).select("line", F.col("n").cast("bigint").alias("n"), "r0", "r1")


@query(f"WITH p AS (SELECT * FROM {_PARTS}), q AS (SELECT tokens AS b FROM p WHERE template_id = (SELECT min(template_id) FROM p)) SELECT template_id, CASE WHEN len(tokens) <> len(b) OR m < 2 THEN 0.0 ELSE (2 + 0.001) / 4 END AS score FROM (SELECT template_id, tokens, b, len(list_filter(list_zip(tokens, b), lambda x: x[1] = x[2])) AS m FROM p, q)")
def template_similarity(spark, sf):
    p = part_templates(spark, sf)
    first = p.agg(F.min_by("tokens", "template_id").alias("b"))
    return p.join(F.broadcast(first), F.lit(True)).select("template_id", mining.similarity(F.col("tokens"), F.col("b"), 0.5).alias("score"))


_MAIN = f"(SELECT g, arg_max(level, n * 100000000 - s) AS main_level FROM (SELECT g, level, count(*) AS n, min(seq) AS s FROM {_MINED} GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT t.* EXCLUDE (g), main_level FROM ({_mined_stats(_RAW, _SEEN + ', min(l.g) AS g')}) t JOIN {_MAIN} m ON t.g = m.g")
def drain_templates(spark, sf):
    rows, templates, _ = plans.mine(mining_entries(spark, sf), Settings(), merge=False)
    return templates.select("template_id", "template", "count", "first_seen", "last_seen", "is_error", "main_level")


@query()
def template_ids(spark, sf):
    lines = stored(conversation_lines(spark, sf).select("seq", "tokens"), "lines")
    return mining.template_ids(lines, mining.assign_templates(lines, Settings().drain)).select("template_id", "template", "created_seq")


@query(f"SELECT template_id, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(level IN ('ERROR', 'FATAL')) AS is_error FROM {_TEMPLATED} GROUP BY template_id")
def template_stats(spark, sf):
    return mining.template_stats(templated(spark, sf)).select("template_id", "count", "first_seen", "last_seen", "is_error")


@query("SELECT event_type AS template_id, concat('L', user_id % 4) AS level, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY 1, 2")
def level_histogram(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("template_id"), F.concat(F.lit("L"), F.col("user_id") % 4).alias("level"))
    return mining.level_histogram(e)


@query(f"SELECT template_id, string_agg(source, ',' ORDER BY k) AS sources FROM (SELECT template_id, source, row_number() OVER (PARTITION BY template_id ORDER BY min(seq), source) AS k FROM {_TEMPLATED.replace('user_id % 5', 'user_id')} GROUP BY template_id, source) WHERE k <= 100 GROUP BY template_id")
def source_list(spark, sf):
    e = templated(spark, sf).drop("source").join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("svc"), "user_id").alias("source")), "seq")
    return mining.source_lists(e).select("template_id", F.array_join("sources", ",").alias("sources"))


@query(f"SELECT template_id, count(*) AS count FROM {_TEMPLATED} GROUP BY template_id HAVING bool_or(level IN ('ERROR', 'FATAL'))")
def error_templates(spark, sf):
    return mining.template_stats(templated(spark, sf)).where("is_error").select("template_id", "count")


@query(f"SELECT template_id, arg_max(level, n * 100000000 - s) AS main_level FROM (SELECT concat(template_id, seq % 3) AS template_id, level, count(*) AS n, min(seq) AS s FROM {_TEMPLATED} GROUP BY 1, 2) GROUP BY 1")
def main_level(spark, sf):
    t = templated(spark, sf).withColumn("template_id", F.concat("template_id", F.col("seq") % 3))
    return mining.template_stats(t).select("template_id", "main_level")


@query(f"SELECT a.template_id AS a, b.template_id AS b, CAST(list_position(list_transform(list_zip(a.tokens, b.tokens), lambda x: x[1] <> x[2]), true) - 1 AS INT) AS pos FROM {_PARTS} a JOIN {_PARTS} b ON a.template_id < b.template_id AND len(a.tokens) = len(b.tokens) AND len(list_filter(list_zip(a.tokens, b.tokens), lambda x: x[1] <> x[2])) = 1")
def merge_candidates(spark, sf):
    return mining.merge_candidates(part_templates(spark, sf)).select("a", "b", F.col("pos").cast("int").alias("pos"))


@query()
def merge_templates(spark, sf):
    return mining.merge_templates(part_templates(spark, sf))[0].select("template_id", "template", "rank")


@query(_mined_stats(_FINAL, _SEEN + ", CAST(count(DISTINCT source) AS INT) AS n_sources"))
def merged_stats(spark, sf):
    rows, templates, _ = plans.mine(mining_entries(spark, sf), Settings(), merge=True)
    return templates.select("template_id", "template", "count", "first_seen", "last_seen", "is_error", F.size("sources").alias("n_sources"))


@query("SELECT user_id AS template_id, count(*) AS count, count(*) < 12 AS is_rare FROM events GROUP BY user_id")
def rare_templates(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("template_id")).agg(F.count("*").alias("count"))
    return mining.compress(t, 10, 12)


_KIND = "CASE WHEN j <= 2 THEN 'created' WHEN j = m AND m % 2 = 1 THEN 'wildcard' ELSE 'existing' END"
_EVENTS = f"(SELECT first_seen AS at, 'created' AS event_type, template_id, NULL::VARCHAR AS related_template_id, '' AS details FROM ({_mined_stats(_FINAL, _SEEN)}) UNION ALL SELECT NULL, 'merged', printf('T%06d', k), printf('T%06d', id), {_KIND} FROM {_FINAL} WHERE m > 1)"


@query(f"SELECT * FROM {_EVENTS}")
def template_events(spark, sf):
    rows, templates, merges = plans.mine(mining_entries(spark, sf), Settings())
    return mining.lifecycle_events(mining.compress(templates, 10, 5), merges)


@query("SELECT event_type AS template_id, greatest(0.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS seconds FROM events GROUP BY 1")
def active_duration(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("template_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return t.select("template_id", mining.active_seconds(F.col("a"), F.col("z")).alias("seconds"))


@query("SELECT a.template_id AS a_id, b.template_id AS b_id FROM (SELECT concat(p_name, ' ', p_type, ' ', p_brand) AS template, concat('A', min(p_partkey)) AS template_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a JOIN (SELECT concat(p_name, ' ', p_type, ' ', p_brand) AS template, concat('B', min(p_partkey)) AS template_id FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) b USING (template)")
def reconcile_exact(spark, sf):
    return _reconciled(spark, sf).where("match = 'exact'").select("a_id", "b_id")


_SIDE = "(SELECT template, string_split(template, ' ') AS tokens, concat('{n}', min(p_partkey)) AS template_id FROM (SELECT p_partkey, concat(p_name, ' ', p_type, ' ', p_brand) AS template FROM part WHERE p_partkey % 2 = {k}) GROUP BY template)"


@query(f"""WITH a AS {_SIDE.format(n='A', k=0)}, b AS (SELECT * FROM {_SIDE.format(n='B', k=1)} WHERE template NOT IN (SELECT template FROM a)),
p AS (SELECT b.template_id AS b_id, a.template_id AS a_id, len(a.tokens) AS n, list_transform(list_zip(a.tokens, b.tokens), lambda x: x[1] = x[2]) AS e FROM a JOIN b ON len(a.tokens) = len(b.tokens)),
s AS (SELECT *, len(list_filter(e, lambda x: x)) AS same FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY same / n DESC, a_id) AS r FROM s WHERE same / n >= 0.4)
SELECT b_id, a_id, 'similar' AS match, same / n AS score, CASE WHEN n - same = 1 THEN CAST(list_position(e, false) - 1 AS INT) ELSE -1 END AS wildcard_pos FROM k WHERE r = 1
UNION ALL SELECT template_id, NULL, 'new', 0.0, -1 FROM b WHERE template_id NOT IN (SELECT b_id FROM k)""")
def reconcile_similar(spark, sf):
    """wildcard_pos is -1 where not just one position differs."""
    return _reconciled(spark, sf).where("match <> 'exact'").withColumn("wildcard_pos", F.coalesce("wildcard_pos", F.lit(-1)))


def _reconciled(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    side = lambda k, n: table(spark, sf, "part").where(F.col("p_partkey") % 2 == k).groupBy(text.alias("template")).agg(F.concat(F.lit(n), F.min("p_partkey")).alias("template_id"), F.count("*").alias("count")).withColumn("tokens", F.split("template", " "))
    return mining.reconcile(side(0, "A"), side(1, "B"), 0.4)


# --- clustering


@query(f"""WITH t AS (SELECT * FROM {_PARTS}), w AS (SELECT token, row_number() OVER (ORDER BY token) AS k FROM (SELECT DISTINCT unnest(tokens) AS token FROM t)),
c AS (SELECT template_id, string_agg(chr(CAST(65536 + k AS INT)), '' ORDER BY p) AS code, count(*) AS n FROM (SELECT template_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM t) JOIN w USING (token) GROUP BY template_id)
SELECT a.template_id AS a, b.template_id AS b, levenshtein(a.code, b.code) / greatest(a.n, b.n) AS distance FROM c a JOIN c b ON a.template_id < b.template_id WHERE levenshtein(a.code, b.code) / greatest(a.n, b.n) < 0.3""")
def template_distance(spark, sf):
    got = clustering.near_pairs(part_templates(spark, sf), 0.3)
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def _cluster_templates(spark, sf):
    p = part_templates(spark, sf)
    seen = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("T"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("template_id")).agg(F.count("*").alias("count"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    return p.join(seen, "template_id")


_LEADERS = f"""(WITH RECURSIVE o AS MATERIALIZED (SELECT template_id, tokens, CAST(row_number() OVER (ORDER BY count DESC, template_id) AS BIGINT) AS r FROM {_PARTS} JOIN (SELECT concat('T', lpad(CAST(l_partkey AS VARCHAR), 6, '0')) AS template_id, count(*) AS count FROM lineitem GROUP BY 1) USING (template_id)),
w AS (SELECT token, row_number() OVER (ORDER BY token) AS k FROM (SELECT DISTINCT unnest(tokens) AS token FROM o)),
c AS MATERIALIZED (SELECT r, string_agg(chr(CAST(65536 + k AS INT)), '' ORDER BY p) AS code, count(*) AS n FROM (SELECT r, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM o) JOIN w USING (token) GROUP BY r),
d AS MATERIALIZED (SELECT a.r AS r, b.r AS s, levenshtein(a.code, b.code) / greatest(a.n, b.n) AS distance FROM c a JOIN c b ON b.r < a.r WHERE levenshtein(a.code, b.code) / greatest(a.n, b.n) < 0.3),
near AS MATERIALIZED (SELECT o.r AS r, coalesce(list(s) FILTER (s IS NOT NULL), []) AS before FROM o LEFT JOIN d ON o.r = d.r GROUP BY o.r),
l(k, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT k + 1, CASE WHEN list_has_any(before, leaders) THEN leaders ELSE list_append(leaders, k + 1) END FROM l JOIN near ON near.r = k + 1),
leader AS (SELECT unnest(leaders) AS s, generate_subscripts(leaders, 1) AS age FROM (SELECT arg_max(leaders, k) AS leaders FROM l)),
joined AS (SELECT d.r AS r, arg_min(d.s, d.distance * 1000000000 + age) AS s FROM d JOIN leader USING (s) WHERE d.r NOT IN (SELECT s FROM leader) GROUP BY d.r UNION ALL SELECT s, s FROM leader)
SELECT printf('C%04d', age) AS cluster_id, x.template_id AS representative_id, o.template_id AS template_id, CAST(o.r - 1 AS INT) AS rank FROM joined j JOIN leader ON leader.s = j.s JOIN o ON o.r = j.r JOIN o x ON x.r = j.s)"""


@query(f"SELECT * FROM {_LEADERS}")
def leader_clusters(spark, sf):
    return clustering.cluster(_cluster_templates(spark, sf), 0.3)


@query(f"""WITH m AS MATERIALIZED {_LEADERS}, t AS (SELECT concat('T', lpad(CAST(l_partkey AS VARCHAR), 6, '0')) AS template_id, count(*) AS count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1), p AS (SELECT template_id, array_to_string(tokens, ' ') AS template FROM {_PARTS})
SELECT cluster_id, max(template) FILTER (template_id = representative_id) AS representative_str, CAST(sum(count) AS BIGINT) AS total_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, string_agg(template_id, ',' ORDER BY rank) AS templates
FROM m JOIN t USING (template_id) JOIN p USING (template_id) GROUP BY cluster_id""")
def leader_cluster_stats(spark, sf):
    """The statistics of the clusters that leader clustering finds."""
    t = stored(_cluster_templates(spark, sf), "templates")
    got = clustering.cluster_stats(clustering.cluster(t, 0.3), t)
    return got.select("cluster_id", "representative_str", "total_count", "first_seen", "last_seen", F.array_join("templates", ",").alias("templates"))


_NAMED = "(SELECT p_name AS cluster_id, l_partkey AS template_id, count(*) AS count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _named(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), F.col("p_name").alias("cluster_id"))
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("template_id")).agg(F.count("*").alias("count"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    members = p.select("cluster_id", F.col("template_id").alias("representative_id"), "template_id", F.col("template_id").alias("rank")).withColumn("representative_id", F.lit(None).cast("bigint"))
    return clustering.cluster_stats(members, seen.withColumn("template", F.col("template_id").cast("string")))


@query(f"SELECT cluster_id, CAST(sum(count) AS BIGINT) AS total_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS members FROM {_NAMED} GROUP BY 1")
def cluster_stats(spark, sf):
    return _named(spark, sf).select("cluster_id", "total_count", "first_seen", "last_seen", F.size("templates").cast("bigint").alias("members"))


@query(f"SELECT cluster_id, CAST(sum(count) AS BIGINT) AS total_count FROM {_NAMED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_clusters(spark, sf):
    return _named(spark, sf).select("cluster_id", "total_count").orderBy(F.desc("total_count"), "cluster_id").limit(20)


# --- anomalies

_P_TEXT = "SELECT p_partkey AS template_id, concat(p_name, ' ', p_type, ' ', p_brand) AS template FROM part"


def _texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("template"))


@query(f"WITH t AS ({_P_TEXT}), b AS (SELECT * FROM t WHERE template_id % 3 = 0) SELECT template_id, template FROM t WHERE template NOT IN (SELECT template FROM b) AND template_id NOT IN (SELECT template_id FROM b)")
def new_templates(spark, sf):
    t = _texts(spark, sf)
    return anomaly.new_templates(t, t.where("template_id % 3 = 0")).select("template_id", "template")


@query(f"SELECT template_id, template FROM ({_P_TEXT}) WHERE NOT regexp_matches(template, 'bolt|^red') AND NOT regexp_matches(template, 'Brand#1\\d?$')")
def whitelist_filter(spark, sf):
    return anomaly.whitelisted(_texts(spark, sf), ["bolt|^red", r"Brand#1\d?$"])


@query(f"SELECT template_id, template FROM ({_P_TEXT}) WHERE regexp_matches(template, 'widget|ECONOMY')")
def focus_filter(spark, sf):
    return anomaly.focused(_texts(spark, sf), ["widget", "ECONOMY"])


@query("SELECT CAST(count(*) FILTER (n >= 24) AS BIGINT) AS enough, count(*) FILTER (n >= 24) = 0 AS data_insufficient FROM (SELECT user_id, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n FROM events GROUP BY user_id)")
def data_sufficiency(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("template_id"), "ts")
    return anomaly.sufficiency(timeseries.gap_filled(timeseries.counts(e, "day"), "day")).select("enough", "data_insufficient")


# --- time series


def _series(spark, sf, unit="hour"):
    return timeseries.counts(templated(spark, sf), unit)


def _bucket_sql(unit: str) -> str:
    return f"SELECT event_type AS template_id, date_trunc('{unit}', ts) AS bucket, count(*) AS value FROM events GROUP BY 1, 2"


@query(_bucket_sql("minute").replace("date_trunc('minute', ts)", "CAST(date_trunc('minute', ts) AS TIMESTAMP)"))
def bucket_minute(spark, sf):
    return _series(spark, sf, "minute")


@query(_bucket_sql("hour").replace("date_trunc('hour', ts)", "CAST(date_trunc('hour', ts) AS TIMESTAMP)"))
def bucket_hour(spark, sf):
    return _series(spark, sf)


@query(_bucket_sql("day").replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def bucket_day(spark, sf):
    return _series(spark, sf, "day")


_FILLED = "(WITH s AS (SELECT event_type AS template_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(*) AS value FROM events GROUP BY 1, 2), g AS (SELECT template_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM s GROUP BY template_id) SELECT template_id, bucket, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g LEFT JOIN s USING (template_id, bucket))"


def _filled(spark, sf):
    return timeseries.gap_filled(_series(spark, sf))


@query(f"SELECT * FROM {_FILLED}")
def gap_fill(spark, sf):
    return _filled(spark, sf)


@query(f"SELECT template_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM {_FILLED} GROUP BY 1")
def series_stats(spark, sf):
    return timeseries.series_stats(_filled(spark, sf)).select("template_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"SELECT template_id, bucket, value FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM {_FILLED} WINDOW w AS (PARTITION BY template_id)) WHERE value > m + 2 * s")
def spikes(spark, sf):
    return timeseries.spikes(_filled(spark, sf), 2.0).select("template_id", "bucket", "value")


@query("""WITH s AS (SELECT user_id AS template_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket FROM events GROUP BY 1, 2), z AS (SELECT max(bucket) AS z FROM s)
SELECT template_id, date_diff('day', max(bucket), max(z)) AS zeros, max(bucket) + INTERVAL 1 DAY AS vanished_since FROM s, z GROUP BY template_id HAVING date_diff('day', max(bucket), max(z)) >= 3""")
def vanished(spark, sf):
    s = timeseries.counts(table(spark, sf, "events").select(F.col("user_id").alias("template_id"), "ts"), "day")
    last = s.agg(F.max("bucket").alias("z")).first().z
    return timeseries.vanished(timeseries.gap_filled(s, "day", F.lit(last).cast("timestamp_ntz")), 3).select("template_id", "zeros", "vanished_since")


_LAGGED = f"""(WITH x AS (SELECT template_id, bucket, value - avg(value) OVER (PARTITION BY template_id) AS d, row_number() OVER (PARTITION BY template_id ORDER BY bucket) AS i, count(*) OVER (PARTITION BY template_id) AS n FROM {_FILLED}),
v AS (SELECT template_id, sum(d * d) AS den FROM x GROUP BY 1),
p AS (SELECT a.template_id, b.i - a.i AS lag, max(a.n) AS n, sum(a.d * b.d) AS num FROM x a JOIN x b ON a.template_id = b.template_id AND b.i - a.i BETWEEN 1 AND least(a.n // 2, 48) - 1 GROUP BY 1, 2)
SELECT template_id, n, lag, CASE WHEN den = 0 THEN 0.0 ELSE num / den END AS value FROM p JOIN v USING (template_id))"""


@query(f"SELECT template_id, CAST(lag AS INT) AS lag, round(value, 6) AS value FROM {_LAGGED}")
def autocorrelation(spark, sf):
    return timeseries.autocorrelation(_filled(spark, sf)).select("template_id", "lag", F.round("value", 6).alias("value"))


def _wave(spark, sf):
    """Events of a daily rhythm: more of them around noon."""
    hours = timeseries.gap_filled(_series(spark, sf))
    return hours.withColumn("value", F.col("value") + F.when(F.hour("bucket") == 12, 50).otherwise(0))


def _periods(lagged: str) -> str:
    return f"""(SELECT template_id, coalesce(max(value) FILTER (peak) > 0.5, false) AS is_periodic, CASE WHEN max(value) FILTER (peak) > 0.5 THEN CAST(arg_max(lag, value - lag * 1e-12) FILTER (peak) AS DOUBLE) END AS period_hours
FROM (SELECT *, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w, false) AND value > 0.3 AND n >= 24 AS peak FROM {lagged} WINDOW w AS (PARTITION BY template_id ORDER BY lag)) GROUP BY template_id)"""


_WAVE = f"(SELECT template_id, bucket, value + CASE WHEN hour(bucket) = 12 THEN 50 ELSE 0 END AS value FROM {_FILLED})"


@query(f"SELECT template_id, is_periodic, period_hours FROM {_periods(_LAGGED.replace(_FILLED, _WAVE))}")
def periodicity(spark, sf):
    return timeseries.periodicity(timeseries.autocorrelation(_wave(spark, sf)))


@query(f"""WITH s AS (SELECT template_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM {_FILLED} GROUP BY 1), x AS (SELECT template_id FROM {_FILLED} f JOIN s USING (template_id) WHERE f.value > mean + 2 * std)
SELECT template_id, n, round(mean, 6) AS mean, round(std, 6) AS std, n >= 24 AS sufficient, n >= 24 AND template_id IN (SELECT template_id FROM x) AS has_spike, false AS has_vanished, NULL::TIMESTAMP AS vanished_since, n >= 24 AND coalesce(is_periodic, false) AS is_periodic, period_hours
FROM s LEFT JOIN {_periods(_LAGGED)} p USING (template_id)""")
def timeseries_analysis(spark, sf):
    """Series end at their own last bucket, so that none vanishes."""
    got = timeseries.analyze(templated(spark, sf).select("template_id", "ts"), n_std=2.0).drop("spike_timestamps")
    return got.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# --- correlation


def _pairs_events(spark, sf):
    return templated(spark, sf).select("template_id", "ts")


@query("SELECT event_type AS template_id, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, sf):
    return correlate.event_counts(_pairs_events(spark, sf))


@query("SELECT user_id AS template_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10 OR (SELECT count(DISTINCT user_id) FROM events) <= 100")
def rare_filter(spark, sf):
    return correlate.frequent(correlate.event_counts(table(spark, sf, "events").select(F.col("user_id").alias("template_id"), "ts")), 10)


@query("SELECT template_id, max(k) AS peak FROM (SELECT event_type AS template_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 600000000 FOLLOWING) AS k FROM events) GROUP BY 1 HAVING max(k) > 3")
def burst_templates(spark, sf):
    return correlate.burst_templates(_pairs_events(spark, sf), 600, 3)


_CO = "(SELECT a, b, count(*) AS co, count(*) FILTER (d < 1000000) AS sim FROM (SELECT x.event_id, x.event_type AS a, y.event_type AS b, min(epoch_us(y.ts) - epoch_us(x.ts)) AS d FROM events x JOIN events y ON x.event_type <> y.event_type AND y.ts >= x.ts AND y.ts <= x.ts + INTERVAL 600 SECOND GROUP BY 1, 2, 3) GROUP BY a, b)"


def _co(spark, sf):
    return correlate.co_occurrence(_pairs_events(spark, sf), 600)


@query(f"SELECT * FROM {_CO}")
def co_occurrence(spark, sf):
    return _co(spark, sf)


_SYM = f"(WITH p AS (SELECT * FROM {_CO}), f AS (SELECT coalesce(p.a, q.b) AS a, coalesce(p.b, q.a) AS b, coalesce(p.co, 0) AS co, coalesce(p.sim, 0) AS sim, coalesce(q.co, 0) AS co2, coalesce(q.sim, 0) AS sim2 FROM p FULL JOIN p q ON p.a = q.b AND p.b = q.a) SELECT a, b, CASE WHEN sim + sim2 > 0 AND co < co2 THEN co2 ELSE co END AS co, CASE WHEN sim + sim2 > 0 AND co < co2 THEN co2 ELSE sim END AS sim FROM f WHERE co > 0 OR sim + sim2 > 0)"


@query(f"SELECT * FROM {_SYM}")
def co_occurrence_sym(spark, sf):
    return correlate.symmetrised(_co(spark, sf))


_HALVES = ["event_id % 2 = 0", "event_id % 2 = 1"]


def _co_half(k: int) -> str:
    return _CO.replace("FROM events x JOIN events y", f"FROM (SELECT * FROM events WHERE {_HALVES[k]}) x JOIN (SELECT * FROM events WHERE {_HALVES[k]}) y")


@query(f"SELECT a, b, CAST(sum(co) AS BIGINT) AS co, CAST(sum(sim) AS BIGINT) AS sim FROM (SELECT * FROM {_co_half(0)} UNION ALL SELECT * FROM {_co_half(1)}) GROUP BY a, b")
def correlate_merge_state(spark, sf):
    """Half of the events counted, saved as a state, loaded and added to the counts of the other half."""
    from sawmill.sources import libraries

    half = lambda k: templated(spark, sf).where(F.col("seq") % 2 == k).select("template_id", "ts")
    at = new_path(spark, "correlation")
    libraries.save_correlation(correlate.co_occurrence(half(0), 600), correlate.event_counts(half(0)), at)
    pairs, _ = libraries.load_correlation(spark, at)
    return correlate.merged_state(correlate.co_occurrence(half(1), 600), pairs)


_RULES = f"""(WITH c AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1), g AS (SELECT count(*)::DOUBLE AS total FROM events),
r AS (SELECT s.a, s.b, least(s.co, ca.n, cb.n) AS co, least(s.sim, s.co, ca.n, cb.n) AS sim, ca.n AS an, cb.n AS bn, total FROM {_SYM} s JOIN c ca ON s.a = ca.t JOIN c cb ON s.b = cb.t, g)
SELECT a, b, co / total AS support, co / an AS confidence, (co / an) / (bn / total) AS lift, pow(co - an * bn / total, 2) / (an * bn / total) AS chi2, co / (an + bn - co) AS jaccard, co AS co_count, an AS a_count, bn AS b_count, sim = co AND co > 0 AS is_simultaneous FROM r)"""


def _rules(spark, sf, **limits):
    events = _pairs_events(spark, sf)
    counts = correlate.event_counts(events)
    return correlate.rules(correlate.symmetrised(_co(spark, sf)), counts, events.count(), **limits)


_METRICS = ("support", "confidence", "lift", "chi2", "jaccard")


@query("SELECT a, b, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + f", co_count, a_count, b_count, is_simultaneous FROM {_RULES}")
def association_rules(spark, sf):
    return _rules(spark, sf).select("a", "b", *[F.round(m, 6).alias(m) for m in _METRICS], "co_count", "a_count", "b_count", "is_simultaneous")


@query(f"SELECT a, b, round(lift, 6) AS lift FROM {_RULES} WHERE support >= 0.001 AND confidence >= 0.01 AND lift >= 0.5 AND chi2 >= 3.841 ORDER BY lift DESC")
def significant_rules(spark, sf):
    return _rules(spark, sf, min_support=0.001, min_confidence=0.01, min_lift=0.5).where("is_significant").select("a", "b", F.round("lift", 6).alias("lift")).orderBy(F.desc("lift"))


def _directed(rules: str) -> str:
    return f"""SELECT x.a AS a, x.b AS b, x.confidence AS confidence FROM {rules} x LEFT JOIN {rules} y ON x.a = y.b AND x.b = y.a
WHERE y.a IS NULL OR CASE WHEN abs(x.confidence - y.confidence) >= 0.05 OR abs(x.co_count - y.co_count) / greatest(x.co_count, y.co_count, 1) >= 0.05
THEN x.confidence > y.confidence OR (x.confidence = y.confidence AND (x.co_count > y.co_count OR (x.co_count = y.co_count AND x.a < x.b)))
ELSE NOT (x.is_simultaneous AND y.is_simultaneous) AND (x.confidence > y.confidence OR (x.confidence = y.confidence AND x.a < x.b)) END"""


@query(f"WITH e AS (SELECT * FROM {_RULES}) SELECT a, b, round(confidence, 6) AS confidence FROM ({_directed('e')})")
def directed_edges(spark, sf):
    return correlate.directed(_rules(spark, sf)).select("a", "b", F.round("confidence", 6).alias("confidence"))


_EDGES = "(SELECT DISTINCT concat('n', n_nationkey) AS a, concat('n', (n_nationkey * 7 + n_regionkey) % 25) AS b FROM nation UNION SELECT concat('n', n_nationkey), concat('n', (n_nationkey * 3 + 1) % 25) FROM nation WHERE n_nationkey % 4 = 0)"


def _edges(spark, sf):
    n = table(spark, sf, "nation")
    node = lambda e: F.concat(F.lit("n"), F.expr(e).cast("string"))
    return n.select(node("n_nationkey").alias("a"), node("(n_nationkey * 7 + n_regionkey) % 25").alias("b")).union(n.where("n_nationkey % 4 = 0").select(node("n_nationkey"), node("(n_nationkey * 3 + 1) % 25"))).distinct()


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), v AS (SELECT a AS x FROM e UNION SELECT b FROM e) SELECT x AS node, least(x, coalesce(min(q.b), x)) AS component FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) q ON q.a = x GROUP BY x")
def scc(spark, sf):
    return correlate.scc_table(_edges(spark, sf))


_STRONG = f"(SELECT * FROM {_RULES} WHERE support >= 0.001 AND confidence >= 0.01 AND lift >= 0.5 AND chi2 >= 3.841 AND NOT is_simultaneous)"


@query(f"""WITH RECURSIVE s AS MATERIALIZED {_STRONG}, e AS MATERIALIZED ({_directed("s")}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), v AS (SELECT a AS x FROM e UNION SELECT b FROM e),
c AS MATERIALIZED (SELECT x, least(x, coalesce(min(q.b), x)) AS c FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) q ON q.a = x GROUP BY x),
names AS (SELECT c, CASE WHEN count(*) = 1 THEN c ELSE '[' || string_agg(x, ', ' ORDER BY x) || ']' END AS name FROM c GROUP BY c),
w AS MATERIALIZED (SELECT f.c AS i, t.c AS j, max(confidence) AS w FROM e JOIN c f ON e.a = f.x JOIN c t ON e.b = t.x WHERE f.c <> t.c GROUP BY 1, 2),
p(j, path, total) AS (SELECT j, [i, j], w FROM w UNION ALL SELECT w.j, list_append(p.path, w.j), p.total + w.w FROM p JOIN w ON p.j = w.i),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY j ORDER BY total DESC, list_reverse(path)) = 1)
SELECT string_agg(name, ' -> ' ORDER BY k) AS path, round(total, 6) AS total_confidence, CAST(count(*) AS INTEGER) AS length
FROM (SELECT j, total, unnest(path) AS c, generate_subscripts(path, 1) AS k FROM best) JOIN names USING (c) GROUP BY j, total""")
def causal_chains(spark, sf):
    r = _rules(spark, sf, min_support=0.001, min_confidence=0.01, min_lift=0.5)
    chains = correlate.causal_chains(r.where("is_significant"))
    return chains.select(F.array_join("path", " -> ").alias("path"), F.round("total_confidence", 6).alias("total_confidence"), "length")


@query("SELECT event_type AS template_id, make_timestamp(epoch_us(a) + CASE WHEN n = 1 THEN 0 ELSE CAST(floor(span * i / (n - 1)) AS BIGINT) END) AS ts FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT event_type, count(*) AS n, min(ts) AS a, greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 1000000) AS span FROM events GROUP BY 1))")
def synthetic_events(spark, sf):
    from sawmill.sources.libraries import synthetic_events as made

    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("template_id")).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return made(t)


@query("SELECT concat('T', p_partkey) AS template_id, p_name AS template, CAST(p_size AS BIGINT) AS count, p_size % 7 = 0 AS is_error, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS rank FROM part")
def library_load(spark, sf):
    """The parts as a JSON library of one document, a template a line, written and loaded again."""
    from sawmill.sources import libraries

    levels = F.when(F.col("p_size") % 7 == 0, F.create_map(F.lit("ERROR"), F.lit(1))).otherwise(F.create_map(F.lit("INFO"), F.lit(1)))
    one = F.struct(F.concat(F.lit("T"), "p_partkey").alias("template_id"), F.col("p_name").alias("template_str"), F.struct(F.col("p_size").alias("count"), levels.alias("level_counts")).alias("stats"))
    parts = ranked(table(spark, sf, "part").select("p_partkey", F.to_json(one).alias("value")), [F.col("p_partkey"), F.col("value")], "rank")
    at = new_path(spark, "library")
    libraries.save_library(parts, at)
    return libraries.load_library(spark, at).select("template_id", "template", "count", "is_error", "rank")


# --- diff

_LIB = "(SELECT concat(p_brand, ' ', p_type) AS template, {agg}(concat('{k}', p_partkey)) AS template_id, count(*) AS count, bool_or(l_returnflag = 'R') AS is_error FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY 1)"
_OLD, _NEW = _LIB.format(agg="min", k="A", where="l_shipdate < TIMESTAMP '1995-06-01' AND p_brand <> 'Brand#3'"), _LIB.format(agg="min", k="B", where="l_shipdate >= TIMESTAMP '1994-06-01' AND p_brand <> 'Brand#7'")
_DIFF = f"(SELECT coalesce(n.template_id, o.template_id) AS template_id, template, coalesce(o.count, 0) AS count_old, coalesce(n.count, 0) AS count_new, CASE WHEN coalesce(o.count, 0) > 0 THEN (coalesce(n.count, 0) - o.count) / o.count WHEN coalesce(n.count, 0) > 0 THEN 1e308 * 10 ELSE 0.0 END AS change, o.template_id IS NULL AS added, n.template_id IS NULL AS removed, coalesce(o.is_error, false) OR coalesce(n.is_error, false) AS is_error FROM {_OLD} o FULL JOIN {_NEW} n USING (template))"
_BUCKET = "CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN change >= 0.5 AND count_new > count_old THEN 'increased' WHEN change <= -0.5 AND count_new < count_old THEN 'decreased' ELSE 'unchanged' END"


def _compared(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = li.select("l_partkey", "l_shipdate", "l_returnflag").join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lib = lambda k, w: j.where(w).groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("template")).agg(F.min(F.concat(F.lit(k), F.col("p_partkey"))).alias("template_id"), F.count("*").alias("count"), F.bool_or(F.col("l_returnflag") == "R").alias("is_error"))
    return diff.compare(lib("A", "l_shipdate < '1995-06-01' AND p_brand <> 'Brand#3'"), lib("B", "l_shipdate >= '1994-06-01' AND p_brand <> 'Brand#7'"), 0.5)


@query(f"SELECT template_id, template, count_old, count_new, CASE WHEN added AND count_new > 0 THEN -1 ELSE round(change, 6) END AS count_change, is_error FROM {_DIFF}")
def library_diff(spark, sf):
    c = _compared(spark, sf)
    return c.select("template_id", "template", "count_old", "count_new", F.when(F.col("count_change") == float("inf"), -1.0).otherwise(F.round("count_change", 6)).alias("count_change"), "is_error")


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM {_DIFF} GROUP BY 1")
def diff_buckets(spark, sf):
    return _compared(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN count(*) FILTER (added AND is_error) > 0 THEN 1 WHEN count(*) FILTER ((added AND count_new > 0) OR {_BUCKET} = 'increased') > 0 THEN 2 ELSE 0 END AS exit_code, count(*) FILTER (added AND is_error) AS new_error_templates FROM {_DIFF}")
def diff_exit_code(spark, sf):
    return diff.exit_code(_compared(spark, sf)).select("exit_code", "new_error_templates")


# --- alerts and tags

_RULE_LIST = [{"name": "many", "condition": "total_templates > 3 and not spike_count >= 100", "severity": "critical"}, {"name": "slow", "condition": "processing_speed < 50000", "severity": "info"}, {"name": "half", "condition": "error_template_count / total_templates > 0.9", "severity": "warning"}, {"name": "fresh", "condition": "max(new_template_count, 1) >= 1", "severity": "warning"}, {"name": "bad", "condition": "__import__('os')", "severity": "critical"}, {"name": "none", "condition": "spike_count / 0 > 1", "severity": "critical"}]
_METRIC_ROW = "SELECT count(*) FILTER (n > 1990) AS new_template_count, count(*) FILTER (t = 'error' OR t = 'view') AS error_template_count, count(*) FILTER (n > 100000) AS spike_count, count(*) AS total_templates, sum(n) / 10.0 AS processing_speed FROM (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1)"


def _metrics(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("t")).agg(F.count("*").alias("n"))
    flagged = t.select((F.col("n") > 1990).alias("is_new"), F.col("t").isin("error", "view").alias("is_error"), (F.col("n") > 100000).alias("is_spike"))
    return alerts.metrics(flagged, table(spark, sf, "events").count(), 10.0)


@query(_METRIC_ROW)
def alert_metrics(spark, sf):
    return _metrics(spark, sf)


@query(f"WITH m AS ({_METRIC_ROW}) SELECT name, severity FROM (SELECT 'many' AS name, 'critical' AS severity, total_templates > 3 AND NOT spike_count >= 100 AS holds FROM m UNION ALL SELECT 'slow', 'info', processing_speed < 50000 FROM m UNION ALL SELECT 'half', 'warning', error_template_count / total_templates > 0.9 FROM m UNION ALL SELECT 'fresh', 'warning', greatest(new_template_count, 1) >= 1 FROM m) WHERE holds")
def triggered_alerts(spark, sf):
    return alerts.fired(_metrics(spark, sf), _RULE_LIST).select("name", "severity")


_TAG_RULES = [{"pattern": "(?i)economy|small", "tags": ["price/low", "stock"]}, {"pattern": r"Brand#1\d", "tags": ["brand/top/one", "stock"]}, {"pattern": "bolt", "tags": ["kind/metal/bolt"]}]
_TAGGED = r"(SELECT template_id, template, list_concat(CASE WHEN a THEN ['price/low', 'stock'] ELSE [] END, list_concat(CASE WHEN b THEN (CASE WHEN a THEN ['brand/top/one'] ELSE ['brand/top/one', 'stock'] END) ELSE [] END, CASE WHEN c THEN ['kind/metal/bolt'] ELSE [] END)) AS tags FROM (SELECT *, regexp_matches(template, '(?i)economy|small') AS a, regexp_matches(template, 'Brand#1\d') AS b, contains(template, 'bolt') AS c FROM (" + _P_TEXT + ")))"
_EXPANDED = f"(SELECT DISTINCT template_id, array_to_string(string_split(tag, '/')[1:i], '/') AS tag FROM (SELECT template_id, tag, unnest(generate_series(1, len(string_split(tag, '/')))) AS i FROM (SELECT template_id, unnest(tags) AS tag FROM {_TAGGED})))"


def _tagged(spark, sf):
    return _texts(spark, sf).withColumn("tags", tags.tags_of(F.col("template"), _TAG_RULES))


@query(f"SELECT template_id, array_to_string(tags, ',') AS tags FROM {_TAGGED}")
def tag_templates(spark, sf):
    return _tagged(spark, sf).select("template_id", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT template_id, tag FROM {_EXPANDED}")
def tag_hierarchy(spark, sf):
    return _tagged(spark, sf).select("template_id", F.explode(tags.expanded(F.col("tags"))).alias("tag"))


@query(f"SELECT template_id FROM {_EXPANDED} WHERE tag = 'brand/top'")
def tag_filter(spark, sf):
    return tags.filtered(_tagged(spark, sf), "brand/top").select("template_id")


@query(f"SELECT tag, count(*) AS n FROM {_EXPANDED} GROUP BY 1")
def tag_counts(spark, sf):
    return tags.tag_counts(_tagged(spark, sf))


@query(f"SELECT template_id, array_to_string(list_transform(tags, lambda t: '[' || t || ']'), ' ') AS badges FROM {_TAGGED}")
def tag_badges(spark, sf):
    return _tagged(spark, sf).select("template_id", tags.badges(F.col("tags")).alias("badges"))


# --- reports


@query("SELECT count(*) AS total_logs, count(DISTINCT event_type) AS total_templates, count(DISTINCT event_type) AS total_clusters, round(count(*) / 2.5, 6) AS processing_speed FROM events")
def summary(spark, sf):
    """Templates of one token each, which are clusters of their own."""
    rows = templated(spark, sf)
    templates = mining.template_stats(rows).withColumn("tokens", F.array("template_id"))
    return reports.totals(rows, templates, clustering.cluster(templates), 2.5).withColumn("processing_speed", F.round("processing_speed", 6))


_REPORT = "SELECT concat('U', user_id) AS template_id, count(*) AS count, max(props) AS template, count(*) FILTER (event_type = 'error') >= 20 AS is_error, count(*) > 60 AS is_spike, count(*) < 15 AS is_rare FROM events GROUP BY 1"


@query(f"SELECT template_id, count, template, CASE WHEN concat_ws(', ', CASE WHEN is_error THEN '错误' END, CASE WHEN is_spike THEN '激增' END, CASE WHEN is_rare THEN '稀有' END) = '' THEN '正常' ELSE concat_ws(', ', CASE WHEN is_error THEN '错误' END, CASE WHEN is_spike THEN '激增' END, CASE WHEN is_rare THEN '稀有' END) END AS status FROM ({_REPORT}) ORDER BY count DESC, template_id LIMIT 20")
def top_templates(spark, sf):
    t = table(spark, sf, "events").groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("template_id")).agg(F.count("*").alias("count"), F.max("props").alias("template"), (F.count_if(F.col("event_type") == "error") >= 20).alias("is_error"), (F.count("*") > 60).alias("is_spike"), (F.count("*") < 15).alias("is_rare"))
    return reports.top_templates(t.withColumn("main_level", F.lit("INFO"))).drop("main_level")


@query(f"""WITH t AS ({_mined_stats(_FINAL, _SEEN)}), e AS (SELECT CASE WHEN event_type = 'created' THEN 'created' ELSE 'ended' END AS part, template_id, "at", coalesce(epoch_us("at"), 0) AS k FROM {_EVENTS}
UNION ALL SELECT 'longest', template_id, first_seen, epoch_us(last_seen) - epoch_us(first_seen) FROM t)
SELECT part, template_id, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k DESC, template_id) AS r FROM e) WHERE r <= 5""")
def evolution(spark, sf):
    rows, templates, merges = plans.mine(mining_entries(spark, sf), Settings())
    return reports.evolution(mining.lifecycle_events(templates, merges), templates)


_TENTH = "printf('%.1f', floor(s / {} * 10 + 0.5) / 10)"


@query(f"SELECT event_id, CASE WHEN s < 60 THEN printf('%.0f秒', s) WHEN s < 3600 THEN {_TENTH.format(60)} || '分钟' WHEN s < 86400 THEN {_TENTH.format(3600)} || '小时' ELSE {_TENTH.format(86400)} || '天' END AS text FROM (SELECT event_id, CAST(event_id * 37 AS DOUBLE) AS s FROM events)")
def format_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", reports.format_duration((F.col("event_id") * 37).cast("double")).alias("text"))


@query(f"SELECT template_id, bucket, round((row_number() OVER (PARTITION BY template_id ORDER BY bucket) - 1) * 600.0 / (count(*) OVER (PARTITION BY template_id) - 1), 6) AS x, round(100.0 - value * 100.0 / greatest(max(value) OVER (PARTITION BY template_id), 1), 6) AS y FROM {_FILLED}")
def chart_points(spark, sf):
    return reports.chart_points(_filled(spark, sf)).select("template_id", "bucket", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- state and streams


@query(f"SELECT template_id, template, count FROM ({_mined_stats(_RAW, _SEEN)})")
def state_roundtrip(spark, sf):
    from sawmill.sources import libraries

    rows, templates, _ = plans.mine(mining_entries(spark, sf), Settings(), merge=False)
    at = new_path(spark, "state")
    libraries.save_state(templates, at)
    return libraries.load_state(spark, at).select("template_id", "template", "count")


@query(f"SELECT template_id, template, count, is_error FROM ({_mined_stats(_RAW, _SEEN)})")
def incremental_mining(spark, sf):
    """Two batches, one after the other, against one stored state."""
    from sawmill.streaming import incremental

    settings, e = Settings(), stored(mining_entries(spark, sf), "entries")
    middle = e.agg((F.max("seq") / 2).alias("m")).first().m
    first = stored(incremental.advance(incremental.empty_state(spark), e.where(F.col("seq") <= middle), settings), "state")
    second = incremental.advance(first, e.where(F.col("seq") > middle), settings)
    return second.select("template_id", "template", "count", "is_error")


# Files of lines by user, as they are first and then: appended to, cut (the last eighth alone), replaced, left alone.
_GROWN = f"(SELECT event_id, user_id % 4 AS c, concat('u', user_id % 40, '.log') AS name, {_FORMATS['text'].format(**_DUCK_TIMES)} AS value, event_id > m / 2 AS late, event_id > m * 7 / 8 AS final FROM events, (SELECT max(event_id) AS m FROM events))"
_TWICE = f"(SELECT 1 AS round, event_id, c, name, value, late FROM {_GROWN} WHERE NOT late UNION ALL SELECT 2, event_id, c, name, CASE c WHEN 2 THEN concat('x', value) ELSE value END, late FROM {_GROWN} WHERE c = 0 OR c = 2 OR (c = 1 AND final))"


@query(f"SELECT round, name, position, value FROM (SELECT *, CAST(sum(strlen(value) + 1) OVER (PARTITION BY round, name ORDER BY event_id) - strlen(value) - 1 AS BIGINT) AS position FROM {_TWICE}) WHERE round = 1 OR c > 0 OR late")
def incremental_append(spark, sf):
    """Log files written twice, and what each batch reads of them."""
    from sawmill.sources import growing

    m = table(spark, sf, "events").agg(F.max("event_id").alias("m")).first().m or 0
    e = event_lines(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id"), "seq")
    e = e.select("seq", (F.col("user_id") % 4).alias("c"), F.concat(F.lit("u"), F.col("user_id") % 40, F.lit(".log")).alias("name"), "value")
    e = stored(e.withColumns({"late": F.col("seq") > m / 2, "final": F.col("seq") > m * 7 / 8}), "grown")
    root, out, offsets = new_path(spark, "logs"), None, None
    first = e.where("not late")
    second = e.where("c in (0, 2) or (c = 1 and final)").withColumn("value", F.when(F.col("c") == 2, F.concat(F.lit("x"), "value")).otherwise(F.col("value")))
    for k, lines in enumerate((first, second), 1):
        growing.write_files(lines, root).agg(F.sum("bytes")).collect()
        read, after = growing.incremental_append(spark, [f"{root}/*.log"], offsets)
        got = stored(read.select(F.lit(k).alias("round"), F.element_at(F.split("path", "/"), -1).alias("name"), "position", "value"), "appended")
        out, offsets = got if out is None else out.unionByName(got), stored(after, "offsets")
    dropped(e)
    return out


@query(f"SELECT template, count, first_seen, last_seen, is_error, n_sources FROM ({_mined_stats(_FINAL, _SEEN + ', CAST(count(DISTINCT source) AS INT) AS n_sources')})")
def state_versions(spark, sf):
    """Three batches mined and merged into one versioned state, which is compacted and read back."""
    from sawmill.sources.state import StateStore

    e, store = stored(mining_entries(spark, sf), "entries"), StateStore(spark, new_path(spark, "state"))
    m = e.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first().m
    for k in range(3):
        part = e.where((F.col("seq") > m * k // 3) & (F.col("seq") <= m * (k + 1) // 3) if k else F.col("seq") <= m // 3)
        plans.advance_state(store, part, Settings(), batch=str(k))
    store.compact()
    store.expire(1)
    dropped(e)
    return store.templates().select("template", "count", "first_seen", "last_seen", "is_error", F.size("sources").alias("n_sources"))


@query(SQL["bucket_hour"])
def stream_available_now(spark, sf):
    """Event counts by hour as a stream that ends with the input."""
    from sawmill.streaming import incremental, vanishing

    at = new_path(spark, "counts")
    counts = incremental.windowed_counts(_event_stream(spark, sf, "event_type"))
    vanishing.counts_to_table(counts, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return vanishing.latest_counts(spark, f"{at}/table").select("template_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "value")


def _event_stream(spark: SparkSession, sf: str, template: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return stream.select(F.expr(template).alias("template_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT template_id, CAST(ts AS TIMESTAMP) AS vanished_since FROM (SELECT concat('u', user_id) AS template_id, date_trunc('second', ts) AS ts,
lead(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(date_trunc('second', ts)) OVER () AS newest FROM events WHERE ts IS NOT NULL)
WHERE CASE WHEN next IS NULL THEN ts + INTERVAL 2 DAY <= newest - INTERVAL 1 HOUR ELSE next - ts > INTERVAL 2 DAY END""")
def stream_vanished(spark, sf):
    """Users who fall silent for two days, as a stream with state and timers, written to a table."""
    from sawmill.streaming import vanishing

    at = new_path(spark, "silent")
    silent = vanishing.vanished(_event_stream(spark, sf, "concat('u', user_id)"), "2 days", "1 hour")
    vanishing.to_table(silent, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("template_id string, vanished_since timestamp_ntz").parquet(f"{at}/table")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Lines to templates with statistics, the most frequent first."""
    rows, templates, _ = plans.mine(mining_entries(spark, sf), overridden(Settings(), {}), merge=True)
    return templates.select("template_id", "template", "count", "first_seen", "last_seen", "is_error", "main_level").orderBy(F.desc("count"), "template_id")
