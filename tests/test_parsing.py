import datetime as dt

from pyspark.sql import functions as F

from sawmill.config import Section, Settings, load_settings, merged, overridden
from sawmill.functions import masking, parsing
from sawmill.sources import lines


def parse(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, value string")
    got = parsing.parse_lines(df, "value", Section(Settings().input | options), 2024).orderBy("seq").collect()
    return [(r.ts, r.level, r.source, r.message) for r in got]


T = dt.datetime(2024, 1, 15, 10, 0, 1)


def test_formats(spark):
    got = parse(spark, [
        "2024-01-15 10:00:01 INFO server01 Test message",
        '{"timestamp": "2024-01-15T10:00:01Z", "level": "ERROR", "hostname": "server01", "message": "Test error"}',
        "<165>1 2024-01-15T10:00:01Z server01 app 1234 ID1 Test syslog message",
        "Jan 15 10:00:01 server01 test: Test message",
        "just a simple log message without timestamp",
        '{"message": }',
        '{"msg":"m","time":"2024-01-15 10:00:01","log_level":"warn","service":"s","message":null}',
        "<11>1 - - - 1 ID1 failed",
    ])
    assert got == [
        (T, "INFO", "server01", "Test message"), (T, "ERROR", "server01", "Test error"), (T, "INFO", "server01:app", "Test syslog message"),
        (T, "INFO", "server01", "test: Test message"), (None, "INFO", "", "just a simple log message without timestamp"), (None, "INFO", "", '{"message": }'),
        (T, "warn", "s", "m"), (None, "ERROR", "", "failed"),
    ]


def test_plain_lines(spark):
    got = parse(spark, [
        "2024-01-15 10:00:01 ERROR Database connection failed", "2024-01-15 10:00:01 [ERROR] disk full", "2024-01-15T10:00:01 warning db1 slow",
        "2024-01-15 10:00:01.123 INFO a b", "svc: it is fatal now", "INFO [x y] rest", "INFO", "INFO [open rest", "[15/Jan/2024:10:00:01 +0800] - GET /x", "1705312801 up", "", None, "   ",
    ])
    assert got == [
        (T, "ERROR", "Database", "connection failed"), (T, "INFO", "ERROR", "disk full"), (T, "WARN", "db1", "slow"), (T, "INFO", "a", "b"), (None, "FATAL", "svc", "it is fatal now"),
        (None, "INFO", "x y", "rest"), (None, "INFO", "", ""), (None, "INFO", "", "[open rest"), (T, "INFO", "", "GET /x"), (T, "INFO", "", "up"), (None, "INFO", "", ""), (None, "INFO", "", ""), (None, "INFO", "", ""),
    ]


def test_forced_formats(spark):
    assert parse(spark, ["[1]", "5"], format="json") == [(None, "INFO", "", "[1]"), (None, "INFO", "", "5")]
    assert parse(spark, ["no syslog"], format="syslog") == [(None, "INFO", "", "no syslog")]
    custom = {"format": "custom", "custom_regex": r"(?P<level>\w+)\|(?P<message>.*)"}
    assert parse(spark, ["WARN|hello", "odd"], **custom) == [(None, "WARN", "", "hello"), (None, "INFO", "", "odd")]
    assert parse(spark, ["2024-01-15 10:00:01 INFO a b"], format="nonsense") == [(T, "INFO", "a", "b")]


def test_levels_and_times(spark):
    df = spark.createDataFrame([("This is an ERROR message",), ("WARN: something wrong",), ("debug info here",), ("FATAL error occurred",), ("normal message",), ("x" * 80 + " error",), ("informal",)], "t string")
    assert [r[0] for r in df.select(parsing.extract_level(F.col("t"))).collect()] == ["ERROR", "WARN", "DEBUG", "FATAL", "INFO", "ERROR", "INFO"]
    t = spark.createDataFrame([("2024-01-15 10:00:01.25",), ("2024-01-15T10:00:01+08:00",), ("Jan  5 00:00:00",), ("nonsense",), ("15.01.2024",)], "t string")
    got = [r[0] for r in t.select(parsing.parse_timestamp(F.col("t"), 2023, "%d.%m.%Y")).collect()]
    assert got == [T.replace(microsecond=250000), T, dt.datetime(2023, 1, 5), None, dt.datetime(2024, 1, 15)]


def test_masks_and_tokens(spark):
    texts = ["Connection from 192.168.1.1 port 22", "é5 5é 7", "id 123e4567-e89b-12d3-a456-426614174000 at /var/lög/x.txt", "no digits here until much later on 10.0.0.1", "mail a.b@c.de", "", None]
    df = masking.mask_all(spark.createDataFrame([(t,) for t in texts], "t string"), "t", Settings().preprocess)
    assert [r.t for r in df.collect()] == ["Connection from <IP> port <NUM>", "é5 5é <NUM>", "id <UUID> at <PATH>", "no digits here until much later on <NUM>.<NUM>.<NUM>.<NUM>", "mail <EMAIL>", "", None]
    t = spark.createDataFrame([(" a b  c ",), ("  ",)], "t string").select(masking.tokenize(F.col("t")).alias("x"))
    assert [list(r.x) for r in t.collect()] == [["a", "b", "c"], ["<EMPTY>"]]


def test_scan_and_settings(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    (tmp_path / "b.log").write_bytes(b"thr\xffee\n")
    got = lines.scan_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).orderBy("seq").collect()
    assert [(r.file_idx, r.value) for r in got] == [(0, "one"), (0, ""), (0, "two"), (1, "thr�ee")]
    assert lines.parsed(lines.from_iterable(spark, ["x\n", " \n"]), Section(Settings().input), 2024).count() == 1
    (tmp_path / "c.yaml").write_text("drain: {depth: 6}\ntags: []\n")
    s = overridden(load_settings(str(tmp_path / "c.yaml")), {"drain.sim_th": 0.5, "output.top_n": None})
    assert (s.drain.depth, s.drain.sim_th, s.drain.max_child, s.tags, s.output.top_n) == (6, 0.5, 100, [], 20)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


FUZZY = [
    "15 Jan 2024 10:00:01", "Jan 15, 2024 10:00:01 PM", "15th of January 2024", "on 2024/01/15 at 10:05 we saw", "31/12/2023 23:59", "12/31/2023", "01.02.2024 3pm", "20240115T100203", "seen 20240115",
    "Mon, 15 Jan 2024 10:00:01 GMT", "2024-01-15 10:00", "12:30", "12:30:15.250", "3 pm", "12 am", "September 5 2021 12:01 am", "5 Sept 2021", "2024-02-30", "1/2/99", "7-8-23 04:05", "May 3 2022 noon", "nothing here",
]


def test_dates_within_texts(spark):
    import datetime

    from dateutil import parser

    today = datetime.datetime.combine(datetime.date.today(), datetime.time())

    def reading(text):
        try:
            return parser.parse(text, fuzzy=True, default=today).replace(tzinfo=None)
        except (ValueError, OverflowError):
            return None

    df = spark.createDataFrame([(t,) for t in FUZZY], "t string")
    got = {r.t: r.x for r in df.select("t", parsing.parse_timestamp(F.col("t"), today.year).alias("x")).collect()}
    assert got == {t: reading(t) for t in FUZZY}
