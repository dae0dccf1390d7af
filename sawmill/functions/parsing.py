"""Log lines to (ts, level, source, message) with built-in functions: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.config import Section

NTZ = "timestamp_ntz"
_SEP = "\u0001"
# Level words, severities and line formats.
LEVELS = ("WARNING", "CRITICAL", "DEBUG", "ERROR", "FATAL", "INFO", "WARN")
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
RFC5424 = r"^<(\d{1,3})>(\d)\s+(-|\S+)\s+(-|\S+)\s+(-|\S+)\s+(-|\S+)\s+(-|\S+)\s+(.*)$"
RFC3164 = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
NGINX = r"^\[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]"
_WORDS = "|".join(LEVELS)


def sealed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns behind a generator of one row: later filters on them (and the null checks that joins add)
    aren't pushed below it, which would write each nested step out again wherever it is used."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up == "WARNING", "WARN").when(up == "CRITICAL", "FATAL").otherwise(up)


def extract_level(text: Column) -> Column:
    """The earliest level word, standing alone, of the first 60 characters; else of the whole text; else INFO."""
    near = F.upper(F.regexp_extract(F.substring(text, 1, 60), rf"(?i)(?<!\p{{L}})({_WORDS})(?!\p{{L}})", 1))
    far = F.upper(F.regexp_extract(text, r"(?iU)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b", 1))
    return F.when(near != "", normalize_level(near)).when(far != "", far).otherwise("INFO")


_STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "y": "yy", "I": "hh", "p": "a", "j": "DDD", "z": "Z", "a": "EEE", "A": "EEEE", "%": "%"}


def time_pattern(strptime: str) -> str:
    """A strptime format as a Spark datetime pattern."""
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(.)", strptime, re.S):
        if m[1]:
            if m[1] not in _STRPTIME:
                raise ValueError(f"%{m[1]} has no counterpart")
            out.append(_STRPTIME[m[1]])
        else:
            out.append(f"'{m[2]}'" if m[2] else "''" if m[3] == "'" else m[3])
    return "".join(out)


def _to(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast(NTZ)


def iso_basic(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss, with a space or T, of exactly 19 characters."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$")
    return F.when(ok, _to(F.replace(c, F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss"))


def iso_fraction(c: Column) -> Column:
    """The same with a fraction of up to six digits; a zone behind it is dropped, not converted."""
    ok = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,](\d+)(?:Z|[+-].*)?$"
    digits = F.rpad(F.substring(F.regexp_extract(c, ok, 1), 1, 6), 6, "0")
    base = F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" "))
    return F.when(c.rlike(ok), _to(F.concat(base, F.lit("."), digits), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def iso_zone(c: Column) -> Column:
    """Without a fraction but with a zone, which is dropped."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})$"), iso_basic(F.substring(c, 1, 19)))


def unix_seconds(c: Column) -> Column:
    ok = c.rlike(r"^-?\d+(?:\.\d+)?$")
    return F.when(ok, F.timestamp_micros((c.try_cast("decimal(24,6)") * 1_000_000).cast("bigint")).cast(NTZ))


def syslog_time(c: Column, year: int) -> Column:
    tidy = F.concat(F.lit(f"{year} "), F.regexp_replace(c, r"\s+", " "))
    return F.when(c.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), _to(tidy, "yyyy MMM d HH:mm:ss"))


def nginx_time(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"^\[|\]$", ""), r"\s+[+-]\d{4}$", "")
    return F.when(c.rlike(r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}"), _to(bare, "dd/MMM/yyyy:HH:mm:ss"))


# Names of months.
MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_CLOCK = r"(?i)(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?:\s*([ap])\.?m\b\.?)?"
_HOUR = r"(?i)(?<![\d:.])(\d{1,2})\s*([ap])\.?m\b\.?"
_YEAR_FIRST = r"(?<!\d)(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?(?!\d)"
_YEAR_LAST = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
_COMPACT = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?:[Tt ]?(\d{2})(\d{2})(\d{2})?)?(?!\d)"
_DAY_MONTH = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s,.\-/]*(?:of\s+)?{_MONTH}\b"
_MONTH_DAY = rf"(?i)(?<!\p{{L}}){_MONTH}[\s,.\-/]+(\d{{1,2}})(?:st|nd|rd|th)?(?!\d)"


def fuzzy_time(c: Column, year: int) -> Column:
    """A date or time somewhere in a text: month names with a day and a year in any order, numbers with the year first or
    last (the month before the day unless that can't be), eight or fourteen digits in a row, a clock time with or without
    am and pm.

    Parts that are missing come from today, a missing year is ``year``, a year of two digits lies within fifty years of it.
    Zones and words are passed over.  Null where there is neither a date nor a time, or no such day.
    """
    # bound as a lambda's variable: the text without its clock is computed once, and the generated code stays small
    bare = F.transform(F.array(c), lambda t: F.struct(t.alias("text"), F.regexp_replace(F.regexp_replace(t, _CLOCK, " "), _HOUR, " ").alias("rest")))
    return F.get(F.transform(bare, lambda x: _found_time(x["text"], x["rest"], year)), F.lit(0))


def _found_time(c: Column, rest: Column, year: int) -> Column:
    """A time of the text ``c``, and a date of what is ``rest`` of it without a clock time."""
    got = lambda text, pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
    clock, hour = c.rlike(_CLOCK), c.rlike(_HOUR)
    named = rest.rlike(rf"(?i)(?<!\p{{L}}){_MONTH}(?!\p{{L}})")
    month = F.lit(None).cast("int")
    for k in range(12, 0, -1):
        month = F.when(rest.rlike(rf"(?i)(?<!\p{{L}})(?:{MONTHS[k - 1]})(?!\p{{L}})"), k).otherwise(month)
    first, last, compact = rest.rlike(_YEAR_FIRST), rest.rlike(_YEAR_LAST), rest.rlike(_COMPACT)
    short = lambda y: F.when(y >= 100, y).otherwise(y + F.lit(year // 100 * 100) + F.when(y + (year // 100 * 100) >= year + 50, -100).when(y + (year // 100 * 100) < year - 50, 100).otherwise(0))
    a, b = got(rest, _YEAR_LAST, 1), got(rest, _YEAR_LAST, 2)
    swapped = (a > 12) & (b <= 12)
    today = F.current_date()
    y = F.when(named, got(rest, r"(?<!\d)(\d{4})(?!\d)", 1)).when(first, got(rest, _YEAR_FIRST, 1)).when(last, short(got(rest, _YEAR_LAST, 3))).when(compact, got(rest, _COMPACT, 1))
    m = F.when(named, month).when(first, got(rest, _YEAR_FIRST, 2)).when(last, F.when(swapped, b).otherwise(a)).when(compact, got(rest, _COMPACT, 2)).otherwise(F.month(today))
    d = F.when(named, F.coalesce(got(rest, _DAY_MONTH, 1), got(rest, _MONTH_DAY, 1))).when(first, got(rest, _YEAR_FIRST, 3)).when(last, F.when(swapped, a).otherwise(b)).when(compact, got(rest, _COMPACT, 3))
    noon = lambda h, half: F.when(half == "", h).otherwise(h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    h = F.when(clock, noon(got(c, _CLOCK, 1), F.regexp_extract(c, _CLOCK, 5))).when(hour, noon(got(c, _HOUR, 1), F.regexp_extract(c, _HOUR, 2))).when(compact, got(rest, _COMPACT, 4))
    minute = F.when(clock, got(c, _CLOCK, 2)).when(~hour & compact, got(rest, _COMPACT, 5))
    second = F.when(clock, got(c, _CLOCK, 3)).when(~hour & compact, got(rest, _COMPACT, 6))
    fraction = F.when(clock, F.rpad(F.regexp_extract(c, _CLOCK, 4), 6, "0").cast("int"))
    zero, year_ = F.lit(0), F.coalesce(y, F.lit(year))
    most = F.day(F.last_day(F.try_make_timestamp_ntz(year_, m, F.lit(1), zero, zero, zero.cast("decimal(8,6)")).cast("date")))
    day = F.coalesce(d, F.least(F.day(today), most))
    seconds = (F.coalesce(second, zero).cast("decimal(8,6)") + F.coalesce(fraction, zero).cast("decimal(14,6)") / F.lit(1_000_000)).cast("decimal(8,6)")
    made = F.try_make_timestamp_ntz(year_, m, day, F.coalesce(h, zero), F.coalesce(minute, zero), seconds)
    return F.when(clock | hour | named | first | last | compact, made)


def parse_timestamp(c: Column, year: int, time_format: str = "") -> Column:
    """The first reading that fits: the given format, ISO, ISO with fraction or zone, Unix seconds (UTC), syslog (in
    ``year``), common log format, else a date or time found somewhere in the text.  Null where none does."""
    tries = [_to(c, time_pattern(time_format))] if time_format else []
    tries += [iso_basic(c), iso_fraction(c), iso_zone(c), unix_seconds(c), syslog_time(c, year), nginx_time(c)]
    return F.coalesce(*tries, fuzzy_time(c, year))


_LEVEL_FIRST = r"^ *(?i:(INFO|ERROR|WARN|DEBUG|FATAL|WARNING|CRITICAL))(?= |$) *(?:\[([^\]]*)\]|(?!\[)([^ ]+)|)(.*)$"
_BRACKET = r"^ *\[([^\]]*)\](.*)$"
_COLON = r"^ *([^ :]{0,39}):( .*)$"


def _at(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i))


def _cut(text: Column, pattern: str, form: str, n: int) -> Column:
    return F.split(F.regexp_replace(text, "(?s)" + pattern, form), _SEP, n)


def level_form(text: Column) -> Column:
    """How a text begins: 'level', 'bracket', 'colon', 'blank' or 'plain'."""
    return F.when(text.rlike("^ *$"), "blank").when(text.rlike("(?s)" + _LEVEL_FIRST), "level").when(text.rlike("(?s)" + _BRACKET), "bracket").when(text.rlike("(?s)" + _COLON), "colon").otherwise("plain")


def split_level_source(df: DataFrame, column: str) -> DataFrame:
    """``df`` with level, source and rest: a leading level word takes the next word (or bracket) as source; else a leading
    bracket or ``word: `` is the source and the level is looked for in the rest."""
    text, form = F.col(column), F.col("_form")
    df = df.withColumn("_form", level_form(text))
    parts = F.when(form == "level", _cut(text, _LEVEL_FIRST, f"$1{_SEP}$2$3{_SEP}$4", 3)).when(form == "bracket", _cut(text, _BRACKET, f"$1{_SEP}$2", 2)).when(form == "colon", _cut(text, _COLON, f"$1{_SEP}$2", 2))
    df = df.withColumn("_parts", parts)
    p = F.col("_parts")
    df = df.withColumn("rest", F.when(form == "level", _at(p, 3)).when(form.isin("bracket", "colon"), _at(p, 2)).otherwise(text))
    df = df.withColumn("source", F.when(form == "level", _at(p, 2)).when(form.isin("bracket", "colon"), _at(p, 1)).otherwise(""))
    level = F.when(form == "level", normalize_level(_at(p, 1))).when(form == "blank", "INFO").otherwise(extract_level(F.col("rest")))
    return df.withColumn("level", level).drop("_form", "_parts")


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern with its named groups made plain, and their numbers."""
    compiled = re.compile(pattern)
    return re.sub(r"\(\?P<\w+>", "(", re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\{compiled.groupindex[m[1]]}", pattern)), dict(compiled.groupindex)


def detect_format(line: Column) -> Column:
    s = strip(line)
    return F.when(s.startswith("{") & s.endswith("}"), "json").when(s.startswith("<") & s.rlike(RFC5424), "rfc5424").when(s.rlike(RFC3164), "rfc3164").otherwise("text")


def _kind(options: Section) -> Column:
    """The parser of each line; 'none' where the demanded format doesn't fit, which makes the line its own message."""
    s, wanted = F.col("_s"), options.format
    if wanted == "json":
        return F.lit("json")
    if wanted == "syslog":
        return F.when(s.rlike(RFC5424), "rfc5424").when(s.rlike(RFC3164), "rfc3164").otherwise("none")
    if wanted == "text":
        return F.lit("text")
    if wanted == "custom" and options.custom_regex:
        return F.when(s.rlike(f"^(?:{named_groups(options.custom_regex)[0]})"), "custom").otherwise("none")
    return detect_format(s)


_SYSLOG_TIME = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"


def parse_lines(df: DataFrame, column: str, options: Section, year: int) -> DataFrame:
    """``df`` with ts, level, source, message of the lines in ``column``, by the format of ``options`` (an unknown one is
    auto).  A blank or null line is an empty message.

    The steps are columns of their own, so that none is computed twice.  JSON fields go by the first name that is there
    (null counts as absent); a line that isn't an object is its own message.  Plain lines have a time at their begin.
    """
    line, s, kind = F.col("_line"), F.col("_s"), F.col("_kind")
    df = df.withColumn("_line", F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+$", ""))
    df = df.withColumn("_s", strip(line))
    df = df.withColumn("_kind", _kind(options))
    df = df.withColumn("_json", F.when((kind == "json") & s.startswith("{"), F.from_json(s, "map<string,string>")))
    df = df.withColumn("_kind", F.when((kind == "json") & F.col("_json").isNull(), "none").otherwise(kind))
    field = lambda *names: F.coalesce(*[F.try_element_at(F.col("_json"), F.lit(n)) for n in names])
    parts = F.when(kind == "rfc5424", F.split(F.regexp_replace(s, RFC5424, f"$1{_SEP}$3{_SEP}$4{_SEP}$5{_SEP}$8"), _SEP, 5)).when(kind == "rfc3164", F.split(F.regexp_replace(s, RFC3164, f"$1{_SEP}$2{_SEP}$3"), _SEP, 3))
    df = df.withColumn("_p", parts)
    p = F.col("_p")

    # the time at the begin of a plain line
    iso, text = F.col("_iso"), kind == "text"
    df = df.withColumn("_iso", text & s.rlike(r"(?s)^.{4}-.{2}-.{2}[ T].{2}:.{2}:") & (F.length(s) >= 19))
    wide = iso & s.rlike(r"(?s)^.{19}\.") & (F.length(s) >= 23)
    behind = (
        F.when(wide, F.regexp_replace(s, r"(?s)^.{19}\.[\p{Nd}Z+\-:. ]{0,15}", "")).when(iso, F.substr(s, F.lit(20)))
        .when(text & s.rlike(_SYSLOG_TIME), F.regexp_replace(s, _SYSLOG_TIME, "")).when(text & s.rlike(NGINX), F.regexp_replace(s, NGINX, ""))
        .when(text, F.regexp_replace(s, r"^\d{10}(?:\.\d+)?", ""))
    )
    df = df.withColumn("_behind", behind)
    behind = F.col("_behind")
    df = df.withColumn("_head", F.substr(s, F.lit(1), F.length(s) - F.length(behind)))
    head = F.col("_head")
    df = df.withColumn("_body", F.when(text & (head != ""), F.regexp_replace(behind, r"^[ \-:]+", "")).when(text, s).when(kind == "rfc5424", _at(p, 5)).when(kind == "rfc3164", _at(p, 3)))

    pattern, groups = named_groups(options.custom_regex) if options.format == "custom" and options.custom_regex else ("", {})
    group = lambda name, default: F.regexp_extract(s, f"^(?:{pattern})", groups[name]) if name in groups else default
    time = (
        F.when(kind == "json", field("timestamp", "time", "@timestamp")).when(kind == "rfc5424", F.when(_at(p, 2) != "-", _at(p, 2))).when(kind == "rfc3164", _at(p, 1))
        .when(text & ~iso & (head != ""), head).when(kind == "custom", group(options.timestamp_group, F.lit("")))
    )
    df = df.withColumn("_time", time)
    ts = F.when(iso, iso_basic(F.substring(s, 1, 19))).otherwise(parse_timestamp(F.col("_time"), year, options.time_format))
    df = split_level_source(df.withColumn("_ts", ts), "_body").withColumnsRenamed({"level": "_level", "source": "_source", "rest": "_rest"})
    df = df.withColumn("_said", F.when(kind.startswith("rfc"), extract_level(F.col("_body"))))

    severity = F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), F.pmod(_at(p, 1).try_cast("int"), F.lit(8)) + 1)
    dash = lambda c: F.when(c == "-", "").otherwise(c)
    said = F.col("_said")
    level = (
        F.when(kind == "json", F.coalesce(field("level", "log_level"), F.lit("INFO"))).when(kind == "rfc5424", F.when(said == "INFO", severity).otherwise(said))
        .when(kind == "rfc3164", said).when(kind == "custom", group(options.level_group, F.lit("INFO"))).when(text, F.col("_level")).otherwise("INFO")
    )
    source = (
        F.when(kind == "json", F.coalesce(field("hostname", "service", "source"), F.lit("")))
        .when(kind == "rfc5424", F.when(dash(_at(p, 4)) != "", F.concat_ws(":", dash(_at(p, 3)), _at(p, 4))).otherwise(dash(_at(p, 3))))
        .when(kind == "rfc3164", _at(p, 2)).when(kind == "custom", group(options.source_group, F.lit(""))).when(text, F.col("_source")).otherwise("")
    )
    message = (
        F.when(s == "", "").when(kind == "json", F.coalesce(field("message", "msg", "content"), line)).when(kind.startswith("rfc"), F.col("_body"))
        .when(kind == "custom", group(options.message_group, line)).when(text, strip(F.col("_rest"))).otherwise(line)
    )
    made = sealed(df, {"ts": F.col("_ts"), "level": level, "source": source, "message": message})
    return made.drop("_line", "_s", "_kind", "_json", "_p", "_iso", "_behind", "_head", "_body", "_time", "_ts", "_level", "_source", "_rest", "_said")
