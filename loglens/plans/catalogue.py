"""Registered queries, each over the whole derived log (or another table), with its DuckDB counterpart beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, levels, lines, search
from ..operators import crash, filters, grouping, journal, kernel, metrics, rules
from ..sinks import jsonl, otlp
from ..sources import journal_json, kmsg, sample, text
from ..sources.sample import SQL_CRASHES, SQL_LINES, crash_lines, log_lines
from ..sources.text import last_lines, paginate

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

# SQL pieces.  RE2 has no lookbehind or possessive repeats; on these tables the plain forms below mean the same.
_LEVEL_NAMES = "('trace','debug','info','warn','error','fatal','panic')"
_TITLE = "case when lower({0}) in " + _LEVEL_NAMES + " then upper(substr({0}, 1, 1)) || lower(substr({0}, 2)) end"
_GET = "nullif(regexp_extract({0}, '{1}', {2}), '')"
_TIME = r"(^|[T \[])([0-9]{2}:[0-9]{2}(:[0-9]{2})?)"
_PARSED = f"""parsed as (select *, case when raw like '{{%' then 'json' when raw like '[%' then 'plain_bracketed' when regexp_matches(raw, '(^|[ \\t])(level|severity|lvl)=') then 'plain_logfmt' else 'plain_unknown' end as format,
  {_TITLE.format("named")} as level,
  case when raw like '{{%' then {_GET.format("json_extract_string(raw, '$.time')", "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)} else {_GET.format("raw", r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)} end as date,
  case when raw like '{{%' then {_GET.format("json_extract_string(raw, '$.time')", _TIME, 2)} else {_GET.format("raw", _TIME, 2)} end as time
  from (select *, case when raw like '{{%' then json_extract_string(raw, '$.level') when raw like '[%' then {_GET.format("raw", r"^\[([^\]]+)\]", 1)} else {_GET.format("raw", r"(^|[ \t])(level|severity|lvl)=([^ \t]*)", 3)} end as named from log_lines))"""
_WITH = f"with log_lines as ({SQL_LINES}), {_PARSED} "
_NORMAL = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[0-9]+', '#', 'g')), '[ \t\n\r\v\f]+', ' ', 'g'))"
_SIGNATURE = "lower(regexp_replace(regexp_replace(raw, '[a-fA-F][0-9a-fA-F]{7,}', '<id>', 'g'), '[0-9]+', '#', 'g'))"
_MESSAGE = r"""case format when 'json' then json_extract_string(raw, '$.message') when 'plain_logfmt' then nullif(regexp_extract(raw, 'msg="?([^"]*)', 1), '') when 'plain_bracketed' then regexp_replace(raw, '^[^\]]*\][ :\-]*', '') else raw end"""
_FIRED = "pos, ts_ms, kind, rule_id, file, threshold_count, threshold_window_ms, observed_count, line"


def registered(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _found[name] = (query, sql)
        return query

    return keep


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir)


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).withColumn("info", lines.analyse(F.col("raw")))


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _analysed(spark, sf_dir)
    return own.select(F.col("line_no").alias("pos"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), F.col("info.level").alias("level"), "raw", "file")


def _flat(fired: DataFrame) -> DataFrame:
    return fired.select("pos", "ts_ms", "kind", "rule_id", "file", F.col("threshold.count").alias("threshold_count"), F.col("threshold.window_ms").alias("threshold_window_ms"), "observed_count", "line")


@registered("scan_lines", f"select line_no, file, raw from ({SQL_LINES})")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_no", "file", "raw")


@registered("last_n_lines", f"select line_no, file, raw from ({SQL_LINES}) qualify row_number() over (partition by file order by line_no desc) <= 10")
def last_n_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_lines(_lines(spark, sf_dir)).select("line_no", "file", "raw")


@registered("parse_lines", _WITH + "select line_no, format, level, date, time from parsed")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("line_no", "info.format", "info.level", "info.date", "info.time")


_JSON_LEVEL = """'},"level":"'"""


@registered("parse_level_position", _WITH + f"""select line_no, cast(place as integer) as level_start, cast(place + length(named) as integer) as level_end
from (select *, case when format = 'json' then strpos(raw, {_JSON_LEVEL}) - 1 + length({_JSON_LEVEL}) else strpos(raw, named) - 1 end as place from parsed where named is not null)""")
def parse_level_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).filter(F.col("info.level_start").isNotNull()).select("line_no", "info.level_start", "info.level_end")


@registered("level_order", _WITH + "select line_no, level, cast(list_position(['Trace','Debug','Info','Warn','Error','Fatal','Panic'], level) - 1 as tinyint) as ordinal, level in ('Error','Fatal','Panic') as is_error from parsed where level is not null")
def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("info.level")
    return _analysed(spark, sf_dir).filter(level.isNotNull()).select("line_no", level.alias("level"), levels.level_ordinal(level).alias("ordinal"), levels.is_error(level).alias("is_error"))


@registered("filter_level", _WITH + "select line_no, level, raw from parsed where level in ('Error', 'Fatal')")
def filter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(levels=("Error", "Fatal")).apply(_lines(spark, sf_dir)).select("line_no", "info.level", "raw")



@registered("filter_date", _WITH + "select line_no, date, raw from parsed where date between '2024-01-05' and '2024-01-20'")
def filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(date="2024-01-05..2024-01-20").apply(_lines(spark, sf_dir)).select("line_no", "info.date", "raw")


@registered("filter_time", _WITH + "select line_no, time, raw from parsed where time is null or (time >= '09:30' and time <= '17:00:00')")
def filter_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(from_time="09:30", to_time="17:00:00").apply(_lines(spark, sf_dir)).select("line_no", "info.time", "raw")


@registered("search_or", f"select line_no, raw from ({SQL_LINES}) where contains(lower(raw), 'fatal') or contains(lower(raw), 'user 12')")
def search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(search="FATAL|user 12").apply(_lines(spark, sf_dir)).select("line_no", "raw")


@registered("search_and", f"select line_no, raw from ({SQL_LINES}) where contains(lower(raw), 'error') and contains(lower(raw), 'user 1')")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(search="Error&user 1").apply(_lines(spark, sf_dir)).select("line_no", "raw")


@registered("search_regex", f"select line_no, raw from ({SQL_LINES}) where regexp_matches(raw, '(?is)(error|purchase) failed for user [0-9]+') and regexp_matches(raw, '(?is)after [1-4][0-9]? ms')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(search=r"(error|purchase) failed for user \d+&after [1-4]\d? ms").apply(_lines(spark, sf_dir)).select("line_no", "raw")


@registered("search_documents", "select doc_id from documents where contains(lower(text), 'license') or contains(lower(text), 'token')")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.filter(search.search(F.col("text"), "license|token")).select("doc_id")


@registered("highlight", f"select line_no, cast(strpos(lower(raw), 'failed') - 1 as integer) as first_start, cast((length(lower(raw)) - length(replace(lower(raw), 'failed', ''))) / 6 as integer) as n from ({SQL_LINES}) where contains(lower(raw), 'failed')")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _lines(spark, sf_dir).withColumn("r", search.highlight_ranges(F.col("raw"), "FAILED"))
    return own.filter(F.size("r") > 0).select("line_no", F.col("r")[0]["start"].alias("first_start"), F.size("r").alias("n"))


def _group(mode: str) -> Query:
    return lambda spark, sf_dir: grouping.group_lines(_lines(spark, sf_dir), mode)


def _group_sql(key: str) -> str:
    return _WITH + f"select file, {key} as key, count(*) as count, arg_min(raw, line_no) as sample, min(line_no) as first_pos from parsed group by file, {key}"


registered("agg_exact", _group_sql("raw"))(_group("exact"))
registered("agg_level_message", _group_sql(f"coalesce(level, 'unknown') || chr(31) || trim(coalesce({_MESSAGE}, raw))"))(_group("level-message"))
registered("agg_json_message", _group_sql("trim(coalesce(case when raw like '{%' then json_extract_string(raw, '$.message') end, raw))"))(_group("json-message"))


@registered("agg_normalized", _WITH + f"select file, {_NORMAL} as key, count(*) as count, arg_min(raw, line_no) as sample, min(line_no) as first_pos from parsed where level in ('Error','Fatal','Panic') and date between '2024-01-01' and '2024-01-31' group by all")
def agg_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filters.LogFilter(levels=("Error", "Fatal", "Panic"), date="2024-01-01..2024-01-31")
    return grouping.group_lines(wanted.apply(_lines(spark, sf_dir)), "normalized")


@registered("agg_capped", _WITH + "select file, key, count, sample, first_pos from (select *, row_number() over (partition by file order by first_pos) as r from (select file, level || '' as key, count(*) as count, arg_min(raw, line_no) as sample, min(line_no) as first_pos from (select file, raw, line_no, coalesce(level, 'unknown') || chr(31) || trim(coalesce(" + _MESSAGE + ", raw)) as level from parsed) group by file, level)) where r <= 100")
def agg_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_lines(_lines(spark, sf_dir), "level-message", most_keys=100)


@registered("agg_prefixed", _WITH + f"select file, '[x' || count(*) || '] ' || arg_min(raw, line_no) as line from parsed group by file, {_NORMAL}")
def agg_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_lines_prefixed(grouping.group_lines(_lines(spark, sf_dir), "normalized")).select("file", "line")


@registered("level_summary", _WITH + "select file, level, count(*) as count from parsed where level is not null group by file, level union all select file, null, count(*) from parsed where level is not null group by file")
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.with_total(grouping.count_levels(_lines(spark, sf_dir)))


@registered("jsonl_output", _WITH + """select line_no, '{"level":"' || coalesce(level, '') || '","date":"' || coalesce(date, '') || '","time":"' || coalesce(time, '') || '","raw":"' || replace(replace(raw, '\\', '\\\\'), '"', '\\"') || '"}' as json from parsed""")
def jsonl_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("line_no", jsonl.line_json(F.col("raw"), F.col("info")).alias("json"))


@registered("paginate", f"select line_no, file, cast(ceil(row_number() over (partition by file order by line_no) / 50.0) as bigint) as page from ({SQL_LINES})")
def paginate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate(_lines(spark, sf_dir), 50).select("line_no", "file", "page")


def _rate_sql(kind: str, rule: str, where: str, n: int, window: int) -> str:
    bucket = -(-window // 8)
    return _WITH + f""", counted as (select line_no as pos, epoch_us(ts) // 1000 as t_ms, file, raw, epoch_us(ts) // 1000 // {bucket} as e from parsed where {where}),
    ranked as (select *, row_number() over (order by pos) - count(*) over (order by e range between unbounded preceding and 8 preceding) as obs from counted),
    due as (select *, row_number() over (partition by e order by pos) as k from ranked where obs >= {n})
    select pos, t_ms as ts_ms, '{kind}' as kind, '{rule}' as rule_id, file, cast({n} as integer) as threshold_count, cast({window} as bigint) as threshold_window_ms, obs as observed_count, raw as line from due where k = 1"""


@registered("rule_error_rate", _rate_sql("error_rate", "error_rate", "level in ('Error','Fatal','Panic')", 5, 3_600_000))
def rule_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.error_rate(_ruled(spark, sf_dir), rules.Threshold(5, 3_600_000)))


@registered("rule_regex_rate", _rate_sql("regex", "purchase .*user", "regexp_matches(raw, '(?is)purchase .*user')", 4, 7_200_000))
def rule_regex_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.regex_rate(_ruled(spark, sf_dir), [("purchase .*user", rules.Threshold(4, 7_200_000))]))


@registered("rule_first_seen", _WITH + f"select arg_min(line_no, line_no) as pos, arg_min(epoch_us(ts) // 1000, line_no) as ts_ms, 'first_seen' as kind, 'first_seen' as rule_id, arg_min(file, line_no) as file, cast(1 as integer) as threshold_count, cast(0 as bigint) as threshold_window_ms, cast(1 as bigint) as observed_count, arg_min(raw, line_no) as line from parsed where level in ('Error','Fatal','Panic') group by {_SIGNATURE}")
def rule_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.first_seen(_ruled(spark, sf_dir)))


_SILENT, _UNTIL = 600_000, 1_706_745_600_000


@registered("rule_silence", f"""with log_lines as ({SQL_LINES}), last as (select file, epoch_us(ts) // 1000 as t, max(line_no) as pos from log_lines group by all),
    gaps as (select *, coalesce(lead(t) over (partition by file order by t), {_UNTIL}) as nxt from last),
    due as (select *, t + {_SILENT} as d from gaps where t + {_SILENT} < nxt),
    hits as (select pos, file, d as moment from due union all select pos, file, unnest(range((d // {_SILENT} + 1) * {_SILENT}, nxt, {_SILENT})) from due)
    select pos, moment as ts_ms, 'silence' as kind, 'silence' as rule_id, file, cast(0 as integer) as threshold_count, cast({_SILENT} as bigint) as threshold_window_ms, cast(0 as bigint) as observed_count, '' as line from hits""")
def rule_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.silence(_ruled(spark, sf_dir), _SILENT, _UNTIL))


@registered("signature", _WITH + f"select {_SIGNATURE} as signature, count(*) as count from parsed where level in ('Error','Fatal','Panic') group by 1")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _analysed(spark, sf_dir).filter(levels.is_error(F.col("info.level")))
    return own.groupBy(keys.signature_text(F.col("raw")).alias("signature")).agg(F.count("*").alias("count"))


@registered("metrics_lines_bytes", _WITH + "select coalesce(lower(level), 'unknown') as level, count(*) as lines, cast(sum(strlen(raw)) as bigint) as bytes from parsed group by 1")
def metrics_lines_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.line_counters(_ruled(spark, sf_dir))


@registered("metrics_points", _WITH + """, alerts as (select 'first_seen' as rule, count(distinct """ + _SIGNATURE + """) as n from parsed where level in ('Error','Fatal','Panic'))
    select 'loglens_lines_total' as name, 'level' as label, l as label_value, cast(count(raw) as bigint) as value from unnest(['trace','debug','info','warn','error','fatal','panic','unknown']) as t(l) left join parsed on coalesce(lower(level), 'unknown') = l group by l
    union all select 'loglens_alerts_fired_total', 'rule', r, cast(coalesce(n, 0) as bigint) from unnest(['error_rate','regex','first_seen','silence','kernel_oom','kernel_segfault','kernel_panic','service_crash','service_stop','service_restart']) as t(r) left join alerts on rule = r
    union all select 'loglens_bytes_total', null, null, cast(sum(strlen(raw)) as bigint) from parsed""")
def metrics_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _ruled(spark, sf_dir)
    return metrics.metric_points(own, rules.first_seen(own)).select("name", "label", "label_value", "value")


_CRASH = f"with crash_lines as ({SQL_CRASHES}) "


@registered("crash_markers", _CRASH + "select line_no, 'go_panic' as marker, cast(regexp_extract(raw, '\\[([0-9]+)\\]', 1) as bigint) as pid from crash_lines where contains(raw, 'panic:')")
def crash_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.marked(crash_lines(spark, sf_dir)).filter("marker is not null").select("line_no", "marker", "pid")


@registered("extract_pid", _CRASH + "select line_no, cast(nullif(regexp_extract(raw, '\\[([0-9]+)\\]', 1), '') as bigint) as pid from crash_lines")
def extract_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash_lines(spark, sf_dir).select("line_no", lines.pid(F.col("raw")).alias("pid"))


@registered("trace_lines", _CRASH + "select line_no, raw like chr(9) || '%' as is_trace from crash_lines")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash_lines(spark, sf_dir).select("line_no", crash.is_trace_line(F.col("raw")).alias("is_trace"))


@registered("crash_events", _CRASH + """, ordered as (select *, row_number() over (partition by service order by line_no) as r from crash_lines),
    traces as (select event_id, any_value(service) as service, count(*) filter (where raw like chr(9) || '%') as frames,
      string_agg(case when raw like chr(9) || '%' and line_no - event_id * 64 <= 32 then raw || chr(10) end, '' order by line_no) as stack_trace,
      min(raw) filter (where line_no = event_id * 64) as detail, min(t_ms) as started from crash_lines group by event_id having bool_or(contains(raw, 'panic:')))
    select service, 'service_crash' as kind, 'go_panic' as marker, cast(regexp_extract(detail, '\\[([0-9]+)\\]', 1) as bigint) as pid, row_number() over (partition by service order by event_id) as crash_count, detail, nullif(stack_trace, '') as stack_trace from traces""")
def crash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crash_lines(spark, sf_dir).withColumnRenamed("line_no", "pos")
    return crash.track(own, until_ms=_UNTIL).filter("kind = 'service_crash'").select("service", "kind", "marker", "pid", "crash_count", "detail", "stack_trace")


@registered("service_lookup", f"select line_no, file, case file when 'app0.log' then 'api' else 'web' end as service from ({SQL_LINES}) where file in ('app0.log', 'app1.log')")
def service_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crash.name_services(_lines(spark, sf_dir), [("api", "app0.log"), ("web", "app1.log"), ("late", "app0.log")])
    return own.select("line_no", "file", "service")


#: Journal entries and kernel records made from events, in both engines.
_JOURNAL = {
    "pos": "event_id",
    "message": """case event_id % 6 when 0 then 'Started Daily Cleanup.' when 1 then 'app.service: Main process exited, code=killed, status=9/KILL' when 2 then 'Stopped with code=killed'
      when 3 then concat('panic: lost worker ', cast(user_id as {text})) when 4 then '' else 'listening' end""",
    "unit": "case event_id % 5 when 0 then 'api-1.service' when 1 then 'api.service' when 2 then 'web.service' when 3 then 'apix.socket' end",
    "identifier": "case when event_id % 6 < 3 then 'systemd' else 'app' end",
    "priority": "cast(event_id % 9 as {text})",
}
_KERNEL = {
    "pos": "event_id",
    "record": """concat('4,', cast(event_id as {text}), ',1,-;', case event_id % 5 when 0 then concat('Killed process ', cast(user_id as {text}), ' (worker', cast(event_id % 7 as {text}), '), UID 0')
      when 1 then concat('nginx[', cast(user_id as {text}), ']: segfault at 0 ip 0') when 2 then 'general protection fault: 0000' when 3 then 'usb 1-1: new device' else 'Killed process x (y)' end, chr(10), ' SUBSYSTEM=mm')""",
}
_JOURNAL_SQL, _KERNEL_SQL = sample.select_sql(_JOURNAL, "events"), sample.select_sql(_KERNEL, "events")


def _from_events(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return sample.events_table(spark, sf_dir).selectExpr(*sample.expressions(columns, "string"))


@registered("journal_classify", f"select pos, case when message like 'Started %' or message like 'Stopped %' then 'lifecycle' when contains(message, 'Main process exited, code=killed') then 'crash_signal' else 'other' end as class from ({_JOURNAL_SQL})")
def journal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _JOURNAL).select("pos", journal.manager_class(F.col("message")).alias("class"))


@registered("journal_priority", f"select pos, case priority when '0' then 'Panic' when '1' then 'Panic' when '2' then 'Fatal' when '3' then 'Error' when '4' then 'Warn' when '5' then 'Info' when '6' then 'Info' when '7' then 'Debug' end as level from ({_JOURNAL_SQL})")
def journal_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _JOURNAL).select("pos", levels.priority_level(F.col("priority")).alias("level"))


@registered("unit_glob", f"select pos, unit from ({_JOURNAL_SQL}) where unit like 'api%.service'")
def unit_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _JOURNAL).filter(search.glob_match(F.col("unit"), "api*.service")).select("pos", "unit")


@registered("journal_route", f"select pos, coalesce(unit, 'api*.service') as unit, case when identifier <> 'systemd' then 'app' when contains(message, 'Main process exited, code=killed') then 'systemd_crash' end as route from ({_JOURNAL_SQL}) where message <> '' and (unit is null or unit like 'api%.service')")
def journal_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _from_events(spark, sf_dir, _JOURNAL).withColumn("pid", F.lit("12"))
    return journal.route(entries, "api*.service").select("pos", "unit", "route")


@registered("kmsg_message", f"select pos, regexp_extract(record, '^[^;]*;([^\\n]*)', 1) as message from ({_KERNEL_SQL})")
def kmsg_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, _KERNEL).select("pos", lines.kmsg_message(F.col("record")).alias("message"))


@registered("kernel_events", f"""select pos, case when m like 'Killed%' then 'kernel_oom' else 'kernel_segfault' end as kind, coalesce(cast(nullif(case when m like 'Killed%' then regexp_extract(m, 'process ([0-9]+)', 1) else regexp_extract(m, '\\[([0-9]+)\\]', 1) end, '') as bigint), 0) as pid,
    case when m like 'Killed%' then regexp_extract(m, '\\(([^)]*)\\)', 1) when m like 'nginx%' then 'nginx' end as comm, m as detail from (select pos, regexp_extract(record, ';([^\\n]*)', 1) as m from ({_KERNEL_SQL})) where regexp_matches(m, '^Killed process [0-9]') or m like 'nginx%' or m like 'general%'""")
def kernel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.kernel_events(_from_events(spark, sf_dir, _KERNEL)).select("pos", "kind", "pid", "comm", "detail")


@registered("alert_payload", _WITH + f""", f as (select min(line_no) as pos, arg_min(epoch_us(ts) // 1000, line_no) as t, arg_min(file, line_no) as file, arg_min(raw, line_no) as raw from parsed where level in ('Error','Fatal','Panic') group by {_SIGNATURE})
    select pos, '{{"ts_ms":' || t || ',"kind":"first_seen","rule_id":"first_seen","file":"' || file || '","threshold":{{"count":1,"window_ms":0}},"observed_count":1,"line":"' || replace(replace(raw, '\\', '\\\\'), '"', '\\"') || '"}}' as payload from f""")
def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_seen(_ruled(spark, sf_dir)).select("pos", jsonl.alert_json().alias("payload"))


@registered("parse_strict", _WITH + "select line_no, format, level, date, time from parsed")
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("info", lines.strict_json(F.col("raw"))).select("line_no", "info.format", "info.level", "info.date", "info.time")


@registered("extract_message", _WITH + f"select line_no, {_MESSAGE} as message from parsed")
def extract_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("line_no", lines.message(F.col("raw"), F.col("info.format")).alias("message"))


@registered("logfmt_field", f"select line_no, regexp_extract(raw, ' level=([^ ]*)', 1) as level, regexp_extract(raw, ' msg=\"([^\"]*)\"', 1) as msg, cast(null as varchar) as other from ({SQL_LINES}) where raw like 'time=%'")
def logfmt_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _lines(spark, sf_dir).filter(lines.line_format(F.col("raw")) == "plain_logfmt")
    return own.select("line_no", *[lines.logfmt_field(F.col("raw"), k).alias(k) for k in ("level", "msg", "other")])


@registered("bounded_lines", f"select line_no, substr(raw, 1, 40) as raw from ({SQL_LINES})")
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_no", lines.truncate_bytes(F.col("raw"), 40).alias("raw"))


@registered("search_groups", f"select line_no from ({SQL_LINES}) where regexp_matches(raw, '(?is)(click|view|signup) failed.*[^0-9]9[0-9]* ms($|[^a-z])')")
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.LogFilter(search=r"(click|view|signup) failed.*\D9\d* ms($|[^a-z])").apply(_lines(spark, sf_dir)).select("line_no")


_ROUTES = "case event_id % 4 when 0 then '/metrics' when 1 then '/metrics.json' when 2 then '/healthz' else 'other' end"


@registered("http_counters", f"select route, cast(case when code in (200, 400, 401, 404, 500) then code when code < 400 then 200 when code < 500 then 400 else 500 end as integer) as code, count(*) as count from (select {_ROUTES} as route, 200 + user_id % 310 as code from events) group by all")
def http_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.http_counters(sample.events_table(spark, sf_dir).selectExpr(f"{_ROUTES} as route", "200 + user_id % 310 as code"))


@registered("kernel_payload", f"""select pos, '{{"ts_ms":' || pos || ',"kind":"kernel_oom","source":"kmsg","pid":' || regexp_extract(m, 'process ([0-9]+)', 1) || ',"comm":"' || regexp_extract(m, '\\(([^)]*)\\)', 1) || '","detail":"' || m || '"}}' as payload
    from (select pos, regexp_extract(record, ';([^\\n]*)', 1) as m from ({_KERNEL_SQL})) where regexp_matches(m, '^Killed process [0-9]')""")
def kernel_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernel.kernel_events(_from_events(spark, sf_dir, _KERNEL)).filter("kind = 'kernel_oom'").withColumn("ts_ms", F.col("pos"))
    return found.select("pos", jsonl.kernel_json().alias("payload"))


@registered("otlp_records", _WITH + f"""select min(line_no) as pos, arg_min(epoch_us(ts) // 1000, line_no) * 1000000 as time_ns, 'info' as severity, 'alert first_seen/first_seen fired (1/1 in 0ms)' as body, arg_min(file, line_no) as path
    from parsed where level in ('Error','Fatal','Panic') group by {_SIGNATURE}""")
def otlp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = rules.first_seen(_ruled(spark, sf_dir))
    own = otlp.rule_records(fired, "pos")
    return own.select("pos", "time_ns", "severity", "body", F.filter("attributes", lambda a: a["key"] == "log.file.path")[0]["string_value"].alias("path"))


# Queries over real files: the sample is written, then read back by the sources.
def _text_files(spark: SparkSession, sf_dir: str, compression: str) -> DataFrame:
    path = sample.scratch(spark, "text")
    _lines(spark, sf_dir).select("raw").write.option("compression", compression).text(path)
    return text.scan(spark, path).select("raw")


@registered("source_text", _WITH + "select raw from parsed")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_files(spark, sf_dir, "none")


@registered("source_gzip", _WITH + "select raw from parsed")
def source_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_files(spark, sf_dir, "gzip")


@registered("source_numbered", _WITH + "select count(*) as n_lines, cast(count(distinct raw) as bigint) as n_texts from parsed")
def source_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every file run from 0 without gaps; what is counted is the (file, number) pairs within these bounds."""
    path = sample.scratch(spark, "numbered")
    _lines(spark, sf_dir).select("raw").write.text(path)
    numbered = text.scan_numbered(spark, path)
    per_file = numbered.groupBy("file").agg(F.count_distinct("line_no").alias("n"), F.max("line_no").alias("last"))
    whole = per_file.filter(F.col("last") == F.col("n") - 1).agg(F.sum("n").alias("n_lines"))
    return whole.crossJoin(numbered.agg(F.count_distinct("raw").alias("n_texts")))  # one row each


@registered("source_journal_json", f"select pos, case when message <> '' then message end as message, unit, identifier, priority from ({_JOURNAL_SQL}) where message <> ''")
def source_journal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sample.scratch(spark, "journal")
    own = _from_events(spark, sf_dir, _JOURNAL).withColumn("realtime", (F.col("pos") * 1000).cast("string"))
    named = F.struct(*[F.col(k).alias(v) for k, v in journal_json.FIELDS.items() if k in own.columns])
    own.select(F.to_json(named).alias("line")).write.text(path)
    found = journal_json.read(spark, path).filter("message <> ''")
    return found.select(F.col("t_ms").alias("pos"), "message", "unit", "identifier", "priority")


@registered("source_kmsg", f"select regexp_extract(record, '^[^;]*;([^\n]*)', 1) as message, cast(length(record) > strpos(record, chr(10)) and strpos(record, chr(10)) > 0 as boolean) as continued from ({_KERNEL_SQL})")
def source_kmsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sample.scratch(spark, "kmsg")
    _from_events(spark, sf_dir, _KERNEL).select("record").write.text(path)
    found = kmsg.read(spark, path)
    return found.select(lines.kmsg_message(F.col("record")).alias("message"), F.col("record").contains("\n").alias("continued"))


# The service's state machine over journal entries has no SQL form; tests hold it against plain expectations.
@registered("journal_crashes", None)
def journal_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _from_events(spark, sf_dir, _JOURNAL).withColumn("pid", F.lit("12")).withColumn("t_ms", F.col("pos") * 1000)
    return journal.track_units(entries, "sample", "*.service", until_ms=_UNTIL)


@registered("service_payload", None)
def service_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crash_lines(spark, sf_dir).withColumnRenamed("line_no", "pos")
    return crash.track(own, until_ms=_UNTIL).select("service", jsonl.service_json().alias("payload"))


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}
