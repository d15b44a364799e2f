"""Request tables: validation, day windows, status and warnings. The requests are a view over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import requests as V
from ..sources.tables import table

#: The values that a request's field takes, by event_id // step % their number.
FIELDS = {
    "city_id": (3, ["da-nang", "da-nang", "  ", "da-nang", None]), "query": (5, ["cafe", "", "hai san", "x" * 501, "bia", None, "food"]), "date": (7, ["2026-02-28", "2026-02-30", None, "2026-2-3", "", "2024-02-29", "tomorrow"]),
    "start_time": (11, ["09:00", "24:00", None, "9:00", " 08:30 ", ""]), "duration": (2, ["120", "14", None, "abc", "120.5", "", "480", "1e2"]), "day_count": (13, ["2", "0", None, "3", "8", "7"]),
    "transport": (17, ["walk", "plane", None, "taxi", ""]), "pace": (19, ["packed", None, "fast", "relaxed"]), "budget": (23, ["budget", "free", None, "premium"]),
    "w_start": (29, ["09:00", "18:00", None, "8h", "10:00", "00:00"]), "w_end": (31, ["17:00", "09:05", None, "25:00", "23:59"]),
    "d1": (37, ["1", "2", None, "9", "1"]), "d2": (41, ["1", "2", "3", "1.5"]), "lat": (43, ["16.05", "91", None, "x", "-90"]), "lon": (47, ["108.2", None, "181", "108.3"]),
    "max_stops": (53, ["4", "7", None]), "max_distance_km": (59, ["5", "-1", None, "0", "far"]), "limit": (61, ["12", "31", None, "0", "20"]),
}


def requests(spark, sf) -> DataFrame:
    i = F.col("event_id")
    value = lambda n: F.try_element_at(F.array(*[F.lit(v) for v in FIELDS[n][1]]), (F.floor(i / FIELDS[n][0]) % len(FIELDS[n][1]) + 1).cast("int"))
    d = table(spark, sf, "events").select("event_id", *[value(n).alias(n) for n in FIELDS])
    window = F.when(i % 3 > 0, F.struct(F.col("w_start").alias("start"), F.col("w_end").alias("end")))
    day = lambda n, a, b: F.struct(F.col(n).alias("day_number"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    ids = F.when(i % 4 == 0, F.array(F.lit("a"), F.lit(" "))).when(i % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(i % 4 == 2, F.array_repeat(F.lit("a"), 21))
    return d.select("*", window.alias("daily_window"), F.when(i % 5 > 1, F.array(day("d1", "08:00", "20:00"), day("d2", "10:00", "10:10"))).alias("day_windows"), ids.alias("must_include"), F.when(i % 6 == 0, F.array_repeat(F.lit("z"), 101)).alias("exclude"))


def _sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


REQUESTS_SQL = (
    "raw as (select event_id, "
    + ", ".join(f'{_sql_list(v)}[(event_id // {step} % {len(v)} + 1)::int] as "{n}"' for n, (step, v) in FIELDS.items())
    + """ from events),
req as (select *, event_id % 3 > 0 as has_window, event_id % 5 > 1 as has_days,
  case event_id % 4 when 0 then ['a', ' '] when 1 then ['a', 'b'] when 2 then list_transform(range(21), lambda x: 'a') end as must_include, event_id % 6 = 0 as many_excluded from raw)"""
)


def _given(c: str) -> str:
    return f"coalesce({c}, '') <> ''"


def _number(c: str) -> str:
    return f"try_cast({c} as double)"


def _whole(c: str, field: str, low: int, high: int, required: bool = False) -> str:
    need = f"when not ({_given(c)}) then '{field}:required' " if required else ""
    return f"case {need}when {_given(c)} and not coalesce({_number(c)} = floor({_number(c)}) and {_number(c)} between {low} and {high}, false) then '{field}:integer_between_{low}_and_{high}' end"


def _minutes(c: str) -> str:
    return f"(case when regexp_full_match(trim({c}), '([01][0-9]|2[0-3]):[0-5][0-9]') then trim({c})[1:2]::int * 60 + trim({c})[4:5]::int end)"


def _enum(c: str, field: str, values, default: str) -> str:
    return f"case when trim(case when {_given(c)} then {c} else '{default}' end) not in ({', '.join(repr(v) for v in values)}) then '{field}:enum_{'_'.join(values)}' end"


def _place(field: str) -> str:
    return f"""case when lat is null and lon is null then null when lat is null or lon is null then '{field}:lat_lon_required'
 when not coalesce({_number('lat')} between -90 and 90, false) then '{field}.lat:number_between_-90_and_90' when not coalesce({_number('lon')} between -180 and 180, false) then '{field}.lon:number_between_-180_and_180' end"""


_T = lambda c, f: f"case when {_given(c)} and {_minutes(c)} is null then '{f}:time_HH_mm' end"
_day = lambda c: f"(case when {_number(c)} = floor({_number(c)}) and {_number(c)} between 1 and 7 then {_number(c)}::int end)"


def trip_request_errors(spark, sf):
    d = requests(spark, sf).withColumn("errors", V.trip_errors(F.col))
    return d.select("event_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", ";").alias("errors"))


# The two windows of a request are of 12 hours and of 10 minutes, so the second is always too short.
ERRORS_SQL = f"""with {REQUESTS_SQL},
checked as (select event_id, has_window, has_days, list_filter([
  case when trim(coalesce(city_id, '')) = '' then 'cityId:required' end, case when length(trim(coalesce(query, ''))) not between 1 and 500 then 'query:string_length_1_to_500' end,
  case when {_given('date')} and not (regexp_full_match(trim(date), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(date as date) is not null) then 'trip.date:date_YYYY_MM_DD' end,
  {_T('start_time', 'trip.startTime')}, {_whole('duration', 'trip.durationMinutes', 15, 480)}, {_whole('day_count', 'trip.dayCount', 1, 7)}, {_enum('transport', 'trip.transport', V.MODES, 'motorbike')},
  {_enum('pace', 'trip.pace', tuple(V.PACES), 'balanced')}, {_enum('budget', 'trip.budget', V.BUDGETS, 'unknown')}], lambda x: x is not null) as e1,
  list_filter([{_T('w_start', 'trip.dailyWindow.start')}, {_T('w_end', 'trip.dailyWindow.end')}], lambda x: x is not null) as e2,
  case when not ({_given('w_start')}) or not ({_given('w_end')}) then 'trip.dailyWindow:start_end_required' when {_minutes('w_end')} <= {_minutes('w_start')} then 'trip.dailyWindow:same_day_end_after_start'
    when {_minutes('w_end')} - {_minutes('w_start')} not between 15 and 960 then 'trip.dailyWindow:span_minutes_between_15_and_960' end as e3,
  {_whole('d1', 'trip.dayWindows[0].dayNumber', 1, 7, True)} as e4,
  coalesce({_whole('d2', 'trip.dayWindows[1].dayNumber', 1, 7, True)}, case when {_day('d1')} = {_day('d2')} then 'trip.dayWindows:unique_dayNumber' else 'trip.dayWindows[1]:span_minutes_between_15_and_960' end) as e5,
  case when {_day('d1')} > {_day('day_count')} then 'trip.dayWindows:dayNumber_within_dayCount' end as e6,
  list_filter([{_place('startLocation')}, {_whole('max_stops', 'constraints.maxStopsPerDay', 1, 6)},
  case when {_given('max_distance_km')} and not coalesce({_number('max_distance_km')} > 0, false) then 'constraints.maxDistanceKm:positive_number' end,
  case when len(must_include) > 20 then 'constraints.mustIncludePoiIds:maximum_20' when len(list_filter(must_include, lambda x: trim(x) = '')) > 0 then 'constraints.mustIncludePoiIds:non_empty_string_items' end,
  case when many_excluded then 'constraints.excludePoiIds:maximum_100' end, {_whole('"limit"', 'recommendationOptions.limit', 1, 30)}], lambda x: x is not null) as e7 from req),
joined as (select event_id, list_concat(e1, case when not has_window then [] when len(e2) > 0 then e2 when e3 is not null then [e3] else [] end, case when has_days then list_filter([e4, e5, e6], lambda x: x is not null) else [] end, e7) as e from checked)
select event_id, len(e) as n_errors, array_to_string(e, ';') as errors from joined"""


def recommendation_request_error(spark, sf):
    return requests(spark, sf).select("event_id", F.coalesce(V.recommendation_error(F.col), F.lit("")).alias("error"))


FIRST_SQL = f"""with {REQUESTS_SQL} select event_id, coalesce(case when trim(coalesce(city_id, '')) = '' then 'cityId:required' end, case when trim(coalesce(query, '')) = '' then 'query:non_empty_string' end,
  {_place('context.location')}, {_whole('"limit"', 'limit', 1, 20)}, '') as error from req"""


def trip_day_windows(spark, sf):
    """The windows of all days of requests whose windows are valid."""
    d = requests(spark, sf).withColumn("day_windows", F.when(F.col("event_id") % 5 > 1, F.slice("day_windows", 1, 1))).where(F.size(V.window_errors(F.col("daily_window"), "w")) == 0)
    d = d.where((F.size(V.day_window_errors(F.col("day_windows"), F.lit("7"))) == 0) & V.time_error(F.col("start_time"), "t").isNull())
    days = d.select("*", F.explode(F.sequence(F.lit(1), F.coalesce(V.integer(F.col("day_count"), 1, 7), F.lit(1)))).alias("day"))
    return days.select("event_id", "day", V.day_windows(F.col, F.col("day")).alias("w")).select("event_id", "day", "w.start", "w.end", "w.span")


DAYS_SQL = f"""with {REQUESTS_SQL},
m as (select *, case when has_window then {_minutes('w_start')} end as ws, case when has_window then {_minutes('w_end')} end as we, {_minutes('start_time')} as st, {_day('d1')} as own,
  case when {_number('duration')} = floor({_number('duration')}) and {_number('duration')} between 15 and 480 then {_number('duration')}::int end as most, coalesce({_day('day_count')}, 1) as n from req),
ok as (select * from m where (not has_window or coalesce(we - ws between 15 and 960, false)) and (not has_days or own is not null) and (not ({_given('start_time')}) or st is not null)),
d as (select *, unnest(range(1, n + 1))::int as day from ok),
e as (select event_id, day, st, most, case when has_days and own = day then 480 else ws end as s, case when has_days and own = day then 1200 else we end as e from d),
f as (select event_id, day, coalesce(s, st) as start, case when s is not null then least(e - s, coalesce(most, e - s)) else coalesce(most, 480) end as span from e)
select event_id, day, start, start + span as "end", span from f"""


def preview_warnings(spark, sf):
    """The warnings of each user's events, each once and in order."""
    i = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(w) for w in V.WARNINGS], F.lit("OTHER")), (i % (len(V.WARNINGS) + 1) + 1).cast("int"))
    w = F.struct(code.alias("code"), F.when(i % 3 > 0, (i % 3).cast("int")).alias("day"), F.when(i % 4 > 0, (i % 4).cast("int")).alias("stop"), F.lit(None).cast("int").alias("leg"), F.lit(None).cast("string").alias("poi"), F.lit("stop").alias("scope"))
    # Distinct before they are gathered, so a user's list is bounded by the kinds of warnings.
    g = table(spark, sf, "events").select("user_id", w.alias("w")).distinct().groupBy("user_id").agg(F.collect_list("w").alias("w"))
    s = g.select("user_id", V.sorted_warnings(F.col("w")).alias("w"))
    return s.select("user_id", F.size("w").cast("long").alias("n"), F.array_join(F.transform("w", lambda x: F.concat_ws("/", x["code"], x["d"].cast("string"), x["s"].cast("string"))), ",").alias("warnings"))


PREVIEW_WARNINGS_SQL = f"""with w as (select distinct user_id, (event_id % {len(V.WARNINGS) + 1})::int as k, case when event_id % 3 > 0 then event_id % 3 else 999999 end as d, case when event_id % 4 > 0 then event_id % 4 else 999999 end as s from events)
select user_id, count(*) as n, string_agg({_sql_list((*V.WARNINGS, 'OTHER'))}[k + 1] || '/' || d || '/' || s, ',' order by k, d, s) as warnings from w group by user_id"""


def preview_status(spark, sf):
    """Orders as previews: lines as stops, returned ones as unscheduled, open ones as warned of."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("stops"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).alias("left_out"), F.count_if(F.col("l_linestatus") == "O").alias("warned"))
    s = g.withColumn("status", V.preview_status(F.col("stops"), F.col("left_out"), F.col("warned")))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STATUS_SQL = """with g as (select l_orderkey, count(*) filter (where l_returnflag <> 'R') as stops, count(*) filter (where l_returnflag = 'R' and l_quantity > 25) as left_out, count(*) filter (where l_linestatus = 'O') as warned from lineitem group by 1)
select case when stops = 0 then 'INFEASIBLE' when left_out > 0 then 'PARTIAL' when warned > 0 then 'FEASIBLE_WITH_WARNINGS' else 'FEASIBLE' end as status, count(*) as n from g group by 1"""

QUERIES = {f.__name__: f for f in (trip_request_errors, recommendation_request_error, trip_day_windows, preview_warnings, preview_status)}
ORACLE_SQL = {"trip_request_errors": ERRORS_SQL, "recommendation_request_error": FIRST_SQL, "trip_day_windows": DAYS_SQL, "preview_warnings": PREVIEW_WARNINGS_SQL, "preview_status": STATUS_SQL}
