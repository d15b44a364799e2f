"""Validation of request tables: every rule is a column, all rules of a row are checked in one pass without a shuffle.

A request's values come as text, as a form or a JSON body holds them; null and empty mean not given. An error is a text `field:rule`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules of a trip request: fixed values.
MODES = ("walk", "motorbike", "car", "taxi")
PACES = {"relaxed": 3, "balanced": 4, "packed": 6}
BUDGETS = ("budget", "moderate", "premium", "unknown")
MAX_WINDOWS, MIN_SPAN, MAX_SPAN = 7, 15, 960

#: Order in which warnings are shown: fixed values.
WARNINGS = (
    "OPENING_HOURS_CONFLICT", "UNSCHEDULED_MUST_INCLUDE", "COORDINATES_MISSING", "OPENING_HOURS_UNPARSEABLE", "DAILY_WINDOW_TIGHT", "INSUFFICIENT_CANDIDATES", "PARTIAL_PREVIEW",
    "OPENING_HOURS_UNKNOWN", "DURATION_ESTIMATED", "TRAVEL_TIME_ESTIMATED", "ORIGIN_NOT_PROVIDED", "MAX_STOPS_APPLIED", "BUDGET_DATA_UNKNOWN",
)

NO_ERRORS = "array<string>"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def number(c: Column) -> Column:
    """The whole text as a number; null if it is none."""
    return F.when(c.rlike("^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"), F.trim(c).try_cast("double"))


def error(field: str | Column, rule: str, bad: Column) -> Column:
    return F.when(bad, F.concat(F.lit(field) if isinstance(field, str) else field, F.lit(":" + rule)))


def integer_error(c: Column, field: str | Column, low: int, high: int, required: bool = False) -> Column:
    n = number(c)
    ok = F.coalesce((n == F.floor(n)) & n.between(low, high), F.lit(False))
    return F.coalesce(error(field, "required", blank(c) & F.lit(required)), error(field, f"integer_between_{low}_and_{high}", ~blank(c) & ~ok))


def integer(c: Column, low: int, high: int) -> Column:
    """The value if it is valid."""
    n = number(c)
    return F.when((n == F.floor(n)) & n.between(low, high), n.cast("int"))


def time_minutes(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.substring(t, 1, 2).try_cast("int") * 60 + F.substring(t, 4, 2).try_cast("int"))


def date_error(c: Column, field: str) -> Column:
    t = F.trim(c)
    return error(field, "date_YYYY_MM_DD", ~blank(c) & ~(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).isNotNull()))


def time_error(c: Column, field: str | Column) -> Column:
    return error(field, "time_HH_mm", ~blank(c) & time_minutes(c).isNull())


def enum_error(c: Column, field: str, values, default: str) -> Column:
    given = F.trim(F.when(blank(c), F.lit(default)).otherwise(c))
    return error(field, "enum_" + "_".join(values), ~given.isin(*values))


def window_errors(w: Column, field: str | Column) -> Column:
    """Errors of a struct with start and end."""
    base = F.lit(field) if isinstance(field, str) else field
    start, end = time_minutes(w["start"]), time_minutes(w["end"])
    formats = F.array_compact(F.array(time_error(w["start"], F.concat(base, F.lit(".start"))), time_error(w["end"], F.concat(base, F.lit(".end")))))
    span = end - start
    whole = F.coalesce(
        error(base, "start_end_required", blank(w["start"]) | blank(w["end"])),
        error(base, "same_day_end_after_start", span <= 0),
        error(base, f"span_minutes_between_{MIN_SPAN}_and_{MAX_SPAN}", (span < MIN_SPAN) | (span > MAX_SPAN)),
    )
    return F.when(w.isNull(), F.array().cast(NO_ERRORS)).when(F.size(formats) > 0, formats).otherwise(F.array_compact(F.array(whole)))


def day_window_errors(windows: Column, day_count: Column, field: str = "trip.dayWindows") -> Column:
    """Errors of windows by day, in order; a day that stands in an earlier window is no window of its own."""
    days = F.transform(windows, lambda w: integer(w["day_number"], 1, MAX_WINDOWS))

    def one(w: Column, i: Column) -> Column:
        at = F.concat(F.lit(field + "["), i.cast("string"), F.lit("]"))
        wrong = integer_error(w["day_number"], F.concat(at, F.lit(".dayNumber")), 1, MAX_WINDOWS, required=True)
        again = F.array_contains(F.slice(days, F.lit(1), i), integer(w["day_number"], 1, MAX_WINDOWS))
        return F.when(wrong.isNotNull(), F.array(wrong)).when(again, F.array(F.lit(field + ":unique_dayNumber"))).otherwise(window_errors(w, at))

    each = F.transform(windows, one)
    late = F.exists(F.arrays_zip(windows.alias("w"), each.alias("e")), lambda x: (F.size(x["e"]) == 0) & (integer(x["w"]["day_number"], 1, MAX_WINDOWS) > integer(day_count, 1, 7)))
    found = F.concat(F.flatten(each), F.array_compact(F.array(error(field, "dayNumber_within_dayCount", late))))
    return F.when(windows.isNull(), F.array().cast(NO_ERRORS)).when(F.size(windows) > MAX_WINDOWS, F.array(F.lit(f"{field}:maximum_{MAX_WINDOWS}"))).otherwise(found)


def location_error(lat: Column, lon: Column, field: str) -> Column:
    """No location if neither is given."""
    outside = lambda c, most: ~F.coalesce(number(c).between(-most, most), F.lit(False))
    return F.when(lat.isNull() & lon.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(
            error(field, "lat_lon_required", lat.isNull() | lon.isNull()),
            error(field + ".lat", "number_between_-90_and_90", outside(lat, 90)), error(field + ".lon", "number_between_-180_and_180", outside(lon, 180)),
        )
    )


def list_error(c: Column, field: str, most: int) -> Column:
    empty = F.exists(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    return F.coalesce(error(field, f"maximum_{most}", F.size(c) > most), error(field, "non_empty_string_items", empty))


def trip_errors(r) -> Column:
    """All errors of a trip request, in a fixed order. r gives a column by name."""
    query = F.trim(F.coalesce(r("query"), F.lit("")))
    single = lambda *c: F.array_compact(F.array(*c))
    distance = number(r("max_distance_km"))
    return F.concat(
        single(
            error("cityId", "required", F.trim(F.coalesce(r("city_id"), F.lit(""))) == ""), error("query", "string_length_1_to_500", ~F.length(query).between(1, 500)), date_error(r("date"), "trip.date"),
            time_error(r("start_time"), "trip.startTime"), integer_error(r("duration"), "trip.durationMinutes", 15, 480), integer_error(r("day_count"), "trip.dayCount", 1, 7),
            enum_error(r("transport"), "trip.transport", MODES, "motorbike"), enum_error(r("pace"), "trip.pace", tuple(PACES), "balanced"), enum_error(r("budget"), "trip.budget", BUDGETS, "unknown"),
        ),
        window_errors(r("daily_window"), "trip.dailyWindow"),
        day_window_errors(r("day_windows"), r("day_count")),
        single(
            location_error(r("lat"), r("lon"), "startLocation"), integer_error(r("max_stops"), "constraints.maxStopsPerDay", 1, 6),
            error("constraints.maxDistanceKm", "positive_number", ~blank(r("max_distance_km")) & ~F.coalesce(distance > 0, F.lit(False))),
            list_error(r("must_include"), "constraints.mustIncludePoiIds", 20), list_error(r("exclude"), "constraints.excludePoiIds", 100),
            integer_error(r("limit"), "recommendationOptions.limit", 1, 30),
        ),
    )


def recommendation_error(r) -> Column:
    """The first error of a recommendation request, or null."""
    return F.coalesce(
        error("cityId", "required", F.trim(F.coalesce(r("city_id"), F.lit(""))) == ""), error("query", "non_empty_string", F.trim(F.coalesce(r("query"), F.lit(""))) == ""),
        location_error(r("lat"), r("lon"), "context.location"), integer_error(r("limit"), "limit", 1, 20),
    )


def day_windows(r, day: Column) -> Column:
    """start, end and span in minutes of a day: its own window, the daily one, or from the start time; a shorter duration cuts it. For valid requests."""
    own = F.try_element_at(F.filter(F.coalesce(r("day_windows"), F.array().cast("array<struct<day_number:string,start:string,end:string>>")), lambda w: integer(w["day_number"], 1, MAX_WINDOWS) == day), F.lit(1))
    start = F.coalesce(time_minutes(own["start"]), time_minutes(r("daily_window")["start"]))
    end = F.coalesce(time_minutes(own["end"]), time_minutes(r("daily_window")["end"]))
    most = integer(r("duration"), 15, 480)
    span = F.when(start.isNotNull(), F.least(end - start, most)).otherwise(F.coalesce(most, F.lit(480)))
    begin = F.coalesce(start, time_minutes(r("start_time")))
    return F.struct(begin.alias("start"), (begin + span).alias("end"), span.alias("span"))


def preview_status(n_stops: Column, n_unscheduled: Column, n_warnings: Column) -> Column:
    return F.when(n_stops == 0, "INFEASIBLE").when(n_unscheduled > 0, "PARTIAL").when(n_warnings > 0, "FEASIBLE_WITH_WARNINGS").otherwise("FEASIBLE")


def warning_rank(code: Column) -> Column:
    """Place in WARNINGS; behind all for other codes."""
    at = F.array_position(F.array(*[F.lit(w) for w in WARNINGS]), code)
    return F.when(at == 0, len(WARNINGS)).otherwise(at - 1)


def sorted_warnings(warnings: Column) -> Column:
    """Distinct warnings (structs with code, day, stop, leg, poi, scope) in the order of their codes, then of place; a missing place is last."""
    far = lambda c: F.coalesce(c, F.lit(999999))
    text = lambda c: F.coalesce(c, F.lit(""))
    keyed = F.transform(warnings, lambda w: F.struct(warning_rank(w["code"]).alias("k"), far(w["day"]).alias("d"), far(w["stop"]).alias("s"), far(w["leg"]).alias("l"), text(w["poi"]).alias("p"), text(w["scope"]).alias("o"), w["code"].alias("code")))
    return F.array_distinct(F.array_sort(keyed))
