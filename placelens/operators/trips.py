"""Trips: greedy geographic order and the scheduling of stops. Both are sequential within a trip (50 stops at most): greedy_order and schedule say how, for one trip.

Tables of trips are done without a call for each: rows come sorted by trip, in Arrow batches, and trips of about the same number of stops take each step together, as arrays (a row for each
trip, a column for each stop). A trip that reaches into the next batch waits for it.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import OPENING, TRIP_MODES

ORDER_SCHEMA = "trip_id long, poi_id long, position int, leg_metres double"
SCHEDULE_SCHEMA = "trip_id long, poi_id long, day int, stop_order int, arrival string, departure string, travel_minutes int, status string, warnings string"


def metres(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    s, t = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    h = s * s + math.cos(p) * math.cos(q) * t * t
    return math.floor(2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) / 10 + 0.5) * 10.0


def minutes(distance: float, mode: str) -> int:
    speed, overhead, least = TRIP_MODES.get(mode, TRIP_MODES["motorbike"])
    return int(max(least, math.ceil(distance / 1000 / speed * 60 + overhead)))


def _point(r):
    return None if r["lat"] is None or r["lon"] is None or math.isnan(r["lat"]) or math.isnan(r["lon"]) else (r["lat"], r["lon"])


def greedy_order(stops: list[dict], start=None) -> list[dict]:
    """Nearest next stop; equal distances and stops without a position by score, rank, id."""
    rest = sorted(stops, key=lambda r: (-r["score"], r["rank"], r["poi_id"]))
    here, out = start, []
    while rest:
        if here is None:
            i, d = 0, None
        else:
            best = [(metres(here, p), i) for i, r in enumerate(rest) if (p := _point(r))]
            d, i = min(best) if best else (None, 0)
        r = rest.pop(i)
        out.append(r | {"leg_metres": d})
        here = _point(r) or here
    return out


def schedule(stops: list[dict], start=None, days: int = 1, first: int = 540, last: int = 1080, per_day: int = 4, mode: str = "motorbike"):
    """Stops in their order over days: each takes the travel from the one before and its own minutes. Only the first days * per_day stops take part. A stop goes to the first day that
    isn't full, else to the last one. It is left out if it would end behind the day, or meets closed hours and is no must. The trip's start is the point before the first day's first
    stop; a later day has none, so its first leg is unknown. hours is a stop's opening status, ranges the opening ranges in minutes."""
    now, here, full = [first] * days, [start] + [None] * (days - 1), [0] * days
    out = []
    for k, r in enumerate(stops):
        if k >= days * per_day:
            out.append(r | {"day": None, "status": "unscheduled", "warnings": "MAX_STOPS_APPLIED"})
            continue
        d = next((i for i in range(days) if full[i] < per_day), days - 1)
        p, before = _point(r), here[d]
        travel = minutes(metres(before, p), mode) if before and p else None
        arrive = now[d] + (travel or 0)
        leave = arrive + r["stay"]
        if leave > last:
            out.append(r | {"day": None, "status": "unscheduled", "warnings": "UNSCHEDULED_MUST_INCLUDE" if r.get("must") else "DAILY_WINDOW_TIGHT"})
            continue
        hours = r.get("hours") or "unknown"
        if hours == "known":
            hours = "open" if any(arrive >= x["start"] and leave <= x["end"] for x in r["ranges"]) else "conflict"
        if hours == "conflict" and not r.get("must"):
            out.append(r | {"day": None, "status": "dropped", "warnings": "OPENING_HOURS_CONFLICT"})
            continue
        leg = "TRAVEL_TIME_ESTIMATED" if travel is not None else "ORIGIN_NOT_PROVIDED" if not full[d] and not before else "COORDINATES_MISSING"
        notes = [leg] + ([] if hours == "open" else [f"OPENING_HOURS_{hours.upper()}"])
        full[d] += 1
        out.append(r | {"day": d + 1, "stop_order": full[d], "arrival": arrive, "departure": leave, "travel": travel, "status": "scheduled", "warnings": ",".join(notes)})
        now[d], here[d] = leave, p or before
    return out


def hhmm(m: int) -> str:
    return f"{m % 1440 // 60:02d}:{m % 60:02d}"


#: hhmm of each minute of a day.
TIMES = [hhmm(m) for m in range(1440)]


def _metres(lat, lon, lat2, lon2) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lat2)
    s, t = np.sin(np.radians(lat2 - lat) / 2), np.sin(np.radians(lon2 - lon) / 2)
    h = s * s + np.cos(p) * np.cos(q) * t * t
    return np.floor(2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) / 10 + 0.5) * 10.0


def _minutes(distance: np.ndarray, mode: str) -> np.ndarray:
    speed, overhead, least = TRIP_MODES.get(mode, TRIP_MODES["motorbike"])
    return np.maximum(least, np.ceil(distance / 1000 / speed * 60 + overhead))


def _by_preference(stops: DataFrame) -> DataFrame:
    """The rows of each trip in a row, by score, rank and id, numbered from 1 (at): a window leaves them in its order."""
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("rank"), F.asc_nulls_last("poi_id")]
    return stops.withColumn("at", F.row_number().over(Window.partitionBy("trip_id").orderBy(*order)))


def _whole_trips(batches):
    """Tables of whole trips, from batches of numbered rows."""
    import pyarrow as pa

    waiting: list = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(b.schema.get_field_index("at")).to_numpy()
        before = waiting[-1].column(waiting[-1].schema.get_field_index("at"))[-1].as_py() if waiting else 0
        if not ((at == 1) | (at == np.concatenate(([before], at[:-1])) + 1)).all():
            raise ValueError("the rows of a trip must come in a row")
        firsts = np.flatnonzero(at == 1)
        if len(firsts):
            whole = pa.Table.from_batches([*waiting, b.slice(0, firsts[-1])]).combine_chunks()
            if whole.num_rows:
                yield whole
            waiting = []
            b = b.slice(firsts[-1])
        waiting.append(b)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _like_sized(at: np.ndarray):
    """(first row, number of stops) of trips whose numbers of stops are within a factor of two, as arrays."""
    first = np.flatnonzero(at == 1)
    size = np.diff(np.append(first, len(at)))
    exponent = np.frexp(size)[1]
    for e in np.unique(exponent):
        yield first[exponent == e], size[exponent == e]


def _numbers(column) -> np.ndarray:
    """As doubles; null is NaN."""
    return column.cast("float64").to_numpy(zero_copy_only=False)


def _greedy(first: np.ndarray, size: np.ndarray, lat: np.ndarray, lon: np.ndarray):
    """Each trip's rows in greedy_order, and the metres to each (NaN where unknown); behind a trip's last stop, anything."""
    most, trips = int(size.max()), np.arange(len(first))
    rows = np.minimum(first[:, None] + np.arange(most), (first + size - 1)[:, None])
    rest = np.arange(most) < size[:, None]
    y, x = lat[rows], lon[rows]
    known = ~(np.isnan(y) | np.isnan(x))
    here_y, here_x = np.full((2, len(first)), np.nan)
    order, legs = np.zeros(rows.shape, np.int64), np.full(rows.shape, np.nan)
    for k in range(most):
        d = np.where(rest & known, _metres(here_y[:, None], here_x[:, None], y, x), np.inf)
        d[np.isnan(d)] = np.inf  # no point yet
        pick = d.argmin(1)  # the first of equals
        leg = d[trips, pick]
        far = np.isinf(leg)
        pick = np.where(far, rest.argmax(1), pick)
        order[:, k], legs[:, k] = rows[trips, pick], np.where(far, np.nan, leg)
        rest[trips, pick] = False
        moved = known[trips, pick]
        here_y, here_x = np.where(moved, y[trips, pick], here_y), np.where(moved, x[trips, pick], here_x)
    return order, legs


def _order(batches):
    import pyarrow as pa

    for t in _whole_trips(batches):
        lat, lon = _numbers(t["lat"]), _numbers(t["lon"])
        taken, metre = np.zeros(t.num_rows, np.int64), np.full(t.num_rows, np.nan)
        for first, size in _like_sized(t["at"].to_numpy()):
            order, legs = _greedy(first, size, lat, lon)
            for k in range(order.shape[1]):
                some = k < size
                taken[first[some] + k], metre[first[some] + k] = order[some, k], legs[some, k]
        cols = [t["trip_id"], t["poi_id"].take(pa.array(taken)), t["at"].cast("int32"), pa.array(metre, mask=np.isnan(metre))]
        yield from pa.Table.from_arrays(cols, ["trip_id", "poi_id", "position", "leg_metres"]).combine_chunks().to_batches()


def order_trips(stops: DataFrame) -> DataFrame:
    """stops: trip_id, poi_id, score, rank, lat, lon."""
    ids = [F.col(c).cast("long").alias(c) for c in ("trip_id", "poi_id")]
    return _by_preference(stops.select(*ids, "score", "rank", "lat", "lon")).select("trip_id", "poi_id", "lat", "lon", "at").mapInArrow(_order, ORDER_SCHEMA)


LEGS = ["TRAVEL_TIME_ESTIMATED", "ORIGIN_NOT_PROVIDED", "COORDINATES_MISSING"]
LEFT_OUT = [("unscheduled", "MAX_STOPS_APPLIED"), ("unscheduled", "UNSCHEDULED_MUST_INCLUDE"), ("unscheduled", "DAILY_WINDOW_TIGHT"), ("dropped", "OPENING_HOURS_CONFLICT")]


def opening_hours(text: str | None) -> tuple[str, list[tuple[int, int]]]:
    """C.opening_status and C.opening_ranges (those that can be read) of one text: a batch holds few distinct ones, and parsing each row's took most of the time."""
    text = (text or "").strip(" ")
    if not text:
        return "unknown", []
    found = [re.search(OPENING, part.strip(" "), re.ASCII) for part in text.split("|")]
    ranges = [(a * 60 + b, c * 60 + d) for a, b, c, d in (map(int, m.groups()) for m in found if m)]
    ranges = [x for x in ranges if x[1] > x[0]]
    return "known" if len(ranges) == len(found) else "unparseable", ranges


def _schedule(start=None, days: int = 1, first: int = 540, last: int = 1080, per_day: int = 4, mode: str = "motorbike"):
    """schedule of greedy_order, for all trips of a batch."""

    def run(batches):
        import pyarrow as pa

        for t in _whole_trips(batches):
            lat, lon, n = _numbers(t["lat"]), _numbers(t["lon"]), t.num_rows
            if t["stay"].null_count:
                raise ValueError("a stop needs its minutes")
            stay, must = t["stay"].to_numpy().astype(np.int64), t["must"].fill_null(False).to_numpy()
            # Each distinct text of opening hours: its status, with open and conflict behind, by number, and its ranges as columns.
            said = t["opening_hours"].fill_null("").chunk(0).dictionary_encode()
            parsed = [opening_hours(x) for x in said.dictionary.to_pylist()]
            names = ["known", "unknown", "unparseable", "open", "conflict"]
            is_open, conflict = 3, 4
            text, status = said.indices.to_numpy().astype(np.int64), np.array([names.index(x) for x, _ in parsed])
            begin, end = (np.full((len(parsed), max([1, *(len(x) for _, x in parsed)])), v) for v in (np.inf, -np.inf))
            for i, (_, own) in enumerate(parsed):
                for j, (opens, closes) in enumerate(own):
                    begin[i, j], end[i, j] = opens, closes

            out = {c: np.full(n, -1, np.int64) for c in ("row", "day", "stop", "arrive", "leave", "travel", "state")}
            for heads, size in _like_sized(t["at"].to_numpy()):
                order, _ = _greedy(heads, size, lat, lon)
                shape = (len(heads), days)
                now, full, here_y, here_x = np.full(shape, first), np.zeros(shape, np.int64), np.full(shape, np.nan), np.full(shape, np.nan)
                if start is not None:
                    here_y[:, 0], here_x[:, 0] = start
                for k in range(order.shape[1]):
                    g = np.flatnonzero(k < size)
                    r, to = order[g, k], heads[g] + k
                    out["row"][to] = r
                    if k >= days * per_day:
                        out["state"][to] = 0
                        continue
                    space = full[g] < per_day
                    d = np.where(space.any(1), space.argmax(1), days - 1)
                    y, x = here_y[g, d], here_x[g, d]
                    far = _metres(y, x, lat[r], lon[r])
                    unknown = np.isnan(far)
                    travel = np.where(unknown, -1, _minutes(np.where(unknown, 0, far), mode)).astype(np.int64)
                    arrive = now[g, d] + np.maximum(travel, 0)
                    leave = arrive + stay[r]
                    hours = text[r]
                    fits = ((arrive[:, None] >= begin[hours]) & (leave[:, None] <= end[hours])).any(1)
                    at = np.where(status[hours] == 0, np.where(fits, is_open, conflict), status[hours])
                    late, closed = leave > last, (at == conflict) & ~must[r]
                    leg = np.where(~unknown, 0, np.where((full[g, d] == 0) & np.isnan(y), 1, 2))
                    out["state"][to] = np.where(late, np.where(must[r], 1, 2), np.where(closed, 3, 4 + leg * len(names) + at))
                    kept = ~late & ~closed
                    g, r, to, d = g[kept], r[kept], to[kept], d[kept]
                    full[g, d] += 1
                    now[g, d] = leave[kept]
                    moved = ~(np.isnan(lat[r]) | np.isnan(lon[r]))
                    here_y[g[moved], d[moved]], here_x[g[moved], d[moved]] = lat[r[moved]], lon[r[moved]]
                    for c, v in (("day", d + 1), ("stop", full[g, d]), ("arrive", arrive[kept]), ("leave", leave[kept]), ("travel", travel[kept])):
                        out[c][to] = v
            notes = [leg + ("" if x == "open" else f",OPENING_HOURS_{x.upper()}") for leg in LEGS for x in names]
            states, warnings = zip(*LEFT_OUT, *(("scheduled", x) for x in notes), strict=True)
            number = lambda c: pa.array(out[c].astype(np.int32), mask=out[c] < 0)
            clock = lambda c: pa.array(TIMES).take(pa.array(out[c] % 1440, mask=out[c] < 0))
            word = lambda words: pa.array(words).take(pa.array(out["state"]))
            cols = [t["trip_id"], t["poi_id"].take(pa.array(out["row"])), number("day"), number("stop"), clock("arrive"), clock("leave"), number("travel"), word(states), word(warnings)]
            yield from pa.Table.from_arrays(cols, ["trip_id", "poi_id", "day", "stop_order", "arrival", "departure", "travel_minutes", "status", "warnings"]).combine_chunks().to_batches()

    return run


def schedule_trips(stops: DataFrame, **options) -> DataFrame:
    """stops: trip_id, poi_id, score, rank, lat, lon, stay, and opening_hours (text) and must if there are any."""
    kinds = {"opening_hours": "string", "must": "boolean"}
    more = [F.col(c) if c in stops.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    ids = [F.col(c).cast("long").alias(c) for c in ("trip_id", "poi_id")]
    rows = _by_preference(stops.select(*ids, "score", "rank", "lat", "lon", "stay", *more))
    return rows.drop("score", "rank").mapInArrow(_schedule(**options), SCHEDULE_SCHEMA)
