"""Online preference profiles: an event stream folded into a state for each user, and the same fold in batch.

Events are put in order (time, source, id) within what arrives together; an event key that the state has seen is skipped, which makes
redelivery harmless for KEEP_SECONDS; an event redelivered later than that counts again (a difference made for a bounded state). Weights follow an exponential mean: old (1 - alpha) + delta alpha, weights of 0.001 or less go, the largest stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

OUTPUT = "user_id long, kind string, key string, weight double"
MAX_KEYS, MAX_CONTEXTS = 24, 16
#: How long, in event time behind a user's newest event, a key is known as seen: the state holds the keys of 30 days.
KEEP_SECONDS = 30 * 86_400.0


def alpha(dwell: Column, rating: Column) -> Column:
    d = F.when(F.coalesce(dwell, F.lit(0.0)) != 0, clamp(dwell / 90.0, 0.4, 1.8)).otherwise(1.0)
    r = F.when(F.coalesce(rating, F.lit(0.0)) != 0, clamp(rating / 4.0, 0.75, 1.35)).otherwise(1.0)
    return clamp(d * r * 0.18, 0.08, 0.34)


def weight(source: Column, dwell: Column, rating: Column) -> Column:
    quality = F.when(source == "review", clamp(F.coalesce(F.nullif(rating, F.lit(0.0)), F.lit(3.0)) / 5.0, 0.2, 1.2)).otherwise(1.0)
    return quality * F.when(F.coalesce(dwell, F.lit(0.0)) != 0, clamp(dwell / 45.0, 0.5, 3.0)).otherwise(1.0)


def learning_columns(events: DataFrame) -> DataFrame:
    """events: user_id, ts, source, event_id, category, purpose, mood, context, transport, dwell, rating. Rows without a user go."""
    return events.where("user_id is not null").withColumn("alpha", alpha(F.col("dwell"), F.col("rating"))).withColumn("weight", weight(F.col("source"), F.col("dwell"), F.col("rating")))


def empty_state() -> dict:
    return {"seen": {}, "category": {}, "purpose": {}, "mood": {}, "transport": {}, "context": {}, "purpose_by_category": {}, "dwell": {"target": 45, "n": 0}, "count": {}}


def blend(old: dict, delta: dict, a: float, most: int = MAX_KEYS) -> dict:
    new = {k: v * (1 - a) for k, v in old.items()}
    for k, v in delta.items():
        new[k] = new.get(k, 0.0) + v * a
    return dict(sorted(((k, v) for k, v in new.items() if v > 0.001), key=lambda x: -x[1])[:most])


def present(v) -> bool:
    return v is not None and v != "" and not (isinstance(v, float) and math.isnan(v))


def forget(seen: dict, keep: float = KEEP_SECONDS) -> None:
    """Drops the keys of events older than keep, behind the newest; keys without a time stay."""
    newest = max((t for t in seen.values() if t is not None), default=0.0)
    for key in [k for k, t in seen.items() if t is not None and t < newest - keep]:
        del seen[key]


def learn(state: dict, e: dict) -> None:
    key = f"{e['source']}_{e['event_id']}"
    if key in state["seen"]:
        return
    state["seen"][key] = e["ts"].timestamp() if present(e["ts"]) and e["ts"] == e["ts"] else None
    a, w = e["alpha"], e["weight"]
    own = {n: ({e[n]: w} if present(e[n]) else {}) for n in ("category", "purpose", "mood")}
    for n, delta in own.items():
        state[n] = blend(state[n], delta, a)
    state["transport"] = blend(state["transport"], {e["transport"]: 1.0} if present(e["transport"]) else {}, a, 8)
    at = state["context"].setdefault(e["context"], {})
    for n, delta in own.items():
        at[n] = blend(at.get(n, {}), delta, a)
    while len(state["context"]) > MAX_CONTEXTS:
        del state["context"][next(iter(state["context"]))]
    if present(e["purpose"]):
        state["purpose_by_category"][e["category"]] = blend(state["purpose_by_category"].get(e["category"], {}), {e["purpose"]: 1.0}, a, 8)
    if present(e["dwell"]) and e["dwell"] > 0:
        d = state["dwell"]
        state["dwell"] = {"target": math.floor(d["target"] * (1 - a) + e["dwell"] * a + 0.5), "n": d["n"] + 1}
    state["count"][e["source"]] = state["count"].get(e["source"], 0) + 1


def rows_of(user, s: dict):
    for kind in ("category", "purpose", "mood", "transport"):
        for k, v in s[kind].items():
            yield user, kind, k, v
    for c, parts in s["context"].items():
        for kind, m in parts.items():
            for k, v in m.items():
                yield user, f"context:{kind}", f"{c}:{k}", v
    for c, m in s["purpose_by_category"].items():
        for k, v in m.items():
            yield user, "purpose_by_category", f"{c}:{k}", v
    yield user, "dwell", "target", float(s["dwell"]["target"])
    for k, v in s["count"].items():
        yield user, "count", k, float(v)


def fold(user, state: dict, frames):
    import pandas as pd

    for e in pd.concat(frames).sort_values(["ts", "source", "event_id"], kind="stable").to_dict("records"):
        learn(state, e)
    forget(state["seen"])
    return pd.DataFrame(list(rows_of(user, state)), columns=["user_id", "kind", "key", "weight"])


def batch_profiles(events: DataFrame) -> DataFrame:
    return learning_columns(events).groupBy("user_id").applyInPandas(lambda key, pdf: fold(int(key[0]), empty_state(), [pdf]), OUTPUT)


def stream_profiles(events: DataFrame) -> DataFrame:
    """In update mode: the whole profile of each user that had events."""
    def step(key, frames, state):
        s = json.loads(state.get[0]) if state.exists else empty_state()
        out = fold(int(key[0]), s, list(frames))
        state.update((json.dumps(s),))
        yield out

    return learning_columns(events).groupBy("user_id").applyInPandasWithState(step, OUTPUT, "state string", "update", "NoTimeout")


def place_counters(events: DataFrame) -> DataFrame:
    """Running counts for each place, in batch or as a stream in update mode."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return events.groupBy("poi_id").agg(n("poi_visit").alias("times_visited"), n("add_to_itinerary").alias("times_added"), n("route_segment").alias("times_routed"), n("review").alias("review_count"), F.coalesce(F.sum("rating"), F.lit(0.0)).alias("rating_sum"))
