"""First come, first served: requests that each claim the earliest free response within a time, without one long walk.

Responses of a kind are numbered by time. A request at time t may claim numbers low (the first at t or later) to high (the
last within the window). Requests come in order of time, so the last number claimed, u, is all that one leaves to the next:
it claims max(u + 1, low) if that is at most high, else nothing. As u is never above the high of a later request, it
becomes min(max(u + 1, low), high), so what a block of requests does to u has three pieces at most, however dense they are:
flat, of slope one, flat. Blocks give their functions side by side, functions of SUPER blocks are composed to one,
these few are walked through, and the numbers found go back down to the blocks, which then name their claims side by side.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.scratch import written

#: Rows are numbered within slots of this many microseconds; slots of a span; requests of a block; blocks whose functions are composed at once.
SLOT = 60 * 1_000_000
SPAN = 1024
BLOCK = 4096
SUPER = 256
PIECES = "array<struct<at: long, value: long, slope: int>>"
Pieces = list[tuple[int, int, int]]


def _joined(pieces: Pieces) -> Pieces:
    """pieces without those that only go on."""
    out = pieces[:1]
    for at, value, slope in pieces[1:]:
        a, v, s = out[-1]
        if slope != s or value != v + s * (at - a):
            out.append((at, value, slope))
    return out


def claimed(f: Pieces, low: int, high: int) -> Pieces:
    """f, then one request: values below low - 1 become low, others grow by one, to high at most; none is above high before."""
    if low > high:
        return f
    out = []
    for i, (at, value, slope) in enumerate(f):
        if not slope:
            out.append((at, min(max(value + 1, low), high), 0))
            continue
        last = f[i + 1][0] - 1 if i + 1 < len(f) else math.inf
        grows, stays = at + max(0, low - 1 - value), at + max(0, high - 1 - value)
        if grows > at:
            out.append((at, low, 0))
        if grows <= last and grows < stays:
            out.append((grows, value + grows - at + 1, 1))
        if stays <= last:
            out.append((stays, high, 0))
    return _joined(out)


def value_at(f: Pieces, u: int) -> int:
    """f(u); what lies before the first piece counts as its start."""
    u = max(u, f[0][0])
    at, value, slope = f[bisect_right(f, (u, math.inf)) - 1]
    return value + slope * (u - at)


def composed(f: Pieces, g: Pieces) -> Pieces:
    """First f, then g."""
    out = []
    for i, (at, value, slope) in enumerate(f):
        out.append((at, value_at(g, value), slope * _slope(g, value)))
        if slope:
            last = f[i + 1][0] - 1 if i + 1 < len(f) else math.inf
            for a, v, s in g[bisect_right(g, (value, math.inf)) :]:
                if at + a - value <= last:
                    out.append((at + a - value, v, s))
            if value < g[0][0] and g[0][0] - value + at <= last and not any(p[0] == at + g[0][0] - value for p in out):
                out.append((at + g[0][0] - value, g[0][1], g[0][2]))
    return _joined(sorted(out))


def _slope(g: Pieces, u: int) -> int:
    return 0 if u < g[0][0] else g[bisect_right(g, (u, math.inf)) - 1][2]


def sums_before(slots: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """slots (keys, slot, columns) with {c}_before, the sum of each column over the earlier slots of their keys.

    Summed within spans of SPAN slots, and over the spans before: one task of a key sees a row a span, not a row a slot.
    """
    slots = written(slots.withColumn("span", F.floor(F.col("slot") / SPAN)), "slots")
    earlier = lambda c, at, by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = slots.groupBy(*keys, "span").agg(*(F.sum(c).alias(c) for c in columns))
    spans = spans.select(*keys, "span", *(earlier(c, "span", keys).alias(f"{c}_spans") for c in columns))
    within = slots.select("*", *(earlier(c, "slot", (*keys, "span")).alias(f"{c}_within") for c in columns)).join(spans, [*keys, "span"])
    return within.select(*(c for c in slots.columns if c != "span"), *((F.col(f"{c}_within") + F.col(f"{c}_spans")).alias(f"{c}_before") for c in columns))


def _numbered(requests: DataFrame, responses: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(uuid, kind, k: its number, low, high) of requests and (message_id, kind, number) of responses, each numbered within their kind."""
    none = F.lit(None).cast("string")
    # in order at one time: requests that ask from here on, responses, requests whose window ends here
    events = (
        requests.select("kind", F.col("mtime").alias("time"), F.lit(0).alias("what"), F.col("uuid").alias("id"), "uuid", none.alias("message_id"))
        .unionByName(responses.select("kind", F.col("mtime").alias("time"), F.lit(1).alias("what"), F.col("message_id").alias("id"), none.alias("uuid"), "message_id"))
        .unionByName(requests.select("kind", (F.col("mtime") + window).alias("time"), F.lit(2).alias("what"), F.col("uuid").alias("id"), "uuid", none.alias("message_id")))
        .withColumn("slot", F.floor(F.col("time") / SLOT))
    )
    is_response, is_request = (F.when(F.col("what") == w, 1).otherwise(0) for w in (1, 0))
    upto = Window.partitionBy("kind", "slot").orderBy("time", "what", "id").rowsBetween(Window.unboundedPreceding, 0)
    slots = sums_before(events.groupBy("kind", "slot").agg(F.sum(is_response).alias("n"), F.sum(is_request).alias("m")), ("kind",), ("n", "m")).drop("n", "m")
    placed = written(events.select("*", F.sum(is_response).over(upto).alias("n"), F.sum(is_request).over(upto).alias("m")).join(slots, ["kind", "slot"]), "placed")
    n, m = F.col("n") + F.col("n_before"), F.col("m") + F.col("m_before")
    when = lambda what, x: F.max(F.when(F.col("what") == what, x))
    asked = placed.where("what <> 1").groupBy("uuid", "kind").agg(when(0, m - 1).alias("k"), when(0, n).alias("low"), when(2, n - 1).alias("high"))
    return asked, placed.where("what = 1").select("message_id", "kind", (n - 1).alias("number"))


def _function(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    f = [(int(rows["low"].iloc[0]) - 1,) * 2 + (1,)]
    for low, high in zip(rows["low"].tolist(), rows["high"].tolist(), strict=True):
        f = claimed(f, low, high)
    return pd.DataFrame({"kind": rows["kind"].iloc[:1], "block": rows["block"].iloc[:1], "f": [f]})


def _pieces(f) -> Pieces:
    return [(p["at"], p["value"], p["slope"]) if isinstance(p, dict) else tuple(p) for p in f]


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    fs = [_pieces(f) for f in rows.sort_values("block")["f"]]
    f = fs[0]
    for g in fs[1:]:
        f = composed(f, g)
    return pd.DataFrame({"kind": rows["kind"].iloc[:1], "super": rows["super"].iloc[:1], "f": [f]})


def _walked(number: str):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """What each function is given: -1 or the first row's u, then what the one before it makes."""
        rows = rows.sort_values(number)
        u, given = int(rows["u"].iloc[0]), []
        for f in rows["f"]:
            given.append(u)
            u = value_at(_pieces(f), u)
        return pd.DataFrame({"kind": rows["kind"], number: rows[number], "u": given})

    return walk


def _claims(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    u, out = int(rows["u"].iloc[0]), []
    for low, high in zip(rows["low"].tolist(), rows["high"].tolist(), strict=True):
        number = max(u + 1, low)
        out.append(number if low <= high and number <= high else -1)
        u = max(u, out[-1])
    return pd.DataFrame({"uuid": rows["uuid"], "kind": rows["kind"], "number": out})[[x >= 0 for x in out]]


def first_come(requests: DataFrame, responses: DataFrame, window: int) -> DataFrame:
    """(uuid, message_id): requests (uuid, kind, mtime) by time and uuid, each with the earliest free response (message_id, kind, mtime; by time and message_id) of its kind at its time or up to window later.

    No group holds over BLOCK requests or SUPER functions. One task of a kind sees a row for every SUPER * BLOCK of its
    requests, and one a row for every SPAN slots of time.
    """
    asked, numbers = _numbered(requests, responses, window)
    asked = written(asked.withColumn("block", F.floor(F.col("k") / BLOCK)), "asked")
    functions = written(asked.groupBy("kind", "block").applyInPandas(_function, f"kind string, block long, f {PIECES}").withColumn("super", F.floor(F.col("block") / SUPER)), "functions")
    tops = functions.groupBy("kind", "super").applyInPandas(_whole, f"kind string, super long, f {PIECES}").withColumn("u", F.lit(-1).cast("long"))
    starts = tops.groupBy("kind").applyInPandas(_walked("super"), "kind string, super long, u long")
    given = functions.join(starts, ["kind", "super"]).groupBy("kind", "super").applyInPandas(_walked("block"), "kind string, block long, u long")
    made = asked.join(given, ["kind", "block"]).groupBy("kind", "block").applyInPandas(_claims, "uuid string, kind string, number long")
    return made.join(numbers, ["kind", "number"]).select("uuid", "message_id")
