"""Requests and the responses they were answered with: by the ids that later requests name, else by time.

All of it runs on metadata; bodies never enter. Requests have session_id, chain, num_messages, mtime, uuid, model and
prev_id, responses message_id, mtime and model.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import claims
from tracewell.sources.scratch import written

#: A request without a later one is answered within this many microseconds.
WINDOW = 10 * 60 * 1_000_000


def named(requests: DataFrame) -> DataFrame:
    """requests with place (from 1) in their chain, root_mtime and root_uuid of its first, and named: the prev_id of the next."""
    chain = Window.partitionBy("session_id", "chain").orderBy("num_messages", "mtime", "uuid")
    root = lambda c: F.first(c).over(chain).alias(f"root_{c}")
    return requests.select("*", F.lead("prev_id").over(chain).alias("named"), F.row_number().over(chain).alias("place"), root("mtime"), root("uuid"))


def adjacent(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with message_id and the other columns of responses: the response that the next request of the chain names.

    Within session and chain, ordered by messages, time and uuid, request i gets the response whose message_id is request
    i + 1's prev_id, whatever its model. A response goes to one request: by session, then chain root, then position.
    Unpaired requests have an empty message_id. The windows run over metadata of one chain, never over bodies.
    """
    return requests.join(_won(requests, responses).withColumnRenamed("named", "message_id").join(responses, "message_id"), "uuid", "left").withColumn("message_id", F.coalesce("message_id", F.lit("")))


def _won(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(named, uuid): the request that each named response goes to."""
    claims = named(requests).where("named <> ''").join(responses.select(F.col("message_id").alias("named")), "named")
    return claims.groupBy("named").agg(F.min_by("uuid", F.struct("session_id", "root_mtime", "root_uuid", "place")).alias("uuid"))


def unclaimed(paired: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that no request has."""
    return responses.join(paired.where("message_id <> ''").select("message_id"), "message_id", "left_anti")


def _tips_claimed(rows: pd.DataFrame) -> pd.DataFrame:
    """(session_id, chain, owner, tip_uuid, message_id): the chain whose tip answers a continuation's root, for each continuation of a session.

    rows are the session's continuations of free responses (message_id is what the root names) and its tips without an answer
    (message_id is null). Continuations claim in order of their roots, each the latest tip in reach that is left; one
    that names a response already claimed joins its claimant's owner. Tips stand in order of time per model; what is claimed
    is skipped by links to the one before, so a claim does not look at all of them.
    """
    rows = rows.sort_values(["root_mtime", "root_uuid"])
    asked, tips = rows[rows["message_id"].notna()], rows[rows["message_id"].isna()].reset_index(drop=True)
    # of tips of one time the first chain's counts, so it stands last
    order = sorted(range(len(tips)), key=lambda j: (tips["mtime"][j], -j))
    roots, uuids, chains = list(zip(tips["root_mtime"], tips["root_uuid"], strict=True)), tips["tip_uuid"].tolist(), tips["chain"].tolist()
    lists: dict[str | None, list[int]] = {None: order}
    for j in order:
        lists.setdefault(tips["model"][j], []).append(j)
    times = {m: [tips["mtime"][j] for j in at] for m, at in lists.items()}
    before = {m: list(range(len(at) + 1)) for m, at in lists.items()}
    taken, claimed, out = [False] * len(tips), {}, []

    def left(model: str | None, k: int) -> int:
        """The last place of a list, up to k, that nobody has; place k is the list's k-th from 1, 0 is none."""
        skip, at = before[model], lists[model]
        path = []
        while k and (skip[k] != k or taken[at[k - 1]]):
            path.append(k)
            k = skip[k] if skip[k] != k else k - 1
        for p in path:
            skip[p] = k
        return k

    for session, chain, root, free_mtime, free_model, message in zip(asked["session_id"], asked["chain"], zip(asked["root_mtime"], asked["root_uuid"], strict=True), asked["mtime"], asked["model"], asked["message_id"], strict=True):
        if message not in claimed:
            best = None
            for model in (free_model, "") if free_model else (None,):
                k = left(model, bisect_right(times[model], free_mtime)) if model in lists else 0
                while k and roots[lists[model][k - 1]] >= root:
                    k = left(model, k - 1)
                if k:
                    j = lists[model][k - 1]
                    best = j if best is None else max(best, j, key=lambda x: (tips["mtime"][x], -x))
            if best is None:
                continue
            taken[best], claimed[message] = True, best
        out.append((session, chain, chains[claimed[message]], uuids[claimed[message]], message))
    return pd.DataFrame(out, columns=["session_id", "chain", "owner", "tip_uuid", "message_id"]).astype(object)


def roots(edges: DataFrame) -> DataFrame:
    """(session_id, chain, root) of edges (session_id, chain, root, done): a chain leads to another, or, done, to its thread's first.

    Pointers double: a chain takes over where the chain that it leads to leads, so the rounds are the logarithm of the longest
    thread. Only edges to earlier chains may be open, so that none leads round.
    """
    edges = written(edges, "roots")
    while edges.where("not done").take(1):
        ahead = edges.select("session_id", F.col("chain").alias("root"), F.col("root").alias("next"), F.col("done").alias("next_done"))
        moved = edges.where("not done").join(ahead, ["session_id", "root"], "left")
        moved = moved.select("session_id", "chain", F.coalesce("next", "root").alias("root"), F.coalesce("next_done", F.lit(True)).alias("done"))
        edges = written(edges.where("done").unionByName(moved), "roots")
    return edges.select("session_id", "chain", "root")


def _claim(rows: pd.DataFrame) -> pd.DataFrame:
    """Requests of a stretch of time, in order, each with the first response of its model that is free and within WINDOW."""
    asked = rows[rows["message_id"].isna()].sort_values(["mtime", "uuid"])
    free = rows[rows["uuid"].isna()].sort_values(["mtime", "message_id"])[["mtime", "model", "message_id"]].values.tolist()
    out, first, taken = [], 0, set()
    for at, model, uuid in asked[["mtime", "model", "uuid"]].values.tolist():
        while first < len(free) and (free[first][0] < at or first in taken):
            first += 1
        for k in range(first, len(free)):
            if free[k][0] > at + WINDOW:
                break
            if k not in taken and (not model or not free[k][1] or model == free[k][1]):
                taken.add(k)
                out.append((uuid, free[k][2]))
                break
    return pd.DataFrame(out, columns=["uuid", "message_id"]).astype({"uuid": str, "message_id": str})


def by_time(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(uuid, message_id): requests (uuid, mtime, model), earliest first, each with the earliest free response of its model.

    A response may follow its request by WINDOW at most; an empty model fits any. Time is cut into stretches where no earlier
    request can claim any more. In a stretch whose models are all known each model is matched by itself, in bounded groups
    (claims.first_come). A stretch with a row of unknown model is one group, since that row ties its models together.
    """
    both = requests.select("mtime", "model", "uuid", F.lit(None).cast("string").alias("message_id")).unionByName(responses.select("mtime", "model", F.lit(None).cast("string").alias("uuid"), "message_id"))
    both = written(both.withColumn("slot", F.floor(F.col("mtime") / WINDOW)), "both")
    matched = lambda rows: claims.first_come(*(rows.where(f"{x} is not null").withColumnRenamed("model", "kind") for x in ("uuid", "message_id")), WINDOW)
    if not both.where("model = ''").take(1):
        return matched(both)
    # one row per slot of ten minutes; no request reaches beyond the slot after its own
    reach = F.max(F.when(F.col("uuid").isNotNull(), F.col("mtime") + WINDOW))
    slots = written(both.groupBy("slot").agg(F.max(F.col("model") == "").alias("open"), reach.alias("reach"), F.min("mtime").alias("first")), "slots")
    reached = slots.select((F.col("slot") + 1).alias("slot"), F.col("reach").alias("reached"))
    slots = slots.join(reached, "slot", "left").select("slot", "open", F.when(F.coalesce(F.col("first") > F.col("reached"), F.lit(True)), 1).otherwise(0).alias("new"))
    slots = claims.sums_before(slots, (), ("new",)).withColumn("stretch", F.col("new_before") + F.col("new"))
    open_ = written(slots.join(slots.where("open").select("stretch").distinct(), "stretch", "left_semi").select("slot", "stretch"), "open")
    tied = both.join(open_, "slot").groupBy("stretch").applyInPandas(lambda pdf: _claim(pdf[["mtime", "model", "uuid", "message_id"]]), "uuid string, message_id string")
    return tied.unionByName(matched(both.join(open_, "slot", "left_anti")))


def threaded(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with thread_id, message_id and the other columns of responses (empty and null where unpaired).

    First chain adjacency. Then a chain whose root names a response of another chain of its session continues that chain's
    thread; if nobody has that response, it also goes to the latest request before it that ends a chain and fits its time
    and model. Threads are named by the first request of the first chain. Last, requests that end a chain and are
    still unpaired take responses by time. Threads are found by doubling pointers between chains. Only the continuations that
    claim an answer nobody has, and the tips of their session, are grouped by session, one row a chain.
    """
    requests, responses = written(requests, "requests"), written(responses, "responses")
    won = written(_won(requests, responses), "won")
    placed = named(requests).join(won.select("uuid", F.col("named").alias("message_id")), "uuid", "left")
    tip = F.max_by(F.struct("uuid", "mtime", "model", F.col("message_id").isNull().alias("free")), "place").alias("tip")
    chains = placed.groupBy("session_id", "chain").agg(F.min("root_mtime").alias("root_mtime"), F.min("root_uuid").alias("root_uuid"), F.min_by("prev_id", "place").alias("root_prev"), tip)
    owners = placed.where("message_id is not null").select("session_id", F.col("message_id").alias("root_prev"), F.col("chain").alias("owner_chain"))
    open_ = responses.select(F.col("message_id").alias("root_prev"), F.col("mtime").alias("free_mtime"), F.col("model").alias("free_model")).join(won.select(F.col("named").alias("root_prev")), "root_prev", "left_anti")
    chains = chains.join(owners, ["session_id", "root_prev"], "left").join(open_, "root_prev", "left")
    chains = chains.select("session_id", "chain", "root_mtime", "root_uuid", "root_prev", "owner_chain", "free_mtime", "free_model", F.col("tip.uuid").alias("tip_uuid"), F.col("tip.mtime").alias("tip_mtime"), F.col("tip.model").alias("tip_model"), F.col("tip.free").alias("tip_free"))
    chains = written(chains, "chains")
    # continuations of free responses, and tips without an answer in their sessions
    asking = chains.where("root_prev <> '' and owner_chain is null and free_mtime is not null")
    tips = chains.where("tip_free").join(asking.select("session_id").distinct(), "session_id", "left_semi")
    both = lambda rows, mtime, model, message: rows.select("session_id", "chain", "root_mtime", "root_uuid", "tip_uuid", F.col(mtime).alias("mtime"), F.coalesce(model, F.lit("")).alias("model"), message.alias("message_id"))
    claimed = both(asking, "free_mtime", "free_model", F.col("root_prev")).unionByName(both(tips, "tip_mtime", "tip_model", F.lit(None).cast("string")))
    claimed = written(claimed.groupBy("session_id").applyInPandas(_tips_claimed, "session_id string, chain string, owner string, tip_uuid string, message_id string"), "claimed")
    owned = chains.where("root_prev <> ''").join(claimed.select("session_id", "chain", "owner"), ["session_id", "chain"], "left").withColumn("root", F.coalesce("owner_chain", "owner"))
    # a chain is done where its owner comes later, as owners are settled in order of their roots
    owner = chains.select("session_id", F.col("chain").alias("root"), F.struct("root_mtime", "root_uuid").alias("at"))
    edges = owned.where("root <> chain").join(owner, ["session_id", "root"]).select("session_id", "chain", "root", (F.col("at") > F.struct("root_mtime", "root_uuid")).alias("done"))
    first = chains.select("session_id", F.col("chain").alias("root"), F.col("root_uuid").alias("thread_id"))
    threads = chains.select("session_id", "chain", "root_uuid").join(roots(edges).join(first, ["session_id", "root"]).drop("root"), ["session_id", "chain"], "left")
    threads = threads.select("session_id", "chain", F.coalesce("thread_id", "root_uuid").alias("thread_id"))
    # a response that two sessions' continuations name goes to one
    stitched = claimed.groupBy("message_id").agg(F.min_by("tip_uuid", F.struct("session_id", "tip_uuid")).alias("uuid"))
    known = won.select("uuid", F.col("named").alias("message_id")).unionByName(stitched.select("uuid", "message_id"))
    ends = chains.where("tip_free").select(F.col("tip_uuid").alias("uuid"), F.col("tip_mtime").alias("mtime"), F.col("tip_model").alias("model")).join(stitched.select("uuid"), "uuid", "left_anti")
    free = responses.select("message_id", "mtime", "model").join(known.select("message_id"), "message_id", "left_anti")
    known = known.unionByName(by_time(ends, free))
    answers = responses.withColumnsRenamed({"mtime": "response_mtime", "model": "response_model"})
    return requests.join(threads, ["session_id", "chain"]).join(known.join(answers, "message_id"), "uuid", "left").withColumn("message_id", F.coalesce("message_id", F.lit("")))
