import json
import os

import pyarrow as pa
import pytest

from tracewell.operators import pairing
from tracewell.sources import bodies, capture

DAY = 1705276800  # 2024-01-15 00:00 UTC


@pytest.fixture
def folder(tmp_path):
    def put(name, value, at):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        os.utime(tmp_path / name, (DAY + at, DAY + at))

    def request(uuid, at, n, first="hi", prev="", user="u_session_s1"):
        put(f"{uuid}.request.json", {"model": "m", "metadata": {"user_id": user}, "diagnostics": {"previous_message_id": prev}, "messages": [{"role": "user", "content": first}] * n}, at)

    def response(name, at, message, model="m", tokens=3):
        put(f"{name}.response.json", {"id": message, "model": model, "stop_reason": "end_turn", "usage": {"input_tokens": tokens, "output_tokens": 1}}, at)

    request("r1", 10, 1)
    request("r2", 30, 3, prev="msg_1")
    request("r3", 50, 5, prev="msg_2")
    request("side", 31, 1, first="task")
    request("rival", 32, 1, first="other", user='{"session_id": "s2", "account_uuid": "acc"}')
    request("rival2", 33, 3, first="other", prev="msg_1", user='{"session_id": "s2"}')
    request("late", 90000, 1, first="late")
    put("broken.request.json", "{", 5)
    put("none.request.json", {"messages": []}, 5)
    put("notes.txt", "x", 5)
    response("q1", 20, "msg_1")
    response("again", 40, "msg_1", tokens=9)
    response("q2", 45, "msg_2", model="other")
    response("q3", 60, "msg_3")
    (tmp_path / "sub").mkdir()
    return str(tmp_path)


def test_adjacency_claims_once(spark, folder):
    made = pairing.adjacent(capture.requests(spark, folder), capture.responses(spark, folder).withColumnsRenamed({"mtime": "response_mtime", "model": "response_model"}))
    assert {r["uuid"]: r["message_id"] for r in made.collect() if r["message_id"]} == {"r1": "msg_1", "r2": "msg_2"}


def test_read(spark, folder):
    rows = {r["request_uuid"]: r for r in capture.read(spark, folder, bodies=True).collect()}
    assert set(rows) == {"r1", "r2", "r3", "side", "rival", "rival2", "late"}
    # the last request of the first chain takes the free response of its model by time
    assert {u: r["message_id"] for u, r in rows.items() if r["message_id"]} == {"r1": "msg_1", "r2": "msg_2", "side": "msg_3"}
    assert (rows["r1"]["request_id"], rows["r1"]["status"], rows["r1"]["input_tokens"]) == ("q1", "200", 3)
    assert (rows["r3"]["request_id"], rows["r3"]["status"], rows["r3"]["input_tokens"]) == ("r3", "", 0)
    assert rows["rival"]["principal"] == "acc" and rows["rival"]["session_id"] == "s2" and rows["rival"]["extra"] == {"session_id": "s2"}
    assert rows["r1"]["thread_id"] == rows["r3"]["thread_id"] == "r1" and rows["side"]["thread_id"] == "side"
    assert json.loads(rows["r1"]["input_body"])["model"] == "m" and json.loads(rows["r1"]["output_body"])["id"] == "msg_1" and rows["r3"]["output_body"] is None
    assert rows["rival2"]["message_id"] == "" and rows["late"]["message_id"] == ""


def test_window_and_unclaimed(spark, folder):
    assert "late" not in {r["request_uuid"] for r in capture.read(spark, folder, "2024-01-15", "2024-01-15").collect()}
    left = pairing.unclaimed(capture.read(spark, folder), capture.responses(spark, folder))
    assert left.collect() == []


SECOND = 1_000_000


def paired(spark, requests, responses):
    """requests: (uuid, session, chain, messages, second, prev, model); responses: (message, second, model)."""
    asked = spark.createDataFrame([(u, s, c, n, at * SECOND, p, m) for u, s, c, n, at, p, m in requests], "uuid string, session_id string, chain string, num_messages int, mtime long, prev_id string, model string")
    given = spark.createDataFrame([(m, at * SECOND, x) for m, at, x in responses], "message_id string, mtime long, model string")
    return {r.uuid: (r.thread_id, r.message_id) for r in pairing.threaded(asked, given).collect()}


def test_compaction_is_stitched(spark):
    """A chain whose root names the answer of another chain continues its thread, over several steps, whoever has the answer."""
    requests = [("a1", "s", "A", 1, 10, "", "m"), ("a2", "s", "A", 3, 20, "x1", "m"), ("b1", "s", "B", 1, 40, "x2", "m"), ("b2", "s", "B", 3, 50, "y1", "m"), ("c1", "s", "C", 1, 70, "y2", "m"), ("side", "s", "D", 1, 15, "", "n"), ("other", "t", "A", 1, 41, "x2", "m")]
    responses = [("x1", 15, "m"), ("x2", 30, "m"), ("y1", 45, "m"), ("y2", 60, "m"), ("z", 80, "m"), ("d", 16, "n")]
    got = paired(spark, requests, responses)
    assert got == {"a1": ("a1", "x1"), "a2": ("a1", "x2"), "b1": ("a1", "y1"), "b2": ("a1", "y2"), "c1": ("a1", ""), "side": ("side", "d"), "other": ("other", "z")}


def test_time_matches_first_come_first_served(spark):
    requests = [(f"r{i}", f"s{i}", "A", 1, at, "", m) for i, (at, m) in enumerate([(10, "m"), (11, "m"), (12, ""), (13, "n"), (5000, "m")])]
    responses = [("p1", 9, "m"), ("p2", 14, "n"), ("p3", 15, "m"), ("p4", 16, ""), ("p5", 700, "m"), ("p6", 5601, "m")]
    assert {u: m for u, (_, m) in paired(spark, requests, responses).items()} == {"r0": "p3", "r1": "p4", "r2": "p2", "r3": "", "r4": ""}
    assert {u: m for u, (_, m) in paired(spark, requests[3:4] + requests[1:2], [("k1", 20, "m"), ("k2", 21, "n")]).items()} == {"r3": "k2", "r1": "k1"}
    assert paired(spark, [], responses) == {} and paired(spark, requests[:1], []) == {"r0": ("r0", "")}


def test_only_bodies_of_the_rows_left_are_opened(spark, folder, monkeypatch):
    rows = capture.read(spark, folder, bodies=True).where("request_uuid in ('r1', 'r3')")
    assert {r.request_uuid: (json.loads(r.input_body)["model"], r.output_body and json.loads(r.output_body)["id"]) for r in rows.collect()} == {"r1": ("m", "msg_1"), "r3": ("m", None)}
    opened = []
    monkeypatch.setattr(bodies, "_text", lambda path: opened.append(path) or ("x" * 5 if path else None))
    monkeypatch.setattr(bodies, "HELD", 12)
    given = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "p": ["a", None, "c"], "q": ["b", "d", None]})
    out = list(bodies._read(iter([given]), ["k"], {"in": "p", "out": "q"}))
    assert opened == ["a", "b", None, "d", "c", None] and [b.to_pydict() for b in out] == [{"k": [1, 2], "in": ["xxxxx", None], "out": ["xxxxx", "xxxxx"]}, {"k": [3], "in": ["xxxxx"], "out": [None]}]


def test_files_that_are_gone_are_null(spark, folder):
    rows = spark.createDataFrame([(1, f"file:{folder}/q1.response.json"), (2, f"file:{folder}/gone"), (3, None), (4, "")], "k long, path string")
    got = {r.k: r.body for r in bodies.fetched(rows, {"body": "path"}).collect()}
    assert json.loads(got[1])["id"] == "msg_1" and (got[2], got[3], got[4]) == (None, None, None)


def _in_order(requests, responses):
    """Owners and claims chain by chain in order of their roots: {chain: thread}, {tip: message}, of one session."""
    chains = {}
    for u, _, c, n, at, p, m in requests:
        chains.setdefault(c, []).append((n, at, u, p, m))
    chains = {c: sorted(rows) for c, rows in chains.items()}
    given = {m: (at, x) for m, at, x in responses}
    order = sorted(chains, key=lambda c: (chains[c][0][1], chains[c][0][2]))
    holder, claims = {}, {}
    for c in order:
        for i in range(1, len(chains[c])):
            if chains[c][i][3] in given and chains[c][i][3] not in holder:
                holder[chains[c][i][3]] = c
    root = {c: c for c in order}
    open_tips = set(order)
    for n, c in enumerate(order):
        named = chains[c][0][3]
        if named and named not in holder and named in given:
            at, model = given[named]
            fits = [t for t in order[:n] if t in open_tips and chains[t][-1][1] <= at and (not model or not chains[t][-1][4] or model == chains[t][-1][4])]
            if fits:
                tip = max(fits, key=lambda t: (chains[t][-1][1], -order.index(t)))
                open_tips.remove(tip)
                holder[named], claims[chains[tip][-1][2]] = tip, named
        if named in holder and holder[named] != c:
            root[c] = root[holder[named]]
    return {c: chains[root[c]][0][2] for c in order}, claims


def test_stitching_equals_one_chain_after_another(spark):
    """Random sessions whose roots name any response, of any time and model, several chains the same one."""
    import random

    rng = random.Random(7)
    requests, responses, want = [], [], {}
    for s in range(40):
        given = [(f"x{s}-{i}", rng.randrange(60), rng.choice(["m", "n", ""])) for i in range(12)]
        used, mine = iter(rng.sample(range(12), 12)), []
        for c in range(14):
            at = rng.randrange(60)
            for n in range(1, rng.choice([1, 1, 2]) + 1):
                prev = rng.choice(["", given[rng.randrange(12)][0], given[rng.randrange(12)][0]]) if n == 1 else f"x{s}-{k}" if (k := next(used, None)) is not None else ""
                mine.append((f"r{s}-{c:02}-{n}", f"s{s}", f"c{c:02}", n, at + 2 * n, prev, rng.choice(["m", "n", ""])))
        requests += mine
        responses += given
        threads, claims = _in_order(mine, given)
        want |= {u: (threads[c], claims.get(u)) for u, _, c, *_ in mine}
    got = paired(spark, requests, responses)
    assert {u: t for u, (t, _) in got.items()} == {u: t for u, (t, _) in want.items()}
    assert all(got[u][1] == m for u, (_, m) in want.items() if m)


def test_pointers_double(spark):
    edges = [("s", f"c{i:04}", f"c{i - 1:04}", False) for i in range(1, 1000)] + [("s", "late", "later", True), ("s", "after", "late", False)]
    got = {r.chain: r.root for r in pairing.roots(spark.createDataFrame(edges, "session_id string, chain string, root string, done boolean")).collect()}
    assert {got.pop("late"), got.pop("after")} == {"later"} and set(got.values()) == {"c0000"} and len(got) == 999


def test_a_session_of_many_chains():
    """Every continuation takes the latest tip that is left, as brackets close; no claim looks at all tips."""
    import time

    import pandas as pd

    n = 50_000
    tips = [("s", f"t{i}", i, f"t{i}", f"u{i}", i, "m", None) for i in range(n)]
    asked = [("s", f"a{i}", n + i, f"a{i}", "", n, "m", f"x{i}") for i in range(n)]
    rows = pd.DataFrame(tips + asked, columns=["session_id", "chain", "root_mtime", "root_uuid", "tip_uuid", "mtime", "model", "message_id"])
    begun = time.time()
    got = pairing._tips_claimed(rows)
    assert got["owner"].tolist() == [f"t{i}" for i in reversed(range(n))] and time.time() - begun < 30
