"""Streams against folds of the sorted events, with late, repeated and shuffled rows, and after a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deskflume.operators import mailbox
from deskflume.plans import streams as plans
from deskflume.streaming import states

T0 = dt.datetime(2024, 1, 1)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def drained(spark, make, schema, batches, tmp_path, name):
    """Rows that a stream gives over batches of files, with a new query, from the checkpoint, for each."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(out).collect()


def test_run_states_from_shuffled_events(spark, tmp_path):
    schema = "run long, ts timestamp, event_id long, kind string"
    events = [(1, at(0), 1, "start"), (1, at(2), 2, "ask"), (1, at(4), 3, "approve"), (1, at(6), 4, "finish"), (1, at(7), 5, "fail"), (2, at(1), 6, "ask"), (2, at(3), 7, "start"), (2, at(5), 8, "ask"), (2, at(8), 9, "fail"), (3, at(2), 10, "start")]
    flush = [(9, at(1000), 99, "start")]
    batches = [[events[3], events[0], events[6], events[5]], [events[1], events[2], events[1], events[8]], [events[4], events[7], events[9], events[3]], flush, [(1, at(3), 98, "ask"), (9, at(2000), 100, "ask")]]
    got = drained(spark, lambda s: states.folded_stream(s, "run", "ts", ["event_id"], states.run_step, states.RUN_ROW, "30 minutes"), schema, batches, tmp_path, "runs")
    want = states.folded(spark.createDataFrame(events, schema), "run", "ts", ["event_id"], states.run_step, states.RUN_ROW).collect()
    assert sorted((r.run, r.event_id, r.before or "", r.after or "", r.refused) for r in got if r.run < 9) == sorted((r.run, r.event_id, r.before or "", r.after or "", r.refused) for r in want)
    for last in (states.final_states(spark.createDataFrame(want), "run", "ts", ["event_id"]), states.run_states(spark.createDataFrame(events, schema), "run", "ts", ["event_id"])):
        assert {(r.run, r.status, r.changes, r.refused) for r in last.collect()} == {(1, "COMPLETED", 4, 1), (2, "FAILED", 3, 1), (3, "RUNNING", 1, 0)}


def test_ledger_caps():
    state, rows = None, []

    def charge(**event):
        nonlocal state
        state, row = states.ledger_step(state, event)
        rows.append(row)
        return row

    for action, most in (("find", 6), ("probe", 8), ("hop", 4)):
        assert [charge(action=action)["granted"] for _ in range(most + 1)] == [1] * most + [0]
    assert rows[-1]["refusal"] == "hop: 4 hops (cap 4)"
    assert [charge(action="open", dataset=x)["granted"] for x in "aabcd"] == [1, 1, 1, 1, 0]
    assert [charge(action="page", dataset="a")["granted"] for _ in range(4)] == [1, 1, 1, 0]
    assert charge(action="open", dataset="a")["refusal"] == "open: 3 datasets (cap 3)"
    assert charge(action="chars", dataset="b", wanted=2800, overview=500)["granted"] == 2800
    assert charge(action="chars", dataset="b", wanted=900, overview=150)["granted"] == 150
    assert charge(action="chars", dataset="b", wanted=900, overview=100)["refusal"] == "chars b: 2950/3000 per dataset — only 50 of 100 overview characters fit"
    assert charge(action="chars", dataset="b", wanted=50, overview=10)["granted"] == 50
    assert charge(action="chars", dataset="b", wanted=1, overview=1)["refusal"] == "chars b: 3000/3000 per dataset"
    for k in range(7):
        charge(action="chars", dataset=f"s{k}", wanted=3000, overview=3000)
    assert rows[-1]["chars"] == 24_000
    assert charge(action="chars", dataset="z", wanted=5, overview=5)["refusal"] == "chars global: 24000/24000"
    assert charge(action="discard")["chars"] == charge(action="compact")["chars"] == 24_000 and charge(action="odd")["granted"] == 0


def test_ledger_stream_is_the_batch_fold(spark, tmp_path):
    table = plans.charges(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in table.where("run < 6").orderBy(F.xxhash64("event_id")).collect()]
    want = states.folded(spark.createDataFrame(rows, table.schema), "run", "ts", ["event_id"], states.ledger_step, states.LEDGER_ROW).collect()
    end = (-1, max(r[1] for r in rows) + dt.timedelta(days=99), -1, "find", None, None, None)
    got = drained(spark, lambda s: states.folded_stream(s, "run", "ts", ["event_id"], states.ledger_step, states.LEDGER_ROW, "60 days"), table.schema, [rows[::2], rows[1::2], rows[::3], [end], [(-1, end[1] + dt.timedelta(days=99), -2, "find", None, None, None)]], tmp_path, "ledger")
    assert sorted(map(str, (r for r in got if r.run >= 0))) == sorted(map(str, want)) and len(want) == len(rows)


def test_mail_delivered_twice_changes_nothing(spark, tmp_path):
    schema = "id string, ts timestamp, sender string, subject string, body string, headers map<string,string>"
    tickets = spark.createDataFrame([(100, "OPEN", "a@x.org", 1), (101, "CLOSED", "b@x.org", 2), (102, "OPEN", "a@x.org", 3)], "number long, status string, requester_address string, updated long")
    mails = [("m1", at(0), "A <a@x.org>", "Re: #100 x", "text", None), ("m2", at(1), "b@x.org", "#101", "text", None), ("m3", at(2), "postmaster@x.org", "f", "Original-Recipient: rfc822; A@x.org;", None), ("m4", at(3), "c@x.org", None, "t", {"x-autoreply": "yes"}), ("m5", at(4), "c@x.org", "a", None, None)]
    got = drained(spark, lambda s: mailbox.placed(mailbox.delivered_once(s, "id", "ts", "1 hour"), tickets), schema, [mails[:3], mails, mails[2:] + mails[:1]], tmp_path, "mail")
    assert sorted((r.id, r.action, r.ticket, r.reason) for r in got) == [
        ("m1", "comment", 100, None), ("m2", "created", None, None), ("m3", "bounce", 102, None), ("m4", "ignored", None, "Automated mail — Auto-responder header."), ("m5", "ignored", None, "Empty message body."),
    ]


@pytest.mark.parametrize("name", ["runs"])
def test_empty_table(spark, name):
    none = spark.createDataFrame([], "run long, ts timestamp, event_id long, kind string")
    assert states.folded(none, "run", "ts", ["event_id"], states.run_step, states.RUN_ROW).count() == 0
