"""State per key over events in the order of their time: run states and the ledger of retrieval.

A stream's rows wait in state until the watermark has passed them, and are then taken in order of time, so
the result is that of a fold over the sorted events, however they arrive; repeats within the delay and
rows later than it are dropped. The fold is a small function of state and event, the same in batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict | None, dict], tuple[dict, dict]]


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def folded(events: DataFrame, key: str, ts: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """Rows (key, ts, order and what ``step`` gives, by schema) of a table: each key's events in order."""
    names = [key, ts, *order, *_columns(schema)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for e in rows.sort_values([ts, *order], kind="stable").to_dict("records"):
            state, row = step(state, e)
            out.append({key: e[key], ts: e[ts], **{c: e[c] for c in order}, **row})
        return pd.DataFrame(out, columns=names)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(key, ts, *order).schema)
    return events.groupBy(key).applyInPandas(run, f"{head}, {schema}")


def folded_stream(stream: DataFrame, key: str, ts: str, order: list[str], step: Step, schema: str, lateness: str) -> DataFrame:
    """The same of a stream whose ``order`` columns together name an event: rows come out once the
    watermark, ``lateness`` behind the newest event, has passed them."""
    names = [key, ts, *order, *_columns(schema)]
    payload = [c for c in stream.columns if c not in (key, ts)]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.select(key, ts, *order).schema)

    def plain(value):
        return None if value is None or value is pd.NaT or value != value else value.item() if hasattr(value, "item") else value

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = (None, []) if not state.exists else (json.loads(x) for x in state.get)
        for rows in batches:
            waiting += [[int(r[ts].value // 1000), {c: plain(r[c]) for c in payload}] for r in rows.to_dict("records")]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda w: (w[0], *[w[1][c] for c in order]))
        due = [w for w in waiting if w[0] <= mark]
        waiting, out = waiting[len(due) :], []
        for at, e in due:
            moment = pd.Timestamp(at, unit="us")
            held, row = step(held, {key: k[0], ts: moment, **e})
            out.append({key: k[0], ts: moment, **{c: e[c] for c in order}, **row})
        state.update((json.dumps(held), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, mark // 1000) + 1)
        yield pd.DataFrame(out, columns=names)

    marked = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(order)
    return marked.groupBy(key).applyInPandasWithState(run, f"{head}, {schema}", "held string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


#: What each event makes of a run's state; anything else is refused and changes nothing.
RUNS = {
    (None, "start"): "RUNNING", ("RUNNING", "ask"): "WAITING_APPROVAL", ("WAITING_APPROVAL", "approve"): "RUNNING", ("WAITING_APPROVAL", "reject"): "RUNNING",
    ("RUNNING", "finish"): "COMPLETED", ("RUNNING", "fail"): "FAILED", ("WAITING_APPROVAL", "fail"): "FAILED",
}
RUN_ROW = "before string, after string, refused boolean"


def run_step(state: dict | None, event: dict) -> tuple[dict, dict]:
    """One event (kind) of a run."""
    before = (state or {}).get("status")
    after = RUNS.get((before, event["kind"]))
    return {"status": after or before}, {"before": before, "after": after or before, "refused": after is None}


#: Most finds, probed sources, opened sets and hops of a run; characters and pages of a set; characters of all.
FINDS, PROBES, OPENS, HOPS, SET_CHARS, SET_PAGES, ALL_CHARS = 6, 8, 3, 4, 3000, 3, 24_000
LEDGER_ROW = "granted long, refusal string, chars long"


def ledger_step(state: dict | None, event: dict) -> tuple[dict, dict]:
    """One charge (action; dataset; wanted and overview, numbers of characters) of a run. Nothing is ever
    given back. A card that does not fit is granted as its overview if that fits."""
    s = state or {"find": 0, "probe": 0, "open": 0, "hop": 0, "chars": 0, "sets": {}, "discarded": 0, "compacted": 0}
    action, name = event["action"], event.get("dataset")
    own = s["sets"].get(name)
    granted, refusal = 1, None
    if action in ("find", "probe", "hop"):
        most, what = {"find": (FINDS, "calls"), "probe": (PROBES, "sources"), "hop": (HOPS, "hops")}[action]
        if s[action] >= most:
            granted, refusal = 0, f"{action}: {s[action]} {what} (cap {most})"
        else:
            s[action] += 1
    elif action == "open":
        if s["open"] >= OPENS:
            granted, refusal = 0, f"open: {s['open']} datasets (cap {OPENS})"
        elif own and own["pages"] >= SET_PAGES:
            granted, refusal = 0, f"open {name}: {own['pages']} pages (cap {SET_PAGES})"
        elif own and own["chars"] >= SET_CHARS:
            granted, refusal = 0, f"open {name}: {own['chars']} chars (cap {SET_CHARS})"
        elif own is None:
            s["open"] += 1
            s["sets"][name] = {"chars": 0, "pages": 0}
    elif action == "page":
        if own and own["pages"] >= SET_PAGES:
            granted, refusal = 0, f"page {name}: {own['pages']} pages (cap {SET_PAGES})"
        else:
            s["sets"].setdefault(name, {"chars": 0, "pages": 0})["pages"] += 1
    elif action == "chars":
        used = own["chars"] if own else 0
        rest, left, wanted, overview = ALL_CHARS - s["chars"], SET_CHARS - used, event["wanted"], event["overview"]
        room = min(rest, left, wanted)
        granted = 0
        if left <= 0:
            refusal = f"chars {name}: {used}/{SET_CHARS} per dataset"
        elif rest <= 0:
            refusal = f"chars global: {s['chars']}/{ALL_CHARS}"
        elif room >= wanted or room >= overview:
            granted = wanted if room >= wanted else overview
            s["sets"].setdefault(name, {"chars": 0, "pages": 0})["chars"] += granted
            s["chars"] += granted
        else:
            scope = f"{name}: {used}/{SET_CHARS} per dataset" if left <= rest else f"global: {s['chars']}/{ALL_CHARS}"
            refusal = f"chars {scope} — only {room} of {overview} overview characters fit"
    elif action in ("discard", "compact"):
        s["discarded" if action == "discard" else "compacted"] += 1
    else:
        granted, refusal = 0, f"{action}: unknown"
    return s, {"granted": granted, "refusal": refusal, "chars": s["chars"]}


def final_states(rows: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """(key, status, changes, refused) from the rows of ``run_step``."""
    last = F.max_by("after", F.struct(ts, *order))
    return rows.groupBy(key).agg(last.alias("status"), F.count_if(~F.col("refused")).alias("changes"), F.count_if("refused").alias("refused"))


def run_states(events: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """``final_states`` of a table (kind), by Spark's functions alone: each run's events, in order, in one array."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(ts, *order, "kind"))), lambda x: x["kind"])
    begin = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("changes"), F.lit(0).cast("long").alias("refused"))

    def step(acc, kind):
        after = F.coalesce(*[F.when(acc["status"].eqNullSafe(F.lit(before)) & (kind == event), F.lit(to)) for (before, event), to in RUNS.items()])
        legal = after.isNotNull().cast("long")
        return F.struct(F.coalesce(after, acc["status"]).alias("status"), (acc["changes"] + legal).alias("changes"), (acc["refused"] + 1 - legal).alias("refused"))

    return events.groupBy(key).agg(F.aggregate(listed, begin, step).alias("s")).select(key, "s.*")
