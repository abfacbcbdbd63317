"""Queries of state folded over events, and the same rows as SQL."""

from pyspark.sql import functions as F

from ..streaming import states as S
from ..tables import table

C = F.col
#: What each type of event is to a run.
KINDS = {"signup": "start", "click": "ask", "view": "approve", "purchase": "finish", "error": "fail"}
ACTIONS = ("find", "probe", "open", "hop", "page", "chars", "discard", "compact")


def run_events(s, d):
    """Events as events of runs: a user's day of the month is a run."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), C("event_type"))
    return table(s, d, "events").select((C("user_id") * 100 + F.dayofmonth("ts")).alias("run"), "ts", "event_id", kind.alias("kind"))


def run_states(s, d):
    return S.run_states(run_events(s, d), "run", "ts", ["event_id"])


def charges(s, d):
    """Events as charges of users' runs on five sets."""
    k = C("event_id")
    action = F.get(F.array(*map(F.lit, ACTIONS)), (k * 7 % len(ACTIONS)).cast("int"))
    wanted = F.floor(C("value") * 20).cast("long")
    return table(s, d, "events").select(C("user_id").alias("run"), C("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"), F.concat(F.lit("d"), k % 5).alias("dataset"), wanted.alias("wanted"), F.floor(wanted / 3).alias("overview"))


def ledger(s, d):
    return S.folded(charges(s, d), "run", "ts", ["event_id"], S.ledger_step, S.LEDGER_ROW).drop("ts")


QUERIES = {"R15_run_states": run_states, "R9_ledger": ledger}

_NEXT = "CASE WHEN a.st = 'NEW' AND b.k = 'signup' THEN 'RUNNING' WHEN a.st = 'RUNNING' AND b.k = 'click' THEN 'WAITING_APPROVAL' WHEN a.st = 'WAITING_APPROVAL' AND b.k = 'view' THEN 'RUNNING' WHEN a.st = 'RUNNING' AND b.k = 'purchase' THEN 'COMPLETED' WHEN a.st IN ('RUNNING', 'WAITING_APPROVAL') AND b.k = 'error' THEN 'FAILED' END"
ORACLES = {
    "R15_run_states": f"""WITH e AS (SELECT user_id * 100 + day(ts) AS run, list({{'k': event_type, 'st': 'NEW', 'n': 0::BIGINT, 'x': 0::BIGINT}} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
      f AS (SELECT run, list_reduce([{{'k': '', 'st': 'NEW', 'n': 0::BIGINT, 'x': 0::BIGINT}}] || l, lambda a, b: {{'k': b.k, 'st': coalesce({_NEXT}, a.st), 'n': a.n + CASE WHEN {_NEXT} IS NULL THEN 0 ELSE 1 END, 'x': a.x + CASE WHEN {_NEXT} IS NULL THEN 1 ELSE 0 END}}) AS s FROM e)
      SELECT run, nullif(s.st, 'NEW') AS status, s.n AS changes, s.x AS refused FROM f""",
}
