import random

from faultlens.operators.ops import PENDING_SECONDS, delivery_ledger

SCHEMA = "incident_key string, destination string, at_s bigint, seq bigint, action string, external_id string, state string"


def replay(events, as_of):
    """One delivery after the other, event by event."""
    out = {}
    for incident, destination, at, _, action, external, _ in sorted(events, key=lambda e: (e[2], e[3], e[4], e[5] or "~")):
        key = incident, destination
        now = out.get(key)
        if now is None:
            if action == "reserve":
                out[key] = ["pending", 1, at, at, ""]
            continue
        if action in ("reserve", "retry") and now[0] == "failed":
            now[0], now[1], now[3] = "pending", now[1] + 1, at
        elif action == "reserve" and now[0] == "pending" and at - now[3] >= PENDING_SECONDS:
            now[0], now[3] = "unknown", at
        elif action in ("confirm", "fail", "unknown"):
            now[0], now[3], now[4] = {"confirm": "confirmed", "fail": "failed", "unknown": "unknown"}[action], at, external or ""
    return sorted((*key, *now, now[0] == "pending" and as_of - now[3] >= PENDING_SECONDS, now[0] == "failed") for key, now in out.items())


def result(df):
    return sorted((r.incident_key, r.destination, r.state, r.attempts, r.created_at, r.updated_at, r.external_id, r.overdue, r.retryable) for r in df.collect())


def test_replayed_event_by_event(spark):
    rng = random.Random(4)
    actions = ["reserve"] * 5 + ["retry", "confirm", "fail", "fail", "unknown", "noop", None]
    for trial in range(3):
        # Nearly all events belong to one delivery, which fills many pieces.
        events = [("hot" if rng.random() < 0.8 else f"i{rng.randrange(40)}", "chat" if rng.random() < 0.9 else "mail", rng.randrange(60_000 if trial else 900), i, rng.choice(actions), rng.choice([None, "", "x", "y"]), "s")
                  for i in range(700)]
        as_of = 60_100
        ledger = delivery_ledger(spark.createDataFrame([(*e[:4], e[4] or "noop", *e[5:]) for e in events], SCHEMA).repartition(3), as_of)
        assert result(ledger) == replay([(*e[:4], e[4] or "noop", *e[5:]) for e in events], as_of)


def test_without_a_reservation_there_is_no_delivery(spark):
    rows = [("a", "chat", 1, 1, "confirm", "x", "s"), ("a", "chat", 2, 2, "retry", "x", "s"), ("b", "chat", 1, 1, None, None, "s")]
    assert delivery_ledger(spark.createDataFrame(rows, SCHEMA), 10).collect() == []
    assert delivery_ledger(spark.createDataFrame([], SCHEMA), 10).collect() == []
