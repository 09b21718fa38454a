"""Price chasing: an open order is quoted anew on a timer until it is filled, or its attempts or failures are used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Tries, failures and milliseconds between tries of one order.
ATTEMPTS, FAILURES, EVERY_MS = 25, 3, 5000
#: What may be chased, and what ends an order.
CHASED, FINAL = ("OPEN", "PARTIAL"), ("COMPLETED", "CANCELLED", "REJECTED")

OUT = "order_id long, at timestamp, action string, price double, attempts int, failures int, remarks string"
_STATE = "status string, instrument string, kind string, price double, chase boolean, seq long, last_ms long, attempts int, failures int"


def chased_orders(
    events: DataFrame, quote: Callable[[str, float | None], float], modify: Callable[[int, float, str], None], allowed: Callable[[int], bool] = lambda ms: True,
    attempts: int = ATTEMPTS, failures: int = FAILURES, every_ms: int = EVERY_MS, event_time: bool = False,
) -> DataFrame:
    """What chasing did, as a stream of OUT in update mode: modified, unchanged or failed.

    events: order_id, ts, seq, status, instrument, kind (LIMIT or other), price, chase. An order's timer runs ``every_ms`` after it was first
    seen as open, or was last tried. Then ``quote(instrument, price)`` gives its new price: an unchanged limit price counts as an attempt and
    calls nobody; else ``modify(order_id, price, key)`` is called, and the order is a limit order at that price. What either raises counts as a
    failure, not as an attempt. A late timer is one try, not several. While ``allowed(ms)`` is false the order waits for its next timer.

    State is one row an order and goes when the order ends, so a key is small however many orders an instrument has. A batch that is run again
    finds the state before it: calls are repeated with the same key (order and try), by which the broker's side can tell them. Events whose
    ``seq`` is not new are ignored; a final state is remembered by the absence of state, so events must not return after it.
    Timers go by the clock, or by the watermark of ``ts`` (``event_time``), which replays alike.
    """

    def timer(state: GroupState, s: tuple) -> None:
        now = state.getCurrentWatermarkMs() if event_time else state.getCurrentProcessingTimeMs()
        due = s[6] + every_ms + 1  # strictly older than the interval
        if event_time:
            state.setTimeoutTimestamp(max(due, now + 1))
        else:
            state.setTimeoutDuration(max(due - now, 1))

    def may(s: tuple) -> bool:
        return s[0] in CHASED and s[4] and s[7] < attempts and s[8] < failures

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else ("", "", "", None, False, -1, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() if event_time else state.getCurrentProcessingTimeMs()
            status, instrument, kind, price, chase, seq, last, tried, failed = s
            if allowed(now):
                remarks = None
                try:
                    new = float(quote(instrument, price))
                    action = "unchanged" if kind == "LIMIT" and new == price else "modified"
                    if action == "modified":
                        modify(int(key[0]), new, f"{int(key[0])}:{tried + failed + 1}")
                    kind, price, tried = "LIMIT", new, tried + 1
                    if tried >= attempts:
                        remarks = f"{attempts} attempts exhausted"
                except Exception as e:
                    action, failed, remarks = "failed", failed + 1, str(e) or type(e).__name__
                out.append((key[0], pd.Timestamp(now, unit="ms"), action, price, tried, failed, remarks))
            s = (status, instrument, kind, price, chase, seq, now, tried, failed)
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples(index=False):
                if r.seq <= s[5]:
                    continue
                price = None if pd.isna(r.price) else float(r.price)
                first = s[0] not in CHASED and r.status in CHASED
                # A chased price is the newer one: an order's event brings a price only before the first try.
                s = (r.status, r.instrument or "", r.kind if not s[7] else s[2], price if not s[7] else s[3], bool(r.chase), int(r.seq), int(pd.Timestamp(r.ts).timestamp() * 1000) if first else s[6], s[7], s[8])
        if s[0] in FINAL:
            if state.exists:
                state.remove()
        else:
            state.update(s)
            if may(s):
                timer(state, s)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"remarks": object, "action": object})

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    x = events.select("order_id", "ts", "seq", "status", "instrument", "kind", "price", "chase")
    x = x.withWatermark("ts", "0 seconds") if event_time else x
    return x.groupBy("order_id").applyInPandasWithState(step, OUT, _STATE, "update", timeout)
