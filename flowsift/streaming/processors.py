"""Keyed state of the streaming jobs: one typed value per key and one event-time timer.

A timer fires when the watermark passes it, whether or not the key has new
rows, so state leaves by itself.  (Time-to-live of state counts processing time
and would make results depend on the machine's speed.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsift.functions.packets import FLOW_KEY, TCP_FLAGS
from flowsift.operators.anchors import FRESH, RunRule, RunScan

_SUMS = ["packets_seen", "src_bytes", "dst_bytes", *[f"flag_{n}" for n in TCP_FLAGS]]
_LONGS = ["start_us", "flow_id", "end_us", *_SUMS]
#: Columns of an emitted flow after its key.
FLOW_COLUMNS = ["flow_id", "start_us", "end_us", "packet_count", "src_bytes", "dst_bytes", *[f"flag_{n}" for n in TCP_FLAGS]]

#: What the gate says of a packet's payload, without the underscore that such processors do not hand over.
PAYLOAD_COLUMNS = {"payload_hit": "_hit", "payload_some": "_some", "payload_head": "_head", "payload_tail": "_tail"}


def sorted_rows(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable").reset_index(drop=True)


def walk(rows: pd.DataFrame, rule: RunRule, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    first = np.zeros(len(rows), dtype=bool)
    first[0] = state == FRESH
    return rule.walk(rows["ts_us"].to_numpy(np.int64), first, state)


class _Timed(StatefulProcessor):
    """A value state whose last field ``due`` is the time of the key's timer (0: none)."""

    name: str
    fields: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState(self.name, T.StructType([*self.fields.fields]).add("due", "long"))

    def known(self) -> dict | None:
        if not self.value.exists():
            return None
        return dict(zip([*self.fields.names, "due"], self.value.get()))

    def keep(self, known: dict | None, new: dict, due: int) -> None:
        """Store ``new`` and move the timer."""
        if known and known["due"] and known["due"] != due:
            self.handle.deleteTimer(known["due"])
        if due and (not known or known["due"] != due):
            self.handle.registerTimer(due)
        self.value.update(tuple(new[n] for n in self.fields.names) + (due,))

    def forget(self, known: dict | None) -> None:
        if known:
            if known["due"]:
                self.handle.deleteTimer(known["due"])
            self.value.clear()

    def close(self) -> None:
        pass


class FlowTracker(_Timed):
    """Packets to flows: the running sums of the open flow, and with ``scan`` the end of its payload.

    A closed flow is emitted with the packet that closes it, an idle one when
    its timer fires.  If ``gated``, rows bring :data:`PAYLOAD_COLUMNS` and
    flows say whether their payload ``matched``; ``scan`` finds matches across
    packets, also those of different micro-batches.
    """

    name = "flow"

    def __init__(self, rule: RunRule, packet_cap: int | None, idle_us: int | None, gated: bool, scan: RunScan | None):
        self.rule, self.packet_cap, self.idle_us, self.gated, self.scan = rule, packet_cap, idle_us, gated, scan
        self.fields = T.StructType([T.StructField(n, T.LongType()) for n in _LONGS]).add("matched", "boolean").add("ending", "string")

    def _emitted(self, key: tuple, flow: dict, reason: str) -> dict:
        row = dict(zip(FLOW_KEY, key)) | {n: int(flow[n]) for n in FLOW_COLUMNS if n != "packet_count"}
        seen = int(flow["packets_seen"])
        row |= {"packet_count": seen if self.packet_cap is None else min(seen, self.packet_cap), "close_reason": reason}
        return row | ({"matched": bool(flow["matched"])} if self.gated else {})

    def _frame(self, flows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(flows, columns=[*FLOW_KEY, *FLOW_COLUMNS, "close_reason", *["matched"] * self.gated])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known()
        batch = sorted_rows(rows, ["ts_us", "packet_id"])
        anchor, is_anchor, leaving = walk(batch, self.rule, FRESH if known is None else int(known["start_us"]))
        matched, ending = batch["payload_hit"].to_numpy(dtype=bool) if self.gated else np.zeros(len(batch), dtype=bool), ""
        if self.scan:
            records = pa.RecordBatch.from_pandas(batch[list(PAYLOAD_COLUMNS)].rename(columns=PAYLOAD_COLUMNS), preserve_index=False)
            across, ending = self.scan.mark(records, is_anchor, known["ending"] if known else self.scan.empty)
            matched = matched | across
        parts = pd.DataFrame({
            "start_us": anchor, "flow_id": batch["packet_id"], "end_us": batch["ts_us"], "packets_seen": 1,
            "src_bytes": np.where(batch["from_a"], batch["length"], 0), "dst_bytes": np.where(batch["from_a"], 0, batch["length"]),
            **{f"flag_{n}": ((batch["flags"] & bit) != 0).astype("int64") for n, bit in TCP_FLAGS.items()}, "matched": matched,
        })
        if known:
            parts = pd.concat([pd.DataFrame([known], columns=[*_LONGS, "matched"]), parts])
        how = {"flow_id": "min", "end_us": "max", **dict.fromkeys(_SUMS, "sum"), "matched": "max"}
        flows = parts.groupby("start_us", sort=True).agg(how).reset_index()
        closed = flows if leaving == FRESH else flows.iloc[:-1]
        if leaving == FRESH:
            self.forget(known)
        else:
            last = flows.iloc[-1]
            flow = {n: int(last[n]) for n in _LONGS} | {"matched": bool(last["matched"]), "ending": ending}
            due = 0 if self.idle_us is None else max((flow["end_us"] + self.idle_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.keep(known, flow, due)
        if len(closed):
            yield self._frame([self._emitted(key, f, "timeout") for f in closed.to_dict("records")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known()
        if known and known["due"] == expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
            yield self._frame([self._emitted(key, known, "idle")])


class Cooldown(_Timed):
    """Rows that are not within ``limit`` of the last kept row of their key; the timer ends the cooldown."""

    name = "cooldown"
    fields = T.StructType().add("anchor_us", "long")

    def __init__(self, rule: RunRule, order: Sequence[str], columns: Sequence[str]):
        self.rule, self.order, self.columns = rule, list(order), list(columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known()
        batch = sorted_rows(rows, self.order)
        _, kept, leaving = walk(batch, self.rule, FRESH if known is None else int(known["anchor_us"]))
        due = max((leaving + self.rule.limit) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.keep(known, {"anchor_us": int(leaving)}, due)
        yield batch.loc[kept, self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known()
        if known and known["due"] == expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
        yield from ()


