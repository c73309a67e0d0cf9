"""Packing documents into sequences in bounded space.

Documents are tokenised where they lie.  A document longer than a sequence
fills whole sequences first.  Each packer (at first one per partition) keeps a
fixed number of open sequences; a piece goes to the open one with the least
room that still holds it.  If none does, the fullest is emitted; where its room
is worth it, the head of the piece is cut off to fill it.

What is open when a packer ends is handed, ids included, to a packer that
merges the leftovers of ``FAN`` packers, and so on until one is left.  No
packer ever holds more than ``FAN * OPEN`` sequences.  The last one fills its
sequences completely, so all leftovers of a run pad one sequence at most.

Null texts are empty; an empty text still has its end id.  Repeated rows are
packed as often as they occur; rows without an id are packed too.  Other
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.tokens import WordIds
from flowsift.session import cut_lineage

LENGTH = 2048
END_ID = 1
#: Open sequences of a packer, packers merged by one, and the least room that is filled by cutting.
OPEN = 64
FAN = 16
LEAST_CUT = 32

_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "packer", "ids"]


class Packer:
    """Online best fit into a bounded number of open sequences."""

    def __init__(self, number: int, length: int = LENGTH, most: int = OPEN):
        self.number, self.length, self.most = number, length, most
        self.count, self.open, self.rows = 0, [], []  # an open sequence: [used, pieces]

    def _emit(self, pieces: list[tuple]) -> None:
        sequence, offset = (self.number << 32) | self.count, 0
        self.count += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, None, None))
            offset += len(ids)

    def _place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        fits = [s for s in self.open if s[0] + len(ids) <= self.length]
        if fits:
            best = max(fits, key=lambda s: s[0])
        else:
            if len(self.open) == self.most:
                fullest = max(self.open, key=lambda s: s[0])
                self.open.remove(fullest)
                room = self.length - fullest[0]
                if room >= LEAST_CUT:
                    fullest[1].append((doc, start, ids[:room], total))
                    start, ids = start + room, ids[room:]
                self._emit(fullest[1])
            best = [0, []]
            self.open.append(best)
        best[0] += len(ids)
        best[1].append((doc, start, ids, total))
        if best[0] == self.length:
            self.open.remove(best)
            self._emit(best[1])

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        for at in range(0, len(ids), self.length):
            part = ids[at:at + self.length]
            if len(part) == self.length:
                self._emit([(doc, start + at, part, total)])
            else:
                self._place(doc, start + at, part, total)

    def hand_on(self) -> None:
        """Leave the open sequences to the next packer."""
        for _, pieces in self.open:
            for doc, start, ids, total in pieces:
                self.rows.append((doc, start, len(ids), None, total, None, None, self.number, ids.tobytes()))
        self.open = []

    def finish(self) -> None:
        """Emit everything: the emptiest sequences are cut up to fill the others."""
        left = sorted(self.open, key=lambda s: s[0])
        self.open = []
        while left:
            used, pieces = left.pop()
            while used < self.length and left:
                source = left[0]
                doc, start, ids, total = source[1].pop()
                take = min(self.length - used, len(ids))
                pieces.append((doc, start + len(ids) - take, ids[len(ids) - take:], total))
                used, source[0] = used + take, source[0] - take
                if take < len(ids):
                    source[1].append((doc, start, ids[:len(ids) - take], total))
                if not source[1]:
                    left.pop(0)
            self._emit(pieces)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         end_id: int = END_ID, most: int = OPEN, fan: int = FAN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, packer long, ids binary"
    )
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *kinds])], names=_COLUMNS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids_of, kind = Packer(TaskContext.get().partitionId(), length, most), WordIds(path), None
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text"))):
                packer.add(doc, np.concatenate([ids, end]))
            yield batch_of(packer.taken(), kind)
        packer.hand_on()
        if kind is not None:
            yield batch_of(packer.taken(), kind)

    def merger(low: int, number: int, last: bool):
        """Packers ``low`` and up hand over to packers ``number`` and up."""

        def merge(group: pa.Table) -> pa.Table:  # Arrow keeps integers beside nulls as they are
            rows = group.select(["length", "packer", "doc_id", "start", "doc_tokens", "ids"]).to_pylist()
            # within a packer rows without an id come last
            rows.sort(key=lambda r: (-r["length"], r["packer"], (1,) if r["doc_id"] is None else (0, r["doc_id"]), r["start"]))
            packer = Packer(number + (rows[0]["packer"] - low) // fan, length, most)
            for r in rows:
                packer.add(r["doc_id"], np.frombuffer(r["ids"], dtype="<u4"), r["start"], r["doc_tokens"])
            packer.finish() if last else packer.hand_on()
            return pa.Table.from_batches([batch_of(packer.taken(), group.schema.field("doc_id").type)])

        return merge

    placed = cut_lineage(rows.mapInArrow(first, schema))
    left, whole = placed.where("packer is not null"), placed.where("packer is null")
    low, number = 0, (left.agg(F.max("packer")).first()[0] or 0) + 1
    while True:
        groups = -(-(number - low) // fan)
        by = F.floor((F.col("packer") - low) / fan).alias("group")
        merged = cut_lineage(left.groupBy(by).applyInArrow(merger(low, number, groups == 1), schema))
        left, whole = merged.where("packer is not null"), whole.unionByName(merged.where("packer is null"))
        low, number = number, number + groups
        if groups == 1:
            return whole.select(*_COLUMNS[:7])
