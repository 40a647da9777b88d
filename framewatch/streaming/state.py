"""What a stream keeps of each bus and id: typed state that gives the same columns however frames fall into batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The columns of an enriched frame.
ENRICHED = "bus string, seq long, ts_us long, can_id int, dlc int, data array<int>, is_extended boolean, is_remote boolean, is_error boolean, _n long, interval_ms double, _payload string, _nibble int, _counter_before int, _run_length long, _gap_us long, _repeats long, _source int, _sources long, _intervals array<double>, _payloads array<string>, _backs array<long>"


#: Payloads of an id in one value of the state store at most, on average.
BUCKET = 256
_SEEN = pa.schema([("payload", pa.string()), ("ts_us", pa.int64()), ("repeats", pa.int64())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SEEN) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(value))).read_all()


def use_state_store(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; sets it for this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class IdState(StatefulProcessor):
    """State of one (bus, can_id): scalars of the last frame, the tail that rules look back on, and for each payload its last time and number of repeats.

    Payloads lie in buckets by hash, one value of the store each, so that a batch asks for
    buckets and not for payloads; their number doubles as payloads come.

    ``counts``: distinct frame limits, whose frame times ``_backs`` gives. ``history``:
    intervals and payloads kept (0: none). ``replay``: whether repeats are wanted at all. ``memory_us``: a payload not seen for longer
    is new again (None: never), by the frames' own times; ``rules.add_state`` does the
    same with the same value. Sources never expire. Frames that are in one batch are
    taken in order of time; those later than the watermark are dropped before.
    """

    def __init__(self, counts: list[int], history: int, replay: bool, memory_us: int | None):
        self.counts, self.history, self.replay, self.memory = counts, history, replay, memory_us
        self.most = max(counts, default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "n long, ts_us long, payload string, run long, counter int, sources array<int>")
        self.tail = handle.getValueState("tail", "intervals array<double>, payloads array<string>, times array<long>")
        self.size = handle.getValueState("size", "payloads long, depth int")
        self.seen = handle.getMapState("seen", "bucket long", "payloads binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"], kind="stable", ignore_index=True)
        n, last_t, last_p, run, counter, sources = self.last.get() or (0, None, None, 0, 0, [])
        t = batch["ts_us"].to_numpy(np.int64)
        p = batch["payload"].astype(object).where(batch["payload"].notna(), None).to_numpy()
        size, index = len(t), np.arange(len(t))
        before = np.concatenate([[np.nan if last_t is None else last_t], t[:-1]])
        interval = (t - before) / 1000

        same = np.array([a is not None and a == b for a, b in zip(p, [last_p, *p[:-1]])])
        start = np.maximum.accumulate(np.where(same, -1, index))
        length = np.where(start < 0, index + 1 + run, index - start + 1)

        nibble = batch["nibble"].astype("Int64")
        carried = pd.concat([pd.Series([counter], dtype="Int64"), nibble], ignore_index=True).ffill()
        source = batch["source"].astype("Int64")
        fresh = source.notna() & ~source.isin(list(sources)) & ~source.duplicated()
        gaps, repeats = self._repeats(t, p) if self.replay else ([None] * size, [None] * size)
        backs, intervals, payloads = self._tail(t, p, interval)

        out = batch.assign(
            _payload=p, _n=n + 1 + index, interval_ms=interval, _nibble=nibble, _counter_before=carried[:-1].to_numpy(), _run_length=length, _gap_us=gaps, _repeats=repeats,
            _source=source, _sources=len(sources) + fresh.cumsum().to_numpy(), _intervals=intervals, _payloads=payloads, _backs=backs,
        )
        self.last.update((int(n + size), int(t[-1]), p[-1], int(length[-1]), int(carried.iloc[-1]), [*sources, *(int(v) for v in source[fresh])]))
        if self.replay and self.memory is not None:
            self._wake(int(t[-1]))
        yield out[[c.split()[0] for c in ENRICHED.split(", ")]]

    def _repeats(self, t: np.ndarray, p: np.ndarray) -> tuple[pd.Series, np.ndarray]:
        """Of each frame, the time since its payload came last and how often it has come before; the payloads' state moves on."""
        codes, values = pd.factorize(p, use_na_sentinel=False)
        values = pa.array([None if v is None or v != v else v for v in values], pa.string())
        buckets, held = self._held(values)
        at = pc.index_in(values, value_set=held.column("payload").combine_chunks())
        was = at.is_valid().to_numpy(zero_copy_only=False)
        row = at.fill_null(0).to_numpy()
        was_t, was_n = (held.column(c).to_numpy()[row] if len(held) else np.zeros(len(values), np.int64) for c in ("ts_us", "repeats"))

        order = np.argsort(codes, kind="stable")
        code, time = codes[order], t[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])
        earlier = np.concatenate([[0], time[:-1]])
        old = was[code]
        earlier[first] = was_t[code[first]]
        has = ~first | old
        gap = time - earlier
        if self.memory is not None:
            has &= gap <= self.memory
        begins = first | ~has
        place = np.arange(len(code)) - np.maximum.accumulate(np.where(begins, np.arange(len(code)), 0))
        base = np.where(was, was_n + 1, 0)[code]
        start = np.maximum.accumulate(np.where(begins, np.arange(len(code)), 0))
        repeats = place + np.where(first[start] & has[start], base, 0)

        final = np.append(np.flatnonzero(first)[1:], len(code)) - 1
        others = np.ones(len(held), bool)
        others[row[was]] = False
        moved = pa.Table.from_arrays([values, pa.array(time[final]), pa.array(repeats[final])], schema=_SEEN)
        self._hold(buckets, pa.concat_tables([held.filter(pa.array(others)), moved]), int((~was).sum()))

        gaps, counts = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        there = np.empty(len(t), bool)
        gaps[order], counts[order], there[order] = gap, repeats, has
        return pd.Series(gaps).astype("Int64").where(there), counts

    def _bucket_of(self, payloads: pa.Array | pa.ChunkedArray, depth: int) -> np.ndarray:
        hashed = pd.util.hash_array(np.array(payloads.to_pylist(), object), categorize=False)
        return (hashed & np.uint64((1 << depth) - 1)).astype(np.int64)

    def _held(self, values: pa.Array) -> tuple[np.ndarray, pa.Table]:
        """The buckets that some payloads lie in, and what these hold; all of them where there are to be more."""
        total, depth = self.size.get() or (0, 0)
        if total + len(values) > BUCKET << depth:
            old = np.arange(1 << depth)
            while total + len(values) > BUCKET << depth:
                depth += 1
            self.size.update((total, depth))
            touched = np.arange(1 << depth)
        else:
            old = touched = np.unique(self._bucket_of(values, depth))
        found = [self.seen.getValue((b,)) for b in old.tolist()] if total else []
        return touched, pa.concat_tables([_SEEN.empty_table(), *(unpacked(v[0]) for v in found if v is not None)])

    def _hold(self, buckets: np.ndarray, payloads: pa.Table, more: int) -> None:
        """Puts all payloads of some buckets back, ``more`` of which are new."""
        total, depth = self.size.get() or (0, 0)
        bucket = self._bucket_of(payloads.column("payload"), depth)
        order = np.argsort(bucket, kind="stable")
        payloads = payloads.take(pa.array(order)).combine_chunks()
        cuts = np.searchsorted(bucket[order], np.append(buckets, buckets[-1] + 1))
        for b, low, high in zip(buckets.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            if high > low:
                self.seen.updateValue((b,), (packed(payloads.slice(low, high - low)),))
        self.size.update((total + more, depth))

    def _tail(self, t: np.ndarray, p: np.ndarray, interval: np.ndarray) -> tuple[list, list, list]:
        old_i, old_p, old_t = (self.counts or self.history) and self.tail.get() or ([], [], [])
        size, none = len(t), [None] * len(t)
        backs, intervals, payloads = none, none, none
        times = [*old_t, *t.tolist()]
        if self.counts:
            at = [len(old_t) + i + 1 for i in range(size)]
            backs = [[times[k - c] if k >= c else None for c in self.counts] for k in at]
        all_i, all_p = [*old_i], [*old_p]
        if self.history:
            n = self.history
            intervals, payloads = [], []
            for v, x in zip(interval.tolist(), p):
                if v == v:
                    all_i.append(v)
                if x is not None:
                    all_p.append(x)
                intervals.append(all_i[-n:])
                payloads.append(all_p[-n:])
            all_i, all_p = all_i[-n:], all_p[-n:]
        if self.counts or self.history:
            self.tail.update((all_i, all_p, times[-self.most :] if self.most else []))
        return backs, intervals, payloads

    def _wake(self, t: int) -> None:
        """A timer for the next end of a span of ``memory_us`` that leaves ``t`` two such spans behind; the same for all frames of a span."""
        self.handle.registerTimer((t // self.memory + 3) * self.memory // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Payloads go when event time has left them behind by twice ``memory_us``: no frame that still comes can tell."""
        old = expiredTimerInfo.getExpiryTimeInMs() * 1000 - 2 * self.memory
        gone = 0
        for k, v in list(self.seen.iterator()):
            payloads = unpacked(v[0])
            left = payloads.filter(pc.greater_equal(payloads.column("ts_us"), old))
            if len(left) < len(payloads):
                gone += len(payloads) - len(left)
                if len(left):
                    self.seen.updateValue(k, (packed(left),))
                else:
                    self.seen.removeKey(k)
        if gone:
            total, depth = self.size.get()
            self.size.update((total - gone, depth))
        return iter(())

    def close(self) -> None:
        pass
