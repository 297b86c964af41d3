"""Operators over streams whose state lives with its key and goes when the key is idle.

Each is a stateful processor: Spark keeps a key's state variables in its state store, reads and
writes those of keys that a micro-batch touches and no others, and calls back when event
time passes a timer. Rows of one key and micro-batch meet in one task, so a trigger's size bounds
that; a batch whose hot key is too large for it goes through flows.carried, which cuts keys into
blocks of time.

State is dropped where that changes no result: a thinned key after its interval, a slot
that is flat. Gaps alone forget by a stated rule, `idle`. Streams need a watermark; rows behind it
are dropped by Spark (flows.late_step marks them instead).
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from ..operators import ledger as L

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NS_IN_MS = 1_000_000


def stateful(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: StructType | str, at: str = "") -> DataFrame:
    """rows through a processor by key. at: a stamp of its output that operators after it may go by."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime", eventTimeColumnName=at)


def nanos(stamps: pd.Series) -> np.ndarray:
    return stamps.to_numpy("datetime64[ns]").astype(np.int64)


def millis_after(ns: int) -> int:
    """The first whole millisecond at or after a stamp; timers count in those."""
    return -(-int(ns) // NS_IN_MS)


class Timed(StatefulProcessor):
    """What processors with one pending timer a key share: it is replaced, never added to."""

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def set_timer(self, at: int | None) -> None:
        old = self.due.get()
        if old is not None and old[0] == at:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def close(self) -> None:
        pass


class Gaps(Timed):
    """Marks rows whose number does not follow their key's last; a key without rows for `idle` milliseconds of event time is forgotten."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], number: str, at: str, idle: int):
        self.keys, self.order, self.number, self.at, self.idle = list(keys), list(order), number, at, idle

    def open(self, handle) -> None:
        self.last = handle.getValueState("last", "number bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(self.order, kind="stable")
        state = self.last.get()
        number = batch[self.number].to_numpy(np.int64)
        before = np.concatenate([[state[0] if state is not None else number[0] - 1], number[:-1]])
        seen = max(int(nanos(batch[self.at]).max()), state[1] if state is not None else 0)
        self.last.update((int(number[-1]), seen))
        self.set_timer(millis_after(seen) + self.idle)
        yield batch.assign(gap=number != before + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.due.clear()
        return iter([])


def gaps(stream: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, at: str, idle: int) -> DataFrame:
    """Adds gap: whether a row's number does not follow the one before of its key. A key's first row, or its first after `idle` milliseconds
    without one as of the watermark, has none. Batches bring a key's numbers in order."""
    return stateful(stream, keys, Gaps(keys, order, number, at, idle), StructType([*stream.schema, *StructType.fromDDL("gap boolean")]))


#: Groups that keys are dealt into where a key's own rows are few: a call into Python and its exchange with the store is paid a group and not a key.
BUCKETS = 256


class Thinned(Timed):
    """For each key of a group, keeps a row once `interval` passed since the last kept one; after that stretch the key needs no state."""

    def __init__(self, interval: int, at: str, columns: Sequence[str]):
        self.interval, self.at, self.columns = interval, at, list(columns)

    def open(self, handle) -> None:
        self.last = handle.getListState("last", "name string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, last, keep = pd.concat(rows), dict(self.last.get()), []
        codes, names = pd.factorize(batch["key__"])
        stamps = nanos(batch[self.at])
        order = np.lexsort((stamps, codes))
        edge = np.searchsorted(codes[order], np.arange(len(names) + 1)).tolist()
        stamps = stamps[order].tolist()
        for name, at, stop in zip(names, edge, edge[1:]):
            kept = last.get(name)
            while at < stop:
                # The next row that is far enough is found by halving, so dense stretches cost one step each.
                at = at if kept is None else bisect_left(stamps, kept + self.interval, at, stop)
                if at < stop:
                    kept = stamps[at]
                    keep.append(at)
                    at += 1
            last[name] = kept
        # What the watermark has passed can hold back no later row.
        passed = timerValues.getCurrentWatermarkInMs()
        left = [(name, kept) for name, kept in last.items() if millis_after(kept + self.interval) > passed]
        if left:
            self.last.put(left)
        else:
            self.last.clear()
        self.set_timer(millis_after(max(kept for _, kept in left) + self.interval) if left else None)
        yield batch[self.columns].iloc[order[keep]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.due.clear()
        return iter([])


def thinned(stream: DataFrame, interval: int, keys: Sequence[str], at: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows at least `interval` microseconds after the last kept one of their key, in order of at. Batches bring a key's rows in order.
    State is kept by groups of keys, `buckets` in all."""
    # As JSON a key of any columns is one text, nulls too.
    dealt = stream.withColumns({"key__": F.to_json(F.struct(*keys)), "bucket__": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    return stateful(dealt, ["bucket__"], Thinned(interval * 1000, at, stream.columns), stream.schema)


class Positions(StatefulProcessor):
    """An account's cash and what it holds; slots that are flat are not kept."""

    def init(self, handle) -> None:
        self.cash = handle.getValueState("cash", "amount double")
        self.held = handle.getMapState("held", "instrument string", "position double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t", "seq"], kind="stable")
        # An instrument that is null is one of its own, under a name no instrument has.
        slot = batch["instrument"].map(lambda x: "\0" if x is None else x)
        cash = self.cash.get()
        dq = np.where(batch["side"] == "buy", batch["qty"], -batch["qty"])
        batch = batch.assign(cash=(cash[0] if cash is not None else 0.0) + np.cumsum(-(dq * batch["price"] + batch["fee"])), position=pd.Series(dq, batch.index).groupby(slot).cumsum())
        for name, last in batch.groupby(slot)["position"].last().items():
            before = self.held.getValue((name,)) if self.held.containsKey((name,)) else None
            if before is not None:
                batch.loc[slot == name, "position"] += before[0]
            total = float(last) + (before[0] if before is not None else 0.0)
            if total:
                self.held.updateValue((name,), (total,))
            elif before is not None:
                self.held.removeKey((name,))
        self.cash.update((float(batch["cash"].iloc[-1]),))
        yield batch[["account", "instrument", "t", "seq", "position", "cash"]]

    def close(self) -> None:
        pass


def positions(fills: DataFrame) -> DataFrame:
    """(account, instrument, t, seq, position, cash) of fills, as of each; see Positions. Batches bring an account's fills in order."""
    return stateful(fills, ["account"], Positions(), StructType([*[fills.schema[c] for c in ("account", "instrument", "t", "seq")], *StructType.fromDDL("position double, cash double")]))


EVENTS = "instrument string, t timestamp, kind string, account string, dq double, dc double, price double"


def book_events(fills: DataFrame | None = None, marks: DataFrame | None = None, prints: DataFrame | None = None) -> list[DataFrame]:
    """Fills, mark bars and funding prints in the one form that equity reads."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    out = []
    if fills is not None:
        fee = F.col("fee") if "fee" in fills.columns else F.lit(0.0)
        out.append(fills.select("instrument", F.col("t").cast("timestamp").alias("t"), F.lit("fill").alias("kind"), "account", L.signed().alias("dq"),
                                (-(L.signed() * F.col("price") + fee)).alias("dc"), number.alias("price")))
    for rows, kind, value in ((marks, "mark", "price"), (prints, "print", "rate")):
        if rows is not None:
            out.append(rows.select("instrument", F.col("t").cast("timestamp").alias("t"), F.lit(kind).alias("kind"), text.alias("account"), number.alias("dq"), number.alias("dc"), F.col(value).alias("price")))
    return out


def netted(events: DataFrame) -> DataFrame:
    """A watermarked stream of book_events with one row for all of an instrument's, stamp's, kind's and account's: sums of fills and rates, the largest mark.
    Spark adds them up before it shuffles them, so equity after it waits on stamps and not on fills."""
    price = F.when(F.col("kind") == "mark", F.max("price")).otherwise(F.sum(F.coalesce("price", F.lit(0.0))))
    made = events.groupBy("instrument", "t", "kind", "account").agg(F.sum("dq").alias("dq"), F.sum("dc").alias("dc"), price.alias("price"))
    return made.select("instrument", "t", "kind", "account", "dq", "dc", "price")


class Waiting(Timed):
    """Rows wait until the watermark has passed them, so they are worked on in order of their stamps, whatever order they came in."""

    SCHEMA = ""
    COLUMNS: tuple[str, ...] = ()

    def open(self, handle) -> None:
        self.rows = handle.getListState("waiting", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        batch = batch.assign(t=nanos(batch["t"]))[list(self.COLUMNS)].astype(object)
        values = list(batch.where(batch.notna(), None).itertuples(index=False, name=None))
        self.rows.appendList(values)
        first, old = millis_after(min(v[0] for v in values)), self.due.get()
        self.set_timer(first if old is None else min(first, old[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * NS_IN_MS
        rows = sorted(self.rows.get(), key=lambda r: r[0])
        ready = [r for r in rows if r[0] <= reached]
        rest = rows[len(ready):]
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        self.due.clear()
        self.set_timer(millis_after(rest[0][0]) if rest else None)
        if ready:
            yield from self.work(key, pd.DataFrame(ready, columns=list(self.COLUMNS)))

    def work(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


class Holders(Waiting):
    """One instrument: its mark and who holds how much of it. What each stamp does to an account's cash and marked value.

    At a stamp fills come first, then funding prints at the mark before the stamp, then the mark bar.
    A mark or print concerns the accounts whose position is not flat then; flat ones are not kept.
    """

    SCHEMA = "t bigint, kind string, account string, dq double, dc double, price double"
    COLUMNS = ("t", "kind", "account", "dq", "dc", "price")

    def open(self, handle) -> None:
        super().open(handle)
        self.mark = handle.getValueState("mark", "price double")
        self.held = handle.getMapState("held", "account string", "position double")

    def work(self, key, rows):
        state = self.mark.get()
        mark = state[0] if state is not None else None
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        stored = dict(held)
        out: list[tuple] = []
        for t, now in rows.groupby("t", sort=True):
            fills, prints, news = (now[now["kind"] == k] for k in ("fill", "print", "mark"))
            price = news["price"].max() if len(news) else None
            price = mark if price is None or pd.isna(price) else float(price)
            old, new = mark or 0.0, price or 0.0
            was, paid = dict(held), {}
            for account, own in fills.groupby("account"):
                total = held.get(account, 0.0) + float(own["dq"].sum())
                paid[account] = float(own["dc"].sum())
                if total:
                    held[account] = total
                else:
                    held.pop(account, None)
            rate = float(prints["price"].fillna(0).sum())
            for account in (dict.fromkeys([*held, *paid]) if len(prints) or len(news) else paid):
                now_held = held.get(account, 0.0)
                out.append((account, t, paid.get(account, 0.0) - now_held * old * rate, now_held * new - was.get(account, 0.0) * old))
            mark = price
        for account in stored.keys() - held.keys():
            self.held.removeKey((account,))
        for account, position in held.items():
            if stored.get(account) != position:
                self.held.updateValue((account,), (position,))
        if mark is not None:
            self.mark.update((float(mark),))
        if out:
            made = pd.DataFrame(out, columns=["account", "t", "dc", "dv"])
            yield made.assign(t=pd.to_datetime(made["t"]))


class Accounts(Waiting):
    """One account: changes of all its instruments, added up stamp by stamp."""

    SCHEMA = "t bigint, dc double, dv double"
    COLUMNS = ("t", "dc", "dv")

    def open(self, handle) -> None:
        super().open(handle)
        self.total = handle.getValueState("total", "cash double, value double")

    def work(self, key, rows):
        state = self.total.get()
        cash, value = state if state is not None else (0.0, 0.0)
        sums = rows.astype({"dc": float, "dv": float}).groupby("t", sort=True)[["dc", "dv"]].sum().cumsum()
        sums = sums.assign(cash=sums["dc"] + cash, value=sums["dv"] + value)
        self.total.update((float(sums["cash"].iloc[-1]), float(sums["value"].iloc[-1])))
        yield pd.DataFrame({"account": key[0], "t": pd.to_datetime(sums.index), "cash": sums["cash"].to_numpy(), "value": sums["value"].to_numpy(), "equity": (sums["cash"] + sums["value"]).to_numpy()})


def equity(events: DataFrame) -> DataFrame:
    """(account, t, cash, value, equity) of a watermarked stream of book_events, final once the watermark has passed t.

    A row for every stamp at which an account trades or something it holds is marked or settles. Marks
    that come late, but not behind the watermark, count where they belong.
    """
    moved = stateful(events, ["instrument"], Holders(), "account string, t timestamp, dc double, dv double", at="t")
    return stateful(moved, ["account"], Accounts(), "account string, t timestamp, cash double, value double, equity double")
