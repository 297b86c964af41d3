"""Portfolio accounting as running values over fills, marks and funding tables.

fills: (account, instrument, t, seq, side, qty, price[, fee]); marks:
(instrument, t, price, kind); funding: (instrument, t, rate). A busy account or
instrument is cut into blocks of time (operators.ordered), never sorted whole.
"""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DAY, clip, micros
from ..session import settle
from .asof import asof_join
from .ordered import last_seen, previous, running, scan
from .spans import during, until_next

SLOT = ["account", "instrument"]
# Kinds that set the position mark, in the order they count; only mark bars set the funding mark.
MARK_KINDS = ("trade", "kline", "mark_kline")
TAKER_FEE_RATE = 0.0004


def signed(qty: str = "qty") -> Column:
    return F.when(F.col("side") == "buy", F.col(qty)).otherwise(-F.col(qty))


def _block(df: DataFrame, at: str, width: int) -> Column:
    return F.floor(micros(df, at) / F.lit(width))


def positions(fills: DataFrame, order: Sequence[str] = ("t", "seq"), block: int = 32 * DAY) -> DataFrame:
    """Adds position, the running signed quantity per (account, instrument)."""
    return running(fills, SLOT, list(order), _block(fills, "t", block), sums={"position": signed()})


def cash_and_fees(fills: DataFrame, order: Sequence[str] = ("t", "seq"), block: int = 32 * DAY) -> DataFrame:
    """Adds fees, the running fees per (account, instrument), and cash, the account's running cash."""
    f = running(fills, SLOT, list(order), _block(fills, "t", block), sums={"fees": F.col("fee")})
    paid = -(signed() * F.col("price") + F.col("fee"))
    return running(f, ["account"], list(order), _block(f, "t", block), sums={"cash": paid})


def marks_from_events(events: DataFrame) -> DataFrame:
    """(instrument, t, seq, mark, funding_mark) from events of every kind; kinds that carry no mark are left out."""
    e = events.filter(F.col("kind").isin(*MARK_KINDS))
    return e.select("instrument", "t", "seq", F.col("price").alias("mark"),
                    F.when(F.col("kind") == "mark_kline", F.col("price")).alias("funding_mark"))


def current_marks(events: DataFrame, block: int = DAY) -> DataFrame:
    """Every event with the mark and funding mark in force after it, in (t, bars last, seq) order."""
    is_bar = F.col("kind").isin("kline", "mark_kline").cast("int")
    e = events.withColumn("__bar", is_bar)
    mark = F.when(F.col("kind").isin(*MARK_KINDS), F.col("price"))
    fmark = F.when(F.col("kind") == "mark_kline", F.col("price"))
    return last_seen(e, ["instrument"], ["t", "__bar", "seq"], _block(e, "t", block),
                     {"mark": mark, "funding_mark": fmark}).drop("__bar")


def _flows(fills: DataFrame) -> DataFrame:
    """(account, instrument, t, dq, dc): what a slot's fills of one stamp do to its position and its account's cash."""
    fee = F.col("fee") if "fee" in fills.columns else F.lit(0.0)
    return fills.groupBy(*SLOT, "t").agg(F.sum(signed()).alias("dq"), F.sum(-(signed() * F.col("price") + fee)).alias("dc"))


def holdings(flows: DataFrame, block: int = 32 * DAY) -> DataFrame:
    """(account, instrument, since, until, position) while a slot is not flat, from _flows: fills of since included, until the next ones."""
    held = running(flows, SLOT, ["t"], _block(flows, "t", block), sums={"position": F.col("dq")})
    held = until_next(held, SLOT, "t", block)
    return held.filter(F.col("position") != 0).select(*SLOT, F.col("t").alias("since"), "until", "position")


def _news(marks: DataFrame, funding: DataFrame | None, block: int) -> DataFrame:
    """(instrument, t, price, rate, was), settled: each mark bar with the one before it, and each funding print with the bar before it."""
    bars = marks.filter(F.col("kind") == "mark_kline").groupBy("instrument", "t").agg(F.max("price").alias("price"), F.lit(None).cast("double").alias("rate"))
    if funding is None:
        rows = bars
    else:
        rows = bars.unionByName(funding.groupBy("instrument", "t").agg(F.sum("rate").alias("rate")), allowMissingColumns=True)
    # At one stamp prints come before bars.
    order = ["t", F.col("price").isNotNull()]
    return settle(scan(settle(rows), ["instrument"], order, _block(rows, "t", block), lasts={"upto": F.col("price")}, before={"was": "upto"}).drop("upto"))


def funding_flows(fills: DataFrame, marks: DataFrame, funding: DataFrame, block: int = 32 * DAY) -> DataFrame:
    """(account, instrument, t, rate, position, mark, flow, paid, received) per funding print and holder.

    A print settles on the position, fills of its own stamp included, at the
    mark bar before it: at one stamp bars come last. No mark yet means no flow.
    Slots that are flat at a print have no row.
    """
    prints = _news(marks, funding, block).filter(F.col("rate").isNotNull())
    due = during(holdings(settle(_flows(fills)), block), prints, ["instrument"], "t", width=block)
    due = due.withColumn("flow", F.coalesce(F.col("position") * F.col("was") * F.col("rate"), F.lit(0.0)))
    return (due.select(*SLOT, "t", "rate", "position", F.col("was").alias("mark"), "flow")
            .withColumn("paid", F.greatest("flow", F.lit(0.0))).withColumn("received", F.greatest(-F.col("flow"), F.lit(0.0))))


def equity(fills: DataFrame, marks: DataFrame, funding: DataFrame | None = None, block: int = 32 * DAY) -> DataFrame:
    """(account, t, cash, value, equity) at every stamp an account trades or an instrument it holds then is marked or settles.

    A stamp changes an account's value by what its fills bring at the mark of the stamp, and by what
    the stamp's mark bar does to the position before it. Marks and prints meet the spans in which a
    slot is held, add up by account and stamp where they meet, and one running sum
    per account does the rest.
    """
    none = F.lit(0.0)
    flows, news = settle(_flows(fills)), _news(marks, funding, block)
    traded = asof_join(flows, news.filter(F.col("price").isNotNull()), ["instrument"], "t", "t", {"mark": "price"}, block=block)
    moves = traded.select("account", "t", (F.col("dq") * F.coalesce("mark", none)).alias("dv"), "dc")
    # A print sees the fills of its own stamp, a bar moves what was held before.
    held = during(holdings(flows, block), news, ["instrument"], "t", opening=F.col("rate").isNotNull(), width=block)
    paid = F.coalesce(F.col("position") * F.col("was") * F.col("rate"), none)
    moved = F.coalesce(F.col("position") * (F.col("price") - F.coalesce("was", none)), none)
    moves = moves.unionByName(held.select("account", "t", moved.alias("dv"), (-paid).alias("dc")))
    change = settle(moves.groupBy("account", "t").agg(F.sum("dv").alias("dv"), F.sum("dc").alias("dc")))
    out = running(change, ["account"], ["t"], _block(change, "t", block), sums={"cash": F.col("dc"), "value": F.col("dv")})
    return out.select("account", "t", "cash", "value", (F.col("cash") + F.col("value")).alias("equity"))


def instrument_report(fills: DataFrame, marks: DataFrame, funding: DataFrame | None = None) -> DataFrame:
    """(account, instrument, position, mark, basis, fees, funding_paid, funding_received), as of the last event."""
    fee = F.col("fee") if "fee" in fills.columns else F.lit(0.0)
    pos = fills.groupBy(*SLOT).agg(F.sum(signed()).alias("position"), F.sum(fee).alias("fees"))
    last = marks.groupBy("instrument").agg(F.max_by("price", "t").alias("mark"))
    out = pos.join(last, "instrument", "left").withColumn("basis", F.coalesce(F.col("position") * F.col("mark"), F.lit(0.0)))
    if funding is not None:
        f = funding_flows(fills, marks, funding).groupBy(*SLOT).agg(F.sum("paid").alias("funding_paid"), F.sum("received").alias("funding_received"))
        out = out.join(f, SLOT, "left")
        for c in ("funding_paid", "funding_received"):
            out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out.select(*SLOT, *[c for c in out.columns if c not in SLOT])


def price_with_costs(orders: DataFrame, prices: DataFrame, cost_rows: DataFrame, block: int = 32 * DAY) -> DataFrame:
    """Orders filled against the last price and the cost row in force: reason, ref, bps, fill and fee.

    orders: (order_id, symbol, t, side, qty); prices: (symbol, t, price);
    cost_rows: (symbol, week_start, half_spread_bps, impact_bps_per_unit,
    taker_fee_bps). No price yet or no cost row yet rejects the order.
    """
    o = asof_join(orders, prices, ["symbol"], "t", "t", {"ref": "price"}, block=block)
    o = asof_join(o, cost_rows, ["symbol"], "t", "week_start",
                  {c: c for c in ("half_spread_bps", "impact_bps_per_unit", "taker_fee_bps")}, block=block)
    reason = F.when(F.col("ref").isNull(), "NoPriceAvailable").when(F.col("half_spread_bps").isNull(), "NoCostAvailable")
    bps = F.col("half_spread_bps") + F.col("impact_bps_per_unit") * F.col("qty")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    ok = F.col("reason").isNull()
    o = o.withColumn("reason", reason).withColumn("bps", F.when(ok, bps))
    o = o.withColumn("fill", F.when(ok, F.col("ref") * (1 + sign * F.col("bps") / 1e4)))
    return o.withColumn("fee", F.when(ok, F.col("fill") * F.col("qty") * F.col("taker_fee_bps") / 1e4)).drop(
        "half_spread_bps", "impact_bps_per_unit", "taker_fee_bps")


def price_at_last(orders: DataFrame, prices: DataFrame, fee_rate: float = TAKER_FEE_RATE, block: int = 32 * DAY) -> DataFrame:
    """Orders filled at the last price; none yet rejects the order."""
    o = asof_join(orders, prices, ["symbol"], "t", "t", {"fill": "price"}, block=block)
    return (o.withColumn("reason", F.when(F.col("fill").isNull(), "NoPriceAvailable"))
            .withColumn("fee", F.col("fill") * F.col("qty") * F.lit(fee_rate)))


def sized_orders(targets: DataFrame, max_qty: float, order: Sequence[str] = ("t", "seq"), block: int = 32 * DAY, breaches: DataFrame | None = None) -> DataFrame:
    """Targets (account, instrument, t, seq, target) to orders: clamped target, delta to the clamped target before, side, outcome.

    Assumes orders fill, so the position is the clamped target before. After its account's breach_t in breaches, as from drawdown_breach, a
    target is Rejected and has no order.
    """
    t = targets.withColumn("clamped", clip("target", -max_qty, max_qty))
    t = previous(t, SLOT, list(order), _block(t, "t", block), {"__was": F.col("clamped")})
    t = t.withColumn("delta", F.col("clamped") - F.coalesce("__was", F.lit(0.0))).drop("__was")
    outcome = F.when(F.col("clamped") == F.col("target"), "Approved").otherwise("Resized")
    if breaches is not None:
        b = breaches.select(F.col("account").alias("__account"), "breach_t")
        t = t.join(b, F.col("account").eqNullSafe(F.col("__account")), "left").withColumn("__out", F.coalesce(F.col("t") > F.col("breach_t"), F.lit(False)))
        t = t.withColumn("delta", F.when(~F.col("__out"), F.col("delta")))
        outcome = F.when(F.col("__out"), "Rejected").otherwise(outcome)
    return (t.withColumn("side", F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell"))
            .withColumn("qty", F.abs("delta")).withColumn("outcome", outcome).drop("__account", "__out", "breach_t"))


def carry_targets(prints: DataFrame, entry: float, exit_: float, qty: float, block: int = 32 * DAY) -> DataFrame:
    """Funding carry with hysteresis: (symbol, t, rate, market, target), spot long and futures short while on.

    On from a rate of at least entry until one of at most exit; between, the
    last decision holds, flat at first.
    """
    want = F.when(F.col("funding_rate") >= entry, F.lit(qty)).when(F.col("funding_rate") <= exit_, F.lit(0.0))
    p = last_seen(prints, ["symbol"], ["t"], _block(prints, "t", block), {"held": want})
    p = p.withColumn("held", F.coalesce("held", F.lit(0.0)))
    legs = F.array(F.struct(F.lit("spot").alias("market"), F.col("held").alias("target")),
                   F.struct(F.lit("futures").alias("market"), (-F.col("held")).alias("target")))
    return p.select("symbol", "t", F.col("funding_rate").alias("rate"), F.explode(legs).alias("l")).select("symbol", "t", "rate", "l.*")


def drawdown_breach(eq: DataFrame, max_drawdown: float, block: int = 32 * DAY) -> DataFrame:
    """(account, breach_t, breach_fall): the first stamp whose equity is max_drawdown or more below its peak, 0 at the start."""
    p = running(eq, ["account"], ["t"], _block(eq, "t", block), maxes={"__peak": F.col("equity")})
    fall = F.greatest(F.col("__peak"), F.lit(0.0)) - F.col("equity")
    b = p.withColumn("__fall", fall).filter(F.col("__fall") >= max_drawdown)
    return b.groupBy("account").agg(F.min("t").alias("breach_t"), F.min_by("__fall", "t").alias("breach_fall"))


def flatten_list(fills: DataFrame, breaches: DataFrame) -> DataFrame:
    """(account, instrument, breach_t, position): what an account held when it breached."""
    j = fills.join(breaches.select("account", "breach_t"), "account").filter(F.col("t") <= F.col("breach_t"))
    return j.groupBy(*SLOT, "breach_t").agg(F.sum(signed()).alias("position")).filter(F.col("position") != 0)


def thin(series: DataFrame, interval: int, keys: Sequence[str] = ("account",), at: str = "t") -> DataFrame:
    """Keeps a point only if interval microseconds passed since the last kept one per key.

    A gap of at least the interval always starts afresh, so keys are cut there
    into runs that spread over tasks. The greedy pass then streams sorted
    batches with one number of state. The series is read several times: store an
    expensive one first (session.settle).
    """
    keys = list(keys)
    s = series.withColumn("__t", micros(series, at))
    where = F.floor(F.col("__t") / F.lit(max(interval, 1) * 4096))
    s = previous(s, keys, ["__t"], where, {"__was": F.col("__t")})
    fresh = (F.col("__was").isNull() | (F.col("__t") - F.col("__was") >= interval)).cast("bigint")
    s = running(s, keys, ["__t"], where, sums={"__run": fresh})
    part = [*keys, "__run"]
    s = s.repartition(*part).sortWithinPartitions(*part, "__t")

    def greedy(batches):
        key, last = None, None
        for b in batches:
            keep = []
            for pos, row in enumerate(zip(*[b[c] for c in part], b["__t"])):
                k, t = row[:-1], row[-1]
                if k != key or t - last >= interval:
                    key, last = k, t
                    keep.append(pos)
            yield b.iloc[keep]

    return s.mapInPandas(greedy, s.schema).select(*series.columns)
