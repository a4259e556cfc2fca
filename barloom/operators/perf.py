"""Performance tables over trades and equity curves."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import cagr, div, ieee_div
from barloom.operators.joins import range_extremes
from barloom.operators.scan import ROWS_BEFORE, ROWS_TO_HERE, day_of, prefix, with_ordinal

INF = float("inf")
POINT_VALUE = 20.0
YEAR = 252.0


def trade_summary(trades: DataFrame, by: Sequence[str], net: str = "net_pnl_dollars") -> DataFrame:
    """Core statistics per group in one aggregation; exact zeros count as neither win nor loss."""
    n, p = F.count(F.lit(1)), F.col(net)
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    agg = trades.groupBy(*by).agg(
        n.alias("n_trades"), F.count(win).alias("n_win"), F.avg(win).alias("__aw"), F.avg(loss).alias("__al"), F.avg(p).alias("avg_trade"),
        F.sum(win).alias("__sw"), F.sum(loss).alias("__sl"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"), F.sum(p).alias("net_pnl"),
        F.sum("commission_paid").alias("commission"), F.sum("slippage_paid").alias("slippage"),
        F.avg(F.unix_timestamp(F.col("exit_ts").cast("timestamp")) - F.unix_timestamp(F.col("entry_ts").cast("timestamp"))).alias("avg_seconds"))
    zero = F.lit(0.0)
    aw, al = F.coalesce("__aw", zero), F.coalesce("__al", zero)
    ratio = lambda a, b: F.coalesce(div(a, b), F.lit(INF))
    return agg.withColumns({
        "win_rate": F.col("n_win") / F.col("n_trades"), "avg_win": aw, "avg_loss": al, "payoff": ratio(aw, F.abs(al)),
        "profit_factor": ratio(F.coalesce("__sw", zero), F.abs(F.coalesce("__sl", zero))), "expectancy_r": ratio(F.col("avg_trade"), F.abs(al)),
    }).drop("__aw", "__al", "__sw", "__sl")


def breakdown(trades: DataFrame, by: Sequence[Column | str], net: str = "net_pnl_dollars") -> DataFrame:
    """Count, win rate, mean and total per exit reason, hour or any other label."""
    p = F.col(net)
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((p > 0).cast("double")).alias("win_rate"),
                                   F.avg(p).alias("avg_pnl"), F.sum(p).alias("total_pnl"))


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], net: str, capital: float, block: Column | None = None) -> DataFrame:
    """Equity, running peak and drawdown after every trade, by blocked scan."""
    part = [*keys, "__blk"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*ROWS_TO_HERE)
    d = trades.withColumn("__blk", day_of(order[0]) if block is None else block).withColumn("__eq", F.sum(net).over(w))
    d = d.withColumn("__top", F.max("__eq").over(w))
    over_blocks = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(*ROWS_BEFORE)
    blocks = d.groupBy(*part).agg(F.sum(net).alias("__t"), F.max("__eq").alias("__m"))
    blocks = blocks.withColumn("__c", F.coalesce(F.sum("__t").over(over_blocks), F.lit(0.0)))
    blocks = blocks.withColumn("__p", F.max(F.col("__c") + F.col("__m")).over(over_blocks)).select(*part, "__c", "__p")
    d = d.join(blocks, part, "left").withColumn("equity", capital + F.col("__c") + F.col("__eq"))
    d = d.withColumn("peak", F.greatest(F.lit(float(capital)), capital + F.col("__p"), capital + F.col("__c") + F.col("__top")))
    dd = F.col("equity") - F.col("peak")
    return d.withColumns({"dd": dd, "dd_pct": dd / F.when(F.col("peak") == 0, 1.0).otherwise(F.col("peak"))}).drop("__blk", "__eq", "__top", "__c", "__p")


def in_drawdown() -> Column:
    return F.col("dd") < -1e-9


def drawdown_stats(equity: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, bars_per_day: float = 390.0) -> DataFrame:
    """Deepest and mean drawdown, longest run of rows under the peak."""
    d = prefix(equity, keys, order, {"__run": ("count", F.when(~in_drawdown(), 1))}, block)
    runs = d.groupBy(*keys, "__run").agg(
        F.min("dd").alias("dd"), F.min("dd_pct").alias("dd_pct"), F.sum(F.when(in_drawdown(), F.col("dd_pct"))).alias("__s"),
        F.sum(F.when(in_drawdown(), 1).otherwise(0)).alias("__len"))
    return runs.groupBy(*keys).agg(
        F.min("dd").alias("max_dd"), F.min("dd_pct").alias("max_dd_pct"), F.coalesce(div(F.sum("__s"), F.sum("__len")), F.lit(0.0)).alias("avg_dd_pct"),
        F.max("__len").alias("longest_rows")).withColumn("longest_days", F.col("longest_rows") / bars_per_day)


def streaks(trades: DataFrame, keys: Sequence[str], order: Sequence[str], net: str = "net_pnl_dollars", block: Column | None = None) -> DataFrame:
    """Longest winning and losing runs (zero counts as a loss)."""
    win = F.col(net) > 0
    d = prefix(trades, keys, order, {"__w": ("count", F.when(win, 1)), "__l": ("count", F.when(~win, 1))}, block)
    runs = d.groupBy(*keys, win.alias("__win"), F.when(win, F.col("__l")).otherwise(F.col("__w")).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("__n"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(F.col("__win")).alias("win_streak"), longest(~F.col("__win")).alias("loss_streak"))


def daily_pnl(trades: DataFrame, keys: Sequence[str], exit_ts: str = "exit_ts", net: str = "net_pnl_dollars") -> DataFrame:
    return trades.groupBy(*keys, F.to_date(exit_ts).alias("date")).agg(F.sum(net).alias("pnl"), F.count(F.lit(1)).alias("n"))


def on_calendar(daily: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P&L of days outside the calendar moved to the next calendar day (after its end: to its last), summed per day."""
    days = daily.select("date").union(calendar.select("date")).distinct().join(calendar.select("date", F.lit(True).alias("__open")), "date", "left")
    # A row per calendar date of the whole history: small whatever the number of trades.
    over = Window.orderBy("date")
    mine = F.when(F.col("__open"), F.col("date"))
    to = F.coalesce(F.first(mine, ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing)), F.last(mine, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    moved = days.select("date", to.alias("__to"))
    return daily.join(moved, "date").where("__to is not null").groupBy(*keys, F.col("__to").alias("date")).agg(F.sum("pnl").alias("pnl"))


def risk_ratios(daily: DataFrame, calendar: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Sharpe, Sortino, CAGR from daily P&L over all trading days; days without trades count as 0.

    The zero days enter through the day count instead of being generated.
    """
    days = calendar.agg(F.count(F.lit(1))).scalar()
    neg = F.when(F.col("pnl") < 0, F.col("pnl"))
    g = on_calendar(daily, calendar, keys).groupBy(*keys).agg(F.sum("pnl").alias("__s"), F.sum(F.col("pnl") * F.col("pnl")).alias("__q"), F.count(neg).alias("__nn"), F.stddev_pop(neg).alias("__dn"))
    g = g.withColumn("__nd", days)
    mean = F.col("__s") / F.col("__nd")
    sd = F.sqrt(F.greatest(F.col("__q") / F.col("__nd") - mean * mean, F.lit(0.0)))
    ok = F.col("__nd") >= 2
    root = F.sqrt(F.lit(YEAR))
    return g.withColumns({
        "n_days": F.col("__nd"), "total": F.col("__s"),
        "sharpe": F.when(ok & (sd > 0), mean / F.nullif(sd, F.lit(0.0)) * root).otherwise(0.0),
        "sortino": F.when(ok & (F.col("__nn") >= 2) & (F.col("__dn") > 0), mean / F.nullif("__dn", F.lit(0.0)) * root).otherwise(0.0),
        "cagr": cagr(F.lit(float(capital)) + F.col("__s"), F.lit(float(capital)), F.col("__nd")),
    }).drop("__s", "__q", "__nn", "__dn", "__nd")


def with_calmar(ratios: DataFrame, drawdown: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = ratios.join(drawdown, list(keys))
    return d.withColumn("calmar", F.coalesce(div(F.col("cagr"), F.abs("max_dd_pct")), F.lit(INF)))


def mae_mfe(trades: DataFrame, bars: DataFrame, keys: Sequence[str], ident: str, start: str, end: str) -> DataFrame:
    """Worst and best excursion of each trade as a share of its entry price; of a price of 0 as ``ieee_div`` has it."""
    ext = range_extremes(trades, bars, keys, ident, start, end, "ts")
    e = F.col("entry_price")
    d = trades.join(ext, ident, "left")
    down, up = ieee_div(e - F.col("span_low"), e), ieee_div(F.col("span_high") - e, e)
    long = F.col("direction") == 1
    floor0 = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return d.withColumns({"mae": floor0(F.when(long, down).otherwise(up)), "mfe": floor0(F.when(long, up).otherwise(down))})


def trades_per_day(trades: DataFrame, by: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    """Trades over the calendar span they cover."""
    d = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1), F.datediff(F.to_date(F.max(ts)), F.to_date(F.min(ts))) + 1).alias("days"))
    return d.withColumn("tpd", F.col("n") / F.col("days"))


def buy_hold_fixed(bars: DataFrame, keys: Sequence[str], capital: float, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Equity of one contract bought at the first open and held."""
    first = bars.groupBy(*keys).agg((F.min_by("open", "ts") + slippage).alias("__entry"))
    return bars.join(first, list(keys)).withColumn("equity", capital - commission + (F.col("close") - F.col("__entry")) * POINT_VALUE).drop("__entry")


def buy_hold_compounding(bars: DataFrame, keys: Sequence[str], capital: float, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Buy-and-hold that adds whole contracts when a day's open makes the balance worth more of them.

    With h contracts held, ``capital - commission * h`` buys ``floor(that / (open * POINT_VALUE))``. A day can only add
    contracts if its open is worth more of them without any commission than an earlier day's was with the largest
    possible commission; these few days alone are folded, and each day takes the state of the last one before it.
    """
    keys = list(keys)
    worth = lambda cash: F.greatest(F.lit(0), F.floor(cash / (F.col("day_open") * POINT_VALUE)))
    days = bars.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.min_by("open", "ts").alias("day_open"))
    upper = worth(F.lit(float(capital)))
    most = days.groupBy(*keys).agg(F.max(upper).alias("__most"))
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(*ROWS_BEFORE)
    days = days.join(most, keys).withColumn("__sure", F.max(worth(capital - commission * F.col("__most"))).over(past))
    buys = days.where(upper > F.coalesce("__sure", F.lit(0))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "day_open"))).alias("__days"))
    state = "struct<held:bigint,cost:double,path:array<struct<date:date,held:bigint,cost:double>>>"

    def buy(s: Column, day: Column) -> Column:
        want = F.floor((capital - commission * s["held"]) / (day["day_open"] * POINT_VALUE))
        held = F.greatest(s["held"], want)
        cost = s["cost"] + (day["day_open"] + slippage) * (held - s["held"])
        return F.struct(held.alias("held"), cost.alias("cost"), F.concat(s["path"], F.array(F.struct(day["date"].alias("date"), held.alias("held"), cost.alias("cost")))).alias("path"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0.0).alias("cost"), F.array().cast("array<struct<date:date,held:bigint,cost:double>>").alias("path")).cast(state)
    path = buys.select(*keys, F.explode(F.aggregate("__days", start, buy)["path"]).alias("__s")).select(*keys, "__s.date", F.col("__s.held").alias("__h"), F.col("__s.cost").alias("__c"))
    here = Window.partitionBy(*keys).orderBy("date").rowsBetween(*ROWS_TO_HERE)
    days = days.join(path, [*keys, "date"], "left")
    days = days.select(*keys, "date", *[F.coalesce(F.last(c, ignorenulls=True).over(here), F.lit(0)).alias(c) for c in ("__h", "__c")])
    d = bars.withColumn("date", F.to_date("ts")).join(days, [*keys, "date"])
    return d.withColumn("equity", capital - commission * F.col("__h") + (F.col("close") * F.col("__h") - F.col("__c")) * POINT_VALUE).drop("__h", "__c")


def curve_stats(curve: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """P&L, CAGR, Sharpe and deepest drawdown of a bar-level equity curve (starting at ``capital``)."""
    part = [*keys, "date"]
    w = Window.partitionBy(*part).orderBy("ts").rowsBetween(*ROWS_TO_HERE)
    d = curve.withColumn("date", F.to_date("ts")).withColumn("__top", F.max("equity").over(w))
    days = d.groupBy(*part).agg(F.max_by("equity", "ts").alias("__eod"), F.max("equity").alias("__m"))
    over = Window.partitionBy(*keys).orderBy("date")
    days = days.withColumns({"__p": F.max("__m").over(over.rowsBetween(*ROWS_BEFORE)), "__chg": F.col("__eod") - F.coalesce(F.lag("__eod").over(over), F.lit(float(capital)))})
    peak = F.greatest(F.lit(float(capital)), F.col("__p"), F.col("__top"))
    worst = d.join(days.select(*part, "__p"), part).groupBy(*keys).agg(F.least(F.lit(0.0), F.min((F.col("equity") - peak) / F.nullif(peak, F.lit(0.0)))).alias("max_dd_pct"))
    s = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.avg("__chg").alias("__a"), F.stddev_pop("__chg").alias("__d"), F.max_by("__eod", "date").alias("__f"))
    return s.join(worst, list(keys)).select(
        *keys, (F.col("__f") - capital).alias("pnl"), cagr(F.col("__f"), F.lit(float(capital)), F.col("n_days")).alias("cagr"),
        F.when(F.col("__d") > 0, F.col("__a") / F.nullif("__d", F.lit(0.0)) * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("sharpe"), "max_dd_pct")


def benchmark_compare(strategy: DataFrame, fixed: DataFrame, compounding: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(metric, strategy, fixed, compounding, verdict) rows from three one-row-per-key tables.

    Metrics: pnl, cagr, sharpe, max_dd_pct (the smaller drop is the better one), calmar, and the alpha of the strategy's
    CAGR over either benchmark. verdict: better than both benchmarks, than the worse of them alone (between), or worse;
    of an alpha its sign.
    """
    keys = list(keys)
    metrics = ["pnl", "cagr", "sharpe", "max_dd_pct", "calmar"]

    def long(df: DataFrame, name: str) -> DataFrame:
        d = df.withColumn("calmar", F.when(F.col("max_dd_pct") != 0, F.col("cagr") / F.abs("max_dd_pct")).otherwise(0.0))
        pairs = ", ".join(f"'{m}', CAST({m} AS double)" for m in metrics)
        return d.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, {name})"))

    d = long(strategy, "strategy").join(long(fixed, "fixed"), [*keys, "metric"]).join(long(compounding, "compounding"), [*keys, "metric"])
    own, a, b = F.col("strategy"), F.col("fixed"), F.col("compounding")  # drops are negative: the higher is the better for all
    verdict = F.when(own > F.greatest(a, b), "better").when(own > F.least(a, b), "between").otherwise("worse")
    alpha = d.where("metric = 'cagr'").select(*keys, F.explode(F.array(
        F.struct(F.lit("alpha_fixed").alias("metric"), (own - a).alias("strategy")), F.struct(F.lit("alpha_compounding").alias("metric"), (own - b).alias("strategy")))).alias("__a"))
    none = F.lit(None).cast("double")
    alpha = alpha.select(*keys, "__a.metric", "__a.strategy", none.alias("fixed"), none.alias("compounding"), F.when(F.col("__a.strategy") > 0, "better").otherwise("worse").alias("verdict"))
    return d.select(*keys, "metric", "strategy", "fixed", "compounding", verdict.alias("verdict")).union(alpha)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts over min..max per key, empty bins included; a constant gives one bin."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    n_bins = F.when(F.col("__hi") == F.col("__lo"), 1).otherwise(bins)
    width = (F.col("__hi") - F.col("__lo")) / n_bins
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0))), n_bins - 1)).otherwise(0).cast("int")
    counts = df.join(span, keys).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), n_bins - 1))).withColumn("center", F.when(width > 0, F.col("__lo") + (F.col("bin") + 0.5) * width).otherwise(F.col("__lo")))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", "center", F.coalesce("n", F.lit(0)).alias("n"))


def downsample(df: DataFrame, keys: Sequence[str], order: Sequence[str], points: int, block: Column | None = None) -> DataFrame:
    """At most ``points`` evenly spaced rows per key, the last one always kept."""
    keys = list(keys)
    d = with_ordinal(df, keys, order, day_of(order[0]) if block is None else block).withColumn("idx", F.col("ord") - 1)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, F.col("__n") - 1).otherwise(F.floor(i * ((F.col("__n") - 1) / float(points - 1)))))
    wanted = size.where(F.col("__n") > points).select(*keys, F.explode(F.array_distinct(spaced)).alias("idx"))
    short = size.where(F.col("__n") <= points).select(*keys)
    return d.join(wanted, [*keys, "idx"], "left_semi").unionByName(d.join(short, keys, "left_semi")).drop("ord")


def representative_trades(trades: DataFrame, keys: Sequence[str], width: float = 100.0, net: str = "net_pnl_dollars") -> DataFrame:
    """The winner and the loser a third of the way down their ranking, among trades with a stop if any."""
    keys = list(keys)
    pool = trades.groupBy(*keys).agg(F.max(F.col("sl_price").isNotNull()).alias("__any"))
    d = trades.join(pool, keys).where(~F.col("__any") | F.col("sl_price").isNotNull())
    d = d.withColumn("winner", F.col(net) > 0).withColumn("__rank", -F.abs(F.col(net)))
    part = [*keys, "winner"]
    d = with_ordinal(d, part, ["__rank", "trade_id"], F.floor(F.col("__rank") / width))
    n = d.groupBy(*part).agg(F.floor(F.count(F.lit(1)) / 3).alias("__third"))
    return d.join(n, part).where(F.col("ord") - 1 == F.col("__third")).drop("ord", "__third", "__rank", "__any")
