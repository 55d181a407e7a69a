"""Normalised metrics of periodic statements, and quotes by source preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance as M
from ..plans import vocabulary as V


def preferred_source(rows: DataFrame, key: str, order: list[str], valid: Column) -> DataFrame:
    """Of each key's valid rows those of the first source in the order; keys without any have none."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("source"))
    ok = rows.where(valid & (rank > 0)).withColumn("__rank", rank)
    best = ok.groupBy(key).agg(F.min("__rank").alias("__best"))
    return ok.join(best, key).where("__rank = __best").drop("__rank", "__best")


def line_items(statements: DataFrame) -> DataFrame:
    """ticker, period_kind, period_end and one column per metric: of each metric's items the first that a ticker's statements of that kind have at all.

    The choice is made per item, not per cell: a chosen item's missing periods stay missing.
    """
    choice = F.create_map(*(x for m, items in V.METRIC_ITEMS.items() for i, item in enumerate(items) for x in (F.lit(item), F.struct(F.lit(m).alias("metric"), F.lit(i).alias("rank")))))
    rows = statements.withColumn("__c", choice[F.col("item")]).where("__c is not null").select("ticker", "period_kind", "period_end", M.not_nan(F.col("value")).alias("value"), "__c.metric", "__c.rank")
    first = F.min("rank").over(Window.partitionBy("ticker", "period_kind", "metric"))
    kept = rows.withColumn("first", first).where("rank = first")
    return kept.groupBy("ticker", "period_kind", "period_end").pivot("metric", list(V.METRIC_ITEMS)).agg(F.first("value", ignorenulls=True))


def metrics(items: DataFrame) -> DataFrame:
    """The fourteen metrics from line items, in millions, margins in percent; periods without revenue are left out."""
    c = F.col
    out = items.where(c("revenue").isNotNull()).withColumns({
        "admin_exp": F.coalesce(c("admin_exp"), c("sga") - c("selling_exp")),
        "capex": F.coalesce(c("capex"), c("free_cash_flow") - c("ocf")),
        "gross_margin": M.margin(c("gross_profit"), c("revenue")),
        "operating_margin": M.margin(c("operating_income"), c("revenue")),
        "net_margin": M.margin(c("net_income"), c("revenue")),
    })
    return out.select("ticker", "period_kind", "period_end", *((c(m) if m.endswith("margin") else M.millions(c(m))).alias(m) for m in V.METRIC_LABELS))


def latest(rows: DataFrame, periods: dict[str, int] | None = None, key: str = "ticker", kind: str = "period_kind", end: str = "period_end") -> DataFrame:
    """The newest reported periods of each key: so many per kind, gaps allowed."""
    periods = V.PERIODS if periods is None else periods
    most = max(periods.values())
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key, kind).orderBy(F.desc(end)))).where(F.col("__n") <= most)
    limit = F.create_map(*(F.lit(x) for p in periods.items() for x in p))[F.col(kind)]
    return ranked.where(F.col("__n") <= limit).drop("__n")


def unpivoted(rows: DataFrame) -> DataFrame:
    """ticker, period_kind, period_end, metric, value: one row per cell."""
    return rows.unpivot(["ticker", "period_kind", "period_end"], list(V.METRIC_LABELS), "metric", "value")


def valuation(quotes: DataFrame, order: list[str], as_of: Column | None = None) -> DataFrame:
    """ticker, five multiples as text, price and dates, market_cap and enterprise_value as text, of the preferred source with a price."""
    got = preferred_source(quotes, "ticker", order, F.coalesce(F.col("currentPrice") != 0, F.lit(False)))
    shown = {k: M.multiple(F.col(k)) for k in V.MULTIPLES}
    note = M.period_note(M.price(F.col("currentPrice")), F.current_date() if as_of is None else as_of, M.epoch_date(F.col("mostRecentQuarter")), M.epoch_date(F.col("nextFiscalYearEnd")))
    return got.select("ticker", "source", *(v.alias(k) for k, v in shown.items()), M.money(F.col("marketCap")).alias("market_cap"), M.money(F.col("enterpriseValue")).alias("enterprise_value"), note.alias("note"), M.valuation_table(list(shown.values()), note).alias("block"))


def cell(metric: Column) -> Column:
    return F.coalesce(F.replace(F.format_number(metric, 2), F.lit(","), F.lit("")), F.lit("-"))


def rendered(rows: DataFrame) -> DataFrame:
    """ticker, period_kind, table: a Markdown table with metrics as rows and periods, newest first, as columns."""
    cells = [F.struct(F.lit(label).alias("label"), cell(F.col(m)).alias("text")) for m, label in V.METRIC_LABELS.items()]
    period = F.struct("period_end", F.array(*cells).alias("cells"))
    kept = rows.groupBy("ticker", "period_kind").agg(F.reverse(F.array_sort(F.collect_list(period))).alias("p"))
    head = F.concat(F.lit("|  | "), F.array_join(F.transform("p", lambda x: x["period_end"].cast("string")), " | "), F.lit(" |\n|:---|"), F.array_join(F.transform("p", lambda x: F.lit("---:|")), ""))
    row = lambda i: F.array_join(F.transform("p", lambda x: F.get(x["cells"], F.lit(i))["text"]), " | ")
    lines = [F.concat(F.lit(f"\n| {label} | "), row(i), F.lit(" |")) for i, label in enumerate(V.METRIC_LABELS.values())]
    return kept.select("ticker", "period_kind", F.concat(head, *lines).alias("table"))


def financial_section(block: Column, annual: Column, quarterly: Column) -> Column:
    """The financial section from the valuation block and both tables; missing tables say so."""
    table = lambda t: F.coalesce(t, F.lit(V.NO_DATA))
    return F.concat(F.lit(V.FINANCIAL_TITLE + "\n"), F.coalesce(F.concat(block, F.lit("\n\n")), F.lit("")), F.lit(V.ANNUAL_TITLE + "\n"), table(annual), F.lit("\n\n" + V.QUARTERLY_TITLE + "\n"), table(quarterly), F.lit("\n"))
