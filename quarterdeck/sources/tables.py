"""Adapters that read order/supplier warehouse tables as fundamentals inputs.

Amounts are summed as scaled integers, so every engine that runs the same definition gets
the same doubles.  A supplier plays the company, a calendar quarter the reporting period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# value = sum of coefficient * quarter sum; see QUARTER_SUMS for the names
FACT_MIX: dict[str, dict[str, int]] = {
    "Revenue": {"net": 1},
    "CostOfRevenue": {"tax": 9, "disc": 3},
    "OperatingIncomeLoss": {"net": 1, "returned": -2, "tax": -3},
    "NetIncomeLoss": {"accepted": 2, "returned": -1, "tax": -4},
    "OperatingCashFlow": {"accepted": 1},
    "Capex": {"tax": 1},
    "DepreciationAndAmortization": {"disc": 1},
    "DividendsPerShare": {"lines": 1},
    "ShareBasedCompensation": {"disc": 2, "tax": -1},
    "IncomeTaxExpense": {"tax": 3, "disc": -2},
    "PretaxIncome": {"net": 1, "returned": -2},
    "StockRepurchased": {"returned": 1},
    "StockIssued": {"accepted": 1, "tax": -2},
    "SharesOutstanding": {"qty": 1},
    "StockholdersEquity": {"net": 1, "returned": -2},
    "Goodwill": {"disc": 4},
    "LongTermDebt": {"returned": 3},
    "CashAndEquivalents": {"accepted": 1, "disc": 1},
    "Assets": {"net": 5},
    "NetInterestIncome": {"net": 1, "disc": -5},
    "NoninterestIncome": {"disc": 3},
    "NoninterestExpense": {"tax": 6},
    "ProvisionForCreditLosses": {"tax": 1, "disc": -1},
    "EarnedPremiums": {"net": 2},
    "IncurredLosses": {"net": 1, "disc": 2},
    "BenefitsLossesAndExpenses": {"net": 1, "disc": 2, "tax": 9},
    "NetInvestmentIncome": {"disc": 2},
    "RealizedInvestmentGains": {"accepted": 1, "returned": -1},
    "Investments": {"net": 3},
    "ClaimsReserve": {"net": 2, "tax": 3},
    "Inventory": {"disc": 2, "tax": 2},
    "AccountsReceivable": {"accepted": 1, "tax": 1},
    "AccountsPayable": {"returned": 1, "tax": 1},
    "ResearchAndDevelopment": {"tax": 2},
    "GainLossOnSaleOfProperties": {"accepted": 1, "disc": -3},
}
FACT_CONCEPTS = tuple(FACT_MIX)
PROFILE_BY_REGION = ("standard", "financial", "insurance_pc", "retail", "reit")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_end(timestamp: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(F.col(timestamp).cast("date"), "quarter"), 2))


def ticker_of(key: str, prefix: str = "S") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _cents(column: str) -> Column:
    """Non-negative amount in hundredths, rounded half up."""
    return F.floor(F.col(column) * 100 + 0.5)


def quarter_sums(lineitem: DataFrame) -> DataFrame:
    """Integer sums per supplier and quarter (partial sums are combined before the shuffle)."""
    price, discount, tax = _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax")
    return lineitem.groupBy("l_suppkey", quarter_end("l_shipdate").alias("end")).agg(
        F.sum(price * (100 - discount)).alias("net"),
        F.sum(price * tax).alias("tax"),
        F.sum(price * discount).alias("disc"),
        F.sum(F.when(F.col("l_returnflag") == "A", price * 100).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("l_returnflag") == "R", price * 100).otherwise(0)).alias("returned"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.count(F.lit(1)).alias("lines"))


def quarter_index(end: Column | str) -> Column:
    return (F.year(end) * 4 + F.quarter(end)).cast("long")


def mixed_value(mix: dict[str, int]) -> str:
    """SQL of a linear mix of quarter sums."""
    return " + ".join(f"{name} * ({factor})" for name, factor in mix.items())


def _present(place: str, every: int, gaps: bool) -> str:
    """SQL condition that fails at one place in ``every``, if there are to be gaps."""
    return f"({place}) % {every} <> 0" if gaps else "true"


def facts_from_sums(sums: DataFrame, concepts: tuple[str, ...] = FACT_CONCEPTS, gaps: bool = False) -> DataFrame:
    """Long facts per supplier quarter.

    With ``gaps``, for queries about absence, some rows carry no value (the row stays) and
    some companies lack a concept altogether.
    """
    quarter = "(year(end) * 4 + quarter(end))"
    cells = ", ".join(
        f"named_struct('concept', '{concept}', 'value', "
        f"CASE WHEN {_present('l_suppkey + qi + ' + str(position), 23, gaps)} "
        f"THEN double({mixed_value(FACT_MIX[concept])}) END, "
        f"'kept', {_present('l_suppkey + 1 + ' + str(position), 17, gaps)})"
        for position, concept in enumerate(FACT_CONCEPTS) if concept in concepts)
    # the ticker is spelt once per quarter, not once per row
    rows = sums.withColumns({"qi": F.expr(quarter), "ticker": ticker_of("l_suppkey")}).select(
        "ticker", "end", F.expr(f"inline(array({cells}))"))
    return rows.filter("kept").select("ticker", "concept", "end", "value")


def facts_from_lineitem(lineitem: DataFrame, concepts: tuple[str, ...] = FACT_CONCEPTS,
                        gaps: bool = False) -> DataFrame:
    return facts_from_sums(quarter_sums(lineitem), concepts, gaps)


def sparse_facts_from_orders(orders: DataFrame) -> DataFrame:
    """One concept per customer with holes: quarters without an order have no row."""
    return orders.groupBy(
        ticker_of("o_custkey", "C").alias("ticker"), quarter_end("o_orderdate").alias("end")
    ).agg(F.sum(_cents("o_totalprice")).cast("double").alias("value")).select(
        "ticker", F.lit("Revenue").alias("concept"), "end", "value")


def prices_from_lineitem(lineitem: DataFrame, gaps: bool = False) -> DataFrame:
    """Daily close per supplier, missing on some days with ``gaps``; every tenth supplier splits 2:1 on its first 1998 trade."""
    daily = lineitem.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.sum(_cents("l_extendedprice") * 100).cast("double")
         / F.sum(F.col("l_quantity").cast("long"))).alias("close"),
        F.count(F.lit(1)).alias("n"))
    splits = (lineitem.filter((F.year("l_shipdate") == 1998) & (F.col("l_suppkey") % 10 == 0))
              .groupBy("l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("split_day")))
    traded = F.expr(_present("l_suppkey + dayofmonth(date)", 13, gaps))
    return daily.join(splits, "l_suppkey", "left").select(
        ticker_of("l_suppkey").alias("ticker"), "date",
        F.when(traded, F.col("close")).alias("close"),
        F.when(F.col("date") == F.col("split_day"), 2.0).otherwise(0.0).alias("stock_split"))


def quotes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Current quote per supplier: an overall price and share count."""
    totals = lineitem.groupBy("l_suppkey").agg(
        F.sum(_cents("l_extendedprice")).alias("cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    shares = F.floor(F.col("qty") / (16 + F.col("l_suppkey") % 25)).cast("double")
    price = (F.col("cents") * 100).cast("double") / F.col("qty")
    return totals.select(
        ticker_of("l_suppkey").alias("ticker"), price.alias("price"),
        shares.alias("shares_outstanding"), (price * shares).alias("market_cap"))


def profiles_from_suppliers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(p) for p in PROFILE_BY_REGION]),
                         (F.col("n_regionkey") + 1).cast("int"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        ticker_of("s_suppkey").alias("ticker"), names.alias("profile"))


def shifted_facts(facts: DataFrame) -> DataFrame:
    """Ends of some concepts moved by up to a week, plus rows a month off."""
    key = F.substring("ticker", 2, 20).cast("long")
    length = F.length("concept").cast("long")
    moved = F.when(key % 3 == 0, F.date_sub("end", (length % 8).cast("int"))).otherwise(F.col("end"))
    far = ((key + length) % 5 == 0)
    ends = F.when(far, F.array(moved, F.date_sub("end", 28))).otherwise(F.array(moved))
    return facts.select("ticker", "concept", F.explode(ends).alias("end"), "value")


def submissions_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One periodic report per supplier quarter, filed 30 to 44 days after its end."""
    quarters = lineitem.groupBy("l_suppkey", quarter_end("l_shipdate").alias("end")).agg(
        F.count(F.lit(1)).alias("n"))
    lag = (30 + (F.col("l_suppkey") * 7 + quarter_index("end") * 3) % 15).cast("int")
    return quarters.select(
        ticker_of("l_suppkey").alias("ticker"),
        F.when(F.month("end") == 12, "10-K").otherwise("10-Q").alias("form"),
        F.col("end").alias("report_date"), F.date_add("end", lag).alias("filing_date"))


# --- raw filings ------------------------------------------------------------

def _item(tag, val, *, start="NULL", end="pe", filed="filed_first", unit="USD", unit_pos=0,
          place=0, accn="accn_first", when="true") -> dict[str, str]:
    """One filed number; the expressions are plain SQL over a supplier quarter."""
    return {"when": when, "tag": f"'{tag}'", "unit": f"'{unit}'", "unit_pos": str(unit_pos),
            "ordinal": f"CAST(qi * 10 + {place} AS INT)", "start": f"CAST({start} AS DATE)",
            "pe": end, "val": f"CAST({val} AS DOUBLE)", "filed": filed, "accn": accn}


def _quarter_or_ladder(tag: str, value: str, running: str, when: str) -> list[dict[str, str]]:
    """Even suppliers file year-to-date ladders, odd ones three quarters and a year.

    Every number is filed again a year later, a quarter of them with another value.
    """
    even = f"({when}) AND s % 2 = 0"
    odd = f"({when}) AND s % 2 = 1"
    out = []
    for place, filed, accn, shift in ((0, "filed_first", "accn_first", "0"),
                                      (1, "filed_again", "accn_again",
                                       "CASE WHEN (s + qi) % 4 = 0 THEN 10000 ELSE 0 END")):
        common = dict(filed=filed, accn=accn, place=place)
        out += [
            _item(tag, f"{running} + {shift}", start="year_start", when=even, **common),
            _item(tag, f"{value} + {shift}", start="quarter_start", when=f"{odd} AND q < 4", **common),
            _item(tag, f"{running} + {shift}", start="year_start", when=f"{odd} AND q = 4", **common),
        ]
    return out


def raw_items() -> list[dict[str, str]]:
    q = dict(start="quarter_start")
    y = dict(start="year_start", when="q = 4")
    shares = "qty * 1000"
    wrong_scale = "s % 9 = 4 AND qi % 13 = 5"
    too_large = "s % 11 = 3 AND qi % 10 = 7"
    basis = "CASE WHEN split_day IS NOT NULL AND {filed} < split_day THEN 500 ELSE 1000 END"
    filed_shares = (f"qty * {basis.format(filed='filed_first')} "
                    f"* CASE WHEN {too_large} THEN 1000 ELSE 1 END "
                    f"/ CASE WHEN {wrong_scale} THEN 1000 ELSE 1 END")
    diluted = "WeightedAverageNumberOfDilutedSharesOutstanding"
    income = "accepted * 2 - returned"
    return [
        *_quarter_or_ladder("Revenues", "net", "net_ytd", "year <= 2000"),
        _item("RevenueFromContractWithCustomerExcludingAssessedTax", "net + 7", when="year >= 2000", **q),
        _item("Depreciation", "disc", **q),
        _item("AmortizationOfIntangibleAssets", "tax", when="(s + q) % 3 <> 0", **q),
        _item("DepreciationDepletionAndAmortization", "disc * 2", when="s % 5 = 0 AND year >= 1998", **q),
        _item("LongTermDebt", "returned - accepted", when="s % 4 = 0"),
        _item("LongTermDebtNoncurrent", "returned", when="(s + qi) % 6 <> 0"),
        _item("LongTermDebtCurrent", "tax"),
        _item("NotesPayableCurrent", "disc", when="s % 3 = 0"),
        _item(diluted, filed_shares, unit="shares", **q),
        _item(diluted, "qty * 1000 + 5", unit="shares", place=2, **y),
        _item(diluted, f"qty * {basis.format(filed='filed_again')}", unit="shares", place=1,
              filed="filed_again", accn="accn_again", when="s % 20 = 0", **q),
        _item("CommonStockSharesOutstanding", f"{shares} + 11 * qty", unit="shares",
              when="s % 10 <> 0"),
        _item("NetIncomeLoss", income, **q),
        _item("EarningsPerShareDiluted", f"({income}) / (qty * 1000)", unit="USD/shares",
              when="s % 4 <> 1", **q),
        _item("EarningsPerShareDiluted", f"({income}) / ({filed_shares})", unit="USD/shares",
              when="s % 4 = 1", **q),
        _item("StockholdersEquity", "net - returned"),
        _item("StockholdersEquity", "net - returned + 3", place=1, filed="filed_first - 5",
              when="s % 7 = 0", **q),
        _item("StockholdersEquity", "net - returned + 5", place=2, filed="filed_again",
              accn="accn_again", when="s % 7 = 0 AND qi % 2 = 0"),
        _item("StockholdersEquity", "net - returned + 9", place=3, filed="filed_again",
              accn="accn_again", start="quarter_start - 275", when="s % 7 = 0 AND qi % 3 = 0"),
        _item("Goodwill", "disc * 4", unit="EUR"),
        _item("Goodwill", "disc * 3", unit="USD", unit_pos=1, when="s % 2 = 0"),
        _item("PaymentsForRepurchaseOfCommonStock", "returned", when="s % 3 <> 0", **q),
        _item("PaymentsForRepurchaseOfCommonStock", "returned_ytd", **{**y, "when": "q = 4 AND s % 3 = 0"}),
        _item("OperatingIncomeLoss", "net - returned * 2", **q),
        _item("OperatingIncomeLoss", "net - returned * 2 + 1", place=1, start="quarter_start - 2",
              end="pe - 2", when="s % 5 = 1"),
        _item("OperatingIncomeLoss", "net + 2", place=2, start="quarter_start - 28",
              end="pe - 28", when="s % 5 = 2 AND qi % 9 = 0"),
        _item("NetCashProvidedByUsedInOperatingActivities", "accepted", **q),
        _item("PaymentsToAcquirePropertyPlantAndEquipment", "tax * IF(qi % 11 = 0, -1, 1)", **q),
    ]


def raw_filings_from_lineitem(lineitem: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Filing facts per supplier: ladders, restatements, several tags, units and scales.

    ``sums`` are the quarter sums of ``lineitem``, if they are there.
    """
    split = (lineitem.filter((F.year("l_shipdate") == 1998) & (F.col("l_suppkey") % 10 == 0))
             .groupBy("l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("split_day")))
    running = Window.partitionBy("s", "year").orderBy("pe").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = (quarter_sums(lineitem) if sums is None else sums).withColumnsRenamed({"l_suppkey": "s", "end": "pe"}).withColumns({
        "year": F.year("pe"), "q": F.quarter("pe"), "qi": quarter_index("pe")})
    base = base.withColumns({
        "net_ytd": F.sum("net").over(running), "returned_ytd": F.sum("returned").over(running),
        "year_start": F.trunc("pe", "year"), "quarter_start": F.trunc("pe", "quarter"),
        "filed_first": F.date_add("pe", 35), "filed_again": F.date_add("pe", 400),
        "accn_first": F.expr("concat('A', s, '-', qi)"),
        "accn_again": F.expr("concat('A', s, '-', qi + 4)"),
    }).join(split.withColumnRenamed("l_suppkey", "s"), "s", "left")
    fields = [n for n in raw_items()[0] if n != "when"]
    structs = ", ".join(
        "CASE WHEN {} THEN named_struct({}) END".format(
            item["when"], ", ".join(f"'{n}', {item[n]}" for n in fields)) for item in raw_items())
    rows = base.select(ticker_of("s").alias("ticker"), "q", "year",
                       F.expr(f"inline(array({structs}))")).filter("tag IS NOT NULL")
    return rows.select(
        "ticker", "tag", "unit", "unit_pos", "ordinal", "start", F.col("pe").alias("end"), "val",
        "filed", F.when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.col("q"))).alias("fp"),
        F.col("year").alias("fy"),
        F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form"), "accn")


def documents_from_filings(raw: DataFrame) -> DataFrame:
    """The same facts as nested company documents: (ticker, text).

    Every seventh company has a second document that breaks off in the middle.
    """
    fields = ["start", "end", "val", "filed", "fp", "fy", "form", "accn"]
    in_order = lambda rows, value: F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[value])
    units = raw.groupBy("ticker", "tag", "unit", "unit_pos").agg(
        in_order(F.struct("ordinal", F.struct(*fields).alias("item")), "item").alias("items"))
    tags = units.groupBy("ticker", "tag").agg(F.map_from_entries(in_order(
        F.struct("unit_pos", F.struct("unit", "items").alias("entry")), "entry")).alias("units"))
    bodies = tags.groupBy("ticker").agg(F.map_from_entries(F.collect_list(
        F.struct("tag", F.struct("units")))).alias("us-gaap"))
    whole = bodies.select("ticker", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("text"))
    cut = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    texts = F.when(F.substring("ticker", 2, 20).cast("long") % 7 == 0, F.array(F.col("text"), cut))
    return whole.select("ticker", F.explode(F.coalesce(texts, F.array("text"))).alias("text"))


def company_layer(profiles: DataFrame, layers: DataFrame) -> DataFrame:
    """``layers`` (owner = layer0, layer1 ...) as company sources: a company's number mod 4 names its layer."""
    key = F.substring("ticker", 2, 20).cast("long") % 4
    owners = profiles.select("ticker", F.concat(F.lit("layer"), key.cast("string")).alias("owner"))
    return owners.join(layers, "owner").drop("owner").withColumnRenamed("ticker", "owner")


def known_bad_from_filings(raw: DataFrame) -> DataFrame:
    """A correction table for tests: some goodwill facts of a few suppliers."""
    return raw.filter((F.col("tag") == "Goodwill") & (F.col("ordinal") % 50 == 0)).select(
        "ticker", "tag", "end", "filed", "val")
