"""Company-fundamentals analytics as Spark DataFrame jobs.

Long frames ``(ticker, concept, end, value)`` go in; clean quarterly series,
trailing-twelve-month series, guarded ratios, valuation multiples, snapshots and
view queries come out.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
