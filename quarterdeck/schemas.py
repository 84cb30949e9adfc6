"""Schemas of the tables that cross a module boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, D, F64, I32, I64, B = (
    T.StringType(),
    T.DateType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
)

FACTS = _struct(
    ticker=S, concept=S, end=D, value=F64, ttm_source=S, ffo_gains_source=S, yoy_growth=F64
)
LONG = _struct(ticker=S, end=D, concept=S, value=F64)
PRICE_HISTORY = _struct(ticker=S, date=D, close=F64, stock_split=F64)
QUOTES = _struct(ticker=S, price=F64, shares_outstanding=F64, market_cap=F64)

# One row per filed number.  ``unit_pos`` and ``ordinal`` keep the order of the source
# document: several rules resolve ties by "first seen".
RAW_FACTS = _struct(
    ticker=S, tag=S, unit=S, unit_pos=I32, ordinal=I32,
    start=D, end=D, val=F64, filed=D, fp=S, fy=I32, form=S, accn=S,
)

_ITEM = _struct(start=S, end=S, val=F64, filed=S, fp=S, fy=I32, form=S, accn=S)
COMPANY_FACTS_JSON = T.StructType([
    T.StructField("facts", T.StructType([
        T.StructField("us-gaap", T.MapType(
            S, T.StructType([T.StructField("units", T.MapType(S, T.ArrayType(_ITEM)))])
        )),
    ])),
])
SUBMISSIONS_JSON = T.StructType([
    T.StructField("filings", T.StructType([
        T.StructField("recent", T.StructType([
            T.StructField("form", T.ArrayType(S)),
            T.StructField("reportDate", T.ArrayType(S)),
            T.StructField("filingDate", T.ArrayType(S)),
        ])),
    ])),
])
SUBMISSIONS = _struct(ticker=S, form=S, report_date=D, filing_date=D)

PROFILES = _struct(ticker=S, profile=S)
KNOWN_BAD = _struct(ticker=S, tag=S, end=D, filed=D, val=F64)
MASKED_PERIODS = _struct(ticker=S, concept=S, end=D, reason=S)
IDENTIFIERS = _struct(ticker=S, cik=S)
# One row per (owner, concept, source, tag); ``role`` is 'term' or 'require'.
CONCEPT_SOURCES = _struct(
    owner=S, concept=S, source_ix=I32, tag_ix=I32, tag=S, role=S, kind=S,
    point_in_time=B, non_negative=B, only_if_empty=B,
)
