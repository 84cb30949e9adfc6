"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix; it fits the host and all its subdomains where the url's
path starts with the rule's.  Each rule is filed under the one of its literal tokens that is
rarest in the urls at hand.  A url's tokens fetch the rules filed under them, and only those
run their regular expression; the longest rule that fits decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rules travel to every task, so their number is bounded
MOST_RULES = 1_000_000
DEFAULT_VERDICT = "allow"
TOKEN = re.compile(r"[^./]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host + path; neither holds a '?' or '#', and only the path a '/'."""
        return rf"(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){re.escape(self.path)}"

    def literals(self) -> list[str]:
        """Tokens that any url fitting the rule has as whole tokens."""
        path = self.path[:max(self.path.rfind("/"), self.path.rfind(".")) + 1]
        return TOKEN.findall(self.host) + TOKEN.findall(path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lowered; path: then up to
    '?', '#' or the end.  Both are empty for a null url or one without '://'."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def token_counts(parts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many urls have each of the rules' tokens; counted over all urls, one row per token."""
    found = F.array_distinct(F.split(F.concat("host", F.lit("/"), "path"), "[./]"))
    wanted = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    counted = parts.select(F.explode(found).alias("token")).join(
        F.broadcast(wanted), "token").groupBy("token").count()
    return {row["token"]: row["count"] for row in counted.collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token; those without one are filed under ''."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.literals(), key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = DEFAULT_VERDICT) -> DataFrame:
    """The columns of ``pages`` that are called page_id, and host, path, rule, verdict.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits.  Among rules of one
    length that fit, the one with the longer host, then the lesser name, then 'block' wins.
    Rows are judged one by one, so repeated rows and null ids stay as they are.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    named = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parts = named.select("page_id", host.alias("host"), path.alias("path"))
    tokens = sorted({t for rule in rules for t in rule.literals()})
    index = build_index(rules, token_counts(parts, tokens) if tokens else {})

    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        compiled: dict[Rule, re.Pattern] = {}

        def fits(rule: Rule, text: str) -> bool:
            if rule not in compiled:
                compiled[rule] = re.compile(rule.pattern)
            return compiled[rule].match(text) is not None

        names, verdicts = [], []
        for text in hosts + paths:
            candidates = {r for t in {*TOKEN.findall(text), ""} if t in index for r in index[t]}
            best = max((r for r in candidates if fits(r, text)), default=None,
                       key=lambda r: (len(r.name), len(r.host), r.name, r.verdict))
            names.append(best and best.name)
            verdicts.append(best.verdict if best else default)
        return pd.DataFrame({"rule": names, "verdict": verdicts})

    judged = F.pandas_udf(judge, "rule string, verdict string")("host", "path")
    return parts.withColumn("judged", judged).select("page_id", "host", "path", "judged.rule", "judged.verdict")
