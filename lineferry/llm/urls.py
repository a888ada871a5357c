"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` with the tokens that every match contains as
whole tokens. Each rule is filed under the one of its tokens that the fewest URLs hold; a URL's own
tokens fetch the rules filed under them, and only those run their expression. Rules without any
token are tried on every URL.

Nulls and URLs without ``://`` have an empty host and path. Every row is judged for itself, so
repeated rows and null keys need no care; an empty table gives an empty result. Other columns are
passed through. ``host``, ``path``, ``rule`` and ``verdict`` of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.session import BROADCAST_BYTES

SEPARATOR = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` over host + path; ``tokens`` are runs of letters and digits that each match holds.

    Of the rules that fit, the one of the highest ``rank`` decides, by name where ranks are equal.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Rule for a host with its subdomains and the paths that start with ``path``; longer ones win.

    What follows the path's last separator may end inside a token, so it is no token.
    """
    whole = re.split(SEPARATOR, path)[:-1]
    tokens = [t for t in [*re.split(SEPARATOR, host), *whole] if t]
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, pattern, tuple(tokens), verdict, len(host + path))


def word_rule(verdict: str, word: str) -> Rule:
    """Rule for hosts and paths that hold a word as a whole token; any site rule goes before it."""
    return Rule(word, rf"(?s:.*)(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word,), verdict, 0)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(keyed: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; one row per token reaches the driver."""
    held = F.array_distinct(F.split(F.concat("host", "path"), SEPARATOR))
    counts = keyed.select(F.explode(held).alias("token")).where(F.col("token").isin(sorted(tokens))).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``tried``.

    ``tried`` counts the expressions run on the URL. The rules go to every task; their size is
    checked. URLs never leave their task, so a token that all of them share costs no shuffle.
    """
    if sum(len(r.pattern) + len(r.name) for r in rules) > BROADCAST_BYTES // 4:
        raise ValueError("the rules are too large to send to every task")
    keyed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    counts = token_counts(keyed, {t for r in rules for t in r.tokens}) if rules else {}
    # A token that no URL holds is the best: its rule is never fetched. Ties go by the token.
    filed: dict[str | None, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None), []).append(r)

    @F.pandas_udf("rule string, verdict string, tried int")
    def fetch(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = {t: [(re.compile(r.pattern), r) for r in rs] for t, rs in filed.items()}
        for hosts, paths in columns:
            rows = []
            for text in hosts + paths:
                fetched = [x for t in {None, *re.split(SEPARATOR, text)} for x in ready.get(t, ())]
                fits = [r for p, r in fetched if p.match(text)]
                best = max(fits, key=lambda r: (r.rank, r.name), default=None)
                rows.append((best and best.name, best.verdict if best else default, len(fetched)))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "tried"])

    judged = keyed.withColumn("_judged", fetch("host", "path"))
    return judged.withColumns({c: F.col("_judged")[c] for c in ("rule", "verdict", "tried")}).drop("_judged")
