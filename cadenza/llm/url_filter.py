"""URL filter: host rules first, then a weighted vocabulary searched with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.text import ascii_lower

# One of the strict terms rejects a url; of the soft ones it takes several.
STRICT = (
    "casino", "cialis", "escort", "escorts", "hentai", "keygen", "malware", "milf", "nsfw", "phishing",
    "porn", "porno", "sex", "torrent", "torrents", "viagra", "warez", "xxx",
)
SOFT = (
    "ad", "ads", "adserver", "adult", "affiliate", "banner", "bet", "betting", "bonus", "cams", "cheap", "click",
    "clicks", "coupon", "coupons", "crack", "dating", "deal", "deals", "erotic", "free", "gambling", "girls", "hot",
    "jackpot", "loan", "loans", "nude", "payday", "pills", "poker", "popup", "promo", "slots", "spam", "sponsor",
    "sponsored", "track", "tracker", "tracking", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. A null url, or one without ``://``, has neither: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _rule_finder(rules: Iterable[Rule]):
    """(host, path) -> the longest rule that fits, or None: one look-up per label of the host."""
    of_host: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: -len(r.path)):
        of_host.setdefault(rule.host, []).append(rule)

    def find(host: str, path: str) -> Rule | None:
        fitting = []
        while host:
            fitting += [r for r in of_host.get(host, ()) if path.startswith(r.path)][:1]
            host = host.partition(".")[2]
        return max(fitting, key=lambda r: len(r.name), default=None)

    return find


def vocabulary_of(terms: DataFrame, max_bytes: int = 256 << 20) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict terms, and soft ones with their weights, of a table (term, kind, weight) for ``judge_urls``.

    Terms are lower-cased (A-Z) and taken once, a term of both kinds as strict, a soft one with its
    largest weight; a null weight is 1. Rows without a term, or of another kind than ``strict`` and
    ``soft``, are left out. Every task holds the automaton, so the table is measured before it is
    fetched, and one that is too large for that raises an error.
    """
    term, weight = ascii_lower(F.col("term").cast("string")), F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    rows = terms.select(term.alias("term"), F.col("kind"), weight.alias("weight")).where("term <> '' AND kind IN ('strict', 'soft')")
    rows = rows.groupBy("term").agg(F.max("kind").alias("kind"), F.max("weight").alias("weight"))
    size = rows.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a vocabulary of {size} bytes")
    found = sorted(map(tuple, rows.collect()))
    return tuple(t for t, kind, _ in found if kind == "strict"), {t: w for t, kind, w in found if kind == "soft"}


def _term_finder(strict: Iterable[str], soft: Iterable[str]):
    """text -> sets of the strict and soft terms in it that stand between non-alphanumeric characters."""
    automaton = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            automaton.add_word(term, (kind, term))
    if len(automaton):
        automaton.make_automaton()
    inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def find(text: str) -> tuple[set[str], set[str]]:
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        for end, (kind, term) in automaton.iter(text) if len(automaton) else ():
            start = end - len(term)
            if (start < 0 or text[start] not in inner) and (end + 1 == len(text) or text[end + 1] not in inner):
                found[kind].add(term)
        return found["strict"], found["soft"]

    return find


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] | Mapping[str, float] = SOFT,
    min_soft: int = 2,
    min_weight: float | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, strict_terms, soft_terms, score).

    The longest rule that fits decides. Without one a url is blocked that holds a strict term, or
    ``min_soft`` different soft terms that weigh ``min_weight`` together (unless given, as much as
    ``min_soft`` terms of weight 1, which is what a list without weights has), each between
    characters other than a-z and 0-9 (A-Z are lower-cased first). ``score`` is 1 for a strict term,
    else the share of ``min_weight`` that was found. Terms can come from a table: ``vocabulary_of``.
    A map over the rows: no shuffle, whatever the hosts.

    Null and empty urls, and those without ``://``, have an empty host and path, fit no rule and
    are allowed unless their text holds terms. Repeated rows are judged each for itself; an empty
    table gives an empty one; other columns are not read.
    """
    rules, strict = list(rules), tuple(strict)
    weights = dict(soft) if isinstance(soft, Mapping) else dict.fromkeys(soft, 1.0)
    enough = float(min_soft if min_weight is None else min_weight)

    @F.pandas_udf("rule string, verdict string, strict_terms int, soft_terms int, score double")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rule_of, terms_in = _rule_finder(rules), _term_finder(strict, weights)

        def one(host: str, path: str, url: str) -> tuple:
            rule, (hard, weak) = rule_of(host, path), terms_in(url)
            weight = sum(weights[t] for t in sorted(weak))
            blocked = bool(hard) or (len(weak) >= min_soft and weight >= enough)
            verdict = rule.verdict if rule else "block" if blocked else "allow"
            score = 1.0 if hard or weight >= enough else max(0.0, weight / enough)
            return rule.name if rule else None, verdict, len(hard), len(weak), score

        for hosts, paths, urls in parts:
            rows = [one(*x) for x in zip(hosts, paths, urls, strict=True)]
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_terms", "soft_terms", "score"])

    host, path = url_parts(F.col(url_column))
    lowered = F.coalesce(ascii_lower(url_column), F.lit(""))
    found = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), lowered.alias("lowered"))
    found = found.withColumn("found", judge("host", "path", "lowered"))
    return found.select(id_column, "host", "path", "found.*")
