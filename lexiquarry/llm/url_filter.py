"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds the terms in host, path and query. A term counts where
no letter or digit touches it. One strict term rejects, and so do ``soft_hits`` distinct
soft terms. Defined results: null or a value without ``://`` has empty host and path and
no rule; repeated rows are judged alike; a url of any length is read whole, once; all other
columns of the input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms of which one rejects.
STRICT_TERMS = (
    "porn", "porno", "xxx", "xvideos", "hentai", "nsfw", "adult", "adults", "sex", "sexcam", "escort", "escorts",
    "casino", "casinos", "bet", "bets", "betting", "gambling", "poker", "slots", "jackpot", "roulette",
    "viagra", "cialis", "pill", "pills", "phishing", "malware", "warez", "spam",
)
#: Terms of which several distinct ones reject.
SOFT_TERMS = (
    "ad", "ads", "advert", "banner", "track", "tracker", "tracking", "click", "clicks", "popup", "sponsor", "affiliate",
    "promo", "cheap", "discount", "free", "win", "winner", "bonus", "prize", "deal", "deals", "coupon", "loan", "loans",
    "payday", "crypto", "farm", "torrent", "crack", "keygen", "dating", "cam", "cams", "hot", "girls", "replica",
)


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, a path's beginning, and what to do."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].translate(_LOWER), rest[cut:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:end]


def rule_for(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule that fits."""
    best, at = None, 0
    while host:
        for r in by_host.get(host[at:], ()):
            if path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                best = r
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]):
    auto = ahocorasick.Automaton()
    for t in soft:
        auto.add_word(t, (t, False))
    for t in strict:
        auto.add_word(t, (t, True))
    auto.make_automaton()
    return auto


def term_hits(text: str, auto) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms that stand with both ends at a boundary."""
    strict, soft, n = set(), set(), len(text)
    for end, (term, hard) in auto.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < n and text[end + 1].isalnum()):
            continue
        (strict if hard else soft).add(term)
    return strict, soft


SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    soft_hits: int = 2,
) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url)."""
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not strict and not soft:
        raise ValueError("the vocabulary is empty")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = vocabulary(strict, soft)
        for b in batches:
            out: list[tuple] = []
            for page_id, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                rule = rule_for(host, path, by_host)
                hard, mild = term_hits((url or "").lower(), auto)
                verdict = rule.verdict if rule else "block" if hard or len(mild) >= soft_hits else "allow"
                out.append((page_id, host, path, rule.name if rule else None, verdict, len(hard), len(mild)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"]).mapInArrow(judge, SCHEMA)


def _listed(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def oracle() -> str:
    """The same judgement in DuckDB SQL: a regular expression for each term."""
    hit = "len(list_filter({}, lambda t: regexp_matches(lower(coalesce(c.url, '')), '(^|[^\\pL\\pN])' || t || '([^\\pL\\pN]|$)')))"
    rules = " UNION ALL ".join(f"SELECT '{r.host}' AS rule_host, '{r.path}' AS rule_path, '{r.verdict}' AS rule_verdict" for r in DEFAULT_RULES)
    return f"""
WITH rules AS ({rules}), parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), fits AS (
  SELECT c.page_id, c.url, max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, max_by(r.rule_verdict, length(r.rule_host || r.rule_path)) AS rule_verdict
  FROM cut c JOIN rules r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path) GROUP BY 1, 2
), hits AS (
  SELECT c.page_id, c.host, c.path, f.rule, f.rule_verdict, CAST({hit.format(_listed(STRICT_TERMS))} AS INTEGER) AS strict_hits, CAST({hit.format(_listed(SOFT_TERMS))} AS INTEGER) AS soft_hits
  FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.url = c.url
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits FROM hits
"""
