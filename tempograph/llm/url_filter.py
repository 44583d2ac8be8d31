"""URL filters: rules on host and path, then a weighted vocabulary counted by an Aho-Corasick automaton.

A url is read with its percent codes decoded, as written if they are not UTF-8. A term counts where neither neighbour
is a letter or digit of any script. One strict term rejects a url, or several distinct soft terms whose weights reach
SOFT_LIMIT: words of the trade itself weigh 2, words that also stand in plain addresses 1, and no word reaches the
limit alone; a term that occurs again adds nothing.
"""

from __future__ import annotations

import functools
import unicodedata
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict): for the host and all its subdomains, where the url's path starts with the rule's; the longest rule wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = {"ads": 2, "bet": 2, "bets": 2, "bonus": 1, "cheap": 1, "crack": 2, "deal": 1, "farm": 1, "free": 1, "hot": 1, "jackpot": 2, "loan": 2, "loans": 2, "lottery": 2, "nude": 2, "pills": 2, "poker": 2, "popup": 2, "track": 1, "tracker": 2, "win": 1, "winner": 1}
SOFT_LIMIT = 3
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.lru_cache(maxsize=4)
def automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight))
    for term in strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def plain(url: str) -> str:
    """The url with percent codes decoded and A-Z lower-cased."""
    if "%" in url:
        try:
            url = urllib.parse.unquote(url, errors="strict")
        except UnicodeDecodeError:
            pass
    return url.translate(LOWER)


def hits(url: str, strict: tuple = STRICT, soft: tuple = tuple(SOFT.items())) -> tuple[list[str], list[str], int]:
    """Distinct strict terms, distinct soft terms, and the soft ones' weight."""
    low, own, some = plain(url), set(), {}
    for last, (term, weight) in automaton(strict, soft).iter(low):
        first = last + 1 - len(term)
        if (first and in_word(low[first - 1])) or (last + 1 < len(low) and in_word(low[last + 1])):
            continue
        if weight is None:
            own.add(term)
        else:
            some[term] = weight
    return sorted(own), sorted(some), sum(some.values())


def place(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[stop:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:stop].translate(LOWER), path[:end]


def ruled(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """The longest rule that fits, as written (host and path), and its verdict."""
    fits = [(len(h) + len(p), h + p, verdict) for h, p, verdict in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def judged(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: dict = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) of pages(page_id, url), one row a row; other columns are not read.

    Null and empty urls have empty host and path, no rule and no hits, and are allowed. A very long url is judged whole,
    in time that is linear in it. Repeated rows and null ids stay. An empty table gives none.
    """
    weighted = tuple(soft.items())
    names = ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch["url"].to_pylist():
                host, path = place(url)
                rule, verdict = ruled(host, path, rules) or (None, None)
                hard, some, weight = hits(url or "", strict, weighted)
                verdict = verdict or ("block" if hard or weight >= limit else "allow")
                for column, value in zip(out, (host, path, rule, verdict, hard, some), strict=True):
                    column.append(value)
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch["page_id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    schema = "page_id long, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged() of all pages: one row a row; null, empty and repeated urls as there; only page_id and url are read."""
    return judged(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The same for DuckDB: a regular expression for each term instead of the automaton."""
    bounded = r"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}])({})([^\p{{L}}\p{{N}}]|$)')".format
    score = " + ".join(f"{w} * {bounded(t)}::int" for t, w in SOFT.items())
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    upper, lower = (chr(a) + "-" + chr(a + 25) for a in (65, 97))
    letters = ("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    return f"""
-- letters {upper} as {lower}
with a as (select page_id, translate(case when contains(url, '%') then coalesce(try(url_decode(url)), url) else coalesce(url, '') end, '{letters[0]}', '{letters[1]}') as low,
             case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select page_id, low, translate(raw, '{letters[0]}', '{letters[1]}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b)
select page_id, host, path,
  case {" ".join(f"when {w} then '{r}'" for w, r, _ in fits)} end as rule,
  case {" ".join(f"when {w} then '{v}'" for w, _, v in fits)}
       when {bounded("|".join(STRICT))} or {score} >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict
from c"""
