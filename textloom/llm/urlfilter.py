"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule names a host and the beginning of a path; it holds for that host and all its subdomains. Of the
rules that fit, the longest (host and path together, then the longer host) gives the verdict. Urls that
no rule fits are searched for terms in one pass, whatever the vocabulary's size. A hit counts where
neither neighbour is an ASCII letter or digit. A strict term weighs `LIMIT`, a soft term 1; every
distinct term counts once, and a sum of `LIMIT` or more rejects: one strict or several soft terms.

Terms are looked for in host and path, lower-cased (A-Z): query strings and fragments hold referrers and
tracking words that say nothing of the page. Rules and terms are parameters that every task holds (some
hundred bytes each). The work is one map over the rows: nothing is shuffled, so a host that holds a third
of all rows, repeated rows and ties need no care.

A null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Texts of any
length are searched whole. An empty table gives no rows; other columns of the table are ignored.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "(?s)^.*?://([^/?#]*)([^?#]*)"
LETTERS = frozenset(LOWER + "0123456789")
LIMIT = 2

#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
STRICT = ("casino", "escort", "hentai", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "adult", "bet", "bets", "bonus", "cheap", "farm", "free", "loan", "loans", "nude",
        "pharmacy", "pills", "poker", "sex", "track", "win", "x")

SCHEMA = ("page_id long, host string, path string, rule string, verdict string, "
          "strict_terms long, soft_terms long, terms array<string>")


class Rules:
    """Rules by host, longest path first."""

    def __init__(self, rules):
        self.by_host, self.labels = {}, 0
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
            self.labels = max(self.labels, host.count(".") + 1)
        for found in self.by_host.values():
            found.sort(key=lambda r: -len(r[0]))

    def fitting(self, host, path):
        """(rule, verdict) of the longest rule that fits, or two Nones."""
        best = (-1, 0, None, None)
        labels = host.rsplit(".", self.labels)
        for n in range(1, min(len(labels), self.labels) + 1):
            suffix = ".".join(labels[-n:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    size = len(suffix) + len(start)
                    best = max(best, (size, len(suffix), suffix + start, verdict))
                    break
        return best[2:]


def automaton(terms):
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def terms_in(searcher, text):
    """Distinct terms that stand in the text between other characters than letters and digits."""
    found = set()
    for end, term in searcher.iter(text):
        start = end - len(term)
        if ((start < 0 or text[start] not in LETTERS)
                and (end + 1 == len(text) or text[end + 1] not in LETTERS)):
            found.add(term)
    return sorted(found)


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit=LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, the numbers of distinct terms and the terms of every url.

    Terms are given in lower case; they are only looked for where no rule fits.
    """
    def part(n):
        return F.coalesce(F.regexp_extract(F.col("url").cast("string"), ADDRESS, n), F.lit(""))

    def run(batches):
        known, searcher = Rules(rules), automaton((*strict, *soft))
        weight = dict.fromkeys(soft, 1) | dict.fromkeys(strict, limit)
        hard = frozenset(strict)
        for b in batches:
            out = []
            for host, path, lowered in zip(*(b[c].to_pylist() for c in ("host", "path", "lowered"))):
                rule, verdict = known.fitting(host, path)
                terms = []
                if rule is None:
                    terms = terms_in(searcher, lowered)
                    verdict = "block" if sum(map(weight.get, terms)) >= limit else "allow"
                n = sum(t in hard for t in terms)
                out.append((rule, verdict, n, len(terms) - n, terms))
            rule, verdict, n_strict, n_soft, terms = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["host"], b["path"], pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string()), pa.array(n_strict, pa.int64()),
                 pa.array(n_soft, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms",
                       "terms"])

    urls = pages.select(F.col("page_id").cast("long"), F.translate(part(1), UPPER, LOWER).alias("host"),
                        part(2).alias("path"))
    urls = urls.withColumn("lowered", F.concat("host", F.translate("path", UPPER, LOWER)))
    return urls.mapInArrow(run, SCHEMA)


def _count(terms):
    tests = [f"regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::BIGINT" for w in terms]
    return " + ".join(tests)


def _rule(host, path, verdict):
    fits = f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}')"
    return (f"SELECT '{host}{path}' AS rule, '{verdict}' AS verdict, page FROM urls WHERE {fits}")


SQL = f"""
WITH found AS (
  SELECT row_number() OVER () AS page, page_id,
    coalesce(regexp_extract(url, '{ADDRESS}', 1), '') AS h,
    coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages
), urls AS MATERIALIZED (
  SELECT page, page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path,
    translate(h || path, '{UPPER}', '{LOWER}') AS t FROM found
), fitting AS ({' UNION ALL '.join(_rule(*r) for r in RULES)}
), ruled AS (
  SELECT page, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fitting GROUP BY page
), counted AS (
  SELECT page_id, host, path, rule, verdict AS given,
    CASE WHEN rule IS NULL THEN {_count(STRICT)} ELSE 0 END AS strict_terms,
    CASE WHEN rule IS NULL THEN {_count(SOFT)} ELSE 0 END AS soft_terms
  FROM urls LEFT JOIN ruled USING (page)
)
SELECT page_id, host, path, rule, strict_terms, soft_terms,
  coalesce(given, CASE WHEN {LIMIT} * strict_terms + soft_terms >= {LIMIT} THEN 'block'
    ELSE 'allow' END) AS verdict
FROM counted"""
