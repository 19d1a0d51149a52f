"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it fits must
hold. Spark counts those tokens over all URLs, and each rule is filed under the rarest
of its own. A URL's tokens fetch the candidate rules, and only these run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.tables import table

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Most rules that one index holds; it goes to every task.
MOST_RULES = 1_000_000


class Rule(NamedTuple):
    """``pattern`` is searched in host and path together. Of the rules that fit, those of
    the higher ``rank`` win, then the longer name, then the smaller one."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def place_rule(text: str, verdict: str) -> Rule:
    """The rule of a host with its subdomains and of paths that start alike: ``host/path``."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    # The last token of the path may go on in the URL.
    closed = path[: max((i + 1 for i, c in enumerate(path) if not c.isalnum()), default=0)]
    return Rule(
        text,
        verdict,
        rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}",
        (*_TOKEN.findall(host), *_TOKEN.findall(closed)),
        1,
    )


# The rules of the query.
PLACE_RULES = (
    place_rule("org/", "allow"),
    place_rule("example.org/es/", "block"),
    place_rule("example.org/en/1", "block"),
    place_rule("com/fr/", "allow"),
    place_rule("com/de/", "block"),
)
# Hosts of advertising and gambling; they decide where no place rule does.
JUNK_RULES = (
    Rule("casino", "block", r"\A[^/]*\bcasino\b", ("casino",)),
    Rule("bets", "block", r"\A[^/]*\bbets\b", ("bets",)),
    Rule("pills", "block", r"\A[^/]*\bpills\b", ("pills",)),
    Rule("ads", "block", r"\A[^/]*\bads-track\b", ("ads", "track")),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty without one."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    cut = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(_LOWER), path[:cut]


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.always: list[tuple[Rule, re.Pattern]] = []
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules:
            entry = (rule, re.compile(rule.pattern))
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, place: str) -> list[tuple[Rule, re.Pattern]]:
        found = list(self.always)
        for token in set(_TOKEN.findall(place)):
            found += self.by_token.get(token, ())
        return found

    def best(self, host: str, path: str) -> Rule | None:
        if not host:
            return None
        place = host + path
        fits = [r for r, pattern in self.candidates(place) if pattern.search(place)]
        return min(fits, key=lambda r: (-r.rank, -len(r.name), r.name), default=None)


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens is; one row per token at most returns."""
    if not tokens:
        return {}
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    here = F.array_distinct(F.regexp_extract_all(url, F.lit("([A-Za-z0-9]+)")))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    counted = (
        urls.select(F.explode(here).alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return {r.token: r.n for r in counted.collect()}


def judge_urls(
    urls: DataFrame,
    *,
    rules: Sequence[Rule] = (*PLACE_RULES, *JUNK_RULES),
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; rows may repeat.

    ``rule`` names the rule of rank 1 that decided, else it is null and the verdict is
    that of a lower rank or ``default``. A null url, or one without ``://``, has empty
    host and path and the default verdict. The id may be null; other columns are not
    read. Empty in, empty out.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    index = RuleIndex(rules, token_counts(urls, url_col, {t for r in rules for t in r.tokens}))
    text = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    schema = T.StructType([T.StructField("page_id", urls.schema[id_col].dataType), *text])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule = index.best(host, path)
                named = rule.name if rule and rule.rank else None
                rows.append((host, path, named, rule.verdict if rule else default))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.string()) for c in columns)],
                names=schema.names,
            )

    slim = urls.select(urls[id_col].alias("id"), urls[url_col].cast("string").alias("url"))
    return slim.mapInArrow(judge, schema)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM s
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1')
      THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/')
      THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '\b(casino|bets|pills|ads-track)\b') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
