"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules to test.

All work is column expressions. The index is a constant map in the plan, so judging needs no shuffle
and no join; how often each literal occurs is counted over all URLs first (one narrow aggregate whose
result has at most one row per literal of the rules).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are configuration that travels with the plan; more than this belongs into a table of hosts and a join.
MAX_RULES = 20_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host with its subdomains and every path that starts with ``path``; the longest rule wins."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return r"^(?:[^/]*\.)?" + literal(self.text)

    @property
    def tokens(self) -> list[str]:
        """Literals that stand in a fitting URL as whole tokens: the last one only if something ends it."""
        found = list(re.finditer(TOKEN, lowered(self.text)))
        return [m[0] for m in found if m.end() < len(self.text)]


@dataclass(frozen=True)
class WordRule:
    """A block for URLs that no site rule fits: ``pattern`` on host and path, all ``tokens`` of which it needs."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


SITE_RULES = (
    SiteRule("com", "/", "allow"),
    SiteRule("example.com", "/en/", "block"),
    SiteRule("www.example.com", "/en/", "allow"),
    SiteRule("net", "/es/", "block"),
    SiteRule("net", "/fr/", "block"),
)
WORD_RULES = (
    WordRule("free bets", r"(?i)(^|[^a-z0-9])free-bets?([^a-z0-9]|$)", ("free",)),
    WordRule("casino", r"(?i)(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",)),
    WordRule("poker", r"(?i)(^|[^a-z0-9])poker([^a-z0-9]|$)", ("poker",)),
    WordRule("porn", r"(?i)(^|[^a-z0-9])porn([^a-z0-9]|$)", ("porn",)),
    WordRule("xxx", r"(?i)(^|[^a-z0-9])xxx([^a-z0-9]|$)", ("xxx",)),
    WordRule("cheap pills", r"(?i)(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)", ("cheap", "pills")),
)


def lowered(text: str) -> str:
    return text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


def literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, ascii_uppercase, ascii_lowercase), F.lit(f"({TOKEN})")))


def literal_counts(urls: DataFrame, rules) -> dict[str, int]:
    """How many URLs hold each literal of the rules, over all URLs."""
    wanted = sorted({token for rule in rules for token in rule.tokens})
    if not wanted:
        return {}
    counts = (
        urls.select(F.explode("tokens").alias("token")).where(F.col("token").isin(wanted)).groupBy("token").count()
    )
    return {row["token"]: row["count"] for row in counts.collect()}


def judge_urls(pages: DataFrame, url: str = "url", sites=SITE_RULES, words=WORD_RULES) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``word_rule``.

    The longest site rule that fits decides. Without one, a URL is blocked if a word rule matches and allowed
    otherwise; ``word_rule`` names the first such rule. Null, empty and malformed URLs have empty host and path,
    no rule and are allowed. Of equally long rules the one later in the alphabet wins, of equal texts a block.
    Columns of ``pages`` with one of these names are replaced, all others stay.
    """
    rules = [*sites, *words]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: at most {MAX_RULES} can travel with the plan")
    host, path = host_and_path(F.col(url))
    counts = literal_counts(pages.select(url_tokens(F.concat(host, path)).alias("tokens")), rules)
    index: dict[str, list[Column]] = {}
    for place, rule in enumerate(rules):
        site = isinstance(rule, SiteRule)
        entry = F.struct(
            F.lit(rule.pattern).alias("pattern"),
            F.lit(len(rule.text) if site else -place).alias("length"),
            F.lit(rule.text if site else rule.name).alias("name"),
            F.lit(rule.verdict if site else "word").alias("verdict"),
        )
        rarest = min(sorted(rule.tokens), key=lambda t: counts.get(t, 0), default="")
        index.setdefault(rarest, []).append(entry)
    target = F.concat("__host", "__path")
    keys = F.concat(url_tokens(target), F.array(F.lit("")))  # rules without a whole literal stand under the empty token
    kind = "array<struct<pattern:string,length:int,name:string,verdict:string>>"
    if index:
        by_token = F.create_map(*[x for token, entries in index.items() for x in (F.lit(token), F.array(*entries))])
        fetched = F.flatten(F.filter(F.transform(keys, lambda t: F.try_element_at(by_token, t)), lambda x: x.isNotNull()))
    else:
        fetched = F.array().cast(kind)
    out = (
        pages.withColumns({"__host": F.coalesce(host, F.lit("")), "__path": F.coalesce(path, F.lit(""))})
        .withColumn("__hits", F.filter(fetched, lambda r: F.regexp_like(target, r["pattern"])))
        .withColumn("__site", F.array_max(F.transform(
            F.filter("__hits", lambda r: r["verdict"] != "word"),
            lambda r: F.struct(r["length"].alias("length"), r["name"].alias("name"), r["verdict"].alias("verdict")))))
        .withColumn("__word", F.array_max(F.transform(
            F.filter("__hits", lambda r: r["verdict"] == "word"),
            lambda r: F.struct(r["length"].alias("length"), r["name"].alias("name")))))
    )
    return out.withColumns({
        "host": F.col("__host"),
        "path": F.col("__path"),
        "rule": F.col("__site.name"),
        "verdict": F.when(F.col("__site").isNotNull(), F.col("__site.verdict"))
        .when(F.col("__word").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
        "word_rule": F.when(F.col("__site").isNull(), F.col("__word.name")),
    }).drop("__host", "__path", "__hits", "__site", "__word")
