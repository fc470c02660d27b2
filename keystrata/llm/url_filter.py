"""URL filter: host and path rules first, then pattern rules found through their rarest literal token.

Every pattern rule names literal tokens (lower-case runs of letters and digits) that any URL it matches must hold; what has
alternatives is a rule for each. A rule is indexed under the one of its tokens that the fewest URLs of the corpus hold. The
index is a constant hash table in the plan: a URL's tokens each look up one bucket, which gives the numbers of the candidate rules, and only
those run their regular expression. What a URL costs doesn't grow with rules whose token it doesn't hold.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is allowed by the patterns
unless one matches its text; rules without a literal run on every URL; repeated rows give repeated rows; an empty table gives no rows;
other columns are ignored. Expressions have no nested repeats, so they take time in proportion to the URL.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Pattern:
    """verdict if regex is found in the lower-cased URL; each of literals is a whole token of any such URL."""

    verdict: str
    regex: str
    literals: tuple[str, ...]


#: (verdict, host, path): fits the host and all its subdomains where the path starts with path.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

START, END, GAP = r"(^|[^a-z0-9])", r"([^a-z0-9]|$)", r"[^a-z0-9]+"


def words(verdict: str, *terms: str) -> list[Pattern]:
    """A rule for each term: its words as whole tokens, one behind the other."""
    return [Pattern(verdict, START + GAP.join(t.split()) + END, tuple(dict.fromkeys(t.split()))) for t in terms]


#: Terms of gambling, drugs, adult pages and traps for crawlers, and what is allowed in spite of them.
PATTERNS = [
    *words("block", "casino", "casino win", "casino bonus", "online casino", "poker bonus", "free spins", "free bets", "sports betting", "slot machine", "slot machines", "roulette", "jackpot"),
    *words("block", *(f"{how} {what}" for what in ("viagra", "cialis", "xanax", "tramadol", "steroids") for how in ("buy", "cheap", "order"))),
    *words("block", "porn", "xxx", "hentai", "escorts", "camgirls", "payday loan", "payday loans", "replica watches", "essay writing service"),
    *words("block", "wp login php", "wp admin", "xmlrpc php", "phpmyadmin", "cgi bin", "add to cart", "session id"),
    *[Pattern("block", rf"[?&]action={x}{END}", ("action", x)) for x in ("login", "logout", "register", "edit")],
    *words("allow", "casino museum", "casino history", "casino royale film", "porn addiction help", "gambling help"),
]


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def rarest_index(df: DataFrame, url: str, patterns: list[Pattern]) -> dict[str, list[Pattern]]:
    """Patterns by their rarest literal over all URLs; "" holds those without a literal. One count a literal comes to the driver."""
    literals = sorted({x for p in patterns for x in p.literals})
    seen = dict.fromkeys(literals, 0)
    if literals:
        held = df.select(F.explode(tokens(F.col(url))).alias("_t")).where(F.col("_t").isin(literals)).groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
        seen |= {r["_t"]: r["_c"] for r in held.collect()}
    index: dict[str, list[Pattern]] = {}
    for p in patterns:
        index.setdefault(min(p.literals, key=lambda x: (seen[x], x)) if p.literals else "", []).append(p)
    return index


def candidates(words: Column, index: dict[str, list[Pattern]], patterns: list[Pattern]) -> Column:
    """Numbers of the rules that a URL's tokens fetch, with those that have no literal."""
    number = {id(p): i for i, p in enumerate(patterns)}
    entries = {t: [number[id(p)] for p in rules] for t, rules in index.items() if t}
    size = max(1, len(entries))
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for t, rules in sorted(entries.items()):
        buckets[zlib.crc32(t.encode()) % size].append({"t": t, "r": rules})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t:string,r:array<int>>>>")  # a constant: folded when planned
    bucket = lambda t: F.get(table, (F.crc32(t.cast("binary")) % size).cast("int"))
    found = F.flatten(F.flatten(F.transform(words, lambda t: F.transform(F.filter(bucket(t), lambda x: x["t"] == t), lambda x: x["r"]))))
    always = [number[id(p)] for p in index.get("", [])]
    return F.concat(found, F.array(*map(F.lit, always))) if always else found


def pattern_verdict(df: DataFrame, url: str, patterns: list[Pattern]) -> Column:
    """allow or block: an allowing pattern beats blocking ones; without a match a URL is allowed."""
    if not patterns:
        return F.lit("allow")
    low = F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    regex = F.from_json(F.lit(json.dumps([p.regex for p in patterns])), "array<string>")
    allows = F.from_json(F.lit(json.dumps([p.verdict == "allow" for p in patterns])), "array<boolean>")

    def judged(rules: Column) -> Column:
        hit = lambda i: F.rlike(low, F.get(regex, i))
        return F.when(F.exists(rules, lambda i: F.get(allows, i) & hit(i)), "allow").when(F.exists(rules, lambda i: ~F.get(allows, i) & hit(i)), "block").otherwise("allow")

    return let(candidates(tokens(F.col(url)), rarest_index(df, url, patterns), patterns), judged)


def filter_urls(df: DataFrame, key: str, url: str, rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(key, host, path, rule, verdict)."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    d = df.select(F.col(key).alias("_key"), u.alias("_url"), F.coalesce(rest, F.lit("")).alias("_rest"))
    host, path = F.regexp_extract("_rest", r"^[^/?#]*", 0), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    d = d.select("_key", "_url", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), pattern_verdict(d, "_url", patterns)
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return d.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def oracle(rules=HOST_RULES, patterns=PATTERNS) -> str:
    """DuckDB SQL for filter_urls over pages, every pattern run on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    hit = lambda v: " or ".join(f"regexp_matches(low, {q(p.regex)})" for p in patterns if p.verdict == v)
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = {q(h)} or host like {q('%.' + h)}) and starts_with(path, {q(p)})"
    rule = " ".join(f"when {fits(h, p)} then {q(h + p)}" for _, h, p in order)
    verdict = " ".join(f"when {fits(h, p)} then {q(v)}" for v, h, p in order)
    return f"""with a as (select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') rest,
      translate(coalesce(url, ''), '{UPPER}', '{LOWER}') low from pages),
    b as (select page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a)
    select page_id, host, path, case {rule} else null end as rule,
      case {verdict} when {hit("allow")} then 'allow' when {hit("block")} then 'block' else 'allow' end as verdict from b"""
