"""URL filters by pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL must hold. The
rule stands in the index under the one of its tokens that the fewest URLs have; the tokens of
a URL fetch their rules, and only those run. DataFrame functions only; no shuffle but the
count of the rules' tokens.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path. Ranked rules compete by length, the others decide where none fits."""

    label: str
    regex: str
    action: str
    tokens: tuple[str, ...]
    ranked: bool = False


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's."""
    literal = host + path
    tokens = re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", literal)
    return Rule(literal, rf"^(?:[^/]*\.)?{re.escape(literal)}", action, tuple(t.lower() for t in tokens), True)


def word_rule(word: str, action: str = "block") -> Rule:
    """Fits where the words stand, in the host, between dots or hyphens."""
    return Rule(word, rf"^[^/]*(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", action, tuple(re.findall(TOKEN, word)))


HOST_RULES = [host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"),
              host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"),
              host_rule("block", "net", "/fr/")]
# Hosts of no use as training text.
PATTERNS = [word_rule(w) for w in ("casino", "bets", "poker", "pills", "viagra", "porn", "xxx", "escort", "payday", "torrent")] + [
    Rule(name, rf"{re.escape(name)}(?:/|$)", "block", tuple(re.findall(TOKEN, name)))
    for name in ("/adserver", "/doubleclick", "/wp-login.php", "/cgi-bin")]


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(subject: Column) -> Column:
    """The distinct tokens, and the empty one under which rules without a token stand."""
    found = F.regexp_extract_all(F.translate(subject, UPPER, UPPER.lower()), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def rarest_tokens(subjects: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """For each rule its token in the fewest rows; ties by the token's order. Counts all rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {r["token"]: r["n"] for r in subjects.select(F.explode(tokens_of(F.col("subject"))).alias("token"))
              .where(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for r in rules}


def rule_index(at: dict[Rule, str]) -> Column:
    """Buckets of rules by the hash of their token, as a constant."""
    buckets: list[list[dict]] = [[] for _ in range(1 << max(4, (2 * len(at)).bit_length()))]
    for rule, token in at.items():
        place = xxhash.xxh64_intdigest(token.encode(), 42) % len(buckets)
        buckets[place].append({"token": token, "label": rule.label, "regex": rule.regex, "action": rule.action,
                               "ranked": rule.ranked, "size": len(rule.label)})
    kind = "array<array<struct<token:string,label:string,regex:string,action:string,ranked:boolean,size:int>>>"
    return F.from_json(F.lit(json.dumps(buckets)), kind), len(buckets)


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict; columns of these names are replaced.

    The longest ranked rule that fits decides (equal lengths: the later label). Where none does,
    the URL is blocked if a pattern that blocks fits, else gets the default. Null URLs and those
    without `://` have empty host and path, no rule and the default. Rows are kept as they are.
    """
    rules = HOST_RULES + PATTERNS if rules is None else rules
    host, path = host_of(F.col(url)), path_of(F.col(url))
    index, size = rule_index(rarest_tokens(pages.select(F.concat(host, path).alias("subject")), rules))
    rows = pages.withColumns({"host": host, "path": path})
    subject = F.concat("host", "path")

    def fetch(token: Column) -> Column:
        bucket = F.element_at(index, (F.pmod(F.xxhash64(token), F.lit(size)) + 1).cast("int"))
        return F.filter(bucket, lambda r: r["token"] == token)

    # A power of two divides 2^64, so the remainder of the signed hash is that of the unsigned one.
    fits = F.filter(F.flatten(F.transform(tokens_of(subject), fetch)), lambda r: F.rlike(subject, r["regex"]))
    rows = rows.withColumn("_fits", fits)
    best = F.array_max(F.transform(F.filter("_fits", lambda r: r["ranked"]), lambda r: F.struct(r["size"], r["label"], r["action"])))
    blocked = F.exists("_fits", lambda r: ~r["ranked"] & (r["action"] == "block"))
    rows = rows.withColumn("_best", best)
    return rows.withColumns({"rule": F.col("_best.label"), "verdict": F.coalesce(
        F.col("_best.action"), F.when(blocked, "block").otherwise(default))}).drop("_fits", "_best")
