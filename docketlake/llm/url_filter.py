"""URL rules found by their rarest literal token.

A rule is a regular expression over "host + path" with a literal part.  Each
rule is filed under the token of its literals that the fewest URLs hold.  A URL
fetches the rules filed under its own tokens, and only those run their regular
expression.  Of the rules that fit, the longest named rule wins; without one, the longest
pattern (ties: block, then the name); a URL without a fitting rule is allowed.
A pass holds a bounded number of rules; further rules take further passes over
the URLs, each of which keeps the better of its own rule and the one before.

Rows: a null URL or one without "://" has an empty host and path.  Repeated rows
are judged one by one; a null id is kept.  Host letters A-Z are lower-cased.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import lists, map_batches, stage

TOKEN = re.compile(r"[a-z0-9]+")
SPLIT = re.compile(r"[^a-z0-9]+")
# Rules that one pass holds in a worker.
RULES_PER_PASS = 20_000


@dataclass(frozen=True)
class Rule:
    """``literals``: text that every URL the pattern fits holds as whole tokens; ``name`` is what the result shows."""

    name: str
    verdict: str
    pattern: str
    literals: str
    contract: bool = False

    @property
    def tokens(self) -> list[str]:
        return TOKEN.findall(self.literals.lower())


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains, and paths that start with ``path``.

    A path counts towards the literals up to its last full token only: what
    follows in the URL may lengthen an unfinished one.
    """
    after = ".*" if path else "(?:/.*)?"
    pattern = rf"(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}{after}"
    literals = f"{host} {re.sub('[A-Za-z0-9]+$', '', path)}"
    return Rule(host.lower() + path, verdict, pattern, literals, True)


# Fixed: the rules the result names, as (verdict, host, path).
CONTRACT_RULES = [host_rule(*r) for r in (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)]
# The method's own rules: kinds of hosts that training data leaves out.
HOST_PATTERNS = [Rule(f"host:{literal}", "block", pattern, literal) for literal, pattern in (
    ("spam farm", r"(?:[^/]*\.)?spam-farm(?:\.[^/]*)?(?:/.*)?"),
    ("cheap pills", r"(?:[^/]*\.)?cheap-pills(?:\.[^/]*)?(?:/.*)?"),
    ("adult", r"(?:[^/]*\.)?adult-[^/.]*(?:\.[^/]*)?(?:/.*)?"),
    ("casino", r"(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/.*)?"),
)]


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def lower(text: str) -> str:
    """A-Z to lower case, nothing else."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules; bounded by the rules."""
    spark = urls.sparkSession
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    wanted = spark.createDataFrame([(n,) for n in names], "token string")
    held = urls.select(F.explode(F.array_distinct(F.split(
        F.translate(F.coalesce("url", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "[^a-z0-9]+"))).alias("token"))
    counted = held.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r.token: r.n for r in counted.collect()}


def rank(rule: Rule) -> tuple:
    """Named rules come first; among them, and among patterns, the longest name wins."""
    return rule.contract, len(rule.name), rule.verdict == "block", rule.name


class RuleIndex:
    """Rules filed under their rarest token; rules without any token are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule in rules:
            entry = (re.compile(rule.pattern, re.DOTALL), rule)
            key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
            (self.always if key is None else self.by_token.setdefault(key, [])).append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        where = host + path
        tokens = {*SPLIT.split(lower(where))}
        candidates = [e for t in tokens for e in self.by_token.get(t, ())] + self.always
        return max((rule for pattern, rule in candidates if pattern.fullmatch(where)), key=rank, default=None)


JUDGED = "page_id long, host string, path string, rule string, verdict string, pattern string"


def _judge(urls: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """One pass with ``rules``, over URLs or over what an earlier pass with other rules has judged."""
    built: list[RuleIndex] = []
    first = "url" in urls.columns

    def work(batch):
        if not built:
            built.append(RuleIndex(rules, counts))
        if first:
            ids, texts = lists(batch, "page_id", "url")
            parts, held = [url_parts(t) for t in texts], [None] * len(texts)
        else:
            ids, hosts, paths, named, verdicts, patterns = lists(
                batch, "page_id", "host", "path", "rule", "verdict", "pattern")
            parts = list(zip(hosts, paths))
            held = [None if n is None and p is None else Rule(p if n is None else n, v, "", "", n is not None)
                    for n, v, p in zip(named, verdicts, patterns)]
        out = {"page_id": ids, "host": [], "path": [], "rule": [], "verdict": [], "pattern": []}
        for (host, path), before in zip(parts, held):
            rule = max((r for r in (before, built[0].best(host, path)) if r), key=rank, default=None)
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(rule.name if rule and rule.contract else None)
            out["pattern"].append(rule.name if rule and not rule.contract else None)
            out["verdict"].append(rule.verdict if rule else "allow")
        return out

    return map_batches(urls, work, JUDGED)


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, per_pass: int = RULES_PER_PASS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row of ``pages`` (page_id, url, ...).

    ``rule`` is the named host rule that decided, else null; ``pattern`` the
    method's own rule that decided, else null.  Named rules come before patterns.
    """
    rules = CONTRACT_RULES + HOST_PATTERNS if rules is None else rules
    urls = pages.select("page_id", "url")
    counts = token_counts(urls, rules)
    judged = _judge(urls, rules[:per_pass], counts)
    for start in range(per_pass, len(rules), per_pass):
        # written between passes, so that a worker never holds the rules of two
        judged = _judge(stage(judged, "judged"), rules[start:start + per_pass], counts)
    return judged
