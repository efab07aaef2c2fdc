"""URL filter: pattern rules found through an index on their rarest literal token.

A rule's host labels and whole path segments are literal tokens that any URL it fits must
hold. The rule is filed under the one of them that the fewest URLs hold; a URL looks up
its own tokens, and only rules found that way have their regular expression run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import map_texts

TOKEN = re.compile(r"[a-z0-9]+")
URL = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains from a path on; or what `pattern` finds in host and path (lower-cased), whose literal tokens are `literals`."""

    host: str
    path: str
    action: str
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return self.pattern or f"{self.host}{self.path}"

    @property
    def regex(self) -> re.Pattern:
        if self.pattern:
            return re.compile(self.pattern, re.IGNORECASE)
        return re.compile(rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) or '(?=/|$)'}")

    @property
    def tokens(self) -> set[str]:
        """Tokens that a fitting URL holds: host labels, and path segments that the rule gives whole."""
        whole = self.path[: self.path.rfind("/") + 1]
        return set(self.literals) if self.pattern else set(TOKEN.findall(f"{self.host} {whole}".lower()))


def word_rule(word: str, action: str = "block") -> Rule:
    """A rule for URLs that hold `word` between characters that are no letters or digits."""
    return Rule("", "", action, rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", tuple(TOKEN.findall(word)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    found = URL.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def tokens_of(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(f"{host} {path}".lower()))


def filter_urls(pages: DataFrame, rules: list[Rule], others: list[Rule] = (), url: str = "url", default: str = "allow") -> DataFrame:
    """Adds `host`, `path`, `rule` and `verdict` to every row.

    The longest fitting rule of `rules` decides (of equally long ones the first in
    alphabetical order); `rule` is its text. Where none fits, `rule` is null and the
    verdict is block if a rule of `others` that blocks fits, else `default`. A null url
    has an empty host and path. Rows stay as they are, repeated ones too; columns of the
    four names are replaced. The rules are a parameter of the job and travel with it.
    """
    wanted = sorted({t for r in (*rules, *others) for t in r.tokens})
    # How many URLs hold each token that a rule has: one row per token of the rules.
    host_path = F.concat_ws(" ", F.regexp_extract(url, r"://([^/?#]*)", 1), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))
    held = pages.select(F.explode(F.array_intersect(F.split(F.lower(host_path), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if wanted else {}

    def index(some) -> tuple[dict, list]:
        filed, always = defaultdict(list), []
        for rule in some:
            own = rule.tokens
            (filed[min(own, key=lambda t: (counts.get(t, 0), t))] if own else always).append((len(rule.text), rule.text, rule.action, rule.regex))
        return dict(filed), always

    (main, main_all), (extra, extra_all) = index(rules), index(others)

    def fitting(filed: dict, always: list, tokens: set[str], target: str) -> list[tuple]:
        return [(-n, text, action) for t in tokens for n, text, action, regex in filed.get(t, ()) if regex.search(target)] + [(-n, text, action) for n, text, action, regex in always if regex.search(target)]

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(url).to_pylist():
            host, path = split_url(text)
            tokens, target = tokens_of(host, path), host + path
            fits = fitting(main, main_all, tokens, target)
            if fits:
                _, rule, verdict = min(fits)
            else:
                rule, verdict = None, "block" if any(a == "block" for _, _, a in fitting(extra, extra_all, tokens, target)) else default
            out.append((host, path, rule, verdict))
        return {name: pa.array([x[i] for x in out], pa.string()) for i, name in enumerate(("host", "path", "rule", "verdict"))}

    return map_texts(pages, url, run, "host string, path string, rule string, verdict string")
