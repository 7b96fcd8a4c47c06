"""URL filters: rules are fetched by token, only fetched rules run a regular expression.

Each rule is a regular expression over host and path plus the literal tokens
that any URL it fits must contain as whole tokens. A rule is filed under the
one of its tokens that is rarest among the URLs judged. A URL's own tokens
fetch candidate rules from that index; all else is never tried.

The index is a hash table: an array with about two slots a token, where the
checksum of a token names its slot. Reading an array's element takes one step, so
a URL pays for its own tokens and the rules they fetch, whatever the number of
rules. The table is one constant of the plan (some 150 bytes a rule), so
everything is a projection over the URL table and no row moves. The URLs'
frequencies of rule tokens are counted first (one row per rule token comes back).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[A-Za-z0-9]+"
SITE, PATTERN = 1, 0  # a fitting site rule overrules every pattern rule


@dataclass(frozen=True)
class UrlRule:
    """``regex`` is searched in host + path; ``tokens`` occur in each match as whole tokens."""

    verdict: str
    regex: str
    tokens: tuple[str, ...]
    kind: int
    length: int
    name: str | None


def escaped(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", literal)


def site_rule(verdict: str, text: str) -> UrlRule:
    """``org/``, ``example.org/en/1``: a host with its subdomains, and a path prefix."""
    host, slash, path = text.partition("/")
    if not host or not slash:
        raise ValueError(f"a site rule is host/path, not {text!r}")
    whole = re.findall(TOKEN, host) + re.findall(rf"(?<![A-Za-z0-9])({TOKEN})(?=[^A-Za-z0-9])", f"/{path}")
    return UrlRule(verdict, rf"^([^/]*\.)?{escaped(host)}/{escaped(path)}", tuple(whole), SITE, len(text), text)


def pattern_rule(verdict: str, regex: str, *tokens: str) -> UrlRule:
    """A free regular expression with tokens that each match is sure to hold."""
    return UrlRule(verdict, regex, tokens, PATTERN, len(regex), None)


#: Pattern rules in force where no site rule fits.
DEFAULT_PATTERNS = (
    pattern_rule("block", r"^([^/]*\.)?ads-track\.", "ads", "track"),
    pattern_rule("block", r"/wp-admin/", "wp", "admin"),
    pattern_rule("block", r"/(user|account)/login(/|$)", "login"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


ENTRY = "struct<token:string,regex:string,kind:int,length:int,verdict:string,name:string>"


def _constant(value: object, kind: str) -> Column:
    """``value`` as one constant of the plan, read from one text however much it holds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _entry(token: str | None, rule: UrlRule) -> dict:
    return {"token": token, "regex": rule.regex, "kind": rule.kind, "length": rule.length,
            "verdict": rule.verdict, "name": rule.name}


def _token_counts(tokens: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each of the ``wanted`` tokens; one row a token reaches the driver."""
    known = tokens.sparkSession.range(1).select(F.explode(_constant(wanted, "array<string>")).alias("token"))
    held = tokens.select(F.explode("tokens").alias("token")).groupBy("token").count()
    return {row["token"]: row["count"] for row in held.join(known, "token", "left_semi").collect()}


def _slots(filed: dict[str, list[UrlRule]]) -> list[list[dict]]:
    """The hash table: at crc32(token) modulo its size, the rules filed under the token."""
    slots: list[list[dict]] = [[] for _ in range(2 * len(filed))]
    for token, rules in filed.items():
        slots[zlib.crc32(token.encode()) % len(slots)] += [_entry(token, rule) for rule in rules]
    return slots


def _fetched(index: list[list[dict]]) -> Column:
    """The rules that ``index`` files under one of the URL's ``tokens``."""
    table = _constant(index, f"array<array<{ENTRY}>>")

    def under(token: Column) -> Column:
        slot = F.pmod(F.crc32(token.cast("binary")), F.lit(len(index))).cast("int")
        return F.filter(F.get(table, slot), lambda rule: rule["token"] == token)

    return F.flatten(F.transform("tokens", under))


def judge_urls(
    pages: DataFrame,
    rules: Iterable[UrlRule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    The longest fitting site rule decides, then pattern rules (block before
    allow), then ``default``. Null URLs and URLs without ``://`` have empty
    host and path, fit no rule and get ``default``. Repeated rows are judged
    one by one; other columns of ``pages`` are neither read nor returned, so
    their names don't matter. An empty table gives no rows.
    """
    rules = list(rules)
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path")
    )
    key = F.concat("host", "path")
    parts = parts.select("*", F.array_distinct(F.regexp_extract_all(key, F.lit(TOKEN), F.lit(0))).alias("tokens"))

    wanted = sorted({token for rule in rules for token in rule.tokens})
    counts = _token_counts(parts, wanted) if wanted else {}
    filed: dict[str | None, list[UrlRule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda token: (counts.get(token, 0), token), default=None)
        filed.setdefault(rarest, []).append(rule)

    candidates = _constant([_entry(None, rule) for rule in filed.pop(None, [])], f"array<{ENTRY}>")
    if filed:
        candidates = F.concat(candidates, _fetched(_slots(filed)))
    fitting = F.filter(candidates, lambda rule: F.regexp_like(key, rule["regex"]))
    best = F.array_max(
        F.transform(
            fitting,
            lambda rule: F.struct(
                *(rule[part].alias(part) for part in ("kind", "length", "verdict", "name"))
            ),
        )
    )
    return parts.select("id", "host", "path", best.alias("best")).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
