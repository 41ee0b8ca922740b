"""URL filter: rules indexed by their rarest literal token.

A rule is a pattern. What it needs is read from the parsed pattern: literal tokens (runs of ASCII letters and
digits) between two places where a token must end, so that every URL it fits holds them whole; an
alternative needs one of several. One Spark pass counts how many URLs hold each of these tokens,
and each rule is filed under its rarest one (or the rarest set of alternatives). A URL's tokens
fetch the rules filed under them, and only the regular expressions of those run; rules that need
no whole token run on every URL. Host rules of which the longest wins come first; pattern rules
decide for URLs that no host rule fits, and the rest is allowed.

A null URL, or one without `://`, has an empty host and path and fits no rule. Repeated rows are
judged one by one; an empty table gives an empty result; other columns play no part. The list of
rules is an argument and so fits the driver; the index sent to the tasks has one entry per rule.
"""

import itertools
import re
import re._parser as parser
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import ascii_lower, quoted

TOKEN = "[A-Za-z0-9]+"
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Patterns over host and path for URLs that no host rule fits.
PATTERNS = (
    ("block", r"(?:^|[./-])(?:cheap|discount)-(?:pills|meds)[./-]"),
    ("block", r"(?:^|[./-])casino[./-]"),
)
MOST_ALTERNATIVES = 64
EDGE, OPEN = "edge", "open"  # a token must end here; nothing is known here
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


class Rule(NamedTuple):
    verdict: str
    name: str | None  # None for a pattern, which decides only where no named rule fits
    pattern: str
    needs: tuple[tuple[str, ...], ...]  # of each of these sets, a URL that fits holds a token


def _steps(parsed) -> list:
    """A parsed pattern as EDGE, OPEN, and lists of alternative pieces of a token."""
    out = []
    for kind, of in parsed:
        if kind is parser.LITERAL:
            out.append([chr(of)] if chr(of) in LETTERS else EDGE)
        elif kind is parser.AT:
            out.append(OPEN if of is parser.AT_NON_BOUNDARY else EDGE)
        elif kind is parser.IN and all(k is parser.LITERAL and chr(v) not in LETTERS for k, v in of):
            out.append(EDGE)
        elif kind is parser.IN and all(k is parser.LITERAL and chr(v) in LETTERS for k, v in of):
            out.append([chr(v) for _, v in of])
        elif kind is parser.SUBPATTERN and not of[1] and not of[2]:
            out += _steps(of[3])
        elif kind is parser.BRANCH:
            ways = [_steps(way) for way in of[1]]
            if all(way == [EDGE] for way in ways):
                out.append(EDGE)
            elif all(way and all(isinstance(x, list) and len(x) == 1 for x in way) for way in ways):
                out.append(["".join(x[0] for x in way) for way in ways])
            else:
                out.append(OPEN)
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and of[0] > 0 and set(map(str, _steps(of[2]))) == {EDGE}:
            out.append(EDGE)
        else:
            out.append(OPEN)
    return out


def needed(pattern: str, flags: int = 0) -> tuple[tuple[str, ...], ...]:
    """Sets of tokens: a text in which `pattern` is found holds one of each set as a whole token.

    Options inside the pattern, such as ignoring case, make nothing needed.
    """
    parsed = parser.parse(pattern, flags)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    found, part = [], None  # part: pieces since the last edge; None after something open
    for step in _steps(parsed):
        if step is EDGE:
            ways = 1
            for pieces in part or ():
                ways *= len(pieces)
            if part and ways <= MOST_ALTERNATIVES:
                found.append(tuple(sorted({"".join(x) for x in itertools.product(*part)})))
            part = []
        elif step is OPEN or part is None:
            part = None
        else:
            part.append(step)
    return tuple(found)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for `host`, its subdomains, and paths that start with `path`."""
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = re.match(r"(?:.*[^A-Za-z0-9])?", path, re.S)[0]  # what follows may be part of a longer token
    return Rule(verdict, host + path, pattern, tuple((t,) for t in re.findall(TOKEN, f"{host}/{whole}")))


def all_rules(rules: Iterable = RULES, patterns: Iterable = PATTERNS) -> list[Rule]:
    return [host_rule(*r) for r in rules] + [
        Rule(verdict, None, f"(?s:.*?)(?:{pattern})", needed(pattern)) for verdict, pattern in patterns
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return ascii_lower(host), path


def rarest_tokens(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, list[int]]:
    """Rules (by number) under their rarest token or tokens; under "" those that need none."""
    known = sorted({t for rule in rules for tokens in rule.needs for t in tokens})
    host, path = host_and_path(quoted(url))
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(TOKEN), F.lit(0)))
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in known], "token string")
    counts = (
        pages.select(F.explode(tokens).alias("token")).join(F.broadcast(wanted), "token")
        .groupBy("token").count()
    )
    found = {r["token"]: r["count"] for r in counts.collect()}  # a row per token of a rule at most
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for token in min(rule.needs, key=lambda ts: (sum(found.get(t, 0) for t in ts), ts), default=("",)):
            index.setdefault(token, []).append(i)
    return index


def judge(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest host rule that fits, or null), verdict."""
    rules = all_rules() if rules is None else rules
    index = rarest_tokens(pages, rules, url)
    host, path = host_and_path(quoted(url))
    parts = pages.select(quoted(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        tokens = re.compile(TOKEN)

        def one(host: str, path: str) -> tuple[str | None, str]:
            text = host + path
            near = {*index.get("", ()), *(i for t in {*tokens.findall(text)} for i in index.get(t, ()))}
            fits = [rules[i] for i in near if host and compiled[i].match(text)]
            named = max((r for r in fits if r.name), key=lambda r: (len(r.name), r.name), default=None)
            if named:
                return named.name, named.verdict
            return None, "block" if any(r.verdict == "block" for r in fits) else "allow"

        for batch in found:
            answers = [one(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            names, verdicts = zip(*answers) if answers else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(batches, schema)
