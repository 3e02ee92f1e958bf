"""URL filters: host rules, then a weighted vocabulary searched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of which one is enough to reject.
STRICT_TERMS = ("adult", "camgirls", "casino", "escort", "hentai", "milf", "nsfw", "porn", "porno", "sex", "viagra", "xxx")
#: Terms of which several different ones are needed.
SOFT_TERMS = ("bet", "cam", "dating", "free", "girls", "hot", "lottery", "naked", "nude", "pills", "poker", "sexy", "slots", "win")

SCHEMA = "rule string, verdict string, strict_hits long, soft_hits long"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules_of(*lines: str) -> tuple[Rule, ...]:
    """Rules from lines such as "block example.com/de/"."""
    out = []
    for line in lines:
        verdict, _, where = line.partition(" ")
        host, slash, path = where.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return tuple(out)


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term.lower(), (kind, term.lower()))
    if len(found):
        found.make_automaton()
    return found


def hits(found, text: str) -> tuple[int, int]:
    """Numbers of different strict and soft terms that stand in text between characters that are no ASCII letters or digits."""
    seen = {1: set(), 2: set()}
    if len(found):
        n = len(text)
        for end, (kind, term) in found.iter(text):
            start = end - len(term) + 1
            if not (start and text[start - 1].isascii() and text[start - 1].isalnum()) and not (end + 1 < n and text[end + 1].isascii() and text[end + 1].isalnum()):
                seen[kind].add(term)
    return len(seen[2]), len(seen[1])


def best_rule(by_host: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """The longest rule whose host is host or a parent domain of it and whose path path starts with; of equals, the longer host, then block."""
    best, rest = None, host
    while True:
        for rule in by_host.get(rest, ()):
            if path.startswith(rule.path) and (best is None or (len(rule.text), len(rule.host), rule.verdict == "block") > (len(best.text), len(best.host), best.verdict == "block")):
                best = rule
        dot = rest.find(".")
        if dot < 0:
            return best
        rest = rest[dot + 1 :]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_needed: int = 2, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits) for every row of pages.

    The longest fitting rule decides; where none fits, one strict term or soft_needed different soft terms
    of the vocabulary, standing between boundaries anywhere in the lower-cased url, block it. A null url has
    an empty host and path and no hits, and so is allowed, as is an empty one. Repeated rows give repeated
    results, other columns are not read, an empty table gives an empty result, and a long url is searched
    whole. The work is a map over Arrow batches: rules and terms are parameters, held once a task.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host.lower(), []).append(rule)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            out: list[tuple] = []
            for url, host, path in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n_strict, n_soft = hits(found, (url or "").lower())
                rule = best_rule(by_host, host, path)
                verdict = rule.verdict if rule else "block" if n_strict or n_soft >= soft_needed else "allow"
                out.append((rule.text if rule else None, verdict, n_strict, n_soft))
            columns = [list(x) for x in zip(*out, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=[id_column, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    read = pages.select(F.col(id_column), F.col(url_column).alias("_url"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    kind = dict(read.dtypes)[id_column]
    return read.mapInArrow(judged, f"`{id_column}` {kind}, host string, path string, {SCHEMA}")
