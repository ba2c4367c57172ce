"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse, each closed by a NUL, so that a
host and all its subdomains share a prefix and a rule's host is an interval
of keys.  URLs are range-partitioned and sorted by (key, path); a sweep over
each sorted partition merges them with the sorted rules and keeps a stack of
the intervals that are open, each nested in the one below.  A URL asks the
open intervals for the longest rule whose path its own path starts with.

One shuffle of (id, host, path), by range: a very common host is cut by path
and id.  Rules travel as a broadcast of checked size; larger rule sets are
swept in slices over the same sorted partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000  # swept at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split(".")))


class RuleSweep:
    """Sorted rules and a stack of open host intervals; keys must come in order."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        hosts: dict[str, tuple[str, dict[str, str]]] = {}
        for host, path, verdict in sorted(rules, reverse=True):  # of equal rules 'allow' comes last and wins
            hosts.setdefault(host_key(host), (host, {}))[1][path] = verdict
        self.keys = sorted(hosts)
        self.frames = [(hosts[k][0], hosts[k][1], sorted({len(p) for p in hosts[k][1]}, reverse=True)) for k in self.keys]
        self.restart()

    def restart(self) -> None:
        self.next, self.stack, self.key = 0, [], None

    def move(self, key: str) -> None:
        """Advance the sweep to ``key``: close what ended before it, open what begins up to it."""
        if key == self.key:
            return
        if self.key is not None and key < self.key:
            self.restart()
        self.key = key
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            k = self.keys[self.next]
            if key.startswith(k):
                self.stack.append(self.next)
            self.next += 1

    def best(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; equally long: the more specific host."""
        found = None
        for at in self.stack:
            host, paths, lengths = self.frames[at]
            for n in lengths:
                if n <= len(path) and (v := paths.get(path[:n])) is not None:
                    rule = host + path[:n]
                    if found is None or len(rule) >= len(found[0]):
                        found = (rule, v)
                    break
        return found


def _weight(rule: str) -> tuple[int, int]:
    """Length of a rule and of its host: of equally long fitting rules the longer host is the more specific one."""
    cut = rule.find("/")
    return len(rule), cut if cut >= 0 else len(rule)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", max_rules: int = MAX_RULES) -> DataFrame:
    """(``id_col``, host, path, rule, verdict) for every row of ``urls`` (columns ``id_col``, url).

    ``rules`` has host, path and verdict.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's path; the longest
    fitting rule (host and path together) decides, on equal length that of the
    more specific host; a rule given with both verdicts allows.  No rule fits:
    rule is null and the verdict ``default``.  A null URL or one without
    ``://`` has an empty host and path, which no rule fits.  Rules with a null
    in any column are ignored; repeated rows are judged one by one; other
    columns are ignored; empty tables give empty results.
    """
    missing = [c for c in (id_col, "url") if c not in urls.columns] + [c for c in ("host", "path", "verdict") if c not in rules.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    host, path = host_and_path(F.col("url").cast("string"))
    keyed = urls.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\0"), F.lit("\0"))
    out = keyed.withColumn("_key", key).repartitionByRange("_key", "path", "_id").sortWithinPartitions("_key", "path")
    out = out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    clean = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict")).dropna().distinct()
    count = clean.count()
    slices = -(-count // max_rules)
    for k in range(slices):
        part = clean.where(F.pmod(F.xxhash64("host", "path"), F.lit(slices)) == k) if slices > 1 else clean
        shared = urls.sparkSession.sparkContext.broadcast([(r.host, r.path, r.verdict) for r in part.toLocalIterator()])

        def sweep(batches, shared=shared):
            s = RuleSweep(shared.value)
            for b in batches:
                rules_, verdicts = b.column("rule").to_pylist(), b.column("verdict").to_pylist()
                for i, (key, path) in enumerate(zip(b.column("_key").to_pylist(), b.column("path").to_pylist(), strict=True)):
                    s.move(key)
                    if s.stack and (got := s.best(path)) and (rules_[i] is None or _weight(got[0]) > _weight(rules_[i])):
                        rules_[i], verdicts[i] = got
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("host"), b.column("path"), b.column("_key"), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], ["_id", "host", "path", "_key", "rule", "verdict"])

        out = out.mapInArrow(sweep, out.schema)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
