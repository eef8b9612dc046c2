"""URL rules by a cascade of Bloom filters over the corpus's keys.

A rule is a host suffix and a path prefix, written as one key such as
``com/en/``. Every url has a few candidate keys; all candidate keys of the
corpus are the key universe. The first filter of a cascade holds the listed
keys, the second the universe's false positives of the first, the third the
listed keys that the second lets through, and so on until nothing is wrong.
Over that universe membership is then exact, with neither a join nor the list
at hand, in a few bits a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The list comes with the call and is sent to every task, so its size is checked.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    key: str
    verdict: str

    @property
    def host(self) -> str:
        return self.key.partition("/")[0]

    @property
    def path(self) -> str:
        return self.key[len(self.host) :]


class Bloom:
    """A Bloom filter over 64-bit hashes; ``salt`` keeps the levels of a cascade independent."""

    def __init__(self, hashes: np.ndarray, rate: float, salt: int):
        n = max(1, len(hashes))
        self.m = max(64, int(math.ceil(-n * math.log(rate) / math.log(2) ** 2)))
        self.k = max(1, round(self.m / n * math.log(2)))
        self.k = min(self.k, max(1, math.ceil(-math.log2(rate))))
        self.salt = np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        bits = np.zeros(self.m, bool)
        for at in self._places(hashes):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a = _mixed(hashes ^ self.salt)
        b = _mixed(a) | np.uint64(1)
        for i in range(self.k):
            yield ((a + np.uint64(i) * b) % np.uint64(self.m)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and two odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Cascade:
    """Exact membership in ``listed`` for every hash of ``listed`` and ``others``."""

    def __init__(self, first: Bloom, listed: np.ndarray, others: np.ndarray):
        self.levels = [first]
        inside, outside = listed, others[first.holds(others)] if len(others) else others
        while len(outside):
            level = Bloom(outside, 0.5, len(self.levels) + 1)
            self.levels.append(level)
            inside, outside = outside, inside[level.holds(inside)]
            if len(self.levels) > 200:
                raise ValueError("two keys share a hash")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        member = np.zeros(len(hashes), bool)
        at = np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            at = at[level.holds(hashes[at])]
            member[at] = i % 2 == 0
            if not len(at):
                break
        return member


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: then up to ``?``, ``#`` or the end. Both are empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys of a url that can be listed, longest first.

    Host suffixes of as many labels as a rule's host has, with path prefixes
    of as many characters as a rule's path has.
    """
    labels = F.split(host, r"\.")
    out = []
    for n in sorted({r.host.count(".") + 1 for r in rules}, reverse=True):
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        for m in sorted({len(r.path) for r in rules}, reverse=True):
            fits = (F.size(labels) >= n) & (F.length(path) >= m)
            out.append(F.when(fits, F.concat(suffix, F.substring(path, 1, m))))
    keys = F.array_distinct(F.array_compact(F.array(*out))) if out else F.array().cast("array<string>")
    return F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))


def build_cascades(keyed: DataFrame, rules: list[Rule], most_again: int = 8) -> dict[str, Cascade]:
    """One cascade a verdict over the universe: the distinct hashes of the ``keys`` of ``keyed``, computed once.

    The first filter's rate is about the list's size over the universe's, so
    that about as many false positives come back as there are rules. Only
    these come to the driver; should far more do, the rate is lowered, and
    after ``most_again`` rates that let too many through it is an error.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to every task")
    spark = keyed.sparkSession
    universe = cut_lineage(keyed.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h")).distinct())
    size = universe.count()
    hashes = dict(zip([r.key for r in rules], _key_hashes(spark, [r.key for r in rules])))
    out = {}
    for verdict in sorted({r.verdict for r in rules}):
        listed = np.array([hashes[r.key] for r in rules if r.verdict == verdict], np.uint64)
        rate, bound = min(0.5, math.sqrt(0.5) * len(listed) / max(1, size)), 64 * len(listed) + 10_000
        for _ in range(most_again):
            first = Bloom(listed, rate, 1)
            seen = universe.mapInArrow(_passing(first), "h long").limit(bound + 1).toArrow().column("h").to_numpy()
            if len(seen) <= bound:
                break
            rate /= 4
        else:
            raise RuntimeError(f"more than {bound} false positives at a rate of {rate:.2g}")
        out[verdict] = Cascade(first, listed, np.setdiff1d(seen.view(np.uint64), listed))
    return out


def _key_hashes(spark, keys: list[str]) -> list[int]:
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.xxhash64("key").alias("h")).collect()
    found = {r.key: r.h & (1 << 64) - 1 for r in rows}
    return [found[k] for k in keys]


def _passing(first: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h[first.holds(h)].view(np.int64))], names=["h"])

    return run


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (the longest that fits, else null) and verdict.

    Without a rule the verdict is ``default``: the cascades hold none of the
    url's keys. Null urls and urls without ``://`` have an empty host and path
    and fit no rule. Repeated rows repeat; an empty table gives no rows; other
    columns are ignored.
    """
    rules = list(rules)
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    cascades = pages.sparkSession.sparkContext.broadcast(build_cascades(keyed, rules) if rules else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(3), batch.column(4)
            flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            names = keys.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(hashes.offsets.to_numpy()))
            verdict = np.full(len(flat), None, object)
            for name, cascade in cascades.value.items():
                verdict[cascade.holds(flat)] = name
            hit = np.flatnonzero(verdict != None)  # noqa: E711
            rows, first = np.unique(row[hit], return_index=True)
            rule, said = [None] * batch.num_rows, [default] * batch.num_rows
            for r, i in zip(rows.tolist(), hit[first].tolist()):
                rule[r], said[r] = names[i].as_py(), verdict[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    hashed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
