"""URL rules in a sorted digest array.

The array is one file: the sorted 64-bit xxhash keys of all rule strings (host suffix followed by path prefix), the place
of each string, the strings themselves and one verdict byte each. Spark hands the file to every executor, each Python
worker maps it into memory, and a batch of URLs probes it at once: for every host suffix and every path length that occurs
in the rules there is one candidate string; its key is looked up by vectorised binary search, and a hit counts only if the
stored string equals the candidate, so colliding keys are harmless. Suffixes longer than any rule's host can't match and
aren't probed, so a URL costs at most (labels in the longest rule host's length) x (path lengths in the rules) probes, however
long its host and the list are.

Defined cases: a null URL or one without "://" has an empty host and path and meets no rule; repeated rows are judged one by
one; other columns are ignored; among rules that fit the longest string wins (on a tie the longer host); of two rules with
the same string the last given holds; a URL that meets no rule gets the default verdict.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm.handout import hand_out
from ripplegraph.runtime import ship

MAGIC = np.uint64(0x5249504C55524C31)
VERDICTS = ("allow", "block")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    cut = rest.find("/", 0, end)
    cut = end if cut < 0 else cut
    return rest[:cut].translate(LOWER), rest[cut:end]


def write_array(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """rules: (verdict, host, path prefix). Little-endian 64-bit words: magic, n, number of path lengths, the longest
    host's length, path lengths, keys, places; then verdicts and strings."""
    held = {(host.translate(LOWER) + prefix).encode("utf-8", "surrogatepass"): (VERDICTS.index(verdict), len(prefix), len(host)) for verdict, host, prefix in rules}
    rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, (v, _, _) in held.items())
    lengths = sorted({n for _, n, _ in held.values()})
    longest = max((n for _, _, n in held.values()), default=0)
    places = np.zeros(len(rows) + 1, np.uint64)
    np.cumsum([len(s) for _, s, _ in rows], out=places[1:])
    with open(path, "wb") as f:
        f.write(np.array([MAGIC, len(rows), len(lengths), longest, *lengths], np.uint64).tobytes())
        f.write(np.array([k for k, _, _ in rows], np.uint64).tobytes())
        f.write(places.tobytes())
        f.write(bytes(v for _, _, v in rows))
        f.write(b"".join(s for _, s, _ in rows))


class DigestArray:
    def __init__(self, path: str):
        if os.path.getsize(path) < 32:
            raise ValueError(f"{path} is not a digest array")
        raw = np.memmap(path, np.uint8, "r")
        magic, n, m, self.longest = (int(x) for x in raw[:32].view(np.uint64))
        if magic != int(MAGIC):
            raise ValueError(f"{path} is not a digest array")
        at = 32 + 8 * m
        self.lengths = [int(x) for x in raw[32:at].view(np.uint64)]
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.places = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.verdicts = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.strings = raw[at + 17 * n + 8 :]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.places[i]) : int(self.places[i + 1])].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The number of each candidate's rule, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(candidates), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys)) if len(self.keys) else ():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal keys stand side by side
                if self.string(j) == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The number of the rule that holds for each URL, or -1."""
        candidates, owner, rank = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            prefixes = [path[:n] for n in self.lengths if n <= len(path)]
            suffix = host if len(host) <= self.longest else host[-self.longest - 1 :].partition(".")[2]
            while suffix:
                for p in prefixes:
                    candidates.append((suffix + p).encode("utf-8", "surrogatepass"))
                    owner.append(i)
                    rank.append((len(suffix) + len(p), len(suffix)))
                suffix = suffix.partition(".")[2]
        best: dict[int, tuple] = {}
        for k, j in enumerate(self.find(candidates)):
            if j >= 0:
                best[owner[k]] = max(best.get(owner[k], ((0, 0), -1)), (rank[k], int(j)))
        return [best.get(i, (None, -1))[1] for i in range(len(hosts))]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages(page_id, url) to (page_id, host, path, rule, verdict)."""
    ship(pages.sparkSession)
    name = hand_out(pages.sparkSession, "url-rules", lambda path: write_array(rules, path))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = (list(x) for x in zip(*map(host_and_path, b["url"].to_pylist()), strict=True)) if b.num_rows else ([], [])
            found = array.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [
                    b["page_id"],
                    pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()),
                    pa.array([array.string(j).decode("utf-8", "surrogatepass") if j >= 0 else None for j in found], pa.string()),
                    pa.array([VERDICTS[array.verdicts[j]] if j >= 0 else default for j in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^?#]*', 0) END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '(?s)^[^/]*', 0)) + 1) AS path FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
