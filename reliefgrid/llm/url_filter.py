"""URL rules and block list in a sorted digest array.

Entries ``host + path prefix`` are kept as one file: 64-bit xxhash keys in ascending order, then the offsets and bytes of the full
strings. Executors get the file through Spark and map it into memory, so workers of one machine share its pages. The candidates of a
batch of urls (each parent domain with each prefix of a stored length) are hashed, probed with one vectorised binary search, and
every hit is confirmed on the stored string, so two strings of one digest are told apart.

The longest fitting rule decides; without one, a fitting block-list entry blocks; all else is allowed.

Defined results: a url that is null, empty or without ``://`` has an empty host and path and is allowed; each row is judged by
itself, also when rows repeat; an empty table gives an empty table; other columns are not looked at. An empty rule list allows all.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.session import shared_folder

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hosts of the block list, with path prefixes.
BLOCKED = [("spam-farm.example.org", "/"), ("spam-farm.example.com", "/"), ("spam-farm.example.net", "/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIST_ENTRY, BLOCK_RULE, ALLOW_RULE = b"\x00", b"\x01", b"\x02"  # first byte of a stored string
HEADER = 2


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^(?>.*?://)([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Of what follows the first ``://``: the group is atomic, so a later one is never tried."""
    return F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1)


class DigestArray:
    """Sorted keys with their full strings, in one memory-mapped file: [n, bytes], keys, offsets, text."""

    def __init__(self, path: str):
        words = np.memmap(path, np.uint64, "r")
        n = int(words[0])
        self.keys = words[HEADER : HEADER + n]
        self.offsets = words[HEADER + n : HEADER + 2 * n + 1]
        self.text = np.memmap(path, np.uint8, "r", offset=8 * (HEADER + 2 * n + 1)) if words[1] else np.zeros(0, np.uint8)

    @staticmethod
    def packed(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
        """File content for (entry, first byte of what is stored); the same entry is kept once for each kind."""
        found = sorted({(xxhash.xxh64_intdigest(entry), kind + entry) for entry, kind in entries})
        texts = [text for _, text in found]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.uint64))).astype(np.uint64)
        head = np.array([len(found), int(offsets[-1])], np.uint64)
        keys = np.array([key for key, _ in found], np.uint64)
        content = head.tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(texts)
        return content + bytes(-len(content) % 8)

    def stored(self, i: int) -> bytes:
        return self.text[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def probe(self, candidates: list[bytes]) -> list[list[bytes]]:
        """For each candidate, the first bytes of the stored strings that equal it."""
        found: list[list[bytes]] = [[] for _ in candidates]
        if not len(self.keys) or not candidates:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        low, high = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(high > low).tolist():
            for k in range(low[i], high[i]):
                text = self.stored(k)
                if text[1:] == candidates[i]:
                    found[i].append(text[:1])
        return found


def publish(spark: SparkSession, content: bytes) -> str:
    """Hands the file to every executor and returns its name there; the same content is handed out once."""
    name = f"digests-{hashlib.sha256(content).hexdigest()[:32]}.bin"
    if any(str(x).endswith(name) for x in _listed(spark)):
        return name
    folder = shared_folder(spark)
    if folder is None:
        with open(os.path.join(tempfile.mkdtemp(prefix="digests-"), name), "wb") as f:
            f.write(content)
        spark.sparkContext.addFile(f.name)
        return name
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(content))
    out.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addFile(path.toString() if "://" in folder or folder.startswith("file:") else f"file://{path}")
    return name


def _listed(spark: SparkSession) -> list:
    found = spark.sparkContext._jsc.sc().listFiles()
    return [found.apply(i) for i in range(found.size())]


def parents(host: str) -> Iterator[str]:
    """The host and every domain above it, longest first."""
    while host:
        yield host
        _, _, host = host.partition(".")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[tuple[str, str]] = BLOCKED
) -> DataFrame:
    """page_id, host, path, rule (of the longest fitting rule, else null), verdict, listed (whether the block list has it)."""
    spark = pages.sparkSession
    entries = [((h + p).encode(), BLOCK_RULE if v == "block" else ALLOW_RULE) for h, p, v in rules]
    entries += [((h + p).encode(), LIST_ENTRY) for h, p in blocked]
    # entries are told apart by host and path; the path begins at the first slash, which no host has
    lengths = sorted({len(p.encode()) for _, p, *_ in [*rules, *blocked]}, reverse=True)
    name = publish(spark, DigestArray.packed(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(SparkFiles.get(name))
        for batch in batches:
            candidates, owner = [], []
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                whole = path.encode()
                fitting = [whole[:n] for n in lengths if n <= len(whole)]
                for domain in parents(host):
                    start = domain.encode()
                    for prefix in fitting:
                        candidates.append(start + prefix)
                        owner.append(row)
            rule: list[bytes | None] = [None] * len(hosts)
            blocks, listed = [False] * len(hosts), [False] * len(hosts)
            for entry, row, kinds in zip(candidates, owner, digests.probe(candidates), strict=True):
                for kind in kinds:
                    if kind == LIST_ENTRY:
                        listed[row] = True
                    elif rule[row] is None or len(entry) > len(rule[row]) or entry == rule[row] and kind == BLOCK_RULE:
                        # of equally long rules the one of the longer host comes first and stays
                        rule[row], blocks[row] = entry, kind == BLOCK_RULE
            verdict = ["block" if (blocks[i] if rule[i] is not None else listed[i]) else "allow" for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r and r.decode() for r in rule], pa.string()),
                 pa.array(verdict, pa.string()), pa.array(listed, pa.bool_())],
                names=["page_id", "host", "path", "rule", "verdict", "listed"],
            )

    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    parts = pages.select(pages["page_id"].cast("long"), url_host(url).alias("host"), url_path(url).alias("path"))
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed boolean")
