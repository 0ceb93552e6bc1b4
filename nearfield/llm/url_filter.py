"""URL filter over a sorted array of 64-bit digests.

A rule is a host and a path prefix; it fits its host and all subdomains when
the url's path starts with its path, and of several the longest rule decides
(of equally long ones the one with the longer host). The rules' xxhash64 keys
are sorted into one array and written, with the full rule strings, to a file
that every executor receives once through Spark and memory-maps, so that all
its workers share the pages; rules and verdicts are read from there, and no
worker holds the list. A batch of urls is probed with vectorised binary
search: first the host suffixes against the digests of rule hosts, then host
suffix and path prefix of each length in use against the digests of rules. A
hit counts only when the stored string equals the probed one.

A rule list beyond ``max_index_bytes`` is not shipped: the probes of the
distinct urls are joined with the rules on the whole string instead, with the
same result.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end. A null url, or one without
``://``, has both empty and no rule. Urls without a rule get ``default``.
Repeated rows are judged each time, null ids are carried, an empty table gives
an empty result, no rules leave ``default`` everywhere, other columns are
ignored. Very long urls are judged whole, with as many probes as the rules have
labels and path lengths. A rule given twice must have one verdict; one with a
null verdict gives ``default``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import per_process

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url):
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Strings by their sorted 64-bit digests, in one file: counts, digests, ends, payloads, strings."""

    @staticmethod
    def write(path: str, strings, payload, digest=xxhash.xxh64_intdigest) -> None:
        """``strings``: a list or an Arrow array, read in slices."""
        strings = pa.array(strings, pa.large_string())
        n = len(strings)
        keys = np.fromiter((digest(s.encode()) for s in _listed(strings)), "<u8", n)
        order = np.lexsort((np.arange(n), keys))
        ends = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False)[order], dtype="<u8")
        with open(path, "wb") as f:
            for part in (np.array([n], "<u8"), keys[order], ends, np.asarray(payload, "<i8")[order]):
                f.write(part.astype(part.dtype.newbyteorder("<")).tobytes())
            for lo in range(0, n, 4096):
                f.write("".join(strings.take(pa.array(order[lo : lo + 4096])).to_pylist()).encode())

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        self.digest = digest
        n = int(np.fromfile(path, "<u8", 1)[0])
        self.size = n
        if n:
            self.keys = np.memmap(path, "<u8", "r", 8, (n,))
            self.ends = np.memmap(path, "<u8", "r", 8 + 8 * n, (n,))
            self.payload = np.memmap(path, "<i8", "r", 8 + 16 * n, (n,))
            self.strings = np.memmap(path, np.uint8, "r", 8 + 24 * n)

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, probes: list[str]) -> np.ndarray:
        """Per probe the payload of its string, or -1."""
        at = self.locate(probes)
        return np.where(at >= 0, self.payload[at], -1) if self.size else at

    def locate(self, probes: list[str]) -> np.ndarray:
        """Per probe the place of its string, or -1; digests are compared first, then whole strings."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not self.size or not probes:
            return out
        raw = [p.encode("utf-8", "surrogatepass") for p in probes]
        keys = np.fromiter(map(self.digest, raw), "<u8", len(raw))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, self.size - 1)] == keys):
            k = int(at[i])
            while k < self.size and self.keys[k] == keys[i]:  # digests may collide
                if self.string(k) == raw[i]:
                    out[i] = k
                    break
                k += 1
        return out


def _listed(strings: pa.Array):
    for lo in range(0, len(strings), 4096):
        yield from strings.slice(lo, 4096).to_pylist()


class RuleIndex:
    """Rules in two digest arrays, their hosts and host with path, and the verdicts in a third."""

    def __init__(self, folder: str, name: str):
        self.hosts = DigestArray(os.path.join(folder, f"{name}.hosts"))
        self.rules = DigestArray(os.path.join(folder, f"{name}.rules"))
        self.verdicts = DigestArray(os.path.join(folder, f"{name}.verdicts"))
        # the most labels of a rule host, and the lengths of rule paths
        self.depth, *self.lengths = np.fromfile(os.path.join(folder, f"{name}.lengths"), "<i8").tolist()

    @staticmethod
    def write(folder: str, rules, verdicts=()) -> tuple[str, list[str]]:
        """Write the files; they share the folder's name, as Spark ships files of one name once.

        Both are lists or Arrow arrays. With verdicts, a rule's payload is the place of its verdict (-1: null), else its index.
        """
        name = os.path.basename(folder)
        rules, verdicts = pa.array(rules, pa.large_string()), pa.array(verdicts, pa.large_string())
        owner = pc.list_element(pc.split_pattern(rules, "/", max_splits=1), 0)
        hosts, kinds = pc.unique(owner), pc.unique(verdicts.drop_null())
        paths = [os.path.join(folder, f"{name}.{kind}") for kind in ("hosts", "rules", "verdicts", "lengths")]
        DigestArray.write(paths[0], hosts, np.arange(len(hosts)))
        DigestArray.write(paths[2], kinds, np.arange(len(kinds)))
        payload = np.arange(len(rules))
        if len(verdicts):
            placed = DigestArray(paths[2])
            place = np.full(len(kinds) + 1, -1)
            if len(kinds):
                place[placed.payload] = np.arange(len(kinds))
            payload = place[pc.fill_null(pc.index_in(verdicts, kinds), len(kinds)).to_numpy(zero_copy_only=False)]
        DigestArray.write(paths[1], rules, payload)
        depth = (pc.max(pc.count_substring(hosts, ".")).as_py() or 0) + 1 if len(hosts) else 0
        lengths = pc.unique(pc.subtract(pc.utf8_length(rules), pc.utf8_length(owner))).to_pylist()
        np.array([depth, *sorted(lengths)], "<i8").tofile(paths[3])
        return name, paths

    def rule(self, at: int) -> str | None:
        return self.rules.string(at).decode() if at >= 0 else None

    def verdict(self, at: int, default: str) -> str:
        kind = int(self.rules.payload[at]) if at >= 0 else -1
        return self.verdicts.string(kind).decode() if kind >= 0 else default

    def longest(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Per url the payload of its longest fitting rule, or -1."""
        at = np.array(self.places(hosts, paths), np.int64)
        return [int(self.rules.payload[k]) if k >= 0 else -1 for k in at]

    def places(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Per url the place of its longest fitting rule, or -1."""
        probes, owner = [], []
        for i, host in enumerate(hosts):
            at = len(host)
            for _ in range(self.depth):  # the last label, the last two, ...: no rule has more
                at = host.rfind(".", 0, at)
                if at + 1 < len(host):
                    probes.append(host[at + 1 :])
                    owner.append(i)
                if at < 0:
                    break
        known = np.flatnonzero(self.hosts.locate(probes) >= 0)
        deep, rows = [], []
        for j in known:
            path = paths[owner[j]]
            for n in self.lengths:
                if n <= len(path):
                    deep.append(probes[j] + path[:n])
                    rows.append((owner[j], len(probes[j]) + n, len(probes[j])))
        best: dict[int, tuple[int, int, int]] = {}
        for (i, size, host_size), rule in zip(rows, self.rules.locate(deep)):
            if rule >= 0:
                best[i] = max(best.get(i, (-1, -1, -1)), (size, host_size, int(rule)))
        return [best[i][2] if i in best else -1 for i in range(len(hosts))]


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    max_index_bytes: int = 256 << 20,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null without one), ``verdict``.

    ``rules`` has columns ``rule`` (host and path prefix, such as ``net/``) and ``verdict``.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    src = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rules = rules.select("rule", "verdict").where("rule is not null").distinct()
    bytes_, n, distinct = rules.agg(
        F.coalesce(F.sum(F.octet_length("rule") + F.coalesce(F.octet_length("verdict"), F.lit(0)) + 64), F.lit(0)), F.count("rule"), F.countDistinct("rule")
    ).first()
    if n != distinct:
        raise ValueError("a rule is given with more than one verdict")
    if bytes_ > max_index_bytes:
        return _judge_by_join(src, rules, default).withColumnRenamed("id", id_col)
    listed = rules.toArrow()  # of checked size, by column
    columns = [listed[c].combine_chunks().cast(pa.large_string()) for c in ("rule", "verdict")]
    name, files = RuleIndex.write(tempfile.mkdtemp(prefix="nearfield-rules-"), *columns)  # where Spark takes the files from
    for f in files:
        spark.sparkContext.addFile(f)
    id_type = to_arrow_type(src.schema["id"].dataType)
    schema = pa.schema([("id", id_type), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def kernel(batches):
        folder = os.path.dirname(SparkFiles.get(f"{name}.hosts"))
        index = per_process(("urls", folder, name), lambda: RuleIndex(folder, name))
        for batch in batches:
            ids, hosts, paths = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "host", "path"))
            found = index.places(hosts.to_pylist(), paths.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(id_type), hosts.cast(pa.string()), paths.cast(pa.string()),
                 pa.array([index.rule(i) for i in found], pa.string()),
                 pa.array([index.verdict(i, default) for i in found], pa.string())],
                schema=schema,
            )

    names_type = f"id {src.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return src.mapInArrow(kernel, names_type).withColumnRenamed("id", id_col)


def _judge_by_join(src: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for any number of rules: probes of the distinct urls meet the rules in a join."""
    lengths = [r[0] for r in rules.select(
        F.when(F.col("rule").contains("/"), F.length("rule") - F.locate("/", "rule") + 1).otherwise(0).alias("n")
    ).distinct().collect()]  # path lengths in use: bounded by the length of a url
    urls = src.select("host", "path").distinct()
    depth = rules.agg(F.max(F.size(F.split(F.split("rule", "/")[0], "[.]", -1)))).first()[0] or 1  # as in the index
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    probes = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])))
        .where("suffix != '' and n <= length(path)")
        .withColumn("rule", F.concat("suffix", F.expr("left(path, n)")))
    )
    best = (
        probes.join(rules, "rule")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("suffix").alias("h"), "rule", "verdict")).alias("best"))
    )
    return src.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
