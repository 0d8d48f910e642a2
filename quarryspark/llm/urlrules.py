"""URL filters by a sort-merge range join.

A host is written backwards, label by label ("org.example."), so a rule for a host and its subdomains is an
interval of keys: all that begin with the rule's. Rules and urls are cut into key ranges, sorted, and swept
once; a stack holds the rules whose interval is open, which are always nested. A url is judged by the
longest rule on the stack whose path its own begins with.

A rule that spans several ranges is opened anew in each. A url's key ends in a small hash of the row, so
a host with very many urls is spread over ranges. The limits of the ranges come from a bounded sample, and
serve balance alone.

Defined results: host and path of a null url, or one without "://", are empty, and only rules for every
host fit it; repeated rows are judged alike; of equal rules, block wins over allow; of rules of one length
(host and path together) the longer host wins; rules with a null host or path count as empty there; an
empty table gives no rows, and without rules every url gets the default. All columns of the table are kept, but for
those named host, path, rule or verdict, which the results replace; names that begin with two underscores are ours.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 4, 32
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first "://" to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _AZ, _az)


def path_of(url: Column) -> Column:
    """From the host's end to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """"www.example.org" -> "org.example.www."; the empty host, which holds all others, is empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(others: list[str], default: str):
    """Judges the urls of sorted ranges; the stack lives across batches of a partition."""

    def run(batches):
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        at = None
        for batch in batches:
            rules, verdicts, keep = [], [], []
            for i, (part, key, is_url, host, path, verdict) in enumerate(zip(batch["__part"], batch["__key"], batch["__is_url"], batch["__host"], batch["__path"], batch["__verdict"], strict=True)):
                if part != at:
                    at, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, paths, lengths = stack[-1]
                    if verdict == "block" or path not in paths:
                        paths[path] = (verdict, host + path)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = (-1, -1, None)
                for level, paths, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (hit := paths.get(path[:n])):
                            best = max(best, (len(hit[1]), len(level), hit), key=lambda b: b[:2])
                            break
                verdict, rule = best[2] or (default, None)
                keep.append(i)
                rules.append(rule)
                verdicts.append(verdict)
            out = batch.iloc[keep][[*others, "__host", "__path"]].rename(columns={"__host": "host", "__path": "path"})
            yield out.assign(rule=pd.Series(rules, index=out.index, dtype=object), verdict=pd.Series(verdicts, index=out.index, dtype=object))

    return run


def _limits(urls: DataFrame, ranges: int) -> list[str]:
    """Keys that part the urls into about equal ranges, from a sample of about ``ranges * SAMPLED`` keys."""
    n = urls.count()
    if not n:
        return []
    share = min(1.0, ranges * SAMPLED / n)
    picked = urls.select("__key").where(F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(1_000_003)) < F.lit(max(1, int(share * 1_000_003))))
    keys = sorted(r[0] for r in picked.limit(8 * ranges * SAMPLED).collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def judge(table: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``table`` with host, path, rule (host and path of the rule that decided; else null) and verdict.
    ``rules``: host, path, verdict ("allow" or "block")."""
    spark = table.sparkSession
    others = [c for c in table.columns if c not in ("host", "path", "rule", "verdict")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    salt = F.lpad(F.hex(F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in others]), F.lit(4096))), 3, "0")
    urls = table.select(*others, host.alias("__host"), path.alias("__path"), F.concat(reversed_host(host), F.lit("\x01"), salt).alias("__key"))
    limits = _limits(urls, RANGES * parts)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(limits, k)).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: list(range(bisect_right(limits, k), bisect_right(limits, k + "\U0010ffff") + 1)))

    r_host, r_path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    r_host = F.translate(r_host, _AZ, _az)
    opened = rules.select(r_host.alias("__host"), r_path.alias("__path"), F.col("verdict").alias("__verdict"), reversed_host(r_host).alias("__key"))
    opened = opened.withColumn("__part", F.explode(ranges_of("__key"))).withColumn("__is_url", F.lit(False))
    urls = urls.withColumns({"__part": range_of("__key"), "__verdict": F.lit(None).cast("string"), "__is_url": F.lit(True)})
    both = urls.unionByName(opened, allowMissingColumns=True).repartition(parts, "__part").sortWithinPartitions("__part", "__key", "__is_url")
    texts = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    return both.mapInPandas(_sweep(others, default), T.StructType([*[T.StructField(f.name, f.dataType) for f in table.schema if f.name in others], *texts]))
