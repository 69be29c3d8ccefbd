"""URL allow and block rules by a sort-merge range join.

A host becomes a canonical key: its labels reversed, each ended by "/", which no
host can hold ("www.example.com" -> "com/example/www/").  A rule on a host then
covers one interval of keys, those that start with its own key, and intervals of
two rules are nested or disjoint.  Keys are cut into ranges at sampled splitters;
each url goes to its range and each rule to all ranges its interval meets.  One
sorted sweep per range keeps a stack of the active nested rules: a key that
doesn't start with the top's key closes it.  The urls of a very common host are
spread by a hash behind the key, so no host is bound to one range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys drawn for the splitters, about; and the most ranges.
SAMPLE_KEYS = 20_000
MAX_RANGES = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple:
    """Columns host and path of a url column: both empty for null or without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def host_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


class _Level:
    """The rules on one host: verdict by path, and the path lengths there are, longest first."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.paths or verdict == "block":
            self.paths[path] = (host + path, verdict)
            self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def find(self, path: str):
        for n in self.lengths:
            if n <= len(path) and (hit := self.paths.get(path[:n])):
                return hit
        return None


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stack: list[_Level] = []
    at = None
    for rows in batches:
        out = []
        for part, key, rule, host, path, verdict in zip(rows["_range"], rows["_key"], rows["_rule"], rows["host"], rows["path"], rows["_verdict"]):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if rule:
                if not stack or stack[-1].key != key:
                    stack.append(_Level(key))
                stack[-1].add(host, path, verdict)
                out.append((None, None))
                continue
            best = (None, None)
            for level in stack:  # from the shortest host to the longest, so a tie goes to the nearer host
                if (hit := level.find(path)) and (best[0] is None or len(hit[0]) >= len(best[0])):
                    best = hit
            out.append(best)
        found = rows.assign(rule=[r for r, _ in out], _hit=[v for _, v in out])
        found = found[found["_rule"] == 0]
        yield found.rename(columns={"_hit": "verdict"})[["_id", "host", "path", "rule", "verdict"]]


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: ``key``, host, path, rule, verdict.

    ``rules`` has host, path, verdict ("allow" or "block").  A rule fits its host
    and all subdomains where the url's path starts with the rule's path; of the
    rules that fit, the one with the most characters in host and path wins, the
    nearer host on a tie, block where one host and path have both.  Urls that no
    rule fits get rule null and ``default``.  Null urls and urls without "://" have
    an empty host and path.  Repeated rows and null keys pass row by row; an empty
    table gives an empty one; other columns are ignored, and names may hold dots.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{url}`").alias("_url"))
    host, path = url_parts("_url")
    urls = pages.select("_id", host.alias("host"), path.alias("path"), F.xxhash64("_id", "_url").alias("_hash"))
    urls = urls.withColumn("_key", host_key(F.col("host")))
    n = urls.count()
    ranges = max(1, min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500))
    drawn = sorted(map(tuple, urls.select("_key", "_hash").sample(min(1.0, SAMPLE_KEYS / max(n, 1)), seed=11).collect()))
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(_range=[bisect_right(cuts, x) for x in zip(rows["_key"], rows["_hash"])], _rule=0, _verdict=None)[order]

    def place_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = -(1 << 63), 1 << 63
        for rows in batches:
            rows = rows.assign(_range=[list(range(bisect_right(cuts, (k, low)), bisect_right(cuts, (k + "\U0010ffff", high)) + 1)) for k in rows["_key"]])
            yield rows.explode("_range").assign(_id=None, _rule=1, _hash=0)[order]

    order = ["_id", "host", "path", "_key", "_hash", "_range", "_rule", "_verdict"]
    id_type = urls.schema["_id"].dataType.simpleString()
    kind = f"_id {id_type}, host string, path string, _key string, _hash long, _range int, _rule int, _verdict string"
    marked = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").alias("_verdict"))
    marked = marked.withColumn("_key", F.when(F.col("host") == "", "").otherwise(host_key(F.col("host"))))
    events = urls.mapInPandas(place, kind).unionByName(marked.mapInPandas(place_rules, kind))
    swept = events.repartition(F.col("_range")).sortWithinPartitions("_range", "_key", F.desc("_rule"), "_hash").mapInPandas(_sweep, f"_id {id_type}, host string, path string, rule string, verdict string")
    return swept.select(F.col("_id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
