"""Rate limits replayed over logs of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ordered import carried, previous


def gaps(requests: DataFrame, key: str, at: str, tie: str, delay_s: float) -> DataFrame:
    """Requests with the seconds since the last one of their key, whether that is enough, and how long to wait if not."""
    rows = previous(requests, key, at, tie)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 1e6
    return rows.withColumn("gap_s", gap).drop("previous").withColumn("allowed", F.coalesce(F.col("gap_s") >= delay_s, F.lit(True))).withColumn(
        "wait_s", F.when(F.col("allowed"), 0.0).otherwise(delay_s - F.col("gap_s"))
    )


def may_crawl(hosts: DataFrame, now: Column, default_s: float = 1.0) -> DataFrame:
    """Hosts with the delay that counts (robots, else own, else default; zero counts as missing) and whether they may be asked now."""
    delay = F.coalesce(F.nullif(F.col("robots_txt_delay"), F.lit(0.0)), F.nullif(F.col("crawl_delay"), F.lit(0.0)), F.lit(default_s))
    since = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_crawl_time").cast("timestamp"))
    free = ~F.coalesce(F.col("blocked_until") > now, F.lit(False)) & F.coalesce(since >= delay, F.lit(True))
    return hosts.select("hostname", delay.alias("delay_s"), F.coalesce(F.col("blocked_until") > now, F.lit(False)).alias("blocked"), free.alias("allowed"))


def token_bucket(requests: DataFrame, key: str, at: str, tie: str, rate: float, capacity: float) -> DataFrame:
    """Requests (key, tie, tokens, allowed) through a token bucket per key that starts full.

    The refill is cut off at the capacity, so the fold is not associative and runs in order. But after a
    pause of more than ``capacity / rate`` seconds the bucket is full whatever came before: the log of a key is cut
    there, and the pieces run side by side. Only a key that is never quiet that long runs in one task, which
    carries the state from batch to batch whatever the length of its log. Requests without a time are a log of their own, in which nothing is refilled.
    """
    gap = capacity / rate
    log = requests.select(key, at, tie)
    quiet = previous(log, key, at, tie, seconds=max(3600, int(4 * gap)))
    pause = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 1e6
    fresh = F.when(F.col("previous").isNull() | (pause >= gap + 1), F.unix_micros(F.col(at).cast("timestamp")))
    pieces = carried(quiet.withColumn("_fresh", fresh), key, at, [tie], "_fresh", seconds=max(3600, int(16 * gap)))
    rows = pieces.select(key, F.coalesce("carried", F.lit(-1)).alias("_piece"), tie, F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0)).alias("t"))
    rows = rows.repartition(key, "_piece").sortWithinPartitions(key, "_piece", "t", tie)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, capacity, 0
        for p in parts:
            left, ok = [], []
            for k, piece, t in zip(p[key], p["_piece"], p["t"]):
                if (k, piece) != now:
                    now, tokens, last = (k, piece), capacity, t
                tokens = min(capacity, tokens + (t - last) / 1e6 * rate)
                last = t
                ok.append(tokens >= 1)
                tokens -= 1 if tokens >= 1 else 0
                left.append(tokens)
            yield pd.DataFrame({key: p[key], tie: p[tie], "tokens": left, "allowed": ok})

    kind = dict(rows.dtypes)
    return rows.mapInPandas(run, f"{key} {kind[key]}, {tie} {kind[tie]}, tokens double, allowed boolean")


def updated_hosts(hosts: DataFrame, crawled: DataFrame, default_s: float = 1.0) -> DataFrame:
    """Host states after crawls (hostname, at, crawl_delay, robots_txt_delay): the last crawl of each host is put into its state.

    A delay that the crawl does not give stays as it was; a host without a state gets one, with the default delay.
    """
    last = crawled.groupBy("hostname").agg(F.max_by(F.struct("at", "crawl_delay", "robots_txt_delay"), "at").alias("_c"))
    new = F.col("_known").isNull()
    return hosts.withColumn("_known", F.lit(True)).join(last, "hostname", "full").select(
        "hostname",
        F.coalesce("_c.at", "last_crawl_time").alias("last_crawl_time"),
        F.coalesce("_c.crawl_delay", "crawl_delay", F.when(new, F.lit(default_s))).alias("crawl_delay"),
        F.coalesce("_c.robots_txt_delay", "robots_txt_delay").alias("robots_txt_delay"),
        "blocked_until",
    )


def blocked_hosts(hosts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Host states after blocks (hostname, at, seconds): blocked until the last block ends; a host without a state gets one."""
    last = blocks.groupBy("hostname").agg(F.max_by(F.struct("at", "seconds"), "at").alias("_b"))
    until = F.col("_b.at") + F.make_dt_interval(secs=F.col("_b.seconds"))
    return hosts.join(last, "hostname", "full").select(
        "hostname", F.coalesce("last_crawl_time", "_b.at").alias("last_crawl_time"), "crawl_delay", "robots_txt_delay", F.coalesce(until.cast("timestamp_ntz"), F.col("blocked_until")).alias("blocked_until")
    )
