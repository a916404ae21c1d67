"""Usage analytics over history, subscription and cache tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelytics import fixed_values as fv
from parcelytics.functions import geo
from parcelytics.operators import ordering, serving
from parcelytics.plans.scale import exact_quantiles, is_small, keep_last, maybe_broadcast, with_positions
from parcelytics.session import freeze

ACTIVE = ("active", "trialing")


def rolling_quota(history: DataFrame, user: str, event: str, ts: str, days: int, limit: int, one_task_bytes: int | None = None) -> DataFrame:
    """Accepted estimates per user in the trailing period (start included), what remains, and whether the next is blocked.

    A small history uses a range window. Otherwise each event adds a marker where its period starts and one where it
    ends; running counts of events over the time-ordered mix, taken at the markers, give the same number while a
    heavy user's rows are spread over many tasks. Rows are told apart by their place in a frozen copy, so an event id may
    repeat or be NULL; rows without a time count each other, as in the range window.
    """
    span = F.expr(f"interval {days} days")
    if is_small(history, one_task_bytes):
        frame = Window.partitionBy(user).orderBy(F.col("__t")).rangeBetween(-days * 86_400_000_000, Window.currentRow)
        counted = history.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("used", F.count("*").over(frame)).drop("__t")
    else:
        marks = F.explode(F.array(
            F.struct((F.col(ts) - span).alias("at"), F.lit(0).alias("kind")), F.struct(F.col(ts).alias("at"), F.lit(1).alias("kind")),
            F.struct(F.col(ts).alias("at"), F.lit(2).alias("kind")))).alias("m")
        placed = freeze(history.withColumn("__row", F.monotonically_increasing_id()))
        mixed = placed.select(user, "__row", marks).select(user, "__row", "m.at", "m.kind")
        ran = with_positions(mixed, [user], [F.col("at"), F.col("kind"), F.col("__row")], "__rn", {"__run": (F.col("kind") == 1).cast("long")}, one_task_bytes)
        sign = F.when(F.col("kind") == 2, F.col("__run")).when(F.col("kind") == 0, -F.col("__run")).otherwise(0)
        counted = placed.join(ran.groupBy("__row").agg(F.sum(sign).alias("used")), "__row").drop("__row")
    return counted.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("blocked", F.col("used") >= limit)


def replay_quota(requests: DataFrame, user: str, event: str, ts: str, days: int, limit: int) -> DataFrame:
    """Replay a raw request log: a request is accepted iff fewer than `limit` accepted ones lie in its trailing period.

    Acceptance depends on earlier acceptances, so each user's requests are walked in time order, batch by batch; only
    the last `limit` accepted times are remembered.
    """
    span = days * 86_400_000_000
    slim = requests.select(user, event, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    laid = slim.repartition(user).sortWithinPartitions(user, "__us", event)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken = None, deque()
        for batch in batches:
            flags = []
            for who, at in zip(batch[user], batch["__us"]):
                if who != current:
                    current, taken = who, deque()
                while taken and taken[0] < at - span:
                    taken.popleft()
                accepted = len(taken) < limit
                if accepted:
                    taken.append(at)
                flags.append(accepted)
            yield batch.assign(accepted=flags)[[user, event, "accepted"]]

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return laid.mapInPandas(walk, f"{user} {kinds[user]}, {event} {kinds[event]}, accepted boolean")


def subscription_state(events: DataFrame, customer: str, kind: str, status: str, order: Sequence[Column]) -> DataFrame:
    """Latest event per customer -> status, plan and is_pro; a deletion means free and canceled."""
    last = keep_last(events.select(customer, kind, status, *[o.alias(f"__o{i}") for i, o in enumerate(order)]), [customer],
                     [F.col(f"__o{i}") for i in range(len(order))])
    final = F.when(F.col(kind) == "deleted", "canceled").otherwise(F.col(status))
    out = last.select(customer, final.alias("status"))
    plan = F.when(F.col("status").isin(*ACTIVE), "pro").otherwise("free")
    return out.withColumn("plan", plan).withColumn("is_pro", (F.col("plan") == "pro") & F.col("status").isin(*ACTIVE))


def dashboard(history: DataFrame, user: str, ts: str, tie: str, price: str, total: str, division: str, n: int = 100) -> DataFrame:
    """KPIs per user over the newest n estimates: count, median price, total value, distinct divisions."""
    latest = ordering.latest_n(history, user, ts, tie, n)
    basic = [F.count("*").alias("count"), F.sum(total).alias("total_value"), F.count_distinct(division).alias("division_count")]
    return exact_quantiles(latest, [user], price, {"median_price": 0.5}, also=basic)


def monthly_activity(history: DataFrame, ts: str, as_of: str, months: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Counts for the last calendar months up to the as-of month, zero-filled (per `by` key when given)."""
    first = F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("date")
    span = F.sequence(F.add_months(first, -(months - 1)), first, F.expr("interval 1 month"))
    month = F.date_trunc("month", F.col(ts)).cast("date")
    counts = history.groupBy(*by, month.alias("month")).agg(F.count("*").alias("n"))
    keys = history.select(*by).distinct() if by else history.sparkSession.range(1).select()
    grid = keys.select(*by, F.explode(span).alias("month"))
    return grid.join(counts, [*by, "month"], "left").select(*by, F.date_format("month", "MMM yyyy").alias("label"), "month", F.coalesce("n", F.lit(0)).alias("n"))


def fixed_level_counts(df: DataFrame, level: Column, levels: Sequence[str]) -> DataFrame:
    """Counts for every declared level in order; anything else counts as the last level."""
    known = F.when(level.isin(list(levels)), level).otherwise(F.lit(levels[-1]))
    stats = df.agg(*[F.count_if(known == v).alias(f"n{i}") for i, v in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias("level"), F.col(f"n{i}").alias("n")) for i, v in enumerate(levels)])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def cached_lookup(requests: DataFrame, cache: DataFrame, fetched: DataFrame, ts: str, ttl_days: int = fv.CACHE_TTL_DAYS) -> DataFrame:
    """Answer requests from the newest cache entry of their bucket; stale entries yield to a new result if there is one.

    `requests`: lat, lon, ts; `cache`: lat_bucket, lon_bucket, payload, fetched_at; `fetched`: lat_bucket, lon_bucket,
    payload of the look-ups that succeeded. Adds payload and source (cache, fetched, stale, none).
    """
    bucket = ["lat_bucket", "lon_bucket"]
    newest = keep_last(cache.select(*bucket, "payload", "fetched_at"), bucket, [F.col("fetched_at")])
    asked = requests.withColumn("lat_bucket", geo.cache_bucket(F.col("lat"))).withColumn("lon_bucket", geo.cache_bucket(F.col("lon")))
    found = asked.join(maybe_broadcast(newest.withColumnRenamed("payload", "__old")), bucket, "left").join(
        maybe_broadcast(fetched.select(*bucket, F.col("payload").alias("__new"))), bucket, "left")
    fresh = F.coalesce(F.col("fetched_at") > F.col(ts) - F.expr(f"interval {ttl_days} days"), F.lit(False))
    source = F.when(fresh, "cache").when(F.col("__new").isNotNull(), "fetched").when(F.col("__old").isNotNull(), "stale").otherwise("none")
    return found.withColumn("source", source).withColumn(
        "payload", F.when(fresh, F.col("__old")).otherwise(F.coalesce("__new", "__old"))).drop("__old", "__new", "fetched_at")


def map_phrase(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "outside the mapped area").when(pct > 0, F.concat(F.bround(pct, 0).cast("int").cast("string"), F.lit("% inside the flood extent")))
        .otherwise("mapped - not flooded"))


def estimate_report(history: DataFrame, records: DataFrame, profiles: DataFrame, division: str, events: Sequence[str], risk: Sequence[str]) -> DataFrame:
    """Flattened report rows: basis, grade label, flood phrases, years, and the risk profile of each estimate."""
    served = serving.event_record(records, events, [division, "indication"], "years_text")
    joined = history.join(maybe_broadcast(served), division, "left").join(maybe_broadcast(serving.risk_profile(profiles, [division], risk)), division, "left")
    basis = F.when(F.col("known_division"), "Known division").otherwise("City-wide average (unknown division)")
    return joined.select(
        *history.columns, basis.alias("basis"), F.coalesce(F.initcap("confidence"), F.lit("N/A")).alias("grade"),
        F.coalesce("indication", F.lit(fv.FLOOD_LEVELS[-1])).alias("indication"),
        *[map_phrase(F.col(f"flooded_pct_{e}")).alias(f"map_{e}") for e in events],
        F.coalesce(F.nullif(F.array_join(F.transform("years", lambda y: y.cast("string")), ", "), F.lit("")), F.lit("none")).alias("records"), *risk)
