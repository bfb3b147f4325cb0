"""What a user did last: histories, searches, bookmarks, bursts, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

RECENT, SEARCHES = 5, 4


def recent(visits: DataFrame, user: str, item: str, ts: str, keep: int = RECENT) -> DataFrame:
    """``(user, item, ts, place)``: each user's newest visit of each item, the newest ``keep`` of them. Items break ties."""
    last = visits.where(F.col(item).isNotNull() & (F.col(item) != "home")).groupBy(user, item).agg(F.max(ts).alias(ts))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), item))
    return last.withColumn("place", place).where(F.col("place") <= keep)


def recent_searches(searches: DataFrame, user: str, term: str, ts: str, keep: int = SEARCHES) -> DataFrame:
    """Trimmed terms of two signs or more, one for each spelling in lower case, the newest spelling kept; the newest ``keep``."""
    tidy = searches.withColumn(term, tx.trim(F.col(term))).where(F.length(term) >= 2)
    last = tidy.groupBy(user, F.lower(term).alias("folded")).agg(F.max_by(term, F.struct(ts, term)).alias(term), F.max(ts).alias(ts))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), "folded"))
    return last.withColumn("place", place).where(F.col("place") <= keep).drop("folded")


def toggled(events: DataFrame, ts: str, *keys: str) -> DataFrame:
    """The keys that an odd number of toggles left switched on, with the time of the last one."""
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias(ts))
    return counts.where("n % 2 = 1").drop("n")


def debounce(events: DataFrame, user: str, ts: str, value: str, tie: str, milliseconds: int = 300) -> DataFrame:
    """The last event of each burst: an event after which its user is silent for ``milliseconds`` at least."""
    at = F.col(ts).cast("timestamp")
    gap = F.unix_micros(F.lead(at).over(Window.partitionBy(user).orderBy(ts, tie))) - F.unix_micros(at)
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= milliseconds * 1000)).select(user, ts, value, tie)


def neighbours(rows: DataFrame, key: str, order: str, *groups: str) -> DataFrame:
    """Add ``previous`` and ``next``: the keys beside each row in its group."""
    own = Window.partitionBy(*groups).orderBy(order, key)
    return rows.withColumns({"previous": F.lag(key).over(own), "next": F.lead(key).over(own)})


def expanded_groups(events: DataFrame, user: str, kind: str, item: str, *order: str) -> DataFrame:
    """``(user, item)``: the groups that each user's events leave open.

    ``toggle`` turns a group over, ``show`` opens it, ``search`` opens the group it found and, if no search is on,
    remembers what was open; ``clear`` ends a search and brings that back. Other kinds and null groups do nothing, but a
    search without a result still begins.

    What happens in a search that ends leaves no trace, so it is left out, and no set is ever carried along: of the other
    events, those since a group was last opened decide by their number. Each user's events are sorted once.
    """
    by_time = Window.partitionBy(user).orderBy(*order)
    sign = F.when(F.col(kind).isin("search", "clear"), F.col(kind) == "search")
    on = F.coalesce(F.last(sign, ignorenulls=True).over(by_time), F.lit(False))
    ends = F.first(F.when(F.col(kind) == "clear", F.lit(True)), ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing))
    kept = events.withColumn("_lost", on & ends.isNotNull()).where(~F.col("_lost") & F.col(item).isNotNull() & F.col(kind).isin("toggle", "show", "search"))
    when = F.struct(*order)
    opened = kept.groupBy(user, item).agg(F.max(F.when(F.col(kind) != "toggle", when)).alias("_last"), F.count("*").alias("_n"))
    later = kept.where(F.col(kind) == "toggle").join(opened.where("_last is not null").select(user, item, "_last"), [user, item]).where(when > F.col("_last")).groupBy(user, item).agg(F.count("*").alias("_later"))
    turned = opened.join(later, [user, item], "left")
    state = F.when(F.col("_last").isNull(), F.col("_n") % 2 == 1).otherwise(F.coalesce("_later", F.lit(0)) % 2 == 0)
    return turned.where(state).select(user, item)
