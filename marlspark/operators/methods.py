"""How a domain's documents are downloaded: switches after failures in a row, manual choices, and the method that comes next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank


def streaks(attempts: DataFrame, length: int = 3) -> DataFrame:
    """Attempts (domain, method, success, reason, at, attempt_id) that end `length` failed requests in a row or more: domain, switched_at, reason, trigger, attempt_id.

    Requests are numbered over the whole table by domain and time, and failures meet
    those before them by number: no domain is sorted in one task.
    """
    requests = attempts.filter("method = 'requests'").select("domain", "success", "reason", "at", "attempt_id")
    failed = global_rank(requests, [F.col("domain"), F.col("at"), F.col("attempt_id")], "place").filter("NOT success").drop("success")
    before = [failed.select(F.col("domain").alias(f"d{i}"), (F.col("place") + i).alias("place")) for i in range(1, length)]
    row = reduce(lambda df, i: df.join(before[i - 1], "place").filter(F.col(f"d{i}") == F.col("domain")).drop(f"d{i}"), range(1, length), failed)
    return row.select("domain", F.col("at").alias("switched_at"), "reason", F.lit(f"{length}_failures").alias("trigger"), "attempt_id")


def preferences(attempts: DataFrame, manual: DataFrame, length: int = 3) -> DataFrame:
    """Of each domain with an attempt or a manual choice (domain, method, user, at): the automatic switch, the choice, and the method that comes next.

    The first streak after a reset switches to the browser; a manual choice of `auto` resets, and any
    other manual choice holds until the next one. Equal times: the larger attempt counts as later, and a choice as after attempts.
    """
    last = manual.groupBy("domain").agg(F.max_by(F.struct("method", "user", "at"), F.struct("at", "method", "user")).alias("m"))
    reset = manual.filter("method = 'auto'").groupBy("domain").agg(F.max("at").alias("reset_at"))
    first = streaks(attempts, length).join(reset, "domain", "left").filter("reset_at IS NULL OR switched_at > reset_at")
    first = first.groupBy("domain").agg(F.min(F.struct("switched_at", "attempt_id", "reason", "trigger")).alias("s"))
    every = attempts.select("domain").unionByName(manual.select("domain")).distinct()
    held = F.nullif("m.method", F.lit("auto"))
    preferred = F.coalesce(held, F.when(F.col("s").isNotNull(), "browser"), F.lit("auto"))
    return every.join(first, "domain", "left").join(last, "domain", "left").select(
        "domain", preferred.alias("preferred"), F.coalesce(F.nullif(preferred, F.lit("auto")), F.lit("requests")).alias("next_method"),
        F.when(held.isNotNull(), F.concat(F.lit("manual:"), F.coalesce("m.user", F.lit("")))).otherwise(F.col("s.reason")).alias("reason"),
        "s.switched_at", "s.trigger", held.alias("manual_method"), F.when(held.isNotNull(), F.col("m.at")).alias("manual_at"),
    )
