"""Digests, subscriptions and retention, as set operations over subscribers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.hashing import pseudonym


def window(cases: DataFrame, since: dt.date, until: dt.date, most: int) -> tuple[DataFrame, DataFrame]:
    """(total, newest): published cases first seen from ``since`` up to before ``until``; the ``most`` newest of them."""
    if since >= until:
        raise ValueError("since: before until")
    seen = cases.where(F.col("is_published") & (F.col("first_seen_on") >= F.lit(since)) & (F.col("first_seen_on") < F.lit(until)))
    return seen.agg(F.count("*").alias("total")), seen.orderBy(F.desc("first_seen_on"), F.desc("id")).limit(most)


def recipients(subscribers: DataFrame, until: Column, after_id: int = -(2**63), size: int | None = None) -> DataFrame:
    """Confirmed subscribers who have not had this digest, by id; a batch of them for a resumable walk."""
    due = subscribers.where((F.col("status") == "confirmed") & (F.col("id") > after_id) & (F.col("last_digest_at").isNull() | (F.col("last_digest_at") < until)))
    return due.orderBy("id") if size is None else due.orderBy("id").limit(size)


def stamp(subscribers: DataFrame, sent: DataFrame, until: Column) -> DataFrame:
    """After a digest: who was sent it has the window's end and one more digest. Sending again changes nothing."""
    ids = sent.select("id").distinct().withColumn("__sent", F.lit(True))
    new = F.col("__sent") & (F.col("last_digest_at").isNull() | (F.col("last_digest_at") < until))
    joined = subscribers.join(ids, "id", "left")
    done = F.coalesce(new, F.lit(False))
    return joined.withColumns({"digest_count": F.col("digest_count") + done.cast("int"), "last_digest_at": F.when(done, until).otherwise(F.col("last_digest_at"))}).drop("__sent")


def subscribe(requests: DataFrame, now: Column, notice_seconds: int = 3600) -> DataFrame:
    """What a request to subscribe does, given the address's row (status null: unknown)."""
    recent = F.col("notice_sent_at").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("notice_sent_at") < notice_seconds)
    action = (
        F.when(F.col("status").isNull(), "created")
        .when(F.col("status") == "unsubscribed", "suppressed")
        .when(recent, "throttled")
        .when(F.col("status") == "pending", "resent")
        .otherwise("reminded")
    )
    return requests.withColumn("action", action)


def confirm(subscribers: DataFrame, now: Column, ttl_hours: int = 72) -> DataFrame:
    """Pending rows within their time become confirmed."""
    live = (F.col("status") == "pending") & (F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_hours * 3600)
    return subscribers.withColumns({"status": F.when(live, "confirmed").otherwise(F.col("status")), "confirmed_at": F.when(live, now).otherwise(F.col("confirmed_at"))})


def unsubscribe(subscribers: DataFrame, ids: DataFrame, key: bytes, version: str, now: Column) -> DataFrame:
    """The address gives way to its keyed digest."""
    marked = subscribers.join(ids.select("id").distinct().withColumn("__out", F.lit(True)), "id", "left")
    out = F.coalesce(F.col("__out"), F.lit(False)) & (F.col("status") != "unsubscribed")
    return marked.withColumns({
        "email_digest": F.when(out, pseudonym(key, F.col("email"), version)).otherwise(F.col("email_digest")),
        "email": F.when(out, F.lit(None)).otherwise(F.col("email")),
        "unsubscribed_at": F.when(out, now).otherwise(F.col("unsubscribed_at")),
        "status": F.when(out, "unsubscribed").otherwise(F.col("status")),
    }).drop("__out")


def lookup(asked: DataFrame, subscribers: DataFrame, key: bytes, version: str) -> DataFrame:
    """asked (ask, email, and token_seed of a verified token) with the subscriber that each asks for, if any: id, status and by what it was
    found. By address, else by the keyed digest that an address leaves when it goes, else by the seed. A digest is compared byte by
    byte, whatever the collation of its column; null finds nothing. Addresses are compared trimmed and lower-case."""
    plain = F.lower(F.trim("email"))
    asked = asked.withColumns({"__mail": plain, "__digest": pseudonym(key, F.col("email"), version)})
    of = lambda column, name: subscribers.where(F.col(column).isNotNull()).select(F.col(column).cast("binary").alias(f"__{name}_key"), F.struct("id", "status").alias(f"__{name}"))
    rows = asked
    for name, mine, theirs in (("mail_row", "__mail", "email"), ("digest_row", "__digest", "email_digest"), ("seed_row", "token_seed", "token_seed")):
        rows = rows.join(of(theirs, name), F.col(mine).cast("binary") == F.col(f"__{name}_key"), "left")
    row = F.coalesce("__mail_row", "__digest_row", "__seed_row")
    by = F.when(F.col("__mail_row").isNotNull(), "email").when(F.col("__digest_row").isNotNull(), "digest").when(F.col("__seed_row").isNotNull(), "token")
    return rows.select("ask", row["id"].alias("id"), row["status"].alias("status"), by.alias("found_by"))


def purge(subscribers: DataFrame, digest_horizon: Column | None, unconfirmed_horizon: Column | None) -> DataFrame:
    """Digests of those gone before the first horizon are forgotten; rows pending since before the second are deleted. A horizon
    that is not set enforces nothing."""
    out = subscribers
    if digest_horizon is not None:
        old = (F.col("status") == "unsubscribed") & F.col("email_digest").isNotNull() & (F.col("unsubscribed_at") < digest_horizon)
        out = out.withColumn("email_digest", F.when(old, F.lit(None)).otherwise(F.col("email_digest")))
    if unconfirmed_horizon is not None:
        out = out.where(~F.coalesce((F.col("status") == "pending") & F.col("confirmed_at").isNull() & (F.col("created_at") < unconfirmed_horizon), F.lit(False)))
    return out


def statistics(subscribers: DataFrame) -> DataFrame:
    """Survives the loss of addresses: counts, digests and days by status."""
    days = F.datediff("last_digest_at", "created_at")
    return subscribers.groupBy("status").agg(F.count("*").alias("n"), F.sum("digest_count").alias("digests"), F.sum(days).cast("long").alias("days"))


def truncated(text: Column, width: int) -> Column:
    """One line, cut to ``width`` with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(line) > width, F.concat(F.rtrim(F.substring(line, 1, width - 1)), F.lit("…"))).otherwise(line)


def overflow_note(shown: Column, total: Column) -> Column:
    return F.when(total > shown, F.format_string("%d of %d new cases are listed.", shown, total)).otherwise(F.format_string("%d new %s.", total, F.when(total == 1, "case").otherwise("cases")))
