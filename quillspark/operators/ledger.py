"""Passes, access links, credits and feedback as event tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS_PER_CREDIT, TRIAL_WORDS = 5000, 3000
PASS_DAYS = 30
#: What a balance reads in test mode.
TEST_CREDITS = 999


def active(rows: DataFrame, at: Column | str) -> DataFrame:
    """Passes or links that hold at a time: active, begun (if they have a beginning), not ended, not revoked."""
    at = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    test = (F.col("status") == "active") & (F.col("expires_at") > at)
    if "starts_at" in rows.columns:
        test = test & (F.col("starts_at") <= at)
    return rows.filter(test)


def active_pass(rows: DataFrame, user_id, at) -> DataFrame:
    return active(rows, at).filter(F.col("user_id") == user_id).limit(1)


def token_hash(token: Column) -> Column:
    """SHA-256 of a well-formed token (43 URL-safe characters), else null."""
    return F.when(token.rlike("^[A-Za-z0-9_-]{43}$"), F.sha2(token, 256))


def active_link(links: DataFrame, token: Column, at) -> DataFrame:
    return active(links, at).filter(F.col("token_hash") == token_hash(token)).limit(1)


def newest_first(links: DataFrame) -> DataFrame:
    return links.select("id", "label", "status", "created_at", "expires_at", "revoked_at").orderBy(F.desc("created_at"))


def revoked(links: DataFrame, link_id, at: Column) -> DataFrame:
    """links with one of them revoked; the rest as they are."""
    hit = (F.col("id") == link_id) & (F.col("status") == "active")
    return links.withColumns({"status": F.when(hit, "revoked").otherwise(F.col("status")), "revoked_at": F.when(hit, at).otherwise(F.col("revoked_at"))})


def fulfilled(events: DataFrame, passes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to append, passes to append) for new payment events: each event id counts once, ever."""
    fresh = new.dropDuplicates(["event_id"]).join(events.select("event_id"), "event_id", "left_anti")
    made = fresh.select("user_id", F.lit("active").alias("status"), F.col("paid_at").alias("starts_at"), F.expr(f"paid_at + make_interval(0, 0, 0, {PASS_DAYS})").alias("expires_at"))
    return fresh, made.select(*[c for c in passes.columns if c in made.columns])


def redeemed(invites: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invites after, passes to append): each open invite goes once, to the first who asks for it.

    invites: id, email, duration_days, status, invite_expires_at; asked: user_id, email, at.
    """
    wants = asked.select(F.col("user_id").alias("redeemed_by"), F.lower(F.trim("email")).alias("email"), F.col("at").alias("redeemed_at"))
    meets = invites.filter("status = 'active'").select("id", "email", "duration_days", "invite_expires_at").join(wants, "email").filter("invite_expires_at IS NULL OR invite_expires_at > redeemed_at")
    first = meets.groupBy("id").agg(F.min(F.struct("redeemed_at", "redeemed_by", "duration_days")).alias("x")).select("id", "x.*")
    passes = first.select(F.col("redeemed_by").alias("user_id"), F.concat(F.lit("invite:"), F.col("id").cast("string")).alias("source"), F.lit("active").alias("status"), F.col("redeemed_at").alias("starts_at"), F.expr("redeemed_at + make_interval(0, 0, 0, duration_days)").alias("expires_at"))
    after = invites.drop("redeemed_by", "redeemed_at").join(first.drop("duration_days"), "id", "left")
    return after.withColumn("status", F.when(F.col("redeemed_at").isNotNull(), "redeemed").otherwise(F.col("status"))), passes


def new_link(spark: SparkSession, at: dt.datetime, label: str | None = None) -> tuple[str, DataFrame]:
    """(the secret, shown only now; the row to append): a link of PASS_DAYS days that keeps only the secret's hash."""
    if label and "@" in label:
        raise ValueError("a label must not hold an e-mail address")
    token = secrets.token_urlsafe(32)
    row = (hashlib.sha256(token.encode()).hexdigest(), label or None, "active", at, at + dt.timedelta(days=PASS_DAYS))
    return token, spark.createDataFrame([row], "token_hash string, label string, status string, created_at timestamp, expires_at timestamp")


def labels_allowed(links: DataFrame) -> DataFrame:
    """Links whose label names no e-mail address."""
    return links.filter(F.col("label").isNull() | ~F.contains(F.col("label"), F.lit("@")))


def appended(rows: DataFrame, path: str) -> None:
    """Add rows to a table folder; rows that have a status lie in a folder for each, so active ones are found without the rest."""
    out = rows.write.mode("append")
    (out.partitionBy("status") if "status" in rows.columns else out).parquet(path)


def committed(done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(credit events, request ids, trial users) to append for answered requests: user_id, request_id, is_trial, seq."""
    charged = done.filter("NOT is_trial").select("user_id", "seq", F.lit(-1).alias("delta"))
    return charged, done.select("request_id").distinct(), done.filter("is_trial").select("user_id").distinct()


def added(users: DataFrame) -> DataFrame:
    """Credit events to append for bought credits: user_id, seq, amount."""
    return users.select("user_id", "seq", F.col("amount").alias("delta"))


def balances(events: DataFrame) -> DataFrame:
    """user_id, balance: credits after all events in order; a charge never takes a balance below zero.

    events: user_id, seq, delta. The balance is the running sum less the lowest it has been below zero.
    """
    order = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("total", F.sum("delta").over(order))
    last = F.max(F.struct("seq", "total"))["total"]
    return run.groupBy("user_id").agg((last - F.least(F.lit(0), F.min("total"))).cast("long").alias("balance"))


def decided(requests: DataFrame, events: DataFrame, seen: DataFrame, trials: DataFrame, test_mode: bool = False) -> DataFrame:
    """requests with allowed, reason and credits_remaining.

    requests: user_id, request_id, words, is_trial; seen: request_id; trials: user_id of those who had one. In test
    mode all are allowed.
    """
    if test_mode:
        return requests.select("user_id", "request_id", F.lit(True).alias("allowed"), F.lit("test_mode").alias("reason"), F.lit(TEST_CREDITS).cast("long").alias("credits_remaining"))
    r = requests.join(balances(events), "user_id", "left").join(seen.select("request_id").distinct().withColumn("seen", F.lit(True)), "request_id", "left")
    r = r.join(trials.select("user_id").distinct().withColumn("tried", F.lit(True)), "user_id", "left")
    has = F.coalesce("balance", F.lit(0))
    reason = (
        F.when(F.col("seen"), "duplicate_request_id")
        .when(F.col("is_trial") & F.col("tried"), "trial_already_used")
        .when(F.col("is_trial") & (F.col("words") > TRIAL_WORDS), "trial_word_cap_exceeded")
        .when(F.col("is_trial"), "trial_ok")
        .when(has <= 0, "no_credits")
        .when(F.col("words") > WORDS_PER_CREDIT, "word_cap_exceeded")
        .otherwise("ok")
    )
    left = F.when(F.col("reason").isin("duplicate_request_id", "word_cap_exceeded", "ok"), has).otherwise(0)
    return r.withColumn("reason", reason).select("user_id", "request_id", F.col("reason").isin("ok", "trial_ok").alias("allowed"), "reason", left.cast("long").alias("credits_remaining"))


def valid_feedback(rows: DataFrame) -> DataFrame:
    """Feedback worth storing: no honeypot, 10 to 2000 characters, short name and contact; blanks are null."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    message = F.trim("message")
    ok = (F.coalesce(F.trim("website"), F.lit("")) == "") & F.length(message).between(10, 2000)
    ok = ok & (F.length(F.coalesce(F.trim("name"), F.lit(""))) <= 120) & (F.length(F.coalesce(F.trim("contact"), F.lit(""))) <= 254)
    others = [c for c in rows.columns if c not in ("name", "contact", "message", "website")]
    return rows.filter(ok).select(*others, blank("name").alias("name"), blank("contact").alias("contact"), message.alias("message"))
