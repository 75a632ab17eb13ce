"""Joins between messages, documents, stored rows, caches and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspend.functions.text import domain, mailbox, strip
from docspend.operators.filters import scoped


def invoice_counts(users: DataFrame, invoices: DataFrame) -> DataFrame:
    """id, n: every user's number of invoices, folded before the join."""
    counts = invoices.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return users.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def mark_existing(candidates: DataFrame, invoices: DataFrame) -> DataFrame:
    """Candidates with existing_id, the stored invoice of the tenant with the same number; none for an empty number."""
    known = invoices.where("invoice_no <> ''").groupBy("user_id", "invoice_no").agg(F.min("id").alias("existing_id"))
    return candidates.join(known, ["user_id", "invoice_no"], "left")


def seen_attachments(logs: DataFrame, *scope: str) -> DataFrame:
    """The attachments that any earlier outcome was recorded for, by message, name and scope."""
    rows = logs.where("email_uid <> '' AND attachment_filename IS NOT NULL")
    return rows.select(*scope, "email_uid", F.col("attachment_filename").alias("filename")).distinct()


def drop_seen(attachments: DataFrame, logs: DataFrame, *scope: str) -> DataFrame:
    """Attachments (email_uid, filename) without those seen before; a message without an id was never seen.

    scope: further columns that have to agree, such as user_id where tenants number their messages alike.
    """
    return attachments.join(seen_attachments(logs, *scope), [*scope, "email_uid", "filename"], "left_anti")


def hydrate(invoices: DataFrame, ids: DataFrame, user_id: int) -> DataFrame:
    """The tenant's invoices among ids."""
    return scoped(invoices, user_id).join(ids.select("id").distinct(), "id", "left_semi")


def hydrate_ranked(invoices: DataFrame, hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first of invoices among hits (id and order columns) with their place: limited before they are ranked."""
    top = invoices.join(hits, "id").orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def split_cache(wanted: DataFrame, cache: DataFrame, as_of: str, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Hits with the cache's answer, and misses: entries count while they have no expiry or a later one."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    answers = live.select(key, "response_json")
    return wanted.join(answers, key), wanted.join(answers, key, "left_anti")


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """id, email of the sessions that are open at a time, of active users."""
    at = F.lit(as_of).cast("timestamp")
    live = sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > at) & (F.col("created_at") <= at)).select("id", "user_id")
    return live.join(users.where("is_active").select(F.col("id").alias("user_id"), "email"), "user_id").select("id", "email")


#: Characters of a pattern that are looked up before it is compared as a whole.
GRAM = 4


def match_trusted(emails: DataFrame, patterns: DataFrame) -> DataFrame:
    """email_id, trusted, pattern (the first by its characters) of every message; emails: email_id, user_id, from_addr; patterns: user_id, pattern.

    A pattern x@y is the whole mailbox, @d a domain or what it is under; any other is either of these
    or a part of the sender.  Patterns count for their tenant, or for all where user_id is null.
    Every kind is an equality join over the distinct senders: by mailbox, by each suffix of the domain,
    and for parts by the first characters of the pattern at each place of the sender, of which those
    found are compared; so neither side need be small.
    """
    c = F.col
    every = F.lit(-1).cast("long")
    rules = patterns.select(F.coalesce(c("user_id").cast("long"), every).alias("scope"), F.lower(strip(c("pattern"))).alias("p")).where("p <> ''").distinct()
    kind = F.when(F.startswith("p", F.lit("@")), "domain").when(F.contains("p", F.lit("@")), "mailbox").otherwise("part")
    rules = rules.withColumn("kind", kind)
    senders = emails.select("user_id", "from_addr").distinct()
    known = senders.select("user_id", "from_addr", F.lower("from_addr").alias("low"), mailbox(c("from_addr")).alias("box"), F.explode(F.array(c("user_id").cast("long"), every)).alias("scope"))
    what = ["user_id", "from_addr", "p"]
    boxes = known.join(rules.where("kind = 'mailbox'").withColumnRenamed("p", "box"), ["scope", "box"]).withColumn("p", c("box")).select(*what)
    labels = F.split(domain(c("box")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    under = known.withColumn("labels", labels).where("contains(box, '@')").select("user_id", "from_addr", "scope", F.explode(suffixes).alias("d"))
    under = under.join(rules.where("kind <> 'mailbox'").withColumn("d", F.regexp_replace("p", "^@", "")), ["scope", "d"]).select(*what)
    parts = rules.where("kind = 'part'").withColumn("gram", F.substring("p", 1, GRAM))
    places = F.explode(F.sequence(F.lit(1), F.length("low")))
    grams = known.where("low <> ''").select("user_id", "from_addr", "low", "scope", places.alias("at"))
    grams = grams.select("user_id", "from_addr", "low", "scope", F.explode(F.array_distinct(F.array(*(F.substr("low", c("at"), F.lit(n)) for n in range(1, GRAM + 1))))).alias("gram")).distinct()
    inside = grams.join(parts, ["scope", "gram"]).where("contains(low, p)").select(*what)
    found = boxes.unionByName(under).unionByName(inside).groupBy("user_id", "from_addr").agg(F.min("p").alias("pattern"))
    rows = emails.alias("e").join(found.alias("f"), c("e.user_id").eqNullSafe(c("f.user_id")) & c("e.from_addr").eqNullSafe(c("f.from_addr")), "left")
    return rows.select("e.email_id", c("f.pattern").isNotNull().alias("trusted"), "f.pattern")


def drilldown(logs: DataFrame, scans: DataFrame) -> DataFrame:
    """The extraction rows of the given scans in the order they were made."""
    own = scans.select(F.col("id").alias("scan_log_id"))
    return logs.join(own, "scan_log_id", "left_semi").orderBy("created_at", "id")


def orphan_owners(listing: DataFrame, users: DataFrame) -> DataFrame:
    """owner: numbers of owners' folders (users/number/...) that no user has; other names do not count."""
    folder = F.regexp_extract("path", "^users/([^/]+)/", 1)
    owners = listing.select(folder.alias("owner")).distinct().withColumn("id", F.col("owner").try_cast("long")).where("id IS NOT NULL")
    return owners.join(users.select("id"), "id", "left_anti").select("owner")


def pending_links(links: DataFrame, done: DataFrame) -> DataFrame:
    """Links (link) that are not among the done ones, each once."""
    return links.where("link IS NOT NULL").select("link").distinct().join(done.select("link"), "link", "left_anti")


def events_to_audit(logs: DataFrame, events: DataFrame) -> DataFrame:
    """Audit rows and a source's own events (kind, folder) as rows of one table."""
    found = events.select(F.concat_ws(":", F.lit("scanner"), "kind", "folder").alias("email_uid"), F.col("kind").alias("outcome"))
    return logs.unionByName(found, allowMissingColumns=True)
