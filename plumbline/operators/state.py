"""State from append-only logs: upserts, deletions, tickets, outbox, replies.

A log row has a key, a version and a payload; the last version wins. The fold is an aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("assigned", "in_progress", "resolved")
BASE_SECONDS, MOST_TRIES = 30, 5


def latest(log: DataFrame, keys: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key; keys whose last row is a deletion are gone."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    out = last.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in log.columns))
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def submit(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming with outcome: new, stored (same text), replace (other text, nothing decided), conflict. current and incoming have
    text; current has decided."""
    c = current.select(*keys, F.col("text").alias("old"), "decided")
    same = F.col("old").eqNullSafe(F.col("text"))
    known = F.col("decided").isNotNull()
    return incoming.join(c, keys, "left").withColumn("outcome", F.when(~known, "new").when(same, "stored").when(~F.col("decided"), "replace").otherwise("conflict")).drop("old", "decided")


def decide(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(finding_id, decision, conflict): the first decision stands; another one later is a conflict."""
    d = decisions.groupBy("finding_id").agg(F.min_by("decision", "at").alias("decision"), (F.countDistinct("decision") > 1).alias("conflict"))
    return findings.join(d, "finding_id", "left")


def opens_ticket(structural, status, staff_open) -> Column:
    return ~structural & ((status == "pending") | F.coalesce(staff_open, F.lit(False)))


def ticket_state(moves: DataFrame) -> DataFrame:
    """(ticket_id, state, violations): states only move forward; moves back are counted, not applied. moves: ticket_id, at, state."""
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int")
    seen = moves.select("ticket_id", "at", at.alias("s")).groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("m"))
    fold = F.aggregate("m", F.struct(F.lit(1).alias("s"), F.lit(0).alias("bad")), lambda a, x: F.struct(F.greatest(a["s"], x["s"]).alias("s"), (a["bad"] + (x["s"] < a["s"]).cast("int")).alias("bad")))
    r = seen.select("ticket_id", fold.alias("f"))
    return r.select("ticket_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("f.s")).alias("state"), F.col("f.bad").alias("violations"))


def queue(tickets: DataFrame, findings: DataFrame, reviews: DataFrame, *, hotel_id, department: str | None = None, state: str | None = None) -> DataFrame:
    """Tickets of a hotel with their finding and review, urgent first, then oldest."""
    r = tickets.join(findings, "finding_id").join(reviews.where(F.col("hotel_id") == hotel_id), "review_id")
    for column, value in (("department", department), ("state", state)):
        if value is not None:
            r = r.where(F.col(column) == value)
    return r.orderBy(F.when(F.col("priority") == "urgent", 0).otherwise(1), "created_at", "ticket_id")


def due(outbox: DataFrame, now, limit: int) -> DataFrame:
    return outbox.where((F.col("state") == "pending") & (F.col("next_attempt_at") <= F.lit(now))).orderBy("id").limit(limit)


def claimed(rows: DataFrame, now, lease_seconds: int) -> DataFrame:
    return rows.withColumn("next_attempt_at", F.lit(now) + F.make_dt_interval(secs=F.lit(lease_seconds)))


def backoff_seconds(attempts) -> Column:
    """30, 60, 120 ... seconds after each failure; null when the tries are used up."""
    return F.when(attempts < MOST_TRIES, BASE_SECONDS * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def failed(rows: DataFrame, now, error: str) -> DataFrame:
    n = F.col("attempts") + 1
    wait = backoff_seconds(n)
    return rows.withColumns({"attempts": n, "state": F.when(wait.isNull(), "failed").otherwise("pending"), "next_attempt_at": F.when(wait.isNotNull(), F.lit(now) + F.make_dt_interval(secs=F.coalesce(wait, F.lit(0)))), "error": F.substring(F.lit(error), 1, 300)})


def reply_state(resolved, forwarded) -> Column:
    return F.when(resolved, "fixed").when(forwarded, "forwarded").otherwise("noted")


def first_good(log: DataFrame, item: str, at: str, good: Column) -> DataFrame:
    """The first good row of each item."""
    rest = [c for c in log.columns if c != item]
    f = log.where(good).groupBy(item).agg(F.min_by(F.struct(*rest), at).alias("r"))
    return f.select(item, *(F.col(f"r.{c}").alias(c) for c in rest))


def quota(submissions: DataFrame, rated: DataFrame, analysed: DataFrame, key: str, *, at: str, once: int = 100, most: int = 300, used: int = 0) -> DataFrame:
    """New submissions: rated and repeated ones dropped; those analysed before cost no quota; `once` at a time, `most` in all."""
    r = submissions.join(rated.select(key), key, "left_anti")
    rest = [c for c in r.columns if c != key]
    r = r.groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
    r = r.join(analysed.select(key, F.lit(True).alias("known")).distinct(), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    fresh = r.where(~F.col("known")).orderBy(at, key).limit(max(0, min(once, most - used)))
    return r.where("known").unionByName(fresh)


def card(findings: DataFrame, tickets: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Each finding with its ticket's id and state, null where it has none, and its review's reply. tickets: finding_id, ticket_id, state, of
    which equal rows count once; replies: review_id, draft, approved_text."""
    out = findings.join(tickets.select("finding_id", "ticket_id", F.col("state").alias("ticket_state")).distinct(), "finding_id", "left")
    return out.join(replies.select("review_id", "draft", "approved_text"), "review_id", "left") if replies is not None else out


def children(log: DataFrame, keys: list[str], version: str, nested: str) -> DataFrame:
    """(keys..., position, child...): the children that the last row of each key carries. They are nested in the row, so a later version
    replaces them all at once, with none of the earlier ones left."""
    last = latest(log.select(*keys, version, nested), keys, version)
    return last.select(*keys, F.posexplode(nested).alias("position", "c")).select(*keys, "position", "c.*")


def erased(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without the keys that are gone, keys with found: whether any table held them)."""
    left = {name: t.join(gone.select(keys), keys, "left_anti") for name, t in tables.items()}
    held = None
    for t in tables.values():
        k = t.select(keys)
        held = k if held is None else held.unionByName(k)
    return left, gone.select(keys).distinct().join(held.distinct().withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def decided(findings: DataFrame, decisions: DataFrame, *, opened: Column, priority: Column, recipient: Column, unstated: str = "proposed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings with their decision, tickets, outbox) from a log of decisions, all folds of the same first decision, so that a ticket never
    stands without its finding's decision, nor a message without its ticket. decisions: finding_id, at, decision, still_open; what is
    decided again in the same way changes nothing, another decision is a conflict. Of decisions of one time the least counts, then a closed
    one, however the rows lie; one without a time comes last. One without a value stands as
    unstated and conflicts with nothing. A ticket and its message have keys that follow from the finding, so a repeated run makes the same ones."""
    stands = F.coalesce("decision", F.lit(unstated)).alias("decision")
    first = decisions.groupBy("finding_id").agg(F.min_by(F.struct(stands, "still_open", "at"), F.struct(F.col("at").isNull(), "at", stands, "still_open")).alias("d"), (F.countDistinct("decision") > 1).alias("conflict"))
    f = findings.join(first, "finding_id", "left").select(*findings.columns, F.coalesce("d.decision", F.lit("proposed")).alias("decision"), F.col("d.still_open").alias("still_open"), F.col("d.at").alias("decided_at"), F.coalesce("conflict", F.lit(False)).alias("conflict"))
    t = f.where((F.col("decision") == "confirmed") & opened).select(F.concat(F.lit("ticket-"), F.col("finding_id").cast("string")).alias("ticket_id"), "finding_id", "hotel_id", "department", priority.alias("priority"), F.lit(STATES[0]).alias("state"), F.col("decided_at").alias("created_at"))
    o = t.select(F.concat("ticket_id", F.lit("-assigned")).alias("send_id"), "ticket_id", "hotel_id", recipient.alias("recipient"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.col("created_at").alias("next_attempt_at"))
    return f, t, o


def outbox_state(outbox: DataFrame, tries: DataFrame) -> DataFrame:
    """outbox with state, attempts, last_error and next_attempt_at after a log of tries: send_id, at, error (null: sent). The first success
    ends it; failures before that wait twice as long each time, and MOST_TRIES of them end it too."""
    sent = F.min(F.when(F.col("error").isNull(), F.col("at")))
    s = tries.groupBy("send_id").agg(sent.alias("sent_at"))
    t = tries.join(s, "send_id").where(F.col("sent_at").isNull() | (F.col("at") <= F.col("sent_at")))
    k = t.groupBy("send_id").agg(F.count("*").cast("int").alias("n"), F.max("at").alias("last"), F.max_by("error", "at").alias("error"), F.min("sent_at").alias("sent_at"))
    j = outbox.drop("state", "attempts", "next_attempt_at").join(k, "send_id", "left").join(outbox.select("send_id", F.col("next_attempt_at").alias("due_at")), "send_id")
    wait = backoff_seconds(F.col("n"))
    state = F.when(F.col("sent_at").isNotNull(), "sent").when(F.col("n").isNull() | wait.isNotNull(), "pending").otherwise("failed")
    due_at = F.when(F.col("n").isNull(), F.col("due_at")).when(state == "pending", F.col("last") + F.make_dt_interval(secs=F.coalesce(wait, F.lit(0))))
    rest = [c for c in outbox.columns if c not in ("state", "attempts", "next_attempt_at")]
    return j.select(*rest, state.alias("state"), F.coalesce("n", F.lit(0)).alias("attempts"), F.substring("error", 1, 300).alias("last_error"), "sent_at", due_at.alias("next_attempt_at"))


def replies(log: DataFrame) -> DataFrame:
    """(review_id, state, draft, approved_text) after a log of (review_id, at, kind, text): the last draft; it is approved where an approval
    with words in it came after. An approval without any draft before it is not taken."""
    d = log.where(F.col("kind") == "draft").groupBy("review_id").agg(F.max_by("text", "at").alias("draft"), F.max("at").alias("drafted"))
    a = log.where((F.col("kind") == "approve") & (F.trim("text") != "")).join(d.select("review_id", "drafted"), "review_id").where(F.col("at") > F.col("drafted")).groupBy("review_id").agg(F.max_by(F.trim("text"), "at").alias("approved_text"))
    return d.join(a, "review_id", "left").select("review_id", F.when(F.col("approved_text").isNull(), "draft").otherwise("approved").alias("state"), "draft", "approved_text")


def reply_facts(findings: DataFrame) -> DataFrame:
    """(review_id, ready, facts): facts of a reply once every finding is decided; rejected ones give none. findings: review_id, finding_id,
    type, decision, status, ticket_id."""
    state = F.when(F.col("decision") == "confirmed", reply_state(F.col("status") == "resolved", F.col("ticket_id").isNotNull()))
    fact = F.when(state.isNotNull(), F.struct("finding_id", "type", state.alias("state")))
    g = findings.groupBy("review_id").agg(F.bool_and(F.col("decision") != "proposed").alias("ready"), F.array_sort(F.array_compact(F.collect_list(fact))).alias("f"))
    facts = F.transform("f", lambda x: F.concat_ws(": ", x["type"], x["state"]))
    return g.select("review_id", "ready", F.when(F.col("ready"), facts).alias("facts"))
