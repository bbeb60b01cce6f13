"""Scans of a source against what is known: classification, change events, absence, coverage, workflow.

A scan may be partial. Absence is only told from a complete one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(scan: DataFrame, key: str, order: str, fingerprint: str) -> DataFrame:
    """One row per key, the first by order, with `repeats` and `conflicts` (later rows with another fingerprint)."""
    firsts = scan.groupBy(key).agg(F.min(F.struct(order, fingerprint)).alias("__f"), F.count("*").alias("__n"))
    spread = scan.join(firsts, key).groupBy(key).agg(F.sum((~F.col(fingerprint).eqNullSafe(F.col(f"__f.{fingerprint}"))).cast("long")).alias("conflicts"))
    return firsts.join(spread, key).select(key, f"__f.{order}", f"__f.{fingerprint}", (F.col("__n") - 1).alias("repeats"), "conflicts")


def classify_scan(known: DataFrame, scan: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """scan's keys with `state`: NEW, UPDATED or UNCHANGED."""
    old = known.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__f"))
    state = F.when(F.col("__k").isNull(), "NEW").when(F.col("__f").eqNullSafe(F.col(fingerprint)), "UNCHANGED").otherwise("UPDATED")
    return scan.join(old, F.col(key) == F.col("__k"), "left").select(key, state.alias("state"))


def change_events(known: DataFrame, scan: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, event, field, before, after: NEW for unknown keys, CHANGED for every field that differs."""
    old = known.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = scan.join(old, F.col(key) == F.col("__k"), "left")
    new = F.col("__k").isNull()
    fresh = F.struct(F.lit("NEW").alias("event"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    cells = [
        F.when(~new & ~F.col(f).eqNullSafe(F.col(f"__{f}")), F.struct(F.lit("CHANGED").alias("event"), F.lit(f).alias("field"), F.col(f"__{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")))
        for f in fields
    ]
    found = both.select(key, F.explode(F.array_compact(F.array(F.when(new, fresh), *cells))).alias("c"))
    return found.select(key, "c.event", "c.field", "c.before", "c.after")


def absence(known: DataFrame, scan: DataFrame, key: str, present: str, complete: bool) -> DataFrame:
    """key, event: NO_LONGER_OBSERVED for present keys that a complete scan lacks, REAPPEARED for absent ones that it has."""
    back = scan.select(key).distinct().join(known.where(~F.col(present)), key, "left_semi").select(key, F.lit("REAPPEARED").alias("event"))
    if not complete:
        return back
    gone = known.where(F.col(present)).join(scan.select(key), key, "left_anti").select(key, F.lit("NO_LONGER_OBSERVED").alias("event"))
    return gone.unionByName(back)


def observed_events(known: DataFrame, scan: DataFrame, key: str, fields: list[str], status: str, fingerprint: str) -> DataFrame:
    """key, event, fields, before, after: what a scan tells of each record.

    NEW_OPPORTUNITY for unknown keys; METADATA_CHANGED, once for all fields that
    differ (named in `fields`); SOURCE_STATUS_CHANGED for the status alone. before and
    after are fingerprints.
    """
    old = known.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__fp"), *[F.col(f).alias(f"__{f}") for f in [*fields, status]])
    both = scan.join(old, F.col(key) == F.col("__k"), "left")
    new, none = F.col("__k").isNull(), F.array().cast("array<string>")
    differ = lambda f: ~F.col(f).eqNullSafe(F.col(f"__{f}"))
    changed = F.array_compact(F.array(*[F.when(differ(f), F.lit(f)) for f in fields]))
    event = lambda name, of: F.struct(F.lit(name).alias("event"), of.alias("fields"))
    told = F.array_compact(F.array(
        F.when(new, event("NEW_OPPORTUNITY", none)), F.when(~new & (F.size(changed) > 0), event("METADATA_CHANGED", changed)), F.when(~new & differ(status), event("SOURCE_STATUS_CHANGED", F.array(F.lit(status)))),
    ))
    found = both.select(key, F.explode(told).alias("e"), F.col("__fp").alias("before"), F.col(fingerprint).alias("after"))
    return found.select(key, "e.event", "e.fields", "before", "after")


def document_events(known: DataFrame, scan: DataFrame, keys: list[str], fingerprint: str, active: str, complete: bool) -> DataFrame:
    """keys, event: DOCUMENT_ADDED for references that are new or were inactive, DOCUMENT_CHANGED for other fingerprints, and from a complete scan DOCUMENT_REMOVED for active ones that it lacks.

    keys: a record's and its document's. Only documents of records that the scan saw can be removed.
    """
    old = known.select(*keys, F.col(fingerprint).alias("__fp"), F.col(active).alias("__active"))
    both = scan.select(*keys, F.col(fingerprint).alias("__new")).withColumn("__seen", F.lit(True)).join(old, keys, "full")
    seen, was = F.coalesce("__seen", F.lit(False)), F.coalesce("__active", F.lit(False))
    event = F.when(seen & ~was, "DOCUMENT_ADDED").when(seen & ~F.col("__fp").eqNullSafe(F.col("__new")), "DOCUMENT_CHANGED")
    told = both.select(*keys, (event.when(~seen & was, "DOCUMENT_REMOVED") if complete else event).alias("event")).where("event IS NOT NULL")
    if not complete:
        return told
    records = scan.select(keys[0]).distinct().withColumn("__r", F.lit(True))
    return told.join(records, keys[0], "left").where("event <> 'DOCUMENT_REMOVED' OR __r").drop("__r")


def scope_hash(source: Column, version: Column, query: Column) -> Column:
    """What identifies the filter of a scan: absence is only told against scans of the same."""
    return F.sha2(F.to_json(F.struct(source.alias("source"), version.alias("version"), query.alias("query"))), 256)


def covered_absence(coverage: DataFrame, observed: DataFrame, scope: str, key: str) -> DataFrame:
    """scope, key, event against the coverage (scope, key, present) of complete scans of the same scope.

    NO_LONGER_OBSERVED for present keys that the scope's scan lacks, REAPPEARED for
    absent ones that it has; scopes that were not scanned tell nothing.
    """
    seen = observed.select(scope, key).distinct().withColumn("__seen", F.lit(True))
    scanned = observed.select(scope).distinct()
    both = coverage.join(scanned, scope, "left_semi").join(seen, [scope, key], "left")
    here = F.coalesce("__seen", F.lit(False))
    event = F.when(F.col("present") & ~here, "NO_LONGER_OBSERVED").when(~F.col("present") & here, "REAPPEARED")
    return both.select(scope, key, event.alias("event")).where("event IS NOT NULL")


def recovered(runs: DataFrame, holders: DataFrame, holder: str, status: str, retrieved: str) -> DataFrame:
    """runs after a crash: RUNNING ones whose holder is gone become PARTIAL if they had retrieved something, else FAILED."""
    alive = holders.select(F.col(holder).alias("__h")).distinct()
    met = runs.join(alive, F.col(holder) == F.col("__h"), "left")
    dead = (F.col(status) == "RUNNING") & F.col("__h").isNull()
    return met.withColumn(status, F.when(dead, F.when(F.col(retrieved) > 0, "PARTIAL").otherwise("FAILED")).otherwise(F.col(status))).drop("__h")


def handoffs(requests: DataFrame, current: DataFrame, receipts: DataFrame, key: str, binding: str, request: str) -> DataFrame:
    """requests with `outcome`: REPLAYED with a receipt of the same request, MISSING without a record, STALE if what was previewed (binding) is no longer so, LINKED if another request has linked the record, else ACCEPTED."""
    now = current.select(F.col(key).alias("__k"), F.col(binding).alias("__b"))
    mine, any_ = receipts.select(F.col(request).alias("__r")).distinct(), receipts.select(F.col(key).alias("__l")).distinct()
    met = requests.join(now, F.col(key) == F.col("__k"), "left").join(mine, F.col(request) == F.col("__r"), "left").join(any_, F.col(key) == F.col("__l"), "left")
    outcome = F.when(F.col("__r").isNotNull(), "REPLAYED").when(F.col("__k").isNull(), "MISSING").when(~F.col(binding).eqNullSafe(F.col("__b")), "STALE").when(F.col("__l").isNotNull(), "LINKED").otherwise("ACCEPTED")
    return met.withColumn("outcome", outcome).drop("__k", "__b", "__r", "__l")


def retries(failed: DataFrame, attempts: DataFrame, key: str, fingerprint: str, most: int) -> DataFrame:
    """failed with `retry`: whether the failed state, as its fingerprint tells it, has been tried fewer than `most` times; a new state starts anew."""
    tried = attempts.groupBy(F.col(key).alias("__k"), F.col(fingerprint).alias("__f")).agg(F.count("*").alias("__n"))
    met = failed.join(tried, (F.col(key) == F.col("__k")) & F.col(fingerprint).eqNullSafe(F.col("__f")), "left")
    return met.withColumn("retry", F.coalesce("__n", F.lit(0)) < most).drop("__k", "__f", "__n")


def coverage(known: DataFrame, scan: DataFrame, key: str, scope: str) -> DataFrame:
    """scope, known, observed, share of known keys that the scan saw."""
    seen = scan.select(F.col(key).alias("__k")).distinct()
    met = known.join(seen, F.col(key) == F.col("__k"), "left")
    return met.groupBy(scope).agg(F.count("*").alias("known"), F.count("__k").alias("observed"), F.round(F.count("__k") / F.count("*"), 4).alias("share"))


def scan_status(areas: DataFrame, area: str, issues: str, terminal: str, rows: str) -> DataFrame:
    """Per area: SUCCESS without issues and with the last page seen, else PARTIAL with some rows, else FAILED."""
    status = F.when((F.sum(issues) == 0) & F.bool_or(terminal), "SUCCESS").when(F.sum(rows) > 0, "PARTIAL").otherwise("FAILED")
    return areas.groupBy(area).agg(status.alias("status"))


def request_outcomes(requests: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """requests with `outcome`: ACCEPTED first, REPLAYED with the same payload, CONFLICT with another."""
    firsts = requests.groupBy(key).agg(F.min(F.struct(order, payload)).alias("__f"))
    first = F.col(order) == F.col(f"__f.{order}")
    same = F.col(payload).eqNullSafe(F.col(f"__f.{payload}"))
    return requests.join(firsts, key).withColumn("outcome", F.when(first, "ACCEPTED").when(same, "REPLAYED").otherwise("CONFLICT")).drop("__f")


def transitions(log: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, list[str]], start: str) -> DataFrame:
    """log with `before` and whether the step is `allowed`; a key begins in `start`."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit(start))
    legal = F.lit(False)
    for a, targets in allowed.items():
        legal = legal | ((F.col("before") == a) & F.col(state).isin(*targets)) if targets else legal
    return log.withColumn("before", before).withColumn("allowed", legal)


def chain_breaks(log: DataFrame, key: str, version: str, names: str, own: str) -> DataFrame:
    """Rows that break a revision chain: version 1 names a predecessor, or n doesn't name n - 1 of its key."""
    w = Window.partitionBy(key).orderBy(version)
    good = F.when(F.col(version) == 1, F.col(names).isNull()).otherwise(F.col(names).eqNullSafe(F.lag(own).over(w)) & (F.lag(version).over(w) == F.col(version) - 1))
    return log.withColumn("__ok", F.coalesce(good, F.lit(False))).where("NOT __ok").drop("__ok")


def rewritten(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, breach: rows of an append-only log that were DELETED or CHANGED since."""
    n = new.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    both = old.join(n, F.col(key) == F.col("__k"), "left")
    breach = F.when(F.col("__k").isNull(), "DELETED").when(~F.col(digest).eqNullSafe(F.col("__d")), "CHANGED")
    return both.select(key, breach.alias("breach")).where("breach IS NOT NULL")


def manifest_differences(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, finding of two listings (path, size, sha): MISSING, UNREFERENCED, SIZE or HASH."""
    m, f = manifest.alias("m"), files.alias("f")
    both = m.join(f, F.expr("m.path = f.path"), "full")
    finding = F.expr("CASE WHEN f.path IS NULL THEN 'MISSING' WHEN m.path IS NULL THEN 'UNREFERENCED' WHEN m.size <> f.size THEN 'SIZE' WHEN m.sha <> f.sha THEN 'HASH' END")
    return both.select(F.expr("coalesce(m.path, f.path)").alias("path"), finding.alias("finding")).where("finding IS NOT NULL")


#: Changes of a record's documents.
DOCUMENT_CHANGES = ("DOCUMENT_ADDED", "DOCUMENT_CHANGED", "DOCUMENT_REMOVED")


def unread(changes: DataFrame, key: str) -> DataFrame:
    """(key, unread_changes, unread_document_changes) of changes (key, category, origin, acknowledged_at) that a source made and nobody has acknowledged."""
    some = changes.where((F.col("origin") == "SOURCE") & F.col("acknowledged_at").isNull())
    return some.groupBy(key).agg(F.count("*").alias("unread_changes"), F.sum(F.col("category").isin(*DOCUMENT_CHANGES).cast("long")).alias("unread_document_changes"))


def acknowledge(changes: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, changes): what becomes of requests (request, key, id, at), a row an id, and the changes (id, key, acknowledged_at) after them.

    A request that names an id twice is DUPLICATE_CHANGE_ID, one that names an unknown
    id or another record's is DISCOVERY_CHANGE_NOT_OWNED, and nothing of either is done.
    Of the others each unacknowledged id goes to the first that names it, by number;
    outcomes tell how many that were, and an event is due where it is more than none.
    """
    owned = changes.select("id", F.col(key).alias("__owner"), F.col("acknowledged_at").isNull().alias("__open"))
    asked = requests.join(owned, "id", "left")
    twice = asked.groupBy("request", "id").agg(F.count("*").alias("n")).where("n > 1").select("request").distinct().withColumn("__twice", F.lit(True))
    foreign = asked.where(F.col("__owner").isNull() | (F.col("__owner") != F.col(key))).select("request").distinct().withColumn("__foreign", F.lit(True))
    judged = requests.select("request").distinct().join(twice, "request", "left").join(foreign, "request", "left")
    judged = judged.select("request", F.when(F.col("__twice"), "DUPLICATE_CHANGE_ID").when(F.col("__foreign"), "DISCOVERY_CHANGE_NOT_OWNED").alias("error"))
    firsts = asked.where("__open").join(judged.where("error IS NULL").select("request"), "request").groupBy("id").agg(F.min(F.struct("request", "at")).alias("f"))
    done = firsts.groupBy("f.request").agg(F.count("*").alias("acknowledged"))
    outcomes = judged.join(done, "request", "left").select("request", "error", F.when(F.col("error").isNull(), F.coalesce("acknowledged", F.lit(0))).alias("acknowledged"))
    after = changes.join(firsts.select("id", F.col("f.at").alias("__at")), "id", "left").withColumn("acknowledged_at", F.coalesce("acknowledged_at", "__at")).drop("__at")
    return outcomes, after


def change_summary(changes: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """One row: records (key, state, watching) that are new, have unread changes, are followed and have some; unread changes and new documents."""
    counts = unread(changes, key)
    open_ = changes.where((F.col("origin") == "SOURCE") & F.col("acknowledged_at").isNull()).agg(F.count("*").alias("unread_changes"), F.coalesce(F.sum((F.col("category") == "DOCUMENT_ADDED").cast("long")), F.lit(0)).alias("new_documents"))
    told = records.join(counts, key, "left").agg(
        F.coalesce(F.sum((F.col("state") == "NEW").cast("long")), F.lit(0)).alias("new_opportunities"), F.coalesce(F.sum((F.col("unread_changes").isNotNull() & F.col("watching")).cast("long")), F.lit(0)).alias("followed_with_changes")
    )
    changed = counts.agg(F.count("*").alias("changed_opportunities"))
    return told.crossJoin(changed).crossJoin(open_)
