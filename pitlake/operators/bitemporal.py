"""Two clocks: what was stored by a snapshot and what was known at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ready_observed(*instants: Column) -> Column:
    """P10: the latest of all instants; null if any is missing, which greatest() alone would skip."""
    known = F.lit(True)
    for c in instants:
        known &= c.isNotNull()
    return F.when(known, F.greatest(*instants) if len(instants) > 1 else instants[0])


def ready_reconstructed(published: Column, modeled: Column) -> Column:
    """The later of publication and modelled availability; null if either is missing."""
    return ready_observed(published, modeled)


def visible(mode: str, snapshot: int, t: int, generation: str = "generation", observed: str = "observed", published: str = "published", reconstructed: str = "reconstructed") -> Column:
    """Stored by the snapshot and known at t. Test it before any choice of a revision.

    Observed mode admits an unknown publication; reconstructed mode needs its own clock."""
    stored = F.col(generation) <= snapshot
    if mode == "observed":
        return stored & (F.col(observed) <= t) & (F.col(published).isNull() | (F.col(published) <= t))
    if mode == "reconstructed":
        return stored & F.col(reconstructed).isNotNull() & (F.col(reconstructed) <= t)
    raise ValueError(f"no such mode: {mode}")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark keeps one row a key and task before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def points(versions: DataFrame, mode: str, snapshot: int, t: int) -> DataFrame:
    """The visible version of each (key, period): highest source order (else observed time), then observed, then id."""
    seen = versions.where(visible(mode, snapshot, t))
    out = latest(seen, ["key", "period"], [F.coalesce("source_order", "observed").desc(), F.col("observed").desc(), F.col("id").desc()])
    return out.drop("observed", "source_order") if mode == "reconstructed" else out


def fact_snapshot(facts: DataFrame, sources: DataFrame, t: int, keys: list[str]) -> DataFrame:
    """Facts ready at t whose source is ready, the highest revision of each key, then only active ones.

    Status counts after the choice: a retraction hides the older row. facts: keys, revision, status, source_id, ready."""
    ready = facts.join(sources.where(F.col("ready") <= t).select("source_id"), "source_id", "left_semi").where(F.col("ready") <= t)
    return latest(ready, keys, [F.col("revision").desc(), F.col("id")]).where(F.col("status") == "active")


def revision_conflicts(facts: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys with one revision number and different contents; they must stop a run."""
    return facts.groupBy(*keys, "revision").agg(F.count_distinct(F.struct(*content)).alias("contents")).where("contents > 1")


def edge_snapshot(edges: DataFrame, t: int, entity: str | int | None = None, documents: DataFrame | None = None, captures: DataFrame | None = None) -> DataFrame:
    """Edges known by t, latest revision of each id, active, and valid in [since, until).

    entity: only edges that begin or end there. documents (document_id, capture_id), captures (capture_id): only edges whose source document
    and its capture are there."""
    known = latest(edges.where(F.col("known") <= t), ["id"], [F.col("revision").desc()])
    live = known.where(F.col("active") & (F.col("since") <= t) & (F.col("until").isNull() | (F.col("until") > t)))
    if entity is not None:
        live = live.where((F.col("a") == entity) | (F.col("b") == entity))
    if documents is not None:
        sourced = documents if captures is None else documents.join(captures.select("capture_id").distinct(), "capture_id", "left_semi")
        live = live.join(sourced.select("document_id").distinct(), "document_id", "left_semi")
    return live


def layered_graph(nodes: DataFrame, edges: DataFrame, t: int, text: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes known by t whose name or kind has the text, edges known at t that begin or end at one of them).

    nodes: id, kind, name, known_from. edges: id, layer, a, b, known_from, known_to (exclusive, null for open) and others; validity is data of an edge, not a
    condition. Layers stay apart: an edge's layer says what kind of claim it is. Each edge asks for its two ends in one semi-join."""
    named = F.lower(F.concat_ws(" ", "name", "kind"))
    seen = nodes.where((F.col("known_from") <= t) & F.contains(named, F.lit(text.lower())))
    known = edges.where((F.col("known_from") <= t) & (F.col("known_to").isNull() | (F.col("known_to") > t)))
    ends = known.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("__end"))
    hit = ends.join(seen.select(F.col("id").alias("__end")), "__end", "left_semi").select("id").distinct()
    return seen, known.join(hit, "id", "left_semi")


def latest_metric(facts: DataFrame) -> DataFrame:
    """For each (entity, metric) the fact of the last period; ambiguous where that period has two keys.

    Facts with dimensions (a map that is not empty) are parts of a metric and do not count; a column `dimensions` need not be there."""
    if "dimensions" in facts.columns:
        facts = facts.where(F.col("dimensions").isNull() | (F.size("dimensions") == 0))
    r = F.rank().over(Window.partitionBy("entity", "metric").orderBy(F.desc("period_end"), F.desc("period_start")))
    top = facts.withColumn("__r", r).where("__r = 1")
    return top.groupBy("entity", "metric", "period_end", "period_start").agg(F.count_distinct("fact_key").alias("keys"), F.min("value").alias("value")).withColumn("ambiguous", F.col("keys") > 1)


def snapshot_many(decisions: DataFrame, versions: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each decision time and key the best version ready by then, as one pass over each key.

    Decisions and versions of a key are put in order of time; the best so far is a running maximum."""
    # one row for each key and decision: keys that have a version by then
    first = versions.groupBy(*keys).agg(F.min("ready").alias("__f"))
    grid = first.join(decisions, F.col("__f") <= F.col("decision")).select(*keys, F.col("decision").alias("__t"), F.lit(1).alias("__s"), F.lit(None).alias("__v"))
    payload = F.struct(order.alias("o"), F.col("id").alias("id"), F.col("value").alias("value"))
    rows = versions.select(*keys, F.col("ready").alias("__t"), F.lit(0).alias("__s"), payload.alias("__v"))
    both = rows.unionByName(grid.withColumn("__v", F.col("__v").cast(rows.schema["__v"].dataType)))
    best = F.max("__v").over(Window.partitionBy(*keys).orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__b", best).where("__s = 1").select(*keys, F.col("__t").alias("decision"), F.col("__b.id").alias("id"), F.col("__b.value").alias("value"))


def neighbour_metric(edges: DataFrame, metric: DataFrame) -> DataFrame:
    """For each b the weighted mean of the metric over its suppliers a; 0 and missing where no weight is."""
    joined = edges.join(metric, edges["a"] == metric["entity"], "left")
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    # sums of decimals are exact in any order
    mean = F.try_divide(F.sum(F.col("value") * w).cast("double"), F.sum(w).cast("double"))
    return joined.groupBy("b").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), mean.isNull().alias("missing"), F.count("*").alias("n_edges"))


def allowed(df: DataFrame, policies: DataFrame, purpose: str, t: int) -> DataFrame:
    """Rows whose provider's policy is enabled, allows the purpose and is not overdue for review; default deny."""
    ok = policies.where(F.col("enabled") & (F.col("review_due") > t) & F.coalesce(F.try_element_at("purposes", F.lit(purpose)), F.lit(False))).select("provider")
    return df.join(ok, "provider", "left_semi")


def series_catalog(metadata: DataFrame, versions: DataFrame, mode: str, snapshot: int, t: int, text: str = "", provider: str | None = None, policies: DataFrame | None = None, purpose: str = "") -> DataFrame:
    """Latest visible metadata of each series with the count of its visible versions; name filter (F19), one provider's, those that policies allow."""
    meta = latest(metadata.where((F.col("generation") <= snapshot) & (F.col("known") <= t)), ["key"], [F.col("generation").desc()])
    if provider is not None:
        meta = meta.where(F.col("provider") == provider)
    if policies is not None:
        meta = allowed(meta, policies, purpose, t)
    counts = versions.where(visible(mode, snapshot, t)).groupBy("key").agg(F.count("*").alias("versions"))
    return meta.join(counts, "key", "left").withColumn("versions", F.coalesce("versions", F.lit(0))).where(F.contains(F.lower("name"), F.lit(text.lower())))


def revision_history(versions: DataFrame, key, snapshot: int, t: int, most: int = 200) -> DataFrame:
    """Visible versions of one key, newest first; a report of at most so many rows."""
    return versions.where((F.col("key") == key) & visible("observed", snapshot, t)).orderBy(F.desc("observed"), F.desc("id")).limit(most)


def revealed(past: DataFrame, now: DataFrame) -> DataFrame:
    """For each key the last value visible in the past, and the first later period that has a value now."""
    base = past.where("value is not null").groupBy("key").agg(F.max_by(F.struct("period", "value"), F.struct("period", "id")).alias("b")).select("key", F.col("b.period").alias("base_period"), F.col("b.value").alias("base_value"))
    later = now.where("value is not null").select("key", "period", "value", "id").join(base, "key").where(F.col("period") > F.col("base_period"))
    found = later.groupBy("key").agg(F.min_by(F.struct("period", "value"), F.struct("period", "id")).alias("o"))
    return base.join(found, "key", "left").select("key", "base_period", "base_value", F.col("o.period").alias("period"), F.col("o.value").alias("value"))


def evidence(ids: DataFrame, versions: DataFrame, captures: DataFrame, series: DataFrame, policies: DataFrame, purpose: str, mode: str, snapshot: int, t: int) -> DataFrame:
    """Visible versions of the ids with their series, its policy and the receipt of their capture.

    Versions without a capture, of no visible series or of a provider that the policy denies are left out. captures: capture_id, url, receipt. In reconstructed
    mode receipts are withheld: the url stays, the note says why."""
    seen = ids.join(versions.where(visible(mode, snapshot, t)), "id")
    meta = latest(series.where((F.col("generation") <= snapshot) & (F.col("known") <= t)), ["key"], [F.col("generation").desc()]).select("key", "name", "provider")
    found = allowed(seen.join(captures, "capture_id").join(meta, "key"), policies, purpose, t).join(policies.select("provider", "purposes"), "provider")
    if mode == "reconstructed":
        found = found.withColumn("receipt", F.lit(None).cast(found.schema["receipt"].dataType)).withColumn("note", F.lit("acquisition receipt needs the current view"))
    else:
        found = found.withColumn("note", F.lit(None).cast("string"))
    return found.select("id", "key", "name", "provider", "value", "url", "receipt", "note", "purposes")


def current_vintage(observations: DataFrame, mode: str, t: int) -> DataFrame:
    """Observed by t; a reconstructed view of a current vintage is empty."""
    return observations.where((F.col("observed") <= t) if mode == "observed" else F.lit(False))


def fact_coverage(facts: DataFrame, precision: str, day: int, observed: str = "observed", published: str = "published", reconstructed: str = "reconstructed") -> DataFrame:
    """For each precision its facts, those that each mode can time, and the distinct days of publication."""
    known = ready_observed(F.col(published), F.col(observed)), ready_reconstructed(F.col(published), F.col(reconstructed))
    counts = [F.count(c).alias(n) for c, n in zip(known, ("ready_observed", "ready_reconstructed"))]
    days = F.count_distinct(F.floor(F.col(published) / day)).alias("release_days")
    return facts.groupBy(F.col(precision).alias("precision")).agg(F.count("*").alias("facts"), *counts, days)
