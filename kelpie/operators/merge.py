"""Merging tables: upserts as joins that make the new table, pruning as anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """New values over old ones unless null; of `keep_old` the old ones over the new. `rules` gives columns by expressions over
    o.column and n.column. Each side has a key once."""
    columns = [c for c in old.columns if c not in keys]
    out = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    for c in columns:
        one, two = (f"o.{c}", f"n.{c}") if c in keep_old else (f"n.{c}", f"o.{c}")
        out.append(((rules or {}).get(c) if c in (rules or {}) else F.coalesce(one, two)).alias(c))
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition &= m
    return old.alias("o").join(new.alias("n"), condition, "full").select(*out)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def pruned(nodes: DataFrame, edges: DataFrame, node_links: DataFrame, edge_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that have a source: edges without one go first, then nodes without one that no edge left names."""
    edges = edges.join(edge_links, "edge_id", "left_semi")
    ends = edges.select(F.col("first_id").alias("node_id")).union(edges.select(F.col("second_id").alias("node_id")))
    named = ends.union(node_links.select("node_id")).distinct()
    return nodes.join(named, "node_id", "left_semi"), edges


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Enabled jobs without a lease that runs, whose interval has passed since the last success or that never succeeded."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    passed = F.col("last_success_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_success_at") >= F.col("interval_seconds"))
    return jobs.filter(F.col("enabled") & free & passed)


def with_invalidation(old: DataFrame, new: DataFrame, key: str, watched: str, derived: dict[str, Column]) -> DataFrame:
    """Old rows with new values of `watched`: where it is given and differs, the derived columns fall back to the given values;
    null or equal keeps them. New keys are added with the fallbacks. Each side has a key once."""
    both = old.alias("o").join(new.select(key, watched).alias("n"), key, "full")
    changed = F.col(f"o.{key}").isNull() | (F.col(f"n.{watched}").isNotNull() & ~F.col(f"n.{watched}").eqNullSafe(F.col(f"o.{watched}")))
    kept = [F.when(changed, value).otherwise(F.col(f"o.{c}")).alias(c) for c, value in derived.items()]
    return both.select(key, F.coalesce(f"n.{watched}", f"o.{watched}").alias(watched), *kept)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there; of new rows with equal keys one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def assigned_unless_manual(rows: DataFrame, given: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """Rows with `column` as given (key, value), null where nothing is given; what was set by hand stays, the candidate is noted."""
    manual = F.coalesce(F.col(source) == "manual", F.lit(False))
    joined = rows.join(given.select(key, F.col("value").alias("candidate")), key, "left")
    kept = {column: F.when(manual, F.col(column)).otherwise(F.col("candidate")), source: F.when(manual, F.col(source)).otherwise("auto")}
    return joined.withColumns(kept)


def repointed(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """Rows with `column` moved by (old_id, new_id), each old_id once."""
    return rows.join(moves, F.col(column) == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def first_wins(passes: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """The rows of several passes one after the other, each key once, where it came first; `place` is the order over all."""
    marked = [p.withColumn("pass", F.lit(k)) for k, p in enumerate(passes)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p)
    return latest(every, [key], [F.col("pass"), *order])


def overwritten(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whole, nulls too, over old ones of the same key. Each side has a key once."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    """first_id and second_id in order instead of a and b."""
    return edges.withColumns({"first_id": F.least(a, b), "second_id": F.greatest(a, b)}).drop(*{a, b} - {"first_id", "second_id"})


def reset_on_change(rows: DataFrame, new: DataFrame, key: str, watched: str, derived: list[str]) -> DataFrame:
    """Rows with the given values of `watched` (a null one clears it); where it differs, the derived columns become null."""
    given = new.select(key, F.col(watched).alias("__new"), F.lit(True).alias("__given"))
    joined = rows.join(given, key, "left")
    differs = F.coalesce(F.col("__given") & ~F.col("__new").eqNullSafe(F.col(watched)), F.lit(False))
    cleared = {c: F.when(~differs, F.col(c)) for c in derived}
    return joined.withColumns({**cleared, watched: F.when(F.col("__given"), F.col("__new")).otherwise(F.col(watched))}).select(*rows.columns)


def published_assignments(rows: DataFrame, run: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows with cluster, tag and tag_source of a run (key, cluster, tag): all clusters are set anew, tags of that owner are cleared
    and set from the run, tags of others stay."""
    joined = rows.drop("cluster").join(run.select(key, "cluster", F.col("tag").alias("__tag")), key, "left")
    own = F.col("tag").isNull() | F.coalesce(F.col("tag_source") == owner, F.lit(False))
    tags = {"tag": F.when(own, F.col("__tag")).otherwise(F.col("tag")), "tag_source": F.when(own & F.col("__tag").isNotNull(), owner).when(~own, F.col("tag_source"))}
    return joined.withColumns(tags).drop("__tag")


def published_communities(nodes: DataFrame, communities: DataFrame, run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the run's community (node_id, community_id), null if it names none, and the communities that have a node."""
    set_ = nodes.drop("community_id").join(run.select("node_id", "community_id"), "node_id", "left")
    return set_, communities.join(set_.select("community_id"), "community_id", "left_semi")


def ensured_bindings(bindings: DataFrame, wanted: DataFrame, used: DataFrame) -> DataFrame:
    """Bindings (day, tag, overview_id, source) with one for each wanted (day, tag): there are those kept, and new ones that get
    the next ids in order of day and tag. Of those made automatically, what no used (day, tag) needs goes. New keys meet in one
    task to be numbered."""
    last = bindings.agg(F.coalesce(F.max("overview_id"), F.lit(0)).alias("__last"))
    new = wanted.select("day", "tag").distinct().join(bindings.select("day", "tag"), ["day", "tag"], "left_anti").crossJoin(F.broadcast(last))  # one row
    numbered = new.withColumn("overview_id", F.col("__last") + F.row_number().over(Window.orderBy("day", "tag"))).select("day", "tag", "overview_id", F.lit("auto").alias("source"))
    every = bindings.select("day", "tag", "overview_id", "source").union(numbered)
    needed = used.select("day", "tag", F.lit(True).alias("__used")).distinct()
    return every.join(needed, ["day", "tag"], "left").filter("source = 'manual' or __used").drop("__used")


def retagged(bindings: DataFrame, moves: DataFrame) -> DataFrame:
    """Bindings of overviews that get a new tag (overview_id, new_tag): their days go with them, but where another overview has
    that day and tag already, it stays and theirs goes."""
    moved = bindings.join(moves, "overview_id", "left").withColumn("__moves", F.col("new_tag").isNotNull()).withColumn("tag", F.coalesce("new_tag", "tag")).drop("new_tag")
    return latest(moved, ["day", "tag"], [F.col("__moves"), F.col("overview_id")]).drop("__moves")


def without_file(links: DataFrame, file_column: str, files: list) -> DataFrame:
    """Links (of nodes or edges to their sources) that don't come from the files."""
    return links.filter(~F.col(file_column).isin(files)) if files else links


def leased(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """All jobs, with the lease of those that are due set until so many seconds from now, and whether each was claimed."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    passed = F.col("last_success_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_success_at") >= F.col("interval_seconds"))
    claimed = F.col("enabled") & free & passed
    return jobs.withColumn("claimed", claimed).withColumn("lease_until", F.when(F.col("claimed"), now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease_until")))


def finished(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Jobs after outcomes (job_id, outcome): a success sets last_success_at and clears failures, a failure counts, a job put off
    only gives its lease back; each clears the lease."""
    joined = jobs.join(outcomes, "job_id", "left")
    said = lambda x: F.coalesce(F.col("outcome") == x, F.lit(False))
    return joined.withColumns({
        "last_success_at": F.when(said("success"), now).otherwise(F.col("last_success_at")),
        "failures": F.when(said("success"), 0).when(said("fail"), F.col("failures") + 1).otherwise(F.col("failures")),
        "lease_until": F.when(F.col("outcome").isNull(), F.col("lease_until")),
    }).drop("outcome")


def saved_children(old: DataFrame, saved: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (parent_id, child_id, image, note) after their parents (parent_id) were saved with the children given: those are
    upserted, an image only where none is stored; other children of these parents go; those of other parents stay."""
    both = saved.alias("n").join(old.alias("o"), ["parent_id", "child_id"], "left").select("parent_id", "child_id", F.coalesce("o.image", "n.image").alias("image"), F.col("n.note").alias("note"))
    return both.union(old.join(parents, "parent_id", "left_anti").select("parent_id", "child_id", "image", "note"))
