"""The merge of templates that differ in one position, off the driver.

Templates can only meet if a chain of one-position differences joins them, among them and the wildcard templates that could
be made of them.  So the closure of such differences is computed in rounds, its connected components are merged in parallel,
each in its own order, and the order over all components follows afterwards: the merger always takes the pair that is first
in order, so the pairs of all components interleave by the first template of a pair.  Pairs whose first template was made
come behind all others, in the order in which it was made: a level for each generation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions.masking import WILDCARD
from sawmill.operators.graph import components
from sawmill.operators.mining import Merger
from sawmill.operators.ordering import ranked
from sawmill.plans.stored import dropped, stored

_BLANK = "\u0001"


def _buckets(nodes: DataFrame) -> DataFrame:
    """(text, key, token): a row for each position of each node, under its tokens with that position blanked."""
    at = nodes.select("text", F.posexplode(F.split("text", " ")).alias("pos", "token"), F.split("text", " ").alias("tokens"))
    blanked = F.array_join(F.transform("tokens", lambda t, i: F.when(i == F.col("pos"), F.lit(_BLANK)).otherwise(t)), " ")
    return at.select("text", blanked.alias("key"), "token")


def closure(texts: DataFrame) -> DataFrame:
    """(text, key) of the nodes and the buckets in which they have company, for ``texts`` and all that could be made."""
    nodes = stored(texts.select("text").distinct(), "nodes")
    rows = stored(_buckets(nodes), "buckets")
    parts, fresh = [nodes, rows], True
    while fresh:
        shared = rows.groupBy("key").agg(F.count_distinct("token").alias("n")).where("n > 1").select("key")
        made = shared.select(F.replace("key", F.lit(_BLANK), F.lit(WILDCARD)).alias("text")).distinct()
        new = stored(made.join(nodes, "text", "left_anti"), "made")
        parts.append(new)
        fresh = not new.isEmpty()
        if fresh:
            more = stored(_buckets(new), "buckets")
            parts.append(more)
            nodes, rows = nodes.unionByName(new), rows.unionByName(more)
    shared = rows.groupBy("key").agg(F.count_distinct("text").alias("n")).where("n > 1").select("key")
    out = stored(rows.join(shared, "key").select("text", "key"), "shared")
    dropped(*parts)
    return out


_STEPS = "component string, step bigint, template_id string, into_old string, into_made int, gone_made int, kind string, level int, first_rank bigint, first_made int, made int"


def _merged_component(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges one component; a row for each event and, with a kind of ``kept``, for each template that is left.  Made
    templates are numbered from 0 within the component."""
    pdf = pdf.sort_values("rank", kind="stable")
    n, comp = len(pdf), pdf["component"].iloc[0]
    ranks = pdf["rank"].to_numpy()
    merger = Merger([(str(k), list(t)) for k, t in enumerate(pdf["tokens"])], n - 1)
    # the merger's ids: places of the originals as they are, made ones as T%06d from n on
    place = {i: k for k, i in enumerate(merger.ids)}
    kept = merger.run()
    place = {i: k for k, i in enumerate(merger.ids)}
    ids = pdf["template_id"].to_numpy()
    made_level: dict[int, int] = {}
    seen: set[int] = set()
    level, key = 0, -1
    out = []
    for step, ((gone, into, kind), first) in enumerate(zip(merger.events, merger.firsts, strict=True)):
        g, i = place[gone], place[into]
        up = made_level[first] + 1 if first >= n else 0
        this = int(ranks[first]) if first < n else first - n
        if up > level:
            level, key = up, this
        elif up == level:
            key = max(key, this)
        new = i >= n and i not in seen and kind == "created"
        if new:
            seen.add(i)
            made_level[i] = level
        out.append((comp, step, ids[g] if g < n else None, ids[i] if i < n else None, i - n if i >= n else None, g - n if g >= n else None, kind, level, key if level == 0 else None, key if level else None, i - n if new else None, None))
    for name, tokens in kept:
        k = place[name]
        out.append((comp, -1, ids[k] if k < n else None, None, k - n if k >= n else None, None, "kept", None, None, None, None, tokens))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _STEPS.split(", ")] + ["tokens"])
    return frame.astype({c: "Int64" for c in ("step", "into_made", "gone_made", "level", "first_rank", "first_made", "made")}).replace({np.nan: None})


def merge_by_components(templates: DataFrame, last_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``mining.merge_templates``; a component is one task's work, and what it makes is numbered by ranked tables."""
    ordered = ranked(templates.select("template_id", "tokens"), [F.asc("template_id")], "rank")
    ordered = stored(ordered.withColumn("text", F.array_join("tokens", " ")), "ordered")
    if last_id is None:
        last_id = ordered.agg(F.coalesce(F.max(F.expr("try_cast(substring(template_id, 2) as bigint)")), F.lit(0)).alias("n")).first().n
    shared = closure(ordered)
    parts = stored(components(shared.select(F.concat(F.lit("t"), "text").alias("u"), F.concat(F.lit("k"), "key").alias("v"))), "components")
    of = parts.where(F.col("node").startswith("t")).select(F.expr("substring(node, 2)").alias("text"), "component")
    member = stored(ordered.join(of, "text"), "members")
    done = stored(member.select("component", "template_id", "tokens", "rank").groupBy("component").applyInPandas(_merged_component, _STEPS + ", tokens array<string>"), "merged")
    steps = done.where("step >= 0")

    # the order over all components, a level after the other: (component, step, at)
    deepest = steps.agg(F.coalesce(F.max("level"), F.lit(-1)).alias("n")).first().n
    placed, base, previous = None, 0, None
    for level in range(deepest + 1):
        here = steps.where(F.col("level") == level)
        if level:
            # where the first template of the pair was made
            at_made = previous.join(steps.where("made is not null").select("component", "step", F.col("made").alias("first_made")), ["component", "step"])
            here = here.join(at_made.select("component", "first_made", F.col("at").alias("key")), ["component", "first_made"])
        else:
            here = here.withColumn("key", F.col("first_rank"))
        part = ranked(here.select("component", "step", "key"), [F.asc("key"), F.asc("component"), F.asc("step")], "at")
        part = stored(part.select("component", "step", (F.col("at") + base).alias("at")), "placed")
        base += part.count()
        previous = part
        placed = part if placed is None else placed.unionByName(part)
    spark = templates.sparkSession
    if placed is None:
        placed = spark.createDataFrame([], "component string, step bigint, at bigint")
    timed = stored(steps.join(placed, ["component", "step"]), "timed")
    born = ranked(timed.where("made is not null").select("component", F.col("made").alias("k"), "at"), [F.asc("at")], "n")
    born = stored(born.select("component", "k", F.format_string("T%06d", F.col("n") + (last_id + 1)).alias("name"), "at"), "born")
    into = born.select("component", F.col("k").alias("into_made"), F.col("name").alias("into_name"))
    gone = born.select("component", F.col("k").alias("gone_made"), F.col("name").alias("gone_name"))
    events = timed.join(into, ["component", "into_made"], "left").join(gone, ["component", "gone_made"], "left")
    events = stored(events.select(F.coalesce("template_id", "gone_name").alias("template_id"), F.coalesce("into_old", "into_name").alias("related_template_id"), "kind", F.col("at").alias("step")), "events")

    kept = done.where("step < 0").join(into, ["component", "into_made"], "left").select(F.coalesce("template_id", "into_name").alias("template_id"), "tokens", F.when(F.col("template_id").isNull(), 1).otherwise(0).alias("_made"))
    alone = ordered.join(member.select("template_id"), "template_id", "left_anti").select("template_id", "tokens", F.lit(0).alias("_made"))
    # made templates stand behind all others, in the order in which they were made, which is that of their ids
    number = F.expr("try_cast(substring(template_id, 2) as bigint)")
    merged = ranked(kept.unionByName(alone), [F.asc("_made"), F.when(F.col("_made") == 1, number).asc(), F.asc("template_id")], "rank")
    merged = stored(merged.select("template_id", F.array_join("tokens", " ").alias("template"), "tokens", F.col("rank").cast("int").alias("rank")), "merged-templates")

    # the final id of each: up the events, doubling the way each round
    up = stored(events.select(F.col("template_id").alias("raw_id"), F.col("related_template_id").alias("template_id")), "up")
    while True:
        above = up.select(F.col("raw_id").alias("template_id"), F.col("template_id").alias("_above"))
        moved = up.join(above, "template_id", "left")
        further = stored(moved.select("raw_id", F.coalesce("_above", "template_id").alias("template_id"), F.col("_above").isNotNull().alias("_moved")), "up")
        more = not further.where("_moved").isEmpty()
        up = further.drop("_moved")
        if not more:
            break
    stay = merged.select(F.col("template_id").alias("raw_id"), "template_id")
    lineage = stored(up.unionByName(stay), "lineage")
    dropped(shared, parts, member, done, timed)
    return merged, lineage, events
