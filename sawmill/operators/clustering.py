"""Leader clustering of templates by token edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.operators.ordering import ranked
from sawmill.plans.stored import dropped, stored


def spelled(tokens: Column, alphabet: Column) -> Column:
    """The tokens as a string of one character each: that of a token's place in ``alphabet``."""
    char = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, t) + 0x10000), 8, "0")), "UTF-32")
    return F.array_join(F.transform(tokens, char), "")


def token_distance(a: Column, b: Column) -> Column:
    """Edits between two lists of tokens, divided by the longer length; 0 for two empty ones.  Both are spelled in the
    alphabet of the pair, so that the built-in levenshtein counts tokens whatever their number in all lists."""
    longer, union = F.greatest(F.size(a), F.size(b)), F.array_union(a, b)
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(spelled(a, union), spelled(b, union)) / longer)


def near_pairs(templates: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, distance) nearer than ``threshold``, a before b by name.

    With k edits at most, k + 1 segments of the longer list leave one untouched, which stands in the other list no more
    than k places away.  So pairs come from an equi-join on (length of the longer, segment, its tokens), exactly, and only
    these are compared.
    """
    t = templates.select("template_id", "tokens", F.size("tokens").alias("n")).where("n > 0")
    k = lambda n: (F.ceil(n * threshold + 1e-9) - 1).cast("int")
    begin = lambda i, n: F.floor(i * n / (k(n) + 1)).cast("int")
    segment = lambda at, width: F.xxhash64(F.slice("tokens", at + 1, width)).alias("segment")
    long = t.select(F.col("template_id").alias("a"), "tokens", "n", F.explode(F.sequence(F.lit(0), k(F.col("n")))).alias("i"))
    at, to = begin(F.col("i"), F.col("n")), begin(F.col("i") + 1, F.col("n"))
    long = long.select("a", F.col("tokens").alias("ta"), "n", "i", segment(at, to - at))
    most = F.floor(F.col("m") / (1 - threshold)).cast("int") + 1
    short = t.select(F.col("template_id").alias("b"), "tokens", F.col("n").alias("m")).withColumn("n", F.explode(F.sequence(F.col("m"), most)))
    short = short.where(F.col("n") - k(F.col("n")) <= F.col("m")).withColumn("i", F.explode(F.sequence(F.lit(0), k(F.col("n")))))
    short = short.withColumn("at", at).withColumn("width", to - at)
    low, high = F.greatest(F.col("at") - k(F.col("n")), F.lit(0)), F.least(F.col("at") + k(F.col("n")), F.col("m") - F.col("width"))
    short = short.where(low <= high).withColumn("s", F.explode(F.sequence(low, high))).select("b", F.col("tokens").alias("tb"), "n", "i", segment(F.col("s"), F.col("width"))).dropDuplicates(["b", "n", "i", "segment"])
    pairs = long.join(short, ["n", "i", "segment"])
    # equally long lists meet twice; where they differ in length, a is the longer one
    once = (F.col("n") > F.size("tb")) | (F.col("a") < F.col("b"))
    pairs = pairs.where((F.col("a") != F.col("b")) & once)
    # tokens in common, with repeats left out: a cheap bound before the distance
    lost = F.size(F.array_distinct("ta")) - F.size(F.array_intersect("ta", "tb"))
    pairs = pairs.where(lost <= k(F.col("n"))).dropDuplicates(["a", "b"])
    found = pairs.withColumn("distance", token_distance(F.col("ta"), F.col("tb"))).where(F.col("distance") < threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


#: So many pairs at most are finished in one step on the driver instead of in rounds.
HERE = 100_000


def leaders(pairs: DataFrame, here: int = HERE) -> DataFrame:
    """Of (x, y), x before y, the y that are no leaders: those with a leader among their x.

    The lexicographically first choice in rounds: who has nobody left before it leads, who has a leader before it doesn't,
    and the pairs of both are done with; once at most ``here`` pairs are left, they are walked in order.
    """
    out, left = None, stored(pairs.select("x", "y"), "pairs")
    while n := left.count():
        if n <= here:
            followers: set = set()
            for y, x in sorted((r.y, r.x) for r in left.collect()):
                if x not in followers:
                    followers.add(y)
            last = left.sparkSession.createDataFrame([(y,) for y in followers], left.select("y").schema)
            out = last if out is None else out.unionByName(last)
            break
        free = left.select("x").distinct().join(left.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
        led = stored(left.join(free, "x", "left_semi").select("y").distinct(), "led")
        done = free.select(F.col("x").alias("z")).unionByName(led.select(F.col("y").alias("z")))
        rest = left.join(done, left["x"] == done["z"], "left_anti").join(led, "y", "left_anti")
        later = stored(rest.select("x", "y"), "pairs")
        dropped(left)
        out, left = led if out is None else out.unionByName(led), later
    dropped(left)
    return pairs.select("y").limit(0) if out is None else out


def cluster(templates: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(cluster_id, representative_id, template_id, rank): templates by count, descending, join the nearest leader closer
    than ``threshold`` (of equally near ones the older), else lead themselves.  Any number of templates: near pairs, rounds
    of leaders and places are joins and aggregates."""
    order = ranked(templates.select("template_id", "count"), [F.desc("count"), F.asc("template_id")], "rank").select("template_id", "rank")
    order = stored(order, "order")
    of = lambda c, to: order.select(F.col("template_id").alias(c), F.col("rank").alias(to))
    near = near_pairs(templates, threshold).join(of("a", "ra"), "a").join(of("b", "rb"), "b")
    near = stored(near.select(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"), "distance"), "near")
    led = stored(leaders(near), "led")
    joined = near.join(led, "y").join(led.select(F.col("y").alias("x")), "x", "left_anti")
    best = joined.groupBy("y").agg(F.min(F.struct("distance", "x")).alias("m")).select(F.col("y").alias("rank"), F.col("m.x").alias("lead"))
    heads = ranked(order.join(led.select(F.col("y").alias("rank")), "rank", "left_anti"), [F.asc("rank")], "age")
    heads = heads.select(F.col("rank").alias("lead"), F.col("template_id").alias("representative_id"), F.format_string("C%04d", F.col("age") + 1).alias("cluster_id"))
    placed = order.join(best, "rank", "left").withColumn("lead", F.coalesce("lead", "rank"))
    return placed.join(heads, "lead").select("cluster_id", "representative_id", "template_id", F.col("rank").cast("int").alias("rank"))


def cluster_stats(members: DataFrame, templates: DataFrame) -> DataFrame:
    """By cluster: representative, members in order, total_count, first_seen, last_seen; by total_count, descending."""
    joined = members.join(templates.select("template_id", "template", "count", "first_seen", "last_seen"), "template_id")
    out = joined.groupBy("cluster_id", "representative_id").agg(
        F.max(F.when(F.col("template_id") == F.col("representative_id"), F.col("template"))).alias("representative_str"),
        F.sum("count").alias("total_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "template_id"))), lambda x: x["template_id"]).alias("templates"),
    )
    return out.orderBy(F.desc("total_count"), "cluster_id")
