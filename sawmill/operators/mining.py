"""Template mining.

A masked line goes to the leaf (number of tokens, leading tokens after fan-out limits); within a leaf the first template,
in order of creation, that agrees in enough positions takes it, else it becomes a template.  Equal token lists always
share a template, so the sequential part runs over distinct lists per leaf; everything else is joins and aggregates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sawmill.config import Section
from sawmill.functions.masking import WILDCARD
from sawmill.operators.ordering import ranked as numbered
from sawmill.plans.stored import dropped, stored

SOURCES = 100


def min_required(n: int, sim_th: float) -> int:
    return n - int((1.0 - sim_th) * n)


def similarity(a: Column, b: Column, sim_th: float) -> Column:
    """Agreement of equally long token lists: 1 if all positions that are required agree and are all, (m + 0.001)/n once m
    do, else 0; a wildcard on either side agrees."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: ((x == y) | (x == WILDCARD) | (y == WILDCARD)).cast("int")), F.lit(0), lambda s, x: s + x)
    n = F.size(a)
    need = n - F.floor(F.lit(1.0 - sim_th) * n).cast("int")
    return F.when((n != F.size(b)) | (same < need), 0.0).when(need == n, 1.0).otherwise((need + 0.001) / n)


def distinct_lists(lines: DataFrame) -> DataFrame:
    """line (joined tokens), tokens, first_seq of the distinct token lists of (seq, tokens)."""
    return lines.groupBy(F.array_join("tokens", " ").alias("line")).agg(F.min("seq").alias("first_seq"), F.first("tokens").alias("tokens"))


def leaf_routing(lists: DataFrame, depth: int = 4, max_child: int = 100) -> DataFrame:
    """``lists`` (line, tokens, first_seq) with n and the routed tokens r0, r1, ...: at each level the ``max_child`` tokens
    that come first keep a child of their own, later ones share the wildcard's."""
    out, keys = lists.withColumn("n", F.size("tokens")), ["n"]
    for level in range(max(0, depth - 2)):
        token, routed = f"_t{level}", f"r{level}"
        out = out.withColumn(token, F.try_element_at("tokens", F.lit(level + 1)))
        ranked = out.where(f"{token} is not null").groupBy(*keys, token).agg(F.min("first_seq").alias("_s"))
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_s", token)))
        ranked = ranked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(token).alias("_token"), F.when(F.col("_r") <= max_child, F.col(token)).otherwise(WILDCARD).alias(routed))
        match = [out[k].eqNullSafe(ranked[f"_{k}"]) for k in keys] + [out[token] == ranked["_token"]]
        out = out.join(ranked, match, "left").drop(*[f"_{k}" for k in keys], "_token", token)
        keys.append(routed)
    return out


class Fit:
    """The templates of one leaf, in order: token lists of one length as codes, a row of the table for each position."""

    def __init__(self, n: int, sim_th: float):
        self.n, self.need, self.used, self.wild = n, min_required(n, sim_th), 0, False
        self.codes: dict[str, int] = {WILDCARD: 0}
        self.table = np.zeros((n, 16), np.int32)

    def code(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], np.int32)

    def _agree(self, x: np.ndarray) -> np.ndarray:
        """In how many positions each template agrees with each row of ``x``."""
        known = self.table[:, : self.used]
        agree = np.zeros((len(x), self.used), np.uint8 if self.n < 256 else np.uint32)
        for p in range(self.n):
            same = x[:, p, None] == known[p]
            if self.wild:
                same |= known[p] == 0
            same[x[:, p] == 0] = True
            agree += same
        return agree

    def find(self, x: np.ndarray) -> int | None:
        """The first template that agrees in enough positions."""
        if self.n and self.used:
            if self.used < 64 and not self.wild and x.all():
                hit = (self.table[:, : self.used] == x[:, None]).sum(0) >= max(self.need, 1)
            else:
                hit = self._agree(x[None])[0] >= max(self.need, 1)
            first = int(hit.argmax())
            if hit[first]:
                return first
        return 0 if self.need <= 0 and self.used else None

    def add(self, x: np.ndarray) -> int:
        if self.used == self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), 1)
        self.table[:, self.used] = x
        self.wild |= not x.all()
        self.used += 1
        return self.used - 1

    def first_of(self, lists: list[list[str]]) -> np.ndarray:
        """``find`` for many lists at once, which become no templates; -1: none."""
        out = np.full(len(lists), -1)
        x = np.array([[self.codes.get(t, -1) for t in ts] for ts in lists], np.int32).reshape(len(lists), self.n)
        step = max(1, (1 << 20) // max(1, self.used))
        for at in range(0, len(lists) if self.used else 0, step):
            hit = self._agree(x[at : at + step]) >= max(self.need, 1)
            out[at : at + step] = np.where(hit.any(1), hit.argmax(1), -1)
        return np.where(out < 0, 0, out) if self.need <= 0 and self.used else out


_SOLVED = "leaf string, at bigint, line string, tokens array<string>, seed boolean, template string"


def _solved(entries: DataFrame, sim_th: float) -> DataFrame:
    """Entries (leaf, at, line, tokens, seed) with their templates; a seed is its own.  A task streams many leaves, each in
    order, and holds the templates of one; leaves take time, not space, so none of its partitions are put together."""
    spark = entries.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        leaf = None
        for batch in batches:
            made = []
            for its, line, tokens, seed in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3, 4)], strict=True):
                if its != leaf:
                    leaf, fit, names = its, Fit(len(tokens), sim_th), []
                x = fit.code(tokens)
                found = None if seed else fit.find(x)
                if found is None:
                    found = fit.add(x)
                    names.append(line)
                made.append(names[found])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(_ARROW.field(c).type) for c in range(5)], pa.array(made, pa.string())], schema=_ARROW)

    dealt = entries.select("leaf", "at", "line", "tokens", "seed").repartition(parts, "leaf")
    return dealt.sortWithinPartitions("leaf", F.desc("seed"), "at").mapInArrow(run, _SOLVED)


class _Trie:
    """The sequential miner of one token count, for lists whose leading tokens hold literal wildcards."""

    def __init__(self, depth: int, max_child: int, sim_th: float):
        self.levels, self.most, self.sim, self.root = depth - 2, max_child, sim_th, {}

    def leaf(self, tokens: list[str], insert: bool):
        at = self.root
        for t in tokens[: max(0, min(len(tokens), self.levels))]:
            kids = at.setdefault("kids", {})
            if t in kids:
                at = kids[t]
            elif insert and len(kids) < self.most:
                at = kids.setdefault(t, {})
            elif WILDCARD in kids:
                at = kids[WILDCARD]
            elif insert:
                at = kids.setdefault(WILDCARD, {})
            else:
                return None
        if "fit" not in at:
            at["fit"], at["names"] = Fit(len(tokens), self.sim), []
        return at

    def insert(self, tokens: list[str], line: str, live: bool = True) -> None:
        """A template; one that isn't live only shapes the routing."""
        leaf = self.leaf(tokens, True)
        if live:
            leaf["fit"].add(leaf["fit"].code(tokens))
            leaf["names"].append(line)

    def add(self, tokens: list[str], line: str) -> str:
        leaf = self.leaf(tokens, False)
        found = leaf["fit"].find(leaf["fit"].code(tokens)) if leaf else None
        if found is not None:
            return leaf["names"][found]
        self.insert(tokens, line)
        return line


#: A leaf of more entries is mined in rounds of about BLOCK of its entries; templates that a pass over the rest compares with.
HOT, BLOCK, COMPARED = 100_000, 32_768, 100_000


def assign_templates(lines: DataFrame, options: Section, seeds: DataFrame | None = None, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(line, template): the joined tokens of each distinct list of ``lines`` (seq, tokens) and of the template that takes it.

    ``seeds`` (seq, tokens, gone) are templates from before, with seqs below all lines'; those that are gone (merged into
    others) only keep their place in the routing.  Leaves are mined a task each, large ones in rounds (``_rounds``).  Token
    counts in which a leading token is a literal wildcard are mined in order by one task each, as a wildcard child may then
    exist before a node is full.  The result is a stored table.
    """
    levels = max(0, options.depth - 2)
    rows = lines.select("seq", "tokens", F.lit(False).alias("seed"), F.lit(True).alias("live"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("seq", "tokens", F.lit(True).alias("seed"), (~F.col("gone")).alias("live")))
    when = lambda test: F.min(F.when(test, F.col("seq")))
    lists = rows.groupBy(F.array_join("tokens", " ").alias("line")).agg(
        F.min("seq").alias("first_seq"), F.first("tokens").alias("tokens"), when(~F.col("seed")).alias("own"), when(F.col("seed") & F.col("live")).alias("was"), F.bool_or("seed").alias("seeded")
    )
    lists = stored(lists.withColumn("n", F.size("tokens")), "lists")
    odd = lists.where(F.array_contains(F.slice("tokens", 1, levels), WILDCARD)).select("n").distinct() if levels else lists.select("n").limit(0)
    odd = stored(odd, "odd")
    is_odd = not odd.isEmpty()
    routed = leaf_routing(lists.join(odd, "n", "left_anti") if is_odd else lists, options.depth, options.max_child)
    keys = [c for c in routed.columns if c == "n" or (c[0] == "r" and c[1:].isdigit())]
    kinds = F.array(F.struct(F.lit(True).alias("seed"), F.col("was").alias("at")), F.struct(F.lit(False).alias("seed"), F.col("own").alias("at")))
    entries = routed.select(F.to_json(F.struct(*keys)).alias("leaf"), "line", "tokens", F.inline(kinds)).where("at is not null")
    entries = stored(entries, "entries")
    large = entries.groupBy("leaf").count().where(F.col("count") > hot).select("leaf")
    pairs = lambda df: df.where(~F.col("seed")).select("line", "template")
    is_large = not large.isEmpty()
    small = entries.join(large, "leaf", "left_anti") if is_large else entries
    out = pairs(_solved(small, options.sim_th))

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = _Trie(options.depth, options.max_child, options.sim_th)
        for x in pdf[pdf["seeded"]].sort_values("first_seq", kind="stable").itertuples():
            trie.insert(list(x.tokens), x.line, not np.isnan(x.was))
        own = pdf[pdf["own"].notna()].sort_values("own", kind="stable")
        return pd.DataFrame({"line": own["line"], "template": [trie.add(list(t), x) for t, x in zip(own["tokens"], own["line"], strict=True)]})

    if is_odd:
        out = out.unionByName(lists.join(odd, "n", "left_semi").withColumns({c: F.col(c).cast("double") for c in ("own", "was")}).groupBy("n").applyInPandas(in_order, "line string, template string"))
    rounds = _rounds(entries.join(large, "leaf", "left_semi"), options.sim_th, block) if is_large else []
    for part in rounds:
        out = out.unionByName(pairs(part))
    assigned = stored(out, "assigned")
    dropped(lists, odd, entries, *rounds)
    return assigned


def _rounds(entries: DataFrame, sim_th: float, block: int) -> list[DataFrame]:
    """Stored tables (leaf, at, line, tokens, seed, template) of the entries of large leaves.

    The lexicographically first greedy choice in rounds: the next entries of each leaf, about ``block``, are mined in order
    by one task; their templates stand before all later ones, so the rest of the leaf is compared with them in parallel, and
    what one takes is settled.  What none takes goes to the next round.
    """
    out: list[DataFrame] = []
    left = stored(entries, "left")
    shares = [2.0**-k for k in range(41)]
    while not left.isEmpty():
        cuts = left.groupBy("leaf").agg(F.count("*").alias("n"), F.percentile_approx("at", F.array(*[F.lit(x) for x in shares]), F.lit(1 << 16)).alias("q"))
        step = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(block)))))).cast("int")
        cuts = cuts.select("leaf", F.get("q", step).alias("cut"))
        marked = left.join(cuts, "leaf")
        solved = stored(_solved(marked.where("at <= cut"), sim_th), "solved")
        made = solved.where(F.col("seed") | (F.col("line") == F.col("template"))).select("leaf", "at", "line", "tokens", "seed")
        passes = -(-made.count() // COMPARED)
        rest = marked.where("at > cut").drop("cut")
        taken = None
        for k in range(passes):
            mine = lambda df, k=k: df if passes == 1 else df.where(F.pmod(F.xxhash64("leaf"), F.lit(passes)) == k)
            part = _taken(mine(rest), mine(made), sim_th)
            taken = part if taken is None else taken.unionByName(part)
        compared = stored(taken, "compared")
        later = stored(compared.where("template is null").drop("template"), "left")
        settled = stored(compared.where("template is not null"), "settled")
        dropped(left, compared)
        out, left = [*out, solved, settled], later
    dropped(left)
    return out


def _taken(rest: DataFrame, made: DataFrame, sim_th: float) -> DataFrame:
    """``rest`` with the first of its leaf's templates ``made`` (at most COMPARED) that takes each, or null; seeds are taken
    by none."""
    by_leaf: dict[str, list] = {}
    for r in made.collect():
        by_leaf.setdefault(r.leaf, []).append((not r.seed, r.at, r.line, list(r.tokens)))
    held = rest.sparkSession.sparkContext.broadcast({k: sorted(v) for k, v in by_leaf.items()})

    def run(batches):
        fits: dict[str, tuple[Fit, list[str]]] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            pdf["template"] = None
            for leaf, at in pdf[~pdf["seed"]].groupby("leaf").groups.items():
                if leaf not in fits:
                    templates = held.value.get(leaf, [])
                    fit = Fit(len(templates[0][3]) if templates else 0, sim_th)
                    for t in templates:
                        fit.add(fit.code(t[3]))
                    fits[leaf] = fit, [t[2] for t in templates]
                fit, names = fits[leaf]
                found = fit.first_of([list(t) for t in pdf.loc[at, "tokens"]]) if names else np.full(len(at), -1)
                pdf.loc[at, "template"] = [names[g] if g >= 0 else None for g in found]
            yield pa.RecordBatch.from_pandas(pdf[["leaf", "at", "line", "tokens", "seed", "template"]], schema=_ARROW, preserve_index=False)

    return rest.select("leaf", "at", "line", "tokens", "seed").mapInArrow(run, _SOLVED)


_ARROW = pa.schema([("leaf", pa.string()), ("at", pa.int64()), ("line", pa.string()), ("tokens", pa.list_(pa.string())), ("seed", pa.bool_()), ("template", pa.string())])


def template_ids(lines: DataFrame, assigned: DataFrame, first: int = 1) -> DataFrame:
    """(template_id, template, tokens, created_seq): ids T%06d in order of creation; a stored table, ranked by
    tasks."""
    created = lines.groupBy(F.array_join("tokens", " ").alias("template")).agg(F.min("seq").alias("created_seq"))
    created = created.join(assigned.select("template").distinct(), "template", "left_semi")
    created = numbered(created, [F.col("created_seq"), F.col("template")], "_rank")
    return created.select(F.format_string("T%06d", F.col("_rank") + first).alias("template_id"), "template", F.split("template", " ").alias("tokens"), "created_seq")


def assignments(lines: DataFrame, assigned: DataFrame, ids: DataFrame) -> DataFrame:
    """``lines`` (seq, ts, level, source, tokens) with template_id."""
    named = assigned.join(ids.select("template", "template_id"), "template").select("line", "template_id")
    keyed = lines.withColumn("line", F.array_join("tokens", " "))
    return keyed.join(named, "line").drop("line")


def template_stats(rows: DataFrame) -> DataFrame:
    """By template_id: count, first_seen, last_seen, level_counts, sources (the first SOURCES in order of appearance,
    without empty ones), is_error, main_level (the most frequent; of equal ones the first to appear)."""
    base = rows.groupBy("template_id").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.bool_or(F.col("level").isin("ERROR", "FATAL")).alias("is_error"))
    levels = level_histogram(rows).groupBy("template_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts"),
        F.max_by("level", F.struct("n", -F.col("first_seq"))).alias("main_level"),
    )
    return base.join(levels, "template_id", "left").join(source_lists(rows), "template_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def level_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("template_id", "level").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def source_lists(rows: DataFrame, most: int = SOURCES) -> DataFrame:
    seen = rows.where("source <> ''").groupBy("template_id", "source").agg(F.min("seq").alias("s"))
    seen = seen.withColumn("k", F.row_number().over(Window.partitionBy("template_id").orderBy("s", "source"))).where(F.col("k") <= most)
    return seen.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda x: x["source"]).alias("sources"))


def merge_candidates(templates: DataFrame) -> DataFrame:
    """Pairs (a, b) of templates of one length that differ in just one position ``pos``: an equi-join on the tokens with
    that position blanked, instead of all pairs."""
    blank = templates.select("template_id", "tokens", F.posexplode("tokens").alias("pos", "token"))
    blank = blank.select("template_id", "pos", "token", F.array_join(F.transform("tokens", lambda t, i: F.when(i == F.col("pos"), "\u0001").otherwise(t)), " ").alias("key"))
    a, b = blank.alias("a"), blank.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.template_id") < F.col("b.template_id")) & (F.col("a.token") != F.col("b.token"))
    return a.join(b, same).select(F.col("a.template_id").alias("a"), F.col("b.template_id").alias("b"), F.col("a.pos").alias("pos"))


class Merger:
    """Templates that differ in one position become one with a wildcard there, until none do.

    Always merges the pair that comes first in order (of the dict of templates).  Pairs come from buckets of templates
    that are equal but for one position, so the next pair is found without comparing all.
    """

    def __init__(self, templates: list[tuple[str, list[str]]], last_id: int | None = None):
        self.ids: list[str] = []
        self.tokens: list[list[str] | None] = []
        self.where: dict[tuple[str, ...], int] = {}
        # by key: its templates in order, the places of the first live one and of the one it was last paired with, the pair on offer
        self.buckets: dict[tuple, list[int]] = {}
        self.place: dict[tuple, tuple[int, int]] = {}
        self.offered: dict[tuple, tuple[int, int]] = {}
        self.heap: list[tuple[int, int, tuple]] = []
        self.last = last_id if last_id is not None else max((int(t[1:]) for t, _ in templates if t[1:].isdigit()), default=0)
        #: (merged id, into id, kind): kinds are wildcard, existing, created
        self.events: list[tuple[str, str, str]] = []
        #: the places of the first template of the pair that each event comes from
        self.firsts: list[int] = []
        for name, tokens in templates:
            self._add(name, list(tokens))

    def _keys(self, tokens: list[str]):
        for p in range(len(tokens)):
            yield (p, *tokens[:p], None, *tokens[p + 1 :])

    def _add(self, name: str, tokens: list[str]) -> int:
        at = len(self.ids)
        self.ids.append(name)
        self.tokens.append(tokens)
        self.where.setdefault(tuple(tokens), at)
        for key in self._keys(tokens):
            self.buckets.setdefault(key, []).append(at)
            if key not in self.offered:
                self._offer(key)
        return at

    def _offer(self, key: tuple) -> None:
        """Puts the first pair of the bucket on offer.  Places only move on, so a bucket is walked once for each first."""
        bucket, tokens = self.buckets[key], self.tokens
        first, second = self.place.get(key, (0, 1))
        self.offered.pop(key, None)
        while first < len(bucket):
            if tokens[bucket[first]] is None:
                first, second = first + 1, first + 2
                continue
            while second < len(bucket) and (tokens[bucket[second]] is None or tokens[bucket[second]] == tokens[bucket[first]]):
                second += 1
            if second < len(bucket):
                self.place[key] = first, second
                self.offered[key] = bucket[first], bucket[second]
                heapq.heappush(self.heap, (bucket[first], bucket[second], key))
                return
            # equal ones alone are left behind it: none pairs with it until one is added
            break
        self.place[key] = first, second

    def _drop(self, at: int, into: int, kind: str) -> None:
        tokens = self.tokens[at]
        self.tokens[at] = None
        if self.where.get(tuple(tokens)) == at:
            del self.where[tuple(tokens)]
        self.events.append((self.ids[at], self.ids[into], kind))
        self.firsts.append(self.first)
        for key in self._keys(tokens):
            if at in self.offered.get(key, ()):
                self._offer(key)

    def run(self) -> list[tuple[str, list[str]]]:
        while self.heap:
            a, b, key = heapq.heappop(self.heap)
            if self.offered.get(key) != (a, b):
                continue
            x, y = self.tokens[a], self.tokens[b]
            p, self.first = key[0], a
            if WILDCARD in (x[p], y[p]):
                gone, into = (b, a) if x[p] == WILDCARD else (a, b)
                self._drop(gone, into, "wildcard")
                continue
            made = [*x[:p], WILDCARD, *x[p + 1 :]]
            into, kind = self.where.get(tuple(made)), "existing"
            if into is None:
                self.last, kind = self.last + 1, "created"
                into = self._add(f"T{self.last:06d}", made)
            self._drop(a, into, kind)
            self._drop(b, into, kind)
        return [(i, t) for i, t in zip(self.ids, self.tokens, strict=True) if t is not None]

    def lineage(self) -> dict[str, str]:
        """The final id of each id that ever was."""
        up = {a: b for a, b, _ in self.events}

        def root(x: str) -> str:
            while x in up:
                x = up[x]
            return x

        return {i: root(i) for i in self.ids}


#: So many templates at most are merged in one step on the driver (about 9 KB each of 15 tokens), more by components.
HERE = 20_000
_MERGES = "template_id string, related_template_id string, kind string, step {}"


def merge_templates(templates: DataFrame, last_id: int | None = None, here: int = HERE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged templates (template_id, template, tokens, rank), lineage (raw_id, template_id) and events (template_id,
    related_template_id, kind, step) of templates (template_id, tokens) in order of their ids; made ones get the ids behind
    ``last_id`` (by default the largest).  Any number of templates: see ``merging``."""
    spark = templates.sparkSession
    ordered = templates.select("template_id", "tokens").orderBy("template_id").limit(here + 1).collect()
    if len(ordered) > here:
        from sawmill.operators import merging

        return merging.merge_by_components(templates, last_id)
    merger = Merger([(r.template_id, list(r.tokens)) for r in ordered], last_id)
    kept = merger.run()
    merged = spark.createDataFrame([(i, " ".join(t), t, k) for k, (i, t) in enumerate(kept)], "template_id string, template string, tokens array<string>, rank int")
    lineage = spark.createDataFrame(list(merger.lineage().items()), "raw_id string, template_id string")
    events = spark.createDataFrame([(*e, k) for k, e in enumerate(merger.events)], _MERGES.format("int"))
    return merged, lineage, events


def merged_rows(rows: DataFrame, lineage: DataFrame, how: str = "inner") -> DataFrame:
    """Assignments under their final ids; with ``how="left"`` an id without a lineage stays."""
    final = lineage.withColumnRenamed("template_id", "_final")
    joined = rows.withColumnRenamed("template_id", "raw_id").join(final, "raw_id", how)
    return joined.withColumn("template_id", F.coalesce("_final", "raw_id")).drop("raw_id", "_final")


def compress(templates: DataFrame, max_templates: int, rare_count: int) -> DataFrame:
    """is_rare: of count below ``rare_count``, if there are more than ``max_templates`` templates."""
    many = templates.agg((F.count("*") > max_templates).alias("many")).first().many
    return templates.withColumn("is_rare", F.col("count") < rare_count if many else F.lit(False))


def lifecycle_events(templates: DataFrame, merges: DataFrame) -> DataFrame:
    """created, merged and compressed events; ``at``: when the template was first seen."""
    created = templates.select(F.col("first_seen").alias("at"), F.lit("created").alias("event_type"), "template_id", F.lit(None).cast("string").alias("related_template_id"), F.lit("").alias("details"))
    merged = merges.select(F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("merged").alias("event_type"), "template_id", "related_template_id", F.col("kind").alias("details"))
    out = created.unionByName(merged)
    if "is_rare" in templates.columns:
        rare = templates.where("is_rare").select(F.col("last_seen").alias("at"), F.lit("compressed").alias("event_type"), "template_id", F.lit(None).cast("string").alias("related_template_id"), F.concat(F.lit("count="), F.col("count")).alias("details"))
        out = out.unionByName(rare)
    return out


def active_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times, at least 0."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1e6)


#: Scores that are looked for first, from above: the best match of most templates is a close one.
SCORES = (0.9, 0.75, 0.5)


def reconcile(a: DataFrame, b: DataFrame, sim_th: float) -> DataFrame:
    """Template library ``b`` joined into ``a`` (template_id, template, tokens, count): rows of b by where they go.

    match: exact (equal text), similar (the best positional similarity of at least sim_th among a's templates of that
    length, the least a_id of equally good ones; ``wildcard_pos`` if just one position differs) or new.
    """
    exact = b.alias("b").join(a.alias("a"), F.col("a.template") == F.col("b.template")).select(F.col("b.template_id").alias("b_id"), F.col("a.template_id").alias("a_id"), F.lit("exact").alias("match"), F.lit(1.0).alias("score"), F.lit(None).cast("int").alias("wildcard_pos"))
    rest = b.join(exact.select(F.col("b_id").alias("template_id")), "template_id", "left_anti")
    left, right = (stored(x.select("template_id", "tokens", F.size("tokens").alias("n")), "side") for x in (a, rest))
    equal = F.zip_with("ta", "tb", lambda x, y: (x == y) | (x == WILDCARD) | (y == WILDCARD))
    best = _best_matches(left, right, sim_th, equal)
    pos = F.when(F.col("n") - F.col("same") == 1, F.array_position(F.transform(equal, lambda x: (~x).cast("int")), 1).cast("int") - 1)
    similar = best.select("b_id", "a_id", F.lit("similar").alias("match"), "score", pos.alias("wildcard_pos"))
    placed = exact.unionByName(similar)
    new = b.join(placed.select(F.col("b_id").alias("template_id")), "template_id", "left_anti").select(F.col("template_id").alias("b_id"), F.lit(None).cast("string").alias("a_id"), F.lit("new").alias("match"), F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("wildcard_pos"))
    return placed.unionByName(new)


def _best_matches(a: DataFrame, b: DataFrame, sim_th: float, equal: Column) -> DataFrame:
    """(b_id, a_id, ta, tb, n, same, score) of the best match of each of b's lists that has one.

    A prefix filter over an inverted index (length, position, token), exactly: with k positions at most that differ, one of
    any k + 1 positions of a list agrees.  So the k + 1 positions whose tokens are rarest in a are looked up, each under its
    token and under the wildcard, and only lists met there are compared.  Scores are lowered in steps: a match of at least a
    step's score is the best of all, so only lists without one go on, and few need the many positions of a low score.
    """
    index = stored(a.select(F.col("template_id").alias("a_id"), "n", F.posexplode("tokens").alias("pos", "token")), "index")
    often = index.groupBy("n", "pos", "token").agg(F.count("*").alias("f"))
    wild = often.where(F.col("token") == WILDCARD).select("n", "pos", F.col("f").alias("w"))
    literal = b.select(F.col("template_id").alias("b_id"), "n", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != WILDCARD)
    cost = literal.join(often, ["n", "pos", "token"], "left").join(wild, ["n", "pos"], "left").withColumn("cost", F.coalesce("f", F.lit(0)) + F.coalesce("w", F.lit(0)))
    w = Window.partitionBy("b_id").orderBy("cost", "pos")
    rarest = stored(cost.select("b_id", "n", "pos", "token", F.row_number().over(w).alias("r")), "rarest")
    least = a.groupBy("n").agg(F.min("template_id").alias("a_id"))
    found, left = None, b.select(F.col("template_id").alias("b_id"), F.col("tokens").alias("tb"), "n")
    for score in [s for s in SCORES if s > sim_th] + [sim_th]:
        most = F.col("n") - F.ceil(F.col("n") * F.lit(float(score)) - 1e-9)
        asked = rarest.where(F.col("r") <= most + 1).join(left.select("b_id"), "b_id", "left_semi")
        asked = asked.select("b_id", "n", "pos", F.explode(F.array("token", F.lit(WILDCARD))).alias("token"))
        met = asked.join(index, ["n", "pos", "token"]).select("b_id", "a_id").distinct()
        # a list of few literals agrees with all where none of them meets any: the least id stands for those
        lowest = left.where(F.lit(score == sim_th)).join(least, "n").select("b_id", "a_id")
        pairs = met.unionByName(lowest).distinct().join(left, "b_id").join(a.select(F.col("template_id").alias("a_id"), F.col("tokens").alias("ta")), "a_id")
        scored = pairs.withColumn("same", F.size(F.filter(equal, lambda x: x))).withColumn("score", F.col("same") / F.col("n")).where(F.col("score") >= score)
        best = scored.groupBy("b_id").agg(F.min_by(F.struct("a_id", "ta", "tb", "n", "same", "score"), F.struct(-F.col("score"), "a_id")).alias("m"))
        part = stored(best.select("b_id", "m.*"), "matched")
        found = part if found is None else found.unionByName(part)
        left = left.join(part.select("b_id"), "b_id", "left_anti")
    return found
