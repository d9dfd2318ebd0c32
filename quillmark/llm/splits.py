"""Problem 7: splits that keep related records together, by min-cost flow over bundles.

1. Records are tied by repo (either table, any spelling) and repos by common authors: connected components.
2. Components of identical size and label profile form a bundle; a large component is a bundle of one.  (Sizes over
   ``EXACT`` that differ by less than one in ``EXACT`` / 2 are taken as one, so that the number of bundles is bounded by
   some 130 for each doubling of size and profile, however many components there are.)
3. A min-cost flow sends the bundles' records to (split, profile) nodes with quotas; flow beyond a quota costs its
   deviation.
4. Flows are rounded to whole components, the bundles of the largest components first; where what is rounded off
   exceeds ``DRIFT`` of all records the flow of the bundles that are left is solved again, so what large components take
   is made up for by small ones.  Last, bundles of one are moved or exchanged while that lowers the cost,
   and components of equal size exchanged between splits to bring the rates of label 1 together.
5. A bundle's components are numbered in hash order by salted prefix sums and take their split by number.

Rows are only touched by the partial aggregation of records per node and by one join with each node's split.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.normalize import clean_name, repo_key
from quillmark.operators.components import connected_components
from quillmark.operators.skew import join_heavy
from quillmark.sources.tables import materialize, table

EXACT = 256
DRIFT = 0.0005
LEVELS = 8  # steps of the share of label 1
SALTS, SALT_NODES = 64, 250_000  # at least so many tasks number a bundle, of about so many components
BLOCK = 1024  # repos of a component that are paired in one task


class Flow:
    """Min-cost flow by successive shortest paths with potentials; integral capacities and costs >= 0."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, u: object, v: object, cap: int, cost: int) -> int:
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out.setdefault(a, []).append(len(self.to))
            self.out.setdefault(b, [])
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: object, t: object) -> int:
        if s not in self.out or t not in self.out:
            return 0
        high = dict.fromkeys(self.out, 0)
        total = 0
        while True:
            dist, via, heap, order = {s: 0}, {}, [(0, 0, s)], 0
            while heap:
                d, _, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    nd = d + self.cost[e] + high[u] - high[v]
                    if self.cap[e] and nd < dist.get(v, 1 << 60):
                        dist[v], via[v] = nd, e
                        order += 1
                        heapq.heappush(heap, (nd, order, v))
            if t not in dist:
                return total
            for v in high:
                high[v] += min(dist.get(v, dist[t]), dist[t])
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def profile_quotas(room: dict[str, float], need: dict[str, float], sizes: dict[int, int], rates: dict[int, float]) -> dict[tuple[str, int], float]:
    """Records of each (split, profile): sums match the rooms and the profiles, and each split's expected
    labels come as near to ``need`` as tilting towards profiles of higher or lower rate can bring them."""
    splits, profiles = sorted(room), sorted(sizes)
    tilt = dict.fromkeys(splits, 0.0)
    row = dict.fromkeys(splits, 1.0)
    q: dict[tuple[str, int], float] = {}
    for _ in range(400):
        for p in profiles:
            w = {s: row[s] * room[s] * math.exp(tilt[s] * rates[p]) for s in splits}
            t = sum(w.values()) or 1.0
            for s in splits:
                q[s, p] = sizes[p] * w[s] / t
        for s in splits:
            have = sum(q[s, p] for p in profiles)
            if have:
                row[s] *= room[s] / have
            got = sum(q[s, p] * rates[p] for p in profiles)
            tilt[s] = min(12.0, max(-12.0, tilt[s] + 2.0 * (need[s] - got) / max(1.0, room[s])))
    return q


class Plan:
    """Quotas of records by split, and what is placed so far: records, and labels 1 beyond the common rate (``excess``:
    labels 1 less rate times labelled records; it is additive, and zero in each split means equal rates)."""

    def __init__(self, shares: dict[str, float], total: int):
        whole = sum(shares.values())
        self.splits = sorted(shares)
        self.quota = {s: shares[s] / whole * total for s in self.splits}
        self.size, self.excess = dict.fromkeys(self.splits, 0.0), dict.fromkeys(self.splits, 0.0)

    def add(self, s: str, records: float, excess: float) -> None:
        self.size[s] += records
        self.excess[s] += excess

    def cost(self) -> float:
        return sum(abs(self.size[s] - self.quota[s]) + abs(self.excess[s]) for s in self.splits)

    def flow(self, left: list[tuple]) -> dict[tuple[object, str], float]:
        """Share of each profile's records that goes to each split, by min-cost flow over the bundles (name, profile,
        components, records, excess) that are left."""
        rest = sum(b[3] for b in left)
        room = {s: max(0.0, self.quota[s] - self.size[s]) for s in self.splits}
        scale = rest / sum(room.values()) if sum(room.values()) else 0.0
        room = {s: room[s] * scale for s in self.splits}
        by_profile: dict[int, int] = {}
        excess: dict[int, float] = {}
        for _, profile, _, records, more in left:
            by_profile[profile] = by_profile.get(profile, 0) + records
            excess[profile] = excess.get(profile, 0.0) + more
        rates = {p: excess[p] / max(1, by_profile[p]) for p in by_profile}
        wanted = profile_quotas(room, {s: -self.excess[s] for s in self.splits}, by_profile, rates)
        net, arcs = Flow(), {}
        # bundles of a profile have the same arcs and costs, so they share a node, and its flow by their records
        for profile, records in by_profile.items():
            net.arc("source", ("b", profile), records, 0)
            for s in self.splits:
                arcs[profile, s] = net.arc(("b", profile), ("p", s, profile), records, 0)
        for s in self.splits:
            for profile, records in by_profile.items():
                net.arc(("p", s, profile), ("s", s), int(round(wanted[s, profile])), 0)
                net.arc(("p", s, profile), ("s", s), records, 1)
            net.arc(("s", s), "sink", int(round(room[s])), 0)
            net.arc(("s", s), "sink", rest, 4)
        net.run("source", "sink")
        return {(p, s): net.cap[e ^ 1] / max(1, by_profile[p]) for (p, s), e in arcs.items()}


def solve(bundles: list[tuple[object, int, int, int, int, int]], shares: dict[str, float]) -> dict[object, dict[str, int]]:
    """Components of each bundle per split.

    bundles: (name, profile, components, records, labelled records, records with label 1).
    """
    total, rate = sum(b[3] for b in bundles), sum(b[5] for b in bundles) / max(1, sum(b[4] for b in bundles))
    plan = Plan(shares, total)
    todo = [(name, profile, count, records, pos - rate * labelled) for name, profile, count, records, labelled, pos in bundles]
    todo.sort(key=lambda b: (-b[3] / max(1, b[2]), str(b[0])))
    out: dict[object, dict[str, int]] = {}
    gone, part = dict.fromkeys(plan.splits, 0.0), {}
    for k, (name, profile, count, records, more) in enumerate(todo):
        if not part or max(map(abs, gone.values())) > DRIFT * total:
            part, gone = plan.flow(todo[k:]), dict.fromkeys(plan.splits, 0.0)
        size = records / max(1, count)
        want = {s: part[profile, s] * count for s in plan.splits}
        got = {s: int(want[s] + 1e-9) for s in plan.splits}
        # whole components that are left go where earlier rounding took most away
        for _ in range(count - sum(got.values())):
            s = max(plan.splits, key=lambda s: ((want[s] - got[s]) * size + gone[s], shares[s], s))
            got[s] += 1
        for s in plan.splits:
            gone[s] += (want[s] - got[s]) * size
            plan.add(s, got[s] * size, got[s] * more / max(1, count))
        out[name] = got
    _exchange_ones(plan, [b for b in todo if b[2] == 1], out)
    _exchange_equal(plan, todo, out)
    return out


def _exchange_ones(plan: Plan, ones: list[tuple], out: dict[object, dict[str, int]], most: int = 64) -> None:
    """Move one of the ``most`` largest bundles of one, or exchange two, while that lowers the cost."""
    ones = ones[:most]
    at = {b[0]: next(s for s in plan.splits if out[b[0]][s]) for b in ones}

    def move(b: tuple, s: str) -> None:
        plan.add(at[b[0]], -b[3], -b[4])
        plan.add(s, b[3], b[4])
        at[b[0]] = s

    better = True
    while better:
        better = False
        for i, a in enumerate(ones):
            trials = [((a, s),) for s in plan.splits] + [((a, at[b[0]]), (b, at[a[0]])) for b in ones[i + 1 :] if at[b[0]] != at[a[0]]]
            for trial in trials:
                now, back = plan.cost(), [(b, at[b[0]]) for b, _ in trial]
                for b, s in trial:
                    move(b, s)
                if plan.cost() < now - 1e-6:
                    better = True
                    break
                for b, s in back:
                    move(b, s)
    for name, s in at.items():
        out[name] = {x: int(x == s) for x in plan.splits}


def _exchange_equal(plan: Plan, bundles: list[tuple], out: dict[object, dict[str, int]]) -> None:
    """Exchange components of equal size and different labels between splits, large ones first, while their excess
    comes nearer to zero; sizes stay."""
    by_size: dict[int, list[tuple[float, object]]] = {}
    for name, _, count, records, more in bundles:
        by_size.setdefault(round(records / max(1, count)), []).append((more / max(1, count), name))
    for size in sorted(by_size, reverse=True):
        ranked = sorted(by_size[size], key=lambda x: (x[0], str(x[1])))
        for s in plan.splits:
            for t in plan.splits:
                low, high = 0, len(ranked) - 1
                while low < high and plan.excess[s] > 0 > plan.excess[t]:
                    (e_high, a), (e_low, b) = ranked[high], ranked[low]
                    have = min(out[a][s], out[b][t])
                    k = min(have, int(min(plan.excess[s], -plan.excess[t]) / (e_high - e_low))) if e_high > e_low else 0
                    if k:
                        for name, e, x, y in ((a, e_high, s, t), (b, e_low, t, s)):
                            out[name][x] -= k
                            out[name][y] += k
                            plan.add(x, 0, -k * e)
                            plan.add(y, 0, k * e)
                    if not out[a][s] or k < have and out[b][t]:
                        high -= 1
                    else:
                        low += 1


def repo_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, author (cleaned, both present) once each, of bug_dataset."""
    bug = table(spark, sf_dir, "bug_dataset").select(repo_key(F.col("repo")).alias("repo"), clean_name(F.col("author")).alias("author"))
    return bug.where("repo is not null and author is not null").distinct()


def components(ties: DataFrame) -> DataFrame:
    """node ("r:" + repo or "a:" + author), component."""
    edges = ties.select(F.concat(F.lit("r:"), "repo").alias("u"), F.concat(F.lit("a:"), "author").alias("v"))
    return connected_components(edges)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_a < repo_b: repo keys of bug_dataset in one component.

    A component's repos are dealt to groups of about ``BLOCK`` by hash, and each meets every group of its component.
    """
    comp = components(repo_ties(spark, sf_dir)).where(F.col("node").startswith("r:"))
    comp = materialize(comp.select("component", F.expr("substring(node, 3)").alias("repo")), "repos")
    groups = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    comp = materialize(join_heavy(comp, groups, ["component"], "_k", comp.count()), "groups")
    n = F.ceil(F.col("_k") / BLOCK).cast("int")
    a = comp.select("component", F.col("repo").alias("repo_a"), F.pmod(F.xxhash64("repo"), n).cast("int").alias("g"))
    b = comp.select("component", F.col("repo").alias("repo_b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("g"))
    return a.join(b, ["component", "g"]).where("repo_a < repo_b").select("repo_a", "repo_b")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bug = table(spark, sf_dir, "bug_dataset").select(
        F.lit("bug_dataset").alias("dataset"),
        "record_id",
        repo_key(F.col("repo")).alias("repo"),
        clean_name(F.col("author")).alias("author"),
        F.col("label").cast("double").alias("label"),
    )
    sec = table(spark, sf_dir, "security_dataset")
    first = F.split_part(F.lower("origin"), F.lit("/"), F.lit(1))
    led = F.when(~first.like("%\\_mining"), repo_key(F.concat_ws("/", first, F.split_part("origin", F.lit("/"), F.lit(2)))))
    sec = sec.select(
        F.lit("security_dataset").alias("dataset"),
        "record_id",
        F.coalesce(repo_key(F.col("repo")), led).alias("repo"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("double").alias("label"),
    )
    return bug.unionByName(sec)


def assign(records: DataFrame, ties: DataFrame, plan: DataFrame) -> DataFrame:
    """dataset, record_id, component, split for each row of ``records``.

    ``records``: dataset, record_id, repo, author, label; ``plan``: split, share (a few rows).  A record
    without repo goes with its author, one without either stands alone.  Labels count where not null.
    A plan without a positive share, and an empty table, give no rows.
    """
    spark = records.sparkSession
    shares = {r.split: float(r.share) for r in plan.where("split is not null and share > 0").collect()}
    node = F.coalesce(
        F.concat(F.lit("r:"), "repo"), F.concat(F.lit("a:"), "author"), F.concat(F.lit("x:"), "dataset", F.lit(":"), F.col("record_id").cast("string"))
    )
    records = records.withColumn("node", node)
    per = records.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("pos")
    )
    nodes = per.join(components(ties), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialize(nodes.select("node", "component", "n", "labelled", "pos"), "nodes")
    whole = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).first()
    sizes = nodes.groupBy("component").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("k"))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2("n")) - (EXACT.bit_length() - 2)))
    profile = F.when(F.col("labelled") == 0, -1).otherwise(F.least(F.lit(LEVELS - 1), F.floor(F.lit(LEVELS) * F.col("pos") / F.col("labelled"))))
    sizes = sizes.withColumns({"size": (F.floor(F.col("n") / step) * step).cast("long"), "profile": profile.cast("int")})
    sizes = materialize(sizes.withColumn("h", F.xxhash64("component")).withColumn("salt", F.pmod("h", F.lit(max(SALTS, whole.nodes // SALT_NODES)))), "sizes")
    # one row a bundle: their number does not grow with that of the components (module docstring)
    found = sizes.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("records"), F.sum("labelled").alias("labelled"), F.sum("pos").alias("pos")).collect()
    quotas = solve([((r.size, r.profile), r.profile, r.k, r.records, r.labelled, r.pos) for r in found], shares) if shares else {}
    ranges = []
    for (size, prof), got in quotas.items():
        begin = 0
        for s in sorted(shares):
            if got[s]:
                ranges.append((size, prof, begin, begin + got[s], s))
            begin += got[s]
    ranges = spark.createDataFrame(ranges, "size long, profile int, begin long, until long, split string")
    # numbers of a bundle's components in hash order, by salt
    counts = sizes.groupBy("size", "profile", "salt").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("size", "profile").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    rank = F.row_number().over(W.partitionBy("size", "profile", "salt").orderBy("h", "component")) - 1
    numbered = sizes.withColumn("rank", rank).join(offsets, ["size", "profile", "salt"]).withColumn("number", F.col("offset") + F.col("rank"))
    chosen = (
        numbered.join(F.broadcast(ranges), ["size", "profile"])  # as many rows as bundles times splits
        .where("number >= begin and number < until")
        .select("component", "split", "k")
    )
    placed = materialize(join_heavy(nodes, chosen, ["component"], "k", whole.nodes).select("node", "component", "split", "n"), "placed")
    out = join_heavy(records, placed, ["node"], "n", whole.records)
    return out.select("dataset", "record_id", "component", "split")


def p7_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id, split of every record of security_dataset and bug_dataset."""
    out = assign(_records(spark, sf_dir), repo_ties(spark, sf_dir), table(spark, sf_dir, "split_plan"))
    return out.select("dataset", "record_id", "split")


QUERIES = {"p7_found": p7_found, "p7_assign": p7_assign}
ORACLE = {
    "p7_found": r"""
WITH RECURSIVE ties AS (
  SELECT DISTINCT nullif(regexp_extract(regexp_replace(lower(trim(repo)), '(?:/|\.git)+$', ''), '([^/:@\s]+)/([^/\s]+)$', 0), '') AS repo,
         nullif(lower(trim(author)), '') AS author FROM bug_dataset),
t AS (SELECT * FROM ties WHERE repo IS NOT NULL AND author IS NOT NULL),
near AS (SELECT DISTINCT a.repo AS x, b.repo AS y FROM t a JOIN t b USING (author)),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x)
SELECT x AS repo_a, y AS repo_b FROM reach WHERE x < y"""
}
