"""What leads to objects, and how far away it is, for so many targets that nearly every object is one.

`bits` has a bit for each target, so its rows follow pairs of objects and targets. Here bits are labels, a class and a
field: an object's labels at depth d are those of its referrers at d - 1, so references are passed over once, however
many objects are targets. That tells the nearest way wherever all ways from an object of a class to another object are
equally long and don't part over two fields; the graph of classes says for which classes that is sure. Objects of other
classes have bits of their own, with which the nearest way is told exactly. If those are more than MOST, `bits` is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import kept, stored
from .trees import LAYERS, few, renamed

#: Bits of an object and depth at most: labels, and objects of doubtful classes times their fields; pairs of classes.
MOST, PAIRS = 256, 100_000
#: Less than one of so many objects being a target, or more than one doubtful object for so many targets, a search from
#: targets reads less.
SHARE, DOUBTS = 4, 4


def worth(objects: DataFrame, targets: DataFrame) -> bool:
    return targets.count() * SHARE >= objects.count()


def _or(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns) if columns else F.lit(0).cast("long")


def doubtful(names: list[tuple], onward: dict, max_depth: int, fields: bool) -> set:
    """Classes from which some class is reached at two depths, or at one depth over two fields; onward: classes by name."""
    classes = {c for _, c in names} | {c for to in onward.values() for c in to}
    by_class = {c: [i for i, own in names if own == c] for c in classes}
    after = [{c: {c} for c in classes}]
    over = []  # by depth, what a name leads to
    for _ in range(max_depth):
        over.append({i: set().union(*(after[-1][c] for c in onward[i])) for i, _ in names})
        after.append({c: set().union(*(over[-1][i] for i in by_class[c])) for c in classes})

    def doubt(c) -> bool:
        met: set = set()
        for level in after:
            if met & level[c]:
                return True
            met |= level[c]
        if not fields:
            return False
        # A reference's own field is the least of its pair already, so only what lies beyond it is in doubt.
        return any(over[d][i] & over[d][j] for d in range(1, max_depth) for i in by_class[c] for j in by_class[c] if i < j)

    return {c for c in classes if doubt(c)}


def ranks_of(names: list[tuple], onward: dict) -> dict | None:
    """The longest way of classes to each class, if no way runs in a circle, none is over LAYERS, and a name leads to one rank."""
    classes = {c for _, c in names} | {c for to in onward.values() for c in to}
    rank = dict.fromkeys(classes, 0)
    for _ in range(LAYERS + 1):
        step = dict(rank)
        for i, own in names:
            for c in onward[i]:
                step[c] = max(step[c], rank[own] + 1)
        if step == rank:
            return rank if all(len({rank[c] for c in onward[i]}) <= 1 for i, _ in names) else None
        rank = step
    return None


def counted(links: DataFrame, objects: DataFrame, targets: DataFrame, max_depth: int, by: list[str], told: Column | None = None, fields: bool = True) -> DataFrame | None:
    """gid, by, n, s, label_class, label_field, depth: which labels meet targets (obj_id, shallow, by) first at a depth.

    A row is of n targets that have all their labels in common (gid), s being the sum of their shallow sizes. links is
    (from_id, to_id, field, class_name of from_id), each pair once. told (over class_name) leaves out labels; without
    fields a label's field is the object's own, and its references have no other. None if bits would be too many.
    """
    links = kept(links.select("from_id", "to_id", "class_name", "field"), "from_id", deal=False)
    try:
        return _counted(links, objects, targets, max_depth, by, told, fields)
    finally:
        links.unpersist()


def _counted(links: DataFrame, objects: DataFrame, targets: DataFrame, max_depth: int, by: list[str], told: Column | None, fields: bool) -> DataFrame | None:
    spark = links.sparkSession
    labels = links.select("class_name", "field").distinct().withColumn("told", F.lit(True) if told is None else F.coalesce(told, F.lit(False))).limit(MOST + 1).collect()
    if not labels or len(labels) > MOST:
        return None
    labels.sort(key=lambda r: (r.field is not None, r.field or "", r.class_name is not None, r.class_name or ""))  # a few names, in the order of fields
    names = [(i, r.class_name) for i, r in enumerate(labels)]
    table = spark.createDataFrame([(i, r.class_name, r.field) for i, r in enumerate(labels)], "name int, __class string, __field string")
    same = F.col("class_name").eqNullSafe(F.col("__class")) & F.col("field").eqNullSafe(F.col("__field"))
    coded = links.join(F.broadcast(table), same).select("from_id", "to_id", "name")
    pairs = coded.select("to_id", "name").join(renamed(objects, to_id="obj_id", to_class="class_name"), "to_id").select("name", "to_class").distinct().limit(PAIRS + 1).collect()
    if len(pairs) > PAIRS:
        return None
    onward: dict = {i: set() for i, _ in names}
    for r in pairs:
        onward[r.name].add(r.to_class)
    said = {i for i, r in enumerate(labels) if r.told}
    open_classes = [c for c in doubtful(names, onward, max_depth, fields) if any(own == c and i in said for i, own in names)]
    wanted = spark.createDataFrame([(c,) for c in open_classes], "__class string")
    own = objects.join(F.broadcast(wanted), F.col("class_name").eqNullSafe(F.col("__class")), "left_semi").select("obj_id", "class_name").distinct()
    sources: dict = {c: [] for c in open_classes}
    for r in own.limit(MOST + 1).collect() if open_classes else []:
        sources[r.class_name].append(r.obj_id)
    # Where bits lie: a label's, or those of up to 64 objects of a class for one of its labels; none reaches over two words.
    plain, runs, ids, end = {}, {c: [] for c in open_classes}, [], 0
    for c, found in sources.items():
        for a in range(0, len(found), 64):
            some, at = sorted(found)[a : a + 64], {}
            for i in (i for i, k in names if k == c and i in said):
                end = end if end % 64 + len(some) <= 64 else -(-end // 64) * 64
                at[i], end = end, end + len(some)
                ids += [(i, x, end - len(some) + k) for k, x in enumerate(some)]
            runs[c].append((some, at))
    for i, c in names:
        if i in said and c not in sources:
            plain[i], end = end, end + 1
    doubts = sum(map(len, sources.values()))
    if end > MOST or doubts > MOST or (doubts and doubts * DOUBTS > targets.count()):
        return None
    words = max(1, -(-end // 64))
    spots = spark.createDataFrame(list(plain.items()), "name int, spot int")
    owns = spark.createDataFrame(ids, "name int, from_id long, own_spot int")
    coded = coded.join(F.broadcast(spots), "name", "left")
    coded = (coded.join(F.broadcast(owns), ["name", "from_id"], "left") if ids else coded.withColumn("own_spot", F.lit(None).cast("int"))).select("from_id", "to_id", "name", F.coalesce("spot", "own_spot").alias("spot"))
    column = lambda d, k: f"d{d}w{k}"

    def step(over: list[int], above: DataFrame | None, depths: int) -> DataFrame:
        """What references of those names lead to, with words for each depth; above has what leads to the referrers."""
        rows = coded.where(F.col("name").isin(over))
        rows = rows if above is None else rows.join(renamed(above, from_id="obj_id", **{c: c for c in above.columns if c != "obj_id"}), "from_id", "left")
        bit = F.expr("shiftleft(1L, spot % 64)")
        parts = [F.when(F.floor(F.col("spot") / 64) == k, bit).otherwise(F.lit(0).cast("long")).alias(column(1, k)) for k in range(words)]
        for d in range(2, depths + 1):
            parts += [F.coalesce(F.col(column(d - 1, k)) if above is not None and column(d - 1, k) in above.columns else F.lit(None), F.lit(0)).cast("long").alias(f"__{column(d, k)}") for k in range(words)]
        rows = rows.select("to_id", *parts)
        ors = [F.bit_or(c).alias(c.removeprefix("__")) for c in rows.columns if c != "to_id"]
        return rows.groupBy(F.col("to_id").alias("obj_id")).agg(*ors)

    rank = ranks_of(names, onward)
    if rank is not None:
        # No way of classes runs in a circle: what leads to a class's referrers is known before its own turn comes.
        tables: dict[int, DataFrame] = {}
        for r in sorted({rank[c] for to in onward.values() for c in to}):
            over = [i for i, _ in names if any(rank[c] == r for c in onward[i])]
            before = sorted({rank[c] for i, c in names if i in over} & set(tables))
            above = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables[b] for b in before]) if before else None
            tables[r] = stored(step(over, above, min(r, max_depth)), "labels")
        made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables.values())
    else:
        made, inner = None, [i for i, _ in names if onward[i] & {c for _, c in names}]
        for r in range(1, max_depth + 1):
            made = stored(step(inner if r < max_depth else [i for i, _ in names], made, r), "labels")
    found = targets.select("obj_id", "shallow", *by).join(made, "obj_id")
    if ids:
        mine = spark.createDataFrame([(x, n, j, k) for n, c in enumerate(open_classes) for j, (some, _) in enumerate(runs[c]) for k, x in enumerate(some)], "obj_id long, __of int, __run int, __place int")
        found = found.join(few(mine), "obj_id", "left")
    zero = F.lit(0).cast("long")
    bits_of = lambda spot, d, width: F.shiftrightunsigned(F.coalesce(F.col(column(d, spot // 64)), zero), spot % 64).bitwiseAND((1 << width) - 1 if width < 64 else -1) if column(d, spot // 64) in made.columns else zero
    tests: dict = {(d, i): [bits_of(s, d, 1)] for i, s in plain.items() for d in range(1, max_depth + 1)}
    for n, c in enumerate(open_classes):
        for j, (some, at) in enumerate(runs[c]):
            # An object isn't met by itself, nor again at a greater depth or over a later field.
            met = F.when((F.col("__of") == n) & (F.col("__run") == j), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place"))).otherwise(zero)
            before = [met]
            for d in range(1, max_depth + 1):
                level: list[Column] = []
                for i, spot in at.items():
                    one = bits_of(spot, d, len(some))
                    tests.setdefault((d, i), []).append(one.bitwiseAND(F.bitwise_not(_or(before + level))))
                    level.append(one)
                before = before + level
    each = -(-len(names) // 64)
    told_bits = []
    for d in range(1, max_depth + 1):
        for k in range(each):
            here = [F.when(_or(tests[d, i]) != 0, F.lit((1 << i % 64) - (1 << 64 if i % 64 == 63 else 0)).cast("long")).otherwise(zero) for i, _ in names if i // 64 == k and (d, i) in tests]
            told_bits.append(_or(here).alias(f"t{d}_{k}"))
    keys = [f"t{d}_{k}" for d in range(1, max_depth + 1) for k in range(each)]
    groups = found.select("shallow", *by, *told_bits).groupBy(*by, *keys).agg(F.count("*").alias("n"), F.sum("shallow").alias("s"))
    groups = stored(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    rows = groups.select("gid", *by, "n", "s", F.posexplode(F.array(*keys)).alias("__at", "__bits")).where("__bits <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("__bits", i) == 1)
    rows = rows.select("gid", *by, "n", "s", (F.floor(F.col("__at") / each) + 1).cast("int").alias("depth"), (F.col("__at") % each).alias("__word"), F.explode(places).alias("__place"))
    rows = rows.withColumn("name", F.col("__word") * 64 + F.col("__place")).drop("__word", "__place")
    return rows.join(F.broadcast(table), "name").select("gid", *(F.col(b) for b in by), "n", "s", F.col("__class").alias("label_class"), F.col("__field").alias("label_field"), "depth")
