"""Mixing sources to target weights by pivotal dependent rounding.

Method: a source's target over its size gives every document an expected number
of copies, the same for all of its documents.  The whole part is certain; the
fractional parts are rounded together: two documents at a time, mass (fraction
times size) moves from one to the other, in a direction drawn so that the
expectations hold, until one fraction is 0 or 1; the other goes on to the next
document.  The source's words stay exact at every step, so the mix misses a
target by less than one document.

Documents are dealt by hash to groups of about ``GROUP``; each group folds its
documents and leaves at most one unsettled document, and groups of those fold
again, level by level, as a reduction tree.  When a long document meets a short
one, the short one settles first, so the last unsettled document of a source
would be among its longest and its draw would miss the target by much.  So a
source's documents are rounded in strata by size, longest first, and what the
last draw of a stratum missed is spread over the fractions of the next.  Strata
are cut at exact quantiles.  Only DataFrame operations run, no group is large,
and all draws are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapanel.llm.common import WORD, materialize, with_row
from terrapanel.operators.rank import group_positions, value_ranks

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT = 1.5, 2.0
GROUP = 48
#: Size quantiles of a source that part its documents into strata, largest sizes first.
STRATA = (0.9, 0.5)
SEED = 7
#: Nearer than this to 0 or 1, a fraction is settled.
SETTLED = 1e-9


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> also ``weight`` and ``target``.

    Sources by code point, null last, take ``weights`` in turn.  Targets share
    ``share`` of all sizes by weight; none exceeds ``limit`` times its source,
    and what is cut off goes to the others by weight.  With sources sorted by
    the level at which they fill up, that is the first level that none of the
    rest exceeds.  One row per source: the windows hold no documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("full", F.lit(limit) * F.col("source_size") / F.col("weight"))
    total, order = Window.partitionBy(), Window.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("capped", F.coalesce(F.sum(F.lit(limit) * F.col("source_size")).over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", (F.lit(share) * F.sum("source_size").over(total) - F.col("capped")) / F.col("open"))
         .withColumn("water", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(total)))
    return s.select("source", "source_size", "weight",
                    F.least(F.lit(limit) * F.col("source_size"), F.coalesce("water", "full") * F.col("weight")).alias("target"))


def _draw(seed: int, a: Column, b: Column) -> Column:
    """A number in (0, 1) from two keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


KEY = "struct<id:bigint,tag:bigint>"
#: Equal rows that are numbered in one task.
COPIES = 4096
ITEM = f"struct<key:{KEY},size:bigint,whole:int,p:double>"
DONE = f"array<struct<key:{KEY},size:bigint,whole:int,one:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _item(a: Column, p: Column) -> Column:
    return F.struct(a["key"].alias("key"), a["size"].alias("size"), a["whole"].alias("whole"), p.alias("p"))


def _moved(a: Column, b: Column, seed: int) -> Column:
    """Struct (p, q): the fractions of a and b after one transfer of mass; what bounds it is integral exactly."""
    def ends(m: Column) -> Column:
        rise = m["draw"] * (m["up"] + m["down"]) < m["down"]
        s, t = a["size"].cast("double"), b["size"].cast("double")
        more = F.struct(F.when(m["a_room"] <= m["b_mass"], 1.0).otherwise(a["p"] + m["up"] / s).alias("p"),
                        F.when(m["b_mass"] <= m["a_room"], 0.0).otherwise(b["p"] - m["up"] / t).alias("q"))
        less = F.struct(F.when(m["a_mass"] <= m["b_room"], 0.0).otherwise(a["p"] - m["down"] / s).alias("p"),
                        F.when(m["b_room"] <= m["a_mass"], 1.0).otherwise(b["p"] + m["down"] / t).alias("q"))
        return F.when(rise, more).otherwise(less)

    a_mass, b_mass = a["p"] * a["size"], b["p"] * b["size"]
    a_room, b_room = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
    m = F.struct(_draw(seed, a["key"], b["key"]).alias("draw"), a_mass.alias("a_mass"), b_mass.alias("b_mass"),
                 a_room.alias("a_room"), b_room.alias("b_room"),
                 F.least(a_room, b_mass).alias("up"), F.least(a_mass, b_room).alias("down"))
    return _let(m, ends)


def fold(items: Column, seed: int) -> Column:
    """Round an array of ITEMs in order; struct (done: DONE, left: the unsettled ITEM or null)."""
    def settle(a: Column, p: Column) -> Column:
        sure = (p < SETTLED) | (p > 1 - SETTLED)
        one = F.struct(a["key"].alias("key"), a["size"].alias("size"), a["whole"].alias("whole"), (p > 0.5).cast("int").alias("one"))
        return F.when(sure, F.array(one).cast(DONE)).otherwise(F.array().cast(DONE))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]

        def after(m: Column) -> Column:
            open_p, open_q = (m["p"] >= SETTLED) & (m["p"] <= 1 - SETTLED), (m["q"] >= SETTLED) & (m["q"] <= 1 - SETTLED)
            rest = F.when(open_p, _item(a, m["p"]).cast(ITEM)).when(open_q, _item(b, m["q"]).cast(ITEM))
            return F.struct(F.concat(acc["done"], settle(a, m["p"]), settle(b, m["q"])).alias("done"), rest.alias("left"))

        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.cast(ITEM).alias("left"))).otherwise(_let(_moved(a, b, seed), after))

    start = F.struct(F.array().cast(DONE).alias("done"), F.lit(None).cast(ITEM).alias("left"))
    return F.aggregate(items, start, step)


def round_fractions(docs: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(source, item: ITEM) with 0 < p < 1 and size > 0 -> (source, key, size, whole, one), ``one`` 0 or 1."""
    left, out = docs, docs.limit(0).select("source", "item.key", "item.size", "item.whole", F.lit(0).alias("one"))
    level = 0
    while True:
        counts = materialize(left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(group)).alias("groups"))
                             .withColumnRenamed("source", "s"), "mix_groups")
        most = counts.agg(F.max("groups").alias("m")).first()["m"]
        if most is None:
            return out
        at = F.pmod(F.xxhash64(F.lit(seed + level), "item.key"), F.col("groups"))
        turn = F.xxhash64(F.lit(seed), F.col("item.key"))
        folded = (left.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("group", at)
                  .groupBy("source", "group").agg(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "item"))).alias("items"))
                  .select("source", fold(F.transform("items", lambda x: x["item"]), seed).alias("f")))
        folded = materialize(folded, "mix_level")
        out = out.unionByName(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.key", "d.size", "d.whole", "d.one"))
        left = folded.filter("f.left is not null").select("source", F.col("f.left").alias("item"))
        level += 1
        if most == 1:  # one unsettled document a source: a draw by its fraction
            one = (_draw(seed, F.col("item.key"), F.lit(0)) < F.col("item.p")).cast("int")
            return out.unionByName(left.select("source", "item.key", "item.size", "item.whole", one.alias("one")))


def size_cuts(sizes: DataFrame, strata: tuple[float, ...] = STRATA) -> DataFrame:
    """(source, size) -> (source, cuts): the smallest size that a share of ``strata`` of the source's rows does not exceed, exactly."""
    ranks = value_ranks(sizes, "source", "size")
    up_to = F.col("before") + F.col("n")
    return ranks.groupBy("source").agg(F.array(*[F.min(F.when(up_to >= F.lit(q) * F.col("grp_n"), F.col("size"))) for q in strata]).alias("cuts"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``no``, 1 to the number of rows equal to it: the same whatever order the rows come in."""
    folded = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "mix_folded")
    few = folded.filter(F.col("n") <= COPIES).select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("no"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    many = folded.filter(F.col("n") > COPIES).select(*rows.columns, "n", starts.alias("start")).repartition("id", "tag", "start")
    part = F.explode(F.sequence(F.col("start") + 1, F.least("n", F.col("start") + COPIES)))
    return few.unionByName(many.select(*rows.columns, part.alias("no")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, group: int = GROUP, seed: int = SEED,
        strata: tuple[float, ...] = STRATA) -> DataFrame:
    """Copies of each document in the mix.

    Returns (doc_id, tag, source, size, source_size, target, copies, taken), one
    row per row of ``docs``; ``tag`` is a hash of the text, so that (doc_id, tag)
    names the row.

    Edge cases: a null text has size 0; documents of size 0 get the whole part
    of their expected copies.  Null is a source of its own, sorted last.  A null
    id is a value like others.  Repeated rows are rounded each on its own: equal
    ones are folded to one with a count and numbered, and the number is part of
    the key that deals rows to groups.  An empty table, or one without words,
    takes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"),
                       F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"))
    rows = materialize(numbered(rows), "mix_rows")
    # the first of equal rows goes by the hash of its text, the others by that and their number
    name = F.when(F.col("no") == 1, F.col("tag")).otherwise(F.xxhash64("tag", "no"))
    others = rows.filter("no > 1").select(F.col("id").alias("o_id"), name.alias("o_name"), F.col("tag").alias("o_tag"))
    goal = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "mix_targets")
    goal = goal.withColumnRenamed("source", "s")
    match = F.col("source").eqNullSafe(F.col("s"))
    rows = rows.join(goal, match)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + SETTLED)  # 2 and 1.9999999999 copies alike: nothing is left to round
    rows = rows.select("source", F.struct(F.struct("id", name.alias("tag")).alias("key"), "size", whole.cast("int").alias("whole"),
                                          (expected - whole).alias("p")).cast(ITEM).alias("item"))
    sure = (F.col("item.p") < SETTLED) | (F.col("item.size") == 0)
    out = rows.filter(sure).select("source", "item.key", "item.size", "item.whole", F.lit(0).alias("one"))
    fractional = rows.filter(~sure)
    # one fraction a source, times a whole sum: the mass does not depend on the order of rows
    per = fractional.groupBy("source").agg((F.sum("item.size") * F.max("item.p")).alias("mass")).withColumnRenamed("source", "s")
    cuts = size_cuts(fractional.select("source", "item.size"), strata)
    per = materialize(per.join(cuts, match).select("s", "mass", "cuts"), "mix_strata")
    over = F.size(F.filter("cuts", lambda c: F.col("item.size") <= c))  # 0: over every cut
    fractional = materialize(fractional.join(per.select("s", "cuts"), match).select("source", "item", over.alias("stratum")), "mix_open")
    sizes = fractional.groupBy("source").pivot("stratum", list(range(len(strata) + 1))).agg(F.sum("item.size"))
    state = per.select("s", "mass").join(sizes.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    for k in range(len(strata) + 1):
        state = materialize(state, "mix_state")
        rest = sum((F.coalesce(F.col(str(i)), F.lit(0)) for i in range(k, len(strata) + 1)), F.lit(0))
        p = state.select("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mass") / rest)).alias("p"))
        own = fractional.filter(F.col("stratum") == k).join(p, match).select("source", _item(F.col("item"), F.col("p")).cast(ITEM).alias("item"))
        settled = (F.col("item.p") < SETTLED) | (F.col("item.p") > 1 - SETTLED)
        done = round_fractions(own.filter(~settled), group, seed + 100 * k).unionByName(
            own.filter(settled).select("source", "item.key", "item.size", "item.whole", (F.col("item.p") > 0.5).cast("int").alias("one")))
        out = out.unionByName(done)
        if k < len(strata):
            took = done.groupBy("source").agg(F.sum(F.col("one") * F.col("size")).alias("took")).withColumnRenamed("source", "s2")
            state = (state.join(took, F.col("s").eqNullSafe(F.col("s2")), "left")
                     .withColumn("mass", F.col("mass") - F.coalesce("took", F.lit(0))).drop("s2", "took"))
    copies = (F.col("whole") + F.col("one")).cast("int")
    out = out.select("*", F.col("key.tag").alias("tag"))
    if not others.isEmpty():
        out = out.join(others, F.col("key.id").eqNullSafe(F.col("o_id")) & (F.col("tag") == F.col("o_name")), "left")
        out = out.withColumn("tag", F.coalesce("o_tag", "tag"))
    return (out.join(goal, match)
            .select(F.col("key.id").alias("doc_id"), "tag", "source", "size", "source_size", "target",
                    copies.alias("copies"), (copies * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` says, columns unchanged.

    Rows equal in id and text share the total of their copies evenly, the
    remainder going to the first by hash of the row.
    """
    taken = mix(docs, id_col, text_col, source_col, **options)
    per = materialize(taken.groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "mix_copies")
    rows = with_row(docs, id=F.col(id_col).cast("long"), t=F.xxhash64(F.col(text_col).cast("string")))
    rows = rows.join(per, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tag")))
    both = rows.filter("rows = 1").select("row", "copies")
    if not per.filter("rows > 1").isEmpty():  # positions by slices, so that no row that repeats is held by one task
        many = group_positions(rows.filter("rows > 1").select("id", "t", "row", "copies", "rows", F.xxhash64("row").alias("turn")), ["id", "t"], "turn")
        share = F.floor(F.col("copies") / F.col("rows")) + (F.col("pos") <= F.col("copies") % F.col("rows")).cast("long")
        both = both.unionByName(many.select("row", share.alias("copies")))
    return (both.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*"))
