"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words.  Document rates r solve

    min  sum_i  r_i log r_i + (m - r_i) log(m - r_i)     (m: most copies)
    s.t. sum_{i in s} r_i size_i = target_s   for every source s,

the entropy-balanced rates nearest to m / 2 that never exceed m.  The solution is
an exponential tilt, r_i = m / (1 + exp(-l_s z_i)) with z_i the size over the
source's mean size.  The dual is convex and separates by source; Newton steps
with a bracket find l_s, each step one aggregation over the table of (source,
size) classes.  All documents of a class share one rate, so rounding works on
classes: copies come from the running sum of rates, and a few repairs move what
is left over to documents of a fitting size.

DataFrame operations only; nothing is gathered on the driver but counters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.storage import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one (source, size) class are numbered in parts of about so many.
CLASS_PART = 256
#: Newton steps in one job, and which of all steps halve the bracket instead.
TOGETHER, HALVING = 3, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` of every source, by capped shares of the whole.

    Sources by code point, null last, weigh ``weights``, repeating.  Together they
    get ``share`` of all words; none gets more than ``most`` times its own, and
    what it can't take goes to the others by weight until none is above.  One row
    a source, so the ordered window over all sources is a small one.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # sources reach their cap in the order of cap / weight; one is capped if at its turn what is left would lift it above
    by = by.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    by = by.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    by = by.withColumn("final", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), F.col("source").alias("of"), F.col("level").alias("level")))).over(whole)["level"])
    return by.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, tolerance: float = 1e-9, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` as ``(doc_id, size, source_size, target, rate, copies, taken)``.

    size: words of the text; target: the words wanted of the row's source; rate:
    the exponentially tilted number of copies; copies: that rounded to a whole
    number from 0 to ``most``; taken: copies times size.  Columns named in ``keep``
    follow and tell rows of one id apart.

    Nulls: a null text has size 0; a null source is a source of its own, the last
    one; a null id is an id like any other.  Repeated rows count as often as they
    occur.  Texts without words get rate ``most / 2`` and take nothing.  Other
    columns are ignored.  An empty table gives no rows.  Reruns agree: rates are
    rounded to whole millionths before anything is derived from them.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keep), "mix-sizes")
    targets = source_targets(sizes, weights, share, most)
    classes = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "n", "source_size", "target"), "mix-classes")
    dual = solve_dual(classes, most, tolerance)
    rated = classes.join(dual.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    z = F.coalesce(F.try_divide(F.col("size").cast("double"), F.col("mean")), F.lit(0.0))
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(most / (1 + F.exp(-F.col("tilt") * z)))
    rated = rated.select("source", "size", "n", "source_size", "target", F.round(rate, 6).alias("rate"))
    planned = round_classes(rated, most)
    return deal(sizes, planned, keep)


def solve_dual(classes: DataFrame, most: int, tolerance: float) -> DataFrame:
    """Newton iterations for the tilt of every source: ``(source, mean, tilt, full)``; full: all of it is taken ``most`` times.

    A step that leaves the bracket of the root is replaced by its middle, as is every
    :data:`HALVING`th one, so that the bracket shrinks and all sources end: within the
    tolerance, or where the bracket is as narrow as numbers can tell.  The
    state is a table of one row a source; a job makes :data:`TOGETHER` steps, and the driver sees one flag a job.
    """
    state = classes.groupBy("source").agg(
        F.max("target").alias("target"),
        F.max("source_size").alias("source_size"),
        (F.max("source_size") / F.sum("n")).alias("mean"),
    )
    state = state.select(
        "source",
        "target",
        "mean",
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-1e3).alias("low"),
        F.lit(1e3).alias("high"),
        F.lit(False).alias("done"),
    )
    state = materialize(state, "mix-state")

    def step(state: DataFrame, turn: int) -> DataFrame:
        own = state.select(F.col("source").alias("s2"), *[c for c in state.columns if c not in ("source", "target")])
        at = classes.join(own, F.col("source").eqNullSafe(F.col("s2"))).where("not full and not done")
        z = F.try_divide(F.col("size").cast("double"), F.col("mean"))
        p = 1 / (1 + F.exp(-F.col("tilt") * z))
        moments = at.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * most * p).alias("words"), F.sum(F.col("n") * F.col("size") * z * most * p * (1 - p)).alias("slope"))
        new = state.join(moments.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        off = F.col("words") - F.col("target")
        new = new.withColumn("off", off).withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.try_divide(F.col("off"), F.col("slope"))
        ended = F.col("done") | F.col("full") | F.col("off").isNull() | (F.col("high") - F.col("low") <= 1e-12) | (F.abs("off") <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")) & F.lit(turn % HALVING > 0)
        new = new.withColumn("done", ended).withColumn("tilt", F.when(ended, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        return new.select("source", "target", "mean", "full", "tilt", "low", "high", "done")

    turn = 0
    while not state.where("not done").isEmpty():
        new = state
        for turn in range(turn + 1, turn + 1 + TOGETHER):
            new = step(new, turn)
        new = materialize(new, "mix-state")
        discard(state)
        state = new
    return state.select("source", "mean", "tilt", "full")


def round_classes(rated: DataFrame, most: int, repairs: int = 6) -> DataFrame:
    """Whole copies of each class: ``(source, size, n, source_size, target, rate, copies)``.

    Classes of a source in falling order of size take the whole part of the
    running sum of their copies.  Then, a few times over, what a source is short
    of or has too much is put right with the largest class that it holds.
    """
    run = Window.partitionBy("source").orderBy(F.col("size").desc())
    due = F.sum(F.col("n") * F.col("rate")).over(run)
    plan = rated.withColumn("upto", F.floor(due + 0.5))
    plan = plan.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(run), F.lit(0)))
    plan = plan.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * most))).drop("upto")
    for _ in range(repairs):
        own = Window.partitionBy("source")
        plan = plan.withColumn("lack", F.round(F.max("target").over(own) - F.sum(F.col("copies") * F.col("size")).over(own)).cast("long"))
        room = F.when(F.col("lack") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & (room > 0)
        plan = plan.withColumn("chosen", F.max(F.when(fits, F.col("size"))).over(own))
        change = F.least(room, F.floor(F.abs("lack") / F.greatest(F.col("size"), F.lit(1)))) * F.signum(F.col("lack").cast("double")).cast("long")
        plan = plan.withColumn("copies", F.when(fits & (F.col("size") == F.col("chosen")), F.col("copies") + change).otherwise(F.col("copies"))).drop("lack", "chosen")
    return materialize(plan, "mix-plan")


def deal(sizes: DataFrame, plan: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Give the copies of each class to its documents, as evenly as whole numbers allow.

    Documents of a class are numbered within hashed parts of about
    :data:`CLASS_PART`, so a class of any size is spread over many tasks.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / CLASS_PART)))
    joined = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    joined = joined.select("d.doc_id", "d.source", "d.size", "source_size", "target", "rate", "n", F.col("copies").alias("class_copies"), part.alias("part"), *keep)
    keys = ["source", "size", "part"]
    parts = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("here"), F.max("n").alias("n"), F.max("class_copies").alias("class_copies"))
    run = Window.partitionBy("source", "size").orderBy("part")
    # the parts' shares of the class are the differences of whole running shares
    upto = F.floor(F.sum("here").over(run) * F.col("class_copies") / F.col("n"))
    parts = parts.withColumn("upto", upto)
    parts = parts.select("source", "size", "part", "here", (F.col("upto") - F.coalesce(F.lag("upto").over(run), F.lit(0))).alias("own"))
    dealt = joined.alias("j").join(parts.alias("q"), F.col("j.source").eqNullSafe(F.col("q.source")) & (F.col("j.size") == F.col("q.size")) & (F.col("j.part") == F.col("q.part")))
    dealt = dealt.select("doc_id", "j.source", "j.size", "j.part", "source_size", "target", "rate", "here", "own", *keep)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id", *keep))
    copies = F.floor(F.col("own") / F.col("here")) + F.when(at <= F.col("own") % F.col("here"), 1).otherwise(0)
    return dealt.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
