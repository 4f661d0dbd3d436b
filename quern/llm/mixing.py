"""Mixing sources to target weights by weighted fair queueing, native throughout.

Targets: sources in code point order (null last) weigh `weights` in turn and share `share` times all
words; a target stops at `max_copies` times its source's words, the excess goes to the others by weight.
Every copy of a document gets a virtual finish time, its source's words up to and with it (in an order
shuffled by hash) divided by the source's target. The copies are put in order of finish time across
sources and cut where their words reach the total budget.

Rows that repeat are counted first and numbered apart in bounded parts. Running sums are taken in levels
(groups of ranges of the shuffled order, ranges, then inside one range), and the cut is looked for in ever
narrower buckets of finish time, so neither a hot source, nor a hot row, nor ties meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.llm.common import forget, n_words, written

WEIGHTS, SHARE_PERCENT, MAX_COPIES = (3, 1, 2), 150, 2
#: Rows that one range holds on average; ranges are told apart by hex digits of the shuffle key.
RANGE_ROWS, SEED = 2_000, "mix-1"
#: Repeats of one row that are numbered together; rows that are put in order to find the cut; buckets that narrow them down.
PART_ROWS, SORTED_ROWS, BUCKETS = 1_000, 10_000, 4_096


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def _keys(docs: DataFrame, seed: str) -> list[Column]:
    """doc_id, src ("=" and the source's name, or "" for null), size, the shuffle key k, and h, a hash of the whole row (maps left out)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return [
        doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"), n_words(text).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), name)).alias("k"), F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType))).alias("h"),
    ]


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """(src, source_size) -> with weight and target. One row per source meets in one task, no more.

    Filling: with sources by cap over weight, the level is the largest of (budget - caps before) /
    (weights from here on); each target is the smaller of its cap and level times weight.
    """
    # "" is the null source: it sorts last.
    order = W.orderBy((F.col("src") == "").asc(), F.col("src").asc())
    weigh = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    x = by_source.withColumn("weight", weigh)
    fill = W.orderBy((max_copies * F.col("source_size") / F.col("weight")).asc(), F.col("src").asc())
    before = F.coalesce(F.sum(max_copies * F.col("source_size")).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    budget = share_percent / 100 * F.sum("source_size").over(everything)
    x = x.withColumn("level", (budget - before) / left)
    level = F.max("level").over(everything)
    return x.withColumn("target", F.least((max_copies * F.col("source_size")).cast("double"), level * F.col("weight"))).drop("level")


def _digits(rows: int) -> int:
    d = 1
    while rows > RANGE_ROWS * 16**d and d < 7:
        d += 1
    return d


def _starts(ranged: DataFrame, digits: int) -> DataFrame:
    """(src, range, start): the words of a source before each of its ranges, over groups of at most 16^4 ranges."""
    sums = ranged.groupBy("src", "range").agg(F.sum(F.col("n") * F.col("size")).alias("words")).withColumn("group", F.substring("range", 1, digits // 2))
    upto = F.sum("words").over(W.partitionBy("src", "group").orderBy("range")) - F.col("words")
    groups = sums.groupBy("src", "group").agg(F.sum("words").alias("words"))
    before = groups.select("src", "group", (F.sum("words").over(W.partitionBy("src").orderBy("group")) - F.col("words")).alias("before"))
    return sums.withColumn("upto", upto).join(before, ["src", "group"]).select("src", "range", (F.col("before") + F.col("upto")).alias("start"))


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """rows with n repeats -> a row each, upto raised by size from one to the next; most: the largest n."""
    one = lambda x: x.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("upto", F.col("upto") + F.col("i") * F.col("size")).drop("i", "n")
    if most <= PART_ROWS:
        return one(rows)
    parts = rows.where(F.col("n") > PART_ROWS).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART_ROWS).cast("int"))))
    done = F.col("part") * PART_ROWS
    parts = parts.withColumn("upto", F.col("upto") + done * F.col("size")).withColumn("n", F.least(F.lit(PART_ROWS), F.col("n") - done))
    return one(rows.where(F.col("n") <= PART_ROWS)).unionByName(one(parts.repartition("src", "k", "part").drop("part")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, finish (one per copy), copies, taken, h.

    taken = copies * size. A null text has size 0; documents of size 0 take nothing. A null source is a
    source of its own, last. Repeated rows are documents of their own, told apart only by their place in
    the order; h is a hash of the whole row. An empty table gives no rows. Reruns agree: the order comes
    from hashes of doc_id (of the text, if doc_id is null), ties from h.
    """
    sizes = written(docs.select(*_keys(docs, seed)).groupBy("doc_id", "src", "size", "k", "h").agg(F.count("*").alias("n")), "sizes")
    rows, words, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    by_source = targets(sizes.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share_percent, max_copies)
    digits = _digits(rows)
    ranged = sizes.withColumn("range", F.substring("k", 1, digits))
    inside = W.partitionBy("src", "range").orderBy("k", "doc_id", "size", "h").rowsBetween(W.unboundedPreceding, 0)
    # upto: the words up to and with the first of n equal rows.
    upto = F.col("start") + F.sum(F.col("n") * F.col("size")).over(inside) - (F.col("n") - 1) * F.col("size")
    each = _numbered(ranged.join(_starts(ranged, digits), ["src", "range"]).withColumn("upto", upto), most)
    timed = each.join(by_source.select("src", "source_size", "target"), "src")
    finish = [F.when(F.col("target") > 0, (F.lit(i) * F.col("source_size") + F.col("upto")) / F.col("target")) for i in range(max_copies)]
    timed = written(timed.select("doc_id", "src", "size", "k", "h", "source_size", "target", F.array(*finish).alias("finish")), "finish-times")
    forget(sizes)
    last = _cut(timed, words * share_percent)
    if last is None:
        copies = F.lit(0)
    else:
        place = lambda i: F.struct(F.col("finish")[i], F.col("k"), F.lit(i), F.col("src"))
        taken = [F.coalesce((F.col("finish")[i].isNotNull() & (place(i) <= F.struct(*map(F.lit, last)))).cast("int"), F.lit(0)) for i in range(max_copies)]
        copies = F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0)
    return timed.select(
        "doc_id", F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), "size", "source_size", "target", "finish",
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "h",
    )


_PLACE = ("finish", "k", "copy", "src")


def _cut(timed: DataFrame, hundred_budgets: int) -> tuple | None:
    """(finish, k, copy, src) of the last copy, in this order, up to which the words stay within the budget; None if none is.

    Each round counts the copies still in question in at most BUCKETS buckets (of finish time; among copies
    of one finish time, of the key's next digits) and goes on inside the one in which the budget ends.
    Only SORTED_ROWS copies or fewer are put in order.
    """
    copy = timed.where("size > 0").select("k", "src", "size", F.posexplode("finish").alias("copy", "finish")).where("finish is not null")
    place, digits, before, first = F.struct(*_PLACE), 0, 0, True
    low, high, last = None, None, None
    within = copy
    while True:
        facts = within.agg(F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.sum("size").alias("words"), F.max(place).alias("last")).first()
        if first and 100 * (facts["words"] or 0) <= hundred_budgets:
            return tuple(facts["last"]) if facts["n"] else None
        first = False
        if facts["n"] <= SORTED_ROWS or digits >= 32:
            break
        low, high = facts["low"], facts["high"]
        if low < high:
            step = F.floor((F.col("finish") - F.lit(low)) / F.lit(high - low) * BUCKETS)
            bucket = F.least(step, F.lit(BUCKETS - 1)).cast("string")
        else:
            digits += 3
            bucket = F.substring("k", 1, digits)
        sums = within.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.max(place).alias("last")).collect()
        sums.sort(key=lambda r: (r["low"], r["bucket"]))  # at most BUCKETS rows
        for r in sums:
            if 100 * (before + r["words"]) > hundred_budgets:
                break
            before, last = before + r["words"], r["last"]
        within = within.where(F.col("finish").between(F.lit(r["low"]), F.lit(r["high"])))
        if low == high:
            within = within.where(F.substring("k", 1, digits) == r["bucket"])
    running = F.sum("size").over(W.orderBy(*_PLACE).rowsBetween(W.unboundedPreceding, 0)) + F.lit(before)
    end = within.withColumn("running", running).where(100 * F.col("running") <= F.lit(hundred_budgets)).agg(F.max(place)).first()[0]
    return tuple(end or last) if end or last else None


def mixed(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept, whatever their names.

    Rows that are equal (maps aside) stand for one another: of n such rows taken t times in all, t come out.
    An empty table gives no rows.
    """
    plan = mix_plan(docs, seed=seed, **options)
    src = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src")
    plan = plan.select("doc_id", src, "size", "h", "copies").groupBy("doc_id", "src", "size", "h").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    plan = written(plan.where("copies > 0").withColumnRenamed("doc_id", "id"), "mix-plan")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keys(docs, seed))
    same = (own["h"] == plan["h"]) & (own["src"] == plan["src"]) & (own["size"] == plan["size"]) & own["doc_id"].eqNullSafe(plan["id"])
    found = own.join(plan, same).select("row", plan["h"], "doc_id", "n", "copies")
    again = lambda x: x.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
    if plan.where("n > 1").isEmpty():
        return again(found)
    # Equal rows become one before their copies are made, a part of them at a time.
    once = found.where("n > 1").groupBy("h", "doc_id", "n", "copies").agg(F.first("row").alias("row"))
    parts = once.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / PART_ROWS).cast("int"))))
    parts = parts.withColumn("copies", F.least(F.lit(PART_ROWS), F.col("copies") - F.col("part") * PART_ROWS)).repartition("h", "part")
    return again(found.where("n = 1")).unionByName(again(parts))


MIX_SQL = r"""
with sized as (
  select doc_id, coalesce('=' || source, '') as src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-1:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as k
  from documents
), by_source as (
  select src, sum(size) as source_size, [3, 1, 2][(row_number() over (order by src = '', src) - 1) % 3 + 1] as weight from sized group by src
), levels as (
  select *, ((150 / 100.0)::double * (sum(source_size) over ())::double
     - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, src rows between unbounded preceding and 1 preceding), 0)::double)
     / sum(weight) over (order by 2 * source_size / weight, src rows between current row and unbounded following)::double as level
  from by_source
), goals as (
  select src, source_size, least(2 * source_size::double, max(level) over () * weight) as target from levels
), upto as (
  select doc_id, src, size, k, source_size, target,
         sum(size) over (partition by src order by k, doc_id, size rows between unbounded preceding and current row) as upto
  from sized join goals using (src)
), copies as (
  select *, copy, (copy * source_size + upto)::double / target as finish from upto, (values (0), (1)) as c(copy) where target > 0
), running as (
  select doc_id, k, size, sum(size) over (order by finish, k, copy rows between unbounded preceding and current row) as running from copies where size > 0
), total as (
  select sum(size) as words from sized
), taken as (
  select doc_id, k, sum(size) as taken from running, total where 100 * running <= 150 * words group by doc_id, k
)
select u.doc_id, u.size, u.source_size::bigint as source_size, u.target, coalesce(t.taken, 0)::bigint as taken
from upto u left join taken t on u.k = t.k
"""
