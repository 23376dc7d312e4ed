"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import WORD, order_hash, packed, running_total
from salescope.plans.session import written


@dataclass(frozen=True)
class Curriculum:
    """``weights`` are given to the sources in order, repeating; ``slopes`` tell how each weight moves with time.

    At time t of the training (0 to 1) a source with slope a has 1 + a * (2t - 1) times its mean weight, so its share
    grows (a > 0) or fades (a < 0); slopes lie between -1 and 1. ``share`` is the size of the mix by all sizes, and
    ``most`` how often a source, and so a document, can be used.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5)
    share: float = 1.5
    most: float = 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, plan: Curriculum) -> DataFrame:
    """(key, weight, slope, source_size, target) of each source.

    A source's target is min(level * weight, most * size). The level that spends the whole mix is found from
    below: with the sources full at the last level left out, it rises until no more of them become full. A step is one
    aggregate over the sources, and reads back one row.
    """
    def pick(values: tuple[float, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("number") % len(values)).cast("int") + 1)

    # Few rows: one for each source, from an aggregate. Numbers run on from the count of smaller ranges.
    ranged = sources.repartitionByRange("is_null", "key").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-sources")
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = ranged.join(offsets, "part").withColumn(
        "number", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("is_null", "key")) - 1)
    table = written(numbered.select(
        "key", "source_size", pick(plan.weights).alias("weight"), pick(plan.slopes).alias("slope"),
    ), "mix-weights")
    full = F.lit(plan.most) * F.col("source_size")
    level = 0.0
    while True:
        over = full < F.lit(level) * F.col("weight")
        spent, used, size = table.agg(
            F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("source_size"))), F.sum("source_size"),
        ).first()
        if not spent:
            break
        found = (plan.share * float(size) - plan.most * float(used or 0)) / spent
        if found <= level:
            break
        level = found
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), full))


def mix(documents: DataFrame, plan: Curriculum = Curriculum(), size: Column | None = None) -> DataFrame:
    """How the mix uses each document, sorted by training position.

    Returns (row, size, source_size, target, taken, positions): ``row`` is the document with all its columns,
    ``target`` its source's, ``taken`` the words of it the mix takes, and ``positions`` the time of each use, at most
    ``plan.most`` rounded up. The documents of a source come in an order fixed by their ids; the words that are wanted from
    the source are counted off along it, again from the start when it is used up, so that the last document of each
    source may be taken in part and what is taken meets the target to the word. A use begins when as many words
    of the source are demanded as come before it: the integral of the source's weight up to time t, inverted.

    Null text or no words: size 0, nothing taken. Null source: a source of its own, the last. Null ids come first
    in their source's order, equal rows are used one after another. No documents: no rows.
    """
    docs = packed(documents)
    source, text, key = F.col("row.source"), F.col("row.text"), F.col("row.doc_id")
    fixed = (words(text) if size is None else size).cast("long")
    docs = docs.select(
        "row", F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("key"),
        fixed.alias("size"), order_hash(key).alias("by"),
    )
    sources = docs.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("is_null", F.col("key") == "")
    targets = _targets(sources, plan)
    row_ties = [key.asc_nulls_first(), F.col("size"), F.col("by")]
    if "text" in documents.columns:
        row_ties.append(text)
    placed = running_total(docs, "key", "by", row_ties, "size", "before").join(targets, "key")

    wanted = F.rint("target").cast("long")
    rounds = [
        (F.lit(r) * F.col("source_size") + F.col("before"),) for r in range(int(-(-plan.most // 1)))
    ]
    uses = []
    for (start,) in rounds:
        n = F.greatest(F.lit(0), F.least(F.col("size"), wanted - start))
        y = start / F.nullif(F.col("target"), F.lit(0.0))
        a = F.col("slope")
        t = F.when(a == 0, y).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * y)) / (2 * a))
        uses.append((n, F.when(n > 0, t)))
    taken = sum((n for n, _ in uses[1:]), uses[0][0])
    return placed.select(
        "row", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.array_compact(F.array(*[t for _, t in uses])).alias("positions"),
    ).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), F.col("row.doc_id"))


def training_documents(documents: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mix as documents in training order, with the columns of ``documents``.

    A document used twice appears twice. One that is taken in part for its last use is cut after that many words, its
    words then joined by one space; ``n_chars``, where it is a column, follows the text.
    """
    mixed = mix(documents, plan)
    use = mixed.select("row", "size", "taken", F.posexplode("positions").alias("nth", "position"))
    n = F.least(F.col("size"), F.col("taken") - F.col("nth") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), 1, n.cast("int")), " ")
    text = F.when(n < F.col("size"), cut).otherwise(F.col("row.text"))
    use = use.withColumn("_text", text).orderBy("position", "row.doc_id")
    replaced = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        replaced["n_chars"] = F.when(n < F.col("size"), F.length("_text")).otherwise(F.col("row.n_chars")).cast(
            documents.schema["n_chars"].dataType)
    return use.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, text,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as n from d group by source),
w as (select *, [5.0, 2.0, 1.0][n % 3 + 1]::double as weight, [0.5, 0.0, -0.5][n % 3 + 1]::double as slope from s),
r as (select *, 2.0::double * source_size as most, sum(source_size) over () as total,
    coalesce(sum(source_size) over (order by source_size / weight, n rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (order by source_size / weight, n rows between current row and unbounded following) as spent from w),
l as (select max(level) as level from (
    select (1.5::double * total - 2.0::double * used) / spent as level, most, weight from r) where level * weight <= most),
t as (select source, source_size, slope, least(level * weight, most) as target from r, l),
p as (select d.doc_id, d.size, t.source_size, t.target, t.slope, round_even(t.target, 0)::bigint as wanted,
    (sum(d.size) over (partition by d.source order by d.h, d.doc_id nulls first, d.size, d.text) - d.size)::bigint as b
    from d join t on d.source is not distinct from t.source),
u as (select *, greatest(0, least(size, wanted - b)) + greatest(0, least(size, wanted - b - source_size)) as taken from p)
select doc_id, size, source_size, target, taken::bigint as taken,
  case when taken > 0 then case when slope = 0 then b / target
    else (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (b / target))) / (2 * slope) end end as first_position
from u
"""
