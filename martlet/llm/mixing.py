"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source; the sources, in code-point order with null last,
take the weights in turn and share ``share`` times all words. A target stops
at ``cap`` times its source's words and the excess goes to the others by
weight until none is above. The fixed point of that resharing is a water
level: ``target = min(cap * words, level * weight)`` with the level at which
the targets sum to the wanted total. With the sources sorted by
``cap * words / weight``, ``level_k`` (the first k sources stopped) rises up
to the true level and falls after it, so the level is the maximum of
``level_k``: one running sum over the per-source rows, no iteration.

A document of a source with repetition rate ``r = target / words`` is taken
``floor(r)`` times plus once more if its seeded hash, as a number in [0, 1),
is below the fraction of ``r``. The hash is md5 of seed, id and the text's md5,
so reruns and other engines agree. ``n`` equal rows (id, source and text) draw
together for ``n * r`` copies, which are dealt out to them evenly, so that a
source meets its target however often its rows repeat.

Scale: the text is read for its word count once; per-source sums combine on
the map side, so a source with a third of all rows is one partial row per
task; the per-source table (one row per source) is the only thing that meets
in one task and is broadcast only when a probe proves it small. Rows that occur
once stay where they are; equal ones are numbered by a range sort that cuts
through them, so a row repeated without end loads no task more than others.

Defined cases: null or empty text has size 0; a null source is a source of
its own, ranked last; a source without any word has target 0 and its rows are
not taken; a null id counts as the empty string in the draw; repeated rows share
a draw as above; an empty table gives an empty result. Other
columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import WORD_PATTERN, materialise
from martlet.plans.joins import broadcast_if_bounded
from martlet.plans.numbering import with_ordered_ids

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, digest: Column, seed: int) -> Column:
    """A number in [0, 1) from seed, id and the text's digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source of ``sized(source, size)``: ``source, source_size,
    target, rate``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("stop", F.lit(float(cap)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level_k = (
        (F.lit(float(share)) * F.sum("source_size").over(everything)
         - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("level_k", level_k).withColumn("level", F.max("level_k").over(everything))
    target = F.least(F.col("stop"), F.col("level") * F.col("weight"))
    return per.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


_ROW = ("doc_id", "source", "digest")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))


def _same_row(rows: DataFrame, other: DataFrame) -> Column:
    return (rows["doc_id"].eqNullSafe(other["_doc_id"]) & rows["source"].eqNullSafe(other["_source"])
            & (rows["digest"] == other["_digest"]))


def _copied(rows: DataFrame, counted: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """``rows(doc_id, source, digest, ...)`` with ``copies`` and their source's
    ``source_size, target``. ``counted`` is a written table of all rows' keys."""
    small = broadcast_if_bounded(rates.withColumnRenamed("source", "_source"))
    rows = rows.join(small, rows["source"].eqNullSafe(small["_source"]), "inner").drop("_source")
    u = draw(F.col("doc_id"), F.col("digest"), seed)

    def total(n: Column) -> Column:
        """Copies of ``n`` equal rows."""
        whole = F.floor(n * F.col("rate"))
        return (whole + (u < n * F.col("rate") - whole).cast("bigint")).cast("bigint")

    several = counted.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    several = materialise(several.select(*[F.col(c).alias(f"_{c}") for c in _ROW], "_n"), "repeated")
    if several.first() is None:
        return rows.withColumn("copies", total(F.lit(1).cast("bigint")))
    several = broadcast_if_bounded(several)
    once = rows.join(several, _same_row(rows, several), "left_anti").withColumn("copies", total(F.lit(1).cast("bigint")))
    again = rows.join(several, _same_row(rows, several)).drop(*[f"_{c}" for c in _ROW]).withColumn("_t", F.monotonically_increasing_id())
    again = with_ordered_ids(again, [*[F.col(c) for c in _ROW], F.col("_t")], "_at").drop("_t")
    begin = again.groupBy(*_ROW).agg(F.min("_at").alias("_first"))
    begin = broadcast_if_bounded(materialise(begin.select(*[F.col(c).alias(f"_{c}") for c in _ROW], "_first"), "firsts"))
    again = again.join(begin, _same_row(again, begin)).drop(*[f"_{c}" for c in _ROW])
    again = again.withColumn("_all", total(F.col("_n"))).withColumn("_nth", F.col("_at") - F.col("_first"))
    dealt = F.floor(F.col("_all") / F.col("_n")) + (F.col("_nth") < F.col("_all") % F.col("_n")).cast("bigint")
    return once.unionByName(again.withColumn("copies", dealt.cast("bigint")).drop("_n", "_at", "_first", "_all", "_nth"))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
              seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies,
    taken`` (words the mix takes, repeats counted)."""
    sized = materialise(_sized(docs), "sizes")
    rates = materialise(source_rates(sized, weights, share, cap), "rates")
    return _copied(sized, sized, rates, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
          seed: int = SEED) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it,
    with their own columns (kept in a struct meanwhile, so that no name can
    clash)."""
    sized = materialise(_sized(docs), "sizes")
    rates = materialise(source_rates(sized, weights, share, cap), "rates")
    packed = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    rows = _copied(packed, sized, rates, seed)
    return (rows.select("_doc", F.col("copies").alias("n")).where("n > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("n"))
            .select("_doc.*"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(text, '')) AS digest
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS stop FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level_k
  FROM weighed),
rates AS (
  SELECT source, source_size, least(stop, max(level_k) OVER () * weight) AS target,
         CASE WHEN source_size > 0 THEN least(stop, max(level_k) OVER () * weight) / source_size ELSE 0.0::DOUBLE END AS rate
  FROM levels),
drawn AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate,
         count(*) OVER (PARTITION BY s.doc_id, s.source, s.digest) AS n,
         row_number() OVER (PARTITION BY s.doc_id, s.source, s.digest) - 1 AS nth,
         ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.digest), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
dealt AS (SELECT *, (floor(n * rate) + (u < n * rate - floor(n * rate))::INT)::BIGINT AS total FROM drawn)
"""
MIX_SIZES_SQL = MIX_SQL + """
SELECT doc_id, source, size, source_size, target, (total // n + (nth < total % n)::INT)::BIGINT AS copies,
       (size * (total // n + (nth < total % n)::INT))::BIGINT AS taken
FROM dealt
"""
