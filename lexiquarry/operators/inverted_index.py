"""An inverted index in Parquet, and exact top-k searches over it that skip most postings.

The index of a table has three parts: ``blocks`` (term, block, top, n, entries), the postings of
each term by falling weight, ``BLOCK`` at a time, with the largest weight of each block;
``heads`` (term, first, second, top, n), one row for each term; ``forward`` (key, term, weight), the
postings by document. Blocks and heads lie in folders by the term's hash, forward in folders
by the key's, so that a search reads the folders of its terms and candidates alone.

A search is two rounds of joins, whatever the number of queries. The first two blocks of each
term give parts of scores, whose k-th puts a floor under the k-th score. A document whose
every term weighs less than a level can't reach the floor, if the terms' largest weights, each
cut at that level, add up to less: so the second round reads only blocks whose top reaches the
level, and looks up only those documents whose read weights, with the most that the unread
ones can add, reach the floor.

Postings are dealt by ranges of (term, weight, key), so a term that is in every document is
split over tasks like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Postings of a block, at most.
BLOCK = 128
#: Folders of each part.
PARTS = 16
#: Scores are sums of doubles; a bound this much under a score is under it.
_NEARLY = 1 - 1e-9


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    path: str
    parts: int = PARTS
    #: The type of keys.
    key: str = "bigint"

    def table(self, name: str) -> DataFrame:
        schema = {
            "blocks": f"term string, block bigint, top double, n bigint, entries array<struct<key: {self.key}, weight: double>>, part int",
            "heads": "term string, first bigint, second bigint, top double, n bigint, part int",
            "forward": f"key {self.key}, term string, weight double, part int",
        }
        return self.spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")

    def part(self, column: str) -> object:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")


def build(postings: DataFrame, path: str, parts: int = PARTS, block: int = BLOCK) -> InvertedIndex:
    """Writes the index of ``postings`` (key, term, weight), weights over 0, to ``path``."""
    index = InvertedIndex(postings.sparkSession, path, parts, postings.schema["key"].dataType.simpleString())
    named = postings.select("key", "term", F.col("weight").cast("double").alias("weight"), index.part("key").alias("part"))
    named.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(f"{path}/forward")
    forward = index.table("forward").select("key", "term", "weight")
    order = [F.col("term"), F.col("weight").desc(), F.col("key")]
    spark = postings.sparkSession
    dealt = forward.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Numbers rise within a range and from range to range, so a term's first block has its least one.
    numbered = dealt.withColumn("block", F.expr(f"monotonically_increasing_id() div {block}"))
    entry = F.struct((-F.col("weight")).alias("minus"), F.col("key"))
    blocks = numbered.groupBy("term", "block").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    plain = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), (-e["minus"]).alias("weight")))
    blocks = blocks.select(index.part("term").alias("part"), "term", "block", (-F.col("entries")[0]["minus"]).alias("top"), F.size("entries").cast("long").alias("n"), plain.alias("entries"))
    blocks.repartition("part").sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(f"{path}/blocks")
    held = index.table("blocks").select("part", "term", "block", "top", "n")
    heads = held.groupBy("part", "term").agg(F.min("block").alias("first"), F.max("top").alias("top"), F.sum("n").alias("n"))
    # A first block may hold few postings, as blocks don't begin with terms; a second one is whole, or the last.
    later = held.select("part", "term", "block").join(heads.select("part", "term", "first"), ["part", "term"]).filter("block > first").groupBy("part", "term").agg(F.min("block").alias("second"))
    heads = heads.join(later, ["part", "term"], "left").select("part", "term", "first", "second", "top", "n")
    heads.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/heads")
    return index


def _lists(index: InvertedIndex, queries: DataFrame) -> DataFrame:
    """The queries' terms that the index has, each with the most that it can add to a score."""
    q = queries.select("qid", "term", F.col("weight").cast("double").alias("qw"), index.part("term").alias("part"))
    return q.join(index.table("heads"), ["part", "term"]).withColumn("most", F.col("qw") * F.col("top"))


def _exact(index: InvertedIndex, lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, key, score) of candidates (qid, key), from the forward part."""
    wanted = candidates.join(lists.select("qid", "term", "qw"), "qid").withColumn("part", index.part("key"))
    found = wanted.join(index.table("forward"), ["part", "key", "term"])
    return found.groupBy("qid", "key").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def _best(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.col(score).desc(), F.col("key").asc())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _read(index: InvertedIndex, lists: DataFrame, which) -> DataFrame:
    """(qid, term, most, level, key, add): entries of the blocks that ``which`` picks."""
    blocks = index.table("blocks").withColumnRenamed("top", "block_top").withColumnRenamed("n", "block_n")
    return lists.join(blocks, ["part", "term"]).filter(which)


def floors(index: InvertedIndex, lists: DataFrame, k: int) -> DataFrame:
    """(qid, floor): a score that the k-th best of each query has or exceeds; 0 if the first
    blocks hold fewer than k documents. What these blocks say of a document is a part of its score."""
    first = _read(index, lists, F.col("block").isin(F.col("first"), F.col("second")) | (F.col("block") == F.col("first")))
    seen = first.select("qid", "qw", F.explode("entries").alias("e")).groupBy("qid", F.col("e.key").alias("key")).agg(F.sum(F.col("qw") * F.col("e.weight")).alias("score"))
    return _best(seen, k).groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor")).select("qid", F.coalesce("floor", F.lit(0.0)).alias("floor"))


def levels(lists: DataFrame, floor: DataFrame) -> DataFrame:
    """lists with ``floor``, ``level`` and ``rest``: the largest level at which the terms' most,
    each cut at the level, add up to no more than the floor; ``rest`` is that sum."""
    w = W.partitionBy("qid").orderBy("most", "term")
    x = lists.join(floor, "qid").withColumn("under", F.col("floor") * _NEARLY)
    x = x.withColumn("below", F.coalesce(F.sum("most").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("above", F.count("*").over(w.rowsBetween(0, W.unboundedFollowing)))
    # With the terms before cut at their own most, the others share what is left.
    share = (F.col("under") - F.col("below")) / F.col("above")
    whole = W.partitionBy("qid")
    # Of the shares that don't exceed their term's most the first is the largest; the last is always one.
    x = x.withColumn("level", F.greatest(F.max(F.when(share <= F.col("most"), share)).over(whole), F.lit(0.0)))
    return x.withColumn("rest", F.sum(F.least("most", "level")).over(whole)).drop("below", "above")


def search(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """(qid, key, score, rank): the k documents of the largest inner product with each query
    (qid, term, weight); ties go by key. Exact."""
    lists = _lists(index, queries).persist()
    cut = levels(lists, floors(index, lists, k)).persist()
    read = _read(index, cut, F.col("qw") * F.col("block_top") >= F.col("level"))
    entries = read.select("qid", "qw", "most", "level", "rest", "under", F.explode("entries").alias("e"))
    entries = entries.withColumn("add", F.col("qw") * F.col("e.weight")).filter(F.col("add") >= F.col("level"))
    seen = entries.groupBy("qid", F.col("e.key").alias("key")).agg(F.sum("add").alias("sure"), F.sum(F.least("most", "level")).alias("cut"), F.first("rest").alias("rest"), F.first("under").alias("under"))
    hopeful = seen.filter(F.col("sure") + F.col("rest") - F.col("cut") >= F.col("under")).select("qid", "key")
    return _best(_exact(index, lists, hopeful), k)


def postings_read(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """(qid, postings, read): postings of each query's terms, and those in the blocks that the
    second round of a search reads."""
    lists = _lists(index, queries)
    cut = levels(lists, floors(index, lists, k))
    read = _read(index, cut, F.col("qw") * F.col("block_top") >= F.col("level")).groupBy("qid").agg(F.sum("block_n").alias("read"))
    return cut.groupBy("qid").agg(F.sum("n").alias("postings")).join(read, "qid", "left").select("qid", "postings", F.coalesce("read", F.lit(0)).alias("read"))
