"""Line dedup by an exact set-similarity join, in DataFrame operations.

A line is the set of its words. A line goes if an earlier line, by (doc_id, number in
the document), has a Jaccard similarity of 4/5 or more with it, whether or not that one
stays itself. Lines without words stay.

1. Words are ordered by rarity: counts over all lines in 65,536 hash buckets, each word
   by its bucket's rank, then its hash. This is one order for all lines.
2. Lines with equal sets: all but the first go. (Sets are known by their size, a 64-bit
   hash of their word hashes and a 64-bit parity of them; words by 47 bits of a hash within
   their bucket, of 65,536.)
3. Different sets: similar ones share a word of their prefixes, the n - ceil(4n/5) + 1
   rarest words. Lines meet by prefix words; sizes, the word's positions, and parities
   of word hashes (their difference is a lower bound of the symmetric difference) sort
   out pairs, and Jaccard is verified on the whole sets, cut again from the texts.
   Before that, every line meets ``HEADS`` lines only: the first ones with its least
   hashes of prefix words. A line that matches one of these needs no other match.

So groups of near copies mostly meet one line, not each other. Sets of up to
three words can only match equal ones and take part in step 2 alone. Sieves before
shuffles are bit arrays of fixed size; they only let too much through.

Defined results: null text is one line without words; rows that share a doc_id do not
remove each other's lines of the same number; null doc_id counts as the largest; other
columns are ignored, whatever their names; repeated rows (id and text) are one row of the
report and keep each other's lines; a line or text may have any length, though a line's
words are one array in memory; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import row_key, shuffle_width, small, stored

BUCKETS = 1 << 16
#: First lines that each line meets before the others.
HEADS = 6
#: Lines with more words have a parity of 256 bits instead of 64.
LONG_LINE = 110
_SIEVE = 1 << 22
_LAST = (1 << 63) - 1
_MASK = (1 << 47) - 1


def _spaced(text: Column) -> Column:
    """The text with plain spaces for other white space, lines left as they are. Most texts
    have none and are only looked through; words are then cut without a pattern."""
    other = "[\\t\\x0B\\f\\r]"
    return F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text)


def _words(line: Column) -> Column:
    """Words and empty strings of a line of a spaced text."""
    return F.split(line, " ")


def _constant(values: list[int]) -> Column:
    """A constant array of longs; Spark folds the parsing away."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")


def rarity_ranks(texts: DataFrame) -> list[int]:
    """Each bucket's rank by the number of its words in all texts. One count for each of a fixed number of buckets comes to the driver."""
    lines = texts.select(F.explode(F.split(_spaced(F.col("text")), "\n", -1)).alias("line"))
    words = lines.select(F.explode(_words(F.col("line"))).alias("w")).filter("w != ''")
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 48).alias("b")).count().collect()
    have = {r["b"]: r["count"] for r in counts}
    order = sorted(range(BUCKETS), key=lambda b: (have.get(b, 0), b))
    ranks = [0] * BUCKETS
    for i, b in enumerate(order):
        ranks[b] = i
    return ranks


def _sieve(keys: DataFrame) -> Column:
    """A condition on column ``h`` that holds for all of the keys' (and few others): a bit
    array of fixed size, as a scalar subquery."""
    at = F.pmod("h", F.lit(_SIEVE))
    bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    every = keys.sparkSession.range(_SIEVE // 64).withColumnRenamed("id", "i").join(bits, "i", "left").select(F.struct("i", F.coalesce("v", F.lit(0)).alias("v")).alias("x"))
    words = stored(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("a"))).scalar()
    word = words[F.shiftright(at, 6).cast("int")]
    return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _parity(toks: Column) -> Column:
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    return F.aggregate(toks, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


#: What a set is known by.
_SET = ("sid", "n", "sig")
#: What a line's parities are called: of all words, and (long lines) of three quarters.
_SIGNS = ("sig", "q1", "q2", "q3")


def _lines(docs: DataFrame) -> DataFrame:
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        row_key().alias("th"),
        _spaced(F.coalesce("text", F.lit(""))).alias("text"),
    )
    return texts.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hashed(line: str) -> Column:
    """The distinct word hashes of a line."""
    return F.array_remove(F.array_distinct(F.transform(_words(F.col(line)), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _line_sets(docs: DataFrame) -> DataFrame:
    """Size, hash, parities and prefix of every line; the prefix by rarity."""
    ranks = _constant(rarity_ranks(docs.select(F.coalesce("text", F.lit("")).alias("text"))))
    hashes = _lines(docs).select("id", "th", "line_no", _hashed("line").alias("hashes"))
    placed = F.transform("hashes", lambda h: F.shiftleft(F.coalesce(ranks[F.shiftrightunsigned(h, 48).cast("int")], F.lit(0)), 47).bitwiseOR(h.bitwiseAND(F.lit(_MASK))))
    sets = hashes.select("id", "th", "line_no", F.sort_array(placed).alias("toks")).withColumn("n", F.size("toks"))
    quarter = lambda j: F.when(F.col("n") > LONG_LINE, _parity(F.filter("toks", lambda x: F.shiftright(x, 6).bitwiseAND(3) == j)))
    prefix = F.when(F.col("n") > 3, F.slice("toks", F.lit(1), F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1))
    return stored(sets.select("id", "th", "line_no", "n", F.xxhash64("toks").alias("sid"), _parity(F.col("toks")).alias("sig"), *[quarter(j).alias(f"q{j}") for j in (1, 2, 3)], prefix.alias("prefix")))


def _sizes(na: Column, nb: Column) -> Column:
    """Sets of these sizes can match."""
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4)


def _least(both: Column) -> Column:
    """The least number of common words of matching sets of so many words together: 4/9 of it, rounded up."""
    return F.call_function("div", both * 4 + 8, F.lit(9).cast("long"))


def _later_matches(docs: DataFrame, sets: DataFrame, again: DataFrame) -> DataFrame:
    """Lines (id, at, sig) that have an earlier line of another, similar set."""
    # Of equal sets only the first line goes on. Few lines have one, and only those join.
    lines = sets.filter("n > 3")
    twice = _sieve(again.select(F.xxhash64(*_SET).alias("h")))
    marked = lines.withColumn("h", F.xxhash64(*_SET))
    maybe = marked.filter(twice).join(small(again), list(_SET), "left").filter(F.col("first").isNull() | (F.col("first") == F.struct("id", "line_no")))
    lines = marked.filter(~twice).select(*sets.columns).unionByName(maybe.select(*sets.columns))
    where = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    some = lines.select("id", where.alias("at"), *_SIGNS, "prefix")
    own = ["id", "at", *_SIGNS, "p"]

    def size(at: str) -> Column:
        return F.col(at).bitwiseAND((1 << 32) - 1)

    def earlier(a: str, b: str) -> Column:
        """Line a stands before line b (the size in ``at`` decides nothing here)."""
        return (F.col(f"{a}id") < F.col(f"{b}id")) | ((F.col(f"{a}id") == F.col(f"{b}id")) & (F.shiftright(f"{a}at", 32) < F.shiftright(f"{b}at", 32)))

    def alike(a: str, b: str) -> Column:
        """Sizes and parities leave the pair open."""
        na, nb = size(f"{a}at"), size(f"{b}at")
        least = _least(na + nb)
        delta = [F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in _SIGNS]
        quarters = [delta[0].bitwiseXOR(delta[1]).bitwiseXOR(delta[2]).bitwiseXOR(delta[3]), *delta[1:]]
        apart = F.coalesce(sum((F.bit_count(q) for q in quarters[1:]), F.bit_count(quarters[0])), F.bit_count(delta[0]))
        return _sizes(na, nb) & (apart <= na + nb - 2 * least)

    def possible(a: str, b: str) -> Column:
        """The positions of a common word, too."""
        na, nb = size(f"{a}at"), size(f"{b}at")
        common = F.least(na - F.col(f"{a}p"), nb - F.col(f"{b}p"))
        return _sizes(na, nb) & (common >= _least(na + nb)) & alike(a, b)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("tok", F.col("done").alias(f"{name}done"), *[F.col(c).alias(f"{name}{c}") for c in own])

    pair = [f"{s}{c}" for s in ("x_", "y_") for c in ("id", "at", "sig")]

    def verified(pairs: DataFrame) -> DataFrame:
        """The x lines of the pairs that match, by both lines' whole sets from the texts."""
        ends = pairs.select(F.col("x_id").alias("id"), F.col("x_at").alias("at"), F.col("x_sig").alias("sig")).unionByName(pairs.select(F.col("y_id").alias("id"), F.col("y_at").alias("at"), F.col("y_sig").alias("sig"))).distinct()
        keep = _sieve(ends.select(F.xxhash64("id", F.shiftright("at", 32)).alias("h")))
        of = _sieve(ends.select(F.xxhash64("id").alias("h")))
        texts = docs.select("doc_id", "text").withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))).filter(of)
        pool = _lines(texts).withColumn("h", F.xxhash64("id", F.col("line_no").cast("long"))).filter(keep)
        pool = pool.select("id", "line_no", _hashed("line").alias("toks")).withColumns({"n": F.size("toks"), "sig": _parity(F.col("toks"))})
        pool = pool.select("id", where.alias("at"), "sig", "toks").join(ends, ["id", "at", "sig"])
        pool = stored(pool.groupBy("id", "at", "sig").agg(F.first("toks").alias("toks")))
        p = pairs
        for s in ("x", "y"):
            p = p.join(pool.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "at", "sig", "toks")]), [f"{s}_id", f"{s}_at", f"{s}_sig"])
        both = F.size(F.array_intersect("x_toks", "y_toks"))
        match = 5 * both >= 4 * (F.size("x_toks") + F.size("y_toks") - both)
        return stored(p.filter(match).select(F.col("x_id").alias("id"), F.col("x_at").alias("at"), F.col("x_sig").alias("sig")).distinct())

    # First every line meets the first line with the same least hash of its prefix, for
    # some hash functions.
    least = lambda k: F.array_min(F.transform("prefix", lambda x: F.xxhash64(F.lit(k), x)))
    ends = some.select("id", "at", "sig", F.explode(F.array(*[F.xxhash64(F.lit(k), least(k)) for k in range(HEADS)])).alias("end"))
    heads = ends.groupBy("end").agg(F.min(F.struct("id", "at", "sig")).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    heads = heads.select("end", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("id", "at", "sig")])
    na, nb = size("h_at"), size("at")
    near = _sizes(na, nb) & (F.bit_count(F.col("h_sig").bitwiseXOR(F.col("sig"))) <= na + nb - 2 * _least(na + nb))
    star = ends.join(heads, "end").filter(earlier("h_", "") & near)
    star = star.select(F.col("id").alias("x_id"), F.col("at").alias("x_at"), F.col("sig").alias("x_sig"), F.col("h_id").alias("y_id"), F.col("h_at").alias("y_at"), F.col("h_sig").alias("y_sig"))
    found = verified(stored(star.distinct()))
    done = some.join(small(found.withColumn("done", F.lit(True))), ["id", "at", "sig"], "left")
    words = done.select("id", "at", *_SIGNS, "done", F.posexplode("prefix").alias("p", "tok")).repartition(shuffle_width(docs.sparkSession), "tok")
    x, y = side(words, "x_"), side(words, "y_")
    # ``done`` is true or null. The condition is over both sides, and what it asks of y
    # always holds, so that both sides read the same shuffle.
    settled = F.coalesce(F.col("x_done") & (F.col("y_done") | F.col("y_done").isNull()), F.lit(False))
    rest = x.join(y, (x["tok"] == y["tok"]) & ~settled & earlier("y_", "x_") & possible("y_", "x_")).select(*pair).distinct()
    return found.unionByName(verified(stored(rest)))


def gone_lines(docs: DataFrame) -> DataFrame:
    """For every document row (id, th) with lines that go their numbers, ascending, as ``gone``."""
    sets = _line_sets(docs)
    several = sets.filter("n > 0").groupBy(*_SET).agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    again = stored(several.select(*_SET, "first"))
    # A set goes as a whole if its first line does; its other lines go anyway.
    later = _later_matches(docs, sets, again).select("id", F.shiftright("at", 32).cast("int").alias("line_no"), "sig").distinct()
    later = sets.select("id", "line_no", *_SET).join(small(stored(later)), ["id", "line_no", "sig"])
    first = later.join(small(again), list(_SET), "left").filter(F.col("first").isNull() | (F.col("first") == F.struct("id", "line_no")))
    matched = stored(first.select(*_SET, F.lit(True).alias("matched")).distinct())
    flags = sets.select("id", "th", "line_no", *_SET).join(small(again), list(_SET), "left").join(small(matched), list(_SET), "left")
    gone = flags.filter(F.col("matched").isNotNull() | (F.col("first") != F.struct("id", "line_no")))
    return stored(gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("gone")))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed lines' numbers (from 0) of every document."""
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), row_key().alias("th"), n_lines.cast("long").alias("n_lines"))
    out = keys.join(small(gone_lines(docs)), ["id", "th"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return out.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"),
        "n_lines",
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"),
    )


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; a text keeps its other lines, joined by \\n."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), row_key().alias("th"))
    # Whether each line goes, up to the last one that does.
    between = lambda g, k: F.array_repeat(F.lit(False), g - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1)
    goes = F.flatten(F.transform("gone", lambda g, k: F.concat(between(g, k), F.array(F.lit(True)))))
    gone = stored(gone_lines(docs).select("id", "th", goes.alias("goes")))
    own = F.col("row.text")
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda x, i: ~F.coalesce(F.get("goes", i), F.lit(False))), "\n")
    text = F.when(F.col("goes").isNotNull(), kept).otherwise(own).alias("text")
    return keyed.join(small(gone), ["id", "th"], "left").select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
