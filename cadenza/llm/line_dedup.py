"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. Lines with equal sets form one class; a class keeps its first occurrence.
Classes are joined on the rarest tokens of their sets (prefix filter) under length, positional and parity bounds,
candidates are verified by their whole sets, and a class with an earlier class of Jaccard similarity ``percent`` / 100 or
more goes altogether. "Earlier" is by document id, then by the document's text where ids repeat, then by line.

Lines are cut into words for the counts and again for the classes, which costs less than writing and reading the words'
numbers; lines of candidate pairs are cut once more, when their sets are verified. Rarity is the rank of a token's bucket among
``BUCKETS`` buckets, counted over the words of all lines. The rank replaces the bucket's bits in the token's hash, so that sorting
the numbers sorts by rarity and nothing is lost.

Every class first meets the earliest class of each of its prefix tokens; only classes that this did not settle meet the
others, so a large group of near copies does not meet in all its pairs. One sorted pass over the prefix entries finds the
earliest class of each token, and only the entries of tokens that three classes or more share are kept for the others. The
entries are exchanged in ``PASSES`` passes over the tokens, so that the disk holds one pass's shuffle at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, carried, release, restored, stored

BITS = 17
BUCKETS = 1 << BITS
#: Candidates whose lines may be fetched by a broadcast of their places (40 bytes each); more are fetched by a shuffled join.
BROADCAST_ROWS = 500_000
#: Sets of more tokens have two parities of 64 bits, as a single one tells little about them.
LONG = 64
#: Passes over the tokens, by the lowest bits of their numbers.
PASSES = 2


def _plain(text: Column) -> Column:
    """Lower case, with spaces for the other white space inside lines."""
    odd = reduce(lambda c, x: c | x, [F.contains(text, F.lit(x)) for x in "\t\r\x0b\x0c"])
    return F.when(odd, F.translate(F.lower(text), "\t\r\x0b\x0c", "    ")).otherwise(F.lower(text))


def _split(docs: DataFrame) -> DataFrame:
    """(id, t, pos, line) of every line; t tells rows apart that share an id."""
    return docs.select("id", "t", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("pos", "line"))


def _tokens(line: Column) -> Column:
    """The distinct hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _ranks(docs: DataFrame) -> Column:
    """The rank of each bucket by how many words of all lines are in it, as one array of BUCKETS numbers."""
    words = _split(docs).select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    often = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "b").join(often, "b", "left")
    # BUCKETS rows whatever the input, so that one task may number them
    rank = F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "b")) - 1 - BUCKETS // 2
    row = every.select("b", rank.alias("rank")).agg(F.sort_array(F.collect_list(F.struct("b", "rank"))).alias("x"))
    text = row.select(F.array_join(F.transform("x", lambda x: x["rank"].cast("string")), ",").alias("ranks")).first()["ranks"]
    return F.split(F.lit(text), ",").cast("array<int>")  # folded to a constant


def _by_rarity(w: Column, ranks: Column) -> Column:
    """The tokens as numbers that sort by rarity, sorted."""

    def packed(h: Column) -> Column:
        rank = F.element_at(ranks, (h.bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")).cast("long")
        # never null, which Spark can't see: arrays without nulls are sorted as plain numbers
        return F.coalesce(F.shiftleft(rank, 64 - BITS).bitwiseOR(F.shiftrightunsigned(h, BITS)), h)

    return F.sort_array(F.transform(w, packed))


def _parity(w: Column) -> Column:
    """64 bits; each tells whether an odd number of tokens falls on it. Two sets differ in as many tokens as bits, at least."""
    return F.aggregate(w, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 56).cast("int"))))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of n and m must share: the least whole number from percent * (n + m) / (100 + percent) on."""
    return F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))


def _possible(percent: int) -> Column:
    """Length, positional and parity bounds of entries (n, i, par, half) and (n2, i2, par2, half2) of one token.

    Similar sets share a token in the prefixes that leave less than the needed overlap behind them; entries behind these
    prefixes need not meet. ``half`` is the parity of the tokens with a negative hash, of long sets only.
    """
    n, m, i, j = F.col("n"), F.col("n2"), F.col("i"), F.col("i2")
    least = _overlap(n, m, percent)
    whole, half = F.col("par").bitwiseXOR(F.col("par2")), F.coalesce(F.col("half").bitwiseXOR(F.col("half2")), F.lit(0).cast("long"))
    apart = F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (i <= n - least) & (j <= m - least) & (apart <= n + m - 2 * least)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(c) of the classes of the pairs (a, b) that have an earlier class similar to them."""
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    places = stored(classes.select("c", "id", "t", "pos").join(ids, "c", "left_semi"))
    near = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    same = F.col("l.id").eqNullSafe(F.col("p.id")) & (F.col("l.t") == F.col("p.t")) & (F.col("l.pos") == F.col("p.pos"))
    found = _split(docs).alias("l").join(near.alias("p"), same).select("c", F.struct("p.id", "p.t", "p.pos").alias("at"), "line")
    sets = stored(found.dropDuplicates(["c"]).select("c", "at", _tokens(F.col("line")).alias("w")))
    a, b = (sets.select(F.col("c").alias(x), F.col("at").alias(f"at_{x}"), F.col("w").alias(f"w_{x}")) for x in "ab")
    both = F.size(F.array_intersect("w_a", "w_b"))
    near = pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("w_a") + F.size("w_b") - both))
    out = stored(near.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("c")).distinct())
    release(places, sets)
    return out


def _classes(docs: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """(c, id, t, pos, n, par, half, prefix): one row per distinct token set, with its first occurrence and rarest tokens.

    The prefix is null where a set is so small that no other can be similar.
    """
    # not by the size of w: as a filter it would be evaluated beside the column, so that lines are cut twice
    lines = _split(docs).where(F.trim("line") != "").select("id", "t", "pos", _tokens(F.col("line")).alias("w"))
    w = F.col("w")
    half = F.when(F.size(w) > LONG, _parity(F.filter(w, lambda h: h < 0)))
    sets = lines.select("id", "t", "pos", _by_rarity(w, ranks).alias("s"), _parity(w).alias("par"), half.alias("half"))
    n = F.size("s")
    # a token in a prefix is cut to 40 bits: two that meet by chance only make one more candidate
    prefix = F.transform(F.slice("s", 1, n - F.ceil(percent * n / 100).cast("int") + 1), lambda x: x.bitwiseAND(F.lit((1 << 40) - 1)))
    alone = 100 * n < percent * (n + 1)  # not even similar to a set with one token more, the nearest that there is
    sets = sets.select(F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), F.struct("id", "t", "pos").alias("at"), F.struct(n.alias("n"), "par", "half", F.when(~alone, prefix).alias("prefix")).alias("set"))
    first = sets.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.first("set").alias("set"))
    return stored(first.select(F.monotonically_increasing_id().alias("c"), "at.*", "set.*"))


def _entries(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The prefix entries of pass ``k`` that meet another class: (s, o, c, n, i, par, half, more, a), dealt out and sorted by token.

    ``a`` is the earliest class of the token where it may be similar; ``more`` tells entries that other classes may ask for.
    """
    own = ["c", "n", "i", "par", "half"]
    entries = classes.select(F.col("id").alias("o"), "c", "n", "par", "half", F.posexplode("prefix").alias("i", "s")).where(F.col("s") % PASSES == k)
    token = Window.partitionBy("s").orderBy(F.col("o").asc_nulls_first(), "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entries = entries.withColumn("lead", F.first(F.struct(*own)).over(token)).withColumn("many", F.count(F.lit(1)).over(token)).where("many > 1")
    entries = entries.withColumns({"a": F.col("lead.c")} | {f"{x}2": F.col(f"lead.{x}") for x in own[1:]})
    pair = (F.col("c") != F.col("a")) & _possible(percent)
    # kept dealt out and sorted by token, so that the second round needs no exchange
    entries = entries.select("s", "o", *own, ((F.col("many") > 2) & (F.col("c") != F.col("a"))).alias("more"), F.when(pair, F.col("a")).alias("a"))
    return bucketed(entries.where("more or a is not null"), "s")


def _others(entries: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the classes b that are not settled with each earlier class of their tokens that may be similar."""
    own = ["c", "n", "i", "par", "half"]
    asks = entries.where("more").select("s", "o", *own)
    other = asks.select("s", F.col("o").alias("o2"), F.col("c").alias("a"), *[F.col(x).alias(f"{x}2") for x in own[1:]])
    asks = asks.join(settled, "c", "left_anti")
    before = (F.col("a") != F.col("c")) & (F.coalesce(F.col("o2") <= F.col("o"), F.col("o2").isNull()))
    return asks.hint("merge").join(other, "s").where(before & _possible(percent)).select("a", F.col("c").alias("b")).distinct()


def _gone(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(c) of the classes that an earlier similar class removes."""
    passes = [_entries(classes, k, percent) for k in range(PASSES)]
    pairs = stored(reduce(DataFrame.union, [e.where("a is not null").select("a", F.col("c").alias("b")) for e in passes]).distinct())
    settled = _verified(docs, classes, pairs, percent)
    near = F.broadcast(settled) if settled.count() <= 4 * BROADCAST_ROWS else settled
    more = reduce(DataFrame.union, [_others(e, near, percent) for e in passes]).distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"))
    release(*passes)
    out = stored(settled.union(_verified(docs, classes, more, percent)).distinct())
    release(pairs, settled, more)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``df`` with its text without repeated lines, and n_lines and n_removed (long), replacing columns of these names.

    Kept are the first occurrence of each class without an earlier similar class, and lines without words (blank ones).
    A null text stays null with 0 lines, an empty one is one blank line. A null id comes before all others. Rows that
    repeat both id and text are one document and get the same result each; rows that share only the id are told apart
    by their text. Further columns of any name are carried along. Exactness rests on 64-bit token hashes: two words that
    collide count as one.
    """
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(7), id_col, text_col).alias("t"), F.col(text_col).alias("text"))
    classes = _classes(docs, _ranks(docs), percent)
    gone = _gone(docs, classes, percent)
    kept = classes.join(gone, "c", "left_anti").groupBy(F.col("id").alias("k_id"), F.col("t").alias("k_t")).agg(F.collect_list("pos").alias("kept"))
    kept = stored(kept)
    release(classes, gone)
    rows = carried(df, id=F.col(id_col), t=F.xxhash64(F.lit(7), id_col, text_col), text=F.col(text_col))
    rows = rows.join(kept, rows["t"].eqNullSafe(kept["k_t"]) & rows["id"].eqNullSafe(kept["k_id"]), "left").withColumn("l", F.split("text", "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.trim(F.translate(F.element_at(F.col("l"), i + 1), "\t\r\x0b\x0c", "    ")) == "")
    rows = rows.withColumn("at", F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank)))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform("at", lambda i: F.element_at(F.col("l"), i + 1)), "\n"))
    n = F.when(F.col("text").isNotNull(), F.size("l")).otherwise(0).cast("long")
    left = F.when(F.col("text").isNotNull(), F.size("at")).otherwise(0)
    return restored(rows, df, {text_col: text, "n_lines": n, "n_removed": n - left})
