"""Line de-duplication by an exact set-similarity join, in DataFrame operations only.

Lines are compared as sets of words (lower-cased, split at white space). Two lines match when the Jaccard similarity of
their sets is at least `threshold`; a line goes if it matches an earlier line of any document, gone or not, where order is
(doc_id, hash of the text, line number). Each distinct set is joined once: its first line stands for it, and all later
lines with the same set go.

Sets that match and are not equal have at least s words in common, where s / (s + 1) reaches the threshold (four at 0.8),
so smaller sets match by equality alone. Words of a set are ordered by rarity, the rarest first. A set of n words is filed under its first n - ceil(t n) + 2
words; two sets that match share two of these. A pair is a candidate if it does, if the sizes allow it (t |x| <= |y|),
if enough words can still follow the shared ones in both orders (the positional filter), and if 64-bit summaries of the
sets do not rule it out. A larger set has two summaries of parts of its words, chosen by hash so that their size stays bounded;
a set of the next size has a part in common with it, and words missing from a part are missing from the whole. Candidates are verified on the whole sets. Rarity is the count over all documents of the words that fall in the same
of 2^17 hash cells: any fixed order gives the same matches, and the counts are a table of constant size.

Before that, each set is compared with the earliest one and the ones just before it under each of its rarest
words, a few rows a word, which settles the families of near copies. A set that matches there goes, but still counts as earlier for others; after that
only sets that are not settled look for an earlier one.

No table of pairs is made, so families that grow with the table give rows in proportion to their size. Of the rows that file sets under words, those
stay that have a candidate under the same word (a semi-join); sets with fewer such rows than the words that a match shares are
out. The others get summaries of 1,024 bits, which leave few false candidates, and the same is asked again; then whole
sets are compared, again by a semi-join. Under a word sets meet those of their own group of sizes and of a group beside it. The words are worked off in slices, so
that only a part of the rows is on disk at a time. Words that a sample of the sets shows to be frequent have their sets cut
into tiles of bounded size. The sample decides the road, never the result.

Defined cases: lines with fewer than `min_words` distinct words stay and match nothing; a null text stays null; an empty
text stays empty; texts and lines of any length are taken whole; rows that agree in doc_id and text are treated alike;
null ids come first; other columns are kept as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemark.llm.columns import unused
from grovemark.session import cut, fits

CELL_BITS = 17
SAMPLE = 16  # one set in so many is counted to find frequent keys
HOT_IN_SAMPLE = 256
SETTLING = 3  # so many of the rarest words of a set lead to an earlier one before pairs are formed
BEFORE = 3  # so many sets before a set are looked at with the earliest one under each of these words
TRIED = 2  # so many of them are verified, those that are met under most words
SALTS = 256  # groups of the sets under a frequent word
SHARED = 2  # words that two prefixes must share; a match of unequal sets has at least four in common at 0.8
TILE_ROWS = 4_096
SUMMARY_WORDS = 48  # of a set in one summary of 64 bits; larger sets are summarised by parts of their words
MAX_LEVEL = 6
WIDE = 16  # times 64 bits of the summary that sets with a near one have besides
GROUP_BITS = 6  # of a key, for the group of sizes
SLICES = 4  # of the keys, one after the other
WHOLE_ROWS = 100_000  # sets of which the keys are not worked off in slices
MAX_BROADCAST_ROWS = 200_000  # of two numbers and a short list each
NO_DOC = -(2**63) + 1  # stands for a null id in the order of documents
MAX_SETTLED = 1_000_000  # of one number each
SPACES = "[ \\t\\r\\n\\x0b\\x0c]+"


def words_of(line: Column) -> Column:
    """The words of a line; the set of them is array_distinct of it."""
    return F.array_remove(F.split(F.lower(line), SPACES), "")


def cell_ranks(docs: DataFrame, text: str) -> Column:
    """The rarity of each hash cell (twice the logarithm of its count) as an array literal of constant size."""
    word = F.explode(F.split(F.lower(F.col(text)), SPACES))
    cell = F.pmod(F.xxhash64("word"), F.lit(1 << CELL_BITS)).cast("int")
    counts = docs.select(word.alias("word")).filter("word <> ''").groupBy(cell.alias("cell")).count()
    ranks = ["0"] * (1 << CELL_BITS)
    for row in counts.collect():  # 2^CELL_BITS rows at most
        ranks[row["cell"]] = str(min(126, 2 * row["count"].bit_length()))
    return F.split(F.lit(",".join(ranks)), ",").cast("array<tinyint>")


def representatives(docs: DataFrame, key: str, text: str, threshold: float, min_words: int) -> DataFrame:
    """(sig, n, bits, more, prefix, place) of each distinct word set, where place is its first line; a table.

    bits and more are summaries of 64 bits, of which each word sets one. A set is at level 0 if it has SUMMARY_WORDS words
    at most, at level k if 2^k times as many. bits is of the words whose hash has k zero bits in a certain place, more of those
    that have k - 1 there and not the next.
    """
    ranks = cell_ranks(docs, text)
    named = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("body"))
    lines = named.select("doc", "row", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))

    def rank_first(word: Column) -> Column:
        h = F.xxhash64(word)
        rank = F.coalesce(F.get(ranks, F.pmod(h, F.lit(1 << CELL_BITS)).cast("int")), F.lit(0).cast("tinyint"))
        return F.shiftleft(rank.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    sets = lines.select(
        F.struct("doc", "row", "line_no").alias("place"),
        F.sort_array(F.transform(F.array_distinct(words_of(F.col("line"))), rank_first)).alias("words"),
    ).withColumn("n", F.size("words")).withColumn("level", level_of(F.col("n")))
    enough = F.col("n") >= min_words
    compared = enough & (F.col("n") >= F.lit(least_common(threshold)))
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + shared_words(threshold, min_words)).cast("int")

    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    summary = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(bit(w)))
    lowest = lambda w, k: F.shiftright(w, 6).bitwiseAND(F.call_function("shiftleft", F.lit(1), k) - 1)
    part = F.filter("words", lambda w: lowest(w, F.col("level")) == 0)
    other = F.filter("words", lambda w: (lowest(w, F.col("level") - 1) == 0) & (lowest(w, F.col("level")) != 0))
    large = F.col("level") > 0

    # 31 bits of a word's hash are enough to file it under: words that share them are told apart when pairs are verified.
    prefix = F.transform(F.slice("words", F.lit(1), length), lambda w: F.shiftright(w, 12).bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    sets = sets.select(
        F.when(enough, F.xxhash64("words")).otherwise(F.xxhash64("place", F.lit("short"))).alias("sig"),
        F.when(enough, F.col("n")).otherwise(0).alias("n"),
        F.when(compared, prefix).alias("prefix"),
        F.when(compared, F.when(large, summary(part)).otherwise(summary(F.col("words")))).alias("bits"),
        F.when(compared, F.when(large, summary(other)).otherwise(F.lit(0).cast("long"))).alias("more"),
        "place",
    )
    one = sets.groupBy("sig").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "bits", "more", "prefix")))
    return cut(one)


def least_common(threshold: float) -> float:
    """How many words two unequal sets that match have in common at least: s of s + 1 must reach the threshold."""
    return math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else math.inf


def shared_words(threshold: float, min_words: int) -> int:
    """How many words two prefixes must share: SHARED, but no more than any match of unequal sets has in common."""
    return max(1, min(SHARED, max(math.ceil(threshold * min_words - 1e-9), least_common(threshold))))


def level_of(n: Column) -> Column:
    """How often SUMMARY_WORDS must be doubled to reach n, MAX_LEVEL at most."""
    return sum(((n > SUMMARY_WORDS << k).cast("int") for k in range(MAX_LEVEL)), F.lit(0))


def entries_of(reps: DataFrame) -> DataFrame:
    """A row for each word of a prefix. doc orders the sets but for those of one document; shape packs n, the level of the
    summaries, at and open.

    reps has a column open: whether the set still looks for an earlier one.
    """
    shape = F.expr("shiftleft(CAST(n AS BIGINT), 32) | shiftleft(CAST(level AS BIGINT), 29) | shiftleft(CAST(at AS BIGINT), 1) | CAST(open AS BIGINT)")
    doc = F.coalesce("place.doc", F.lit(NO_DOC))
    rows = reps.filter("n > 0").withColumn("level", level_of(F.col("n"))).select(F.posexplode("prefix").alias("at", "key"), "*")
    return rows.select("key", "sig", doc.alias("doc"), shape.alias("shape"), "bits", "more")


def possible(threshold: float, shared: int) -> Column:
    """Whether the set of row a may match that of row b, under the same key: sizes, places of the shared word, summaries."""
    n = {x: f"shiftright({x}.shape, 32)" for x in "ab"}
    left = {x: f"({n[x]} - (shiftright({x}.shape, 1) & 268435455L))" for x in "ab"}
    need = f"({n['a']} + {n['b']}) * {threshold / (1 + threshold)!r}D - 1e-9D"
    sizes = f"{n['a']} >= {n['b']} * {threshold!r}D - 1e-9D AND {n['b']} >= {n['a']} * {threshold!r}D - 1e-9D"

    def missing(x: str, y: str) -> str:
        """At least so many words of x are not in y."""
        level = {z: f"(shiftright({z}.shape, 29) & 7L)" for z in (x, y)}
        return (
            f"CASE {level[x]} - {level[y]} WHEN 0 THEN bit_count({x}.bits & ~{y}.bits) + bit_count({x}.more & ~{y}.more)"
            f" WHEN 1 THEN bit_count(({x}.bits | {x}.more) & ~{y}.bits) WHEN -1 THEN bit_count({x}.bits & ~({y}.bits | {y}.more)) ELSE 0 END"
        )

    bits = f"{n['a']} - {missing('a', 'b')} >= {need} AND {n['b']} - {missing('b', 'a')} >= {need}"
    # The first words that two sets share have at most that many shared words before them.
    return F.expr(f"{sizes} AND LEAST({left['a']}, {left['b']}) + {shared - 1} >= {need} AND {bits}")


def wide_summaries(whole: DataFrame) -> DataFrame:
    """(sig, wide0, ...): a summary of 64 * WIDE bits of each set in whole(sig, words), of which each word sets one."""
    bit = whole.select("sig", F.explode("words").alias("word")).withColumn("bit", F.pmod(F.xxhash64("word"), F.lit(64 * WIDE)).cast("int"))
    of = lambda k: F.expr(f"bit_or(IF(shiftright(bit, 6) = {k}, shiftleft(1L, bit & 63), 0L))")
    return bit.groupBy("sig").agg(*(of(k).alias(f"wide{k}") for k in range(WIDE)))


def possible_wide(threshold: float) -> Column:
    """Whether the sets of rows a and b may match by the summaries of 64 * WIDE bits: each bit that differs is a word of one alone."""
    sizes = "(shiftright(a.shape, 32) + shiftright(b.shape, 32))"
    alone = " + ".join(f"bit_count(a.wide{k} ^ b.wide{k})" for k in range(WIDE))
    return F.expr(f"{alone} <= {sizes} * {(1 - threshold) / (1 + threshold)!r}D + 1e-9D")


# An open set looks for one of the same or an earlier document. The condition is the same for both sides, so that both sides
# of the join stay the same shuffle.
NEAR = "a.sig <> b.sig AND ((a.shape & 1 = 1 AND a.doc >= b.doc) OR (b.shape & 1 = 1 AND b.doc >= a.doc))"
SAME_TILE = "a.key = b.key AND a.mine = b.mine AND a.theirs = b.theirs"


def similar(a: Column, b: Column, threshold: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= (F.size(a) + F.size(b) - shared) * F.lit(threshold) - 1e-9


def marked(entries: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    hot = hot.withColumn("hot", F.lit(True))
    return entries.join(F.broadcast(hot) if few else hot, "key", "left")


def words_of_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(sig, place, home, words) of the sets in wanted (sig, place, home), read again from their first lines; a table.

    Rows that agree in id and text give a set more than once.
    """
    by_row = cut(wanted.groupBy("place.doc", "place.row").agg(F.collect_list(F.struct("sig", "place", "home")).alias("lines")))
    named = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("body"))
    few = fits(by_row, MAX_BROADCAST_ROWS)
    same = named["doc"].eqNullSafe(by_row["doc"]) & (named["row"] == by_row["row"])
    found = named.join(F.broadcast(by_row) if few else by_row, same).select("body", "lines")
    lines = found.withColumn("all", F.split("body", "\n", -1)).select("all", F.explode("lines").alias("one"))
    words = F.array_distinct(words_of(F.element_at("all", F.col("one.place.line_no") + 1)))
    return cut(lines.select("one.*", words.alias("words")))


def matched(docs: DataFrame, reps: DataFrame, key: str, text: str, threshold: float, min_words: int) -> DataFrame:
    """sig of every set whose first line matches an earlier line with another set."""
    shared = shared_words(threshold, min_words)
    seen = entries_of(reps.filter(F.pmod("sig", F.lit(SAMPLE)) == 0).withColumn("open", F.lit(True))).groupBy("key").count()
    hot = cut(seen.filter(F.col("count") >= HOT_IN_SAMPLE).select("key"))
    few_hot = fits(hot, MAX_BROADCAST_ROWS)
    gone = settled(docs, reps, hot, few_hot, key, text, threshold)
    few = fits(gone, MAX_SETTLED)
    marks = gone.withColumn("_gone", F.lit(True))
    open_ = reps.join(F.broadcast(marks) if few else marks, "sig", "left").withColumn("open", F.col("_gone").isNull()).drop("_gone")
    near = near_entries(open_ if few else cut(open_), hot, few_hot, threshold, shared)
    asked = met_often(near, shared)
    own = reps.join(asked.select("sig").distinct(), "sig").select("sig", "place", F.col("sig").alias("home"))
    whole = words_of_sets(docs, key, text, own).drop("home").dropDuplicates(["sig"])
    a, b = in_tiles(by_size(asked, threshold), F.lit(True), cut(wide_summaries(whole)))
    nearer = a.join(b, F.expr(SAME_TILE) & F.expr(NEAR) & possible(threshold, shared) & possible_wide(threshold), "left_semi")
    a, b = in_tiles(met_often(cut(of_any_size(nearer.select(*asked.columns))), shared), F.expr("shape & 1 = 1"), whole)
    match = possible(threshold, shared) & similar(F.col("a.words"), F.col("b.words"), threshold)
    found = a.join(b, F.expr(SAME_TILE) & F.expr("a.place > b.place") & match, "left_semi")
    return gone.union(found.select("sig")).distinct()


def met_often(near: DataFrame, shared: int) -> DataFrame:
    """The rows of the sets that have so many rows, since a set shares so many words with one that it matches; a table."""
    often = near.groupBy("sig").agg(F.count("*").alias("met")).filter(F.col("met") >= shared)
    return cut(near.join(often, "sig", "left_semi"))


def by_size(entries: DataFrame, threshold: float) -> DataFrame:
    """entries with keys of a word and a group of sizes: sets are in the group of their size and that of the largest that may match."""
    ratio = math.log(max(threshold**-2, 1.5))  # a set reaches the next group at most
    group = lambda n: f"CAST(floor(ln({n}) / {ratio!r}D) AS BIGINT)"
    n = "shiftright(shape, 32)"
    groups = F.expr(f"explode(sequence({group(n)}, {group(f'floor({n} / {threshold!r}D + 1e-6D)')}))")
    key = F.expr(f"shiftleft(CAST(key AS BIGINT), {GROUP_BITS}) | group")
    return entries.withColumn("group", groups).withColumn("key", key).drop("group")


def of_any_size(entries: DataFrame) -> DataFrame:
    """Rows of by_size with their keys of a word again, once each."""
    return entries.withColumn("key", F.shiftright("key", GROUP_BITS).cast("int")).distinct()


def near_entries(reps: DataFrame, hot: DataFrame, few: bool, threshold: float, shared: int) -> DataFrame:
    """The rows of entries_of whose set may match another one under the same key, where the later of the two is open; a table.

    No pairs are formed: a row is there or not. The keys are worked off in SLICES, so that the rows of one slice alone are on disk.
    """
    near = F.expr(NEAR) & possible(threshold, shared)
    made = []
    slices = 1 if fits(reps, WHOLE_ROWS) else SLICES
    for part in range(slices):
        entries = marked(entries_of(reps).filter(F.pmod("key", F.lit(slices)) == part), hot, few)
        cold = by_size(entries.filter("hot IS NULL").drop("hot"), threshold)
        found = cold.alias("a").join(cold.alias("b"), F.expr("a.key = b.key") & near, "left_semi")
        made.append(cut(of_any_size(found)))
    dense = cut(entries_of(reps).join(F.broadcast(hot) if few else hot, "key"))
    a, b = in_tiles(dense, F.lit(True))
    made.append(cut(a.join(b, F.expr(SAME_TILE) & near, "left_semi").select(*dense.columns).distinct()))
    return reduce(DataFrame.union, made)


def settled(docs: DataFrame, reps: DataFrame, hot: DataFrame, few: bool, key: str, text: str, threshold: float) -> DataFrame:
    """sig of the sets that match the earliest set or one of the BEFORE sets just before them under one of their rarest words.

    Each is tried with TRIED such sets. Sets under a frequent word are dealt to SALTS groups with an earliest one each. A table.
    """
    heads = reps.filter("n > 0").withColumn("prefix", F.slice("prefix", 1, SETTLING)).withColumn("open", F.lit(True))
    first = Window.partitionBy("key", "salt").orderBy("doc", "sig")
    row = F.struct("sig", "doc", "shape", "bits", "more")
    dealt = marked(entries_of(heads), hot, few).withColumn("salt", F.when(F.col("hot"), F.pmod("sig", F.lit(SALTS))).otherwise(0).cast("int"))
    earlier = [F.first(row).over(first), *(F.lag(row, k).over(first) for k in range(1, 1 + BEFORE))]
    ahead = dealt.select(row.alias("a"), F.array_distinct(F.array(*earlier)).alias("earlier")).select("a", F.explode("earlier").alias("b"))
    near = ahead.filter("a.sig <> b.sig").filter(possible(threshold, 1 + SETTLING))
    counted = near.groupBy(F.col("a.sig").alias("sig"), F.col("b.sig").alias("other")).agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "other")), asc=False), 1, TRIED).alias("best")
    tried = cut(counted.groupBy("sig").agg(best).select("sig", F.explode("best.other").alias("other")))
    return cut(verified(docs, reps, tried, key, text, threshold))


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """sig of the pairs (sig, other) whose whole sets match, where other is the earlier one.

    The words of a set move once for each of its pairs, to where those of the other set are.
    """
    both = pairs.select("sig", F.col("other").alias("home")).union(pairs.select("other", "other").distinct())
    whole = words_of_sets(docs, key, text, reps.select("sig", "place").join(both, "sig"))
    heads = whole.filter("sig = home").select("home", F.col("place").alias("before"), F.col("words").alias("y"))
    heads = cut(heads.dropDuplicates(["home"]))  # a table, so that the join below can split a frequent home
    match = (F.col("place") > F.col("before")) & similar(F.col("words"), F.col("y"), threshold)
    return whole.filter("sig <> home").join(heads, "home").filter(match).select("sig").distinct()


def in_tiles(rows: DataFrame, asks: Column, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that ask and all rows, as a and b, copied to the tiles of TILE_ROWS by TILE_ROWS in which those of a key meet.

    facts(sig, ...) are joined to them.
    """
    parts = lambda n: F.ceil(n / TILE_ROWS).cast("int")
    counts = rows.groupBy("key").agg(parts(F.sum(asks.cast("long"))).alias("asking"), parts(F.count("*")).alias("asked"))
    rows = cut(rows.join(counts.filter("asking > 0"), "key"))
    own = lambda n: F.expr(f"CAST(pmod(xxhash64(sig), {n}) AS INT)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.filter(asks).withColumn("mine", own("asking")).withColumn("theirs", every("asked"))
    b = rows.withColumn("theirs", own("asked")).withColumn("mine", every("asking"))
    a, b = (x if facts is None else x.join(facts, "sig") for x in (a, b))
    return a.alias("a"), b.alias("b")


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """(doc, row, kept): the numbers, from 0, of the lines that stay; rows that lose all lines are absent."""
    reps = representatives(docs, key, text, threshold, min_words)
    gone = cut(matched(docs, reps, key, text, threshold, min_words))
    stay = reps.select("sig", "place").join(gone, "sig", "left_anti")
    return stay.groupBy("place.doc", "place.row").agg(F.sort_array(F.collect_list("place.line_no")).alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """docs with the matched lines taken out of the text."""
    doc, row, kept = unused(docs, "_doc", "_row", "_kept")
    stay = kept_lines(docs, key, text, threshold, min_words).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("kept").alias(kept))
    same = F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(row))
    lines = F.split(F.col(text), "\n", -1)
    rest = F.array_join(F.transform(F.coalesce(kept, F.expr("CAST(array() AS array<int>)")), lambda k: F.get(lines, k)), "\n")
    found = docs.join(stay, same, "left")
    return found.withColumn(text, F.when(F.col(text).isNotNull(), rest)).select(*docs.columns)


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_lines (numbers from 0, joined by commas), without moving the texts."""
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("_row"),
        F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0)).alias("n_lines"), F.col(text).isNull().alias("_none"),
    )
    kept = kept_lines(docs, key, text, threshold, min_words)
    same = narrow["doc_id"].eqNullSafe(kept["doc"]) & (narrow["_row"] == kept["row"])
    return narrow.join(kept, same, "left").select(
        "doc_id",
        F.when(F.col("_none"), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_kept"),
        F.coalesce(F.array_join(F.col("kept").cast("array<string>"), ","), F.lit("")).alias("kept_lines"),
    )
