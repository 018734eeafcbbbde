"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what fixed rules find: e-mail addresses, IPv4 addresses, card numbers and phone numbers. The words around an
entity form lexical patterns: the two words on its left, and the word on either side. All tokens with a digit or an @ are
instances; patterns and instances form a weighted graph over the whole corpus. In each round a pattern of a kind scores by
the share of its instances that are trusted for that kind, and an instance by the patterns it stands in: 1 minus the
product of what each leaves open. Seeds stay at 1 for their kind and 0 for the others. After the last round the tokens in
a pattern of high confidence, with enough trusted instances and a high score of their own, are new entities.

Scores are sums for each pattern and each instance over distinct pairs, so they are combined before the shuffle; a very
frequent pattern is one of many rows to sum, and joins on it may be split by Spark.

Defined cases: a null text is an empty one; rows that repeat are rows of their own; a table without seeds has no patterns
and gains nothing; other columns are ignored; texts of any length are taken whole. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemark.session import cut

KINDS = ("email", "ip", "card", "phone")
# In each pattern a match can only begin where a run of its characters begins or the match before ended, and runs are
# possessive: the same matches as the plain pattern, but a long run is read once and without recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
JOINT = "\x01"  # stands for one space or hyphen between two digits
CARD = r"(?<![0-9\x01])[0-9](?:\x01?[0-9]){12,18}(?![0-9\x01])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
TOKENS = len(KINDS)  # the kind of tokens that are no entity yet
NO_MATCH = "CAST(array() AS array<struct<kind:int,k:int,gap:int,size:int,value:string,before:string,after:string>>)"


def last_words(text: Column) -> Column:
    """The end of a text from its last word but one on, however long the words and the space between them."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^\s*+(?:\S++\s*+){0,2}", 0))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*+\S*+\s*+", 0)


def raw_matches(text: Column, kind: int, pattern: str) -> Column:
    """The matches of a pattern, each with the length of the gap before it, the two words before and the word after it.

    A match of the same kind nearby is a word like any other. Words are sought in the nearest gaps: three before a match
    with the two matches between them, and two after it with one, which hold them unless matches touch.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends, heads = F.transform(gaps, last_words), F.transform(gaps, first_word)
    back = lambda values, by: F.concat(F.array(*[F.lit("")] * by), values)
    ahead = lambda values, by: F.slice(values, F.lit(by + 1), F.size(found) + 1)
    sides = {
        "a2": back(ends, 2), "m2": back(found, 2), "a1": back(ends, 1), "m1": back(found, 1), "a0": ends,
        "b1": ahead(heads, 1), "n1": ahead(found, 1), "b2": ahead(heads, 2),
    }
    zipped = F.arrays_zip(found.alias("m"), F.transform(gaps, F.length).alias("gap"), *(v.alias(n) for n, v in sides.items()))

    def one(z: Column, k: Column) -> Column:
        near = lambda *names: F.concat(*(F.coalesce(z[n], F.lit("")) for n in names))
        return F.struct(
            F.lit(kind).alias("kind"), k.alias("k"), z["gap"].alias("gap"), F.length(z["m"]).alias("size"), z["m"].alias("value"),
            last_words(near("a2", "m2", "a1", "m1", "a0")).alias("before"), first_word(near("b1", "n1", "b2")).alias("after"),
        )

    made = F.transform(F.slice(zipped, F.lit(1), F.size(found)), one)
    return F.when(text.rlike(pattern), made).otherwise(F.expr(NO_MATCH))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(k: Column) -> Column:
        digit = F.substring(F.reverse(number), k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, digit).otherwise(F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), worth), F.lit(0), lambda a, n: a + n)
    return total % 10 == 0


def small_parts(address: Column) -> Column:
    """Whether all parts of an address are at most 255, leading zeros allowed."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def all_matches(text: Column) -> Column:
    """The raw matches of all kinds and of tokens; texts without a digit or an @ are left at once."""
    joined = F.regexp_replace(F.translate(text, JOINT, "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    sources = ((text, EMAIL), (text, IP), (joined, CARD), (text, PHONE), (text, TOKEN))
    every = F.concat(*(raw_matches(source, kind, pattern) for kind, (source, pattern) in enumerate(sources)))
    return F.when(text.rlike("[0-9@]"), every).otherwise(F.expr(NO_MATCH))


def scanned(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (uid, doc_id), and entities (uid, kind, start, end, value, before, after).

    An entity of kind TOKENS is an instance that overlaps no other entity. The texts are read once.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.monotonically_increasing_id().alias("uid"))
    rows = cut(rows.select("uid", "doc_id", all_matches(F.col("body")).alias("raw")))
    each = rows.select("uid", F.explode("raw").alias("m")).select("uid", "m.*")
    so_far = Window.partitionBy("uid", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    kind = F.col("kind")
    holds = (
        F.when(kind == 1, small_parts(F.col("value")))
        .when(kind == 2, luhn(digits(F.col("value"))))
        .when(kind == 3, F.length(digits(F.col("value"))).between(9, 15))
        .otherwise(F.lit(True))
    )
    each = each.filter(holds)
    along = Window.partitionBy("uid").orderBy("start", "kind")
    is_base = kind < TOKENS
    reached = F.max(F.when(is_base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_base, F.col("start"))).over(along.rowsBetween(0, Window.unboundedFollowing))
    apart = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    each = each.withColumn("apart", apart).filter(is_base | F.col("apart"))
    return rows.select("uid", "doc_id"), cut(each.select("uid", "kind", "start", "end", "value", "before", "after"))


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around an entity."""
    left = F.filter(F.split(F.lower(before), r"\s+"), lambda w: w != "")
    right = F.filter(F.split(F.lower(after), r"\s+"), lambda w: w != "")
    two = F.when(F.size(left) >= 2, F.concat(F.lit("< "), F.array_join(F.slice(left, F.lit(-2), F.lit(2)), " ")))
    sides = F.when(
        (F.size(left) >= 1) & (F.size(right) >= 1), F.concat(F.lit("<> "), F.element_at(left, -1), F.lit(" _ "), F.element_at(right, 1))
    )
    return F.array_compact(F.array(two, sides))


def graph(entities: DataFrame) -> DataFrame:
    """(pattern, instance, kind): which instances stand in which patterns; kind is null unless it is a seed; a table."""
    seed = F.when(F.col("kind") < TOKENS, F.col("kind")).alias("kind")
    each = entities.select(F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"), instance_of(F.col("value")).alias("instance"), seed)
    return cut(each.distinct())


def instance_of(value: Column) -> Column:
    """The name of an instance: lower-cased, without punctuation at its ends."""
    return F.regexp_replace(F.lower(value), r"^[^a-z0-9+(]+|[^a-z0-9)]+$", "")


def score_patterns(links: DataFrame, trusted: DataFrame, min_support: int) -> DataFrame:
    """(pattern, kind, score): the share of a pattern's distinct instances that are trusted, by how much."""
    sizes = links.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("size"))
    sums = links.select("pattern", "instance").distinct().join(trusted, "instance").groupBy("pattern", "kind").agg(
        F.sum("trust").alias("sum"), F.sum((F.col("trust") >= 0.5).cast("int")).alias("support")
    )
    kept = sums.filter(F.col("support") >= min_support)
    return kept.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("size")).alias("score"))


def bootstrap(links: DataFrame, rounds: int, min_support: int, min_pattern: float) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and trust in instances after the last round."""
    seeds = cut(links.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("trust", F.lit(1.0)))
    trusted, scores = seeds, None
    for _ in range(rounds):
        scores = cut(score_patterns(links, trusted, min_support).filter(F.col("score") >= min_pattern))
        open_ = links.filter("kind IS NULL").select("pattern", "instance").distinct().join(scores, "pattern")
        left = F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))
        found = open_.groupBy("instance", "kind").agg(F.round(1 - left, 9).alias("trust"))
        trusted = cut(seeds.unionByName(found.join(seeds.select("instance"), "instance", "left_anti")))
    return scores, trusted


def discovered(
    entities: DataFrame, rounds: int = 3, min_support: int = 3, min_pattern: float = 0.6, min_trust: float = 0.75, min_digits: int = 4
) -> DataFrame:
    """(uid, kind, start, end) of the entities that patterns add; each is given to its best kind."""
    scores, trusted = bootstrap(graph(entities), rounds, min_support, min_pattern)
    plausible = (F.length(digits(F.col("value"))) >= min_digits) | F.col("value").contains("@")
    tokens = entities.filter((F.col("kind") == TOKENS) & plausible).select(
        "uid", "start", "end", instance_of(F.col("value")).alias("instance"),
        F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"),
    )
    good = tokens.join(scores, "pattern").join(trusted.filter(F.col("trust") >= min_trust), ["instance", "kind"])
    best = good.groupBy("uid", "start", "end").agg(F.max(F.struct("score", "trust", (-F.col("kind")).alias("order"))).alias("best"))
    return best.select("uid", (-F.col("best.order")).cast("int").alias("kind"), "start", "end")


def joined_spans(entities: Column) -> Column:
    """kind:start:end of each entity in order, with commas between."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(entities), lambda e: F.concat_ws(":", F.get(names, e["kind"]), e["start"], e["end"])), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (kind, start, end), of the fixed rules and of the patterns."""
    rows, entities = scanned(docs, key, text)
    base = entities.filter(F.col("kind") < TOKENS).select("uid", "kind", "start", "end", F.lit(False).alias("is_new"))
    new = discovered(entities, **limits).select("uid", "kind", "start", "end", F.lit(True).alias("is_new"))
    span = F.struct("kind", "start", "end")
    spans = base.unionByName(new).groupBy("uid").agg(
        F.collect_list(F.when(~F.col("is_new"), span)).alias("base"), F.collect_list(F.when(F.col("is_new"), span)).alias("added")
    )
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int>>)")
    return rows.join(spans, "uid", "left").select("doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "added")))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row the number of base entities of each kind, the digest of the base spans, and all spans."""
    found = find(docs, key, text, **limits)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
