r"""Document fingerprints from closed syncmers, and their likeness by matching anchors in position.

A run of k units is an anchor if the smallest hash among its inner runs of s units stands first or last. That depends on the run
alone, so an edit moves no anchor outside the units it touches. A fingerprint keeps the ANCHORS anchors of smallest hash, each
with its place, in two sections: over words (runs without ASCII white space; k 3, s 1), and, for texts of fewer than FEW words,
which have hardly as many anchors, over characters (k 4, s 1, with empty units before): so short texts have it, and long ones
without white space. Likeness compares the finest section that both have: matches among the smallest hashes of the union, a match
counting where its displacement agrees with the median displacement.

Everything is DataFrame functions over whole texts: arrays of units, so work is linear in a text's length.

Edge cases: a null text is empty; texts of fewer than k units are one anchor; an empty text has no anchors, and is like another
empty text 1, like any other 0; rows that share a key share a neighbour, of several with the neighbouring key the smallest head; rows with a
null key have no neighbour (an empty text stands for it); a table of one document is its own neighbour; columns besides key and
text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcesieve.llm.shared import let, written

ANCHORS = 48
FEW = 96
WORDS, CHARS = (3, 1), (4, 1)


def _anchors(units: Column, k: int, s: int, keep: int) -> Column:
    """The keep smallest anchors of an array of units, each as hash (upper 32 bits) and place (lower)."""
    pack = lambda h, i: F.shiftleft(F.shiftright(h, 32), 32).bitwiseOR(i.cast("bigint"))
    inner_runs = k - s + 1

    def chosen(h: Column) -> Column:
        def of(inner: Column) -> Column:
            def at(i: Column) -> Column:
                edge = [F.get(inner, i + j) for j in range(inner_runs)]
                least = F.least(*edge)
                return F.when((least == edge[0]) | (least == edge[-1]), pack(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))

            return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - k), at))

        if s == 1:
            return of(h)
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        return let(runs, of)

    whole = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(pack(F.xxhash64(h), F.lit(0))))
    all_anchors = let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: F.when(F.size(h) >= k, chosen(h)).otherwise(whole(h)))
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(a, i - 1), 32)))
    return F.slice(let(F.array_sort(all_anchors), first), 1, keep)


def fingerprint(text: Column, keep: int = ANCHORS) -> Column:
    """(words, chars): the anchors of both sections; chars is null for texts of FEW words and more."""
    pad = F.array_repeat(F.lit(""), CHARS[0] - 1)  # so that a text of any length has runs of k
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(pad, F.split(text, "")))

    def both(words: Column) -> Column:
        return F.struct(_anchors(words, *WORDS, keep).alias("words"), F.when(F.size(words) < FEW, _anchors(chars, *CHARS, keep)).alias("chars"))

    return let(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), both)


def as_string(print_: Column) -> Column:
    """A fingerprint as text: hexadecimal anchors, words first."""
    section = lambda a: F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ".")
    return F.concat(F.lit("w"), section(print_["words"]), F.coalesce(F.concat(F.lit("/c"), section(print_["chars"])), F.lit("")))


def _section_likeness(a: Column, b: Column, keep: int) -> Column:
    key = lambda x: F.shiftright(x, 32)
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))

    def score(ab: Column) -> Column:
        left, right, left_keys, right_keys = ab["a"], ab["b"], ab["ka"], ab["kb"]
        lowest = F.slice(F.array_sort(F.array_union(left_keys, right_keys)), 1, keep)

        def counted(u: Column) -> Column:
            both = F.filter(F.array_intersect(left_keys, right_keys), lambda h: h <= F.array_max(u))
            shift = F.transform(both, lambda h: place(F.get(left, F.array_position(left_keys, h).cast("int") - 1)) - place(F.get(right, F.array_position(right_keys, h).cast("int") - 1)))

            def agreeing(moved: Column) -> Column:
                reach = F.lit(16) + F.greatest(F.array_max(F.transform(left, place)), F.array_max(F.transform(right, place))) / 8
                middle = F.get(moved, F.floor(F.size(moved) / 2).cast("int"))
                return F.size(F.filter(moved, lambda m: F.abs(m - middle) <= reach)) / F.size(u)

            return let(F.array_sort(shift), agreeing)

        return let(lowest, counted)

    named = F.struct(a.alias("a"), b.alias("b"), F.transform(a, key).alias("ka"), F.transform(b, key).alias("kb"))
    some = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    return some.otherwise(F.coalesce(let(named, score), F.lit(0.0)))


def likeness(a: Column, b: Column, keep: int = ANCHORS) -> Column:
    """0 to 1, and 1 for equal fingerprints."""
    chars = F.coalesce(F.size(a["chars"]) + F.size(b["chars"]) >= 0, F.lit(False))
    return F.when(a == b, F.lit(1.0)).when(chars, _section_likeness(a["chars"], b["chars"], keep)).otherwise(_section_likeness(a["words"], b["words"], keep))


def neighbours(keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_key): each distinct key with the next smaller one; the smallest with the largest.

    Keys are dealt out by range; each range finds its own pairs, and a table with one row per range joins them up.
    """
    ranges = keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "key-ranges")
    edges = ranges.groupBy("range").agg(F.max(key).alias("last"))  # one row per range: no more than shuffle partitions
    order = Window.orderBy("range")
    before = edges.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    own = F.lag(key).over(Window.partitionBy("range").orderBy(key))
    return ranges.withColumn("own", own).join(F.broadcast(before), "range").select(key, F.coalesce("own", "last").alias("next_key"))


def with_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, print, head, next_print): each text with its fingerprint, and of the next document as many code points as a
    third of the text has, and its fingerprint.

    Texts are dealt out by key once: both joins read that exchange, so their sides must want the same columns of it and no filter
    on it (a text key, never null, sees to that). What travels to a document from its neighbour is a third of a text at most.
    """
    named = F.concat(F.lit("="), F.col(key).cast("string"))  # a null key is no key, and not the empty one
    at = F.coalesce(named, F.lit("")).alias("_at")
    docs = df.select(key, at, F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = neighbours(df, key).select(named.alias("owner"), F.concat(F.lit("="), F.col("next_key").cast("string")).alias("next_key"))
    wants = df.filter(F.col(key).isNotNull()).select(named.alias("owner"), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 3).cast("int").alias("want"))
    wants = pairs.join(wants.groupBy("owner").agg(F.max("want").alias("want")), "owner")
    heads = docs.join(wants, F.col("_at") == F.col("next_key"))
    given = F.struct(F.substring("text", F.lit(1), F.col("want")).alias("head"), fingerprint(F.col("text")).alias("next_print"), key)
    heads = heads.groupBy("owner").agg(F.min(given).alias("given"))
    found = docs.join(heads, F.col("_at") == F.col("owner"), "left")
    return found.select(key, "text", F.coalesce("given.head", F.lit("")).alias("head"), F.coalesce("given.next_print", fingerprint(F.lit(""))).alias("next_print"), fingerprint(F.col("text")).alias("print"))


def edited(text: Column, head: Column) -> Column:
    """The text with its last floor(n / 3) code points replaced by the first as many of head."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(head, F.lit(1), third))


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    rows = with_neighbours(df, key, text).withColumn("edited", edited(F.col("text"), F.col("head")))
    rows = rows.select(key, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", fingerprint(F.col("edited")).alias("edited_print"), "next_print")
    p, e, n = F.col("print"), F.col("edited_print"), F.col("next_print")
    return rows.select(key, "n_chars", "edited_sha256", as_string(p).alias("fingerprint"), as_string(e).alias("edited_fingerprint"), likeness(p, e).alias("near_edited"), likeness(p, n).alias("near_next"))
