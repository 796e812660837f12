"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot signature is an anchor, one of a list of common words, with the chain of
the next ``CHAIN`` content words after it; common words in between are passed
over. Anchors are spread over natural prose and rare in menus and lists, so the set
of signatures follows the running text. A text's fingerprint is the set of its
signatures' hashes; it is named by the digest of the ordered set.

Two sets are compared by Jaccard, pruned by their lengths: if the shorter has less
than ``least`` times the longer's elements the bound already decides. For near
pairs, sets are partitioned by length, so that only neighbouring partitions can
match; candidates share one of the rarest signatures that a match cannot miss.

Defined results: a null text counts as empty; a text without anchor chains has one
signature, the hash of its words (of the text itself if it has none), so equal
texts always have equal fingerprints and likeness 1. Equal rows give equal
results; rows are ordered by id, then by text, null ids first. An empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import parts
from sparkprep.session import materialise

CHAIN = 2
SIMILARITY = 0.8
BUCKET_ROWS = 2048
# Common words of English, German, French and Spanish, which serve as anchors.
COMMON = (
    "the of and to in is that it for on was be as with by this are at from "
    "der die und von zu das mit des ist dem den sich auf für im "
    "le la les et est un une que qui dans pas du pour sur "
    "el los las del por con para se no lo"
).split()

# So many common words in a row are passed over; an anchor before a longer run starts no chain. (The pattern's
# repetition is recursive, so it needs a bound.)
MOST_PASSED = 20


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, by first letter."""
    letters = dict.fromkeys(w[0] for w in words)
    return "(?:" + "|".join(c + "(?:" + "|".join(w[1:] for w in words if w[0] == c) + ")" for c in letters) + ")"


# The length is looked at first: most words are longer than any common one.
_COMMON = f" (?=[^ ]{{{min(map(len, COMMON))},{max(map(len, COMMON))}}} )(?={_any_of(COMMON)} )"
# A run of common words, of any length, is one token: each word behind a mark, no spaces between. Content words stand alone.
MARK = "\x01"
_JOIN = f"({MARK}[^ ]+) (?={MARK})"
_CONTENT = f" [^ {MARK}][^ ]*"
_RUN = f" {MARK}[^ ]+"
# One match a run, whose anchors all have the same chain; the lookahead lets chains of neighbouring runs overlap.
_SPOT = f"(?<= ){MARK}(?=([^ ]+{(_CONTENT + f'(?:{_RUN})?') * (CHAIN - 1)}{_CONTENT}) )"


def signatures(text: Column) -> Column:
    """The ordered set of hashes of a text's spot signatures."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(words, _COMMON, f" {MARK}"), _JOIN, "$1")
    spots = F.array_join(F.regexp_extract_all(marked, F.lit(_SPOT), F.lit(1)), "\n")
    # runs inside a chain are passed over; no spots at all leave one empty string
    chains = F.split(F.regexp_replace(spots, _RUN, ""), "\n")
    whole = F.when(F.trim(words) == "", F.xxhash64(text)).otherwise(F.xxhash64(words))

    def hashes(spot: Column) -> Column:
        run = F.substring_index(spot, " ", 1)
        chain = F.substr(spot, F.char_length(run) + 1)
        own = F.transform(F.array_distinct(F.split(run, MARK)), lambda anchor: F.xxhash64(F.concat(anchor, chain)))
        return F.when(spot == "", F.array(whole)).otherwise(own)

    return F.sort_array(F.array_distinct(F.flatten(F.transform(chains, hashes))))


def digest(signs: Column) -> Column:
    return F.sha2(F.concat_ws(",", signs.cast("array<string>")).cast("binary"), 256)


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets, or 0 where their lengths alone keep it below ``least``."""
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    if least <= 0:
        return exact.cast("double")
    possible = F.least(F.size(a), F.size(b)) >= F.lit(least) * F.greatest(F.size(a), F.size(b))
    return F.when(possible, exact).otherwise(F.lit(0.0)).cast("double")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, signs`` of each document with the next one's ``next_text, next_signs``, by id; the last meets the first.

    Rows go to buckets of neighbouring ids, and each bucket also gets a copy of the
    first row of the following one, so no window spans more than a bucket. A bucket
    is a range of ids of equal width.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    buckets = parts(n, BUCKET_ROWS)
    width = 1 if low is None else max(1, -(-(high - low + 1) // buckets))
    bucket = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    order = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    placed = rows.withColumn("bucket", bucket).withColumn("order", order)
    firsts = placed.groupBy("bucket").agg(F.min("order").alias("order"))
    # one row a bucket; the bucket before it takes a copy of its first row, the last that of the first
    ring = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    firsts = materialise(firsts.withColumn("to", before), "first-rows").select("to", F.col("order").alias("o"))
    copies = placed.join(firsts, F.col("order").eqNullSafe(F.col("o"))).select("doc_id", "text", F.col("to").alias("bucket"), "order")
    copies = copies.groupBy("bucket", "order").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = placed.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    both = both.withColumn("signs", signatures(F.col("text")))
    along = Window.partitionBy("bucket").orderBy("copy", "order")
    led = both.withColumn("next_text", F.lead("text").over(along)).withColumn("next_signs", F.lead("signs").over(along))
    return led.where("copy = 0").select("doc_id", "text", "signs", "next_text", "next_signs")


def compared(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    In the edited text the last half of the code points (rounded down) is replaced by
    as many of the next document's first, or all it has.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_signs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("signs")).alias("fingerprint"),
        digest(F.col("edited_signs")).alias("edited_fingerprint"),
        jaccard(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        jaccard(F.col("signs"), F.col("next_signs")).alias("near_next"),
        F.size("signs").cast("long").alias("n_signatures"),
    )


def membership(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id``: documents of equal fingerprints share the least id."""
    named = docs.select("doc_id", digest(signatures(F.coalesce("text", F.lit("")))).alias("f"))
    ids = named.groupBy("f").agg(F.min("doc_id").alias("class_id"))
    return named.join(ids, "f").select("doc_id", "class_id")


def near_pairs(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a, b, likeness``: pairs of class ids (see ``membership``) whose sets have Jaccard ``least`` or more.

    Equal sets are one class and never paired. Of a set only its rarest signatures
    travel, one more than a match may miss; a set joins the partition of its length
    and the next longer one.
    """
    signed = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")).withColumn("f", digest(F.col("signs")))
    sets = materialise(signed.groupBy("f").agg(F.min("doc_id").alias("id"), F.first("signs").alias("signs")).select("id", "signs").where("id is not null"), "sets")
    flat = sets.select("id", F.size("signs").alias("n"), F.explode("signs").alias("s"))
    counted = flat.join(flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s")
    rare = Window.partitionBy("id").orderBy("df", "s")
    may_miss = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9)
    lone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    # signatures that occur once come first in rarity and match nothing
    heads = counted.withColumn("nth", F.row_number().over(rare) + lone).where(F.col("nth") <= may_miss + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9)
    heads = heads.select("id", "n", "s", part.alias("part"))
    x, y = heads.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).alias("x"), heads.alias("y")
    in_order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")) & in_order & (F.col("x.n") >= F.col("y.n") * F.lit(least - 1e-9)))
    met = met.select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).distinct()
    left = sets.select(F.col("id").alias("i"), F.col("signs").alias("si"))
    right = sets.select(F.col("id").alias("j"), F.col("signs").alias("sj"))
    scored = met.join(left, "i").join(right, "j").withColumn("likeness", jaccard(F.col("si"), F.col("sj"), least))
    return scored.where(F.col("likeness") >= least - 1e-12).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "likeness")
