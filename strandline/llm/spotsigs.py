"""Operator 9: document fingerprints by SpotSigs, in DataFrame functions alone.

Common words are anchors. The CHAIN content words that follow an anchor, up to the third anchor after it, form a signature; a
document's fingerprint is the set of its signatures' 32-bit hashes. Fingerprints are likened by Jaccard; for a threshold t two sets
of a and b signatures can only reach it if min(a, b) >= t * max(a, b), so sets are partitioned by length and compared within a
partition and with the next one, and only if they share one of their first signatures, the rarest of all classes first: a signature
that many share is only looked up by classes that have hardly any other.

Where no anchor is among the FAR words before a word, the chain of CHAIN words that starts there, or of as many as the text
has before its first anchor, is a signature as well: an anchor more or less changes signatures next to it only. Texts of up to FEW_WORDS words also have chains of characters, of which
each word more takes a part away, by their hashes.
Results: null texts count as empty; an empty text has the empty fingerprint, which is like itself (1) and nothing else (0).
Equal texts have equal fingerprints. A document that is alone is its own next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.neighbours import with_next
from strandline.llm.shared import shared_folder, written

#: Words of a chain; words after an anchor at which no other chains start; most words to have chains of characters; characters of those.
CHAIN, FAR, FEW_WORDS, CHARACTERS = 3, 8, 6, 4
#: Anchors: common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "a an and are as at be by for from had has have he in is it not of on or she that the this to was were with you "
    "aber auch auf aus bei das dem den der des die ein eine einer es für im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce ces dans de du elle en est et il je la le les mais ne ou par pas pour que qui sa se ses son sur un une "
    "al como con del el ella ese esta este las lo los más mi no para pero por se si sin su sus una y"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def _hashed(chain: Column) -> Column:
    return F.xxhash64(chain).cast("string")


def _int(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(1 << 32)) - F.lit(1 << 31)


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column `name`, the sorted distinct signatures of the column `text`."""
    own, at = f"_{name}_words", f"_{name}_parts"
    marked = F.transform(own, lambda w: F.when(w.isin(ANCHORS), F.lit("|")).otherwise(w))
    df = df.withColumn(own, words(F.coalesce(F.col(text), F.lit(""))))
    # the stretches between anchors; the first comes before any anchor
    df = df.withColumn(at, F.transform(F.split(F.array_join(marked, " "), "\\|"), lambda s: F.filter(F.split(s, " "), lambda w: w != "")))
    df = df.withColumn(f"_{name}_letters", F.when(F.size(own) <= FEW_WORDS, F.split(F.array_join(own, " "), "")))
    n, letters = F.size(at), F.col(f"_{name}_letters")
    none = F.lit([]).cast("array<bigint>")
    # elements are taken one by one: slicing a long array copies it, once for each of its elements
    part = lambda i: F.coalesce(F.get(F.col(at), i), F.lit([]).cast("array<string>"))
    chain = lambda i: _int(F.xxhash64(F.lit("anchor"), F.slice(F.concat(part(i), part(i + 1), part(i + 2)), 1, CHAIN)))
    anchored = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), chain)).otherwise(none)
    run = lambda kind, of, k: lambda i: _int(F.xxhash64(F.lit(kind), *(F.get(of, i + j) for j in range(k))))

    def apart(stretch: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(FAR)
        return F.when(F.size(stretch) > start, F.transform(F.sequence(start, F.greatest(start, F.size(stretch) - CHAIN)), run("word", stretch, CHAIN))).otherwise(none)

    each = F.flatten(F.transform(at, apart))
    spelt = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(letters) - CHARACTERS)), run("letters", letters, CHARACTERS))
    spelt = F.when(F.size(own).between(1, FEW_WORDS), F.filter(spelt, lambda s: F.pmod(s, F.lit(FEW_WORDS)) >= F.size(own) - 1)).otherwise(none)
    return df.withColumn(name, F.array_sort(F.array_distinct(F.concat(anchored, each, spelt))).cast("array<int>")).drop(own, at, f"_{name}_letters")


def fingerprint(signatures: Column) -> Column:
    """Eight hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("bigint") + F.lit(1 << 31)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets, 0 where their sizes alone keep it below `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", ["text", "sigs"], lambda df: with_signatures(df, "text", "sigs"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited", "sigs", "next_sigs")
    rows = with_signatures(rows, "edited", "new")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("new")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_classes(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id: the smallest id of its fingerprint) and the pairs (a, b, likeness) of classes that reach the
    threshold. Copies meet in one aggregation; documents without signatures are in no class."""
    rows = with_signatures(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "sigs").select("doc_id", "sigs")
    # a table, as a filter on signatures would be pushed into their own computation
    rows = written(rows, shared_folder(docs.sparkSession), "signatures").where(F.size("sigs") > 0)
    rows = rows.select("doc_id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("of"))
    classes = rows.groupBy("of").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))
    members = rows.select("doc_id", "of").join(classes.select("of", "class_id"), "of").select("doc_id", "class_id")
    each = classes.select("class_id", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count(F.lit(1)).alias("classes"))
    ranked = each.join(rarity, "sig").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("classes", "sig"))).alias("ranked"))
    n = F.size("ranked")
    part = F.floor(F.log(n.cast("double")) / math.log(1 / threshold))
    prefix = F.slice("ranked", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    left = ranked.select("class_id", n.alias("n"), part.alias("part"), F.explode(F.transform(prefix, lambda x: x["sig"])).alias("sig"))
    right = left.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("at"), "sig").withColumn("part", F.explode(F.array(F.col("at"), F.col("at") + 1, F.col("at") - 1)))
    pairs = left.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "part", "sig").join(right, ["part", "sig"]).where("a < b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    side = lambda c: classes.select(F.col("class_id").alias(c), F.col("sigs").alias(f"sigs_{c}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b"), threshold).alias("likeness"))
    return members, found.where(F.col("likeness") >= threshold)
