"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of words (runs without ASCII white space), and the edit distance counts inserted, deleted and
replaced words. Every line with a chance to have a neighbour emits its variants with one word deleted as hashed keys;
equal keys bring together lines at one edit: two variants with the same place for a replacement, a variant and a whole
line for an insertion or deletion. Only the earliest line of a key is a candidate, so a key gives one pair a line, however many lines it
has. The pairs are verified on their words.

A line has a chance if it shares a half with another: one edit leaves at least half of the longer line untouched at its
start or at its end. This prunes most variants and loses none that could join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.llm.tables import keyed, stored

#: Shorter lines are compared exactly: one edit would change too much of them.
MIN_WORDS = 8

_PLACE = ["doc_id", "row_key", "line"]


def _words(line) -> F.Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _half(words: F.Column, extra: int) -> F.Column:
    """Keys of the first and last half of the words, for partners whose longer line has size + extra words."""
    longer = F.size(words) + extra
    keep = F.floor(longer / 2).cast("int")
    return F.array(
        F.xxhash64(F.lit("first"), longer, F.slice(words, 1, keep)),
        F.xxhash64(F.lit("last"), longer, F.slice(words, F.size(words) - keep + 1, keep)),
    )


def _one_edit(a: F.Column, b: F.Column) -> F.Column:
    """Whether two word arrays are one edit apart at most."""
    def agreeing(x, y):
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(first == 0, F.greatest(F.size(x), F.size(y))).otherwise(first - 1)

    return agreeing(a, b) + agreeing(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_lines(kinds: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(h, g) of distinct lines that have an earlier line at one edit. kinds: h, g, n, halves, place."""
    long = kinds.filter(F.col("n") >= min_words)
    halves = long.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high").select("half")
    chance = halves.join(shared, "half").select("h").distinct()
    wanted = long.join(chance, "h").groupBy("place.doc_id", "place.row_key").agg(F.collect_list(F.struct("h", "g", "place")).alias("wanted"))
    chosen = (
        docs.join(wanted, ["doc_id", "row_key"])
        .select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
        .select("w.h", "w.g", "w.place", _words(F.element_at("all", F.col("w.place.line") + 1)).alias("words"))
    )
    chosen = stored(chosen, "chosen-lines")
    size = F.size("words")
    word = chosen.select("h", "g", "place", size.alias("n"), F.posexplode("words").alias("i", "word"))
    word = word.select("h", "g", "place", "n", "i", F.xxhash64("i", "word").alias("at"), F.xxhash64(F.col("i") - 1, "word").alias("shifted"))
    line = Window.partitionBy("h", "g")
    through = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hashed = word.select(
        "h", "g", "place", "n", "i", "at", "shifted",
        F.bit_xor("at").over(through).alias("head"), F.bit_xor("shifted").over(through).alias("head_shifted"), F.bit_xor("shifted").over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_shifted"),
    )
    variant = F.col("head").bitwiseXOR(F.col("at")).bitwiseXOR(F.col("head_shifted")).bitwiseXOR(F.col("all_shifted"))
    keys = hashed.select(
        "h", "g", "place", "n", "i",
        F.explode(
            F.when(F.col("i") == F.col("n") - 1, F.array(F.struct(F.lit(False).alias("deleted"), F.xxhash64("n", "head").alias("key")), F.struct(F.lit(True).alias("deleted"), F.xxhash64(F.col("n") - 1, variant).alias("key"))))
            .otherwise(F.array(F.struct(F.lit(True).alias("deleted"), F.xxhash64(F.col("n") - 1, variant).alias("key"))))
        ).alias("v"),
    ).select("h", "g", "place", "i", "v.deleted", "v.key").repartition("key")
    met = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high").select("key")
    keys = stored(keys.join(met, "key"), "met-variants")
    who = F.struct("place", "h", "g")
    replaced = keys.filter("deleted").groupBy("key", "i").agg(F.min(who).alias("least"))
    removed = keys.groupBy("key", "deleted").agg(F.min(who).alias("least")).withColumn("deleted", ~F.col("deleted"))
    pairs = keys.filter("deleted").join(replaced, ["key", "i"]).unionByName(keys.join(removed, ["key", "deleted"]))
    pairs = pairs.filter(F.col("least.place") < F.col("place")).select("h", "g", F.col("least.h").alias("h2"), F.col("least.g").alias("g2")).distinct()
    own, other = chosen.select("h", "g", "words"), chosen.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("words").alias("words2"))
    return pairs.join(own, ["h", "g"]).join(other, ["h2", "g2"]).filter(_one_edit(F.col("words"), F.col("words2"))).select("h", "g").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row_key, gone): the lines (from 0) of each text that an earlier line equals or nearly equals. docs: keyed()."""
    words = _words(F.col("text"))
    lines = docs.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line", "text")).select(*_PLACE, words.alias("words")).filter(F.size("words") > 0)
    halves = F.when(F.size("words") >= min_words, F.array_distinct(F.concat(_half(F.col("words"), 0), _half(F.col("words"), 1))))
    lines = stored(lines.select(*_PLACE, F.xxhash64("words").alias("h"), F.hash("words").alias("g"), F.size("words").alias("n"), halves.alias("halves")), "lines")
    kinds = lines.groupBy("h", "g").agg(F.min(F.struct(F.struct(*_PLACE).alias("place"), "n", "halves")).alias("m"))
    kinds = stored(kinds.select("h", "g", "m.n", "m.halves", "m.place"), "line-kinds")
    near = near_lines(kinds, docs, min_words).withColumn("near", F.lit(True))
    judged = kinds.select("h", "g", F.col("place").alias("first")).join(near, ["h", "g"], "left")
    gone = lines.select(*_PLACE, "h", "g").join(judged, ["h", "g"]).filter((F.struct(*_PLACE) != F.col("first")) | F.coalesce("near", F.lit(False)))
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set("line").alias("gone"))


def drop_repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with the lines left in text, and n_lines and n_removed added in place of columns of these names.

    A line goes if an earlier line of any text equals it word for word, or is one word edit away and both have at least
    min_words words. Earlier means a smaller (doc_id, line), on the input; null ids come first. Lines without words stay.
    Rows that repeat an id and a text keep the same lines. A null text stays null, with no lines. Rows all of whose lines
    go keep an empty text. Other columns pass through.
    """
    docs = keyed(documents)
    gone = repeated_lines(docs, min_words)
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    same = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = documents.select(*names).withColumns({"_doc": same, "_row": F.xxhash64(same, F.coalesce("text", F.lit("")))})
    joined = rows.join(gone.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"), F.col("gone").alias("_gone")), ["_doc", "_row"], "left")
    joined = joined.withColumn("_all", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.element_at("_all", i + 1)), "\n")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
