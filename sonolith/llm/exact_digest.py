"""Document fingerprints: a canonical exact digest, in DataFrame and SQL functions alone.

Canonical form: Unicode NFKC, case folding, runs of white space as one space, none at the
ends. Normalising and folding are ICU's, which Spark ships, by the SQL function ``reflect``;
texts of ASCII characters alone, which both leave to ``lower``, do not call it. The
fingerprint is 128 bits wide: xxhash64 of the form under two seeds. Equal fingerprints are
one group only if the forms' bytes are equal: forms in a bucket of two documents or more are
grouped by their bytes (within partitions first, so a hot form moves once a partition), and
where a bucket has several, all but one get a third hash at the end of the fingerprint.

Defined results: a null text is an empty one, whose form is empty; a null id is kept and
comes after all others; repeated rows are each a document (in the order of their texts for
equal ids); an empty table gives an empty result; other columns are ignored, whatever
their names. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: The order of documents is cut into ranges of about PER_RANGE rows, at least RANGES of them, by approximate quantiles of the ids.
RANGES, PER_RANGE = 512, 200_000
#: Bits of the map that spares documents alone in their bucket a shuffle: half a megabyte.
SLOTS = 1 << 22


def canonical(text: Column) -> Column:
    """The form that equal documents share."""
    icu = lambda name, method, value, flag: F.call_function("reflect", F.lit(name), F.lit(method), value, F.lit(flag))
    nfkc = lambda value: icu("com.ibm.icu.text.Normalizer", "compose", value, True)
    folded = nfkc(icu("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text), True))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    wide = (F.xxhash64(form), F.xxhash64(F.lit(0x5EED), form))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in wide)))


def mark(form: Column) -> Column:
    """A third hash, to name a form whose fingerprint belongs to another one's bytes."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.lit(0xC0FFEE), form)), 16, "0"))


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the falling bounds lie above the value: halving, in one constant array."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = value >= F.get(known, mid)
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | low, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(~done & low, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halved, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, text, next_text: that of the document with the next smaller id; after the last comes the first.

    Documents are dealt by ranges of ids and ordered within them; a range's last document takes the first of
    the next range that has one. Ranges grow in number with the rows; the driver sees their bounds and numbers.
    """
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranges = ranges or max(RANGES, docs.count() // PER_RANGE)
    found = each.agg(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges - 1)], max(20_000, 4 * ranges))).first()[0]
    bounds = sorted({b for b in found or () if b is not None}, reverse=True)
    ranged = each.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_position(F.col("doc_id"), bounds)))
    # the largest id of each range, then the first text of that id: as many rows as ranges, but for repeated ids
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))
    filled = sorted(r.range for r in heads.select("range").collect())
    follows = each.sparkSession.createDataFrame([(a, b) for a, b in zip(filled, filled[1:] + filled[:1], strict=True)], "range int, following int")
    firsts = ranged.join(F.broadcast(heads), "range").where("doc_id <=> head").groupBy("range").agg(F.min("text").alias("following_text"))
    firsts = firsts.withColumnRenamed("range", "following").join(follows, "following").drop("following")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    led = ranged.withColumn("led", F.lead("text").over(order))
    return led.join(firsts, "range", "left").select("doc_id", "text", F.coalesce("led", "following_text").alias("next_text"))


def _shared_slots(each: DataFrame) -> DataFrame:
    """One row, ``bits``: SLOTS bits as longs, those set that hashes of fingerprints with two documents or more fall on."""
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(SLOTS))
    many = each.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.shiftright(slot, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    words = each.sparkSession.range(SLOTS // 64).join(many.groupBy("id").agg(F.bit_or("b").alias("b")), "id", "left")
    return words.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("w")).select(F.col("w.b").alias("bits"))


def clashes(docs: DataFrame, each: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, mark of forms that share a bucket with other bytes; the form of the least mark in the bucket keeps the plain fingerprint.

    ``each`` has the fingerprints of docs, written. Documents alone in their bucket mostly fall to a bitmap of fixed
    size before their forms move; the others' forms are grouped by their bytes, copies within a partition first.
    """
    bits = stored(_shared_slots(each), "shared-slots").scalar()
    hashed = docs.select(canonical(text_of(text_col)).alias("form")).select(digest(F.col("form")).alias("fingerprint"), "form")
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(SLOTS))
    word = F.element_at(bits, F.shiftright(slot, 6).cast("int") + 1)
    shared = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    forms = hashed.where(shared).groupBy("fingerprint", "form").agg(F.lit(1).alias("one")).select("fingerprint", mark(F.col("form")).alias("mark"))
    mixed = forms.groupBy("fingerprint").agg(F.min("mark").alias("plain"), F.count("*").alias("n")).where("n > 1")
    return forms.join(mixed, "fingerprint").where("mark <> plain").select("fingerprint", "mark").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: equal for equal canonical bytes and for nothing else."""
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(text_of(text_col)).alias("form")).select("doc_id", digest(F.col("form")).alias("fingerprint"), mark(F.col("form")).alias("mark"))
    each = stored(each, "fingerprints")
    return settled(each, clashes(docs, each, id_col, text_col)).drop("mark")


def settled(each: DataFrame, clash: DataFrame, name: str = "fingerprint", own_mark: str = "mark") -> DataFrame:
    """Forms whose bytes differ from their bucket's get their mark at the end of the fingerprint."""
    named = clash.select(F.col("fingerprint").alias(name), F.col("mark").alias(own_mark), F.lit(True).alias("apart"))
    return each.join(named, [name, own_mark], "left").withColumn(name, F.when(F.col("apart"), F.concat_ws("-", name, own_mark)).otherwise(F.col(name))).drop("apart")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = F.char_length("text")
    cut = F.floor(count / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), count - cut), F.substring("next_text", F.lit(1), cut))
    forms = with_next(docs).select("doc_id", count.cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"), canonical(F.col("next_text")).alias("next_form"), edited.alias("edited"))
    forms = forms.withColumn("edited_form", canonical(F.col("edited")))
    alike = lambda other: F.when(F.col("form") == F.col(other), 1.0).otherwise(0.0)
    each = stored(forms.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("form")).alias("fingerprint"), mark(F.col("form")).alias("mark"), digest(F.col("edited_form")).alias("edited_fingerprint"), mark(F.col("edited_form")).alias("edited_mark"), alike("edited_form").alias("near_edited"), alike("next_form").alias("near_next")), "fingerprints")
    clash = clashes(docs, each)
    # an edited text with a form of some document gets that form's name
    both = settled(settled(each, clash), clash, "edited_fingerprint", "edited_mark")
    return both.drop("mark", "edited_mark")
