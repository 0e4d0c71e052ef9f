"""Document fingerprints by order MinHash (DataFrame functions only).

A text's k-mers of units are numbered by occurrence, so that repeats count, and each numbered k-mer is hashed. The hashes are
dealt to ``bins`` by their leading bits; in each bin the ``per_bin`` least stay, are put back in text order and hashed as a
tuple. Two texts agree in a bin only where the same k-mers come in the same order, so the likeness follows edit distance
rather than the set of words. One hash serves all bins, so a text costs two sorts of its k-mers. Tuple hashes have 32 bits: two
unlike tuples of a bin agree by chance once in 2^32.

Units are the words between white space. A word of more than ``LONG_WORD`` characters, as scripts without blanks, long
identifiers and minified code have, gives its overlapping runs of ``RUN`` characters instead, so an edit in it changes the
units around it alone.

Edge cases: a null text counts as empty; a text without words has the empty fingerprint, and two of those are alike (1); a
text of fewer units than ``k`` is one k-mer; texts of any length are read whole (past 2^24 units places wrap around, which
keeps equal texts equal). Documents are ordered by descending doc_id, then by a hash of the text; null ids come last. Rows that
repeat a doc_id with its text are one document, and get equal rows; a single document follows itself. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import Tables, let, materialise, partitions
from millrace.llm.text import SPACE, text_or_empty

K, PER_BIN, BIN_BITS = 2, 2, 6
LONG_WORD, RUN = 24, 4
#: Low bits of a packed number, which hold the place in the text.
_PLACE_BITS = 24
_PLACE, _HASH = (1 << _PLACE_BITS) - 1, (1 << 64 - _PLACE_BITS) - 1


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))


def _run_starts(values: Column, bits: int) -> Column:
    """Where the leading ``64 - bits`` bits change in a sorted array, from 0."""
    def changes(i: Column) -> Column:
        return (i == 0) | (F.shiftrightunsigned(F.get(values, i), bits) != F.shiftrightunsigned(F.get(values, i - 1), bits))

    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), changes)


def _kmers(words: Column, k: int) -> Column:
    """Packed (hash, place) of each k-mer."""
    one = lambda i: _packed(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), one)


def _numbered(kmers: Column) -> Column:
    """Packed (hash of k-mer and its occurrence number, place), from sorted packed k-mers."""

    def runs(starts: Column) -> Column:
        count = lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(kmers)) - s - 1)
        return F.flatten(F.transform(starts, count))

    def label(numbers: Column) -> Column:
        return F.transform(kmers, lambda x, i: _packed(F.xxhash64(F.shiftrightunsigned(x, _PLACE_BITS), F.get(numbers, i)), x))

    return let(let(_run_starts(kmers, _PLACE_BITS), runs), label)


def _tuples(values: Column, bin_bits: int, per_bin: int) -> Column:
    """One word of the fingerprint a bin that has k-mers: the bin's number and the hash of its tuple, in hex."""

    def words(starts: Column) -> Column:
        def word(s: Column, j: Column) -> Column:
            n = F.least(F.coalesce(F.get(starts, j + 1), F.size(values)) - s, F.lit(per_bin))
            swapped = F.transform(F.slice(values, s + 1, n), lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 64 - _PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS)))
            ordered = F.transform(F.sort_array(swapped), lambda x: x.bitwiseAND(F.lit(_HASH)))
            number = F.shiftrightunsigned(F.get(values, s), 64 - bin_bits)
            return F.concat(F.lpad(F.hex(number), 3, "0"), F.lpad(F.hex(F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

        return F.transform(starts, word)

    return let(_run_starts(values, 64 - bin_bits), words)


def units(text: Column) -> Column:
    """Words, long ones as their overlapping runs of characters."""

    def runs(word: Column) -> Column:
        chars = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
        return let(chars, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - RUN), lambda i: F.concat(*[F.get(c, i + j) for j in range(RUN)])))

    def cut(words: Column) -> Column:
        long = lambda w: F.length(w) > LONG_WORD
        return F.when(F.exists(words, long), F.flatten(F.transform(words, lambda w: F.when(long(w), runs(w)).otherwise(F.array(w))))).otherwise(words)

    return let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), cut)


def fingerprint(text: Column, k: int = K, bin_bits: int = BIN_BITS, per_bin: int = PER_BIN) -> Column:
    """The fingerprint of a non-null text: words of a bin's number and hash, joined by blanks."""

    def of(words: Column) -> Column:
        numbered = let(F.sort_array(_kmers(words, k)), lambda kmers: F.sort_array(_numbered(kmers)))
        made = F.array_join(F.array_sort(let(numbered, lambda v: _tuples(v, bin_bits, per_bin))), " ")
        return F.when(F.size(words) > 0, made).otherwise("")

    return let(units(text), of)


def likeness(a: Column, b: Column) -> Column:
    """The share of bins, of those that either fingerprint has, whose tuples agree: 0 to 1."""
    one, two = F.split(a, " "), F.split(b, " ")
    bins = lambda c: F.transform(c, lambda w: F.substring(w, 1, 3))
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(one, two)) / F.size(F.array_union(bins(one), bins(two))))


def neighbours(rows: DataFrame, order: list[str], carry: list[str], tables: Tables) -> DataFrame:
    """``order``, the same columns as ``next_...`` and ``carry`` as ``next_...``: each row of ``rows`` (distinct in ``order``) with
    the next in descending order, nulls last; the first follows the last.

    Meant for ids, not texts: rows are sorted into ranges, and the last of a range takes the first of the next one from a
    table of one row a range.
    """
    by = [F.col(c).desc_nulls_last() for c in order]
    columns = [*order, *carry]
    ranged = rows.select(*columns).repartitionByRange(partitions(rows.sparkSession), *by).withColumn("part", F.spark_partition_id())
    ranged = tables.write(ranged, "ranged", "snappy")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    found = ranged.withColumn("here", place).withColumn("then", F.lead(F.struct(*columns)).over(Window.partitionBy("part").orderBy(*by)))
    firsts = tables.write(found.where("here = 1").select("part", F.struct(*columns).alias("first")), "firsts", "snappy")
    around = Window.orderBy("part")  # one row a range
    after = F.coalesce(F.lead("first").over(around), F.first("first").over(around))
    firsts = firsts.select(F.col("part").alias("part_f"), after.alias("first"))
    made = found.join(firsts, F.col("part") == F.col("part_f")).withColumn("then", F.coalesce("then", "first"))
    return made.select(*columns, *[F.col(f"then.{c}").alias(f"next_{c}") for c in columns])


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first characters of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row a document."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_or_empty(F.col(text_col))).alias("fingerprint"))


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row a document.

    Which document follows which is found on ids alone. Then texts are dealt out by id once, and of each text as many first
    characters as the document before it replaces go to that one, with the fingerprint.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    named = rows.withColumn("digest", F.xxhash64("text"))
    ids = named.groupBy("doc_id", "digest").agg(F.floor(F.max(F.length("text")) / 2).cast("int").alias("half"), F.count("*").alias("rows"))
    with Tables(docs.sparkSession) as tables:
        links = materialise(neighbours(ids, ["doc_id", "digest"], ["half", "rows"], tables), "links", "snappy")
    # A text's name, by which texts and links are dealt out.
    key = lambda i, d: F.xxhash64(F.coalesce(i.cast("string"), F.lit("")), i.isNull(), d)
    same = lambda i, d, j, e: i.eqNullSafe(j) & (d == e)
    before = links.select(key(F.col("next_doc_id"), F.col("next_digest")).alias("k_l"), *[F.col(c).alias(f"{c}_l") for c in ("doc_id", "digest", "half", "next_doc_id", "next_digest")])
    keyed = named.withColumn("k", key(F.col("doc_id"), F.col("digest")))
    of = keyed.join(before, (F.col("k") == F.col("k_l")) & same(F.col("doc_id"), F.col("digest"), F.col("next_doc_id_l"), F.col("next_digest_l")))
    sent = of.select(
        key(F.col("doc_id_l"), F.col("digest_l")).alias("k_s"), F.col("doc_id_l").alias("doc_id_s"), F.col("digest_l").alias("digest_s"),
        F.substring(F.col("text"), F.lit(1), F.col("half_l")).alias("head"), fingerprint(F.col("text")).alias("next_fingerprint"),
    )
    if not links.where("rows > 1").isEmpty():
        sent = sent.dropDuplicates(["k_s", "doc_id_s", "digest_s"])
    both = keyed.join(sent, (F.col("k") == F.col("k_s")) & same(F.col("doc_id"), F.col("digest"), F.col("doc_id_s"), F.col("digest_s")))
    made = both.withColumns({"fingerprint": fingerprint(F.col("text")), "edited": edited(F.col("text"), F.col("head"))})
    made = made.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
