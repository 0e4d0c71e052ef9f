"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text, stripped of white space, is cut where its own characters say so. Every chunk has a 128-bit identifier. The
dictionary of distinct chunks proves that no identifier stands for two chunk texts; if one does, identifiers are drawn
again with other salts. A document is then the ordered list of its chunks' verified identifiers, and documents are
equal when the lists are. Texts are shuffled once, as distinct chunks per task; only the lists are compared.

Edge cases: null text counts as empty; empty (and all-space) texts are one group; any length of text is cut into
chunks of at most ``max_chunk`` characters. Rows that repeat a doc_id with equal text get one decision each, and equal
ones; ``exact_dedup_rows`` leaves a single row of them. A doc_id with several texts is judged for each of them. A null doc_id sorts after all others, and ``exact_dedup_rows``
leaves rows with one alone. An empty table gives an empty result. Other columns of the input are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import let, materialise
from millrace.llm.text import text_or_empty, without_space

MIN_CHUNK, MAX_CHUNK = 256, 2048


def boundary_class(residue: int) -> str:
    """Regex class of characters, about one in 16 of any script: up to Thai, and of kana, those that leave ``residue`` modulo 16; of
    the large scripts above, those whose code's middle half-byte is ``residue``. Other scripts are only tried past Latin-1."""
    single = lambda lo, hi: "".join(f"\\u{c:04x}" for c in range(lo, hi) if c % 16 == residue)
    runs = "".join(f"\\u{c + 16 * residue:04x}-\\u{c + 16 * residue + 15:04x}" for lo, hi in ((0x4E00, 0xA000), (0xAC00, 0xD700)) for c in range(lo, hi, 0x100))
    return f"[{single(0x21, 0x100)}[\\u0100-\\uffff&&[{single(0x100, 0xF00)}{single(0x3000, 0x3100)}{runs}]]]"


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> str:
    """A chunk ends after the first pair of boundary characters past ``min_chunk``, or at ``max_chunk`` characters."""
    pair, rest = boundary_class(5) + boundary_class(4), max_chunk - min_chunk
    return f"(?s).{{{min_chunk}}}(?:.{{0,{rest - 2}}}?{pair}|.{{0,{rest}}})|.{{1,{min_chunk}}}"


def chunks(normalised: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(normalised, F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0))


def chunk_id(chunk: Column, salt: int) -> list[Column]:
    """Two independently salted 64-bit hashes."""
    return [F.xxhash64(F.lit(2 * salt), chunk), F.xxhash64(F.lit(2 * salt + 1), chunk)]


def chunk_dictionary(docs: DataFrame, text_col: str, salt: int, **sizes: int) -> DataFrame:
    """Distinct chunks: id_1, id_2, chunk. One row for each chunk text."""
    found = docs.select(F.explode(chunks(without_space(text_or_empty(F.col(text_col))), **sizes)).alias("chunk"))
    one, two = chunk_id(F.col("chunk"), salt)
    return found.distinct().select(one.alias("id_1"), two.alias("id_2"), "chunk")


def verified_salt(docs: DataFrame, text_col: str, **sizes: int) -> int:
    """The first salt under which no identifier stands for two different chunk texts."""
    salt = 0
    while True:
        ids = chunk_dictionary(docs, text_col, salt, **sizes).groupBy("id_1", "id_2").agg(F.count("*").alias("texts"))
        if ids.where("texts > 1").isEmpty():
            return salt
        salt += 1


def recipes(docs: DataFrame, id_col: str, text_col: str, salt: int, **sizes: int) -> DataFrame:
    """_id, _chars (code points of the original), text_sha256, recipe (identifiers in order)."""

    def row(norm: Column) -> Column:
        ids = F.flatten(F.transform(chunks(norm, **sizes), lambda c: F.array(*chunk_id(c, salt))))
        return F.struct(F.sha2(norm.cast("binary"), 256).alias("text_sha256"), ids.alias("recipe"))

    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_chars"), let(without_space(text), row).alias("_r"))
    return rows.select("_id", "_chars", "_r.text_sha256", "_r.recipe")


def _decide(made: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    groups = made.groupBy("recipe").agg(best.alias("_best"), F.count("*").alias("group_size"))
    # The join key is made after the grouping, so both sides are dealt out anew and a hot group's rows can be split.
    digest = F.sha2(F.col("recipe").cast("string"), 256)
    left = made.withColumn("_key", digest)
    right = groups.select(digest.alias("_key"), F.col("recipe").alias("_recipe"), "_best", "group_size")
    same = (F.col("_key") == F.col("_key_g")) & (F.col("recipe") == F.col("_recipe"))
    return left.join(right.withColumnRenamed("_key", "_key_g"), same).select(
        F.col("_id").alias("doc_id"), F.col("_best.i").alias("keep_id"), "group_size", F.col("_id").eqNullSafe(F.col("_best.i")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points in the original stays, then the smallest doc_id.
    """
    return _decide(recipes(docs, id_col, text_col, verified_salt(docs, text_col, **sizes), **sizes))


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Texts don't move: the ids that go are taken away. Only rows of an
    id that stands in several are told apart by their texts."""
    judged = materialise(exact_dedup(docs, id_col, text_col, **sizes), "judged")
    key = docs[id_col]
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    again = judged.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    if again.isEmpty():
        return docs.join(gone, key == gone["_gone"], "left_anti")
    alone = docs.join(again, key == again["_again"], "left_anti").join(gone, key == gone["_gone"], "left_anti")
    digest = F.sha2(without_space(text_or_empty(F.col(text_col))).cast("binary"), 256)
    several = docs.join(again, key == again["_again"], "left_semi").withColumn("_text_sha256_", digest)
    stay = judged.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha256")).distinct()
    single = several.join(stay, (key == stay["_kept"]) & (several["_text_sha256_"] == stay["_kept_sha256"]), "left_semi").dropDuplicates([id_col, "_text_sha256_"])
    return alone.unionByName(single.drop("_text_sha256_"))
