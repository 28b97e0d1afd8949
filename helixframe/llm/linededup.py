"""Line dedup: which lines many documents share, returned as compressed keep bitmaps.

Everything is a column expression. Line hashes are written once and dealt by range with documents as the secondary order,
so that a line that a third of all documents hold spreads over many tasks; a window over (hash, document) streams the first
occurrences, and only these are counted. The most frequent of the common lines then go to where the hashes are. Texts move
once, to meet their bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import checkpoint, free_name, join_spread, parts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "\t\n\x0b\x0c\r "


def split_lines(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at either end, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_BLANK))
    # Lower-casing is the faster way, but only on ASCII is it that of A-Z alone.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, version, pos, h, g``: two hashes of the key of every line that counts, written once."""
    keys = F.transform(split_lines(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("second"), k).alias("g"), (F.length(k) >= min_chars).alias("long")))
    return checkpoint(docs.select("id", "version", F.posexplode(hashed).alias("pos", "line")).where("line.long").select("id", "version", "pos", "line.h", "line.g"))


def drop_bitmaps(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """``id, version, words``: for each document that loses lines a map from word number to the 64 bits of lost lines.

    Words without a lost line aren't stored.
    """
    lines = line_hashes(docs, min_chars)
    place = F.struct("id", "version", "pos")
    within = Window.partitionBy("h", "g", "id").orderBy("version", "pos")
    firsts = lines.repartitionByRange(parts(docs), "h", "g", "id").withColumn("nth", F.row_number().over(within)).where("nth = 1")
    common = checkpoint(firsts.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") >= min_docs))
    shared = join_spread(lines, common, ["h", "g"], "n")
    if keep_first:
        shared = shared.where(~place.eqNullSafe(F.col("first")))
    words = shared.groupBy("id", "version", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(F.lit(63)))).alias("bits"))
    return words.groupBy("id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def is_dropped(words: Column, pos: Column) -> Column:
    bits = F.coalesce(F.try_element_at(words, F.shiftright(pos, 6)), F.lit(0).cast("bigint"))
    return F.getbit(bits, pos.bitwiseAND(F.lit(63))) == 1


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ld_lines`` (lines before), ``ld_dropped``, and ``ld_kept`` (the kept lines' text).

    A line goes if its key has at least ``min_chars`` code points and at least ``min_docs`` documents hold it; with
    ``keep_first`` its first place in the document with the smallest id stays. Null and empty texts are one empty line and
    come back as ''; a text all of whose lines go comes back as '' too. A null id is an id of its own, the smallest. Rows with
    the same id count as one document but each keeps its own lines. An empty table gives an empty result. A new column whose
    name ``docs`` has already gets underscores after it; the new columns are the last three in any case.
    """
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    bitmaps = drop_bitmaps(row.select("id", "version", "text"), min_docs, min_chars, keep_first)
    bitmaps = bitmaps.select(F.col("id").alias("b_id"), F.col("version").alias("b_version"), "words")
    joined = row.join(bitmaps, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("version") == F.col("b_version")), "left")
    lines = split_lines(F.col("text"))
    kept = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: ~is_dropped(F.col("words"), i)), "\n"))
    dropped = F.coalesce(F.aggregate(F.map_values("words"), F.lit(0).cast("bigint"), lambda a, b: a + F.bit_count(b)), F.lit(0).cast("bigint"))
    new = {"ld_lines": F.size(lines).cast("bigint"), "ld_dropped": dropped, "ld_kept": kept}
    # Two steps, for the row may have columns of any of the names above.
    return joined.select("row", *[c.alias(n) for n, c in new.items()]).select("row.*", *[F.col(n).alias(free_name(docs, n)) for n in new])
