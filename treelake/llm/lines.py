"""Line dedup with DataFrame functions alone: hashes of lines in ranges, keep bitmaps of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ascii_lower, unused

#: What is stripped at both ends of a line: space, and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"
#: Lines in a word of a bitmap.
BITS = 64


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _copy(text: Column) -> Column:
    """Tells rows of one doc_id, or of none, apart by their text."""
    return F.xxhash64(_whole(text))


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, copy, pos): each line whose key has min_chars code points or more, by 128 bits of hash of its key."""
    text = _whole(F.col("text"))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))  # all ASCII: both agree, the first is faster
    once = docs.select("doc_id", _copy(F.col("text")).alias("copy"), F.split(low, "\n").alias("lines"))  # beside a generator these would be taken for each line anew
    lines = once.select("doc_id", "copy", F.posexplode("lines").alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    keyed = lines.select(key.alias("key"), "doc_id", "copy", "pos").where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "copy", "pos")


def line_bitmaps(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, copy, keep array<long>) of each document that loses lines: bit i % 64 of element i div 64 is 1 if line i stays.

    A bitmap ends with the last 64 lines of which one goes; all lines beyond it stay. A document is a
    (doc_id, text); equal rows are one. copy is a hash of the text, for `apply_bitmaps`.

    Hashes are dealt in ranges of (hash, document) and sorted by (hash, document, position), so a line that
    a third of all documents have covers as many ranges as its share, and each run of a document streams
    past once: its first occurrence counts. Counts of documents add up within tasks before they meet. Only
    hashes and positions are shuffled, never lines. Lines of keys in min_docs documents or more then become
    a bit each, and are folded to a word of 64 in their task before words of a document meet.
    """
    scratch = Scratch(spark, "lines")
    key, doc = ["h1", "h2"], ["doc_id", "copy"]
    ranged = line_occurrences(docs, min_chars).repartitionByRange(*key, *doc)
    first = F.row_number().over(Window.partitionBy(*key, *doc).orderBy("pos")) == 1
    lines = scratch.save(ranged.withColumn("first", first), "lines")
    common = scratch.save(lines.where("first").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(*key), "common")
    gone = lines.select(*key, *doc, "pos").join(common, key)  # Spark broadcasts the common ones if their files are small, and splits hot keys otherwise
    place = {"word": (F.col("pos") / BITS).cast("int"), "bit": F.expr(f"shiftleft(1L, pos % {BITS})")}
    words = gone.select(*doc, *[c.alias(n) for n, c in place.items()]).groupBy(*doc, "word").agg(F.expr("~bit_or(bit)").alias("keep"))
    sparse = words.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("word", "keep"))).alias("w"))  # 1 / 64 of a document's lines at most
    before = lambda i: F.when(i > 0, F.get("w", i - 1)["word"]).otherwise(-1)
    dense = F.flatten(F.transform("w", lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before(i) - 1), F.array(x["keep"]))))
    return sparse.select(*doc, dense.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the lines whose bit is 1, joined by a newline.

    Documents without a bitmap keep all lines. A column of docs called like one of these three is replaced;
    all others stay, whatever their names.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    old = [c for c in docs.columns if c.lower() not in new]
    own, copy, keep, id_ = (unused(docs, x) for x in ("own_copy", "copy", "keep", "of"))
    bitmaps = bitmaps.select(F.col("doc_id").alias(id_), F.col("copy").alias(copy), F.col("keep").alias(keep))
    keyed = docs.select(*old, _copy(F.col("text")).alias(own))
    same = [F.col("doc_id").eqNullSafe(F.col(id_)), F.col(own) == F.col(copy)]
    met = keyed.join(bitmaps, reduce(Column.__and__, same), "left")
    lines = F.split(_whole(F.col("text")), "\n")
    bit = lambda i: F.coalesce(F.getbit(F.get(keep, (i / BITS).cast("int")), i % BITS), F.lit(1))
    kept = F.when(F.col(keep).isNull(), lines).otherwise(F.filter(lines, lambda _, i: bit(i) == 1))
    return met.select(*old, F.size(lines).cast("long").alias(new[0]), (F.size(lines) - F.size(kept)).cast("long").alias(new[1]), F.array_join(kept, "\n").alias(new[2]))


def drop_common_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) with n_lines, n_dropped and kept_text, without the lines that min_docs documents or more have.

    A text is split at newlines; null and empty ones are one empty line. A line's key is the line without
    blanks at both ends, A-Z lower-cased. Keys of min_chars code points or more that min_docs documents
    hold lose all their lines everywhere; other lines stay as they are. Rows of equal doc_id and text are
    one document and all come back; rows of one doc_id with different texts are documents of their own, as
    are those without an id. Very long texts are read whole; an empty table gives an empty one.
    """
    return apply_bitmaps(docs, line_bitmaps(spark, docs.select("doc_id", "text"), min_docs, min_chars))
