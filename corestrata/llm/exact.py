"""Exact dedup with two Bloom passes, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import spool, unspool

#: Cells of the filter for a row, to a power of two; with two probes about one single text in 70 passes wrongly, which costs only its shuffle.
CELLS_A_ROW = 16
#: Bits of one bitmap of Spark's bitmap functions.
MAP_BITS = 32768
#: A filter of more bytes than this is joined by bitmap number instead of broadcast; a table of rows to drop beyond it is met by a filter of so many bytes at most.
BROADCAST_BYTES = 64 << 20
#: Bytes of a key in a broadcast table, with what Spark adds.
KEY_BYTES = 96


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8"), 256))


def row_key(id_col: Column, digest: Column) -> Column:
    """A digest that stands for a row's doc_id and text together; rows that repeat both share it."""
    return F.unhex(F.sha2(F.encode(F.concat_ws(":", F.hex(digest), id_col.cast("string")), "UTF-8"), 256))


def cells(digest: Column, bits: int, probes: int = 2) -> list[Column]:
    """Probes from disjoint bits of a SHA-256."""
    return [F.conv(F.hex(F.substring(digest, 1 + 8 * i, 7)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1) for i in range(probes)]


def bitmaps(hit: DataFrame) -> DataFrame:
    """Spark's bitmaps of cells (cell long): bucket numbers and maps."""
    return hit.groupBy(F.bitmap_bucket_number(F.col("cell")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell"))).alias("_map"))


def _repeated_cells(hashes: DataFrame, bits: int) -> DataFrame:
    """First pass: bitmaps of the cells that two rows or more hit. Only cell numbers are counted, pre-aggregated in each task."""
    return bitmaps(hashes.select(F.explode(F.array(*cells(F.col("_digest"), bits))).alias("cell")).groupBy("cell").count().where("count > 1"))


def _bit(cell: Column, bitmap: Column) -> Column:
    """Bit of Spark's bitmap: bucket numbers and bit positions as bitmap_bucket_number and bitmap_bit_position give them."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def marked(rows: DataFrame, digest: str, maps: DataFrame, bits: int, probes: int, small: bool) -> DataFrame:
    """rows plus _maybe: whether the bitmaps have all cells of the digest."""
    if small:
        maps = F.broadcast(maps)
    out = rows
    for i, cell in enumerate(cells(F.col(digest), bits, probes)):
        own = maps.select(F.col("_bucket").alias(f"_b{i}"), F.col("_map").alias(f"_m{i}"))
        out = out.join(own, F.bitmap_bucket_number(cell) == F.col(f"_b{i}"), "left").withColumn(f"_h{i}", _bit(cell, F.col(f"_m{i}"))).drop(f"_b{i}", f"_m{i}")
    hits = [F.col(f"_h{i}") for i in range(probes)]
    return out.withColumn("_maybe", hits[0] if probes == 1 else hits[0] & hits[1]).drop(*(f"_h{i}" for i in range(probes)))


def possible_repeats(rows: DataFrame, bits: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Second pass: rows (with _digest) plus _maybe, true where both cells of the digest were hit twice or more."""
    return marked(rows, "_digest", _repeated_cells(rows.select("_digest"), bits), bits, 2, (1 << bits) // 8 <= broadcast_bytes)


def _passes(docs: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written rows (_id, _digest, _row); the same plus _maybe, for possible repeats; and (_digest, keep_id, keep_row, group_size) of the former.

    The texts are read and digested once; both passes go over the written digests. _row tells repeated rows apart.
    """
    rows = spool(docs.select(F.col(f"`{id_col}`").alias("_id"), text_digest(text_col).alias("_digest")).withColumn("_row", F.monotonically_increasing_id()), "digests")
    bits = max(15, (max(1, rows.count()) * CELLS_A_ROW - 1).bit_length())
    seen = possible_repeats(rows, bits, broadcast_bytes)
    # Written first: the join then has nothing but two exchanges below it, so that adaptive execution may split a group that holds a large share of the rows.
    first = F.max(F.struct(F.col("_id"), (-F.col("_row")).alias("back")))
    groups = seen.where("_maybe").groupBy("_digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows, seen, spool(groups.select("_digest", F.col("first._id").alias("keep_id"), (-F.col("first.back")).alias("keep_row"), "group_size"), "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical (compared by SHA-256), null counting as empty; whole texts of any
    length are digested. Of equal texts the row of the largest doc_id is kept; of rows that tie for it (they
    repeat doc_id and text) one is. A text that occurs once keeps itself and, unless the filter errs, its digest
    meets no other. Repeated rows count in group_size. Null doc_ids are chosen only where a group has no other,
    with a null keep_id. Empty tables give empty results. Further columns are not read, whatever they are called.
    """
    _, seen, groups = _passes(docs, id_col, text_col, broadcast_bytes)
    alone = seen.where("not _maybe").select("_id", "_digest", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = seen.where("_maybe").select("_id", "_digest", "_row").join(groups, "_digest").select("_id", "_digest", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"))
    return alone.unionByName(maybe).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def _split(docs: DataFrame, keys: DataFrame, key: Column, broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows of docs as (_own struct, _key) that may be in keys (_gone binary, distinct, written), those that cannot, and keys as they are to be joined.

    keys is counted. Up to broadcast_bytes it is broadcast, no text moves, and there is no second part. Beyond, a
    filter of at most broadcast_bytes is: rows that it doesn't know make the second part, and only others shuffle.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"), key.alias("_key"))
    n = keys.count()
    if n * KEY_BYTES <= broadcast_bytes:
        return own, None, F.broadcast(keys)
    bits = max(15, min((n * CELLS_A_ROW - 1).bit_length(), (broadcast_bytes * 8).bit_length() - 1))
    seen = marked(own, "_key", bitmaps(keys.select(cells(F.col("_gone"), bits, 1)[0].alias("cell"))), bits, 1, True)
    return seen.where("_maybe"), seen.where("not _maybe"), keys


def without(docs: DataFrame, gone: DataFrame, key: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs whose key (of SHA-256 digests) isn't in gone (_gone binary, distinct, written)."""
    maybe, through, gone = _split(docs, gone, key, broadcast_bytes)
    out = maybe.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("_own.*")
    return out if through is None else through.select("_own.*").unionByName(out)


def only(docs: DataFrame, keys: DataFrame, key: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_own struct, _key) of the rows of docs whose key (of SHA-256 digests) is in keys (_gone binary, distinct, written)."""
    maybe, _, keys = _split(docs, keys, key, broadcast_bytes)
    return maybe.join(keys, F.col("_key") == F.col("_gone"), "left_semi")


def one_of_each(docs: DataFrame, keys: DataFrame, key: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row of docs for each of keys, of those that share a key. Only such rows shuffle."""
    return only(docs, keys, key, broadcast_bytes).groupBy("_key").agg(F.first("_own").alias("_own")).select("_own.*")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row of each text, with all columns of docs: that of the largest doc_id, as exact_groups() has it; of rows that repeat doc_id and text any one.

    Nulls, empty and long texts, ties, repeated rows and empty tables as there. Columns may have any names.
    """
    rows, seen, groups = _passes(docs, id_col, text_col, broadcast_bytes)
    pairs = seen.where("_maybe").groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("n")).join(groups.where("group_size > 1"), "_digest")
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    named = pairs.where(~stays | (F.col("n") > 1)).select(row_key(F.col("_id"), F.col("_digest")).alias("_gone"), stays.alias("stays"))
    gone = spool(named, "gone")
    unspool(groups)
    unspool(rows)
    return one_of_gone(docs, gone, id_col, text_col, broadcast_bytes)


def one_of_gone(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """docs without the rows that gone names (_gone as row_key(), stays boolean; written), but with one of each that stays."""
    key = row_key(F.col(f"`{id_col}`"), text_digest(text_col))
    out = without(docs, gone.select("_gone"), key, broadcast_bytes)
    twins = gone.where("stays").select("_gone")
    return out if twins.isEmpty() else out.unionByName(one_of_each(docs, twins, key, broadcast_bytes))
