"""File trees: (tree keys..., path, length, sha256), compared by path, content, name and place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corestrata.operators.arrow import each_row
from corestrata.operators.metrics import running_total

#: Names that carry a version: a stem that ends with an underscore, and four numbers.
VERSIONED = r"^(?:(.*)/)?([A-Za-z0-9][A-Za-z0-9_.+-]{0,127}_)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\.dll$"
LEAST, MOST, POOL = 65_536, 64 << 20, 8
_REFERENCE_HEADER = 9
#: Bytes of the concatenation where files and the ranges to be read meet.
READ_BUCKET = 1 << 20


def offsets(files: DataFrame, keys: list[str]) -> DataFrame:
    """Each file's place in the concatenation of all files in the order of their paths' bytes."""
    return running_total(files, keys, F.encode("path", "UTF-8"), "length", "off")


def read_ranges(placed: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (range_id, start, size) of the concatenation as pieces of files: (keys..., range_id, path, file_off, length).

    Files and ranges meet by buckets of the concatenation, so that a tree of many files isn't held against all of its ranges; a piece counts in the bucket where it begins.
    """
    touched = lambda first, end: F.explode(F.sequence(F.floor(first / READ_BUCKET), F.floor((end - 1) / READ_BUCKET)))
    files = placed.where("length > 0").select(*keys, "path", "off", (F.col("off") + F.col("length")).alias("end"))
    files = files.select("*", touched(F.col("off"), F.col("end")).alias("bucket"))
    wanted = ranges.where("size > 0").select(*keys, "range_id", "start", (F.col("start") + F.col("size")).alias("stop"))
    wanted = wanted.select("*", touched(F.col("start"), F.col("stop")).alias("bucket"))
    low, high = F.greatest("off", "start"), F.least("end", "stop")
    hit = files.join(wanted, [*keys, "bucket"]).where((low < high) & (F.floor(low / READ_BUCKET) == F.col("bucket")))
    return hit.select(*keys, "range_id", "path", (low - F.col("off")).alias("file_off"), (high - low).alias("length"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each path of either tree as added, removed, changed or unchanged."""
    a = old.select(*keys, "path", F.col("length").alias("old_length"), F.col("sha256").alias("old_sha"))
    b = new.select(*keys, "path", F.col("length").alias("new_length"), F.col("sha256").alias("new_sha"))
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("changed")
    return a.join(b, [*keys, "path"], "full").select(*keys, "path", "old_length", "new_length", status.alias("status"))


def exact_moves(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Added paths whose content an old path has: the source of the shortest path, then the first; record_bytes is what the mapping costs, and strict tells that no old path with that content is still there. Mappings that cost as much as the file are left out."""
    size = lambda c: F.octet_length(F.encode(c, "UTF-8"))
    added = new.join(old.select(*keys, "path"), [*keys, "path"], "left_anti").select(*keys, F.col("path").alias("target_path"), "length", "sha256")
    still = new.select(*keys, "path").withColumn("still", F.lit(True))
    source = old.join(still, [*keys, "path"], "left").groupBy(*keys, "length", "sha256").agg(F.min(F.struct(size("path").alias("n"), F.encode("path", "UTF-8").alias("b"), F.col("path").alias("p"))).alias("best"), F.max(F.coalesce("still", F.lit(False))).alias("any_still"))
    out = added.join(source, [*keys, "length", "sha256"])
    cost = 4 + size("target_path") + 4 + size("best.p") + 8 + 32
    return out.select(*keys, "target_path", F.col("best.p").alias("source_path"), "length", cost.cast("long").alias("record_bytes"), (~F.col("any_still")).alias("strict"), (F.col("length") > cost).alias("mapped"))


def move_census(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair of trees: added files, candidates, strict moves, mapped ones, and bytes saved net of the mapping."""
    moves = exact_moves(old, new, keys)
    added = new.join(old.select(*keys, "path"), [*keys, "path"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("added"), F.sum("length").alias("added_bytes"))
    pick = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    told = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("strict").alias("strict_moves"), F.count_if("mapped").alias("m"), pick(F.col("mapped"), F.col("length")).alias("mb"), pick(F.col("mapped"), F.col("record_bytes")).alias("rb"))
    worth = F.col("mb") > F.col("rb") + _REFERENCE_HEADER
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return added.join(told, keys, "left").select(
        *keys, "added", "added_bytes", zero(F.col("candidates")).alias("candidates"), zero(F.col("strict_moves")).alias("strict_moves"), (zero(F.col("candidates")) - zero(F.col("strict_moves"))).alias("copies_or_ambiguous"),
        zero(F.when(worth, F.col("m"))).alias("mapped"), zero(F.when(worth, F.col("mb"))).alias("mapped_bytes"), zero(F.when(worth, F.col("rb") + _REFERENCE_HEADER)).alias("map_bytes"), zero(F.when(worth, F.col("mb") - F.col("rb") - _REFERENCE_HEADER)).alias("net_saved"),
    )


def signature(files: DataFrame) -> DataFrame:
    """Adds parent, stem and version (array of numbers) where a path carries a version; else nulls. Numbers beyond 31 bits don't count."""
    part = lambda i: F.regexp_extract("path", VERSIONED, i)
    numbers = F.transform(F.split(part(3), r"\."), lambda x: F.try_to_number(x, F.lit("9" * 30)).cast("decimal(38,0)"))
    fine = F.col("path").rlike(VERSIONED) & F.forall(numbers, lambda x: x.isNotNull() & (x <= 2_147_483_647))
    return files.select("*", F.when(fine, part(1)).alias("parent"), F.when(fine, part(2)).alias("stem"), F.when(fine, F.transform(numbers, lambda x: x.cast("long"))).alias("version"))


def rename_pairs(old: DataFrame, new: DataFrame, keys: list[str], least: int = LEAST, most: int = MOST, pool: int = POOL) -> DataFrame:
    """Each added path with the one removed path that it renames, or the reason for which there is none.

    Same directory and stem, lower version, other content, sizes within bounds and a factor of two, unique in
    both directions. Directories and stems with more than pool removed files are told apart, not searched.
    """
    gone = signature(old.join(new.select(*keys, "path"), [*keys, "path"], "left_anti")).where(F.col("stem").isNotNull() & F.col("length").between(least, most))
    come = signature(new.join(old.select(*keys, "path"), [*keys, "path"], "left_anti"))
    on = [*keys, "parent", "stem"]
    sizes = gone.groupBy(*on).agg(F.count(F.lit(1)).alias("in_pool"))
    source = gone.join(sizes.where(F.col("in_pool") <= pool), on, "left_semi").select(*on, F.col("path").alias("source_path"), F.col("length").alias("source_length"), F.col("sha256").alias("source_sha"), F.col("version").alias("source_version"))
    target = come.join(sizes, on, "left")
    able = F.col("stem").isNotNull() & F.col("length").between(least, most)
    pairs = target.where(able).join(source, on).where((F.col("source_version") < F.col("version")) & (F.col("source_sha") != F.col("sha256")) & (F.greatest("length", "source_length") <= 2 * F.least("length", "source_length")))
    per_target = pairs.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("matches"), F.min("source_path").alias("source_path"))
    claims = per_target.where("matches = 1").groupBy(*keys, "source_path").agg(F.count(F.lit(1)).alias("claims"))
    out = target.join(per_target, [*keys, "path"], "left").join(claims, [*keys, "source_path"], "left")
    reason = (
        F.when(F.col("stem").isNull(), "nonversioned_filename")
        .when(~F.col("length").between(least, most), "target_size_out_of_bounds")
        .when(F.coalesce("in_pool", F.lit(0)) > pool, "source_pool_limit")
        .when(F.col("matches").isNull(), "no_unique_structural_source")
        .when(F.col("matches") > 1, "ambiguous_source_candidates")
        .when(F.col("claims") > 1, "source_claimed_by_multiple_targets")
        .otherwise("paired")
    )
    return out.select(*keys, F.col("path").alias("target_path"), reason.alias("outcome"), F.when(reason == "paired", F.col("source_path")).alias("source_path"))


def path_fault(path: Column) -> Column:
    """Null for a portable path, else what is wrong with it."""
    parts = F.split(path, "/", -1)
    device = F.exists(parts, lambda s: F.upper(F.split(s, r"\.", -1)[0]).rlike("^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$"))
    return (
        F.when(path.isNull() | (F.length(path) == 0) | (F.length(path) > 4096), "length")
        .when(F.exists(parts, lambda s: (s == "") | (s == ".") | (s == "..") | F.endswith(s, F.lit(".")) | F.endswith(s, F.lit(" ")) | (F.length(s) > 255)), "component")
        .when(~path.rlike("^[A-Za-z0-9._/-]*$"), "character")
        .when(device, "device")
    )


def faults(entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries: (keys..., path, kind, link). Rows that make the tree invalid: unportable paths, paths equal but for case, parents that are missing or no directories, links to nothing or to links."""
    w = Window.partitionBy(*keys, F.lower("path"))
    parent = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    rows = entries.withColumn("twins", F.count(F.lit(1)).over(w)).withColumn("parent", parent).withColumn("resolved", F.when(F.col("kind") == "symlink", F.concat_ws("/", parent, "link")))
    up = entries.select(*keys, F.col("path").alias("parent"), F.col("kind").alias("parent_kind"))
    to = entries.select(*keys, F.col("path").alias("resolved"), F.col("kind").alias("link_kind"))
    seen = rows.join(up, [*keys, "parent"], "left").join(to, [*keys, "resolved"], "left")
    fault = F.coalesce(
        F.concat(F.lit("path_"), path_fault(F.col("path"))),
        F.when(F.col("twins") > 1, "case_collision"),
        F.when(F.col("parent").isNotNull() & (F.coalesce("parent_kind", F.lit("")) != "directory"), "parent"),
        F.when((F.col("kind") == "symlink") & (F.coalesce("link_kind", F.lit("symlink")) == "symlink"), "link"),
    )
    return seen.withColumn("fault", fault).where("fault is not null").select(*keys, "path", "fault")


def chunk_overlap(placed: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: chunks of the concatenation that lie within it and those that cross its edges, and their bytes there.

    Files are met by buckets of the concatenation, as wide as the largest chunk: a chunk lies in its own bucket and
    at most the next, a file in all that it touches.
    """
    width = 1 << 12
    whole = placed.select(*keys, "path", "off", (F.col("off") + F.col("length")).alias("end"), "length").where("length > 0")
    f = whole.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("off") / width), F.floor((F.col("end") - 1) / width))))
    c = chunks.select(*keys, F.col("off").alias("c_off"), (F.col("off") + F.col("len")).alias("c_end")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("c_off") / width), F.floor((F.col("c_end") - 1) / width))))
    low, high = F.greatest("off", "c_off"), F.least("end", "c_end")
    hit = f.join(c, [*keys, "bucket"]).where((F.col("c_off") < F.col("end")) & (F.col("c_end") > F.col("off")) & (F.floor(low / width) == F.col("bucket")))
    inside = (F.col("c_off") >= F.col("off")) & (F.col("c_end") <= F.col("end"))
    return hit.groupBy(*keys, "path", "length").agg(F.count_if(inside).alias("contained"), F.coalesce(F.sum(F.when(inside, high - low)), F.lit(0)).cast("long").alias("contained_bytes"), F.count_if(~inside).alias("crossing"), F.coalesce(F.sum(F.when(~inside, high - low)), F.lit(0)).cast("long").alias("crossing_bytes"))


def preserved(old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair of concatenations: old chunks found again at the same offset, anywhere, and not at all."""
    here = new_chunks.select(*keys, "id", "off").distinct().withColumn("here", F.lit(True))
    there = new_chunks.select(*keys, "id").distinct().withColumn("there", F.lit(True))
    seen = old_chunks.join(here, [*keys, "id", "off"], "left").join(there, [*keys, "id"], "left")
    return seen.groupBy(*keys).agg(F.count_if(F.col("here").isNotNull()).alias("same_place"), F.count_if(F.col("here").isNull() & F.col("there").isNotNull()).alias("moved"), F.count_if(F.col("there").isNull()).alias("gone"))


def file_reuse(old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per file of the new tree (chunks carry path): bytes found in the old file of that path, and anywhere in the old tree."""
    same = old_chunks.select(*keys, "path", "id").distinct().withColumn("same", F.lit(True))
    whole = old_chunks.select(*keys, "id").distinct().withColumn("whole", F.lit(True))
    seen = new_chunks.join(same, [*keys, "path", "id"], "left").join(whole, [*keys, "id"], "left")
    add = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("len"))), F.lit(0)).cast("long")
    return seen.groupBy(*keys, "path").agg(F.sum("len").alias("bytes"), add("same").alias("same_path_bytes"), add("whole").alias("whole_tree_bytes"))


def alignment(base: DataFrame, target: DataFrame, base_content: DataFrame, keys: list[str]) -> DataFrame:
    """Each target chunk (with payload) as EXACT_WHOLE_AT_CDC_BOUNDARY, EXACT_WHOLE_ONLY_UNALIGNED or NO_WHOLE_EXACT_BYTES: a base chunk, elsewhere in the base's bytes, or nowhere in them.

    Chunks that are no base chunk gather by content and are looked for there together, so that a base is read once.
    """
    ids = base.select(*keys, "id").distinct().withColumn("aligned", F.lit(True))
    seen = target.join(ids, [*keys, "id"], "left")
    rest = seen.where("aligned is null").groupBy(*keys).agg(F.collect_list(F.struct("idx", "len", "payload")).alias("rest"))
    schema = pa.schema([("idx", pa.int64()), ("len", pa.int64()), ("inside", pa.bool_())])
    looked = each_row(rest.join(base_content.select(*keys, "bytes"), keys, "left"), keys, ["rest", "bytes"], "idx long, len long, inside boolean", schema, lambda some, raw: [(c["idx"], c["len"], raw is not None and c["payload"] in raw) for c in some])
    whole = seen.where("aligned").select(*keys, "idx", "len", F.lit("EXACT_WHOLE_AT_CDC_BOUNDARY").alias("alignment"))
    return whole.unionByName(looked.select(*keys, "idx", "len", F.when(F.col("inside"), "EXACT_WHOLE_ONLY_UNALIGNED").otherwise("NO_WHOLE_EXACT_BYTES").alias("alignment")))
