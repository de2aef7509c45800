"""The registered queries on chunks, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corestrata.functions import fixed
from corestrata.functions.profiles import SMALL, STABLE, Profile, gear_table, lab_profile
from corestrata.operators import accounting, candidates, chunking, envelopes, families, identity, incremental, lab, metrics, mutations, patches, policies, reuse, trees
from corestrata.plans import base
from corestrata.plans.base import PAIR, SQL_DOCUMENT_CHUNKS, SQL_DOCUMENTS, SQL_HISTORIES, SQL_TREES, sql_chunks, sql_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison by value."""
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Chunking


@query(f"WITH {SQL_DOCUMENTS}, {sql_chunks('k', 'd', 'content_id', 1024)} SELECT * FROM k")
def chunk_fixed(spark, sf_dir):
    return chunking.fixed_chunks(base.documents(spark, sf_dir).drop("family"), 1024)


def cdc_sql(p: Profile, contents: str = "SELECT doc_id AS content_id, encode(coalesce(text, '')) AS b FROM documents") -> str:
    """Content-defined cutting of contents (content_id, b) in SQL: one step of recursion for each chunk, a fold over its bytes with 128-bit integers."""
    gear = ", ".join(f"{int(g)}::HUGEINT" for g in gear_table())
    begin = 0 if p.warm else p.minimum
    return f"""WITH RECURSIVE gear AS (SELECT [{gear}] AS g),
    d AS MATERIALIZED (SELECT content_id, b, hex(b) AS hx FROM ({contents})),
    gv AS MATERIALIZED (SELECT content_id, b, octet_length(b) AS n, list_transform(range(0, octet_length(b)), lambda i: g[1 + ('0x' || substr(hx, 2 * i + 1, 2))::INT]) AS h FROM d, gear),
    c AS (
        SELECT content_id, -1::BIGINT AS idx, 0::BIGINT AS off, 0::BIGINT AS len FROM gv
        UNION ALL
        SELECT content_id, idx + 1, off, CASE WHEN rest <= {p.minimum} THEN rest WHEN r.cut >= 0 THEN r.cut ELSE least(rest, {p.maximum}) END
        FROM (SELECT c.content_id, c.idx, c.off + c.len AS off, n - c.off - c.len AS rest,
              list_reduce(list_prepend({{'h': 0::HUGEINT, 'i': {begin}::BIGINT, 'cut': -1::BIGINT, 'g': 0::HUGEINT}},
                list_transform(h[c.off + c.len + {begin + 1} : least(n, c.off + c.len + {p.maximum})], lambda x: {{'h': 0::HUGEINT, 'i': 0::BIGINT, 'cut': -1::BIGINT, 'g': x}})),
                lambda a, e: CASE WHEN a.cut >= 0 THEN a ELSE {{
                    'h': (a.h * 2 + e.g) & 18446744073709551615::HUGEINT, 'i': a.i + 1,
                    'cut': CASE WHEN a.i >= {p.minimum} AND (((a.h * 2 + e.g) & 18446744073709551615::HUGEINT) & (CASE WHEN a.i < {p.target} THEN {p.strict}::HUGEINT ELSE {p.relaxed}::HUGEINT END)) = 0 THEN a.i ELSE -1::BIGINT END,
                    'g': 0::HUGEINT}} END) AS r
              FROM c JOIN gv USING (content_id) WHERE c.off + c.len < n))
    SELECT c.content_id, c.idx, c.off, c.len, sha256(b[c.off + 1 : c.off + c.len]) AS id FROM c JOIN gv USING (content_id) WHERE idx >= 0"""


WARM = Profile(64, 256, 1024, True)


@query(cdc_sql(SMALL))
def chunk_cdc(spark, sf_dir):
    return chunking.cdc_chunks(base.documents(spark, sf_dir).drop("family"), SMALL)


@query(cdc_sql(WARM))
def chunk_cdc_warmed(spark, sf_dir):
    return chunking.cdc_chunks(base.documents(spark, sf_dir).drop("family"), WARM)


@query()
def chunk_blake3(spark, sf_dir):
    return chunking.cdc_chunks(base.documents(spark, sf_dir).drop("family"), lab_profile(4096), fixed.BLAKE3_SUITE)


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, idx, len, CAST(sum(len) OVER (PARTITION BY content_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS off FROM k")
def chunk_offsets(spark, sf_dir):
    records = chunking.records(base.document_chunks(spark, sf_dir), ["content_id"])
    return chunking.with_offsets(records, ["content_id"]).select("content_id", "idx", "len", "off")


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, row_number() OVER (PARTITION BY content_id ORDER BY off) - 1 AS idx, off FROM k")
def chunk_index(spark, sf_dir):
    return chunking.with_index(base.document_chunks(spark, sf_dir).drop("idx"), ["content_id"]).select("content_id", "idx", "off")


@query(
    f"""WITH {SQL_DOCUMENT_CHUNKS}, x AS (SELECT content_id, idx, CASE WHEN content_id % 5 = 1 AND idx = 1 THEN off + 1 ELSE off END AS said, CASE WHEN content_id % 7 = 2 AND idx = 2 THEN 0 ELSE len END AS len FROM k)
    SELECT * FROM (SELECT content_id, idx, said, CAST(sum(len) OVER (PARTITION BY content_id ORDER BY idx) - len AS BIGINT) AS off, len FROM x) WHERE len <= 0 OR said <> off"""
)
def chunk_guards(spark, sf_dir):
    """Tables in which some offsets were moved and some lengths lost."""
    some = lambda n, r, i: (F.col("content_id") % n == r) & (F.col("idx") == i)
    chunks = base.document_chunks(spark, sf_dir).withColumn("off", F.col("off") + some(5, 1, 1).cast("int")).withColumn("len", F.when(some(7, 2, 2), 0).otherwise(F.col("len")))
    return chunking.broken(chunks, ["content_id"])


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, idx, off + len AS boundary FROM k WHERE idx < (SELECT max(idx) FROM k AS x WHERE x.content_id = k.content_id)")
def interior_boundaries(spark, sf_dir):
    return chunking.interior(base.document_chunks(spark, sf_dir), ["content_id"]).select("content_id", "idx", (F.col("off") + F.col("len")).alias("boundary"))


# Measures


@query(
    f"""WITH {SQL_DOCUMENT_CHUNKS} SELECT family, count(*) AS chunks, round(avg(len), 6) AS mean_bytes, round(avg(len) / 256, 6) AS mean_to_target, round(stddev_pop(len), 6) AS deviation,
    round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(len) END, 6) AS sample_deviation, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(len) END / avg(len), 6) AS variation, min(len) AS least, max(len) AS greatest FROM k GROUP BY family"""
)
def chunk_size_stats(spark, sf_dir):
    return rounded(metrics.size_stats(base.document_chunks(spark, sf_dir), ["family"], 256))


@query(
    f"""WITH {SQL_DOCUMENTS}, s AS (SELECT family, octet_length(b) AS len FROM d) SELECT family, CAST(quantile_disc(len, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(len, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(len, 0.99) AS BIGINT) AS p99,
    CAST(max(len) AS BIGINT) AS max, round(quantile_cont(len::DOUBLE, 0.5), 6) AS median, round(quantile_cont(len::DOUBLE, 0.95), 6) AS p95_linear FROM s GROUP BY family"""
)
def content_percentiles(spark, sf_dir):
    sizes = base.documents(spark, sf_dir).select("family", F.octet_length("bytes").cast("long").alias("len"))
    return rounded(metrics.percentiles(sizes, ["family"]))


_CDC_FAMILIES = f"k AS MATERIALIZED ({cdc_sql(SMALL)}), f AS (SELECT source AS family, k.* FROM k JOIN documents ON doc_id = content_id)"


@query(
    f"""WITH {_CDC_FAMILIES} SELECT family, CAST(quantile_disc(len, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(len, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(len, 0.99) AS BIGINT) AS p99,
    CAST(max(len) AS BIGINT) AS max, round(quantile_cont(len::DOUBLE, 0.5), 6) AS median, round(quantile_cont(len::DOUBLE, 0.95), 6) AS p95_linear FROM f GROUP BY family"""
)
def chunk_percentiles(spark, sf_dir):
    return rounded(metrics.percentiles(chunking.cdc_chunks(base.documents(spark, sf_dir), SMALL), ["family"]))


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT family, round(avg(CASE WHEN len = 256 THEN 1 ELSE 0 END), 6) AS max_cut_rate, round(avg(CASE WHEN len >= 230.4 AND len < 256 THEN 1 ELSE 0 END), 6) AS near_max_rate FROM k GROUP BY family")
def max_cut_rate(spark, sf_dir):
    return rounded(metrics.cut_rates(base.document_chunks(spark, sf_dir), ["family"], 256))


@query(f"WITH {_CDC_FAMILIES} SELECT family, count(*) FILTER (len >= {SMALL.minimum} AND len < {SMALL.minimum} + 63) AS transient_cuts, count(*) AS chunks FROM f GROUP BY family")
def transient_cuts(spark, sf_dir):
    return metrics.transient_cuts(chunking.cdc_chunks(base.documents(spark, sf_dir), SMALL), ["family"], SMALL.minimum)


@query(f"WITH {SQL_DOCUMENT_CHUNKS}, u AS (SELECT family, id, count(*) AS n, min(len) AS len FROM k GROUP BY ALL) SELECT family, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * len) AS BIGINT) AS bytes, CAST(sum(len) AS BIGINT) AS distinct_bytes FROM u GROUP BY family")
def dedup_summary(spark, sf_dir):
    return metrics.dedup_summary(base.document_chunks(spark, sf_dir), ["family"])


@query(f"WITH {SQL_DOCUMENT_CHUNKS}, u AS (SELECT id, count(*) AS times, min(len) AS len FROM k GROUP BY id) SELECT id, times, len, (times - 1) * len AS saved_bytes FROM u ORDER BY saved_bytes DESC, id LIMIT 100")
def top_duplicate_chunks(spark, sf_dir):
    return metrics.most_repeated(base.document_chunks(spark, sf_dir), 100)


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT family, round(count(*) / (sum(len) / 1073741824.0), 6) AS chunks_per_gib, round(36 * count(*) / (sum(len) / 1073741824.0), 6) AS manifest_per_gib FROM k GROUP BY family")
def manifest_density(spark, sf_dir):
    return rounded(metrics.manifest_density(base.document_chunks(spark, sf_dir), ["family"]))


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT family, p::INT AS pack_mib, round(p * 1048576.0 / avg(len), 6) AS chunks_per_pack FROM k, (VALUES (16), (32), (64), (128)) AS t(p) GROUP BY family, p")
def pack_projection(spark, sf_dir):
    return rounded(metrics.pack_projection(base.document_chunks(spark, sf_dir), ["family"]))


# Reuse


@query(f"WITH {sql_pairs()} SELECT family, version, idx, len, id FROM target t WHERE EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id)")
def reuse_semi(spark, sf_dir):
    return reuse.reused(*base.pair_chunks(spark, sf_dir), PAIR).select(*PAIR, "idx", "len", "id")


@query(f"WITH {sql_pairs()} SELECT family, version, idx, len, id FROM target t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id)")
def missing_anti(spark, sf_dir):
    return reuse.missing(*base.pair_chunks(spark, sf_dir), PAIR).select(*PAIR, "idx", "len", "id")


PLAN_SQL = """f AS (SELECT t.*, EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id) AS known, row_number() OVER (PARTITION BY family, version, id ORDER BY idx) AS r FROM target t),
    plan AS (SELECT family, version, count(*) AS target_chunks, CAST(sum(len) AS BIGINT) AS target_bytes, count(*) FILTER (known) AS reused_chunks, CAST(coalesce(sum(len) FILTER (known), 0) AS BIGINT) AS reused_bytes,
    count(*) FILTER (NOT known) AS missing_chunks, CAST(coalesce(sum(len) FILTER (NOT known), 0) AS BIGINT) AS missing_bytes, count(*) FILTER (NOT known AND r = 1) AS unique_missing_chunks,
    CAST(coalesce(sum(len) FILTER (NOT known AND r = 1), 0) AS BIGINT) AS unique_missing_bytes FROM f GROUP BY family, version)"""


@query(f"WITH {sql_pairs()}, {PLAN_SQL} SELECT * FROM plan")
def reuse_plan(spark, sf_dir):
    return reuse.plan(*base.pair_chunks(spark, sf_dir), PAIR)


@query(f"WITH {sql_pairs()}, {PLAN_SQL} SELECT family, version, round(reused_bytes / target_bytes, 6) AS reuse_ratio, round(unique_missing_bytes / target_bytes, 6) AS missing_ratio, round(CASE WHEN target_bytes = unique_missing_bytes THEN 0 ELSE unique_missing_bytes / (target_bytes - unique_missing_bytes) END, 6) AS amplification FROM plan")
def reuse_ratios(spark, sf_dir):
    planned = reuse.plan(*base.pair_chunks(spark, sf_dir), PAIR).withColumn("changed", F.col("target_bytes") - F.col("unique_missing_bytes"))
    return rounded(reuse.ratios(planned, "changed").select(*PAIR, "reuse_ratio", "missing_ratio", "amplification"))


@query(f"WITH {sql_pairs()}, {PLAN_SQL} SELECT family, version, id, idx, len FROM f WHERE NOT known AND r = 1")
def unique_missing(spark, sf_dir):
    return reuse.first_occurrences(reuse.missing(*base.pair_chunks(spark, sf_dir), PAIR), PAIR).select(*PAIR, "id", "idx", "len")


def _payload(base_chunks: DataFrame, target: DataFrame) -> DataFrame:
    """Entries as a raw patch would have them."""
    return reuse.first_occurrences(reuse.missing(base_chunks, target, PAIR), PAIR).select(*PAIR, "id", F.col("len").alias("stored_len"), F.lit(0).alias("encoding"), F.lit(0).alias("dict_count"))


@query(
    f"""WITH {sql_pairs()}, pay AS (SELECT DISTINCT family, version, id FROM target t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id)),
    fb AS (SELECT family, version, id, arg_min(off, idx) AS base_off FROM base GROUP BY ALL)
    SELECT family, version, t.idx, CASE WHEN pay.id IS NOT NULL THEN 'payload' ELSE 'base' END AS source, fb.base_off FROM target t LEFT JOIN pay USING (family, version, id) LEFT JOIN fb USING (family, version, id)"""
)
def apply_sources(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    return reuse.locate(b, t, _payload(b, t), PAIR).select(*PAIR, "idx", "source", "base_off")


@query(f"WITH {sql_pairs()}, {PLAN_SQL} SELECT family, version, reused_chunks > 0 AS outside, false AS named, reused_chunks > 0 AS depends FROM plan")
def base_dependence(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    return reuse.depends_on_base(t, _payload(b, t), PAIR)


@query(
    f"""WITH {sql_pairs()}, pay AS (SELECT family, version, id, CASE WHEN version % 2 = 0 THEN len ELSE len + 1 END AS stored_len, 0 AS encoding FROM target WHERE idx % 3 = 0 UNION ALL SELECT family, version, sha256(id), len, 0 FROM target WHERE idx = 1),
    t AS (SELECT family, version, id, arg_min(len, idx) AS len FROM target GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY family, version, id) AS times FROM pay)
    SELECT family, version, CAST(bit_or((CASE WHEN times > 1 THEN 8 ELSE 0 END) | (CASE WHEN t.id IS NULL THEN 16 ELSE 0 END) | (CASE WHEN stored_len <> t.len THEN 32 ELSE 0 END)) AS BIGINT) AS flags FROM c LEFT JOIN t USING (family, version, id) GROUP BY family, version"""
)
def payload_check_flags(spark, sf_dir):
    _, t = base.pair_chunks(spark, sf_dir)
    damaged = t.where("idx % 3 = 0").select(*PAIR, "id", F.expr("CASE WHEN version % 2 = 0 THEN len ELSE len + 1 END").alias("stored_len"), F.lit(0).alias("encoding"))
    foreign = t.where("idx = 1").select(*PAIR, F.sha2("id", 256).alias("id"), F.col("len").alias("stored_len"), F.lit(0).alias("encoding"))
    return reuse.payload_flags(t, damaged.unionByName(foreign), PAIR)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {sql_pairs(s, s)} SELECT {s} AS lane, (SELECT count(DISTINCT id) FROM base) AS base_ids, (SELECT count(DISTINCT id) FROM target) AS target_ids, (SELECT count(DISTINCT id) FROM target WHERE id IN (SELECT id FROM base)) AS shared_ids, (SELECT CAST(sum(len) AS BIGINT) FROM target WHERE id IN (SELECT id FROM base)) AS reused_bytes)"
        for s in (64, 128)
    )
)
def profile_sensitivity(spark, sf_dir):
    lanes = [base.pair_chunks(spark, sf_dir, s) for s in (64, 128)]
    b, t = (x[0].withColumn("lane", F.lit(64)).unionByName(x[1].withColumn("lane", F.lit(128))) for x in zip(*lanes, strict=True))
    return reuse.id_sets(b, t, ["lane"])


# Boundaries


PAIRS_SQL = "p{0} AS (SELECT * FROM (SELECT family, version, idx, lag(id) OVER w AS left_id, lag(len) OVER w AS left_len, id AS right_id, len AS right_len FROM {1} WINDOW w AS (PARTITION BY family, version ORDER BY idx)) WHERE left_id IS NOT NULL)"


@query(f"WITH {sql_pairs()}, {PAIRS_SQL.format('t', 'target')} SELECT * FROM pt")
def boundary_pairs(spark, sf_dir):
    return metrics.boundary_pairs(base.pair_chunks(spark, sf_dir)[1], PAIR)


SURVIVAL_SQL = f"""{PAIRS_SQL.format('b', 'base')}, {PAIRS_SQL.format('t', 'target')},
    ca AS (SELECT family, version, left_id, left_len, right_id, right_len, count(*) AS a FROM pb GROUP BY ALL), cb AS (SELECT family, version, left_id, left_len, right_id, right_len, count(*) AS b FROM pt GROUP BY ALL),
    sv AS (SELECT family, version, CAST(sum(a) AS BIGINT) AS boundaries, CAST(sum(least(a, coalesce(b, 0))) AS BIGINT) AS survived FROM ca LEFT JOIN cb USING (family, version, left_id, left_len, right_id, right_len) GROUP BY ALL),
    survival AS (SELECT family, version, coalesce(boundaries, 0) AS boundaries, coalesce(survived, 0) AS survived, coalesce(survived / boundaries, 1.0) AS survival FROM (SELECT family, version FROM base UNION SELECT family, version FROM target) LEFT JOIN sv USING (family, version))"""


@query(f"WITH {sql_pairs()}, {SURVIVAL_SQL} SELECT family, version, boundaries, survived, round(survival, 6) AS survival FROM survival")
def boundary_survival(spark, sf_dir):
    return rounded(metrics.boundary_survival(*base.pair_chunks(spark, sf_dir), PAIR))


@query(
    f"""WITH {sql_pairs(64, 96)}, eb AS (SELECT DISTINCT family, version, off + len AS e FROM base b WHERE idx < (SELECT max(idx) FROM base x WHERE x.family = b.family AND x.version = b.version)),
    et AS (SELECT DISTINCT family, version, off + len AS e FROM target b WHERE idx < (SELECT max(idx) FROM target x WHERE x.family = b.family AND x.version = b.version)),
    a AS (SELECT family, version, count(*) AS l FROM eb GROUP BY ALL), b2 AS (SELECT family, version, count(*) AS r FROM et GROUP BY ALL), s AS (SELECT family, version, count(*) AS m FROM eb JOIN et USING (family, version, e) GROUP BY ALL)
    SELECT family, version, coalesce(l, 0) AS left_boundaries, coalesce(r, 0) AS right_boundaries, coalesce(m, 0) AS shared, round(CASE WHEN greatest(coalesce(l, 0), coalesce(r, 0)) = 0 THEN 1 ELSE coalesce(m, 0) / greatest(coalesce(l, 0), coalesce(r, 0)) END, 6) AS agreement
    FROM (SELECT family, version FROM base UNION SELECT family, version FROM target) LEFT JOIN a USING (family, version) LEFT JOIN b2 USING (family, version) LEFT JOIN s USING (family, version)"""
)
def boundary_agreement(spark, sf_dir):
    return rounded(metrics.boundary_agreement(*base.pair_chunks(spark, sf_dir, 64, 96), PAIR))


def _insertion(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the same with 256 bytes put in after the first hundred (or at the end), and the edits."""
    content = base.documents(spark, sf_dir).drop("family")
    at = F.least(F.lit(100), F.octet_length("bytes"))
    target = content.select("content_id", mutations.inserted(at, b"x" * 256).alias("bytes"))
    edits = content.select("content_id", (at + 256).cast("long").alias("affected_end"), F.lit(256).cast("long").alias("changed_bytes"))
    return chunking.fixed_chunks(content, 256), chunking.fixed_chunks(target, 256), edits


INSERT_SQL = f"""{SQL_DOCUMENTS}, e AS MATERIALIZED (SELECT content_id, least(100, octet_length(b)) AS pos, b FROM d), m AS MATERIALIZED (SELECT content_id, pos + 256 AS affected_end, b[1:pos] || encode(repeat('x', 256)) || b[pos + 1:octet_length(b)] AS b FROM e),
    {sql_chunks('ks', 'd', 'content_id', 256)}, {sql_chunks('kt', 'm', 'content_id', 256)},
    rs AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY idx DESC) AS r FROM ks), rt AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY idx DESC) AS r FROM kt),
    q AS (SELECT rt.content_id, rt.idx, rt.off, min(CASE WHEN coalesce(rs.id = rt.id AND rs.len = rt.len, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rt.content_id ORDER BY rt.r ROWS UNBOUNDED PRECEDING) AS eq FROM rt LEFT JOIN rs USING (content_id, r)),
    hit AS (SELECT q.content_id, min(q.off) AS met FROM q JOIN m USING (content_id) WHERE eq = 1 AND idx >= 1 AND off >= affected_end GROUP BY q.content_id),
    res AS (SELECT m.content_id, CASE WHEN affected_end < octet_length(b) THEN met - affected_end END AS distance, CASE WHEN affected_end >= octet_length(b) THEN 'not-applicable' WHEN met IS NULL THEN 'not-resynchronized' ELSE 'resynchronized' END AS status FROM m LEFT JOIN hit USING (content_id))"""


@query(f"WITH {INSERT_SQL} SELECT content_id, CAST(distance AS BIGINT) AS distance, status FROM res")
def resync_distance(spark, sf_dir):
    return metrics.resynchronization(*_insertion(spark, sf_dir), ["content_id"])


@query(
    f"""WITH {INSERT_SQL}, g AS (SELECT family, res.* FROM res JOIN d USING (content_id)) SELECT family, count(*) FILTER (status <> 'not-applicable') AS applicable, count(*) FILTER (status = 'resynchronized') AS resynchronized,
    round(CASE WHEN count(*) FILTER (status <> 'not-applicable') = 0 THEN NULL ELSE count(*) FILTER (status = 'resynchronized') / count(*) FILTER (status <> 'not-applicable') END, 6) AS coverage,
    CAST(quantile_disc(distance, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(distance, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(distance, 0.99) AS BIGINT) AS p99, CAST(max(distance) AS BIGINT) AS max FROM g GROUP BY family"""
)
def resync_summary(spark, sf_dir):
    found = metrics.resynchronization(*_insertion(spark, sf_dir), ["content_id"])
    return rounded(families.resync_summary(found.join(base.documents(spark, sf_dir).drop("bytes"), "content_id"), ["family"]))


_INSERTED = "SELECT doc_id AS content_id, b[1:least(100, octet_length(b))] || encode(repeat('x', 255)) || b[least(100, octet_length(b)) + 1:octet_length(b)] AS b FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)"


@query(
    f"""WITH m AS MATERIALIZED ({_INSERTED}), ks AS MATERIALIZED ({cdc_sql(SMALL)}), kt AS MATERIALIZED ({cdc_sql(SMALL, _INSERTED)}), e AS (SELECT m.content_id, octet_length(b) AS n, least(100, octet_length(b) - 255) + 255 AS affected_end FROM m),
    rs AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY idx DESC) AS r FROM ks), rt AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY idx DESC) AS r FROM kt),
    q AS (SELECT rt.content_id, rt.idx, rt.off, min(CASE WHEN coalesce(rs.id = rt.id AND rs.len = rt.len, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rt.content_id ORDER BY rt.r ROWS UNBOUNDED PRECEDING) AS eq FROM rt LEFT JOIN rs USING (content_id, r)),
    hit AS (SELECT content_id, min(off) AS met FROM q JOIN e USING (content_id) WHERE eq = 1 AND idx >= 1 AND off >= affected_end GROUP BY content_id),
    g AS (SELECT source AS family, CASE WHEN affected_end < n THEN met - affected_end END AS distance, CASE WHEN affected_end >= n THEN 'not-applicable' WHEN met IS NULL THEN 'not-resynchronized' ELSE 'resynchronized' END AS status FROM e JOIN documents ON doc_id = content_id LEFT JOIN hit USING (content_id))
    SELECT family, count(*) FILTER (status <> 'not-applicable') AS applicable, count(*) FILTER (status = 'resynchronized') AS resynchronized, round(CASE WHEN count(*) FILTER (status <> 'not-applicable') = 0 THEN NULL ELSE count(*) FILTER (status = 'resynchronized') / count(*) FILTER (status <> 'not-applicable') END, 6) AS coverage,
    CAST(quantile_disc(distance, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(distance, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(distance, 0.99) AS BIGINT) AS p99, CAST(max(distance) AS BIGINT) AS max FROM g GROUP BY family"""
)
def resync_cdc(spark, sf_dir):
    """The same edit under content-defined chunks, which do meet again."""
    content = base.documents(spark, sf_dir)
    at = F.least(F.lit(100), F.octet_length("bytes"))
    target = content.select("content_id", "family", mutations.inserted(at, b"x" * 255).alias("bytes"))
    edits = content.select("content_id", (at + 255).cast("long").alias("affected_end"), F.lit(255).cast("long").alias("changed_bytes"))
    cut = lambda c: chunking.cdc_chunks(c.drop("family"), SMALL)
    found = metrics.resynchronization(cut(content), cut(target), edits, ["content_id"])
    return rounded(families.resync_summary(found.join(content.drop("bytes"), "content_id"), ["family"]))


RANGES_SQL = f"WITH {sql_pairs()}, need AS (SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id))"


@query(
    f"""{RANGES_SQL}, g AS (SELECT family, version, gap, off, off + len AS e, CASE WHEN lag(off + len) OVER w IS NULL OR off - lag(off + len) OVER w > gap THEN 1 ELSE 0 END AS fresh FROM need, (VALUES (0), (100), (1000)) t(gap) WINDOW w AS (PARTITION BY family, version, gap ORDER BY off)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY family, version, gap ORDER BY off) AS island FROM g), j AS (SELECT family, version, gap, island, max(e) - min(off) AS bytes FROM i GROUP BY ALL)
    SELECT family, version, gap, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM j GROUP BY ALL"""
)
def coalesced_ranges(spark, sf_dir):
    return metrics.coalesced(reuse.missing(*base.pair_chunks(spark, sf_dir), PAIR), PAIR, (0, 100, 1000))


@query(
    """WITH i AS (SELECT l_orderkey, CAST(l_partkey % 1000 AS BIGINT) AS start, CAST(l_partkey % 1000 + l_quantity * 4 AS BIGINT) AS stop FROM lineitem), m AS (SELECT *, max(stop) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE stop > start),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT l_orderkey, island, max(stop) - min(start) AS bytes FROM n GROUP BY ALL)
    SELECT l_orderkey, count(*) AS islands, CAST(sum(bytes) AS BIGINT) AS covered FROM g GROUP BY l_orderkey"""
)
def interval_coverage(spark, sf_dir):
    lines = base.read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).alias("start"), F.rint(F.col("l_partkey") % 1000 + F.col("l_quantity") * 4).cast("long").alias("stop"))
    return metrics.coverage(lines, ["l_orderkey"])


# Identities and verification

FINGERPRINT = SMALL.fingerprint()


def _le(value: str, size: int) -> str:
    digits = f"printf('%0{2 * size}x', {value})"
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size)))


def manifest_sql(keys: str, source: str, everyone: str) -> str:
    s, p = fixed.SHA256_SUITE.encode(), SMALL.profile_id.encode()
    head = (fixed.MANIFEST_DOMAIN + len(s).to_bytes(2, "little") + s + len(p).to_bytes(2, "little") + p + bytes.fromhex(FINGERPRINT)).hex()
    return f"""SELECT {keys}, sha256(unhex('{head}' || coalesce(e, '') || {_le('coalesce(c, 0)', 8)} || {_le('coalesce(n, 0)', 8)})) AS manifest_id, coalesce(c, 0) AS chunks, coalesce(n, 0) AS bytes
        FROM {everyone} LEFT JOIN (SELECT {keys}, string_agg(id || {_le('len', 4)}, '' ORDER BY idx) AS e, count(*) AS c, CAST(sum(len) AS BIGINT) AS n FROM {source} GROUP BY {keys}) USING ({keys})"""


@query(f"WITH {SQL_DOCUMENT_CHUNKS} {manifest_sql('content_id', 'k', 'd')}")
def manifest_id(spark, sf_dir):
    chunks = chunking.records(base.document_chunks(spark, sf_dir), ["content_id"])
    return identity.manifest_ids(chunks, ["content_id"], fixed.SHA256_SUITE, SMALL.profile_id, FINGERPRINT, base.documents(spark, sf_dir))


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, sha256(unhex('{fixed.SEQUENCE_DOMAIN.hex()}' || {_le('count(*)', 8)} || string_agg(id || {_le('len', 4)}, '' ORDER BY idx))) AS sequence_digest FROM k GROUP BY content_id")
def sequence_digest(spark, sf_dir):
    return identity.sequence_digests(base.document_chunks(spark, sf_dir), ["content_id"])


@query(f"WITH {SQL_TREES} SELECT family, sha256(unhex(string_agg({_le('octet_length(encode(path))', 4)} || lower(hex(encode(path))) || {_le('length', 8)} || sha256, '' ORDER BY encode(path)))) AS layout_sha256, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM new GROUP BY family")
def layout_digest(spark, sf_dir):
    return identity.layout_digests(base.trees(spark, sf_dir)[1], ["family"])


@query(f"WITH {SQL_DOCUMENTS}, {sql_chunks('k', 'd', 'content_id, family', 64)} SELECT content_id, idx // 16 AS block, min(idx) AS first_idx, min(off) AS first_off, count(*) AS chunks FROM k GROUP BY ALL")
def block_index(spark, sf_dir):
    return identity.block_index(base.document_chunks(spark, sf_dir, 64), ["content_id"], 16)


DAMAGE = "CASE content_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {0} || {1} ELSE {2} END"


def _damaged(content: DataFrame) -> DataFrame:
    n = F.octet_length("bytes")
    flipped = F.concat(F.substring("bytes", F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(b"~"))
    kind = F.col("content_id") % 3
    return content.withColumn("bytes", F.when(kind == 0, F.col("bytes")).when(kind == 1, F.concat("bytes", F.lit(b"~"))).otherwise(flipped))


DAMAGED_SQL = "x AS MATERIALIZED (SELECT content_id, CASE content_id % 3 WHEN 0 THEN b WHEN 1 THEN b || encode('~') ELSE b[1:greatest(octet_length(b) - 1, 0)] || encode('~') END AS b FROM d)"


@query(
    f"""WITH {SQL_DOCUMENT_CHUNKS}, {DAMAGED_SQL} SELECT content_id, min(idx) FILTER (sha256(x.b[off + 1 : least(off + len, octet_length(x.b))]) <> id) AS first_bad, count(*) FILTER (sha256(x.b[off + 1 : least(off + len, octet_length(x.b))]) <> id) AS bad,
    sum(len) = max(octet_length(x.b)) AS whole FROM k JOIN x USING (content_id) GROUP BY content_id"""
)
def verify_ranges(spark, sf_dir):
    content = base.documents(spark, sf_dir).drop("family")
    return identity.verify_records(chunking.fixed_chunks(content, 256), _damaged(content), ["content_id"])


@query(
    f"""WITH {SQL_DOCUMENTS}, {DAMAGED_SQL}, {sql_chunks('k', 'd', 'content_id', 256)}, {sql_chunks('kx', 'x', 'content_id', 256)}, ma AS ({manifest_sql('content_id', 'k', 'd')}), mx AS ({manifest_sql('content_id', 'kx', 'x')})
    SELECT content_id, CASE WHEN ma.manifest_id = mx.manifest_id THEN 0 ELSE 32 END AS flags FROM ma JOIN mx USING (content_id)"""
)
def verify_content(spark, sf_dir):
    """Stored manifests against contents cut anew."""
    content = base.documents(spark, sf_dir).drop("family")
    ids = lambda c: identity.manifest_ids(chunking.fixed_chunks(c, 256), ["content_id"], fixed.SHA256_SUITE, SMALL.profile_id, FINGERPRINT, c)
    stored, now = ids(content), ids(_damaged(content)).select("content_id", F.col("manifest_id").alias("now"))
    return stored.join(now, "content_id").select("content_id", F.when(F.col("manifest_id") == F.col("now"), 0).otherwise(32).alias("flags"))


@query(
    f"""WITH RECURSIVE {SQL_DOCUMENT_CHUNKS}, g AS (SELECT content_id, idx, off, len, 0 AS range, len AS size FROM k WHERE idx = 0 UNION ALL
        SELECT k.content_id, k.idx, k.off, k.len, CASE WHEN g.size + k.len > 2000 THEN g.range + 1 ELSE g.range END, CASE WHEN g.size + k.len > 2000 THEN k.len ELSE g.size + k.len END FROM g JOIN k ON k.content_id = g.content_id AND k.idx = g.idx + 1)
    SELECT content_id, range, min(off) AS off, CAST(sum(len) AS BIGINT) AS len, count(*) AS records FROM g GROUP BY ALL"""
)
def range_groups(spark, sf_dir):
    return identity.range_groups(base.document_chunks(spark, sf_dir), ["content_id"], 2000)


@query(f"WITH k AS MATERIALIZED ({cdc_sql(SMALL)}) SELECT content_id, NOT (content_id % 3 = 0 AND count(*) >= 2) AS holds FROM k GROUP BY content_id")
def boundary_recheck(spark, sf_dir):
    """Stored chunk lengths against the boundaries that the bytes have, without hashing them; in some tables the first boundary was moved by a byte."""
    content = base.documents(spark, sf_dir).drop("family")
    chunks = chunking.cdc_chunks(content, SMALL)
    several = chunks.where("idx = 1 and content_id % 3 = 0").select("content_id", F.lit(1).alias("by"))
    moved = chunks.join(several, "content_id", "left").withColumn("len", F.col("len") + F.when(F.col("idx") == 0, F.coalesce("by", F.lit(0))).when(F.col("idx") == 1, -F.coalesce("by", F.lit(0))).otherwise(0)).drop("by")
    return patches.boundaries_hold(content, moved, ["content_id"], SMALL)


# Edits


def _edited(name: str, column: Callable[[Column], Column]) -> Callable:
    def run(spark, sf_dir):
        return base.documents(spark, sf_dir).select("content_id", column(F.octet_length("bytes")).alias("bytes")).select("content_id", F.octet_length("bytes").cast("long").alias("bytes"), F.sha2("bytes", 256).alias("sha256"))

    run.__name__ = name
    return run


def _edit_sql(b: str) -> str:
    return f"WITH {SQL_DOCUMENTS}, m AS (SELECT content_id, {b} AS x FROM (SELECT *, octet_length(b) AS n FROM d)) SELECT content_id, CAST(octet_length(x) AS BIGINT) AS bytes, sha256(x) AS sha256 FROM m"


query(_edit_sql("encode('head') || b"))(_edited("mutate_prepend", lambda n: mutations.inserted(F.lit(0), b"head")))
query(_edit_sql("b || encode('tail')"))(_edited("mutate_append", lambda n: mutations.inserted(n, b"tail")))
query(_edit_sql("b[1:n // 2] || encode('middle') || b[n // 2 + 1:n]"))(_edited("mutate_insert", lambda n: mutations.inserted(F.floor(n / 2), b"middle")))
query(_edit_sql("b[1:n // 3] || b[n // 3 + 51:n]"))(_edited("mutate_delete", lambda n: mutations.deleted(F.floor(n / 3), F.lit(50))))
query(_edit_sql("b[1:n // 3] || encode('overwrite')[1:least(9, n - n // 3)] || b[n // 3 + 10:n]"))(_edited("mutate_overwrite", lambda n: mutations.overwritten(F.floor(n / 3), b"overwrite")))
query(_edit_sql("(b[1:n // 2] || b[n // 2 + n // 8 + 1:n])[1:n // 4] || b[n // 2 + 1:n // 2 + n // 8] || (b[1:n // 2] || b[n // 2 + n // 8 + 1:n])[n // 4 + 1:n]"))(_edited("mutate_move", lambda n: mutations.moved(F.floor(n / 2), F.floor(n / 4), F.floor(n / 8))))

def _draw(what: str, seed: int, limit: str) -> str:
    """mutations.draw() in SQL."""
    return f"(('0x' || substr(md5('{what}/{seed}'), 1, 15))::BIGINT % greatest(1, {limit}))"


def _fill(what: str, seed: int, size: int) -> str:
    return "unhex('" + mutations.filler(seed, what, size).hex() + "')"


def _mutate_sql(jobs: list[tuple[str, str, int, int]]) -> str:
    """mutations.mutate() of documents in SQL; x is the target, in hexadecimal digits."""
    cut = lambda a, b: f"substr(hx, 2 * ({a}) + 1, 2 * (({b}) - ({a})))"
    parts = []
    for name, kind, size, seed in jobs:
        new, fill = f"least({size}, n)", mutations.filler(seed, "fill", size).hex()
        row = lambda x, start, end, changed, basis, given="s", n=name, at="CAST([] AS BIGINT[])": f"SELECT content_id, '{n}' AS mutation, hx, {x} AS x, {start} AS st, {end} AS en, {changed} AS ch, {basis} AS basis, {at} AS touched FROM {given}"
        if kind in ("insert", "prepend", "append"):
            given = f"(SELECT *, {dict(prepend='0', append='n').get(kind) or _draw('place', seed, 'n + 1')} AS p FROM s)"
            parts.append(row(f"{cut(0, 'p')} || '{fill}' || {cut('p', 'n')}", "p", f"p + {size}", size, "'inserted'", given))
        elif kind in ("delete", "overwrite"):
            given = f"(SELECT *, {new} AS z, {_draw('place', seed, f'n - {new} + 1')} AS p FROM s)"
            middle = f" || substr('{fill}', 1, 2 * z)" if kind == "overwrite" else ""
            parts.append(row(f"{cut(0, 'p')}{middle} || {cut('p + z', 'n')}", "p", "p", "z", "'deleted'" if kind == "delete" else "'differing'", given, at="range(p, p + z)"))
        elif kind in ("localized-rewrite", "random-rewrite"):
            reach = f"least({2 * size}, n)" if kind[0] == "l" else "n"
            draws = f"list_transform(range(0, least({size}, {reach})), lambda k: low + ('0x' || substr(md5('byte/' || k || '/{seed}'), 1, 15))::BIGINT % greatest(1, {reach}))"
            given = f"(SELECT *, {draws} AS ps FROM (SELECT *, {_draw('place', seed, f'n - {reach} + 1')} AS low FROM s))"
            given = f"(SELECT *, list_sort(list_distinct(ps)) AS q FROM {given})"
            stretch = "substr(hx, 2 * coalesce(q[k] + 1, 0) + 1, 2 * (coalesce(q[k + 1], n) - coalesce(q[k] + 1, 0)))"
            text = f"array_to_string(list_transform(range(0, len(q) + 1), lambda k: {stretch} || CASE WHEN k < len(q) THEN upper(substr(sha256('new/' || q[k + 1] || '/{seed}/0'), 1, 2)) ELSE '' END), '')"
            parts.append(row(text, "0", "0", "0", "'differing'", given, at="q"))
        elif kind == "move":
            given = f"(SELECT *, CASE WHEN t < a THEN t ELSE a END AS low, CASE WHEN t < a THEN a ELSE a + z END AS mid, CASE WHEN t < a THEN a + z ELSE t + 1 + z END AS high FROM (SELECT *, {_draw('block', seed, 'n - z + 1')} AS a, {_draw('gap', seed, 'n - z')} AS t FROM (SELECT *, least({size}, n // 2) AS z FROM s)))"
            parts.append(row(f"CASE WHEN z = 0 THEN hx ELSE {cut(0, 'low')} || {cut('mid', 'high')} || {cut('low', 'mid')} || {cut('high', 'n')} END", "CASE WHEN z = 0 THEN 0 ELSE low END", "CASE WHEN z = 0 THEN 0 ELSE high END", "z", "CASE WHEN z = 0 THEN 'none' ELSE 'moved' END", given))
        elif kind == "reorder":
            given = f"(SELECT *, least(f, g) * z AS a, greatest(f, g) * z AS b2 FROM (SELECT *, (f + 1 + {_draw('second', seed, 'm - 1')}) % greatest(1, m) AS g FROM (SELECT *, {_draw('first', seed, 'm')} AS f FROM (SELECT *, CASE WHEN z = 0 THEN 0 ELSE n // z END AS m FROM (SELECT *, least({size}, n // 2) AS z FROM s)))))"
            parts.append(row(f"CASE WHEN z = 0 THEN hx ELSE {cut(0, 'a')} || {cut('b2', 'b2 + z')} || {cut('a + z', 'b2')} || {cut('a', 'a + z')} || {cut('b2 + z', 'n')} END", "CASE WHEN z = 0 THEN 0 ELSE a END", "CASE WHEN z = 0 THEN 0 ELSE b2 + z END", "2 * z", "CASE WHEN z = 0 THEN 'none' ELSE 'swapped' END", given))
        else:
            parts.append(row("hx", "0", "0", "0", "'none'"))
    differ = "list_filter(touched, lambda i: upper(substr(hx, 2 * i + 1, 2)) <> upper(substr(x, 2 * i + 1, 2)))"
    return f"""WITH {SQL_DOCUMENTS}, s AS (SELECT content_id, octet_length(b) AS n, hex(b) AS hx FROM d), e AS ({' UNION ALL '.join(parts)}), f AS (SELECT *, CASE WHEN basis = 'differing' THEN {differ} END AS w FROM e)
    SELECT content_id, mutation, sha256(unhex(x)) AS sha256, CAST(CASE WHEN basis <> 'differing' THEN st WHEN len(w) = 0 THEN 0 ELSE w[1] END AS BIGINT) AS affected_start, CAST(CASE WHEN basis <> 'differing' THEN en WHEN len(w) = 0 THEN 0 ELSE w[-1] + 1 END AS BIGINT) AS affected_end,
        CAST(CASE WHEN basis <> 'differing' THEN ch ELSE len(w) END AS BIGINT) AS changed_bytes, basis FROM f"""


JOBS = [(k, k, 64, 7 + i) for i, k in enumerate(mutations.KINDS)]


@query(_mutate_sql(JOBS))
def mutate_seeded(spark, sf_dir):
    return mutations.mutated(base.documents(spark, sf_dir).drop("family"), JOBS).select("content_id", "mutation", F.sha2("bytes", 256).alias("sha256"), "affected_start", "affected_end", "changed_bytes", "basis")


@query(
    f"""WITH k AS MATERIALIZED ({cdc_sql(SMALL)}), dd AS (SELECT doc_id AS content_id, encode(coalesce(text, '')) AS b FROM documents), i AS (SELECT *, max(idx) OVER (PARTITION BY content_id) AS top FROM k),
    j AS (SELECT content_id, off + len AS bd, row_number() OVER (PARTITION BY content_id ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY content_id) AS c FROM i WHERE idx < top AND len > {SMALL.minimum} AND len < {SMALL.maximum}),
    a AS (SELECT dd.content_id, b, mutation, bd + rel AS p FROM dd CROSS JOIN (VALUES ('boundary', 0), ('before', -1)) t(mutation, rel) LEFT JOIN (SELECT * FROM j WHERE r = c // 2) m USING (content_id)),
    x AS (SELECT *, CASE WHEN p >= 0 AND p < octet_length(b) THEN b[1:p] || unhex(printf('%02x', xor(('0x' || hex(b[p + 1:p + 1]))::INT, 90))) || b[p + 2:octet_length(b)] END AS y FROM a)
    SELECT content_id, mutation, sha256(y) AS sha256, CASE WHEN y IS NOT NULL THEN CAST(p AS BIGINT) END AS affected_start, CASE WHEN y IS NOT NULL THEN 1::BIGINT END AS changed_bytes FROM x"""
)
def boundary_edit(spark, sf_dir):
    jobs = [("boundary", "boundary-edit", 0, 0), ("before", "boundary-edit", -1, 0)]
    return mutations.mutated(base.documents(spark, sf_dir).drop("family"), jobs, SMALL).select("content_id", "mutation", F.sha2("bytes", 256).alias("sha256"), "affected_start", "changed_bytes")


@query(
    f"""WITH a AS MATERIALIZED ({cdc_sql(SMALL)}), b AS MATERIALIZED ({cdc_sql(WARM)}), ea AS (SELECT content_id, off AS e FROM a WHERE off > 0), eb AS (SELECT content_id, off AS e FROM b WHERE off > 0),
    x AS (SELECT content_id, count(*) AS l FROM ea GROUP BY 1), y AS (SELECT content_id, count(*) AS r FROM eb GROUP BY 1), z AS (SELECT content_id, count(*) AS m FROM ea JOIN eb USING (content_id, e) GROUP BY 1)
    SELECT content_id, coalesce(l, 0) AS left_boundaries, coalesce(r, 0) AS right_boundaries, coalesce(m, 0) AS shared, round(CASE WHEN greatest(coalesce(l, 0), coalesce(r, 0)) = 0 THEN 1 ELSE coalesce(m, 0) / greatest(coalesce(l, 0), coalesce(r, 0)) END, 6) AS agreement
    FROM (SELECT DISTINCT content_id FROM a) LEFT JOIN x USING (content_id) LEFT JOIN y USING (content_id) LEFT JOIN z USING (content_id)"""
)
def semantic_divergence(spark, sf_dir):
    """Boundaries of the two ways to begin the hash."""
    content = base.documents(spark, sf_dir).drop("family")
    return rounded(metrics.boundary_agreement(chunking.cdc_chunks(content, SMALL), chunking.cdc_chunks(content, WARM), ["content_id"]))


_TWICE = """SELECT content_id, b[1:n // 4] || encode('a new sentence.') || b[n // 4 + 1:n - n // 4] || b[n - n // 4 + 1 + n // 50:n] AS b FROM (SELECT doc_id AS content_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"""


@query(cdc_sql(SMALL, _TWICE))
def incremental_rechunk(spark, sf_dir):
    """Chunks from old ones and two edits, a sentence put in and a stretch taken out; the SQL cuts the edited contents anew."""
    content = base.documents(spark, sf_dir).drop("family")
    n = F.octet_length("bytes")
    first, late, gone = (F.floor(n / 4).cast("long"), (n - F.floor(n / 4)).cast("long"), F.floor(n / 50).cast("long"))
    splice = lambda *x: F.struct(*(v.alias(c) for v, c in zip(x, ("start", "old_end", "new_end"), strict=True)))
    shorter = content.select("content_id", mutations.deleted(late, gone).alias("bytes"), F.array(splice(late, late + gone, late), splice(first, first, first + 15)).alias("splices"))
    edited = shorter.select("content_id", mutations.inserted(F.element_at("splices", 2)["start"], b"a new sentence.").alias("bytes"), "splices")
    return incremental.rechunk(chunking.cdc_chunks(content, SMALL), edited, ["content_id"], SMALL).drop("reused", "scanned")


# Versions and families


@query(
    """WITH v AS (SELECT conv_id AS family, turn AS version, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT a.family, a.version AS from_version, b.version AS to_version, CAST(b.r - a.r AS INT) AS stride, CASE WHEN b.r - a.r = 1 THEN 'version-adjacent' ELSE 'version-skip-' || (b.r - a.r - 1) END AS kind FROM v a JOIN v b ON a.family = b.family AND b.r - a.r BETWEEN 1 AND 3"""
)
def version_transitions(spark, sf_dir):
    return families.transitions(base.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("family"), F.col("turn").alias("version")))


def _rows(spark, sf_dir) -> DataFrame:
    b, t = base.pair_chunks(spark, sf_dir)
    plan = reuse.plan(b, t, PAIR)
    rate = metrics.cut_rates(t, PAIR, base.SMALL_SIZE).select(*PAIR, "max_cut_rate")
    return plan.join(metrics.boundary_survival(b, t, PAIR).select(*PAIR, "survival"), PAIR).join(rate, PAIR).withColumn("kind", F.lit("version-adjacent")).withColumn("status", F.lit("not-applicable")).withColumn("distance", F.lit(None).cast("long"))


FAMILY_SQL = f"""{sql_pairs()}, {PLAN_SQL}, {SURVIVAL_SQL}, mc AS (SELECT family, version, avg(CASE WHEN len = 64 THEN 1 ELSE 0 END) AS r FROM target GROUP BY ALL),
    fam AS (SELECT family, 'adjacent' AS scope, count(*) AS transitions, CAST(sum(target_bytes) AS BIGINT) AS target_bytes, sum(target_bytes) / sum(target_chunks) AS mean_bytes, sum(reused_bytes) / sum(target_bytes) AS reuse_ratio, CAST(sum(unique_missing_bytes) AS BIGINT) AS unique_missing_bytes,
    sum(unique_missing_bytes) / sum(target_bytes) AS missing_ratio, avg(survival) AS survival, avg(r) AS max_cut_rate, 0::BIGINT AS applicable, 0::BIGINT AS resynchronized FROM plan JOIN survival USING (family, version) JOIN mc USING (family, version) GROUP BY family)"""
_FAMILY_ROUND = "family, scope, transitions, target_bytes, round(mean_bytes, 6) AS mean_bytes, round(reuse_ratio, 6) AS reuse_ratio, unique_missing_bytes, round(missing_ratio, 6) AS missing_ratio, round(survival, 6) AS survival, round(max_cut_rate, 6) AS max_cut_rate, applicable, resynchronized"


@query(f"WITH {FAMILY_SQL} SELECT {_FAMILY_ROUND} FROM fam")
def family_aggregate(spark, sf_dir):
    return rounded(families.by_family(_rows(spark, sf_dir), ["family"]))


@query(
    f"""WITH {FAMILY_SQL}, h AS (SELECT fam.*, CASE WHEN n <= 2 THEN 0 ELSE 1 END AS ok FROM fam JOIN (SELECT family, count(*) AS n FROM v GROUP BY family) USING (family))
    SELECT scope, count(*) AS families, count(*) FILTER (ok = 1) AS eligible, count(*) FILTER (ok = 1) AS compared, round(avg(mean_bytes) FILTER (ok = 1), 6) AS mean_bytes, round(avg(reuse_ratio) FILTER (ok = 1), 6) AS mean_reuse, round(min(reuse_ratio) FILTER (ok = 1), 6) AS worst_reuse,
    round(avg(missing_ratio) FILTER (ok = 1), 6) AS mean_missing, round(max(missing_ratio) FILTER (ok = 1), 6) AS worst_missing, round(avg(survival) FILTER (ok = 1), 6) AS mean_survival, round(max(max_cut_rate) FILTER (ok = 1), 6) AS worst_max_cut_rate FROM h GROUP BY scope"""
)
def family_comparison(spark, sf_dir):
    counts = base.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    rows = families.by_family(_rows(spark, sf_dir), ["family"]).join(counts, "family").withColumn("history", families.history(F.col("n")))
    return rounded(families.across_families(rows, []))


@query(
    """WITH f AS (SELECT conv_id, conv_id % 2 AS split, count(*) AS n FROM conversations GROUP BY ALL) SELECT split, count(*) AS families, CAST(sum(n) AS BIGINT) AS versions, count(*) FILTER (n > 2) AS eligible, count(*) FILTER (n <= 2) AS pair_only, count(*) FILTER (n BETWEEN 3 AND 4) AS short_history FROM f GROUP BY split"""
)
def corpus_summary(spark, sf_dir):
    rows = base.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("family"), (F.col("conv_id") % 2).alias("split"), F.col("turn").alias("version"))
    return families.corpus_summary(rows)


@query("WITH r AS (SELECT conv_id AS family, turn AS version, octet_length(encode(coalesce(text, ''))) AS n FROM conversations) SELECT family, version, CASE WHEN version % 3 = 1 AND n > 0 THEN 'size' ELSE 'digest' END AS rule FROM r WHERE (version % 3 = 1 AND n > 0) OR version % 3 = 2")
def corpus_faults(spark, sf_dir):
    """Told sizes of every third version and digests of the next are wrong."""
    talk = base.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("family"), F.col("turn").alias("version"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    told = talk.select("family", F.lit("holdout").alias("split"), "version", F.when(F.col("version") % 3 == 1, 0).otherwise(F.octet_length("bytes")).alias("size"), F.when(F.col("version") % 3 == 2, F.lit("")).otherwise(F.sha2("bytes", 256)).alias("sha256"))
    return families.corpus_faults(told, talk)


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 20 = 2 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3)
    SELECT o_orderkey, CASE WHEN a.o_orderstatus IS NULL THEN 'only_right' WHEN b.o_orderstatus IS NULL THEN 'only_left' WHEN o_orderkey % 10 = 2 THEN 'different' ELSE 'equal' END AS verdict,
    CASE WHEN o_orderkey % 20 = 2 THEN 'o_totalprice,o_orderpriority' WHEN o_orderkey % 10 = 2 THEN 'o_totalprice' ELSE '' END AS fields FROM a FULL JOIN b USING (o_orderkey)"""
)
def run_compare(spark, sf_dir):
    orders = base.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    right = orders.where(k % 10 != 3).withColumn("o_totalprice", F.when(k % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.when(k % 20 == 2, None).otherwise(F.col("o_orderpriority")))
    return families.compare_runs(orders.where(k % 10 != 1), right, "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@query(
    f"""WITH {SQL_DOCUMENTS}, m AS (SELECT family AS candidate, avg(octet_length(b)) AS mean_bytes FROM d GROUP BY family), p AS (SELECT DISTINCT substr(source, 1, 4) AS "group", source AS candidate FROM documents)
    SELECT "group", count(mean_bytes) AS found, 0::BIGINT AS absent, round(max(mean_bytes) / min(mean_bytes) - 1, 6) AS delta, max(mean_bytes) / min(mean_bytes) - 1 <= 0.05 AS matched FROM p JOIN m USING (candidate) GROUP BY "group" """
)
def mean_match_audit(spark, sf_dir):
    docs = base.documents(spark, sf_dir)
    plan = docs.select(F.substring("family", 1, 4).alias("group"), F.col("family").alias("candidate")).distinct()
    results = docs.groupBy(F.col("family").alias("candidate")).agg(F.avg(F.octet_length("bytes")).alias("mean_bytes"))
    return rounded(families.mean_match(plan, results, 0.05))


@query("WITH s AS (SELECT event_type AS lane, value FROM events), t AS (SELECT lane, sum(value) AS total, count(*) AS rows FROM s GROUP BY lane) SELECT lane, round(total, 4) AS total, rows, round(total / (SELECT total FROM t WHERE lane = (SELECT min(event_type) FROM events)), 6) AS share FROM t")
def lane_totals(spark, sf_dir):
    events = base.read(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), "value")
    reference = events.agg(F.min("lane")).first()[0]
    return families.lane_totals(events, "lane", "value", reference).select("lane", F.round("total", 4).alias("total"), "rows", F.round("share", 6).alias("share"))


THROUGHPUT_SQL = """s AS (SELECT event_type AS lane, user_id % 4 AS workload, (1073741824.0 * (1 + user_id % 7) / 1073741824.0) / (1 + value) AS rate, (1073741824.0 * (1 + user_id % 7) / 1073741824.0) / (2 + value) AS cpu_rate FROM events WHERE value >= 0),
    p AS (SELECT workload, lane, count(*) AS samples, quantile_disc(rate, 0.5) AS p50, quantile_disc(rate, 0.95) AS p95, min(rate) AS least, max(rate) AS most, quantile_disc(cpu_rate, 0.5) AS cpu_p50 FROM s GROUP BY ALL)"""


def _throughput(spark, sf_dir) -> DataFrame:
    events = base.read(spark, sf_dir, "events").where("value >= 0")
    samples = events.select((F.col("user_id") % 4).alias("workload"), F.col("event_type").alias("lane"), (F.lit(float(1 << 30)) * (1 + F.col("user_id") % 7)).alias("bytes"), (1 + F.col("value")).alias("wall_s"), (2 + F.col("value")).alias("cpu_s"))
    return families.throughput(samples, ["workload", "lane"])


@query(f"WITH {THROUGHPUT_SQL} SELECT workload, lane, samples, round(p50, 6) AS p50, round(p95, 6) AS p95, round(least, 6) AS least, round(most, 6) AS most, round(cpu_p50, 6) AS cpu_p50 FROM p")
def throughput(spark, sf_dir):
    return rounded(_throughput(spark, sf_dir))


@query(f"WITH {THROUGHPUT_SQL} SELECT workload, p.lane, round(p.p50 / b.p50, 6) AS ratio, CASE WHEN p.p50 / b.p50 >= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p JOIN p b USING (workload) WHERE b.lane = (SELECT min(event_type) FROM events) AND p.lane <> b.lane")
def lane_verdicts(spark, sf_dir):
    reference = base.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return rounded(families.verdicts(_throughput(spark, sf_dir), ["workload"], "lane", reference, "p50", 1.0))


@query()
def bootstrap_medians(spark, sf_dir):
    return rounded(metrics.bootstrap_medians(base.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag", "l_linestatus", "l_quantity").count(), ["l_returnflag", "l_linestatus"], "count"))


@query()
def bootstrap_blocks(spark, sf_dir):
    lines = base.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 20).alias("block"), "l_linenumber").agg(F.avg("l_extendedprice").alias("a"), F.avg("l_quantity").alias("b"))
    return rounded(metrics.bootstrap_blocks(lines.select("l_returnflag", "block", "a", "b"), ["l_returnflag"], "block", "a", "b"))


# Candidates

NEAR_SQL = f"""{sql_pairs()}, need AS (SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.family = t.family AND b.version = t.version AND b.id = t.id)),
    near AS (SELECT * FROM (SELECT n.family, n.version, n.idx, b.idx AS start, abs(b.off - n.off) AS distance, row_number() OVER (PARTITION BY n.family, n.version, n.idx ORDER BY abs(b.off - n.off), b.idx) AS rank FROM need n JOIN base b ON b.family = n.family AND b.version = n.version AND abs(b.off - n.off) <= 512) WHERE rank <= 4)"""


@query(f"WITH {NEAR_SQL} SELECT family, version, idx, start, distance, CAST(rank AS INT) AS rank FROM near")
def candidate_starts(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    return candidates.nearest_starts(b, reuse.missing(b, t, PAIR), PAIR, 512, 4)


@query(f"WITH {sql_pairs()} SELECT * FROM (SELECT family, version, idx AS start, count(*) OVER w AS count, CAST(sum(len) OVER w AS BIGINT) AS bytes FROM base WINDOW w AS (PARTITION BY family, version ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE bytes <= 250")
def candidate_runs(spark, sf_dir):
    return candidates.runs(base.pair_chunks(spark, sf_dir)[0], PAIR, 4, 250)


@query(
    f"""WITH {NEAR_SQL}, bk2 AS (SELECT family, version, idx, off, substr(id, 1, 1) AS key FROM base), hot AS (SELECT family, version, key FROM bk2 GROUP BY ALL HAVING count(*) <= 3), sk AS (SELECT * FROM (SELECT n.family, n.version, n.idx, b.idx AS start, row_number() OVER (PARTITION BY n.family, n.version, n.idx ORDER BY abs(b.off - n.off), b.idx) AS r FROM need n JOIN bk2 b ON b.family = n.family AND b.version = n.version AND b.key = substr(n.id, 1, 1) JOIN hot h ON h.family = b.family AND h.version = b.version AND h.key = b.key) WHERE r <= 8)
    SELECT family, version, idx, start, CASE WHEN a.x IS NULL THEN 'sketch' WHEN b.x IS NULL THEN 'offset' ELSE 'both' END AS found_by FROM (SELECT family, version, idx, start, 1 AS x FROM near) a FULL JOIN (SELECT family, version, idx, start, 1 AS x FROM sk) b USING (family, version, idx, start)"""
)
def candidate_union(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    need = reuse.missing(b, t, PAIR)
    keyed = lambda c: c.select(*PAIR, "idx", "off", F.substring("id", 1, 1).alias("key"))
    return candidates.labelled_union(candidates.nearest_starts(b, need, PAIR, 512, 4), candidates.similar_starts(keyed(b), keyed(need), PAIR, 8, 3), PAIR)


@query(f"WITH {NEAR_SQL} SELECT * FROM (SELECT family, version, idx, start AS ordinal, distance AS cost, row_number() OVER (PARTITION BY family, version, idx ORDER BY distance, start) AS rank FROM near) WHERE rank <= 2")
def candidate_top2(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    near = candidates.nearest_starts(b, reuse.missing(b, t, PAIR), PAIR, 512, 4).select(*PAIR, "idx", F.col("start").alias("ordinal"), F.col("distance").alias("cost"))
    return candidates.cheapest(near, [*PAIR, "idx"], 2)


@query(f"WITH {SQL_DOCUMENT_CHUNKS}, h AS (SELECT content_id, idx, id, sha256(unhex('{fixed.STRIDE_DOMAIN.encode().hex()}00' || id)) AS s FROM k) SELECT content_id, idx, id FROM h WHERE ('0x' || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2))::BIGINT % 4 = 0")
def stride_sample(spark, sf_dir):
    return candidates.stride_sample(base.document_chunks(spark, sf_dir), fixed.STRIDE_DOMAIN, 4).select("content_id", "idx", "id")


@query()
def superfeatures(spark, sf_dir):
    return patches.super_feature_keys(chunking.cdc_chunks(base.documents(spark, sf_dir).drop("family"), SMALL, payload=True), ["content_id"])


@query()
def similar_chunks(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    keys = lambda c: patches.super_feature_keys(chunking.cdc_chunks(c, SMALL, payload=True), PAIR)
    return candidates.similar_starts(keys(b), keys(t), PAIR)


@query(
    f"""WITH {SQL_HISTORIES}, bb AS (SELECT s.family, s.to_version AS version, b, octet_length(b) AS n FROM v JOIN steps s ON v.family = s.family AND v.version = s.from_version), bt AS (SELECT s.family, s.to_version AS version, encode('>>') || v.b AS b, octet_length(v.b) + 2 AS n FROM v JOIN steps s ON v.family = s.family AND v.version = s.to_version),
    wb AS (SELECT family, version, i AS base_at, sha256(b[i + 1:i + 200]) AS h FROM bb, unnest(range(0, n - 199, 128)) AS x(i)), wt AS (SELECT family, version, i AS pos, sha256(b[i + 1:i + 200]) AS h FROM bt, unnest(range(0, n - 199)) AS x(i))
    SELECT family, version, base_at, min(pos) AS target_at FROM wb JOIN wt USING (family, version, h) GROUP BY ALL"""
)
def exact_windows(spark, sf_dir):
    """Windows of 200 bytes, on a grid of 128."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.exact_windows(b, t.withColumn("bytes", F.concat(F.lit(b">>"), "bytes")), PAIR, 200, 128)


@query(
    f"""WITH {SQL_HISTORIES}, p AS (SELECT s.family, s.to_version AS version, octet_length(x.b) AS old, octet_length(y.b) AS new FROM steps s JOIN v x ON x.family = s.family AND x.version = s.from_version JOIN v y ON y.family = s.family AND y.version = s.to_version)
    SELECT family, version, CAST(new AS BIGINT) AS bytes, CAST(CASE WHEN new > old THEN 8 + new - old ELSE 0 END AS BIGINT) AS sparse_bytes, CASE WHEN new > old THEN 1::BIGINT ELSE 0::BIGINT END AS runs, true AS restored FROM p"""
)
def residual_costs(spark, sf_dir):
    """Histories only grow, so a version differs from the one before in one run at its end."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.residuals(b, t, PAIR).drop("xor_bytes")


#: Envelopes of the fixed ones' form, small enough for runs of 64-byte chunks to meet both bounds.
ENVELOPES = (("a", 2, 200, 20), ("b", 4, 200, 20), ("c", 8, 700, 20), ("d", 64, 2000, 20))


@query(
    f"""WITH {NEAR_SQL}, en AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {r}, {b})" for n, r, b, _ in ENVELOPES)}) t(envelope, refs, budget))
    SELECT near.family, near.version, near.idx, CAST(rank AS INT) AS rank, start, envelope, count(*) AS records, CAST(sum(r.len) AS BIGINT) AS bytes
    FROM near JOIN base s ON s.family = near.family AND s.version = near.version AND s.idx = near.start CROSS JOIN en JOIN base r ON r.family = near.family AND r.version = near.version AND r.idx >= start AND r.idx < start + refs AND r.off + r.len - s.off <= budget GROUP BY ALL"""
)
def envelope_prefixes(spark, sf_dir):
    b, t = base.pair_chunks(spark, sf_dir)
    return envelopes.prefixes(b, candidates.nearest_starts(b, reuse.missing(b, t, PAIR), PAIR, 512, 4), PAIR, ENVELOPES)


@query()
def envelope_trials(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return envelopes.trials(b, t, PAIR, SMALL, level=3)


@query()
def envelope_lanes(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return envelopes.lanes(envelopes.trials(b, t, PAIR, SMALL, level=3), PAIR)


@query()
def patch_ledgers(spark, sf_dir):
    """Bytes of binary patches by what they hold; they sum to the patch."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.ledgers(patches.patch_files(b, t, PAIR, STABLE, level=1), PAIR)


# Trees


@query(f"WITH {SQL_TREES} SELECT family, path, o2.length AS old_length, n2.length AS new_length, CASE WHEN o2.sha256 IS NULL THEN 'added' WHEN n2.sha256 IS NULL THEN 'removed' WHEN o2.sha256 = n2.sha256 THEN 'unchanged' ELSE 'changed' END AS status FROM old o2 FULL JOIN new n2 USING (family, path)")
def tree_diff(spark, sf_dir):
    return trees.diff(*base.trees(spark, sf_dir), ["family"])


MOVES_SQL = f"""{SQL_TREES}, added AS (SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.family = new.family AND old.path = new.path)),
    src AS (SELECT family, length, sha256, arg_min(path, (octet_length(encode(path)), encode(path))) AS source_path, bool_or(EXISTS (SELECT 1 FROM new WHERE new.family = old.family AND new.path = old.path)) AS still FROM old GROUP BY ALL),
    mv AS (SELECT family, path AS target_path, source_path, length, CAST(48 + octet_length(encode(path)) + octet_length(encode(source_path)) AS BIGINT) AS record_bytes, NOT still AS strict FROM added JOIN src USING (family, length, sha256))"""


@query(f"WITH {MOVES_SQL} SELECT *, length > record_bytes AS mapped FROM mv")
def exact_moves(spark, sf_dir):
    return trees.exact_moves(*base.trees(spark, sf_dir), ["family"])


@query(
    f"""WITH {MOVES_SQL}, a AS (SELECT family, count(*) AS added, CAST(sum(length) AS BIGINT) AS added_bytes FROM added GROUP BY family), t AS (SELECT family, count(*) AS candidates, count(*) FILTER (strict) AS strict_moves, count(*) FILTER (length > record_bytes) AS m, coalesce(sum(length) FILTER (length > record_bytes), 0) AS mb, coalesce(sum(record_bytes) FILTER (length > record_bytes), 0) + 9 AS rb FROM mv GROUP BY family)
    SELECT family, added, added_bytes, coalesce(candidates, 0) AS candidates, coalesce(strict_moves, 0) AS strict_moves, coalesce(candidates, 0) - coalesce(strict_moves, 0) AS copies_or_ambiguous, CAST(CASE WHEN mb > rb THEN m ELSE 0 END AS BIGINT) AS mapped, CAST(CASE WHEN mb > rb THEN mb ELSE 0 END AS BIGINT) AS mapped_bytes,
    CAST(CASE WHEN mb > rb THEN rb ELSE 0 END AS BIGINT) AS map_bytes, CAST(CASE WHEN mb > rb THEN mb - rb ELSE 0 END AS BIGINT) AS net_saved FROM a LEFT JOIN t USING (family)"""
)
def move_census(spark, sf_dir):
    return trees.move_census(*base.trees(spark, sf_dir), ["family"])


RENAME_SQL = f"""{SQL_TREES}, sig AS (SELECT 'o' AS side, * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.family = old.family AND new.path = old.path) UNION ALL SELECT 'n', * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.family = new.family AND old.path = new.path)),
    ps AS (SELECT *, CASE WHEN regexp_full_match(path, '(.*/)?[A-Za-z0-9][A-Za-z0-9_.+-]*_[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+[.]dll') THEN regexp_extract(path, '^(?:(.*)/)?([^/]*_)([0-9.]+)[.]dll$', 1) || '/' || regexp_extract(path, '^(?:(.*)/)?([^/]*_)([0-9.]+)[.]dll$', 2) END AS stem,
        list_transform(string_split(regexp_extract(path, '_([0-9.]+)[.]dll$', 1), '.'), lambda x: try_cast(x AS BIGINT)) AS ver FROM sig),
    s AS (SELECT *, count(*) OVER (PARTITION BY family, stem) AS pool FROM ps WHERE side = 'o' AND stem IS NOT NULL AND length BETWEEN 1 AND 67108864),
    t AS (SELECT ps.*, coalesce((SELECT max(pool) FROM s WHERE s.family = ps.family AND s.stem = ps.stem), 0) AS pool FROM ps WHERE side = 'n'),
    pr AS (SELECT t.family, t.path, count(*) AS matches, min(s.path) AS source_path FROM t JOIN s ON s.family = t.family AND s.stem = t.stem AND s.pool <= 8 AND s.ver < t.ver AND s.sha256 <> t.sha256 AND greatest(s.length, t.length) <= 2 * least(s.length, t.length) WHERE t.length BETWEEN 1 AND 67108864 GROUP BY ALL),
    cl AS (SELECT family, source_path, count(*) AS claims FROM pr WHERE matches = 1 GROUP BY ALL),
    oc AS (SELECT t.family, t.path AS target_path, pr.source_path, CASE WHEN stem IS NULL THEN 'nonversioned_filename' WHEN NOT length BETWEEN 1 AND 67108864 THEN 'target_size_out_of_bounds' WHEN pool > 8 THEN 'source_pool_limit' WHEN matches IS NULL THEN 'no_unique_structural_source' WHEN matches > 1 THEN 'ambiguous_source_candidates' WHEN claims > 1 THEN 'source_claimed_by_multiple_targets' ELSE 'paired' END AS outcome
        FROM t LEFT JOIN pr ON pr.family = t.family AND pr.path = t.path LEFT JOIN cl ON cl.family = pr.family AND cl.source_path = pr.source_path)"""


@query(f"WITH {RENAME_SQL} SELECT family, target_path, outcome, CASE WHEN outcome = 'paired' THEN source_path END AS source_path FROM oc")
def rename_pairs(spark, sf_dir):
    return trees.rename_pairs(*base.trees(spark, sf_dir), ["family"], least=1)


@query(f"WITH {RENAME_SQL} SELECT outcome, count(*) AS targets FROM oc GROUP BY outcome")
def rename_outcomes(spark, sf_dir):
    return trees.rename_pairs(*base.trees(spark, sf_dir), ["family"], least=1).groupBy("outcome").agg(F.count(F.lit(1)).alias("targets"))


@query(f"WITH {SQL_TREES} SELECT family, path, length, CAST(sum(length) OVER (PARTITION BY family ORDER BY encode(path) ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS off FROM new")
def tree_offsets(spark, sf_dir):
    return trees.offsets(base.trees(spark, sf_dir)[1], ["family"]).select("family", "path", "length", "off")


PLACED_SQL = f"{SQL_TREES}, pl AS MATERIALIZED (SELECT family, path, length, CAST(sum(length) OVER (PARTITION BY family ORDER BY encode(path) ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS off FROM new)"


@query(f"WITH {PLACED_SQL} SELECT pl.family, r AS range_id, path, greatest(off, r * 5000) - off AS file_off, least(off + length, r * 5000 + 3000) - greatest(off, r * 5000) AS length FROM pl, unnest(range(0, 4)) t(r) WHERE off < r * 5000 + 3000 AND off + length > r * 5000 AND length > 0")
def tree_reads(spark, sf_dir):
    placed = trees.offsets(base.trees(spark, sf_dir)[1], ["family"])
    wanted = placed.select("family").distinct().select("family", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("range_id")).select("family", "range_id", (F.col("range_id") * 5000).alias("start"), F.lit(3000).alias("size"))
    return trees.read_ranges(placed.where("length > 0"), wanted, ["family"])


@query(
    f"""WITH {PLACED_SQL}, c AS (SELECT family, i * 1000 AS a, least((i + 1) * 1000, total) AS z FROM (SELECT family, CAST(sum(length) AS BIGINT) AS total FROM pl GROUP BY family), unnest(range(0, (total + 999) // 1000)) t(i)),
    ov AS (SELECT pl.family, path, length, greatest(off, a) AS lo, least(off + length, z) AS hi, a >= off AND z <= off + length AS inside FROM pl JOIN c ON c.family = pl.family AND c.a < off + length AND c.z > off WHERE length > 0)
    SELECT family, path, length, count(*) FILTER (inside) AS contained, CAST(coalesce(sum(hi - lo) FILTER (inside), 0) AS BIGINT) AS contained_bytes, count(*) FILTER (NOT inside) AS crossing, CAST(coalesce(sum(hi - lo) FILTER (NOT inside), 0) AS BIGINT) AS crossing_bytes FROM ov GROUP BY family, path, length"""
)
def chunk_file_overlap(spark, sf_dir):
    placed = trees.offsets(base.trees(spark, sf_dir)[1].drop("bytes"), ["family"])
    total = placed.groupBy("family").agg(F.sum("length").alias("total"))
    chunks = total.select("family", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 1000))).alias("i")).select("family", (F.col("i") * 1000).alias("off"), F.least(F.lit(1000), F.col("total") - F.col("i") * 1000).alias("len"))
    return trees.chunk_overlap(placed, chunks, ["family"])


def _tree_chunks(tree: DataFrame) -> DataFrame:
    return chunking.fixed_chunks(tree.select("family", "path", "bytes"), 256)


TREE_CHUNKS_SQL = f"{SQL_TREES}, {sql_chunks('ok', 'o', 'family, path', 256)}, {sql_chunks('nk', 'n', 'family, path', 256)}"


@query(f"WITH {TREE_CHUNKS_SQL} SELECT family, path, CAST(sum(len) AS BIGINT) AS bytes, CAST(coalesce(sum(len) FILTER (EXISTS (SELECT 1 FROM ok WHERE ok.family = nk.family AND ok.path = nk.path AND ok.id = nk.id)), 0) AS BIGINT) AS same_path_bytes, CAST(coalesce(sum(len) FILTER (EXISTS (SELECT 1 FROM ok WHERE ok.family = nk.family AND ok.id = nk.id)), 0) AS BIGINT) AS whole_tree_bytes FROM nk GROUP BY family, path")
def tree_boundary_attribution(spark, sf_dir):
    old, new = base.trees(spark, sf_dir)
    return trees.file_reuse(_tree_chunks(old), _tree_chunks(new), ["family"])


#: Lengths as the layouts in sources/ add up: what any manifest has, a block (its index entry included) and a chunk; what any patch with a base has besides the manifest, a block and an entry.
_SQL_MANIFEST = f"{320 + len(fixed.SHA256_SUITE) + len(fixed.STABLE_PROFILE)} + 60 * ceil({{0}} / 4096.0) + 36 * {{0}}"
_SQL_PATCH = f"{_SQL_MANIFEST} + 260 + 36 * ceil({{1}} / 4096.0) + 64 * {{1}}"
COSTS_SQL = f"""{TREE_CHUNKS_SQL}, st AS (SELECT new.family, new.path, new.length, old.path IS NOT NULL AS changed FROM new LEFT JOIN old USING (family, path) WHERE old.path IS NULL OR old.sha256 <> new.sha256),
    ids AS (SELECT family, path, id, count(*) AS n, min(len) AS len FROM nk GROUP BY ALL),
    fl AS (SELECT *, EXISTS (SELECT 1 FROM ok WHERE ok.family = ids.family AND ok.path = ids.path AND ok.id = ids.id) AS s, EXISTS (SELECT 1 FROM ok WHERE ok.family = ids.family AND ok.id = ids.id) AS w FROM ids),
    pe AS (SELECT family, path, sum(n) AS c, count(*) FILTER (NOT s) AS es, coalesce(sum(len) FILTER (NOT s), 0) AS bs, count(*) AS eo, sum(len) AS bo, count(*) FILTER (NOT w) AS ew, coalesce(sum(len) FILTER (NOT w), 0) AS bw FROM fl GROUP BY ALL),
    z AS (SELECT family, path, length, changed, coalesce(c, 0) AS c, coalesce(es, 0) AS es, coalesce(bs, 0) AS bs, coalesce(eo, 0) AS eo, coalesce(bo, 0) AS bo, coalesce(ew, 0) AS ew, coalesce(bw, 0) AS bw FROM st LEFT JOIN pe USING (family, path)),
    fc AS (SELECT family, path, CASE WHEN changed THEN 'changed' ELSE 'added' END AS status, length, CAST(CASE WHEN changed THEN {_SQL_PATCH.format('c', 'es')} + bs ELSE length END AS BIGINT) AS same_path,
        CAST(CASE WHEN changed THEN {_SQL_PATCH.format('c', 'es')} + bs ELSE {_SQL_PATCH.format('c', 'eo')} - 48 + bo END AS BIGINT) AS own, CAST({_SQL_PATCH.format('c', 'ew')} + bw AS BIGINT) AS whole_tree FROM z)"""


@query(f"WITH {COSTS_SQL} SELECT * FROM fc")
def tree_file_costs(spark, sf_dir):
    old, new = base.trees(spark, sf_dir)
    return accounting.file_costs(old, new, _tree_chunks(old), _tree_chunks(new), ["family"])


@query(
    f"""WITH {COSTS_SQL}, mp AS (SELECT family, CAST(sum(octet_length(encode(path)) + 46) + 4 AS BIGINT) AS map_bytes FROM new GROUP BY family), t AS (SELECT family, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'added') AS added, sum(same_path) AS a, sum(own) AS b, sum(whole_tree) AS w FROM fc GROUP BY family),
    g AS (SELECT family, count(*) AS removed FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.family = old.family AND new.path = old.path) GROUP BY family), kn AS (SELECT family, count(*) AS k FROM ok GROUP BY family)
    SELECT family, coalesce(changed, 0) AS changed, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, map_bytes, CAST(coalesce(a, 0) + map_bytes AS BIGINT) AS same_path, CAST(coalesce(b, 0) + map_bytes AS BIGINT) AS own, CAST(coalesce(w, 0) + map_bytes AS BIGINT) AS whole_tree,
    CAST(coalesce(w, 0) + map_bytes + {_SQL_MANIFEST.format('coalesce(k, 0)')} AS BIGINT) AS whole_tree_cold FROM mp LEFT JOIN t USING (family) LEFT JOIN g USING (family) LEFT JOIN kn USING (family)"""
)
def tree_update_costs(spark, sf_dir):
    old, new = base.trees(spark, sf_dir)
    return accounting.update_costs(old, new, _tree_chunks(old), _tree_chunks(new), ["family"])


@query(f"WITH {TREE_CHUNKS_SQL}, s AS (SELECT family, EXISTS (SELECT 1 FROM nk WHERE nk.family = ok.family AND nk.id = ok.id AND nk.off = ok.off) AS h, EXISTS (SELECT 1 FROM nk WHERE nk.family = ok.family AND nk.id = ok.id) AS t FROM ok) SELECT family, count(*) FILTER (h) AS same_place, count(*) FILTER (NOT h AND t) AS moved, count(*) FILTER (NOT t) AS gone FROM s GROUP BY family")
def chunks_preserved(spark, sf_dir):
    old, new = base.trees(spark, sf_dir)
    return trees.preserved(_tree_chunks(old), _tree_chunks(new), ["family"])


ENTRIES = f"""SELECT 'dir' || CAST(c_custkey % 7 AS STRING) || '/' || {base.ENTRY_NAME} AS path, CASE WHEN c_custkey % 9 = 2 THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN c_custkey % 9 = 2 THEN 'f' || CAST(c_custkey + 7 AS STRING) END AS link FROM {{0}}
    UNION ALL SELECT DISTINCT 'dir' || CAST(c_custkey % 5 AS STRING), 'directory', CAST(NULL AS STRING) FROM {{0}}
    UNION ALL SELECT 'dir' || CAST(c_custkey % 7 AS STRING) || '/F' || CAST(c_custkey AS STRING), 'file', CAST(NULL AS STRING) FROM {{0}} WHERE c_custkey % 10 = 3"""


@query(
    f"""WITH e AS ({ENTRIES.format('customer')}), r AS (SELECT *, count(*) OVER (PARTITION BY lower(path)) AS twins, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent FROM e),
    p AS (SELECT path, any_value(kind) AS kind FROM e WHERE path LIKE 'dir_' GROUP BY path),
    f AS (SELECT r.path, CASE WHEN r.path LIKE '%.' THEN 'path_component' WHEN NOT regexp_full_match(r.path, '[A-Za-z0-9._/-]*') THEN 'path_character' WHEN r.path LIKE '%/aux.%' THEN 'path_device' WHEN twins > 1 THEN 'case_collision'
        WHEN parent IS NOT NULL AND p.path IS NULL THEN 'parent' WHEN r.kind = 'symlink' AND NOT EXISTS (SELECT 1 FROM e WHERE e.path = r.parent || '/' || r.link AND e.kind <> 'symlink') THEN 'link' END AS fault FROM r LEFT JOIN p ON p.path = r.parent)
    SELECT path, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL"""
)
def tree_validity(spark, sf_dir):
    base.read(spark, sf_dir, "customer").createOrReplaceTempView("corestrata_customer")
    entries = spark.sql(ENTRIES.format("corestrata_customer")).withColumn("tree", F.lit(1))
    return trees.faults(entries, ["tree"]).groupBy("path", "fault").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH e AS (SELECT n_nationkey, 'file' AS kind, 'r' || n_regionkey || '/n' || n_nationkey AS path, 10 + n_nationkey AS length, sha256(encode(n_name)) AS sha, n_nationkey % 2 = 0 AS ex, NULL AS link FROM nation UNION ALL SELECT NULL, 'directory', 'r' || r_regionkey, 0, NULL, false, NULL FROM region UNION ALL SELECT NULL, 'symlink', 'r' || r_regionkey || '/z', 0, NULL, false, 'n' || r_regionkey FROM region)
    SELECT sha256(unhex('{fixed.TREE_DOMAIN.hex()}' || {_le('count(*)', 4)} || string_agg(CASE kind WHEN 'directory' THEN '01' WHEN 'file' THEN '02' ELSE '03' END || {_le('octet_length(encode(path))', 4)} || lower(hex(encode(path))) || CASE kind WHEN 'file' THEN {_le('length', 8)} || sha || CASE WHEN ex THEN '01' ELSE '00' END WHEN 'symlink' THEN {_le('octet_length(encode(link))', 4)} || lower(hex(encode(link))) ELSE '' END, '' ORDER BY encode(path)))) AS tree_id FROM e"""
)
def tree_identity(spark, sf_dir):
    nation, region = base.read(spark, sf_dir, "nation"), base.read(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    files = nation.select(F.expr("'r' || n_regionkey || '/n' || n_nationkey").alias("path"), F.lit("file").alias("kind"), (10 + F.col("n_nationkey")).cast("long").alias("length"), F.sha2("n_name", 256).alias("sha256"), (F.col("n_nationkey") % 2 == 0).alias("exec"), none.alias("link"))
    dirs = region.select(F.expr("'r' || r_regionkey").alias("path"), F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("length"), none.alias("sha256"), F.lit(False).alias("exec"), none.alias("link"))
    links = region.select(F.expr("'r' || r_regionkey || '/z'").alias("path"), F.lit("symlink").alias("kind"), F.lit(0).cast("long").alias("length"), none.alias("sha256"), F.lit(False).alias("exec"), F.expr("'n' || r_regionkey").alias("link"))
    return identity.tree_identities(files.unionByName(dirs).unionByName(links).withColumn("tree", F.lit(1)), ["tree"]).drop("tree")


@query(
    f"""WITH {SQL_HISTORIES}, bb AS (SELECT s.family, s.to_version AS version, b FROM v JOIN steps s ON v.family = s.family AND v.version = s.from_version), bt AS MATERIALIZED (SELECT s.family, s.to_version AS version, encode('>') || v.b AS b FROM v JOIN steps s ON v.family = s.family AND v.version = s.to_version),
    {sql_chunks('kb', 'bb', 'family, version', 64)}, {sql_chunks('kt', 'bt', 'family, version', 64)}
    SELECT kt.family, kt.version, idx, len, CASE WHEN EXISTS (SELECT 1 FROM kb WHERE kb.family = kt.family AND kb.version = kt.version AND kb.id = kt.id) THEN 'EXACT_WHOLE_AT_CDC_BOUNDARY' WHEN contains(bb.b::VARCHAR, bt.b[off + 1 : off + len]::VARCHAR) THEN 'EXACT_WHOLE_ONLY_UNALIGNED' ELSE 'NO_WHOLE_EXACT_BYTES' END AS alignment
    FROM kt JOIN bb ON bb.family = kt.family AND bb.version = kt.version JOIN bt ON bt.family = kt.family AND bt.version = kt.version"""
)
def chunk_alignment(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    t = t.withColumn("bytes", F.concat(F.lit(b">"), "bytes"))
    return trees.alignment(chunking.fixed_chunks(b, 64), chunking.fixed_chunks(t, 64, payload=True), b, PAIR)


# Patches

_CDC_NEED = f"""{SQL_HISTORIES}, kk AS MATERIALIZED ({cdc_sql(SMALL, f"WITH {SQL_HISTORIES} SELECT family || '/' || version AS content_id, b FROM v")}),
    need AS (SELECT s.family, s.to_version AS version, t.idx, t.id, t.len, row_number() OVER (PARTITION BY s.family, s.to_version, t.id ORDER BY t.idx) AS rn FROM steps s JOIN kk t ON t.content_id = s.family || '/' || s.to_version WHERE NOT EXISTS (SELECT 1 FROM kk b WHERE b.content_id = s.family || '/' || s.from_version AND b.id = t.id))"""


@query(
    f"""WITH {sql_pairs()}, {PLAN_SQL}, s AS (SELECT family, version, target_chunks AS c, unique_missing_chunks AS e FROM plan)
    SELECT family, version, CAST({_SQL_MANIFEST.format('c')} AS BIGINT) AS manifest_bytes, CAST({_SQL_PATCH.format('c', 'e')} AS BIGINT) AS framing_bytes FROM s"""
)
def framing_cost(spark, sf_dir):
    planned = reuse.plan(*base.pair_chunks(spark, sf_dir), PAIR)
    return patches.framing(planned, F.col("target_chunks"), F.col("unique_missing_chunks"), F.lit(0)).select(*PAIR, "manifest_bytes", "framing_bytes")


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, idx, len <= 200 AND NOT starts_with(lower(hex(b[off + 1 : off + len])), '54') AS usable, len + 32 * (idx % 5) AS cost FROM k JOIN d USING (content_id)")
def dictionary_usable(spark, sf_dir):
    """The rule with a smaller bound and a one-letter magic, so that both sides of it occur."""
    chunks = chunking.fixed_chunks(base.documents(spark, sf_dir).drop("family"), 256, payload=True)
    return chunks.select("content_id", "idx", patches.usable(F.col("payload"), 200, b"T").alias("usable"), patches.dictionary_cost(F.col("len"), F.col("idx") % 5).alias("cost"))


@query(f"WITH {SQL_HISTORIES} SELECT s.family, s.to_version AS version, sha256(b) AS sha256, CAST(octet_length(b) AS BIGINT) AS bytes FROM v JOIN steps s ON v.family = s.family AND v.version = s.to_version")
def apply_roundtrip(spark, sf_dir):
    """Patches created and applied relationally; the result is the target."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.roundtrip(b, t, PAIR, SMALL, level=3).select(*PAIR, F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").cast("long").alias("bytes"))


@query(f"WITH {SQL_HISTORIES} SELECT s.family, s.to_version AS version, sha256(b) AS sha256, 0::BIGINT AS flags FROM v JOIN steps s ON v.family = s.family AND v.version = s.to_version")
def patch_files(spark, sf_dir):
    """The same through binary manifests and patches."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    made = patches.patch_files(b, t, PAIR, STABLE, level=1)
    return patches.apply_files(made, PAIR).select(*PAIR, F.sha2("bytes", 256).alias("sha256"), "flags")


@query()
def encode_choice(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.entries(b, t, PAIR, SMALL, level=3).select(*PAIR, "idx", "encoding", "stored_len", "dict_count", "choice")


@query()
def encode_ranked(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.entries(b, t, PAIR, SMALL, level=3, ranked=True).select(*PAIR, "idx", "encoding", "stored_len", "dict_count", "choice")


@query()
def candidate_trace(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.trace(b, t, PAIR, SMALL, level=1)


@query(f"WITH {_CDC_NEED} SELECT family, version, count(*) AS entries, count(*) AS raw_entries, 0::BIGINT AS zstd_entries, 0::BIGINT AS dictionary_entries, 0::BIGINT AS references, CAST(sum(len) AS BIGINT) AS stored_bytes, 1::BIGINT AS blocks FROM need WHERE rn = 1 GROUP BY ALL")
def patch_entries_raw(spark, sf_dir):
    """Entry statistics by pair, of entries stored as they are."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.statistics(patches.entries(b, t, PAIR, SMALL, level=0, run=0), PAIR)


@query()
def patch_entries(spark, sf_dir):
    """Entry statistics by pair, and their blocks."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.statistics(patches.entries(b, t, PAIR, SMALL, level=1), PAIR)


@query()
def encoding_study(spark, sf_dir):
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    return patches.study(b, t, PAIR, SMALL, level=3)


@query(f"WITH {sql_pairs()}, {PLAN_SQL} SELECT version % 3 AS lane, CAST(sum(CASE WHEN reused_chunks = 0 THEN 0 WHEN version % 3 = 0 THEN 64 WHEN version % 3 = 1 THEN 0 ELSE 64 END) AS BIGINT) AS flags FROM plan GROUP BY 1")
def base_binding(spark, sf_dir):
    """Pairs that depend on a base which is missing (lane 0), right (1) or another one (2)."""
    b, t = base.pair_chunks(spark, sf_dir)
    need = reuse.depends_on_base(t, _payload(b, t), PAIR)
    given = need.select(*PAIR, "depends", F.when(F.col("version") % 3 != 0, F.lit(fixed.SHA256_SUITE)).alias("base_suite"), F.lit(fixed.SHA256_SUITE).alias("suite"), F.lit(0).alias("base_flags"), F.lit("right").alias("expected"), F.when(F.col("version") % 3 == 1, "right").when(F.col("version") % 3 == 2, "other").alias("base_id"))
    return patches.binding(given).groupBy((F.col("version") % 3).alias("lane")).agg(F.sum("flags").cast("long").alias("flags"))


# Values


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, idx, regexp_full_match(id, '[0-9a-f]{{64}}') AS valid, regexp_full_match(upper(id), '[0-9a-f]{{64}}') AS valid_upper, substr(id, 1, 16) AS head FROM k")
def hash_text(spark, sf_dir):
    k = base.document_chunks(spark, sf_dir)
    hexed = lambda c: c.rlike("^[0-9a-f]{64}$")
    return k.select("content_id", "idx", hexed(F.col("id")).alias("valid"), hexed(F.upper("id")).alias("valid_upper"), F.lower(F.hex(F.substring(F.unhex("id"), 1, 8))).alias("head"))


@query("SELECT p_partkey, regexp_full_match(lower(replace(p_name, ' ', '.')), '[a-z0-9][a-z0-9._-]{0,127}') AS valid, regexp_full_match(p_name, '[a-z0-9][a-z0-9._-]{0,127}') AS valid_raw FROM part")
def identifier_grammar(spark, sf_dir):
    from corestrata.functions.profiles import ID_PATTERN

    part = base.read(spark, sf_dir, "part")
    return part.select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("."))).rlike(ID_PATTERN).alias("valid"), F.col("p_name").rlike(ID_PATTERN).alias("valid_raw"))


@query("SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS fingerprint FROM orders")
def definition_fingerprint(spark, sf_dir):
    return base.read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("fingerprint"))


@query(f"""WITH {sql_pairs()}, {PLAN_SQL} SELECT family, version, '{{"targetChunks":' || target_chunks || ',"reusedBytes":' || reused_bytes || '}}' AS report FROM plan""")
def json_report(spark, sf_dir):
    planned = reuse.plan(*base.pair_chunks(spark, sf_dir), PAIR)
    return planned.select(*PAIR, F.to_json(F.struct(F.col("target_chunks").alias("targetChunks"), F.col("reused_bytes").alias("reusedBytes"))).alias("report"))


@query(f"WITH {SQL_DOCUMENT_CHUNKS} SELECT content_id, off || chr(9) || len || chr(9) || id AS line FROM k")
def chunk_dump(spark, sf_dir):
    return base.document_chunks(spark, sf_dir).select("content_id", F.concat_ws("\t", F.col("off").cast("string"), F.col("len").cast("string"), "id").alias("line"))


@query()
def content_kinds(spark, sf_dir):
    return patches.classified(base.documents(spark, sf_dir).drop("family"))


@query(
    """WITH r AS (SELECT CASE WHEN p_partkey % 40 = 1 THEN 'x' || (p_partkey + 1) ELSE 'x' || p_partkey END AS id, CASE WHEN p_partkey % 30 = 7 THEN 'lost' WHEN p_size < 20 THEN 'open' ELSE 'done' END AS status FROM part WHERE p_partkey % 17 <> 3),
    i AS (SELECT CASE WHEN p_partkey % 50 = 9 THEN '' ELSE 'x' || p_partkey END AS id, CASE WHEN p_size < 21 THEN 'open' ELSE 'done' END AS status FROM part WHERE p_partkey % 13 <> 3),
    rg AS (SELECT id, min(status) AS registered, count(*) AS n, count(*) FILTER (status NOT IN ('open', 'done')) AS bad FROM r GROUP BY id), ig AS (SELECT id, min(status) AS indexed, count(*) AS n, count(*) FILTER (status NOT IN ('open', 'done')) AS bad FROM i GROUP BY id),
    f AS (SELECT coalesce(rg.id, ig.id) AS id, registered, indexed, rg.n AS rn, ig.n AS inn, coalesce(rg.bad, 0) + coalesce(ig.bad, 0) AS bad FROM rg FULL JOIN ig ON rg.id = ig.id)
    SELECT id, 'no_id' AS fault, registered, indexed FROM f WHERE id = '' UNION ALL SELECT id, 'repeated', registered, indexed FROM f WHERE rn > 1 OR inn > 1 UNION ALL SELECT id, 'status', registered, indexed FROM f WHERE bad > 0
    UNION ALL SELECT id, 'unregistered', registered, indexed FROM f WHERE rn IS NULL UNION ALL SELECT id, 'unindexed', registered, indexed FROM f WHERE inn IS NULL UNION ALL SELECT id, 'disagree', registered, indexed FROM f WHERE registered <> indexed"""
)
def registry_faults(spark, sf_dir):
    part = base.read(spark, sf_dir, "part")
    registry = part.where("p_partkey % 17 <> 3").selectExpr("CASE WHEN p_partkey % 40 = 1 THEN 'x' || CAST(p_partkey + 1 AS STRING) ELSE 'x' || CAST(p_partkey AS STRING) END AS id", "CASE WHEN p_partkey % 30 = 7 THEN 'lost' WHEN p_size < 20 THEN 'open' ELSE 'done' END AS status")
    index = part.where("p_partkey % 13 <> 3").selectExpr("CASE WHEN p_partkey % 50 = 9 THEN '' ELSE 'x' || CAST(p_partkey AS STRING) END AS id", "CASE WHEN p_size < 21 THEN 'open' ELSE 'done' END AS status")
    return families.registry_faults(registry, index, ["open", "done"])


LAB_LANES = {"fixed-256": 256, "fixed-1024": 1024}
LAB_JOBS = [("append-300", "append", 300, 5), ("insert-90", "insert", 90, 6), ("delete-200", "delete", 200, 7), ("identity", "identity", 0, 0)]


LAB_EDITS = f"""{SQL_DOCUMENTS}, s AS (SELECT content_id, b, octet_length(b) AS n FROM d), ed AS (
    SELECT content_id, 'append-300' AS mutation, b || {_fill('fill', 5, 300)} AS b, n + 300 AS affected_end, 300 AS changed_bytes FROM s
    UNION ALL SELECT content_id, 'insert-90', b[1:{_draw('place', 6, 'n + 1')}] || {_fill('fill', 6, 90)} || b[{_draw('place', 6, 'n + 1')} + 1:n], {_draw('place', 6, 'n + 1')} + 90, 90 FROM s
    UNION ALL SELECT content_id, 'delete-200', b[1:{_draw('place', 7, 'n - least(200, n) + 1')}] || b[{_draw('place', 7, 'n - least(200, n) + 1')} + least(200, n) + 1:n], {_draw('place', 7, 'n - least(200, n) + 1')}, least(200, n) FROM s
    UNION ALL SELECT content_id, 'identity', b, 0, 0 FROM s), src AS (SELECT ed.content_id, mutation, s.b FROM ed JOIN s USING (content_id))"""


def _lab_sql(size: int) -> str:
    return f"""(WITH {LAB_EDITS}, {sql_chunks('ks', 'src', 'content_id, mutation', size)}, {sql_chunks('kt', 'ed', 'content_id, mutation', size)},
    h AS (SELECT content_id, mutation, sum(len) FILTER (EXISTS (SELECT 1 FROM ks WHERE ks.content_id = kt.content_id AND ks.mutation = kt.mutation AND ks.id = kt.id)) AS reused, sum(len) AS total, count(*) AS n FROM kt GROUP BY ALL), c AS (SELECT content_id, mutation, count(*) AS n FROM ks GROUP BY ALL),
    bs AS (SELECT content_id, mutation, lag(id) OVER w AS l, lag(len) OVER w AS ll, id AS r, len AS rl, idx FROM ks WINDOW w AS (PARTITION BY content_id, mutation ORDER BY idx)), bt AS (SELECT content_id, mutation, lag(id) OVER w AS l, lag(len) OVER w AS ll, id AS r, len AS rl, idx FROM kt WINDOW w AS (PARTITION BY content_id, mutation ORDER BY idx)),
    ga AS (SELECT content_id, mutation, l, ll, r, rl, count(*) AS n FROM bs WHERE idx > 0 GROUP BY ALL), gb AS (SELECT content_id, mutation, l, ll, r, rl, count(*) AS n FROM bt WHERE idx > 0 GROUP BY ALL), sv AS (SELECT ga.content_id, ga.mutation, sum(least(ga.n, coalesce(gb.n, 0))) / sum(ga.n) AS survival FROM ga LEFT JOIN gb USING (content_id, mutation, l, ll, r, rl) GROUP BY ALL),
    rs AS (SELECT *, row_number() OVER (PARTITION BY content_id, mutation ORDER BY idx DESC) AS q FROM ks), rt AS (SELECT *, row_number() OVER (PARTITION BY content_id, mutation ORDER BY idx DESC) AS q FROM kt),
    eq AS (SELECT rt.content_id, rt.mutation, rt.idx, rt.off, min(CASE WHEN coalesce(rs.id = rt.id AND rs.len = rt.len, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rt.content_id, rt.mutation ORDER BY rt.q ROWS UNBOUNDED PRECEDING) AS eq FROM rt LEFT JOIN rs USING (content_id, mutation, q)),
    met AS (SELECT content_id, mutation, min(off) AS met FROM eq JOIN ed USING (content_id, mutation) WHERE eq = 1 AND idx >= 1 AND off >= affected_end GROUP BY ALL)
    SELECT content_id, mutation, 'fixed-{size}' AS lane, CAST(changed_bytes AS BIGINT) AS changed_bytes, coalesce(c.n, 0) AS source_chunks, coalesce(h.n, 0) AS target_chunks, CAST(coalesce(reused, 0) AS BIGINT) AS reused_bytes, CAST(coalesce(total, 0) - coalesce(reused, 0) AS BIGINT) AS missing_bytes, round(coalesce(survival, 1), 6) AS survival,
    CASE WHEN changed_bytes <> 0 AND affected_end < octet_length(ed.b) THEN CAST(met - affected_end AS BIGINT) END AS resync_distance, CASE WHEN changed_bytes = 0 OR affected_end >= octet_length(ed.b) THEN 'not-applicable' WHEN met IS NULL THEN 'not-resynchronized' ELSE 'resynchronized' END AS resync_status
    FROM ed LEFT JOIN c USING (content_id, mutation) LEFT JOIN h USING (content_id, mutation) LEFT JOIN sv USING (content_id, mutation) LEFT JOIN met USING (content_id, mutation))"""


LAB_SQL = " UNION ALL ".join(map(_lab_sql, LAB_LANES.values()))


@query(LAB_SQL)
def lab_run(spark, sf_dir):
    """Two lanes of fixed chunks over all documents and four seeded edits."""
    return rounded(lab.run(base.documents(spark, sf_dir).drop("family"), LAB_LANES, LAB_JOBS))


@query()
def lab_run_cdc(spark, sf_dir):
    """Content-defined lanes over the other kinds of edits."""
    jobs = [(k, k, 64, 7 + i) for i, k in enumerate(mutations.KINDS)]
    return rounded(lab.run(base.documents(spark, sf_dir).drop("family"), {"small": SMALL, "warm": WARM}, jobs))


@query(
    f"""WITH l AS ({LAB_SQL}), g AS (SELECT lane, mutation, count(*) AS contents, round(avg(survival), 5) AS survival, CAST(sum(reused_bytes) AS BIGINT) AS reused_bytes, CAST(sum(missing_bytes) AS BIGINT) AS missing_bytes, round(avg(CASE WHEN resync_status = 'resynchronized' THEN 1.0 ELSE 0 END), 6) AS resynchronized FROM l GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (ORDER BY encode(lane), encode(mutation), contents) AS INT) AS position FROM g"""
)
def lab_report(spark, sf_dir):
    done = lab.report(lab.run(base.documents(spark, sf_dir).drop("family"), LAB_LANES, LAB_JOBS))
    return rounded(done.withColumn("survival", F.round("survival", 5)))


@query()
def bootstrap_ratios(spark, sf_dir):
    """Overhead of net over list price by return flag."""
    lines = base.read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("lane"), F.col("l_extendedprice").alias("off"))
    return rounded(metrics.bootstrap_ratios(lines, ["l_returnflag"], "lane", "off", rounds=200))


_POLICY = "CASE p_partkey % 6 WHEN 0 THEN 'raw' WHEN 1 THEN 'wide' WHEN 2 THEN 'sweep-L' || p_partkey % 25 || '-K' || p_partkey % 7 || '-C' || CASE WHEN p_partkey % 4 = 0 THEN 9 ELSE 8 END WHEN 3 THEN 'enc-L19-K' || p_partkey % 5 || '-C16-' || CASE WHEN p_partkey % 2 = 0 THEN 'copy' ELSE 'prefix' END WHEN 4 THEN 'enc-L9-K4-C8-attach-H' || p_partkey % 30 || 'C18' ELSE p_name END"


@query(
    f"""WITH n AS (SELECT p_partkey, {_POLICY} AS name FROM part), r AS (SELECT *, regexp_extract(name, '{policies.LANE}', ['l1', 'k1', 'c1', 'l2', 'k2', 'c2', 'load', 'h', 'c']) AS m FROM n),
    x AS (SELECT *, TRY_CAST(coalesce(nullif(m.l1, ''), m.l2) AS INT) AS l, TRY_CAST(coalesce(nullif(m.k1, ''), m.k2) AS INT) AS k, TRY_CAST(coalesce(nullif(m.c1, ''), m.c2) AS INT) AS cc, TRY_CAST(nullif(m.h, '') AS INT) AS hl, TRY_CAST(nullif(m.c, '') AS INT) AS cl FROM r),
    y AS (SELECT *, coalesce(name IN ('raw', 'wide') OR (l BETWEEN 1 AND 22 AND k BETWEEN 1 AND 4 AND cc IN (8, 16) AND coalesce(hl BETWEEN 6 AND 27, true) AND coalesce(cl BETWEEN 6 AND 27, true)), false) AS known FROM x)
    SELECT p_partkey, name, known, CASE WHEN known THEN CASE name WHEN 'raw' THEN 0 WHEN 'wide' THEN 9 ELSE l END END AS level, CASE WHEN known THEN CASE name WHEN 'raw' THEN 0 WHEN 'wide' THEN 4 ELSE k END END AS chunks, CASE WHEN known THEN CASE name WHEN 'raw' THEN 0 WHEN 'wide' THEN 16 ELSE cc END END AS candidates,
        CASE WHEN known THEN CASE WHEN name = 'raw' THEN 0 WHEN name = 'wide' OR cc = 16 THEN 1048576 ELSE 262144 END END AS radius, CASE WHEN known THEN false END AS ranked, CASE WHEN known THEN nullif(m.load, '') END AS load, CASE WHEN known THEN hl END AS hash_log, CASE WHEN known THEN cl END AS chain_log FROM y"""
)
def policy_names(spark, sf_dir):
    return policies.parsed(base.read(spark, sf_dir, "part").select("p_partkey", F.expr(_POLICY).alias("name")))


@query(f"WITH {_CDC_NEED}, p AS (SELECT family, version, count(*) AS entries FROM need WHERE rn = 1 GROUP BY ALL) SELECT family, version, unnest(['raw', 'plain', 'sweep-L3-K2-C8']) AS lane, entries, true AS sound FROM p")
def policy_sweep(spark, sf_dir):
    """Entries of three lanes; sound: raw stores the missing bytes as they are, no lane more than that, and only the lane with dictionaries refers to any."""
    b, t = base.pair_contents(base.histories(spark, sf_dir))
    lanes = policies.sweep(b, t, PAIR, SMALL, ["raw", "plain", "sweep-L3-K2-C8"])
    need = reuse.plan(chunking.cdc_chunks(b, SMALL), chunking.cdc_chunks(t, SMALL), PAIR).select(*PAIR, "unique_missing_bytes")
    fits = F.when(F.col("lane") == "raw", F.col("stored_bytes") == F.col("unique_missing_bytes")).otherwise(F.col("stored_bytes") <= F.col("unique_missing_bytes")) & ((F.col("lane") == "sweep-L3-K2-C8") | (F.col("references") == 0))
    return lanes.join(need, PAIR).select(*PAIR, "lane", "entries", fits.alias("sound"))
