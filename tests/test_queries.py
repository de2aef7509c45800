"""Every registered query with SQL against DuckDB; plans; invariance under partitioning; files, streams and the command line."""

import glob
import hashlib
import json
import math
import os
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corestrata import cli
from corestrata.functions import fixed, hashing
from corestrata.functions.cutting import cut, cut_plainly
from corestrata.functions.profiles import SMALL, STABLE, Profile, lab_profile
from corestrata.operators import candidates, chunking, envelopes, families, identity, incremental, lab, metrics, mutations, patches, policies, reuse, trees
from corestrata.operators.arrow import each_row
from corestrata.plans import base
from corestrata.plans.queries import ORACLES, QUERIES
from corestrata.sources import corpus, files, manifests
from corestrata.streaming import stateful

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALLEST}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALLEST)
    cols = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    run = duck.execute(ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    assert got == Counter(repr([plain(row[names.index(c)]) for c in cols]) for row in run.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SMALLEST).count() > 0


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    b, t = base.pair_chunks(spark, SMALLEST)
    near = plan(candidates.nearest_starts(b, t, base.PAIR, 512, 4))
    assert "NestedLoop" not in near and "WindowGroupLimit" in near
    assert re.search("LeftSemi", plan(reuse.reused(b, t, base.PAIR))) and re.search("LeftAnti", plan(reuse.missing(b, t, base.PAIR)))
    for name in QUERIES:
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SMALLEST)), name
    fixed_plan = plan(QUERIES["chunk_fixed"](spark, SMALLEST))
    assert "Exchange" not in fixed_plan and "Python" not in fixed_plan and "struct<doc_id:bigint,text:string>" in fixed_plan


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_partitioning_changes_nothing(spark, partitions):
    content = base.documents(spark, SMALLEST).drop("family")
    ids = lambda c: sorted((r.content_id, r.manifest_id) for r in identity.manifest_ids(chunking.cdc_chunks(c, SMALL), ["content_id"], fixed.SHA256_SUITE, SMALL.profile_id, SMALL.fingerprint(), c).collect())
    assert ids(content) == ids(content.repartition(partitions))


def test_empty_and_null_contents(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "k long, text string")
    content = chunking.contents(table, {"k": "k"}, F.col("text"))
    assert [(r.k, r.len) for r in chunking.fixed_chunks(content, 2).orderBy("k", "idx").collect()] == [(3, 2), (3, 1)]
    assert [(r.k, r.len) for r in chunking.cdc_chunks(content, SMALL).collect()] == [(3, 3)]
    seen = chunking.cdc_chunks(content, SMALL, on_chunk=lambda i, at, raw: raw[::-1]).collect()
    assert [bytes(r.value) for r in seen] == [b"cba"]
    ids = identity.manifest_ids(chunking.fixed_chunks(content, 2), ["k"], fixed.SHA256_SUITE, SMALL.profile_id, SMALL.fingerprint(), content)
    assert ids.count() == 3 and ids.where("chunks = 0").count() == 2
    assert reuse.plan(chunking.fixed_chunks(content, 2), chunking.fixed_chunks(content, 2).limit(0), ["k"]).count() == 0
    none = chunking.cdc_chunks(content.limit(0), SMALL)
    assert none.count() == 0 and metrics.dedup_summary(none, ["k"]).count() == 0


def test_payload_is_found_before_base(spark):
    keys = ["k"]
    rows = lambda r: spark.createDataFrame(r, "k long, idx long, off long, len long, id string")
    b, t = rows([(1, 0, 0, 5, "a"), (1, 1, 5, 5, "a"), (1, 2, 10, 9, "c")]), rows([(1, 0, 0, 5, "a"), (1, 1, 5, 5, "b"), (1, 2, 10, 5, "c"), (1, 3, 15, 1, "d")])
    p = spark.createDataFrame([(1, "b")], "k long, id string")
    got = {r.idx: (r.source, r.base_off) for r in reuse.locate(b, t, p, keys).collect()}
    assert got == {0: ("base", 0), 1: ("payload", None), 2: ("wrong_length", 10), 3: ("missing", None)}


def test_nested_intervals_merge(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 10, 12), (1, 20, 21), (1, 5, 5)], "k long, start long, stop long")
    assert metrics.coverage(rows, ["k"]).first()[1:] == (2, 13)
    assert metrics.clipped(rows, F.lit(1), F.lit(11)).count() == 3


def test_incremental_of_several_edits(spark):
    rnd = random.Random(1)
    data = rnd.randbytes(8000)
    new = data[:1000] + b"one" + data[1000:4000] + data[4100:7000] + b"three" + data[7000:]
    splices = [(1000, 1000, 1003), (4003, 4103, 4003), (6903, 6903, 6908)]
    old = chunking.cdc_chunks(spark.createDataFrame([(1, data)], "k long, bytes binary"), SMALL)
    edited = spark.createDataFrame([(1, new, splices)], "k long, bytes binary, splices array<struct<start:long,old_end:long,new_end:long>>")
    assert [r.len for r in incremental.rechunk(old, edited, ["k"], SMALL).orderBy("idx").collect()] == cut(new, SMALL)


def test_envelopes(spark):
    b, t = base.pair_contents(base.histories(spark, SMALLEST))
    tried = envelopes.trials(b, t, base.PAIR, SMALL, level=3)
    rows, by = tried.collect(), {}
    for r in rows:
        by.setdefault((r.family, r.version, r.idx), []).append(r)
    sizes = {(r.family, r.version, r.idx): r.len for r in chunking.cdc_chunks(t, SMALL).collect()}
    for key, some in by.items():
        plain = [r for r in some if r.envelope == 0]
        best, won = plain[0].cost, plain[0]
        assert len(plain) == 1 and best <= sizes[key]
        for r in some[1:]:
            assert (r.cost is None) == r.repeated and r.records <= fixed.ENVELOPES[r.envelope][1] and 0 < r.dictionary_bytes <= fixed.ENVELOPES[r.envelope][2]
            if not r.repeated and r.cost < best:
                best, won = r.cost, r
        assert [r for r in some if r.selected] == [won]
    lanes = {(r.family, r.version, r.lane): r for r in envelopes.lanes(tried, base.PAIR).collect()}
    for (f, v, lane), r in lanes.items():
        mine = [min(x.cost for x in some if x.envelope <= lane and x.cost is not None) for (a, b_, _), some in by.items() if (a, b_) == (f, v)]
        assert (r.entries, r.cost) == (len(mine), sum(mine)) and r.saved == lanes[f, v, 0].cost - r.cost
    assert envelopes.trials(b.limit(0), t.limit(0), base.PAIR, SMALL).count() == 0


def test_ledgers_sum_to_the_patch(spark):
    b, t = base.pair_contents(base.histories(spark, SMALLEST))
    made = patches.patch_files(b, t, base.PAIR, STABLE, level=1)
    told = {(r.family, r.version): sum(r[2:]) for r in patches.ledgers(made, base.PAIR).collect()}
    assert told == {(r.family, r.version): len(r.patch) for r in made.collect()}


def test_rename_reasons(spark):
    rows = lambda r: spark.createDataFrame([("t", *x) for x in r], "tree string, path string, length long, sha256 string")
    old = rows([("d/a_1.0.0.0.dll", 100, "1"), ("d/b_1.0.0.0.dll", 100, "2"), ("d/b_1.1.0.0.dll", 100, "3"), ("d/c_1.0.0.0.dll", 100, "4")])
    new = rows([("d/a_1.0.0.1.dll", 120, "5"), ("d/b_2.0.0.0.dll", 100, "6"), ("d/c_2.0.0.0.dll", 100, "7"), ("d/c_3.0.0.0.dll", 100, "8"), ("d/x.txt", 100, "9"), ("d/e_1.0.0.0.dll", 100, "0"), ("d/f_1.0.0.0.dll", 0, "0")])
    got = {r.target_path: r.outcome for r in trees.rename_pairs(old, new, ["tree"], least=1).collect()}
    assert got == {"d/a_1.0.0.1.dll": "paired", "d/b_2.0.0.0.dll": "ambiguous_source_candidates", "d/c_2.0.0.0.dll": "source_claimed_by_multiple_targets", "d/c_3.0.0.0.dll": "source_claimed_by_multiple_targets", "d/x.txt": "nonversioned_filename", "d/e_1.0.0.0.dll": "no_unique_structural_source", "d/f_1.0.0.0.dll": "target_size_out_of_bounds"}


def test_families_weigh_alike(spark):
    columns = "lane string, history string, scope string, mean_bytes double, reuse_ratio double, missing_ratio double, survival double, max_cut_rate double"
    rows = spark.createDataFrame([("a", "full-history", "adjacent", 10.0, 0.5, 0.5, 0.4, 0.1), ("a", "pair-only", "adjacent", 99.0, 0.0, 1.0, 0.0, 0.9), ("b", "pair-only", "adjacent", 1.0, 0.3, 0.2, 0.1, 0.2)], columns)
    got = {r.lane: r for r in families.across_families(rows, ["lane"]).collect()}
    assert (got["a"].families, got["a"].compared, got["a"].mean_reuse, got["a"].worst_max_cut_rate) == (2, 1, 0.5, 0.1)
    assert got["b"].compared == 0 and got["b"].mean_reuse is None


def test_patch_relations(spark):
    rnd = random.Random(2)
    one = rnd.randbytes(3000)
    b = spark.createDataFrame([(1, one), (2, b""), (3, b"x")], "k long, bytes binary")
    t = spark.createDataFrame([(1, one[:1500] + b"change" + one[1500:]), (2, b"new"), (3, b"")], "k long, bytes binary")
    got = {r.k: bytes(r.bytes) for r in patches.roundtrip(b, t, ["k"], SMALL, 1).collect()}
    assert got == {r.k: bytes(r.bytes) for r in t.collect()}
    made = patches.patch_files(b, t, ["k"], SMALL, SMALL.profile_id, level=1)
    assert {r.k: bytes(r.bytes) for r in patches.apply_files(made, ["k"]).collect()} == got
    broken = made.withColumn("patch", F.when(F.col("k") == 1, F.substring("patch", F.lit(1), F.octet_length("patch") - 1)).otherwise(F.col("patch")))
    assert {r.k: r.error for r in patches.apply_files(broken, ["k"]).collect()}[1].startswith("malformed")
    total = {r.k: sum(r[1:]) for r in patches.ledgers(made, ["k"]).collect()}
    assert total == {r.k: len(r.patch) for r in made.collect()}
    assert patches.wanted_starts(chunking.cdc_chunks(b, SMALL), chunking.cdc_chunks(t, SMALL), ["k"]).count() > 0


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {f"f{i}": corpus.generate("random", 1000 * i + 1, i) for i in range(5)}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    read = files.read_contents(spark, str(folder))
    made = files.build_manifests(read, index=True)
    files.register(spark)
    named = made.select(F.concat(F.regexp_extract("path", "[^/]+$", 0), F.lit(".csm")).alias("name"), F.col("manifest").alias("content"))
    named.write.format("binary_files").option("path", str(tmp_path / "out")).mode("append").save()
    back = files.read_manifests(spark, str(tmp_path / "out"))
    assert back.where("status = 'valid'").agg(F.sum("len")).first()[0] == sum(map(len, contents.values()))
    assert spark.read.format("binary_files").option("path", str(tmp_path / "out")).load().count() == 5
    (tmp_path / "out" / "bad.csm").write_bytes(b"CSM1 but no more")
    assert files.read_manifests(spark, str(tmp_path / "out")).where("status = 'malformed'").count() == 1
    pairs = made.join(read, "path")
    assert {r.outcome for r in files.verify_manifests(pairs).collect()} == {"valid"}
    k = chunking.cdc_chunks(read, SMALL)
    files.write_dump(k, str(tmp_path / "dump"))
    assert files.read_dump(spark, str(tmp_path / "dump")).count() == k.count()
    (tmp_path / "c.json").write_text(json.dumps({"families": [{"id": "a", "versions": [1, 2]}]}))
    assert files.read_descriptions(spark, str(tmp_path / "c.json")).select(F.explode("families.id")).first()[0] == "a"
    assert corpus.synthetic(spark, [("a", "zero", 10, 1), ("b", "random", 20, 2)]).count() == 2
    with pytest.raises(FileExistsError):
        files.publish(str(folder / "f0"), b"")
    assert sorted(os.listdir(folder)) == sorted(contents)


def test_stream_of_segments(spark, tmp_path):
    rnd = random.Random(3)
    contents = {i: rnd.randbytes(rnd.randrange(1, 6000)) for i in range(6)}
    rows = []
    for i, data in contents.items():
        parts = [data[k : k + 700] for k in range(0, len(data), 700)]
        rows += [(i, s, p, s == len(parts) - 1) for s, p in enumerate(parts)]
    rnd.shuffle(rows)
    schema = "content_id long, seq long, bytes binary, last boolean"
    for k in range(3):  # three batches, in no order
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.cut_segments(stream, SMALL).writeStream.format("memory").queryName("segment_chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM segment_chunks").orderBy("content_id", "off").collect():
        got.setdefault(r.content_id, []).append(r.len)
    assert got == {i: cut(d, SMALL) for i, d in contents.items()}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}").write_bytes(b"same content" * 100)
    chunks = chunking.cdc_chunks(stateful.file_stream(spark, str(tmp_path / "in")), SMALL)
    q = stateful.first_seen(chunks).writeStream.format("memory").queryName("new_chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.sql("SELECT count(*) AS n, count(DISTINCT id) AS d FROM new_chunks").first()
    assert n.n == n.d > 0


def test_command_line(tmp_path, capsys):
    rnd = random.Random(4)
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(rnd.randbytes(200_000))
    b.write_bytes(a.read_bytes()[:100_000] + b"edit" + a.read_bytes()[100_000:])
    at = lambda n: str(tmp_path / n)
    for x in ("a", "b"):
        assert cli.main(["manifest", "create", at(x), "-o", at(f"{x}.csm"), "--suite", "sha256"]) == cli.OK
    capsys.readouterr()
    assert cli.main(["manifest", "inspect", at("a.csm"), "--json"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["contentLength"] == 200_000
    assert cli.main(["manifest", "verify", at("a.csm"), "--content", at("a")]) == cli.OK
    assert cli.main(["manifest", "verify", at("a.csm"), "--content", at("b")]) == cli.MISMATCH
    capsys.readouterr()
    assert cli.main(["patch", "plan", at("a.csm"), at("b.csm"), "--json"]) == cli.OK
    told = json.loads(capsys.readouterr().out)
    assert told["reusedBytes"] + told["missingBytes"] == told["targetBytes"] == 200_004
    assert cli.main(["patch", "create", at("b.csm"), at("b"), "--base-manifest", at("a.csm"), "--base", at("a"), "--level", "1", "-o", at("p.csp")]) == cli.OK
    assert cli.main(["patch", "apply", at("p.csp"), "--base-manifest", at("a.csm"), "--base", at("a"), "--recheck", "boundary", "-o", at("out")]) == cli.OK
    assert (tmp_path / "out").read_bytes() == b.read_bytes()
    assert cli.main(["patch", "apply", at("p.csp"), "-o", at("no")]) == cli.MISMATCH and not os.path.exists(at("no"))
    assert cli.main(["manifest", "create", at("a"), "-o", at("a.csm")]) == cli.ERROR  # there already
    assert cli.main(["manifest", "create", at("a"), "-o", at("a"), "--force"]) == cli.ERROR
    assert cli.main(["manifest"]) == cli.USAGE and cli.main(["manifest", "inspect", at("a")]) == cli.ERROR


def test_verify_lowest_difference(spark):
    content = spark.createDataFrame([(1, b"a" * 1000)], "k long, bytes binary")
    seen = identity.verify_records(chunking.fixed_chunks(content, 100), content.withColumn("bytes", F.concat(F.substring("bytes", F.lit(1), F.lit(250)), F.lit(b"b"), F.substring("bytes", 252, F.lit(1000)))), ["k"]).first()
    assert (seen.first_bad, seen.bad, seen.whole) == (2, 1, True)
    assert manifests.names(33) == ["BlockCrc", "Content"]


# What SQL cannot express, against plain Python over the same tables


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALLEST}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def steps(spark):
    """(family, version): base and target."""
    said = {}
    for r in spark.read.parquet(f"{SMALLEST}/conversations.parquet").orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.text or ""))
    whole = {f: [(v, "\n".join(t for _, t in turns[: i + 1]).encode()) for i, (v, _) in enumerate(turns)] for f, turns in said.items()}
    return {(f, b[0]): (a[1], b[1]) for f, some in whole.items() for a, b in zip(some, some[1:], strict=False)}


def pieces(data, profile):
    at = 0
    for i, n in enumerate(cut_plainly(data, profile)):
        yield i, at, data[at : at + n]
        at += n


def wanted(base_bytes, target_bytes):
    have = {hashlib.sha256(x).digest() for _, _, x in pieces(base_bytes, SMALL)}
    for i, at, x in pieces(target_bytes, SMALL):
        if (c := hashlib.sha256(x).digest()) not in have:
            have.add(c)
            yield i, at, x, c


def test_blake3_chunks(spark, texts):
    got = {(r.content_id, r.idx): (r.off, r.len, r.id) for r in QUERIES["chunk_blake3"](spark, SMALLEST).collect()}
    assert got == {(k, i): (at, len(x), hashing.blake3(x).hex()) for k, t in texts.items() for i, at, x in pieces(t, lab_profile(4096))}


def test_super_features_and_similar_chunks(spark, texts, steps):
    got = Counter(tuple(r) for r in QUERIES["superfeatures"](spark, SMALLEST).select("content_id", "idx", "off", "key").collect())
    assert got == Counter((k, i, at, f"{f:016x}") for k, t in texts.items() for i, at, x in pieces(t, SMALL) for f in hashing.super_features(x))
    got = Counter((r.family, r.version, r.idx, r.start, r.shared, r["rank"]) for r in QUERIES["similar_chunks"](spark, SMALLEST).collect())
    want = Counter()
    for (f, v), (b, t) in steps.items():
        by = {}
        for i, at, x in pieces(b, SMALL):
            for key in hashing.super_features(x):
                by.setdefault(key, []).append((i, at))
        for i, at, x in pieces(t, SMALL):
            shared = Counter((s, abs(a - at)) for key in hashing.super_features(x) if len(by.get(key, ())) <= candidates.HOT_KEY for s, a in by.get(key, ()))
            for rank, (start, _, n) in enumerate(sorted(((s, d, n) for (s, d), n in shared.items()), key=lambda z: (-z[2], z[1], z[0]))[: candidates.MOST], 1):
                want[f, v, i, start, n, rank] += 1
    assert got == want


def test_encodings_are_the_cheapest(spark, steps):
    """Every candidate priced by plain zstd calls; the choice, the trace, the statistics and the study follow from the prices."""
    import zstandard

    def frame(raw, dictionary, level):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        return len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=False, write_dict_id=False).compress(raw))

    def options(b, at, run=4):
        records = list(pieces(b, SMALL))
        near = sorted((abs(o - at), i) for i, o, _ in records if abs(o - at) <= 256 << 10)[:8]
        return [(len(records[i : i + run]), b"".join(x for _, _, x in records[i : i + run])) for _, i in near]

    choice = {(r.family, r.version, r.idx): r for r in QUERIES["encode_choice"](spark, SMALLEST).collect()}
    trace = {(r.family, r.version, r.idx, r.ordinal): r for r in QUERIES["candidate_trace"](spark, SMALLEST).collect()}
    study = {(r.family, r.version): r for r in QUERIES["encoding_study"](spark, SMALLEST).collect()}
    entries = {(r.family, r.version): r for r in QUERIES["patch_entries"](spark, SMALLEST).collect()}
    seen = 0
    for (f, v), (b, t) in list(steps.items())[:30]:
        raw_sum = zstd_sum = n = 0
        for i, at, x, _ in wanted(b, t):
            n += 1
            for level, check in ((3, True), (1, False)):
                prices = [(len(x), -2), (frame(x, b"", level), -1)] + [(frame(x, d, level) + 32 * c, k) for k, (c, d) in enumerate(options(b, at)) if d]
                best = min(prices)
                if check:
                    r = choice[f, v, i]
                    assert (r.stored_len + 32 * r.dict_count, r.choice) == best
                    raw_sum, zstd_sum = raw_sum + len(x), zstd_sum + min(len(x), prices[1][0])
                else:
                    assert {k: trace[f, v, i, k].cost for _, k in prices} == {k: c for c, k in prices} and [k for _, k in prices if trace[f, v, i, k].selected] == [best[1]]
            seen += 1
        if n:
            assert (study[f, v].raw, study[f, v].zstd) == (raw_sum, zstd_sum) and study[f, v].full_zstd == frame(t, b"", 3)
            assert study[f, v].dict_k4 <= study[f, v].zstd <= study[f, v].raw and entries[f, v].entries == n
    assert seen > 20


def test_ranked_choices_are_candidates(spark):
    full = {(r.family, r.version, r.idx): r.stored_len + 32 * r.dict_count for r in QUERIES["encode_choice"](spark, SMALLEST).collect()}
    ranked = {(r.family, r.version, r.idx): r.stored_len + 32 * r.dict_count for r in QUERIES["encode_ranked"](spark, SMALLEST).collect()}
    assert full.keys() == ranked.keys() and all(full[k] <= ranked[k] for k in full)


def test_ledgers_add_up(spark):
    b, t = base.pair_contents(base.histories(spark, SMALLEST))
    made = patches.patch_files(b, t, base.PAIR, STABLE, level=1)
    size = {(r.family, r.version): len(r.patch) for r in made.collect()}
    got = QUERIES["patch_ledgers"](spark, SMALLEST).collect()
    assert {(r.family, r.version): sum(v for k, v in r.asDict().items() if k not in base.PAIR) for r in got} == size


def test_content_kinds_of_texts(spark, texts):
    from corestrata.functions import classify

    got = {r.content_id: (r.executable, r.architecture, r.container) for r in QUERIES["content_kinds"](spark, SMALLEST).collect()}
    assert got == {k: (*classify.executable(t)[:2], classify.container(t)[0]) for k, t in texts.items()}


def test_bootstraps_are_resamples(spark):
    """The same draws, written out value by value."""
    import numpy as np

    rnd = random.Random(1)
    values = [rnd.randrange(30) for _ in range(200)]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 5.0), ("b", None)], "k string, v double").repartition(7)
    got = {r.k: r for r in metrics.bootstrap_medians(df, ["k"], "v", seed=3, rounds=50).collect()}
    v, c = np.unique(values, return_counts=True)
    rng = np.random.default_rng(3)
    medians = [float(np.median(np.repeat(v, rng.multinomial(200, c / 200)))) for _ in range(50)]
    assert (got["a"].median, got["a"].low, got["a"].high) == (float(np.median(values)), float(np.quantile(medians, 0.025)), float(np.quantile(medians, 0.975)))
    assert tuple(got["b"])[1:] == (5.0, 5.0, 5.0)
    pairs = [(x, x + 10) for x in range(1, 40)] * 3
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in pairs] + [("z", 1.0, 0.0)], "k string, x double, y double")
    (r,) = metrics.bootstrap_ratios(df, ["k"], "x", "y", rounds=100).collect()
    assert r.overhead == pytest.approx(sum(x for x, _ in pairs) / sum(y for _, y in pairs) - 1) and r.low < r.overhead < r.high


def test_full_run_of_content_defined_lanes(spark, texts):
    got = {(r.content_id, r.mutation, r.lane): r for r in QUERIES["lab_run_cdc"](spark, SMALLEST).collect()}
    assert len(got) == 2 * len(mutations.KINDS) * len(texts)
    for k, t in list(texts.items())[:20]:
        for i, kind in enumerate(mutations.KINDS):
            e = mutations.mutate(t, kind, 64, 7 + i)
            for lane, p in (("small", SMALL), ("warm", Profile(64, 256, 1024, True))):
                a, b = ([x for _, _, x in pieces(y, p)] for y in (t, e.target))
                r = got[k, kind, lane]
                assert (r.source_chunks, r.target_chunks, r.changed_bytes) == (len(a), len(b), e.changed)
                assert (r.reused_bytes, r.missing_bytes) == (sum(len(x) for x in b if x in a), sum(len(x) for x in b if x not in a))


def test_running_totals_of_large_groups(spark):
    rnd = random.Random(2)
    rows = [(i % 3, f"p/{rnd.random()}/{i}", rnd.randrange(100)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, path string, length long")
    got = {(r.k, r.path): r.off for r in metrics.running_total(df, ["k"], F.encode("path", "UTF-8"), "length", "off").collect()}
    at = Counter()
    for k, path, n in sorted(rows):
        assert got[k, path] == at[k]
        at[k] += n
    assert metrics.running_total(df.limit(0), ["k"], F.col("path"), "length", "off").count() == 0


def test_rows_are_pulled_in_order(spark):
    parts = list(files.pull(spark.range(1000).orderBy("id"), 256))
    assert [len(p) for p in parts] == [256, 256, 256, 232] and [r.id for p in parts for r in p] == list(range(1000))


def test_unknown_policies_are_refused(spark):
    b, t = base.pair_contents(base.histories(spark, SMALLEST))
    with pytest.raises(ValueError, match="sweep-L99"):
        policies.sweep(b, t, base.PAIR, SMALL, ["raw", "sweep-L99-K1-C8"])


def test_exact_windows_meet_in_one_row(spark):
    """One row a pair goes to Python, not one a byte; of repeated keys the least place counts."""
    rnd = random.Random(5)
    b = rnd.randbytes(3000)
    old = spark.createDataFrame([(1, bytearray(b)), (2, bytearray(b)), (3, bytearray(b"")), (4, bytearray(b[:99]))], "k int, bytes binary")
    new = spark.createDataFrame([(1, bytearray(b[500:] + b)), (1, bytearray(b"x" + b)), (2, bytearray(b"z" * 900)), (3, bytearray(b)), (5, bytearray(b))], "k int, bytes binary")
    df = patches.exact_windows(old, new, ["k"], 100, 64)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in df.collect()) == [(1, at, min((b[500:] + b).find(b[at : at + 100]), at + 1)) for at in range(0, 2901, 64)]


def test_windows_of_long_contents_in_little_memory():
    import tracemalloc

    rnd = random.Random(6)
    b = rnd.randbytes(2 << 20)
    t = b[1 << 20 :] + b"??" + b
    tracemalloc.start()
    got = hashing.Windows(b, 200, 4096).first(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == [(at, t.find(b[at : at + 200])) for at in range(0, len(b) - 199, 4096)] and peak < 16 << 20


def test_interval_coverage_rounds_and_has_no_ties(spark, tmp_path):
    """Ends between whole numbers round as SQL's do, halves to the even one; equal intervals count once, in whatever order they come."""
    rnd = random.Random(7)
    rows = [(i % 40, rnd.randrange(30) * 40, rnd.choice((0.125, 0.375, 0.6, 1.9, 10.0, 25.625))) for i in range(400)]
    rows += [(100, at, q) for at, q in ((233, 47.0), (941, 23.0), (233, 47.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k in {r[0] for r in rows}:
        inside = [(s, e) for s, e in sorted((p % 1000, round(p % 1000 + q * 4)) for i, p, q in rows if i == k) if e > s]
        merged = []
        for s, e in inside:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want[k] = (len(merged), sum(e - s for s, e in merged))
    assert {r.l_orderkey: (r.islands, r.covered) for r in QUERIES["interval_coverage"](spark, str(tmp_path)).collect()} == want


def test_content_defined_lanes_need_no_shuffle(spark):
    """One pass over contents gives what joins of both chunk tables give."""
    content = base.documents(spark, SMALLEST).drop("family").where("content_id % 7 = 0")
    jobs = [(k, k, 64, 7 + i) for i, k in enumerate(mutations.KINDS)] + [("near", "boundary-edit", 1, 0)]
    df = lab.run(content, {"small": SMALL}, jobs, SMALL)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.content_id, r.mutation): r for r in df.collect()}
    edited = mutations.mutated(content, jobs, SMALL).where("bytes is not null").cache()
    pair = ["content_id", "mutation"]
    a = chunking.cdc_chunks(edited.select(*pair).join(content, "content_id"), SMALL)
    b = chunking.cdc_chunks(edited.select(*pair, "bytes"), SMALL)
    survival = {(r.content_id, r.mutation): r.survival for r in metrics.boundary_survival(a, b, pair).collect()}
    sync = {(r.content_id, r.mutation): (r.distance, r.status) for r in metrics.resynchronization(a, b, edited.select(*pair, "affected_end", "changed_bytes"), pair).collect()}
    edited.unpersist()
    assert got.keys() == sync.keys() and len({s for _, s in sync.values()}) == 3
    for k, r in got.items():
        assert (r.resync_distance, r.resync_status) == sync[k] and r.survival == survival.get(k, 1.0)


def test_contents_go_to_python_in_small_batches(spark):
    """A batch of pairs holds few megabytes, so that neither side's memory grows with the partition; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    rows = spark.range(40, numPartitions=1).select(F.col("id").alias("k"), F.expr("encode(repeat('x', 1000000), 'UTF-8')").alias("bytes"))
    sized = lambda: each_row(rows, ["k"], ["bytes"], "n long", pa.schema([("n", pa.int64())]), lambda raw: [(len(raw),)])
    try:
        spark.conf.set(key, str(64 << 20))
        assert sorted((r.k, r.n) for r in sized().collect()) == [(k, 1000000) for k in range(40)]
        assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20
        spark.conf.set(key, str(1 << 20))
        sized()
        assert int(spark.conf.get(key).rstrip("b")) == 1 << 20
    finally:
        spark.conf.set(key, was)
