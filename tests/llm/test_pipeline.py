"""The pipeline's stages, each against brute force on its own input."""

import collections
import glob
import os
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import EDGE, check_pieces, edge_docs, slow_exact, slow_secrets
from test_near_copies import slow_kept

from corestrata.llm import quality, secrets, simhash
from corestrata.llm.common import spool
from corestrata.llm.graph import components


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        results[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = results[name][1]
        assert name == "packing" or docs.columns == columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    before, after = results["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.score_documents(before, labels).where("predicted = 1").collect()}
    assert {i for i, _ in rows(after)} == kept
    good = labels.where("quality = 1").join(before, "doc_id", "left_semi").select("doc_id")
    assert good.join(after, "doc_id", "left_semi").count() > 0.97 * good.count()

    before, after = results["exact_dedup"]
    assert sorted(i for i, _ in rows(after)) == sorted(k[0] for k in slow_exact(rows(before)) if k[3])

    before, after = results["near_dedup"]
    assert sorted(i for i, _ in rows(after)) == slow_kept(rows(before))

    before, after = results["secrets"]
    want = {i: secrets.redact(t, slow_secrets(t)) for i, t in rows(before)}
    assert dict(rows(after)) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = results["packing"]
    check_pieces(after.collect(), rows(before))


@pytest.mark.parametrize("rows", [EDGE, [], [(None, None), (None, None), (1, ""), (1, "")]])
def test_stages_on_odd_tables(spark, sf, tmp_path, rows):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and clashing names, through all stages."""
    docs = edge_docs(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else docs.collect()
    texts = [t or "" for _, t in kept["exact_dedup"]]
    assert len(set(texts)) == len(texts) and set(texts) == {t or "" for _, t in kept["quality"]}
    assert len(kept["near_dedup"]) <= len(texts) and (not texts or kept["near_dedup"]) and len(kept["secrets"]) == len(kept["near_dedup"])
    check_pieces(kept["packing"], kept["secrets"])


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert collections.Counter(got.columns) >= collections.Counter(["doc_id", "sequence_id", "offset", "length"])


def test_a_missing_dependency_is_told():
    """The entry forgives the absence of this subpackage, and of nothing else."""
    code = "import sys; sys.modules[{0!r}] = None\nimport __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], capture_output=True, text=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert run("nothing.of.ours").stdout.strip().endswith("True")
    assert run("public_tokenizers").returncode != 0
    gone = run("corestrata.llm")
    assert gone.returncode == 0 and gone.stdout.strip().endswith("False")


def processes(spark, tmp_path, work):
    """work()'s result, and the commands that the JVM started meanwhile."""
    recording = spark._jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart")
    recording.start()
    out = work()
    recording.stop()
    recording.dump(spark._jvm.java.io.File(str(tmp_path / "started.jfr")).toPath())
    recording.close()
    events = spark._jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(spark._jvm.java.io.File(str(tmp_path / "started.jfr")).toPath())
    return out, [e.getString("command") for e in events]


def test_intermediate_files_start_few_processes(spark, tmp_path):
    """A process that an executor starts is at first a second one with all of its memory, so the fewer the better."""
    out, started = processes(spark, tmp_path, lambda: spool(spark.range(100, numPartitions=4), "quiet"))
    assert started and not [c for c in started if ".crc" in c]  # files and folders still get their modes so
    assert sorted(r.id for r in out.collect()) == list(range(100))

    links = spark.range(0, 1000, 1, 50).select("id", (F.col("id") + 1).alias("next")).toDF("a", "b")
    rooted, started = processes(spark, tmp_path, lambda: components(links))
    assert len([c for c in started if ".parquet" in c]) == 1  # a file, not some for each round
    assert rooted.count() == 1000 and not rooted.where("root <> 0").count()


def test_damaged_intermediate_files_are_told(spark):
    out = spool(spark.range(100_000, numPartitions=1), "damaged")
    (file,) = glob.glob(f"{out.spooled_at.removeprefix('file:').replace('//', '/')}/*.parquet")
    with open(file, "r+b") as f:
        f.seek(os.path.getsize(file) // 2)
        byte = f.read(1)
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        out.agg(F.sum("id")).collect()


def test_small_tables_are_few_files(spark, monkeypatch):
    """Few shuffle partitions or many: tables of a few rows take no more tasks than there are cores."""
    made = []
    monkeypatch.setattr(simhash, "spool", lambda df, tag: made.append((tag, spool(df, tag))) or made[-1][1])
    monkeypatch.setattr(simhash, "unspool", lambda df: None)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        words = [f"w{i}" for i in range(400)]
        rows = [(100 * k + c, " ".join(words[k : k + 60] + [str(c)])) for k in range(0, 300, 5) for c in range(3)]
        kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
        assert sorted(r.doc_id for r in kept) == slow_kept(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [(tag, len(glob.glob(f"{df.spooled_at.removeprefix('file:').replace('//', '/')}/*.parquet"))) for tag, df in made]
    small = [(tag, n) for tag, n in files if tag in ("buckets", "named", "pairs", "placed", "gone")]
    assert len(small) == 6 and all(0 < n <= 4 for _, n in small), files
