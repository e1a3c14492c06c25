"""Executors need no copy of the package: operators run in a session whose workers cannot import it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from sluice.llm import queries
from sluice.session import local_session
spark = local_session(2, 2, "bare", spark__checkpoint__dir={folder!r} + "/shared")
spark.sparkContext.setLogLevel("ERROR")
try:
    spark.range(1).select(F.udf(lambda i: __import__("sluice").__name__)("id")).collect()
    raise SystemExit("workers import the package; the test says nothing")
except Exception as failure:
    assert "No module named 'sluice'" in str(failure), failure
words = [F.element_at(F.array(*map(F.lit, "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())),
         (F.abs(F.xxhash64("id", F.lit(i))) % 10 + 1).cast("int")) for i in range(40)]
docs = spark.range(24).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *words).alias("text"), F.lit("en").alias("lang"),
    F.lit("src0").alias("source"), F.lit(1).cast("long").alias("n_chars"))
docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 50).limit(6))
docs.write.parquet({folder!r} + "/t/documents.parquet")
docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(
    {folder!r} + "/t/labels.parquet")
docs.limit(3).select(F.col("doc_id").alias("item_id"), "text").write.parquet({folder!r} + "/t/benchmark.parquet")
docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text").write.parquet(
    {folder!r} + "/t/conversations.parquet")
docs.select(F.col("doc_id").alias("vec_id"), F.array(*(F.rand(i).cast("float") for i in range(4))).alias("embedding")).write.parquet(
    {folder!r} + "/t/embeddings.parquet")
for name in {names!r}:
    rows = queries.QUERIES[name](spark, {folder!r} + "/t").collect()
    print(name, len(rows))
"""
NAMES = ["op1_toxicity", "op2_suffix_dedup", "op3_quality", "op4_token_counts", "op7_top_k", "op8_decontamination",
         "op9_jaccard_join", "op11_secrets", "op12_prefix_trie", "op13_whitening"]


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root, folder=str(tmp_path), names=NAMES))
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == NAMES
