"""All operators with Python workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})  # the driver's path alone
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
def importable(_):
    import importlib.util
    return importlib.util.find_spec("tidemark") is not None
assert not any(spark.sparkContext.parallelize(range(2), 2).map(importable).collect()), "the workers see the package"
text = "the old bridge spans a wide river near the mill and its {{0}} wheel turns all day long while nobody counts"
docs = [(i, text.format(i % 5) + chr(10) + f"line {{i}} " * 12, "en" if i % 2 else "de", "s", 100) for i in range(40)]
spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("docs/documents.parquet")
spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet("docs/labels.parquet")
spark.createDataFrame([("a", "the old bridge spans a wide river near the mill and its")], "item_id string, text string").write.parquet("docs/benchmark.parquet")
spark.createDataFrame([(i, f"http://h{{i}}.example.org/fr/{{i}}", "") for i in range(9)], "page_id long, url string, html string").write.parquet("docs/pages.parquet")
import __spark_entry__
queries = {{k: f for k, f in __spark_entry__.queries().items() if k.startswith("op") or k == "pipeline"}}
assert len(queries) == 11, sorted(queries)
for name, query in queries.items():
    print(name, query(spark, "docs").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert {k: int(v) for k, v in counts.items() if k[:3] in ("op1", "op2", "op5", "op6", "op7", "op9")} == {k: 40 for k in counts if k[:3] in ("op1", "op2", "op5", "op6", "op7", "op9")} and len(counts) == 11
