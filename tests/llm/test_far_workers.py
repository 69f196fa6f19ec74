import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# workers start in a folder and with a path that do not hold the package
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from rolesift.llm.catalog import CATALOG
from rolesift.session import local_session
spark = local_session(2)
spark.sparkContext.setLogLevel("ERROR")
text = "Dr Li Ming wrote to mail {0}@shop{0}.test on paper number {0} about the price of the seven new boats in the harbour " * 3
docs = [(i, text.format(i % 30), "en", "s%d" % (i % 3), 9) for i in range(60)]
spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("t/documents.parquet")
urls = [(i, "https://%s.example.org/a/%d" % ("casino-x" if i % 5 == 0 else "shop", i), "<p>x</p>") for i in range(50)]
spark.createDataFrame(urls, "page_id long, url string, html string").write.parquet("t/pages.parquet")
spark.createDataFrame([(1, "the price of the seven new boats")], "item_id long, text string").write.parquet("t/benchmark.parquet")
rows = [(i, [0.1 * (i % 7), 0.2, -0.1 * (i % 3)], i % 2) for i in range(300)]
spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet("t/embeddings.parquet")
for n in (1, 2, 4, 8, 11, 12, 13):
    name = next(q for q in CATALOG if q.startswith(f"op{n}_"))
    print(name, CATALOG[name][0](spark, "t").count(), flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.strip().splitlines())
    assert len(counts) == 7 and counts["op1_url_cascade"] == "50" and counts["op8_bloom_lm"] == "60"
