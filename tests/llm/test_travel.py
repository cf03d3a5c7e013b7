"""Tasks run where the workers have no copy of this package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from skywell.session import build_session
from skywell.llm import collocations, packing, simhash, variants
spark = build_session("travel", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
docs = spark.createDataFrame([(i, "hello world again and again " * 9, "en", "s", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
print("rows", packing.pack(docs.select("doc_id", "text"), added=packing.ADDED).count(), simhash.near_components(docs).count(),
      variants.variants(variants.word_counts(docs)).count(), collocations.collocations(docs).count())
"""


def test_no_package_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 9 9 3" in out.stdout, out.stderr[-2000:]
