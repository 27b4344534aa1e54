"""The pipeline, stage by stage against brute force, and the registered queries."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_llm_dedup import brute_components, brute_lines, brute_print

import __spark_entry__ as E
import corpus_pipeline as P
from cadence.llm import bpe, langid, mixing
from cadence.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_the_operators_and_the_pipeline_are_registered():
    names = [q for q in E.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and len(P.STAGES) == 5 and set(E.oracle_sql()) <= set(E.queries())


def test_stages_against_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in raw.collect()}
    # language ID
    kept = stored(P.language_id(spark, raw, SF))
    assert kept.columns == raw.columns
    classifier = langid.Classifier(langid.fit(raw))
    said = {i: classifier.predict(r.text) for i, r in docs.items()}
    want = {i: lang for i, (lang, score) in said.items() if lang != "und" and score >= langid.MARGIN}
    assert {r.doc_id: r.lang for r in kept.collect()} == want and len(want) > 0.95 * len(docs)
    # line dedup
    lines = stored(P.cut_lines(spark, kept, SF))
    assert lines.columns == raw.columns
    cut = brute_lines([(i, docs[i].text) for i in want], 3, 50)
    cut = {i: t for i, t in cut.items() if t == docs[i].text or (t or "").split()}
    assert {r.doc_id: r.text for r in lines.collect()} == cut
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    # SimHash
    single = stored(P.near_duplicates(spark, lines, SF))
    prints = {i: brute_print(t) for i, t in cut.items()}
    groups = brute_components(set(prints.values()))
    first = {min(i for i in prints if prints[i] in g) for g in groups}
    assert {r.doc_id for r in single.collect()} == first and single.columns == raw.columns
    # mixing
    mixed = stored(P.mix_domains(spark, single, SF))
    domains = mixing.fit(mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet")), single)
    copies = {r.doc_id: r.copies for r in mixing.mix(single, domains, mixing.QUALITY_WEIGHTS).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == cut[r.doc_id]
    assert got == {i: n for i, n in copies.items() if n} and mixed.columns == raw.columns
    # BPE
    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    out = P.encode(spark, mixed, SF).collect()
    assert len(out) == sum(got.values())
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(cut[r.doc_id]) for r in out)
    # the whole run
    ran = P.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, ran)) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_stages_take_nulls_repeats_and_nothing(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of that. the and of", None, None, None), (70_001, None, "en", "x", 1), (70_002, "", None, None, None)], raw.schema)
    some = raw.union(raw.filter("doc_id < 5")).union(odd)
    for table in (some, raw.limit(0)):
        docs = table
        for _, stage in P.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF))
            assert docs.columns == raw.columns
        n = docs.count()
        assert P.STAGES[-1][1](spark, docs, SF).count() == n and (n > 100 or table is not some)
    # undetermined texts go
    assert P.language_id(spark, some, SF).filter(F.col("doc_id") > 70_000).count() == 0


def test_queries_on_empty_tables(spark, tmp_path):
    for t in ("documents", "embeddings", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in sorted(q for q in E.queries() if q.startswith("op") and q[2].isdigit()):
        n = E.queries()[name](spark, str(tmp_path)).count()
        assert n == (1 if name.startswith("op6_") else 0), name


def test_the_rest_runs_without_the_subpackage(tmp_path):
    """As after the removal of the two folders and corpus_pipeline.py."""
    import os
    import shutil
    repo = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{repo}/cadence", tmp_path / "cadence", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 80 and not [q for q in e.queries() if q.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def _repo():
    import os
    return os.path.dirname(os.path.abspath(E.__file__))


def test_a_missing_library_takes_the_training_queries_only(tmp_path):
    for name in ("zstandard", "xxhash", "regex", "public_tokenizers", "sentencepiece", "tokenizers"):
        code = (f"import sys, warnings; sys.modules[{name!r}] = None; sys.path.insert(0, {_repo()!r})\n"
                "with warnings.catch_warnings(record=True) as told:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\n"
                f"assert any({name!r} in str(w.message) for w in told)\n"
                "assert len(e.queries()) >= 80 and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries()")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_workers_need_no_package(tmp_path):
    """All training-data queries on workers that cannot import this repository."""
    import os
    code = f"""
import sys
sys.path.insert(0, {_repo()!r})
import __spark_entry__ as e
from cadence.session import get_spark
spark = get_spark("no-package", 4, 4)

def importable(_):
    import importlib.util
    return [importlib.util.find_spec("cadence") is not None]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
for name, build in sorted(e.queries().items()):
    if name == "pipeline" or name.startswith("op") or name in ("m06_ols", "m07_elastic_net", "m09_gbt"):
        assert build(spark, {SF!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=1200, env=env)
