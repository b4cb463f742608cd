import os
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pyspark
import pytest
from corpus_pipeline import STAGES

from ..conftest import DATA, ROOT
from .conftest import FIELDS, prose
from .test_dedup import brute_join, brute_repeats

BY_NAME = dict(STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_stages():
    assert [n for n, _ in STAGES] == ["toxicity", "language_id", "jaccard_join", "suffix_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in STAGES[:-1]])
def test_stage_keeps_columns_and_takes_anything(spark, docs, hard_docs, no_docs, name):
    for table in (docs, hard_docs, no_docs):
        out = BY_NAME[name](spark, table, DATA)
        assert out.columns == table.columns and out.count() <= table.count()


def test_packing_stage_takes_anything(spark, hard_docs, no_docs):
    assert BY_NAME["packing"](spark, hard_docs, DATA).count() > 0
    assert BY_NAME["packing"](spark, no_docs, DATA).count() == 0


def test_one_of_each_group_stays(spark, docs):
    kept = {r.doc_id for r in BY_NAME["jaccard_join"](spark, docs, DATA).collect()}
    assert kept == set(brute_join(docs.collect(), 5, 80, 100).values())


def test_repeated_rows_stay_once(spark):
    rows = [(1, prose(1, 50), "en", "s", 1)] * 3 + [(2, prose(2, 50), "en", "s", 1)]
    out = BY_NAME["jaccard_join"](spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), DATA)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_rows_that_share_an_id_go_only_as_near_duplicates(spark):
    rows = [(1, prose(1, 50), "en", "s", 1), (1, prose(2, 50), "en", "s", 1), (2, prose(2, 50), "en", "s", 1), (None, prose(2, 50), "en", "s", 1)]
    out = BY_NAME["jaccard_join"](spark, spark.createDataFrame(rows, FIELDS), DATA)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, prose(2, 50)), (1, prose(1, 50)), (1, prose(2, 50))])


PLANTED = ["xqzj vkpw zzqx jjkw qxv wvk", "talo kissa koira hyvää huomenta mitä kuuluu tänään ystäväni", "Привет как дела сегодня хорошо", "東京都は日本の首都です。東京都は日本の首都です", "12345 !!! 67890", ""]


def test_documents_in_no_learnt_language_go_and_others_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = spark.createDataFrame([(10**7 + i, t * 20, None, "planted", len(t)) for i, t in enumerate(PLANTED)], FIELDS)
    kept = {r.doc_id for r in BY_NAME["language_id"](spark, docs.union(strange), folder).select("doc_id").collect()}
    assert not kept & {10**7 + i for i in range(len(PLANTED))}
    assert len(kept) >= 0.995 * docs.count()


def test_repeats_go_as_by_brute_force(spark, docs):
    own = docs.limit(120)
    rows = sorted((r.doc_id, r.text) for r in own.collect())
    cut = {d: n for d, (_, n, _, _) in brute_repeats(rows, 100).items()}
    for r in BY_NAME["suffix_dedup"](spark, own, DATA).collect():
        before = (dict(rows)[r.doc_id] or "").encode()
        # characters that are covered in part stay
        assert 0 <= len((r.text or "").encode()) - (len(before) - cut[r.doc_id]) <= 6 * (1 + cut[r.doc_id] // 100)
    assert sum(cut.values()) > 0


def test_toxic_documents_go_and_others_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in BY_NAME["toxicity"](spark, docs, folder).select("doc_id").collect()}
    clean = [d for d, toxic in labels.items() if not toxic]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d not in kept for d, toxic in labels.items() if toxic) >= 0.6 * sum(labels.values())


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from corpus_pipeline import STAGES

at, data = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "900m", "spark.executor.extraJavaOptions": f"-XX:+UseG1GC -Xlog:gc:file={at}/gc-%p.log",
        "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.checkpoint.dir": f"{at}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.range(0, 2, 1, 2).selectExpr("size(sequence(id, id + 20000000)) as n").collect()  # heaps grow
dict(STAGES)["packing"](spark, spark.read.parquet(f"{data}/documents.parquet").limit(20), data).count()
spark.stop()
"""


def test_heaps_that_grew_before_a_stage_are_given_back(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in a folder of Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), DATA], cwd=tmp_path, env=env, capture_output=True, text=True, check=False, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2
    for log in logs:
        sizes = [int(x) for x in re.findall(r"M\((\d+)M\)", log)]
        given_back = [int(x) for x in re.findall(r"Pause Full \(System\.gc\(\)\) \d+M->\d+M\((\d+)M\)", log)]
        assert given_back and min(given_back) < max(sizes) / 2
