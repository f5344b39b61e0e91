"""Vector banks, database tables, settings and replaceable parts over the test tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, plugins, settings
from ..sources import banks, files
from . import base
from .base import load, query
from .corpus import _BM25

# ---- sources and sinks


@query("s8_vector_index", "SELECT vec_id AS id, label FROM embeddings")
def vector_index(s, d):
    path = files.scratch(s, "index")
    banks.write_index(base.points(s, d), path, dim=64, metric="cosine")
    index = banks.read_index(s, path, 64).where(F.size("vec") == 64)
    return index.join(base.points(s, d).select("id", "label"), "id").select("id", "label")


@query("s9_query_vectors", """
SELECT 'own' AS kind, vec_id::VARCHAR AS qid, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0.9 AS near_unit FROM embeddings
UNION ALL SELECT 'numbered', (row_number() OVER (ORDER BY vec_id) - 1)::VARCHAR, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0.9 FROM embeddings""")
def query_vectors(s, d):
    rows = base.query_points(s, d)
    own = banks.query_vectors(rows.withColumnRenamed("qid", "id")).withColumn("kind", F.lit("own"))
    numbered = banks.query_vectors(rows.withColumnRenamed("qid", "place"), "place").withColumn("kind", F.lit("numbered"))
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return own.unionByName(numbered).select("kind", "qid", (square > 0.9).alias("near_unit"))


def derby_export(s, rows: DataFrame, table: str, types: str) -> str:
    """``rows`` as the one table of a Derby database, packed into a file of the shared folder: the address under which the
    driver and any number of executors read it.  An embedded database in memory, or in a folder, belongs to one JVM."""
    s._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    manager, out = s._jvm.java.sql.DriverManager, files.scratch(s, "database")
    if urlparse(out).scheme not in ("", "file"):
        raise ValueError(f"a packed database is read by its local path, and {out} has none")
    with tempfile.TemporaryDirectory() as own:
        open_ = manager.getConnection(f"jdbc:derby:{own}/db;create=true")
        open_.createStatement().execute(f"CREATE TABLE {table} ({types})")
        insert = open_.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows.columns))})")
        for row in rows.toLocalIterator():
            for i, value in enumerate(row, 1):
                insert.setObject(i, value)
            insert.executeUpdate()
        open_.close()
        try:
            manager.getConnection(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as closed:  # a shutdown reports itself as an error of state 08006
            if closed.java_exception.getSQLState() != "08006":
                raise
        packed = Path(urlparse(out).path).with_suffix(".jar")
        packed.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(packed, "w") as jar:
            for file in sorted(Path(own, "db").rglob("*")):
                jar.write(file, file.relative_to(own))
    return f"jdbc:derby:jar:({packed})db"


@query("s12_database_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <= 2")
def database(s, d):
    """Through a database that every executor reads: the scan is split on a column, the filter is pushed to it."""
    rows = load(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    url = derby_export(s, rows, "nation", "n_nationkey INT, n_name VARCHAR(100), n_regionkey INT")
    table = banks.read_database(s, url, "nation", "n_nationkey", (0, 25), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return table.where("n_regionkey <= 2").select(*(F.col(c).alias(c.lower()) for c in table.columns if c.lower() != "n_regionkey"))


@query("s15_pinned_snapshot", """
SELECT 'corpus' AS split, doc_id::VARCHAR AS id, trim(text, ' ') AS text FROM documents
UNION ALL SELECT 'queries', item_id::VARCHAR, trim(text, ' ') FROM benchmark WHERE contains(text, 'th')""")
def pinned(s, d):
    root, benchmark = files.scratch(s, "snapshots"), load(s, d, "benchmark").withColumnRenamed("item_id", "_id")
    judged = benchmark.where("contains(text, 'th')").select(F.col("_id").alias("query-id"), F.lit(0).alias("corpus-id"), F.lit(1).alias("score"))
    for revision in ("r1", "r2"):
        corpus = load(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.lit(revision == "r2"), F.col("text")).alias("text"))
        banks.write_snapshot({"corpus": corpus, "queries": benchmark, "qrels": judged}, root, "bench", revision)
    found = banks.read_snapshot(s, root, "bench", {"bench": "r2"})
    corpus = found["corpus"].select(F.lit("corpus").alias("split"), F.col("did").alias("id"), "text")
    return corpus.unionByName(found["queries"].select(F.lit("queries").alias("split"), F.col("qid").alias("id"), "text"))


@query("s22_bank_sink", "SELECT vec_id::VARCHAR AS id, 2 AS copies, 'm-64' AS model FROM embeddings")
def bank(s, d):
    path = files.scratch(s, "bank")
    banks.write_bank(base.points(s, d), base.query_points(s, d).withColumnRenamed("qid", "id"), {"model": "m-64"}, path)
    docs, queries, config = banks.read_bank(s, path)
    return docs.select("id").unionAll(queries.select("id")).groupBy("id").agg(F.count("*").cast("int").alias("copies")).withColumn("model", F.lit(config["model"]))


# ---- settings


@query("f13_environment", "SELECT n_name, '/data/' || n_regionkey || '/none' AS place FROM nation")
def environment(s, d):
    plan = settings.expanded({"place": ["${ROOT}/", "/${PART:-none}"]}, {"ROOT": "/data", "PART": ""})
    before, after = plan["place"]
    return load(s, d, "nation").select("n_name", F.concat(F.lit(before), F.col("n_regionkey").cast("string"), F.lit(after)).alias("place"))


query("f16_quoted_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(
    lambda s, d: load(s, d, "customer").where(f"c_mktsegment IN ({settings.quoted_list(['BUILDING', 'MACHINERY'])})").select("c_custkey")
)


@query("f22_encode_settings", "SELECT lang, count(*) FILTER (n_chars > 512) AS cut, 'Find it. Answer:' AS instruction, '/b/t1' AS data_dir FROM documents GROUP BY lang")
def encode_settings(s, d):
    model = {"name": "m", "max_length": 8192, "instruction_suffix": " Answer:"}
    benchmark = {
        "name": "b", "data": "/b/{task}", "dtype": "float16", "max_length": 4096, "model_overrides": {"m": {"max_length_cap": 512}},
        "tasks": {"t1": {"instruction": "Find it."}},
    }
    chosen = settings.run_settings(model, benchmark, "t1")
    counted = load(s, d, "documents").groupBy("lang").agg(F.count(F.when(F.col("n_chars") > chosen["tokens"], 1)).alias("cut"))
    return counted.withColumns({"instruction": F.lit(chosen["query_prompt"]), "data_dir": F.lit(chosen["folder"])})


# ---- replaceable parts


def _texts(s, d) -> tuple[DataFrame, DataFrame]:
    documents = load(s, d, "documents").select(F.col("doc_id").alias("did"), "text")
    return documents, load(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


query("e1_replaceable_ranker", "WITH " + _BM25.lstrip("\n, "))(
    lambda s, d: (lambda docs, asked: plugins.run_arms({"bm25": lambda: evaluation.bm25(docs, asked)}, ["bm25"]).drop("retriever"))(*_texts(s, d))
)


@query("e2_search_backend", "SELECT qid + 1000 * i AS qid, did, score, rank FROM (" + "WITH " + _BM25.lstrip("\n, ") + "), range(2) t(i)")
def backend(s, d):
    docs, asked = _texts(s, d)
    twice = asked.unionByName(asked.withColumn("qid", F.col("qid") + 1000))
    return plugins.searched(plugins.TableSearch(docs, lambda queries, corpus, k: evaluation.bm25(corpus, queries, k)), twice, 10)


_CODES = "SELECT n_nationkey AS id, list_transform(range(16), lambda x: len(list_filter(string_split(n_name, ''), lambda c: ascii(c) % 16 = x))::FLOAT) AS vec FROM nation"


def _names(s, d) -> DataFrame:
    return load(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))


query("e3_encoders", f"SELECT id, list_sum(vec)::DOUBLE AS total, vec[2]::DOUBLE AS second FROM ({_CODES})")(
    lambda s, d: plugins.encoded(_names(s, d), "characters").select("id", F.aggregate("vec", F.lit(0.0), lambda t, x: t + x).alias("total"), F.get("vec", F.lit(1)).cast("double").alias("second"))
)
query("e4_encoder_per_worker", f"SELECT id, vec[1]::DOUBLE AS first, vec[16]::DOUBLE AS last FROM ({_CODES})")(
    lambda s, d: plugins.encoded(_names(s, d).repartition(4, "id"), "characters", "queries").select("id", F.get("vec", F.lit(0)).cast("double").alias("first"), F.get("vec", F.lit(15)).cast("double").alias("last"))
)


@query("e5_reply_lanes", """
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'ok ' || n_regionkey ELSE 'stub-' || substr(sha1(n_name), 1, 8) END AS reply,
       CASE WHEN n_nationkey % 3 = 0 THEN 'live' ELSE 'stub' END AS lane FROM nation""")
def lanes(s, d):
    nation = load(s, d, "nation")
    stored = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ok "), F.col("n_regionkey").cast("string")).alias("reply"))
    return plugins.replies(_names(s, d).withColumnRenamed("text", "prompt"), stored)


@query("e6_arms_by_name", "SELECT 'left' AS retriever, qid, did, score, rank FROM left_run UNION ALL SELECT 'full', qid, did, score, rank FROM run", "left_run", "run")
def arms(s, d):
    known = {"full": lambda: base.run(s, d), "left": lambda: base.half_run(s, d, 1), "right": lambda: base.half_run(s, d, 33)}
    return plugins.run_arms(known, ["left", "full"])


@query("e7_prompt_files", "SELECT 'r' || r_regionkey AS stage, 'About {name}: ' || r_name AS prompt, ['name'] AS slots FROM region WHERE r_regionkey < 3")
def prompts(s, d):
    folder, rows = files.scratch(s, "prompts"), load(s, d, "region").orderBy("r_regionkey")
    chosen = {}
    for i in range(3):
        rows.where(F.col("r_regionkey") == i).select(F.concat(F.lit("About {name}: "), "r_name")).coalesce(1).write.option("lineSep", " ").mode("append").text(folder)
    named = s.read.text(f"{folder}/*", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.substring_index(F.trim("value"), ": ", -1).alias("r_name"))
    for row in named.join(rows, "r_name").select("r_regionkey", "file").collect():
        chosen[f"r{row['r_regionkey']}"] = row["file"]
    return settings.read_prompts(s, folder, chosen).select("stage", F.trim("prompt").alias("prompt"), "slots")


@query("e8_numbered_stages", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def stages(s, d):
    steps = settings.Stages()
    steps.step(2, "count")(lambda rows: rows.groupBy("n_regionkey").agg(F.count("*").alias("n")))
    steps.step(1, "even")(lambda rows: rows.where("n_nationkey % 2 = 0"))
    steps.step(3, "later")(lambda rows: rows.limit(0))
    return steps.run(load(s, d, "nation"), last=2)
