"""Readers over small trees and files made for the test."""

from pyspark.sql import functions as F
from tessera.sources import files


def test_source_tree(spark, tmp_path):
    for path, body in {"src/a.ts": "let é = 1", "src/a.test.ts": "t", "node_modules/x/b.ts": "n", "docs/c.md": "# c", "d.bin": "no"}.items():
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")
    root = f"file://{tmp_path}/tree"
    rows = {r.path: (r.size, r.content) for r in files.source_tree(spark, root, ["ts", ".md"]).collect()}
    assert rows == {"src/a.ts": (10, "let é = 1"), "src/a.test.ts": (1, "t"), "docs/c.md": (3, "# c")}
    assert {r.path for r in files.source_tree(spark, root, ["ts"], tests=False).collect()} == {"src/a.ts"}
    tree = files.source_tree(spark, root, ["ts", "md"])
    assert [r.path for r in files.listed(tree, after="docs/c.md").orderBy("path").collect()] == ["src/a.test.ts", "src/a.ts"]
    assert [r.path for r in files.listed(tree, ["docs/c.md", "x"]).collect()] == ["docs/c.md"]
    ranks = spark.createDataFrame([("src/a.ts", 0.9)], "path string, rank double")
    assert files.scan_order(tree.withColumn("mtime", F.lit(1)), ranks).first().path == "src/a.ts"


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "y"}\n')
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    corpus, queries, qrels = files.evaluation_set(spark, f"file://{tmp_path}")
    assert corpus.first()["_id"] == "d1" and queries.first().text == "y" and tuple(qrels.first()) == ("q1", "d1", 2)


def test_stale_reason(spark):
    rows = spark.createDataFrame([(False, True, 0, 1.0), (True, False, 0, 1.0), (True, True, 3, 1.0), (True, True, 0, 30.0), (True, True, None, 1.0), (True, True, 0, 1.0)], "i boolean, p boolean, c int, a double")
    got = [r[0] for r in rows.select(files.stale_reason(F.col("i"), F.col("p"), F.col("c"), F.col("a"))).collect()]
    assert got == ["no_index", "path_mismatch", "files_changed", "age_threshold", "check_failed", None]


def test_changed_files_and_partitions(spark, tmp_path):
    diff = spark.createDataFrame([("a.ts", "staged"), ("config/.env", "staged"), ("b.ts", "unstaged")], "path string, scope string")
    assert {r.path for r in files.changed_files(diff, "staged").collect()} == {"a.ts"} and files.changed_files(diff, "all").count() == 2
    out = f"file://{tmp_path}/t"
    files.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string"), out, ["g"])
    files.write_table(spark.createDataFrame([(2, "c")], "g int, v string"), out, ["g"])
    assert {(r.g, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}
