import corpus_pipeline
from shelfwise.llm.ngram_join import one_row_of_each
from shelfwise.llm.rows import fresh, tidy, with_row
from tests.llm.brute import edge_docs, no_docs

D = "/root/testdata/sf0.001"


def test_rows_of_files_are_told_apart_without_a_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id % 3 doc_id", "'same' text").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows, name = with_row(docs)
    assert name == "_row" and rows.inputFiles() == docs.inputFiles()
    assert rows.select(name).distinct().count() == 2000
    both = rows.select(name, "doc_id").join(rows.select(name, docs["doc_id"].alias("again")), name)
    assert both.where("doc_id <> again").count() == 0 and both.count() == 2000
    made, name = with_row(spark.range(10).selectExpr("id _row").union(spark.range(10)))
    assert name == "__row" and made.select(name).distinct().count() == 20


def test_names_and_tidy():
    assert fresh("_row", ["a"]) == "_row" and fresh("_row", ["_ROW", "__row"]) == "___row"

    @tidy
    def each(n):
        yield from range(n)

    @tidy
    def once(n):
        return n

    assert list(each(3)) == [0, 1, 2] and once(4) == 4


def test_copies_go_and_own_columns_stay(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "mine", 7), (1, text, "mine", 8), (2, text + " more", "x", 9), (None, None, "y", None), (3, "other", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _key int")
    docs.write.parquet(str(tmp_path / "d"))
    for d in (docs, spark.read.parquet(str(tmp_path / "d"))):
        left = one_row_of_each(d)
        got = sorted(map(tuple, left.collect()), key=repr)
        assert left.columns == docs.columns and len(got) == 3
        assert {r[0] for r in got} == {1, None, 3} and set(got) <= set(rows)


def test_stages_on_edges_and_empty_tables(spark):
    """Every stage but the last returns the columns it was given, whatever they are called."""
    for docs in (edge_docs(spark), no_docs(spark), edge_docs(spark).union(edge_docs(spark))):
        docs = docs.selectExpr("*", "1L as _row", "'p' as _place", "2 as _shard")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            left = out.count()
            assert left <= n if name != "source_mixing" else left <= 2 * n
            assert left == n or name not in ("secret_scan", "byte_bpe")
