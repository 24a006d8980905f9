from tomewise import catalog


def test_sizes_of_long_documents(spark, tmp_path):
    sizes = {0: "0 B", 1023: "1023 B", 1536: "1.5 KB", 1048575: "1024 KB", 1048576: "1 MB", 1572864: "1.5 MB", 5 << 30: "5120 MB"}
    spark.createDataFrame([(n, n) for n in sizes], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.size for r in catalog.format_bytes(spark, str(tmp_path)).collect()}
    assert got == sizes
