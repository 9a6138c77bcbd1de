"""Every page is ingested, whatever folder its url names."""

from clauselens.plans.queries import ingest_files


def test_every_page_is_ingested(spark, tmp_path):
    urls = ["https://a.example/en/x", "https://a.example/pt-br/x/y", "https://a.example/a+b (1)/x", "https://a.example/x",
            "https://a.example", None]
    pages = [(i, u, f"<body>page {i}</body>") for i, u in enumerate(urls)] + [(9, "https://a.example/zz/x", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = ingest_files(spark, str(tmp_path)).collect()
    assert sorted(r["error"] or "" for r in rows) == [""] * 6 + ["no body"]
    assert len({r["doc_id"] for r in rows}) == 7 and all(r["doc_id"].startswith("part=") for r in rows)
    parts = {r["doc_id"].split("__part-")[0] for r in rows}
    assert {"part=en", "part=pt-br", "part=a+b (1)", "part=zz", "part=__HIVE_DEFAULT_PARTITION__"} <= parts
