from shelfwise.llm import decontaminate


def test_items_without_id(spark):
    """Their passages are hits; only the number and the digest of ids leave them out."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(None, passage), (1, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, passage + " other words"), (3, "clean")], "doc_id long, text string")
    for block_bytes in (1 << 20, 8):
        rows = {r.doc_id: r for r in decontaminate.scan(docs, items, block_bytes=block_bytes).collect()}
        assert [(rows[i].n_hit, rows[i].n_items, rows[i].contaminated) for i in (1, 2, 3)] == [(20, 0, True), (22, 1, True), (0, 0, False)]
        assert rows[1].items_sha256 == rows[3].items_sha256 != rows[2].items_sha256
