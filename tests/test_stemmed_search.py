from lexframe.operators import lexical, retrieval

TEXTS = [("a", "Los contratos de seguro."), ("b", "Nada de eso."), ("c", "El contrato 20/2015.")]


def test_inflections_are_found(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id string, text string")
    queries = spark.createDataFrame([(1, "contrato"), (2, "seguros 20/2015")], "query_id long, query string")
    ids = lambda **k: {(r["query_id"], r["doc_id"]) for r in lexical.search(texts, queries, 5, **k).collect()}
    assert ids() == {(1, "c"), (2, "c")} and ids(stems=True) == {(1, "a"), (1, "c"), (2, "a"), (2, "c")}
    weights = lexical.document_weights(texts, "doc_id", "text", stems=True)
    assert {r["doc_id"] for r in weights.where("term = 'contrat'").collect()} == {"a", "c"}


def test_retrieve_stems(spark):
    chunks = spark.createDataFrame([(i, t, "N", False) for i, t in TEXTS], "chunk_id string, embed_text string, norm_id string, repealed boolean")
    queries = spark.createDataFrame([(1, "contrato")], "query_id long, query string")
    hits = retrieval.retrieve(chunks, queries, mode="sparse", use_references=False)
    assert {r["chunk_id"] for r in hits.collect()} == {"a", "c"}
