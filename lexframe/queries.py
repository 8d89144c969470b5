"""Registered queries: each operator on whole driver tables, beside the DuckDB SQL it is held against.

The legal corpus is not at hand, so tables stand in for it: ``documents.source`` for norms, documents for chunks,
``events`` per user for dated blocks, ``benchmark`` for questions, ``embeddings`` for vectors, ``conversations`` for events.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html, numerals
from .functions.text import STOPWORDS, clean, normalize, text_hash, tokenize
from .operators import aliases, answering, chunking, dense, evaluation, incremental, ivf, lexical, references, retrieval, structure
from .operators.store import Buckets, Segment, Store
from .session import shared_folder
from .sources import catalog, landing, schema, xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = date(2024, 1, 15)


def _registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _sql_values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _norm(text: str) -> str:
    """The letters with marks, and other marks, of the given texts' languages: a table of the SQL's own."""
    return f"translate(lower(coalesce({text}, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçªº\u00a0', 'aaaaaaeeeeiiiiooooouuuuncao ')"


def _tok(text: str) -> str:
    return rf"list_filter(regexp_extract_all({_norm(text)}, '\d+(?:[./]\d+)*|[a-z]+'), lambda t: NOT list_contains({_STOP}, t))"


# --- text and lexical search


@_registered(rf"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)")
def text_normalize_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_terms"), F.sha2(F.array_join("t", " "), 256).alias("terms_sha256"))


@_registered(rf"SELECT source, count(*) AS docs, round(avg(n), 6) AS avg_terms, CAST(max(n) AS INTEGER) AS max_terms FROM (SELECT source, len({_tok('text')}) AS n FROM documents) GROUP BY source")
def doc_len_stats(spark, sf_dir):
    rows = lexical.terms(_table(spark, sf_dir, "documents").withColumn("id", F.struct("source", "doc_id")), "id", "text")
    return rows.groupBy(F.col("id.source").alias("source")).agg(F.count("*").alias("docs"), F.round(F.avg("n_terms"), 6).alias("avg_terms"), F.max("n_terms").alias("max_terms"))


_D = rf"d AS (SELECT doc_id, {_tok('text')} AS w FROM documents), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM d), "
_TF = "tf AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY doc_id, term)"
_W = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))"


@_registered(f"WITH {_D}{_TF} SELECT doc_id, term, tf, round({_W}, 6) AS weight FROM tf, st")
def bm25_doc_weights(spark, sf_dir):
    found = lexical.document_weights(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _bm25_sql(k: int, keep: str = "true") -> str:
    return f"""{_D}{_TF}, q AS (SELECT DISTINCT item_id, unnest({_tok('text')}) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sp AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {_W}), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st WHERE {keep} GROUP BY item_id, doc_id),
    sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sp) WHERE rank <= {k})"""


def _asked(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))


def _sparse(spark, sf_dir, k: int, keep: Column | None = None, docs: DataFrame | None = None) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents") if docs is None else docs, _asked(spark, sf_dir), k, query_col="item_id", keep=keep)


@_registered(f"WITH {_bm25_sql(10)} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir, 10)


@_registered(ORACLES["bm25_topk"])
def stored_bm25_topk(spark, sf_dir):
    """The search of ``bm25_topk`` over postings that a store holds by the hash of their term: the parts of other terms stay closed."""
    held = Store(spark, shared_folder(spark))
    kept = lexical.postings(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_terms", "term", "tf")
    held.commit(postings=Segment(kept, "term"))
    rows, parts = held.parts("postings", "doc_id long, n_terms int, term string, tf long")
    asked = lexical.asked_terms(_asked(spark, sf_dir), "item_id", "query", False)
    return lexical.search_postings(rows, asked, 10, "doc_id", "item_id", parts=parts)


@_registered()
def sparse_vectors(spark, sf_dir):
    """Term ids are CRC-32, which DuckDB lacks; tests hold them against zlib."""
    return lexical.sparse_vectors(lexical.document_weights(_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


# --- dense search, fusion, merging

_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _vector_queries(spark, sf_dir) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    return _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


@_registered(f"SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return dense.search(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 10)


@_registered(ORACLES["dense_topk"])
def dense_topk_indexed(spark, sf_dir):
    """The search of ``dense_topk`` through an inverted file that is built anew at every call."""
    index = ivf.build(_table(spark, sf_dir, "embeddings"), shared_folder(spark))
    return index.search(_vector_queries(spark, sf_dir), 10)


def _dense(spark, sf_dir, k: int, keep: DataFrame | None = None) -> DataFrame:
    """A benchmark item's vector is that of its own number; a document's too."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _asked(spark, sf_dir).join(vectors.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id")
    return dense.search(vectors if keep is None else vectors.join(keep, "doc_id", "left_semi"), asked, k, "doc_id", "embedding", "item_id")


def _dense_sql(k: int, keep: str = "true") -> str:
    return f"""dn AS (SELECT i.item_id, b.vec_id AS doc_id, {_COS} AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b WHERE {keep}),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dn) WHERE rank <= {k})"""


_RRF = """fu AS (SELECT item_id, doc_id, round(sum(1 / (60.0 + rank)), 8) AS score, string_agg(source, ',' ORDER BY source) AS sources
       FROM (SELECT item_id, doc_id, rank, 'dense' AS source FROM dense UNION ALL SELECT item_id, doc_id, rank, 'sparse' FROM sparse) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, sources, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu) WHERE rank <= 10"""


def _fused(rankings: dict[str, DataFrame]) -> DataFrame:
    return retrieval.fuse(rankings, "item_id", "doc_id", 10).withColumn("sources", F.array_join("sources", ","))


@_registered(f"WITH {_bm25_sql(50)}, {_dense_sql(50)}, {_RRF}")
def hybrid_rrf(spark, sf_dir):
    return _fused({"sparse": _sparse(spark, sf_dir, 50), "dense": _dense(spark, sf_dir, 50)})


_KEEP = retrieval.ChunkFilter(norm_ids=tuple(f"src{i}" for i in range(10)), topics=("en", "de"), columns={"norm_id": "source"})


def _filterable(spark, sf_dir) -> DataFrame:
    """Toxic documents count as repealed, the language is the only topic."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("repealed"))
    return _table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("topics", F.array("lang"))


_ALLOWED = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9') AND lang IN ('en', 'de') AND coalesce(toxic, 0) <> 1"


@_registered(_ALLOWED)
def filter_topics_repealed(spark, sf_dir):
    return _filterable(spark, sf_dir).where(_KEEP.predicate()).select("doc_id")


@_registered(f"WITH ok AS ({_ALLOWED}), {_bm25_sql(50, 'doc_id IN (FROM ok)')}, {_dense_sql(50, 'b.vec_id IN (FROM ok)')}, {_RRF}")
def hybrid_filtered(spark, sf_dir):
    docs = _filterable(spark, sf_dir)
    return _fused({"sparse": _sparse(spark, sf_dir, 50, _KEEP.predicate(), docs), "dense": _dense(spark, sf_dir, 50, docs.where(_KEEP.predicate()).select("doc_id"))})


@_registered(f"""WITH {_bm25_sql(10)}, {_dense_sql(5)}, u AS (SELECT item_id, doc_id, score, rank, 0 AS part FROM dense UNION ALL SELECT item_id, doc_id, score, rank, 1 FROM sparse),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY part, rank) AS n FROM u) WHERE n = 1)
SELECT item_id, doc_id, score, source, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id, doc_id, score, CASE part WHEN 0 THEN 'dense' ELSE 'sparse' END AS source, row_number() OVER (PARTITION BY item_id ORDER BY part, rank) AS rank FROM f) WHERE rank <= 8""")
def merge_dedupe_topk(spark, sf_dir):
    named = lambda df, name: df.withColumn("sources", F.array(F.lit(name)))
    merged = retrieval.merge(named(_dense(spark, sf_dir, 5), "dense"), named(_sparse(spark, sf_dir, 10), "sparse"), "item_id", "doc_id", 8)
    return merged.select("item_id", "doc_id", "score", F.col("sources")[0].alias("source"), "rank")


def _reranked(spark, sf_dir) -> DataFrame:
    hits = _sparse(spark, sf_dir, 20).withColumn("sources", F.array(F.lit("sparse")))
    passages = hits.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(_asked(spark, sf_dir), "item_id")
    return retrieval.rerank(passages, "item_id", retrieval.lexical_overlap(F.col("query"), F.col("text")), "doc_id")


_RERANKED = f"""{_bm25_sql(20)}, o AS (SELECT item_id, doc_id, s.rank AS prior, round(len(list_intersect(list_distinct({_tok('b.text')}), w)) / CAST(len(list_distinct({_tok('b.text')})) AS DOUBLE), 6) AS score
  FROM sparse s JOIN benchmark b USING (item_id) JOIN d USING (doc_id)),
rr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, prior, doc_id) AS rank FROM o)"""


@_registered(f"WITH {_RERANKED} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM rr")
def rerank_stable(spark, sf_dir):
    return _reranked(spark, sf_dir).select("item_id", "doc_id", "score", "rank")


@_registered(f"WITH {_RERANKED} SELECT item_id, coalesce(max(score) < 0.9, true) AS abstain FROM benchmark LEFT JOIN rr USING (item_id) GROUP BY item_id")
def abstention(spark, sf_dir):
    return answering.abstentions(_asked(spark, sf_dir), _reranked(spark, sf_dir), 0.9, "item_id")


# --- evaluation


@_registered(f"""WITH h AS (SELECT * FROM (SELECT a.vec_id AS id, a.label, b.label AS other, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10),
g AS (SELECT a.vec_id AS id, a.label, b.vec_id AS gold FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0),
f AS (SELECT g.id, g.label, gold, min(rank) AS rank FROM g LEFT JOIN h ON h.id = g.id AND h.vec_id = gold GROUP BY g.id, g.label, gold),
s AS (SELECT id, CAST(label AS VARCHAR) AS category, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS r3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS r5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS r10, coalesce(1.0 / min(rank), 0) AS rr FROM f GROUP BY id, label)
SELECT 'dense' AS config, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr, count(*) AS n FROM s GROUP BY GROUPING SETS ((), (category))""")
def recall_mrr_grouping_sets(spark, sf_dir):
    """Gold of a vector: all vectors of its label."""
    asked, vectors = _vector_queries(spark, sf_dir), _table(spark, sf_dir, "embeddings")
    gold = asked.select(F.col("query_id").alias("id"), "label").join(vectors.select(F.col("vec_id").alias("gold"), "label"), "label").select("id", "gold")
    hits = dense.search(vectors, asked, 10).select(F.col("query_id").alias("id"), F.col("vec_id").alias("gold"), "rank")
    scores = evaluation.score_questions(gold, hits, "id").join(asked.select(F.col("query_id").alias("id"), F.col("label").cast("string").alias("category")), "id")
    return evaluation.summarise(scores.withColumn("config", F.lit("dense")), digits=6)


def _article_chunks(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("norm_id"), F.lit("articulo").alias("kind"), (F.col("n_chars") % 10).cast("string").alias("number"), F.when(F.col("lang") != "en", F.col("lang")).alias("apartado"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("block_id"))


@_registered("""SELECT item_id, norm_id, number FROM (SELECT item_id, 'src' || (item_id % 25) AS norm_id, CAST(item_id % 12 AS VARCHAR) AS number FROM benchmark) g
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = g.norm_id AND CAST(d.n_chars % 10 AS VARCHAR) = g.number)""")
def gold_missing_anti(spark, sf_dir):
    item = F.col("item_id")
    gold = _table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), item % 25).alias("norm_id"), F.lit("articulo").alias("kind"), (item % 12).cast("string").alias("number"), F.lit(None).cast("string").alias("block_id"))
    return evaluation.missing_gold(gold, _article_chunks(spark, sf_dir)).select("item_id", "norm_id", "number")


_LOOKUPS = [(1, "src0", "3", "fr"), (2, "src1", "4", "xx"), (3, "src2", "5", None), (4, "src3", "1", "de"), (5, "src4", "99", None)]


@_registered(f"""WITH r AS (SELECT * FROM (VALUES {_sql_values(_LOOKUPS)}) t(query_id, norm_id, number, ap)),
j AS (SELECT query_id, doc_id, source, ap, nullif(lang, 'en') AS lang, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM r JOIN documents d ON d.source = r.norm_id AND CAST(d.n_chars % 10 AS VARCHAR) = r.number),
c AS (SELECT *, CASE WHEN ap IS NULL OR lang = ap THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END AS choice FROM j WHERE n <= 200),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM (SELECT *, min(choice) OVER (PARTITION BY query_id) AS best FROM c) WHERE choice = best)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id AS chunk_id, CAST(place AS INTEGER) AS place FROM b WHERE place <= 3""")
def reference_lookup_fallback(spark, sf_dir):
    refs = _values(spark, [(q, n, i, a, "articulo") for q, n, i, a in _LOOKUPS], "query_id long, norm_id string, number string, apartado string, kind string")
    return references.find_provisions(refs, _article_chunks(spark, sf_dir), ["query_id"]).select("query_id", "chunk_id", "place")


# --- references and numerals

_NORMS = [("N1", "ting", ["that the"]), ("N2", "eau", ["de la", "des"]), ("N3", "und", ["der"]), ("N4", "osos", ["que", "a the"])]
_ALIASES = sorted(((norm, alias, i) for i, (norm, short, more) in enumerate(_NORMS) for alias in [short, *more]), key=lambda x: -len(x[1]))


def _catalog(spark) -> DataFrame:
    return catalog.norms(spark, [{"norm_id": n, "short_name": s, "title": f"Norma {n}", "aliases": a, "topics": []} for n, s, a in _NORMS])


_FOUND = f"""t AS (SELECT doc_id, {_norm('text')} AS s FROM documents),
a AS (SELECT * FROM (VALUES {_sql_values([(n, alias, k) for k, (n, alias, _) in enumerate(_ALIASES)])}) v(norm_id, alias, k)),
m AS (SELECT doc_id, norm_id, k, length(regexp_extract(s, '(?s)^(.*?)(?:^|[^\\w/])' || alias || '(?:[^\\w/]|$)', 1)) AS at FROM t, a WHERE regexp_matches(s, '(?:^|[^\\w/])' || alias || '(?:[^\\w/]|$)'))"""


@_registered(f"WITH {_FOUND}, f AS (SELECT doc_id, norm_id, min(k) AS k FROM m GROUP BY doc_id, norm_id) SELECT doc_id, coalesce((SELECT string_agg(norm_id, ',' ORDER BY k) FROM f WHERE f.doc_id = t.doc_id), '') AS norms FROM t")
def mentioned_norms(spark, sf_dir):
    found = aliases.mentioned_norms(_table(spark, sf_dir, "documents"), _catalog(spark))
    return found.select("doc_id", F.array_join("norms", ",").alias("norms"))


#: Characters beside their compatibility decomposition without combining marks, as the Unicode charts give them.
_COMPATIBLE = [("m²", "m2"), ("½", "1⁄2"), ("ﬁn", "fin"), ("Č", "c"), ("№", "no"), ("ⅷ", "viii"), ("㎏", "kg"), ("Ａ９", "a9"), ("…", "..."), ("ŉ", "ʼn"), ("ǆ", "dz"), ("℡", "tel"), ("①", "1"), ("한", "\u1112\u1161\u11ab"), ("Ệ", "e"), ("ş̈", "s"), ("｡", "。"), ("ﷺ", "صلى الله عليه وسلم")]


@_registered(f"""SELECT doc_id, sha256(replace({_norm('text')}, '…', '...') || ' {' '.join(b for _, b in _COMPATIBLE)} ' || doc_id) AS plain_sha256,
CAST(len({_tok('text')}) + {len([t for _, b in _COMPATIBLE for t in re.findall(r'[0-9]+(?:[./][0-9]+)*|[a-z]+', b) if t not in STOPWORDS])} + 1 AS INTEGER) AS n_terms FROM documents""")
def normalize_compatibility(spark, sf_dir):
    """Compatibility characters spliced into every document."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" " + " ".join(a for a, _ in _COMPATIBLE) + " "), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(text), 256).alias("plain_sha256"), F.size(tokenize(text)).alias("n_terms"))


_WORDS = "list_filter(list_distinct(regexp_extract_all({}, '[A-Za-z0-9_/]+')), lambda w: regexp_full_match(w, '[a-z]{{5,}}'))"


@_registered(f"""WITH t AS (SELECT doc_id, lang, {_WORDS.format(_norm('text'))} AS w FROM documents), known AS (SELECT DISTINCT unnest(w) AS w FROM t WHERE lang = 'es'),
hits AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(w) AS w FROM t) SEMI JOIN known USING (w))
SELECT doc_id, count(hits.w) AS n_norms, sha256(coalesce(string_agg(hits.w, ',' ORDER BY hits.w), '')) AS norms_sha256 FROM t LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def mentions_of_many_norms(spark, sf_dir):
    """A catalog with a norm for each longer word of the Spanish documents, looked for in all documents."""
    docs = _table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(normalize(F.col("text")), F.lit("(?<![A-Za-z0-9_/])[a-z]{5,}(?![A-Za-z0-9_/])"), F.lit(0))
    known = docs.where("lang = 'es'").select(F.explode(words).alias("norm_id")).distinct()
    catalog = known.select("norm_id", F.lit(0).alias("ord"), F.col("norm_id").alias("short_name"), F.array().cast("array<string>").alias("aliases"))
    found = aliases.mentioned_norms(docs, catalog)
    return found.select("doc_id", F.size("norms").cast("long").alias("n_norms"), F.sha2(F.array_join(F.array_sort("norms"), ","), 256).alias("norms_sha256"))


_CITED = [
    (1, "¿Qué dice el artículo 10 de la Ley 50/1980?"),
    (2, "art. 20.3 LCS y art. 21 bis de la Ley 50/1980"),
    (3, "La disposición adicional decimotercera del RDL 3/2020"),
    (4, "DT 4.ª del RDL 3/2020, y la disposición final vigésima primera"),
    (5, "La Ley 50/1980 no cita ninguno"),
]
_CITED_NORMS = [("L50", "LCS", ["Ley 50/1980"]), ("R3", "RDL 3/2020", [])]
_CITED_RESULT = [
    (1, 0, "articulo", "10", None, "L50"), (2, 0, "articulo", "20", "3", None), (2, 1, "articulo", "21 bis", None, "L50"),
    (3, 0, "disposicion_adicional", "13", None, "R3"), (4, 0, "disposicion_transitoria", "4", None, "R3"), (4, 1, "disposicion_final", "21", None, None),
]


@_registered(f"SELECT CAST(id AS BIGINT) AS id, CAST(ref AS INTEGER) AS ref, kind, number, apartado, norm_id FROM (VALUES {_sql_values(_CITED_RESULT)}) t(id, ref, kind, number, apartado, norm_id)")
def reference_parse(spark, sf_dir):
    norms = catalog.norms(spark, [{"norm_id": n, "short_name": s, "title": s, "aliases": a, "topics": []} for n, s, a in _CITED_NORMS])
    return references.references(_values(spark, _CITED, "id long, text string"), norms, "id", "text")


_NUMERALS = [("trescientos siete", 307), ("cuarenta y cinco", 45), ("dieciséis", 16), ("Trigésimo segunda", 32), ("decimosexta", 16), ("undécimo", 11), ("27", 27), ("9.º", 9), ("jamás", None), ("", None), ("seiscientos doce", 612)]


@_registered(f"SELECT words, CAST(n AS INTEGER) AS n FROM (VALUES {_sql_values(_NUMERALS)}) t(words, n)")
def numeral_parse(spark, sf_dir):
    return _values(spark, [(w,) for w, _ in _NUMERALS], "words string").select("words", numerals.number(F.col("words")).alias("n"))


_TITLES = [("Artículo cuarenta y uno", "41"), ("Artículo 7 quater", "7 quater"), ("Disposición transitoria decimosexta", "16"), ("Disposición derogatoria única", "única"), ("Artículo quinto bis.", "5 bis"), ("Disposición adicional", None), ("Artículo 112", "112")]


@_registered(f"SELECT title, number FROM (VALUES {_sql_values(_TITLES)}) t(title, number)")
def provision_numbers(spark, sf_dir):
    return _values(spark, [(t,) for t, _ in _TITLES], "title string").select("title", numerals.provision_number(F.col("title")).alias("number"))


# --- structure

_AS_OF = datetime(2024, 1, 15)


@_registered("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE n = 1")
def asof_version(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return structure.as_of(events, ["user_id"], "ts", "event_id", _AS_OF).select("user_id", "event_id", "event_type")


@_registered("""WITH q AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t FROM events)
SELECT q.user_id, CAST(t AS DATE) AS day, event_id FROM q ASOF LEFT JOIN events e ON q.user_id = e.user_id AND q.t >= e.ts""")
def asof_join(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.select("user_id", F.to_date("ts").cast("timestamp").alias("t")).distinct()
    return structure.as_of_join(events, days, ["user_id"], "ts", "t", "event_id").select("user_id", F.to_date("t").alias("day"), "event_id")


def _event_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Users are norms without a scope, their events blocks of one version."""
    events = _table(spark, sf_dir, "events")
    version = F.struct(F.lit(0).alias("vord"), F.to_date("ts").alias("in_force_since"))
    expiry = F.when(F.col("event_type") == "error", F.date_add(F.to_date("ts"), 3))
    blocks = events.select(F.col("user_id").cast("string").alias("norm_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("block_id"), F.lit("precepto").alias("block_type"), F.col("event_type").alias("title"), expiry.alias("expired_on"), F.array(version).alias("versions"))
    return blocks, blocks.select("norm_id").distinct().withColumn("scope", F.lit(None).cast(schema.SCOPE))


@_registered("""SELECT CAST(user_id AS VARCHAR) AS norm_id, min(d) FILTER (WHERE d > DATE '2024-01-15') AS next_change FROM
(SELECT user_id, CAST(ts AS DATE) AS d FROM events UNION ALL SELECT user_id, CAST(ts AS DATE) + 3 FROM events WHERE event_type = 'error') GROUP BY user_id""")
def next_scheduled_change(spark, sf_dir):
    return structure.next_scheduled_change(*_event_blocks(spark, sf_dir), DAY)


@_registered("""WITH s AS (SELECT source, coalesce(min(doc_id) FILTER (WHERE n_chars > 1000), min(doc_id)) AS f, max(doc_id) AS u, min(doc_id) AS x FROM documents GROUP BY source)
SELECT source AS norm_id, doc_id AS ord FROM documents JOIN s USING (source) WHERE (doc_id >= f AND doc_id < u) OR doc_id = x""")
def scope_range_plus_extras(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    text = lambda c: c.cast("string")
    first = F.coalesce(F.min(F.when(F.col("n_chars") > 1000, F.col("doc_id"))), F.min("doc_id"))
    scope = F.struct(text(first).alias("from_block"), text(F.max("doc_id")).alias("until_block"), F.array(text(F.min("doc_id"))).alias("extra_blocks"))
    norms = docs.groupBy(F.col("source").alias("norm_id")).agg(scope.alias("scope"))
    blocks = docs.select(F.col("source").alias("norm_id"), F.col("doc_id").alias("ord"), text(F.col("doc_id")).alias("block_id"))
    return structure.in_scope(blocks, norms).select("norm_id", "ord")


@_registered("""WITH e AS (SELECT user_id, event_id, event_type, max(CASE event_type WHEN 'view' THEN event_id END) OVER w AS a, max(CASE event_type WHEN 'click' THEN event_id END) OVER w AS b,
  max(CASE event_type WHEN 'signup' THEN event_id END) OVER w AS c, max(CASE event_type WHEN 'error' THEN event_id END) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, concat_ws('/', CASE WHEN a > coalesce(z, -1) THEN a END, CASE WHEN b > greatest(coalesce(z, -1), coalesce(a, -1)) THEN b END, CASE WHEN c > greatest(coalesce(z, -1), coalesce(a, -1), coalesce(b, -1)) THEN c END) AS path FROM e WHERE event_type = 'purchase'""")
def hierarchy_stack(spark, sf_dir):
    """Views, clicks and signups are headings of three levels, errors clear, purchases are provisions."""
    kind = F.col("event_type")
    level = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "signup", 3)
    rows = structure.hierarchy(_table(spark, sf_dir, "events"), "user_id", "event_id", level, F.col("event_id").cast("string"), kind == "error")
    return rows.where(kind == "purchase").select("user_id", "event_id", F.array_join("hierarchy", "/").alias("path"))


@_registered("""SELECT source, count(*) AS docs, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr,
CAST(coalesce(sum(toxic), 0) AS BIGINT) AS repealed, CAST(max(length(text)) AS INTEGER) AS longest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def stats_pivot(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), *[F.count_if(F.col("lang") == c).alias(c) for c in ("de", "en", "es", "fr")], F.coalesce(F.sum("toxic"), F.lit(0)).alias("repealed"), F.max(F.length("text")).alias("longest"))


# --- chunking


def _paragraph(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("css_class"))


def _pack_sql(source: str, limit: int, glue: str, extra: int) -> str:
    """Greedy packing of (doc_id, part, i, s) rows within (doc_id, part); ``extra`` is what a piece costs beside its characters."""
    return f"""SELECT doc_id, part, i, 0 AS piece, s AS held FROM {source} WHERE i = 1
    UNION ALL SELECT n.doc_id, n.part, n.i, CASE WHEN p.held <> '' AND length(p.held) + length(n.s) + {extra} > {limit} THEN p.piece + 1 ELSE p.piece END,
      CASE WHEN p.held = '' OR length(p.held) + length(n.s) + {extra} > {limit} THEN n.s ELSE p.held || '{glue}' || n.s END
    FROM packed p JOIN {source} n ON n.doc_id = p.doc_id AND n.part = p.part AND n.i = p.i + 1"""


_SPLIT = r"string_split(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1))"


@_registered(rf"""WITH RECURSIVE x AS (SELECT doc_id, 0 AS part, unnest({_SPLIT}) AS s, generate_subscripts({_SPLIT}, 1) AS i FROM documents),
src AS MATERIALIZED (SELECT doc_id, part, i, trim(s) AS s FROM x), packed AS ({_pack_sql('src', 500, ' ', 1)})
SELECT doc_id, CAST(piece AS INTEGER) AS seq, sha256(max_by(held, i)) AS text_sha256 FROM packed GROUP BY doc_id, piece HAVING max_by(held, i) <> ''""")
def sentence_split_pack(spark, sf_dir):
    pieces = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"), 500)).alias("seq", "t"))
    return pieces.select("doc_id", "seq", text_hash(F.col("t")).alias("text_sha256"))


@_registered(rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS part FROM documents),
x AS (SELECT doc_id, part, unnest({_SPLIT}) AS s, generate_subscripts({_SPLIT}, 1) AS i FROM l WHERE length(text) > 800),
src AS MATERIALIZED (SELECT doc_id, part, i, trim(s) AS s FROM x), packed AS ({_pack_sql('src', 800, ' ', 1)}),
long AS MATERIALIZED (SELECT doc_id, part, piece, max_by(held, i) AS s FROM packed GROUP BY doc_id, part, piece HAVING max_by(held, i) <> ''),
paras AS MATERIALIZED (SELECT doc_id, s, length(s) + 1 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY part, piece) AS i FROM (SELECT doc_id, part, 0 AS piece, text AS s FROM l WHERE length(text) <= 800 UNION ALL SELECT doc_id, part, piece, s FROM long)),
w AS (SELECT doc_id, i, 0 AS seq, n AS held FROM paras WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.held + p.n > 800 THEN seq + 1 ELSE seq END, CASE WHEN w.held + p.n > 800 THEN p.n ELSE w.held + p.n END FROM w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, sha256(string_agg(s, chr(10) ORDER BY i)) AS text_sha256 FROM w JOIN paras USING (doc_id, i) GROUP BY doc_id, seq""")
def chunk_pack_windows(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), _paragraph)
    pieces = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows(lines, 800)).alias("seq", "w"))
    return pieces.select("doc_id", "seq", text_hash(chunking.render(F.col("w"))).alias("text_sha256"))


@_registered("""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, CAST(ts AS DATE) AS day, event_id % 5 + 1 AS k, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS i FROM events),
m AS (SELECT user_id, day, i, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n FROM p WHERE i = 1
  UNION ALL SELECT p.user_id, p.day, p.i, CASE WHEN p.k = m.n + 1 THEN m.n + 1 ELSE m.n END FROM m JOIN p ON p.user_id = m.user_id AND p.day = m.day AND p.i = m.i + 1)
SELECT user_id, day, CASE WHEN max(n) = 0 THEN NULL ELSE CAST(greatest(n, 1) AS VARCHAR) END AS apartado, CAST(count(*) AS INTEGER) AS items FROM (SELECT user_id, day, greatest(n, 1) AS g, n FROM m) GROUP BY user_id, day, g, greatest(n, 1)""")
def chunk_sequence_groups(spark, sf_dir):
    """A user's events of a day are paragraphs numbered 1 to 5 out of order."""
    events = _table(spark, sf_dir, "events")
    text = F.concat((F.col("event_id") % 5 + 1).cast("string"), F.lit(". "), F.col("event_type"))
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))).alias("e"))
    groups = days.select("user_id", "day", F.explode(chunking.apartados(F.transform("e", lambda x: _paragraph(x["t"])))).alias("g"))
    return groups.select("user_id", "day", F.col("g.apartado").alias("apartado"), F.size("g.items").alias("items"))


@_registered("""WITH h AS (SELECT doc_id, sha1(unhex('5b0e1f0c5a8e4c389a532a1f5c3e7d10') || encode(source || '#' || doc_id || '#0')) AS x FROM documents)
SELECT doc_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || CASE WHEN x[17] IN ('0','4','8','c') THEN '8' WHEN x[17] IN ('1','5','9','d') THEN '9' WHEN x[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || x[18:20] || '-' || x[21:32] AS chunk_id FROM h""")
def chunk_ids_uuid5(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"))


@_registered("""SELECT doc_id, sha256(source || ' — ' || 'Norma ' || source || chr(10) || lang || chr(10) || 'Artículo ' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '. Par' ELSE '' END || CASE WHEN n_chars % 3 = 0 THEN ' (apartado ' || (n_chars % 7) || ')' ELSE '' END || chr(10) || text) AS embed_sha256 FROM documents""")
def embed_text_context(spark, sf_dir):
    n = F.col("n_chars")
    text = chunking.embed_text(F.col("source"), F.concat(F.lit("Norma "), "source"), F.array("lang"), F.concat(F.lit("Artículo "), F.col("doc_id")), F.when(n % 2 == 0, "Par"), F.when(n % 3 == 0, (n % 7).cast("string")), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", text_hash(text).alias("embed_sha256"))


@_registered("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN source || ', art. ' || (n_chars % 50) || CASE WHEN n_chars % 2 = 0 THEN '.' || (n_chars % 9) ELSE '' END
 ELSE source || ', Disposición ' || (n_chars % 50) || CASE WHEN n_chars % 2 = 0 THEN ', apartado ' || (n_chars % 9) ELSE '' END END AS citation FROM documents""")
def citation_labels(spark, sf_dir):
    n = F.col("n_chars")
    label = chunking.citation_label(F.col("source"), F.when(n % 3 == 0, "articulo").otherwise("disposicion_final"), (n % 50).cast("string"), F.concat(F.lit("Disposición "), n % 50), F.when(n % 2 == 0, (n % 9).cast("string")))
    return _table(spark, sf_dir, "documents").select("doc_id", label.alias("citation"))


@_registered(r"""SELECT page_id, CAST(len(p) AS INTEGER) AS paragraphs, sha256(array_to_string(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10))) AS text_sha256 FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS p FROM pages)""")
def html_blocks(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)).alias("p"))
    return rows.select("page_id", F.size("p").alias("paragraphs"), text_hash(F.array_join(F.transform("p", clean), "\n")).alias("text_sha256"))


@_registered(rf"""WITH shown AS (SELECT page_id, regexp_replace(regexp_replace(html, '[\x01\x02]', ' ', 'g'), '{html.HIDDEN}', '', 'g') AS h FROM pages),
parted AS (SELECT page_id, regexp_replace(regexp_replace(h, '{html.OPENING}', chr(1) || chr(2), 'g'), '{html.BORDER}', chr(1), 'g') AS h FROM shown),
plain AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(h, '{html.BREAK}', ' ', 'g'), '{html.TAG}', '', 'g'), chr(1)), lambda x: starts_with(x, chr(2))) AS p FROM parted)
SELECT page_id, CAST(len(p) AS INTEGER) AS paragraphs, sha256(array_to_string(list_transform(p, lambda x: trim(regexp_replace(replace(x, chr(2), ''), '\s+', ' ', 'g'))), chr(10))) AS text_sha256 FROM plain""")
def html_paragraphs(spark, sf_dir):
    """Every paragraph with the text of its inline elements; ``html_blocks`` keeps to paragraphs without any."""
    rows = _table(spark, sf_dir, "pages").select("page_id", html.paragraphs(F.col("html")).alias("p"))
    return rows.select("page_id", F.size("p").alias("paragraphs"), text_hash(F.array_join("p", "\n")).alias("text_sha256"))


#: What XML cannot hold, and what Python takes for white space.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@_registered(rf"""WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{NOT_XML}', '', 'g'), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ord FROM d)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'b' || ord AS block_id, DATE '2020-01-01' + CAST(ord % 300 AS INTEGER) AS since, nullif(trim(regexp_replace(line, '{SPACES}', ' ', 'g')), '') AS text FROM e""")
def document_blocks(spark, sf_dir):
    """Documents as responses of the service, a block a line, read back by the pull parser."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), NOT_XML, ""), "\n", -1)
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = lambda i: F.date_format(F.date_add(F.lit(date(2020, 1, 1)), (i % 300).cast("int")), "yyyyMMdd")
    block = lambda t, i: F.concat(F.lit('<bloque id="b'), i.cast("string"), F.lit('" tipo="precepto" titulo="x"><version fecha_vigencia="'), day(i), F.lit('"><p class="parrafo">'), escaped(t), F.lit("</p></version></bloque>"))
    payload = F.concat(F.lit("<response><status><code>200</code></status><data><texto>"), F.array_join(F.transform(lines, block), ""), F.lit("</texto></data></response>"))
    found = xml.blocks(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("norm_id"), payload.alias("payload")))
    version = F.col("versions")[0]
    return found.select(F.col("norm_id").cast("long").alias("doc_id"), "ord", "block_id", version["in_force_since"].alias("since"), F.get(version["paragraphs"], F.lit(0))["text"].alias("text"))


# --- incremental maintenance


@_registered("""SELECT source, sha256('[' || string_agg('["' || doc_id || '", "' || strftime(DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') || '"]', ', ' ORDER BY doc_id) || ']') AS fingerprint FROM documents GROUP BY source""")
def index_fingerprint(spark, sf_dir):
    index = _table(spark, sf_dir, "documents").withColumn("updated_at", F.date_add(F.lit(date(2024, 1, 1)), (F.col("n_chars") % 365).cast("int")))
    return incremental.fingerprints(index, "source", "doc_id", "doc_id")


@_registered("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, sha256(CASE WHEN source = 'src3' THEN text || '.' ELSE text END) AS h FROM documents WHERE lang <> 'es')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, sf_dir):
    """Two snapshots: one lacks the German documents, the other the Spanish ones, and one source has changed."""
    docs = _table(spark, sf_dir, "documents")
    changed = F.when(F.col("source") == "src3", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old = docs.where("lang <> 'de'").select("doc_id", text_hash(F.col("text")).alias("hash"))
    new = docs.where("lang <> 'es'").select("doc_id", text_hash(changed).alias("hash"))
    return incremental.snapshot_diff(old, new, ["doc_id"])


@_registered("SELECT sha256(text) AS text_hash, count(*) AS copies, bool_or(sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en')) AS cached FROM documents GROUP BY sha256(text)")
def cache_hits_misses(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return incremental.cache_lookup(docs, docs.where("lang = 'en'").select(text_hash(F.col("text")).alias("text_hash")))


@_registered("SELECT DISTINCT source AS norm_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3', 'src5', 'src8')")
def catalog_gc_anti(spark, sf_dir):
    state = _table(spark, sf_dir, "documents").select(F.col("source").alias("norm_id"), "doc_id")
    return incremental.forget(state, _values(spark, [(f"src{i}",) for i in (1, 2, 3, 5, 8)], "norm_id string"))[1]


@_registered("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def state_latest_wins(spark, sf_dir):
    return incremental.latest(_table(spark, sf_dir, "events"), ["user_id"], F.col("event_id")).select("user_id", "event_id", "event_type")


@_registered("""SELECT s.norm_id, CASE WHEN d.source IS NULL THEN NULL WHEN s.norm_id = 'src1' THEN 'not indexed' WHEN s.norm_id = 'src2' THEN 'index changed' WHEN s.norm_id = 'src3' THEN 'scheduled change' END AS reason
FROM (VALUES ('src1'), ('src2'), ('src3'), ('src4')) s(norm_id) LEFT JOIN (SELECT DISTINCT source FROM documents) d ON d.source = s.norm_id""")
def due_reasons(spark, sf_dir):
    index = _table(spark, sf_dir, "documents").withColumn("updated_at", F.date_add(F.lit(date(2024, 1, 1)), (F.col("n_chars") % 365).cast("int")))
    now = incremental.fingerprints(index, "source", "doc_id", "doc_id").withColumnRenamed("source", "norm_id")
    state = now.where("norm_id <> 'src1'").select("norm_id", F.when(F.col("norm_id") == "src2", "x").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("norm_id") == "src3", F.lit(DAY)).alias("next_change"))
    return incremental.due(_values(spark, [(f"src{i}",) for i in (1, 2, 3, 4)], "norm_id string"), state, now, DAY)


@_registered("""SELECT c.norm_id, count(d.doc_id) AS chunks, round(coalesce(avg(n_chars), 0), 6) AS avg_chars FROM (VALUES ('src0'), ('src1'), ('src19'), ('none')) c(norm_id) LEFT JOIN documents d ON d.source = c.norm_id GROUP BY c.norm_id""")
def norms_overview(spark, sf_dir):
    counts = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("norm_id")).agg(F.count("*").alias("chunks"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))
    norms = _values(spark, [(x,) for x in ("src0", "src1", "src19", "none")], "norm_id string")
    return norms.join(counts, "norm_id", "left").select("norm_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("avg_chars", F.lit(0.0)).alias("avg_chars"))


# --- answering


@_registered("""SELECT conv_id AS query_id, trim(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS answer,
coalesce(string_agg(DISTINCT CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) FILTER (WHERE role = 'user'), '') AS cited, starts_with(trim(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')), 'No consta en la normativa indexada') AS abstained FROM conversations GROUP BY conv_id""")
def event_fold(spark, sf_dir):
    """Assistant turns are text, user turns cite the source of their number."""
    kind = F.when(F.col("role") == "assistant", "delta").when(F.col("role") == "user", "citation").otherwise("completed")
    none = lambda t: F.lit(None).cast(t)
    events = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), kind.alias("type"), "text", F.col("turn").cast("int").alias("source_index"), none("string").alias("stop_reason"), none("string").alias("model"), *[none("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])
    folded = answering.fold_events(events)
    return folded.select("query_id", "answer", F.array_join(F.array_sort(F.transform("cited_sources", lambda x: x.cast("string"))), ",").alias("cited"), "abstained")


_PRICES = [("small", 1.0, 5.0, 0.1, 1.25), ("large", 4.0, 20.0, 0.2, 5.0)]


@_registered(f"""WITH u AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'small' WHEN 'assistant' THEN 'large' ELSE 'other' END AS model, length(text) // 4 AS i, length(text) // 16 AS o FROM conversations)
SELECT conv_id, turn, u.model, round((i * p.input + o * p.output) / 1e6, 6) AS cost_usd FROM u LEFT JOIN (VALUES {_sql_values(_PRICES)}) p(model, input, output, r, w) ON p.model = u.model""")
def request_cost(spark, sf_dir):
    chars = F.length("text")
    model = F.when(F.col("role") == "user", "small").when(F.col("role") == "assistant", "large").otherwise("other")
    usage = _table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.floor(chars / 4).alias("input_tokens"), F.floor(chars / 16).alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"))
    return answering.costs(usage, _values(spark, _PRICES, schema.PRICING)).select("conv_id", "turn", "model", "cost_usd")


@_registered("""SELECT doc_id, source || ', art. ' || doc_id || ' (texto consolidado a 2024-01-15' || CASE WHEN n_chars % 2 = 0 THEN '; AÚN NO APLICABLE: se aplica desde 2024-02-01' ELSE '' END || CASE WHEN coalesce(toxic, 0) = 1 THEN '; DEROGADO o sin contenido' ELSE '' END || ')' AS title FROM documents LEFT JOIN labels USING (doc_id)""")
def result_titles(spark, sf_dir):
    docs = _filterable(spark, sf_dir)
    later = F.when(F.col("n_chars") % 2 == 0, F.lit(date(2024, 2, 1)))
    cited = F.concat("source", F.lit(", art. "), F.col("doc_id").cast("string"))
    return docs.select("doc_id", answering.result_title(cited, F.lit(None).cast("string"), F.lit(DAY), later, F.coalesce("repealed", F.lit(False)), DAY).alias("title"))


@_registered("""SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS avg_k FROM events GROUP BY event_type""")
def query_log_json(spark, sf_dir):
    parsed = _table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "struct<k:int>"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("p.k"), 6).alias("avg_k"))


@_registered("""SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {"turn":' || turn || ',"n":' || length(text) || '}' || chr(10) || chr(10) AS frame FROM conversations""")
def sse_frames(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", answering.server_sent(F.col("role"), F.struct("turn", F.length("text").alias("n"))).alias("frame"))


@_registered("""SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx FROM conversations WHERE role <> 'system'""")
def source_indices(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("query_id"), "turn")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn")))
    found = answering.sources(ranked.withColumns({"score": F.lit(0.5), "application_date": F.lit(None).cast("date"), "sources": F.array(F.lit("x"))}), DAY)
    return found.select(F.col("query_id").alias("conv_id"), F.col("turn").cast("int").alias("turn"), F.col("index").cast("int").alias("idx"))


# --- ingestion of ordered XML, on a literal

_XML = """<response><status><code>200</code></status><data><texto>
<bloque id="t1" tipo="encabezado" titulo="TÍTULO I"><version fecha_vigencia="20200101"><p class="titulo_num">TÍTULO I</p><p class="titulo_tit">Del objeto</p></version></bloque>
<bloque id="a1" tipo="precepto" titulo="Artículo primero"><version fecha_vigencia="20200101"><p class="articulo">Artículo primero. Ámbito.</p><p>Viejo.</p></version>
<version fecha_vigencia="20230601"><p class="articulo">Artículo primero. Ámbito.</p><p>Nuevo.</p><p>Más.</p></version><version fecha_vigencia="20990101"><p class="articulo">Artículo primero.</p><p>Futuro.</p></version></bloque>
<bloque id="a2" tipo="precepto" titulo="Artículo 2"><version fecha_vigencia="20200101"><p class="articulo">Artículo 2. (Derogado).</p></version></bloque>
<bloque id="a3" tipo="precepto" titulo="Artículo 3" fecha_caducidad="20210101"><version fecha_vigencia="20200101"><p>Caducado.</p></version></bloque>
<bloque id="da" tipo="precepto" titulo="Disposición adicional segunda"><version fecha_vigencia="20200101"><p class="articulo">Disposición adicional segunda. Plazo.</p><p>Un mes.</p></version></bloque>
<bloque id="an" tipo="precepto" titulo="ANEXO"><version fecha_vigencia="20200101"><p class="anexo_num">ANEXO</p><p class="anexo_tit">Tarifas</p><table><tr><th>a</th></tr><tr><td>x</td></tr></table></version></bloque>
</texto></data></response>"""

_INGESTED = [
    ("a1", "articulo", "1", "Ámbito", "TÍTULO I. Del objeto", "Nuevo.\nMás.", 0), ("a2", "articulo", "2", "(Derogado)", "TÍTULO I. Del objeto", "(Sin contenido)", 1),
    ("da", "disposicion_adicional", "2", "Plazo", "", "Un mes.", 0), ("an", "anexo", None, "Tarifas", "", "| a |\n| --- |\n| x |", 0),
]


@_registered(f"SELECT block_id, kind, number, heading, levels, text, repealed = 1 AS repealed FROM (VALUES {_sql_values(_INGESTED)}) t(block_id, kind, number, heading, levels, text, repealed)")
def xml_to_chunks(spark, sf_dir):
    """XML to blocks, wording in force, provisions and chunks."""
    norms = catalog.norms(spark, [{"norm_id": "N", "short_name": "LN", "title": "Ley N"}])
    blocks = xml.blocks(_values(spark, [("N", _XML)], "norm_id string, payload string"))
    provisions = structure.build_provisions(blocks, norms, _values(spark, [], schema.BLOCK_INDEX), DAY)
    chunks = chunking.chunk_provisions(provisions, norms)
    return chunks.select("block_id", "kind", "number", "heading", F.array_join("hierarchy", "/").alias("levels"), "text", "repealed")


_GOLD = [("LCS art. 20", "L50", "articulo", "20", None), ("RDL 3/2020 DA 13", "R3", "disposicion_adicional", "13", None), ("LCS anexo an2", "L50", "anexo", None, "an2")]


@_registered(f"SELECT ref, norm_id, kind, number, block_id FROM (VALUES {_sql_values(_GOLD)}) t(ref, norm_id, kind, number, block_id)")
def gold_parse(spark, sf_dir):
    norms = catalog.norms(spark, [{"norm_id": n, "short_name": s, "title": s, "aliases": a} for n, s, a in _CITED_NORMS])
    return references.parse_gold(_values(spark, [(g[0],) for g in _GOLD], "ref string"), norms)


@_registered("SELECT config, mode, refs = 1 AS refs, rerank = 1 AS rerank FROM (VALUES ('dense', 'dense', 0, 0), ('hybrid+refs', 'hybrid', 1, 0), ('sparse+rerank', 'sparse', 0, 1), ('hybrid+refs+rerank', 'hybrid', 1, 1)) t(config, mode, refs, rerank)")
def config_grid(spark, sf_dir):
    rows = _values(spark, [(c,) for c in ("dense", "hybrid+refs", "sparse+rerank", "hybrid+refs+rerank")], "config string")
    return rows.select("config", evaluation.parse_config(F.col("config")).alias("c")).select("config", "c.*")


@_registered("SELECT doc_id, CAST(1 + greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS INTEGER) AS blocks, source || ' › ' || lang || ' › ' || doc_id AS crumb FROM documents")
def context_blocks(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    block = answering.context_block(F.col("source"), F.array("lang"), doc, F.col("text"), F.lit(""), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", block.alias("b"))
    return rows.select("doc_id", F.size("b.content").alias("blocks"), F.col("b.content")[0]["text"].alias("crumb"))


@_registered("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def cache_fill(spark, sf_dir):
    """What embedding all documents adds to a cache that holds the English ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    embedder = dense.HashEmbedder()
    vector = F.array(*[F.lit(0.0).cast("float")] * embedder.dimension)
    cache = docs.where("lang = 'en'").select(text_hash(F.col("text")).alias("text_hash"), F.lit(embedder.name).alias("model"), vector.alias("vector")).distinct()
    added = incremental.embed_with_cache(docs, cache, embedder.name, lambda wanted: dense.embed(wanted, embedder, "text_hash", "text"), "text")[1]
    return added.select("text_hash")


@_registered("SELECT doc_id, CASE WHEN source = 'src3' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def state_upsert(spark, sf_dir):
    """Through a store of buckets: those of the changed rows' sources are read, changed and written, the others taken over."""
    held, schema = Store(spark, shared_folder(spark)), "source string, doc_id long, n_chars long"
    table = _table(spark, sf_dir, "documents").selectExpr("source", "doc_id", "n_chars")
    held.commit(documents=Buckets(table, "source"))
    changed = table.where("source = 'src3'").withColumn("n_chars", F.col("n_chars") + 1)
    touched = held.touched(changed)
    held.commit(documents=Buckets(incremental.upsert(held.read("documents", schema, touched), changed, ["doc_id"]), "source", touched))
    return held.read("documents", schema).selectExpr("doc_id", "n_chars")


@_registered("""SELECT source AS norm_id, CASE WHEN source = 'src1' THEN 'skipped' ELSE 'updated' END AS status, CASE WHEN source = 'src1' THEN NULL ELSE 'forced' END AS reason,
count(*) FILTER (WHERE lang <> 'es' AND (lang = 'de' OR source = 'src3')) AS changed, count(*) FILTER (WHERE lang = 'es') AS removed, count(*) FILTER (WHERE lang NOT IN ('es', 'de') AND source <> 'src3') AS unchanged FROM documents GROUP BY source""")
def sync_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    diff = snapshot_diff(spark, sf_dir).join(docs.select("doc_id", F.col("source").alias("norm_id")), "doc_id")
    reasons = docs.select(F.col("source").alias("norm_id")).distinct().withColumn("reason", F.when(F.col("norm_id") != "src1", "forced"))
    return incremental.sync_report(diff, reasons)


# --- operators that only tests reached, on whole tables


@_registered("""SELECT norm_id, block_id, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(row_number() OVER (PARTITION BY norm_id, block_id ORDER BY n_chars, CAST(doc_id AS VARCHAR)) AS INTEGER) AS place
FROM (SELECT source AS norm_id, lang AS block_id, doc_id, n_chars FROM documents) WHERE block_id IN ('de', 'fr') AND norm_id <> 'src2'""")
def block_lookup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("norm_id"), F.col("lang").alias("block_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("n_chars").alias("seq"))
    wanted = docs.where("block_id in ('de', 'fr') and norm_id <> 'src2'").select("norm_id", "block_id")
    return references.find_by_block(wanted, docs).select("norm_id", "block_id", "chunk_id", "place")


@_registered(f"WITH {_bm25_sql(10)} SELECT item_id, string_agg(source || '#' || doc_id, ',' ORDER BY rank) AS top FROM sparse JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id")
def top_labels(spark, sf_dir):
    hits = _sparse(spark, sf_dir, 10).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    found = evaluation.top_labels(hits, "item_id", F.concat("source", F.lit("#"), "doc_id"))
    return found.select("item_id", F.array_join("top", ",").alias("top"))


@_registered("""SELECT doc_id, source || CASE WHEN n_chars % 4 = 0 THEN ' anexo an' ELSE ' art. ' || (n_chars % 50) END AS label FROM documents""")
def gold_labels(spark, sf_dir):
    annex = F.col("n_chars") % 4 == 0
    label = references.gold_label(F.col("source"), F.when(annex, "anexo").otherwise("articulo"), (F.col("n_chars") % 50).cast("string"), F.when(annex, "an"))
    return _table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@_registered("""SELECT doc_id, source || ', ' || lang || CASE WHEN n_chars % 2 = 0 THEN '. Par' ELSE '' END || chr(10) || sha256(text) AS passage FROM documents""")
def rerank_passages(spark, sf_dir):
    heading = F.when(F.col("n_chars") % 2 == 0, "Par").when(F.col("n_chars") % 3 == 0, "")
    passage = retrieval.passage(F.col("source"), F.col("lang"), heading, text_hash(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", passage.alias("passage"))


@_registered(f"""WITH {_bm25_sql(20)}, r AS (SELECT item_id, doc_id, CAST(-length(text) AS DOUBLE) AS score, row_number() OVER (PARTITION BY item_id ORDER BY -length(text) DESC, rank, doc_id) AS rank FROM sparse JOIN documents USING (doc_id))
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r""")
def rerank_by_model(spark, sf_dir):
    """A model that prefers short texts, called on batches in Python workers."""
    hits = _sparse(spark, sf_dir, 20).withColumn("sources", F.array(F.lit("sparse")))
    pairs = hits.join(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage")), "doc_id").withColumn("query", F.lit(""))
    scored = retrieval.model_scores(pairs, lambda asked, passages: [-float(len(p)) for p in passages])
    return retrieval.rerank(scored, "item_id", F.col("rerank_score"), "doc_id").select("item_id", "doc_id", "score", "rank")


def _turn_sources(spark, sf_dir) -> DataFrame:
    """User turns as sources of their conversation; texts of an even length do not apply yet."""
    rows = _table(spark, sf_dir, "conversations").where("role = 'user'")
    later = F.when(F.length("text") % 2 == 0, F.lit(date(2024, 2, 1)))
    named = rows.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.lit(0.123456).alias("score"), F.array(F.lit("dense")).alias("sources"), later.alias("application_date"), F.concat(F.lit("turno "), "turn").alias("citation"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"))
    return answering.sources(named, DAY)


@_registered("""SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS index, 'not_yet_applicable' AS code, 'turno ' || turn || ' no se aplica hasta el 2024-02-01.' AS message FROM conversations WHERE role = 'user' AND length(text) % 2 = 0""")
def applicability_warnings(spark, sf_dir):
    return answering.applicability_warnings(_turn_sources(spark, sf_dir))


def _turn_events(spark, sf_dir) -> DataFrame:
    """Assistant turns are deltas, each followed by a citation of the turn before it; every conversation ends cut off."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    none = lambda t: F.lit(None).cast(t)
    said = turns.select(F.col("conv_id").alias("query_id"), (2 * F.col("turn")).cast("int").alias("seq"), F.lit("delta").alias("type"), text_hash(F.col("text")).alias("text"), none("int").alias("source_index"), none("string").alias("stop_reason"))
    cited = turns.select(F.col("conv_id").alias("query_id"), (2 * F.col("turn") + 1).cast("int").alias("seq"), F.lit("citation").alias("type"), F.lit("x").alias("text"), (F.col("turn") - 1).cast("int").alias("source_index"), none("string").alias("stop_reason"))
    end = turns.groupBy(F.col("conv_id").alias("query_id")).agg((2 * F.max("turn") + 2).cast("int").alias("seq")).select("query_id", "seq", F.lit("completed").alias("type"), none("string").alias("text"), none("int").alias("source_index"), F.lit("max_tokens").alias("stop_reason"))
    return said.unionByName(cited).unionByName(end).withColumns({"model": F.lit("m"), "input_tokens": F.lit(1), "output_tokens": F.lit(1)})


@_registered("""WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM t)),
e AS (SELECT DISTINCT conv_id, 0 AS part, 0 AS pos, 'sources' AS type FROM t UNION ALL SELECT conv_id, 1, turn, 'warning' FROM u WHERE length(text) % 2 = 0 UNION ALL SELECT conv_id, 2, 2 * turn, 'delta' FROM t
  UNION ALL SELECT conv_id, 2, 2 * turn + 1, 'citation' FROM t UNION ALL SELECT DISTINCT conv_id, 3, 0, 'warning' FROM t UNION ALL SELECT DISTINCT conv_id, 4, 0, 'done' FROM t)
SELECT conv_id AS query_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, pos, type) - 1 AS INTEGER) AS seq, type FROM e""")
def event_stream(spark, sf_dir):
    events = _turn_events(spark, sf_dir)
    found = _turn_sources(spark, sf_dir).join(events.select("query_id").distinct(), "query_id", "left_semi")
    return answering.event_stream(found, events).select("query_id", "seq", "type")


def _failing(prompt: str, found: list[dict]):
    """A model that breaks off at every seventh length."""
    yield {"type": "delta", "text": str(len(prompt))}
    if len(prompt) % 7 == 0:
        raise RuntimeError("broken")
    yield {"type": "citation", "text": "x", "source_index": 0}
    yield {"type": "completed", "stop_reason": "end_turn", "model": "m", "input_tokens": len(prompt), "output_tokens": 1}


@_registered("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, lang = 'es' AS abstain FROM documents)
SELECT doc_id AS query_id, CASE WHEN abstain THEN 'No consta en la normativa indexada.' ELSE CAST(n AS VARCHAR) END AS answer, CASE WHEN NOT abstain AND n % 7 > 0 THEN 1 ELSE 0 END AS cited,
  CASE WHEN NOT abstain AND n % 7 > 0 THEN 'end_turn' END AS stop_reason, CASE WHEN NOT abstain AND n % 7 > 0 THEN n END AS input_tokens, CASE WHEN NOT abstain AND n % 7 = 0 THEN 'RuntimeError: broken' END AS error, abstain AS abstained FROM d""")
def answers_with_failures(spark, sf_dir):
    """Every document a question; failures stay with their own rows, Spanish ones abstain before the model."""
    none = F.array().cast("array<struct<index:int,text:string>>")
    asked = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("prompt"), F.coalesce(F.col("lang") == "es", F.lit(False)).alias("abstain"), none.alias("sources"))
    return answering.fold_events(answering.generate(asked, _failing)).select("query_id", "answer", F.size("cited_sources").alias("cited"), "stop_reason", "input_tokens", "error", "abstained")


@_registered("""WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT u.conv_id AS query_id, CAST(u.turn AS INTEGER) AS index, t.conv_id IS NOT NULL AS cited FROM u LEFT JOIN t ON t.conv_id = u.conv_id AND t.turn = u.turn + 1""")
def cited_and_uncited(spark, sf_dir):
    folded = answering.fold_events(_turn_events(spark, sf_dir).withColumns({"cache_read_tokens": F.lit(0), "cache_write_tokens": F.lit(0)}))
    return answering.cited_and_uncited(_turn_sources(spark, sf_dir), folded).select("query_id", F.col("index").cast("int").alias("index"), "cited")


@_registered("""SELECT t.conv_id AS query_id, count(*) FILTER (WHERE t.turn - 1 < n) AS kept FROM conversations t JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id) WHERE role = 'assistant' GROUP BY t.conv_id HAVING kept > 0""")
def citations_in_range(spark, sf_dir):
    counts = _turn_sources(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    kept = answering.in_range(_turn_events(spark, sf_dir).where("type = 'citation'"), counts)
    return kept.groupBy("query_id").agg(F.count("*").alias("kept"))


@_registered("""SELECT source AS norm_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS ord, 'b' || doc_id AS block_id, CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS title, DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS updated_at FROM documents""")
def index_payloads(spark, sf_dir):
    """Index responses made of the documents of each source, some without titles, read back."""
    day = F.date_format(F.date_add(F.lit(date(2024, 1, 1)), (F.col("n_chars") % 365).cast("int")), "yyyyMMdd")
    entry = F.struct(F.concat(F.lit("b"), "doc_id").alias("id"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("titulo"), F.concat(day, F.lit("T010203Z")).alias("fecha_actualizacion"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"])
    rows = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("norm_id")).agg(listed.alias("bloque"))
    payload = F.to_json(F.struct(F.struct(F.lit("200").alias("code")).alias("status"), F.struct("bloque").alias("data")))
    return landing.parse_index(rows.select("norm_id", payload.alias("payload")))


@_registered("""SELECT 'n' || doc_id AS norm_id, lang AS title, source AS rank, CASE WHEN n_chars % 2 = 0 THEN DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) END AS entry_into_force, coalesce(toxic, 0) = 1 AS repealed FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_payloads(spark, sf_dir):
    """Metadata responses, one a document, fields as scalars and as objects, read back."""
    day = F.when(F.col("n_chars") % 2 == 0, F.date_format(F.date_add(F.lit(date(2024, 1, 1)), (F.col("n_chars") % 365).cast("int")), "yyyyMMdd")).otherwise("")
    data = F.struct(F.col("lang").alias("titulo"), F.struct(F.lit("1").alias("codigo"), F.col("source").alias("texto")).alias("rango"), day.alias("fecha_vigencia"), F.when(F.col("repealed"), "S").otherwise("N").alias("estatus_derogacion"))
    payload = F.to_json(F.struct(F.struct(F.lit("200").alias("code")).alias("status"), F.array(data).alias("data")))
    raw = _filterable(spark, sf_dir).select(F.concat(F.lit("n"), "doc_id").alias("norm_id"), payload.alias("payload"))
    return landing.parse_metadata(raw).select("norm_id", "title", "rank", "entry_into_force", "repealed")


@_registered("""WITH s AS (SELECT source, min(doc_id) FILTER (WHERE n_chars > 1000) AS f FROM documents GROUP BY source) SELECT source AS norm_id, doc_id AS ord FROM documents JOIN s USING (source) WHERE doc_id > coalesce(f, -1)""")
def approved_text_start(spark, sf_dir):
    """The first long document of a source opens its approved text; sources without one are kept whole."""
    heads = F.col("n_chars") > 1000
    blocks = _table(spark, sf_dir, "documents").select(F.col("source").alias("norm_id"), F.col("doc_id").alias("ord"), F.when(heads, "encabezado").otherwise("precepto").alias("block_type"), F.when(heads, "TEXTO").otherwise("x").alias("title"))
    return structure.after_approval(blocks).select("norm_id", "ord")


@_registered("""SELECT source AS norm_id, count(*) AS provisions, count(*) FILTER (WHERE lang = 'en') AS articulo, count(*) FILTER (WHERE lang <> 'en') AS anexo, count(*) FILTER (WHERE coalesce(toxic, 0) = 1) AS repealed, count(*) AS chunks, CAST(max(length(text)) AS INTEGER) AS longest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def norm_statistics(spark, sf_dir):
    docs = _filterable(spark, sf_dir).withColumnRenamed("source", "norm_id")
    provisions = docs.select("norm_id", F.when(F.col("lang") == "en", "articulo").otherwise("anexo").alias("kind"), F.coalesce("repealed", F.lit(False)).alias("repealed"), F.lit(DAY).alias("block_updated_at"))
    found = structure.norm_statistics(docs.select("norm_id").distinct(), provisions, docs.select("norm_id", "text"))
    return found.select("norm_id", "provisions", "articulo", "anexo", "repealed", "chunks", "longest")


@_registered("""WITH d AS (SELECT *, source IN ('src1', 'src2') AS second FROM documents), n AS (SELECT DISTINCT source FROM documents)
SELECT source AS norm_id, CASE WHEN source = 'src1' THEN 'created' WHEN source = 'src2' THEN 'updated' ELSE 'skipped' END AS status,
CASE WHEN source = 'src1' THEN 'not indexed' WHEN source = 'src2' THEN 'index changed' END AS reason,
count(*) FILTER (WHERE source = 'src1' OR (source = 'src2' AND lang = 'de')) AS changed, CAST(0 AS BIGINT) AS removed, count(*) FILTER (WHERE source = 'src2' AND lang <> 'de') AS unchanged FROM d GROUP BY source""")
def sync_timeline(spark, sf_dir):
    """A second sync in which only two sources were fetched: one is new, one has changed German documents, the others stay."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("norm_id"), F.col("doc_id").alias("block_id"), "lang", text_hash(F.col("text")).alias("hash"))
    norms = docs.select("norm_id").distinct()
    state = norms.where("norm_id <> 'src1'").select("norm_id", F.lit("before").alias("fingerprint"), F.lit(None).cast("date").alias("next_change"))
    delivered = norms.where("norm_id in ('src1', 'src2')")
    reasons = incremental.due(delivered, state, delivered.withColumn("fingerprint", F.lit("now")), DAY)
    reasons = reasons.unionByName(norms.join(delivered, "norm_id", "left_anti").withColumn("reason", F.lit(None).cast("string")))
    new = docs.join(delivered, "norm_id", "left_semi").withColumn("hash", F.when(F.col("lang") == "de", F.concat("hash", F.lit("+"))).otherwise(F.col("hash")))
    old = docs.where("norm_id = 'src2'")
    return incremental.sync_report(incremental.snapshot_diff(old, new, ["norm_id", "block_id"]), reasons)
