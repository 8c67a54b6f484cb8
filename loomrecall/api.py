"""The engine as one object: searches, graph questions and status over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.functions import vectors as V
from loomrecall.operators import codegraph, fusion, index, records
from loomrecall.operators.tables import chunk_path, current_chunks, current_files, current_records
from loomrecall.operators.vectors import exact_neighbors
from loomrecall.plans.reports import project_status
from loomrecall.plans.search import usable_record_vectors
from loomrecall.session import materialize, table

MODES = ("bm25", "semantic", "hybrid")


class Engine:
    """Questions to one folder of tables; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables
        self._graph: tuple[DataFrame, DataFrame] | None = None

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.tables, name)

    def search_files(
        self, query: str, limit: int = 10, languages: list[str] | None = None, paths: list[str] | None = None, project: str | None = None,
        mode: str = "bm25", vectors: DataFrame | None = None, query_vector: list[float] | None = None, alpha: float | None = None,
    ) -> DataFrame:
        """Chunks by words, by vectors or by both, boosted and thinned out per file. Statistics are those of the filtered chunks.

        The modes ``semantic`` and ``hybrid`` take the chunks' ``vectors`` (id, embedding) and the query's own vector of the same model.
        ``alpha`` weighs vectors against words in ``hybrid``; without it symbol queries lean on words.
        """
        if not query.strip() or limit < 1 or mode not in MODES:
            raise ValueError(f"a query, a positive limit and one of the modes {MODES} are needed")
        if mode != "bm25" and (vectors is None or not query_vector):
            raise ValueError("vectors of the chunks and of the query are needed")
        path = chunk_path("file_record_id")
        rows = current_chunks(self._table("indexed_chunks")).where("search_text is not null").withColumn("file_path", path)
        if project:
            rows = rows.where(F.col("project_key") == project)
        if languages:
            rows = rows.where(F.lower(F.coalesce(T.language(F.col("file_path")), F.lit("text"))).isin([x.lower() for x in languages]))
        if paths:
            rows = rows.where(F.exists(F.array(*[F.lit(p) for p in paths]), lambda p: F.col("file_path").contains(p)))
        key = ["id", "project_key", "file_path", "chunk_index"]
        wide = 5 * limit
        lists = []
        if mode != "semantic":
            terms = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(T.tokens(F.lit(query))))).collect()]
            own = F.size(T.tokens(F.col("chunk_text")))
            length = F.when(own > 0, own).otherwise(F.size(T.tokens(F.col("search_text"))))
            lists.append(index.bm25(rows, key, T.tokens(F.col("search_text")), terms, length))
        if mode != "bm25":
            asked = F.array(*[F.lit(float(x)) for x in query_vector])
            near = rows.select(*key).join(vectors.where(F.size("embedding") == len(query_vector)).select("id", "embedding"), "id")
            lists.append(near.select(*key, V.cosine(asked, F.col("embedding")).alias("score")).where("score > 0"))
        best = [x.orderBy(F.desc("score"), "file_path", "chunk_index", "id").limit(wide).withColumn("query_text", F.lit(query)) for x in lists]
        by = ["query_text"]
        if mode == "hybrid":
            share = F.lit(alpha) if alpha is not None else F.when(T.is_symbol_query(F.col("query_text")), F.lit(C.SYMBOL_ALPHA)).otherwise(F.lit(C.DEFAULT_ALPHA))
            lex, sem = [fusion.ranked(x, by, "score", ["file_path", "chunk_index", "id"], n).select(*key, "query_text", n) for x, n in zip(best, ("lr", "sr"), strict=True)]
            both = lex.join(sem, [*key, "query_text"], "full_outer")
            fused = share * F.coalesce(fusion.rrf(F.col("sr")), F.lit(0.0)) + (F.lit(1.0) - share) * F.coalesce(fusion.rrf(F.col("lr")), F.lit(0.0))
            cands = both.select(*key, "query_text", fused.alias("score"))
        else:
            cands = best[0]
        cands = cands.select(*key, "query_text", "score")
        texts = rows.select(*key, "chunk_text").withColumn("query_text", F.lit(query))
        cands = materialize(fusion.with_definitions(cands, texts, "query_text", "chunk_text", key, "score"), "search-candidates")
        ties = ["project_key", "chunk_index", "id"]
        boosted = fusion.coherence_boost(cands, by, "file_path", "score", ties)
        held = boosted.join(rows.select("id", "chunk_text"), "id")
        held = fusion.definition_boost(held, by, "query_text", "file_path", "chunk_text", "score")
        held = fusion.embedded_boost(held, by, "query_text", "file_path", "chunk_text", "score").drop("chunk_text")
        held = fusion.stem_boost(held, by, "query_text", "file_path", "score")
        return fusion.saturated(held, by, "file_path", "score", ties, limit).drop("query_text").orderBy("rank")

    def related_chunks(self, project: str, file_path: str, line: int, vectors: DataFrame, limit: int = 5) -> DataFrame:
        """The chunks whose vectors (id, embedding) are nearest to that of the chunk that holds a line of a file; that chunk is left out."""
        if limit < 1 or line < 1:
            raise ValueError("a line and a limit from 1 on are needed")
        rows = current_chunks(self._table("indexed_chunks")).where(F.col("project_key") == project)
        seed = rows.where((chunk_path("file_record_id") == file_path) & F.lit(line).between(F.col("start_line"), F.col("end_line"))).orderBy("chunk_index", "id").limit(1).select("id")
        own = vectors.join(rows.select("id"), "id", "left_semi")
        near = exact_neighbors(own, own.join(F.broadcast(seed), "id", "left_semi"), "id", "embedding", limit).drop("query_id")
        return near.join(rows.select("id", chunk_path("file_record_id").alias("file_path"), "chunk_index"), "id").orderBy("rank")

    def search_memory(self, query: str, limit: int = 10, scope: str | None = None) -> DataFrame:
        """Records by their signals in hybrid mode."""
        rows = current_records(self._table("memory_records"))
        if scope:
            rows = rows.where(F.col("scope") == scope)
        return records.ranked_signals(rows, query, "hybrid").orderBy(F.desc("semantic"), F.desc("score"), "id").limit(limit)

    def related(self, record_id: str, limit: int = 5) -> DataFrame:
        """The records whose vectors are nearest to one record's, of its provider and model."""
        vecs = usable_record_vectors(self._table("record_embeddings"))
        one = vecs.where(F.col("record_id") == record_id)
        same = vecs.join(F.broadcast(one.select("provider_key", "model").limit(1)), ["provider_key", "model"])
        return exact_neighbors(same, one, "record_id", "embedding", limit).drop("query_id")

    def lookup(self, **identity: str) -> DataFrame:
        """Records by scope, ident, namespace, leaf and parent."""
        return records.lookup(current_records(self._table("memory_records")), **identity)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Vertices and edges, built once per engine."""
        if self._graph is None:
            self._graph = codegraph.code_graph(current_chunks(self._table("indexed_chunks")), current_files(self._table("file_records")))[1:]
        return self._graph

    def graph_query(self, text: str, limit: int = 10) -> DataFrame:
        """Vertices for a text with their degrees."""
        n, e = self.graph()
        hit = n.withColumn("score", codegraph.match_score(F.col("label"), F.col("source_file"), text)).where("score is not null").orderBy(F.desc("score"), "label", "id").limit(limit)
        return hit.join(codegraph.degrees(e, hit), ["project_key", "id"], "left").fillna(0, ["in_degree", "out_degree"])

    def graph_explain(self, text: str, limit: int = 10) -> DataFrame:
        """The best vertex for a text with its best edges."""
        best = self.graph_query(text, 1)
        n, e = self.graph()
        return codegraph.labelled(codegraph.top_adjacent(e, best.select("project_key", "id"), limit), n)

    def graph_path(self, source: str, target: str, max_depth: int = 4) -> DataFrame:
        """A shortest path between the best vertices for two texts."""
        both = self.graph_query(source, 1).select(F.col("id").alias("s"), F.lit(None).cast("string").alias("t")).unionByName(self.graph_query(target, 1).select(F.lit(None).cast("string").alias("s"), F.col("id").alias("t")))
        ends = both.agg(F.max("s").alias("s"), F.max("t").alias("t")).where("s is not null and t is not null")
        return codegraph.shortest_path(self.graph()[1], "s", "t", ends, max_depth)

    def status(self) -> DataFrame:
        """Projects with their counts and health."""
        return project_status(self.spark, self.tables)
