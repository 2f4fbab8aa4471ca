"""KnowledgeGraph: the library's operators on one data folder, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronograph.operators import extract, graph, search, store, temporal
from kronograph.sources import model


class KnowledgeGraph:
    """Every method gives a DataFrame; nothing runs before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def entities(self) -> DataFrame:
        return model.entities(self.spark, self.sf_dir)

    def episodes(self) -> DataFrame:
        return model.episodes(self.spark, self.sf_dir)

    def edges(self, *relationships: str) -> DataFrame:
        return model.edges(self.spark, self.sf_dir, *relationships)

    def node(self, node_id: str) -> DataFrame:
        return self.entities().filter(F.col("id") == node_id)

    def search_memory(self, text: str, limit: int = 20) -> DataFrame:
        e = self.episodes().withColumn("score", search.service_score(text, F.col("content"), F.col("name"))).filter("score is not null")
        return search.top(e, limit, F.desc("score"), F.desc("valid_from"), "id")

    def related(self, node_id: str, depth: int = 2, relationships: tuple[str, ...] = ("IN_REGION", "IN_NATION")) -> DataFrame:
        seeds = self.spark.createDataFrame([(node_id,)], "id string")
        return graph.bfs(graph.adjacency(self.edges(*relationships)), seeds, depth).filter("depth > 0")

    def path(self, source: str, target: str, depth: int = 6, relationships: tuple[str, ...] = ("IN_REGION", "IN_NATION")) -> DataFrame:
        return graph.shortest_path(graph.adjacency(self.edges(*relationships)), source, target, depth)

    def as_of(self, at: str, known_at: str | None = None, *relationships: str) -> DataFrame:
        return temporal.snapshot(self.edges(*relationships), model.ts(at), model.ts(known_at) if known_at else None)

    def conflicts(self, *relationships: str) -> DataFrame:
        return temporal.conflicts(self.edges(*relationships))

    def mentions(self) -> DataFrame:
        return self.episodes().filter("episode_type <> 'event'").select("id", F.explode(extract.capitalised(F.col("content"))).alias("entity"))

    def sql(self, text: str) -> DataFrame:
        """SQL over the model's views entities, episodes and edges and over the tables."""
        model.register(self.spark, self.sf_dir)
        return self.spark.sql(text)

    def history(self, node_id: str, *relationships: str) -> DataFrame:
        """Versions of the edges of a node, in order."""
        touching = store.adjacent(self.edges(*relationships), node_id)
        return temporal.versions(touching)

    def without_episodes(self, ids: DataFrame) -> DataFrame:
        """The episodes that are left when those with the given ids go."""
        return store.without(self.episodes(), ids)

    def without_edges(self, ids: DataFrame, *relationships: str) -> DataFrame:
        return store.without(self.edges(*relationships), ids)

    def facts(self, text: str, limit: int = 20) -> DataFrame:
        """Edges whose relationship or ends hold a text, newest first."""
        t = text.lower()
        hit = F.lower(F.concat_ws(" ", "source_id", "relationship", "target_id")).contains(t)
        return search.top(self.edges().filter(hit), limit, F.desc("valid_from"), "id")
