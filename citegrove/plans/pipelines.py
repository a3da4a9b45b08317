"""The end-to-end flows, composed of the operators: gather, curate, retrieve, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.operators import curation, identity, ranking, retrieval, scoring
from citegrove.plans.materialize import settle


@dataclass(frozen=True)
class GatherSpec:
    """What a bundle is gathered for; lower-case subfields and keywords."""

    subfields: list[str]
    keywords: list[str] = field(default_factory=list)
    topic_ids: list[str] = field(default_factory=list)
    top_k: int = 30
    now: int = 2026


def gather(papers: DataFrame, spec: GatherSpec, pool: str = "pool", bodies: DataFrame | None = None) -> DataFrame:
    """Records merged in two passes, ranked, kept where bodies (seq) has their text, and cut to a balanced top-k of each pool."""
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    merged = identity.merge_by_version(identity.merge_by_identity(papers))
    merged = merged.withColumn(pool, F.coalesce("venue", F.lit("")))
    ranked = ranking.composite_rank(merged, pool, arr(spec.subfields), arr(spec.keywords), arr(spec.topic_ids), spec.now)
    if bodies is not None:
        ranked = ranked.join(bodies.select("seq").distinct(), "seq", "left_semi")
    return ranking.balanced_top_k(ranked, pool, spec.top_k, spec.now)


def curate(items: DataFrame, lanes: list[str] | None = None, fmt: str = "0.4", least: int = 2) -> DataFrame:
    """The claim's card out of the menus of all its subfields: merged by names, absorbed, pruned by evidence, slots dealt over the subfields."""
    return curation.curate(items, lanes, fmt, least)


def retrieve(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, group: str, k: int = 30, cap: int = 3) -> DataFrame:
    """The k best passages of each query with cap of one group at most."""
    cut = settle(retrieval.passages(docs.select(key, group, text), key, text, group).withColumn("passage_id", F.concat_ws(":", key, F.lpad("pos", 6, "0"))))
    best = retrieval.bm25(queries, query_key, query_text, cut, "passage_id", "passage", k, group=group, cap=cap)
    return best.join(cut, "passage_id").withColumnRenamed("rank", "place")


def evaluate(passes: DataFrame, contested: str = "mean") -> DataFrame:
    """Recall of each arm from its passes."""
    return scoring.recall(scoring.aggregate_runs(passes), scoring.ARM, contested)
