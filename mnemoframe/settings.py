"""Settings passed as an argument to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # which parts of the lifecycle run
    enable_semantic_memory: bool = True
    enable_episodic_memory: bool = True
    enable_procedural_memory: bool = True
    enable_retrieval_planning: bool = True
    enable_keyword_retrieval: bool = True
    enable_vector_retrieval: bool = True
    enable_contradiction_detection: bool = True
    enable_temporal_resolution: bool = True
    enable_numeric_scope: bool = True
    enable_consolidation: bool = True
    enable_fallback_retrieval: bool = True
    enable_answer_generation: bool = True
    enable_memory_evaluation: bool = True
    # thresholds
    extraction_confidence_threshold: float = 0.65
    contradiction_confidence_threshold: float = 0.75
    consolidation_confidence_threshold: float = 0.85
    # retrieval
    retrieval_limit: int = 40
    fallback_retrieval_limit: int = 20
    include_superseded_in_standard_retrieval: bool = False
    allow_general_knowledge_in_answers: bool = False
    # concepts
    max_concepts_per_memory: int = 6
    concept_dedup_similarity: float = 0.92
    # agentic retrieval
    retrieval_strategy: str = "flat"
    agentic_max_iterations: int = 4
    agentic_confidence_threshold: float = 0.75
    agentic_max_facts: int = 40
    agentic_concept_search_limit: int = 10
    agentic_match_question_entities: bool = False
    agentic_direct_fact_fallback: bool = True
    agentic_entity_overlap_weight: float = 0.0
    agentic_rerank_keep_ratio: float = 0.0
    agentic_rerank_limit: int = 40
    # reranking
    enable_rerank: bool = False
    rerank_keep: int = 12
    default_policy_name: str = "default"

    def but(self, **changes) -> "Settings":
        """A copy with some fields changed."""
        return replace(self, **changes)


DEFAULTS = Settings()
