"""All knobs of the linking job in one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    """Defaults are those of the whole pipeline; the evaluators' variants are given below."""

    backend: str = "fuzzy"  # fuzzy, difflib, search or token
    top_k: int = 10
    expansion_top_k: int = 30
    use_variants: bool = True
    use_abbreviations: bool = True
    use_expansion: bool = True
    use_rules: bool = True
    use_topics: bool = True
    use_model: bool = False
    merge: str = "max"  # or append
    kg_boost: float = 2.0
    type_penalty: float = -30.0
    overlap_boost: float = 3.0
    protect_from: float = 90.0
    topic_boost: float = 3.0
    topic_penalty: float = -3.0
    topic_least: int = 4
    use_dense: bool = False  # needs an encoder
    hybrid_alpha: float = 0.7
    model_top_k: int = 10
    split_commas: bool = False


#: The evaluator of the rules alone.
RULES_ONLY = LinkConfig(kg_boost=5.0, type_penalty=-30.0, overlap_boost=10.0, use_expansion=False, use_topics=False)
#: The evaluator of the model step alone.
MODEL_ONLY = LinkConfig(use_expansion=False, use_rules=False, use_topics=False, use_model=True, model_top_k=5)
