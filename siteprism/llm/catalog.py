"""All registered queries of this subpackage."""

from siteprism.llm import q_centroids, q_decontaminate, q_embeddings, q_jaccard, q_language, q_licences, q_merkle, q_pieces, q_quality, q_sharding, q_suffixes, q_token_counts, q_toxicity  # noqa: F401
from siteprism.llm.registry import ORACLES, QUERIES  # noqa: F401
