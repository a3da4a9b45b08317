"""All queries of the core: importing the modules of queries fills the registry."""

from __future__ import annotations

from citegrove.plans.registry import REGISTRY

import citegrove.plans.curation_queries  # noqa: E402,F401
import citegrove.plans.identity_queries  # noqa: E402,F401
import citegrove.plans.retrieval_queries  # noqa: E402,F401
import citegrove.plans.scoring_queries  # noqa: E402,F401
import citegrove.plans.source_queries  # noqa: E402,F401
import citegrove.plans.text_queries  # noqa: E402,F401,I001

__all__ = ["REGISTRY"]
