"""Every query of the engine's own operators, with its SQL twin."""

from __future__ import annotations

from loomstone.plans import facts, governance, library, retrieval, topics  # noqa: F401
from loomstone.plans import files, indexes, platform, questions, streams  # noqa: F401  register after the modules it takes queries from
from loomstone.plans.catalog import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "ret_04_hybrid_rrf"
