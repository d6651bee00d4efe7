"""All queries of the subpackage."""

from cohortry.llm import (  # noqa: F401
    chunks, decontaminate, factorisation, lexical, minhash, negatives, pieces, privacy, quality, retrieval, secrets, sequences, sharding,
)
from cohortry.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
