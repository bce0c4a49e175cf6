"""Registered queries and their SQL oracle."""

from . import frames, messages, native, poses, sessions, sets, streams, text  # noqa: F401  (register queries)
from . import oracle_messages, oracle_native, oracle_poses, oracle_sessions, oracle_sets, oracle_text  # noqa: F401  (register oracle SQL)
from .oracle import ORACLE
from .registry import QUERIES

__all__ = ["QUERIES", "ORACLE"]
