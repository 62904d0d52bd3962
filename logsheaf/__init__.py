"""Spark-native analytics over security logs: events, sessions, tokens."""

from logsheaf.config import SessionConfig, TokenConfig
from logsheaf.session import build_session

__all__ = ["SessionConfig", "TokenConfig", "build_session"]
