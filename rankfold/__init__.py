"""Rankfold: a DataFrame library that turns landed listings into one ranked table."""

from rankfold.config import SearchConfig
from rankfold.session import build_session

__all__ = ["SearchConfig", "build_session"]
__version__ = "0.1.0"
