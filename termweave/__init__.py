"""termweave: build, widen and apply phrase dictionaries with Spark DataFrames."""

from termweave.session import build_session, durable

__all__ = ["build_session", "durable"]
