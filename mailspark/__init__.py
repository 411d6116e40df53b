"""mailspark: correspondence and event analytics as Spark jobs over DataFrames."""

from mailspark.session import build_session, checkpointed, pin_utc

__all__ = ["build_session", "checkpointed", "pin_utc"]
