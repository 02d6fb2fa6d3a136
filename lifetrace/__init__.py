"""lifetrace: object-lifetime trace analytics as plain Spark jobs."""

from lifetrace.trace import Trace

__all__ = ["Trace"]
