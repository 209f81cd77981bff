"""reachkit: reach, frequency and virtual-ID audience measurement on Spark DataFrames."""

from reachkit.operators import *  # noqa: F401,F403
from reachkit.operators import __all__ as _ops
from reachkit.session import local_session

__all__ = [*_ops, "local_session"]
