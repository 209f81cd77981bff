"""Column expressions (all JVM-side built-ins: no Python UDF on the hot path)."""

from reachkit.functions.hashing import (
    hash_string,
    hash_uniform,
    seeded_uniform,
    vid_chain,
    vid_chain_pieces,
)
from reachkit.functions.mixture import array_sum, mixture_reach, params_array
from reachkit.functions.rounding import half_up_int, stochastic_round

__all__ = [
    "hash_string",
    "hash_uniform",
    "seeded_uniform",
    "vid_chain",
    "vid_chain_pieces",
    "mixture_reach",
    "array_sum",
    "params_array",
    "half_up_int",
    "stochastic_round",
]
