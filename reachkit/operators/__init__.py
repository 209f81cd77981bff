"""Operators: DataFrame in, DataFrame out."""

from reachkit.operators.assign import assign_vids
from reachkit.operators.curves import frequency_head, reach_points
from reachkit.operators.datagen import add_n_impressions, gen_people_table, gen_synthetic_impressions
from reachkit.operators.explode import explode_weights_to_impressions
from reachkit.operators.exposure import add_exposure_index, add_first_exposure, add_frequency_total
from reachkit.operators.fit import fit_curve, fit_mixture_of_deltas
from reachkit.operators.frequency import generate_frequency_table
from reachkit.operators.mixture import (
    delta_points,
    fit_overlay,
    fit_summary,
    mixture_eval,
    penetrate_uniform_reach,
    population_total,
)
from reachkit.operators.pools import mixture_of_delta_pool_info
from reachkit.operators.reach import generate_reach_table
from reachkit.operators.vid_table import generate_vid_assignment_table, packed_vid_table

__all__ = [
    "add_exposure_index", "add_frequency_total", "add_first_exposure",
    "generate_reach_table", "generate_frequency_table", "explode_weights_to_impressions",
    "population_total", "penetrate_uniform_reach", "fit_overlay", "fit_summary", "delta_points",
    "mixture_eval", "fit_curve", "fit_mixture_of_deltas", "reach_points", "frequency_head",
    "generate_vid_assignment_table", "packed_vid_table", "assign_vids", "mixture_of_delta_pool_info",
    "gen_people_table", "add_n_impressions", "gen_synthetic_impressions",
]
