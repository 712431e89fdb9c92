"""Load spectra, statistics and outliers of vehicle fleets on Spark."""

from fleetspectra.operators.cohort import (
    cohort_combinations,
    extract_signals,
    in_period,
    merge_sketches,
    sample_vehicles,
    select_cohort,
    sketched_count,
    vehicle_count,
    vehicle_count_approx,
    vehicle_sketches,
)
from fleetspectra.operators.comparison import (
    box_stats,
    radar_profile,
    stat_histogram,
    weighted_fleet_average,
)
from fleetspectra.operators.anomalies import anomaly_scores, grow_trees, score_anomalies
from fleetspectra.operators.clustering import cluster_spectra, quantile_vectors
from fleetspectra.operators.distances import fleet_distances, group_distances
from fleetspectra.operators.fleet import (
    complete_cells,
    fleet_average,
    fleet_average_cells,
    fleet_before_after,
    sort_averages,
    vehicle_vs_fleet,
)
from fleetspectra.operators.grid import (
    complete_spectra,
    grid_bounds,
    normalize_spectra,
    total_distance,
    upper_edge_quantile,
)
from fleetspectra.operators.ordering import clean_with_previous, with_previous
from fleetspectra.operators.outliers import (
    completeness_outliers,
    iqr_bounds,
    iqr_outliers,
    mileage_outliers,
    outlier_vins,
    removal_summary,
    removal_totals,
    remove_outliers,
    removed_vins,
    weight_matrix,
    weight_shares,
    zero_mass_outliers,
)
from fleetspectra.operators.quantiles import grouped_quantiles
from fleetspectra.operators.signals import (
    add_distance,
    add_engine_power,
    add_gear_shift,
    add_time_since_last,
    clean_signals,
    interpolate_signals,
)
from fleetspectra.operators.spectra import (
    inspect_vehicle,
    one_spectrum,
    rebin_spectra,
    spectra,
    stack_spectra,
)
from fleetspectra.operators.statistics import SignalNames, vehicle_stats
from fleetspectra.operators.translation import name_signals, spectra_metadata, translate_spectra
from fleetspectra.sources.tables import (
    read_group_family,
    read_table,
    save_bucketed,
    save_signals,
    save_table,
    stored,
)
from fleetspectra.spec import Axis, CleanRule, SpectrumSpec, engine_spec, vehicle_specs
from fleetspectra.streaming.cleaning import clean_stream
from fleetspectra.streaming.tables import BatchTable, start_table

__all__ = [name for name in dir() if not name.startswith("_")]
