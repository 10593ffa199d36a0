"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


#: The longest ones come last, so that a run within a time limit reaches the others first.
LAST = (
    "fill_nearest", "fill_nan_in_target", "distance_transform", "edge_band_weights", "confidence_gating", "normal_angular_error", "normals_cross_product", "normals_facing_camera",
    "random_sparse_input", "axial_noise", "theta_dropout", "low_frequency_error", "step_geometry", "step_geometry_error", "step_error_medians", "zone_report", "edge_cleaning",
    "edge_dropout", "alignment_sweep", "robust_plane_fit", "plane_quality_by_camera", "local_calibration_bilateral", "bilateral_smooth", "active_stereo_chain", "active_stereo_valid_ratio",
    "severity_presets_applied", "severity_chain", "sequential_chain", "sequential_chain_report", "paired_comparison_table", "cluster_bootstrap_ci", "normal_estimators_all", "loader_registry_all",
)


def load() -> dict:
    """Import every ``q_*`` module and return the registry."""
    from gridspark.catalog.registry import REGISTRY

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{mod}")
    return {k: REGISTRY[k] for k in sorted(REGISTRY, key=lambda k: k in LAST)}
