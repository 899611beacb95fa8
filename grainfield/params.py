"""Tunable parameters with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Name, default, least and most allowed. An int default makes an int parameter.
_TABLE = """
histogram_chunks_per_thread 4 1 64
histogram_min_chunk 262144 1024 16777216
auto_cap 0.02 0.0 0.49
tail_steps 200 2 65536
tail_noise_sigma 2.0 0.0 100.0
tail_min_span 4.0 0.000001 65535.0
tail_knee_score 0.2 0.0 1.0
dark_snr 2.0 0.0 100.0
strength_target_base 1.0 0.0 49.0
strength_knee_weight 0.5 0.0 10.0
strength_target_min 1.0 0.0 49.0
strength_target_max 2.0 0.0 49.0
tied_span 1.0 0.000001 65535.0
noise_warning_sigmas 8.0 0.0 1000.0
coherent_samples 500000 1 10000000
coherent_radius 1 1 8
coherent_neighbors 5 1 288
coherent_min_support 4 1 1000000
coherent_tail_fraction 0.005 0.0 0.5
coherent_noise_margin 2.0 0.0 100.0
noise_patch_side 16 5 128
noise_max_patches 12000 1 1000000
noise_haar_lag_small 1 1 127
noise_haar_lag_medium 2 1 127
noise_haar_lag_large 4 1 127
noise_texture_max 1.5 0.01 100.0
noise_lag_growth_max 1.35 0.01 100.0
noise_min_patches 32 1 1000000
noise_patches_per_bin 48 1 1000000
noise_max_bins 16 3 128
noise_variance_quantile 0.25 0.05 0.95
noise_min_sigma 0.5 0.000001 65535.0
noise_fit_min_bins 6 3 128
noise_fit_min_span 16.0 0.000001 65535.0
noise_fit_pair_separation 0.15 0.0 0.99
noise_fit_iterations 4 0 64
noise_fit_residual_scale 0.15 0.000001 10.0
noise_fit_negative_slope 0.15 0.0 10.0
noise_fit_max_error 0.25 0.0 10.0
noise_refinement_passes 3 0 32
noise_fit_success_fraction 0.8 0.01 1.0
noise_sensitivity_tail 0.1 0.0 0.5
noise_read_ratio_max 3.0 1.0 100.0
noise_extrapolation_fraction 0.35 0.0 100.0
noise_shadow_read_sigmas 6.0 0.0 1000.0
noise_tail_divisor 5 1 1024
noise_correlation_min_variance 0.25 0.0 4294836225.0
noise_correlation_warning 1.3 0.0 1000.0
noise_profile_tolerance 2.0 1.0 1000.0
optimize_strength 1.0 0.0 1.0
tone_exposure_bias 0.0 -16.0 16.0
tone_min_exposure_ev -2.0 -16.0 16.0
tone_max_exposure_ev 6.0 -16.0 16.0
tone_exposure_steps 8 1 64
tone_midtone_quantile 0.5 0.0 1.0
tone_shadow_quantile 0.1 0.0 1.0
tone_highlight_quantile 0.9 0.0 1.0
tone_target_midtone 0.43 0.0 1.0
tone_midtone_tolerance 0.15 0.000001 1.0
tone_target_contrast 0.6 0.0 1.0
tone_contrast_tolerance 0.4 0.000001 1.0
tone_contrast_weight 0.15 0.0 1000.0
tone_noise_threshold 0.1 0.0 1.0
tone_noise_tolerance 0.1 0.000001 1.0
tone_noise_weight 0.35 0.0 1000.0
tone_contrast_strength 0.75 0.0 1.0
tone_bins 1024 16 65536
tone_smoothing_passes 3 0 64
tone_smoothing_radius 2 0 16
tone_density_prior 0.15 0.000001 100.0
tone_density_power 0.5 0.0 4.0
tone_noise_target 0.04 0.000001 1.0
tone_cap_min 1.15 1.0 64.0
tone_cap_max 3.0 1.0 64.0
tone_slope_min 0.35 0.0 1.0
tone_solver_upper 32.0 0.000001 1000000000.0
tone_solver_iterations 48 1 128
expression_max_bytes 16384 1 1048576
expression_max_parentheses 128 1 512
expression_max_depth 256 1 512
mapping_steps 20 2 1000
mapping_input_decimals 2 0 12
mapping_output_decimals 5 0 17
progress_dr_decimals 1 0 12
progress_range_decimals 1 0 12
progress_clip_decimals 3 0 12
progress_elapsed_decimals 1 0 6
progress_aperture_decimals 2 0 12
"""

BOUNDS: dict[str, tuple[float, float]] = {}
DEFAULTS: dict[str, float] = {}
for _name, _default, _least, _most in (line.split() for line in _TABLE.split("\n") if line):
    DEFAULTS[_name] = float(_default) if "." in _default else int(_default)
    BOUNDS[_name] = (float(_least), float(_most))


class _Base:
    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name not in BOUNDS:
                continue
            least, most = BOUNDS[f.name]
            if isinstance(DEFAULTS[f.name], int) and not (isinstance(value, int) and not isinstance(value, bool)):
                raise ValueError(f"{f.name} must be a whole number")
            if not least <= value <= most:
                raise ValueError(f"{f.name} must be within {least:g}..{most:g}")
        checks = (
            (self.strength_target_min <= self.strength_target_max, "strength targets are out of order"),
            (self.coherent_neighbors <= (2 * self.coherent_radius + 1) ** 2 - 1, "coherent_neighbors exceeds the neighbourhood"),
            (self.noise_haar_lag_small < self.noise_haar_lag_medium < self.noise_haar_lag_large < self.noise_patch_side, "haar lags are out of order"),
            (self.noise_fit_min_bins <= self.noise_max_bins, "noise_fit_min_bins exceeds noise_max_bins"),
            (self.tone_min_exposure_ev <= self.tone_max_exposure_ev, "exposure bounds are out of order"),
            (self.tone_shadow_quantile <= self.tone_midtone_quantile <= self.tone_highlight_quantile, "tone quantiles are out of order"),
            (self.tone_cap_min <= self.tone_cap_max, "tone caps are out of order"),
            (self.tone_solver_upper * self.tone_density_prior >= 1, "tone_solver_upper is too small for tone_density_prior"),
        )
        for fine, what in checks:
            if not fine:
                raise ValueError(what)


Parameters = dataclass(frozen=True)(
    type(
        "Parameters",
        (_Base,),
        {"__annotations__": {k: type(v) for k, v in DEFAULTS.items()} | {"jpeg_optimize_huffman": bool}, **DEFAULTS, "jpeg_optimize_huffman": True, "__doc__": "Validated knobs; see `BOUNDS`."},
    )
)
