"""Declared record types (DDL); sources never infer a schema."""

METADATA = "struct<image_id string, iso int, shutter_speed_s double, ev double, aperture double>"
ACTION = "struct<iso int, shutter double>"
QUALITY = "struct<brightness double, noise double, motion_blur double, highlight double, shadow double, overall_quality double>"
REPORT = (
    f"struct<quality {QUALITY}, dynamic_range double, midtone_ratio double, sharpness_confidence double, exposure_score double,"
    " contrast_score double, noise_score double, sharpness_score double, acceptable boolean, calibration_version string>"
)
FEATURES = f"struct<luminance_histogram array<double>, histogram_bins int, visual_embedding array<double>, objective_quality {REPORT}, feature_version string>"
EXPERIENCE = (
    "run_id string, scene_id string, physical_scene_id string, cross_fold int, dataset_split string, original_image_path string, output_image_path string,"
    f" initial_metadata {METADATA}, final_metadata {METADATA}, fixed_features {FEATURES}, initial_vlm_action {ACTION}, integrated_vlm_action {ACTION},"
    f" final_action {ACTION}, quality_before {REPORT}, quality_after {REPORT}, quality_gain double, successful boolean, label_source string, simulator_version string"
)
DECISION = f"struct<quality {QUALITY}, action {ACTION}, continue boolean, reason string>"
EVENT_PROPS = "k int"
