"""Declared schemas. Nothing is inferred, so ids keep their leading zeros and a scan needs no extra pass."""

SITES = "point_id string, Lon double, Lat double, daima int, MOD17_sample_Lon double, MOD17_sample_Lat double"
FOLDS = "point_id string, fold_id string"
PANEL = (
    "point_id string, Lon double, Lat double, Year int, Month int, daima int, aspect double, NPP double, LST_Day_1km double, "
    "NDVI double, Precipitation_mm double, VPD double, surface_solar_radiation_downwards_sum double, temperature_2m double, "
    "volumetric_soil_water_layer_1 double, elevation double, slope double"
)
COMPOSITES = "point_id string, composite_start_date date, PsnNet double, Psn_QC int, psn_good_usable int"
ANNUAL = (
    "point_id string, Year int, Npp_raw double, Npp_scaled_kgC_m2_yr double, Npp_scaled_gC_m2_yr double, Npp_QC_raw int"
)
SNOW_QA = "point_id string, Year int, Month int, any_snow_ice_flag int, ndvi_total_composite_count int"
PREDICTIONS = "seed int, point_id string, Year int, Month int, y_true double, y_pred double, arm string, fold_id string"
WINDOW_SCORES = "Window int, seed int, best_val_mse_scaled double"
MANIFEST = (
    "draw_id string, selection_seed long, row_order long, sample_id long, point_id string, Lon double, Lat double, "
    "Year long, Month long, split string, target_original_row_index long, veg_class string"
)
ATTRIBUTIONS = "run_id string, sample_id long, lag int, feature string, shap double"
