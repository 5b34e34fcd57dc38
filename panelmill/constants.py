"""Names, thresholds and grids that results depend on."""

# --- fixed values: Spanish month names and abbreviations -------------------
MONTH_NUMBERS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6,
    "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12,
}

# --- fixed values: scope of the panel --------------------------------------
COMMON_START_DATE = "2016-01-01"
FERTILISER_KEY = "fertilizantes"
KG_PER_40LB_BOX = 18.1437
SHEET_BLOCKLIST = ["resumen", "dashboard", "grafico", "chart", "pivot", "indice"]
PRODUCT_NAMES = {
    "papa_superchola": "Papa Superchola",
    "tomate_rinon_invernadero": "Tomate Rinon De Invernadero",
    "maracuya": "Maracuya",
}
PRODUCT_KEYS = {
    "papa_superchola": "papa superchola",
    "tomate_rinon_invernadero": "tomate rinon de invernadero",
    "maracuya": "maracuya",
}

# --- fixed values: column spellings found in the raw files ------------------
MARKET_RENAMES = {
    "año": "anio", "aÃ±o": "anio", "cantón": "canton", "cantÃ³n": "canton",
    "uni_med": "unidad_medida", "precio_promedio_usd": "promedio_de_precio_usd",
}
RANKING_RENAMES = {
    "año": "anio", "aÃ±o": "anio", "cantón": "canton", "cantÃ³n": "canton",
    "presentación": "presentacion", "presentaciÃ³n": "presentacion",
}

# --- fixed values: feature columns ------------------------------------------
TARGET = "target_precio_mercado_usdkg"
CALENDAR_FEATURES = ["mes_num", "trimestre", "mes_sin", "mes_cos"]
TARGET_LAGS = {f"target_lag_{k}": k for k in (1, 2, 3, 6, 12)}
ROLLING_SIZES = (3, 6)
TARGET_LAG_FEATURES = [
    "target_lag_1", "target_lag_2", "target_lag_3", "target_lag_6", "target_lag_12",
    "target_rolling_mean_3", "target_rolling_std_3",
    "target_rolling_mean_6", "target_rolling_std_6",
    "target_momentum_1_3", "target_momentum_1_6",
]
MARKET_CONTEXT_FEATURES = ["mercados_observaciones", "mercados_distintos", "tipos_mercado_distintos"]
MACRO_COLUMNS = [
    "ipc_alimentos", "inflacion_mensual", "inflacion_anual", "inflacion_acumulada",
    "ibc", "ipm", "ipp_n",
]
PRODUCER_COLUMNS = [
    "precio_productor_provincia_usdkg", "precio_productor_nacional_usdkg",
    "precio_productor_usdkg_filled", "productor_observaciones_provincia",
    "productor_observaciones_nacional", "productor_missing_exact",
]
FERTILISER_COLUMNS = [
    "fertilizantes_precio_promedio_provincia", "fertilizantes_precio_promedio_nacional",
    "fertilizantes_precio_promedio_filled", "fertilizantes_precio_mediano_provincia",
    "fertilizantes_precio_mediano_nacional", "fertilizantes_registros_provincia",
    "fertilizantes_registros_nacional", "fertilizantes_ingredientes_activos_provincia",
    "fertilizantes_missing_exact",
]
EXOGENOUS_FEATURES = [
    "precio_productor_provincia_usdkg", "precio_productor_nacional_usdkg",
    "precio_productor_usdkg_filled", "productor_missing_exact",
    "fertilizantes_precio_promedio_provincia", "fertilizantes_precio_promedio_nacional",
    "fertilizantes_precio_promedio_filled", "fertilizantes_registros_provincia",
    "fertilizantes_ingredientes_activos_provincia", "fertilizantes_missing_exact",
    *MACRO_COLUMNS,
]
# lag column -> (column it lags, rows back)
EXOGENOUS_LAGS = {
    "productor_lag_1": ("precio_productor_usdkg_filled", 1),
    "productor_lag_3": ("precio_productor_usdkg_filled", 3),
    "fertilizantes_lag_1": ("fertilizantes_precio_promedio_filled", 1),
    "fertilizantes_lag_3": ("fertilizantes_precio_promedio_filled", 3),
    "ipc_alimentos_lag_1": ("ipc_alimentos", 1),
    "inflacion_mensual_lag_1": ("inflacion_mensual", 1),
    "ibc_lag_1": ("ibc", 1),
    "ipm_lag_1": ("ipm", 1),
    "ipp_n_lag_1": ("ipp_n", 1),
}
BASE_FEATURES = ["provincia_id", *CALENDAR_FEATURES, *TARGET_LAG_FEATURES]
FULL_FEATURES = [*BASE_FEATURES, *EXOGENOUS_FEATURES, *EXOGENOUS_LAGS]
FEATURES_BY_SET = {"base": BASE_FEATURES, "full": FULL_FEATURES}
FEATURE_SETS = ("base", "full")
REQUIRED_DATASET_COLUMNS = ["fecha", "provincia", "provincia_id", TARGET]
# exogenous inputs of the per-entity models, market context included
ENTITY_EXOGENOUS = [*MARKET_CONTEXT_FEATURES, *EXOGENOUS_FEATURES, *CALENDAR_FEATURES]

# --- fixed values: splits, evaluation, resampling ---------------------------
HOLDOUT_RATIO = 0.2
VALIDATION_WINDOWS = 3
MIN_WINDOW_MONTHS = 6
HORIZONS = (1, 2, 3)
EXPLORATORY_BELOW = 5
MIN_ENTITY_ROWS = 24
BLOCK_MONTHS = 4
REPLICAS = 2000
CONFIDENCE = 0.95
SEED = 42
MIN_REPORT_ROWS = 5

# --- fixed values: tuning grids ----------------------------------------------
BLEND_WEIGHTS = [0.0, 0.1, 0.2, 0.3]
TREE_GRID = [
    {"trees": 500, "depth": 4, "step": 0.03, "subsample": 0.9},
    {"trees": 700, "depth": 3, "step": 0.025, "subsample": 0.9},
    {"trees": 500, "depth": 2, "step": 0.04, "subsample": 0.85},
    {"trees": 350, "depth": 2, "step": 0.06, "subsample": 0.8},
    {"trees": 900, "depth": 3, "step": 0.015, "subsample": 0.85},
]
ORDER_GRID = [(1, 1, 1), (0, 1, 1), (1, 1, 0), (2, 1, 1)]
SEASONAL_GRID = [(0, 0, 0, 0), (1, 0, 1, 12)]
DEFAULT_ORDER = ((1, 1, 1), (1, 0, 1, 12))
SAFE_ORDER = ((1, 1, 0), (0, 0, 0, 0))
STABLE_MULTIPLE = 5.0
SEQUENCE_LENGTHS = [6, 8, 10]
