"""Fixed values the results depend on.

These are data, not logic: category names, label rules, country codes and
name maps of the registrations data set. They are stated plainly here, in
their natural order, so every operator reads them from one place.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the source data set's conventions
# ---------------------------------------------------------------------------

# The six motor-energy categories, in display order.
MOTOR_ENERGY_CATEGORIES = [
    "Petrol (excluding hybrids)",
    "Diesel (excluding hybrids)",
    "Electricity",
    "Petrol hybrid",
    "Diesel hybrid",
    "Alternative/Other",
]

# Raw fuel labels (after lower/trim/'-'->'/') and the category they map to.
# Anything else becomes "Alternative/Other"; these two are removed first.
FUEL_LABELS_DROPPED = ["unknown", "other"]
FUEL_LABEL_RULES = [
    (["electric"], "Electricity"),
    (["petrol/electric", "hybrid/petrol/e", "petrol phev"], "Petrol hybrid"),
    (["diesel/electric"], "Diesel hybrid"),
    (["petrol"], "Petrol (excluding hybrids)"),
    (["diesel"], "Diesel (excluding hybrids)"),
]
FUEL_LABEL_DEFAULT = "Alternative/Other"

# Manufacturer values that are not real manufacturers (compared case-insensitively).
MANUFACTURER_DROPPED = ["DUPLICATE", "OUT OF SCOPE", "UNKNOWN"]

# The 27 reporting countries (2-letter codes, EL = Greece) and their names.
EU27_CODES = [
    "BE", "BG", "CZ", "DK", "DE", "EE", "IE", "EL", "ES", "FR", "HR", "IT", "CY", "LV",
    "LT", "LU", "HU", "MT", "NL", "AT", "PL", "PT", "RO", "SI", "SK", "FI", "SE",
]
EU27_NAMES = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "HR": "Croatia", "CY": "Cyprus",
    "CZ": "Czechia", "DK": "Denmark", "EE": "Estonia", "FI": "Finland", "FR": "France",
    "DE": "Germany", "EL": "Greece", "HU": "Hungary", "IE": "Ireland", "IT": "Italy",
    "LV": "Latvia", "LT": "Lithuania", "LU": "Luxembourg", "MT": "Malta",
    "NL": "Netherlands", "PL": "Poland", "PT": "Portugal", "RO": "Romania",
    "SK": "Slovakia", "SI": "Slovenia", "ES": "Spain", "SE": "Sweden",
}
# Codes that differ from ISO 3166-1 alpha-2.
ISO2_ALIASES = {"EL": "GR", "UK": "GB"}

# ISO 3166-1 alpha-3 codes of the ISO alpha-2 codes used above (after aliases).
ISO3_OF_ISO2 = {
    "AT": "AUT", "BE": "BEL", "BG": "BGR", "HR": "HRV", "CY": "CYP", "CZ": "CZE",
    "DK": "DNK", "EE": "EST", "FI": "FIN", "FR": "FRA", "DE": "DEU", "GR": "GRC",
    "HU": "HUN", "IE": "IRL", "IT": "ITA", "LV": "LVA", "LT": "LTU", "LU": "LUX",
    "MT": "MLT", "NL": "NLD", "PL": "POL", "PT": "PRT", "RO": "ROU", "SK": "SVK",
    "SI": "SVN", "ES": "ESP", "SE": "SWE", "GB": "GBR",
}

# Manufacturer aliases → canonical name (applied after the drop list).
MANUFACTURER_ALIASES = {
    "AUDI HUNGARIA": "AUDI AG",
    "AUDI SPORT": "AUDI AG",
    "BEE": "BEE BEE",
    "BLUECAR ITALY": "BLUECAR",
    "BMW GMBH": "BMW AG",
    "DONGFENG LIUZHOU": "DONGFENG",
    "DONGFENG MOTOR": "DONGFENG",
    "DONKEVOORT": "DONKERVOORT",
    "DR MOTOR": "DR AUTOMOBILES",
    "Duplicate": "DUPLICATE",
    "FORD INDIA": "FORD MOTOR COMPANY",
    "FORD MOTOR AUSTRALIA": "FORD MOTOR COMPANY",
    "FORD WERKE GMBH": "FORD MOTOR COMPANY",
    "Ford Motor Company": "FORD MOTOR COMPANY",
    "GENERAL MOTORS COMPANY": "GENERAL MOTORS",
    "GENERAL MOTORS HOLDINGS": "GENERAL MOTORS",
    "GM ITALIA": "GENERAL MOTORS",
    "GM KOREA": "GENERAL MOTORS",
    "HONDA CHINA": "HONDA",
    "HONDA MOTOR CO": "HONDA",
    "HONDA THAILAND": "HONDA",
    "HONDA TURKIYE": "HONDA",
    "HONDA UK": "HONDA",
    "HYUNDAI ASSAN": "HYUNDAI",
    "HYUNDAI CZECH": "HYUNDAI",
    "HYUNDAI EUROPE": "HYUNDAI",
    "HYUNDAI INDIA": "HYUNDAI",
    "JIANGXI JIANGLING": "JIANGLING MOTOR",
    "KIA SLOVAKIA": "KIA",
    "LADA FRANCE": "LADA",
    "LANZHOU ZHIDOU": "LANZHOU",
    "MAGYAR SUZUKI": "SUZUKI MOTOR CORPORATION",
    "MARUTI SUZUKI": "SUZUKI MOTOR CORPORATION",
    "MAZDA EUROPE": "MAZDA",
    "MERCEDES AMG": "MERCEDES-BENZ AG",
    "MERCEDES-AMG": "MERCEDES-BENZ AG",
    "NISSAN AUTOMOTIVE EUROPE": "NISSAN",
    "OPEL AUTOMOBILE": "OPEL",
    "QUATTRO": "AUDI AG",
    "RADICAL MOTOSPORT": "RADICAL MOTORSPORT",
    "ROLLS-ROYCE": "ROLLS ROYCE",
    "SAIC MAXUS": "SAIC MOTOR CORPORATION",
    "SAIC MOTOR": "SAIC MOTOR CORPORATION",
    "STELLANTIS EUROPE": "STELLANTIS AUTO",
    "SUZUKI THAILAND": "SUZUKI MOTOR CORPORATION",
    "TOYOTA MOTOR CORPORATION": "TOYOTA",
    "WUHAN LOTUS": "LOTUS",
}

# Pseudo-region meaning "all countries".
ALL_REGIONS = "EU27_2020"

# Time range of the clean table.
YEAR_MIN, YEAR_MAX = 2014, 2023

# Latent grid defaults.
GRID_SIZE = 0.2
GRID_MIN_REGISTRATIONS = 5
LATENT_MIN_REGISTRATIONS = 10

# The five model features, in model input order.
FEATURES = ["mass", "co2", "capacity", "power", "consumption"]
