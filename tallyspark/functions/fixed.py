"""Fixed values that results depend on.

FIXED VALUES: these lists and maps must equal the ones the source data
conventions use, so they are written out plainly, in their natural order.
Every operator takes them as default arguments; callers may pass others.
"""

# Canonical column names of a wide station file.
STANDARD_COLUMNS = (
    "raw_row_id", "id_bvote", "scrutin", "annee", "tour", "date", "num_circ",
    "num_quartier", "num_arrond", "num_bureau", "nb_procu", "nb_inscr", "nb_emarg",
    "nb_votant", "nb_bl", "nb_nul", "nb_bl_nul", "nb_exprim",
)

# Columns a wide file needs before it can be cleaned.
REQUIRED_WIDE_COLUMNS = (
    "id_bvote", "scrutin", "annee", "tour", "num_arrond", "num_bureau", "nb_inscr",
    "nb_votant", "nb_exprim",
)

# Columns a long file needs.
REQUIRED_LONG_COLUMNS = ("scrutin", "annee", "tour", "candidate", "votes", "source_bv_id")

# Shape detection: a file with all of these is long.
LONG_SHAPE_COLUMNS = ("candidate", "votes", "source_bv_id")

# Old name -> new name; applied only when the old name is present and the new absent.
COLUMN_ALIASES = (
    ("id_bv", "id_bvote"),
    ("type_election", "scrutin"),
    ("numero_tour", "tour"),
    ("date_tour", "date"),
    ("circ_bv", "num_circ"),
    ("quartier_bv", "num_quartier"),
    ("arr_bv", "num_arrond"),
    ("nb_procuration", "nb_procu"),
    ("nb_inscrit", "nb_inscr"),
    ("nb_emargement", "nb_emarg"),
    ("nb_exprime", "nb_exprim"),
    ("nb_vote_blanc", "nb_bl"),
    ("nb_vote_nul", "nb_nul"),
    ("nb_blanc", "nb_bl"),
)

# Category spelling corrections, keyed by the trimmed lower-case text.
CATEGORY_CORRECTIONS = (
    ("rã©guinales", "Régionales"),
    ("réguinales", "Régionales"),
    ("regionales", "Régionales"),
    ("régionales", "Régionales"),
    ("legislatives", "Législative"),
    ("législatives", "Législative"),
    ("presidentielles", "Présidentielle"),
    ("présidentielles", "Présidentielle"),
    ("présidentielle", "Présidentielle"),
    ("europeennes", "Européennes"),
    ("européennes", "Européennes"),
)

# Columns never taken as value (candidate) columns.
NON_VALUE_COLUMNS = (
    "objectid", "geo_shape", "geo_point_2d", "st_area_shape", "st_perimeter_shape",
    "created_user", "created_date", "last_edited_user", "last_edited_date", "nb_bl",
    "nb_nul", "nb_blanc", "nb_vote_blanc", "nb_vote_nul", "sec_bv",
)

# Text tokens that count as missing.
MISSING_TOKENS = ("", "nan", "none", "<na>")
MISSING_TOKENS_WIDE = ("", "nan", "none", "<na>", "null")

# Names that look like metadata when found among candidates.
SUSPICIOUS_EXACT_NAMES = (
    "objectid", "raw_row_id", "id_bvote", "id_bv", "source_bv_id", "scrutin",
    "type_election", "annee", "tour", "numero_tour", "date", "date_tour", "num_circ",
    "circ_bv", "num_quartier", "quartier_bv", "num_arrond", "arr_bv", "num_bureau",
    "sec_bv", "nb_procu", "nb_procuration", "nb_inscr", "nb_inscrit", "nb_emarg",
    "nb_emargement", "nb_votant", "nb_bl", "nb_nul", "nb_blanc", "nb_vote_blanc",
    "nb_vote_nul", "nb_bl_nul", "nb_exprim", "nb_exprime", "vote_share_exprimes",
    "vote_share_registered", "geo_shape", "geo_point_2d", "st_area_shape",
    "st_perimeter_shape", "created_user", "created_date", "last_edited_user",
    "last_edited_date",
)
SUSPICIOUS_PREFIXES = ("nb_", "num_", "geo_", "st_")
SUSPICIOUS_SUFFIXES = ("_shape",)

# Substrings marking the already-long (municipal) family.
LONG_FAMILY_MARKERS = ("municip", "_muni", "-muni", "muni_")
LONG_FAMILY_FLAG_COLUMNS = ("scrutin", "dataset_id", "source_file", "type_election")

# Index of the wide share table, in this order.
WIDE_INDEX_COLUMNS = (
    "dataset_id", "source_file", "id_bvote", "source_bv_id", "scrutin", "annee", "tour",
    "date", "num_circ", "num_quartier", "num_arrond", "num_bureau", "nb_inscr",
    "nb_votant", "nb_exprim",
)

# Metadata columns of a wide table (everything else is a candidate).
WIDE_METADATA_COLUMNS = (
    "dataset_id", "source_file", "raw_row_id", "id_bvote", "source_bv_id", "scrutin",
    "annee", "tour", "date", "num_circ", "num_quartier", "num_arrond", "num_bureau",
    "nb_procu", "nb_inscr", "nb_emarg", "nb_votant", "nb_bl", "nb_nul", "nb_bl_nul",
    "nb_exprim", "is_municipal",
)

# Column order of the long table.
LONG_COLUMN_ORDER = (
    "id_bvote", "scrutin", "annee", "tour", "date", "num_circ", "num_quartier", "num_arrond",
    "num_bureau", "nb_procu", "nb_inscr", "nb_emarg", "nb_votant", "nb_bl_nul", "nb_exprim",
    "raw_row_id", "candidate_source_column", "votes", "candidate", "source_file", "dataset_id",
    "vote_share_exprimes", "vote_share_registered", "nb_bl", "nb_nul", "source_bv_id", "nom",
    "prenom", "nuance", "liste",
)

# Columns that the validation expects in the long table.
CORE_LONG_COLUMNS = (
    "dataset_id", "source_file", "raw_row_id", "id_bvote", "scrutin", "annee", "tour",
    "num_arrond", "num_bureau", "nb_inscr", "nb_votant", "nb_exprim", "candidate",
    "candidate_source_column", "votes", "vote_share_exprimes", "vote_share_registered",
)

# Text columns of the long family.
LONG_STRINGS = (
    "id_bvote", "source_bv_id", "scrutin", "tour", "num_circ", "num_quartier", "num_arrond",
    "num_bureau", "candidate", "candidate_source_column", "source_file", "dataset_id", "nom",
    "prenom", "nuance", "liste",
)

# Patterns and formats.
STATION_KEY_PATTERN = r"^(\d{5})_(\d{2})(\d{2})$"   # area = group 2, unit = group 3
YEAR_PATTERN = r"(20\d{2})"
SAFE_NAME_KEEP = r"A-Za-z0-9_.-"                    # runs of anything else become "_"
SAFE_NAME_DEFAULT = "unknown"
UNIT_CODE_WIDTH = 4                                 # zero-filled, first 2 digits = area
UNIT_CODE_HEAD = 2
# Names of the rounds in file names.
ROUND_LABELS = {"t1": "1ertour", "t2": "2emetour"}
ELECTION_ID_SEPARATOR = "_"                         # year _ kind _ tN
LONG_FAMILY_PREFIX = "elections-municipales-"

# Tolerances and thresholds.
VALUE_COLUMN_MIN_NUMERIC_RATIO = 0.80
EXPRESSED_VOTE_TOLERANCE = 0.5
SHARE_SUM_TOLERANCE = 0.005
SHARE_RANGE_EPS = 1e-9
RECONCILE_TOLERANCE = 0.000001
MIN_TOTAL_SHARE = 0.002
CCA_RIDGE = 1e-8
CHECK_STATUS_LIMIT = 5
SAMPLE_ROWS = 500
DATASET_YEARS = (2000, 2025)
