"""Fixed values. Each list must equal the published coding for results to agree."""

# --- grades ---------------------------------------------------------------------------
# fixed values: letters recorded for a withdrawal
WITHDRAWAL_GRADES = ["R", "RE", "RO"]

# fixed values: transfer and exemption codes, all reported as CO
TRANSFER_GRADES = [
    "AI", "AU", "CI", "CM", "CO", "CU", "EC", "EI", "ET", "EX", "FV", "IT", "MU", "NC",
    "NT", "PF", "PS", "RI", "SM", "TC", "TM", "UB", "UC", "UN", "US", "UT", "VA", "VI",
]

# fixed values: incomplete, absent, not satisfactory
OTHER_GRADES = ["I", "NA", "NS"]

# fixed values: normalised grade -> status
STATUS_GRADES = {
    "passed": ["A", "B", "B+", "C", "C+", "CO", "S", "P"],
    "failed": ["D", "F", "Q"],
    "withdrawn": ["R"],
    "other": ["OTH"],
}

# fixed values: grades that get a column of their own in the term table
GRADE_COLUMNS = ["A", "B", "B+", "C", "C+", "D", "F", "CO", "OTH", "R"]

# --- conditions and areas ---------------------------------------------------------------
# fixed values: cleaned condition text -> ordinal
CONDITION_CODES = {
    "condicion observada": 1,
    "en proceso": 2,
    "normal": 3,
    "primera suspension por bajo re": 4,
    "progreso academico no satisfac": 5,
    "prueba academica": 6,
    "segunda suspension por bajo re": 7,
    "separado": 8,
    "separado  definitivamente": 9,
    "separado permanencia": 10,
    "separado por retiro o reprob": 11,
    "suspendido": 12,
    "suspendido exceso asgnatura re": 13,
}

# fixed values: cleaned area name -> ordinal
AREA_CODES = {
    "basicas y ambientales": 1,
    "ingenierias": 2,
    "negocios": 3,
    "salud": 4,
    "sociales y humanidades": 5,
}

# fixed values: parts of a condition text that decide the outcome
SEPARATION_MARKS = ["SEPARADO", "NO SATISF"]
SUSPENSION_MARKS = ["SUSPEN"]

# fixed values: sex and outcome numbers
SEX_CODES = {"m": 0, "f": 1}
OUTCOME_CODES = {
    "graduate": 0,
    "voluntary desertion": 1,
    "involuntary desertion": 2,
    "active": 3,
}

# fixed values: year buckets, first to last
YEAR_LABELS = ["1st year", "2nd year", "3rd year", "4th year", "5th year +"]

# --- places -----------------------------------------------------------------------------
# fixed values: spellings of a birth city -> the city
CITY_SYNONYMS = {
    "sto dgo": "santo domingo",
    "repdom santo domingo": "santo domingo",
    "sabto domingo": "santo domingo",
    "dn": "distrito nacional",
    "do": "ciudad republica dominicana",
    "dominican republic": "ciudad republica dominicana",
    "dominacana": "ciudad republica dominicana",
    "dominicano": "ciudad republica dominicana",
    "republica dominicana": "ciudad republica dominicana",
}

# fixed values: country code -> the place to use when no city is known
COUNTRY_PLACES = {
    "do": "ciudad republica dominicana",
    "us": "ciudad estados unidos",
    "ht": "ciudad haiti",
    "ve": "ciudad venezuela",
    "cu": "ciudad cuba",
    "es": "ciudad espana",
    "mx": "ciudad mexico",
    "kr": "ciudad corea sur",
    "cl": "ciudad chile",
    "gt": "ciudad guatemala",
    "ec": "ciudad ecuador",
    "ru": "ciudad rusia",
    "nz": "ciudad nueva zelanda",
    "it": "ciudad italia",
}

# fixed values: spellings of a birth country
COUNTRY_SYNONYMS = {"dom": "do"}

# --- admission scores -------------------------------------------------------------------
# fixed values: scores that exist in two versions; the first three decide the version
VERSIONED_SCORES = [
    "paa_verb", "paa_mat", "paa_redact",
    "elash_total", "elash_lang", "elash_list", "elash_read",
]
VERSION_DECIDERS = ["paa_verb", "paa_mat", "paa_redact"]

# fixed values: single-version scores
POMA_SCORES = [
    "poma_total", "poma_verb", "poma_mat", "poma_struct", "poma_nat", "poma_soc", "poma_human",
]

# fixed values: (column, smallest allowed, largest allowed, value that means missing)
SCORE_LIMITS = (
    [("paa_verb", None, 800, None), ("paa_redact", None, 800, 0), ("elash_total_2", None, None, 0)]
    + [(name, 0, 4000, None) for name in POMA_SCORES]
)

# fixed values: admission types, programmes and programme names left out before modelling
# (callers add the label their own registry gives to graduates who enrol again)
EXCLUDED_ADMISSIONS = ["MOVILIDAD ESTUDIANTIL", "PROFESIONAL"]
EXCLUDED_PROGRAMMES = ["MPM", "NMC", "MCS", "ME"]
EXCLUDED_TERM_PROGRAMMES = ["ME"]
EXCLUDED_PROGRAMME_NAME = "PROGRAMA MOVILIDAD ESTUDIANTIL HUMANIDADES"
