"""Fixed values of the domain. Everything here must stay as it is for results to be right."""

# --- fixed values: target columns of a standardised line, in output order -------------------------
TARGET_COLUMNS = [
    "SFDC QUOTE NUMBER",
    "ITEM",
    "MFG_PARTNO",
    "GLOBAL_MFG_NAME",
    "DESCRIPTION",
    "SITE",
    "STD_COST",
    "LAST_PURCHASE_PRICE",
    "LAST_PO",
    "EAU",
]

# --- fixed values: optional commodity targets -----------------------------------------------------
HIERARCHY_TARGETS = ["LEVEL1_DESC", "LEVEL2_DESC", "LEVEL3_DESC", "GLOBAL_COMM_CODE_DESC"]

# --- fixed values: header tokens per target (a header matches when it contains one of them) --------
HEADER_TOKENS = {
    "ITEM": ["ITEM"],
    "DESCRIPTION": ["DESC"],
    "MFG_PARTNO": ["PART", "MFG"],
    "GLOBAL_MFG_NAME": ["MFG", "MANUF"],
    "STD_COST": ["COST", "PRICE"],
    "LAST_PURCHASE_PRICE": ["PURCHASE", "PRICE"],
    "LAST_PO": ["PO", "ORDER"],
    "EAU": ["EAU", "USAGE"],
    "SITE": ["SITE", "LOCATION"],
    "SFDC QUOTE NUMBER": ["SFDC", "QUOTE", "ID"],
    "LEVEL3_DESC": ["LEVEL3", "L3"],
}

# --- fixed values: header spellings and acceptance thresholds of the commodity columns -------------
HIERARCHY_HEADERS = {
    "LEVEL1_DESC": ["level1", "level_1", "level 1"],
    "LEVEL2_DESC": ["level2", "level_2", "level 2"],
    "LEVEL3_DESC": ["level3", "level_3", "level 3"],
    "GLOBAL_COMM_CODE_DESC": ["global_comm_code", "global_commodity_code", "global comm code"],
}
HIERARCHY_THRESHOLDS = {
    "LEVEL1_DESC": 0.3,
    "LEVEL2_DESC": 0.4,
    "LEVEL3_DESC": 0.5,
    "GLOBAL_COMM_CODE_DESC": 0.5,
}
EXACT_GLOBAL_CODE_HEADERS = ["GLOBAL_COMM_CODE_DESC", "GLOBAL COMM CODE DESC"]
PREVIEW_TOKENS = {
    "LEVEL1_DESC": "LEVEL1",
    "LEVEL2_DESC": "LEVEL2",
    "LEVEL3_DESC": "LEVEL3",
    "GLOBAL_COMM_CODE_DESC": "GLOBAL_COMM_CODE",
}

# --- fixed values: words used in results ----------------------------------------------------------
IN_SCOPE = "In scope"
OUT_OF_SCOPE = "Out of scope"
STORED_IN_SCOPE = "In Scope"
STORED_OUT_OF_SCOPE = "Out of Scope"
SCOPE_OPTIONS = [
    "In Scope",
    "Out of Scope",
    "Under Consideration",
    "Under Development",
    "Under Investigation",
]
REQUIRES_REVIEW = "Requires Review"
UNKNOWN = "Unknown"
INSUFFICIENT_CONTEXT = "Insufficient Context"
UNKNOWN_LEVEL1 = "Unknown Level 1"
NO_DESCRIPTION = "No description provided"
FIRST_FLAG = "Unique"
REPEAT_FLAG = "AML"
QUOTED = "YES"
NOT_QUOTED = "NO"
NO_EAR = "Insufficient data"
EAR_MET = "Compliant"
EAR_NOT_MET = "Non-Compliant"
GRADE_AUTO = "AUTO"
GRADE_COMMERCIAL = "COMMERCIAL"
ACTIVE_STATUS = "ACTIVE"
EXCLUDED_LEVEL3 = ["Super Capacitor Module"]
FILE_STATUSES = ["pending", "column_preview", "queued", "processing", "completed", "failed"]
# Which status may follow which; a file that ended may be taken up again.
STATUS_AFTER = {
    None: ["pending"],
    "pending": ["column_preview", "queued", "failed"],
    "column_preview": ["queued", "failed"],
    "queued": ["processing", "failed"],
    "processing": ["completed", "failed"],
    "completed": ["queued"],
    "failed": ["queued"],
}
SIGN_OUT_REASONS = ["manual", "timeout", "orphaned", "forced"]

# --- fixed values: limits -------------------------------------------------------------------------
EAR_THRESHOLD = 100_000
TOP_EAR_LINES = 10
SIMILAR_REFERENCES = 10
SAMPLE_ROWS = 5
TEXT_LIMIT = 1000
CELL_LIMIT = 100
EMBEDDING_DIMS = 1536
TEXTS_PER_REQUEST = 20
TOKENS_PER_MINUTE = 250_000
CATALOGUE_PAGE = 20
FILE_PAGE = 10
MAX_SESSION_AGE_HOURS = 24

# --- fixed values: description rewrites, applied from first to last --------------------------------
# kind "plain": anywhere, case as written; "word": whole word; "listed": at the start of a line or after
# a comma; "bare": whole word that is not already inside a pair of parentheses. All but "plain" ignore case.
DESCRIPTION_REWRITES = [
    ("plain", "&amp;", "&"),
    ("plain", "[–—−]", "-"),
    ("word", r"(?:AC[-/\s]DC|AC\s+DC)", "Alternating Current / Direct Current"),
    ("word", r"(?:DC[-/\s]DC|DC\s+DC)", "Direct Current / Direct Current"),
    ("plain", r"\s&\s", " and "),
    ("word", "I/O", "Input/Output"),
    ("word", r"W[-\s]?TO[-\s]?B", "Wire to Board"),
    ("word", r"W[-\s]?TO[-\s]?W", "Wire to Wire"),
    ("word", "LVDS", "Low-Voltage Differential Signaling"),
    ("word", "SMT", "Surface-Mount Technology"),
    ("word", "RJ45", "RJ45 (8P8C Ethernet)"),
    ("word", r"AC\s+INLET", "Alternating Current Inlet"),
    ("word", r"DC\s+POWER\s+JACK", "Direct Current Power Jack"),
    ("word", "NTC", "Negative Temperature Coefficient"),
    ("word", "PTC", "Positive Temperature Coefficient"),
    ("word", "GAN", "GaN (Gallium Nitride)"),
    ("word", "SIC", "SiC (Silicon Carbide)"),
    ("word", "EV", "Electric Vehicle"),
    ("listed", "CONN?", "Connector"),
    ("listed", "ASSY", "Assembly"),
    ("listed", "PCB", "Printed Circuit Board"),
    ("listed", "FPC", "Flexible Printed Circuit"),
    ("listed", "HDI", "High-Density Interconnect"),
    ("listed", "HDW", "Hardware"),
    ("listed", "FAST", "Fasteners"),
    ("listed", "MAG", "Magnetic"),
    ("listed", "MECH", "Mechanical"),
    ("listed", r"FREQ\s+CTL", "Frequency Control"),
    ("listed", "OSC", "Oscillators"),
    ("bare", "VCTCXO", "Voltage Controlled Temperature Compensated Crystal Oscillator (VCTCXO)"),
    ("bare", "VCXO", "Voltage Controlled Crystal Oscillator (VCXO)"),
    ("bare", "OCXO", "Oven Controlled Crystal Oscillator (OCXO)"),
    ("bare", "TCXO", "Temperature Compensated Crystal Oscillator (TCXO)"),
    ("word", r"SENSOR\s+IC", "SENSOR Integrated Circuit"),
    ("bare", "MEMS", "Micro-Electro-Mechanical Systems (MEMS)"),
]
