"""Scoring terms, headings, cues and patterns of the page and layout rules."""

# Fixed values. (term, weight, category, match mode); the order is the order in which weights are added.
POSITIVE = [
    ("TEMT6000X01", 5.0, "product_model", "case_insensitive"),
    ("ambient light sensor", 4.0, "equipment_type", "case_insensitive"),
    ("phototransistor", 2.0, "equipment_type", "case_insensitive"),
    ("Vishay Semiconductors", 1.0, "manufacturer", "case_insensitive"),
    ("DESCRIPTION", 2.0, "section_heading", "case_insensitive"),
    ("FEATURES", 2.0, "section_heading", "case_insensitive"),
    ("PRODUCT SUMMARY", 3.0, "section_heading", "case_insensitive"),
    ("ABSOLUTE MAXIMUM RATINGS", 3.0, "section_heading", "case_insensitive"),
    ("BASIC CHARACTERISTICS", 4.0, "section_heading", "case_insensitive"),
    ("PACKAGE DIMENSIONS", 3.0, "section_heading", "case_insensitive"),
    ("Dimensions", 3.0, "parameter_type", "case_insensitive"),
    ("Package form", 2.0, "parameter_type", "case_insensitive"),
    ("Package type", 2.0, "parameter_type", "case_insensitive"),
    ("Angle of half sensitivity", 4.0, "parameter_type", "case_insensitive"),
    ("Wavelength of peak sensitivity", 4.0, "parameter_type", "case_insensitive"),
    ("Range of spectral bandwidth", 4.0, "parameter_type", "case_insensitive"),
    ("Collector emitter voltage", 3.0, "parameter_type", "case_insensitive"),
    ("Emitter collector voltage", 3.0, "parameter_type", "case_insensitive"),
    ("Collector current", 3.0, "parameter_type", "case_insensitive"),
    ("Power dissipation", 3.0, "parameter_type", "case_insensitive"),
    ("Operating temperature range", 4.0, "parameter_type", "case_insensitive"),
    ("Storage temperature range", 3.0, "parameter_type", "case_insensitive"),
    ("Soldering temperature", 2.0, "parameter_type", "case_insensitive"),
    ("Collector light current", 3.0, "parameter_type", "case_insensitive"),
    ("Collector dark current", 2.0, "parameter_type", "case_insensitive"),
    ("Collector emitter capacitance", 2.0, "parameter_type", "case_insensitive"),
    (r"\bVCEO\b", 2.0, "symbol", "regex"),
    (r"\bVECO\b", 2.0, "symbol", "regex"),
    (r"\bIC\b", 1.0, "symbol", "regex"),
    (r"\bPV\b", 1.0, "symbol", "regex"),
    ("Tamb", 1.5, "symbol", "case_insensitive"),
    ("IPCE", 2.0, "symbol", "case_insensitive"),
    ("λp", 2.0, "symbol", "case_insensitive"),
    ("λ0.5", 2.0, "symbol", "case_insensitive"),
    ("φ", 1.5, "symbol", "case_insensitive"),
    ("\uf06a", 1.5, "symbol", "case_insensitive"),
    ("mm", 1.0, "unit", "case_insensitive"),
    ("nm", 1.0, "unit", "case_insensitive"),
    ("deg", 1.0, "unit", "case_insensitive"),
    ("°C", 1.0, "unit", "case_insensitive"),
    (r"\bV\b", 0.8, "unit", "regex"),
    (r"\bmA\b", 0.8, "unit", "regex"),
    ("\u03bcA", 0.8, "unit", "case_insensitive"),
    ("\u00b5A", 0.8, "unit", "case_insensitive"),
    ("mW", 0.8, "unit", "case_insensitive"),
    ("pF", 0.8, "unit", "case_insensitive"),
    ("PARAMETER", 2.0, "table_cue", "case_insensitive"),
    ("TEST CONDITION", 1.5, "table_cue", "case_insensitive"),
    ("SYMBOL", 1.5, "table_cue", "case_insensitive"),
    ("VALUE", 1.0, "table_cue", "case_insensitive"),
    ("UNIT", 1.5, "table_cue", "case_insensitive"),
    ("MIN.", 1.0, "table_cue", "case_insensitive"),
    ("TYP.", 1.0, "table_cue", "case_insensitive"),
    ("MAX.", 1.0, "table_cue", "case_insensitive"),
]

# Fixed values, as above.
NEGATIVE = [
    ("Legal Disclaimer", -8.0, "legal_disclaimer", "case_insensitive"),
    ("Disclaimer", -1.0, "legal_disclaimer", "case_insensitive"),
    ("ALL RIGHTS RESERVED", -5.0, "legal_disclaimer", "case_insensitive"),
    ("liability", -3.0, "legal_disclaimer", "case_insensitive"),
    ("warranty", -3.0, "legal_disclaimer", "case_insensitive"),
    ("third-party websites", -3.0, "legal_disclaimer", "case_insensitive"),
    ("No license", -3.0, "legal_disclaimer", "case_insensitive"),
    ("BLISTER TAPE DIMENSIONS", -2.0, "packaging_only", "case_insensitive"),
    ("REEL DIMENSIONS", -2.0, "packaging_only", "case_insensitive"),
    ("Volume: 3000 pcs/reel", -2.0, "packaging_only", "case_insensitive"),
    ("ORDERING INFORMATION", -1.0, "ordering", "case_insensitive"),
    ("MOQ", -1.0, "ordering", "case_insensitive"),
]

# Section headings, in their order of priority among equal lengths.
HEADINGS = [
    "DESCRIPTION",
    "FEATURES",
    "APPLICATIONS",
    "PRODUCT SUMMARY",
    "ORDERING INFORMATION",
    "ABSOLUTE MAXIMUM RATINGS",
    "BASIC CHARACTERISTICS",
    "REFLOW SOLDER PROFILE",
    "DRYPACK",
    "FLOOR LIFE",
    "DRYING",
    "PACKAGE DIMENSIONS",
    "BLISTER TAPE DIMENSIONS",
    "REEL DIMENSIONS",
    "Legal Disclaimer Notice",
    "Disclaimer",
]
DIMENSION_HEADINGS = ["PACKAGE DIMENSIONS", "BLISTER TAPE DIMENSIONS", "REEL DIMENSIONS"]

# Cues and patterns of the block types.
TABLE_CUES = ["PARAMETER", "TEST CONDITION", "SYMBOL", "VALUE", "UNIT", "MIN.", "TYP.", "MAX."]
LEGAL_CUES = ["Legal Disclaimer", "Disclaimer", "ALL RIGHTS RESERVED", "liability", "warranty", "No license", "third-party websites"]
PACKAGE_CUES = ["BLISTER TAPE DIMENSIONS", "REEL DIMENSIONS", "Volume:", "pcs/reel"]
ELEMENT_PACKAGE_CUES = ["PACKAGE DIMENSIONS", *PACKAGE_CUES]
LINE_FIGURES = [r"\bFig\.\s*\d+", r"\bFigure\s+\d+"]
ELEMENT_FIGURES = [r"\bfig\.\s*\d+", r"\bfigure\s+\d+", r"\babb\.\s*\d+", r"\babbildung\s+\d+"]
TABLE_CAPTIONS = [r"\btab\.\s*\d+", r"\btable\s*\d+", r"\btab\s*\d+", r"\btabelle\s*\d+"]
TABLE_SYMBOLS = [r"\b(?:VCEO|VECO|IPCE|TAMB|TSTG|PV|IC|TSD)\b"]
TABLE_UNITS = ["\\b(?:V|MA|MW|PF|NM|DEG|°C|K/W|\u03bcA|\u00b5A)\\b"]
