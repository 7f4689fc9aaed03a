"""Lookup tables, patterns and labels that decide results.

Everything in this file is data. Each value is stated in full because a
different spelling would give a different answer.
"""

# --- fixed values: identifiers ---------------------------------------------

# Codes that stand in for a number that does not exist yet -> record type.
PLACEHOLDER_TYPES = {
    "PRO": "provisional",
    "ORD": "nonprovisional_filed",
    "CON": "continuation",
    "D": "design_placeholder",
}

# Two-letter prefixes that count as a country.
COUNTRY_PREFIXES = (
    "AE", "AR", "AT", "AU", "BR", "CA", "CH", "CL", "CN", "CO", "DE", "EM", "EP", "ES", "FR", "GB", "HK", "IN",
    "IT", "JP", "KR", "MX", "MY", "NL", "NZ", "PE", "PH", "RU", "TH", "TW", "US", "UY", "VE", "WO", "ZA",
)

HOME_COUNTRY = "US"

# Kind codes dropped from the end of a home-country number.
HOME_KIND_CODE = "(B[12]|A[129]?|S[12]?|P[12]?|E|H)$"

# Record ids are version-5 UUIDs in the public URL namespace (RFC 4122).
ID_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
ID_SEED_PREFIX = "sloan-patent://"

FAMILY_ID_FORMAT = "FAM-%05d"
OVERSIZED_ABOVE = 20

LINK_BASE = "https://patents.google.com/patent/"

# --- fixed values: raw status -> (status, sub tag) --------------------------

STATUS_RULES = {
    "active": ("active", None),
    "granted": ("active", None),
    "active - reinstated": ("active", "reinstated"),
    "active-reinstated": ("active", "reinstated"),
    "pending": ("pending", None),
    "published": ("pending", "published"),
    "filed": ("pending", "filed"),
    "allowed": ("pending", "allowed"),
    "unfiled": ("pending", "unfiled"),
    "expired": ("expired", "standard"),
    "expired - lifetime": ("expired", "lifetime"),
    "expired-lifetime": ("expired", "lifetime"),
    "expired - fee related": ("expired", "fee_lapse"),
    "expired-fee related": ("expired", "fee_lapse"),
    "abandoned": ("dead", "abandoned"),
    "withdrawn": ("dead", "withdrawn"),
    "ceased": ("dead", "ceased"),
    "not-in-force": ("dead", "not_in_force"),
    "not in force": ("dead", "not_in_force"),
}

STATUSES = ("active", "pending", "expired", "dead", "unknown")

# --- fixed values: owner rules, first match wins ----------------------------

# (pattern, canonical name, confirmed owner)
OWNER_RULES = (
    (r"\bsloan\s*valve\b", "Sloan Valve Company", True),
    (r"\bsolan\s*valve\b", "Sloan Valve Company", True),
    (r"\bwilliam\s*e\.?\s*sloan\b", "Sloan Valve Company", True),
    (r"\be\.?\s*sloan\s*william\b", "Sloan Valve Company", True),
    (r"\bsloan\s*transportation\b", "Sloan Transportation Products", False),
    (r"sloan\s*water\s*technology", "Sloan Water Technology", True),
    (r"stone\s*and\s*steel\s*systems", "Stone And Steel Systems", True),
    (r"arichell\s*technolog", "Arichell Technologies", True),
    (r"recurrent\s*solutions", "Recurrent Solutions", True),
)

# A string that each of these patterns can't do without, in the same order. None has a letter
# of which other spellings count as the same in any case (i, k, s).
OWNER_NEEDLES = ("valve", "valve", "loan", "loan", "port", "water", "tone", "chell", "recurrent")

KNOWN_NON_OWNERS = (
    "bauer industries",
    "midland brake",
    "haldex midland brake",
    "hewlett packard",
    "tooshlights",
    "mitsubishi electric",
    "railtech",
    "smart wave technologies",
    "modus systems",
)

# Owner of a curated record that names none.
HOUSE_OWNER = "Sloan Valve Company"

# --- fixed values: provenance labels ----------------------------------------

CURATED = "xlsx"
BULK = "csv"
MANUAL = "manual"
API = "api"

# --- fixed values: missing-value spellings ----------------------------------

# Cell texts (any case, after trimming) that mean "no value".
MISSING_WORDS = ("", "nan", "nat", "none")

# Cell texts (exact) that the delimited-file reader takes as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: export header, in order ----------------------------------

EXPORT_COLUMNS = (
    "id",
    "patent_number",
    "title",
    "status",
    "sub_status",
    "country",
    "type",
    "product_line",
    "model",
    "filing_date",
    "grant_date",
    "expiration_date",
    "inventors",
    "assignee",
    "confirmed_owner",
    "family_id",
    "flags",
)

# --- fixed values: search fields and weights --------------------------------

SEARCH_WEIGHTS = {
    "title": 2,
    "normalized_number": 2,
    "raw_number": 1,
    "inventors": 1,
    "product_line": 1,
    "model": 1,
    "assignee": 1,
}
SEARCH_THRESHOLD = 0.35

PAGE_SIZE = 50
PREVIEW_SIZE = 100
STALE_AFTER_DAYS = 30
