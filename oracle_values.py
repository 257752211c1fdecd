"""Fixed values as the statements state them, apart from the library: an error there shows."""


# --- fixed values: gendered and stereotype words of the corpus audit -------------------------
AUDIT_MALE = [
    "he", "him", "his", "himself", "man", "men", "male", "boy", "boys",
    "father", "son", "brother", "husband", "uncle", "nephew", "grandfather",
    "gentleman", "gentlemen", "sir", "mr", "king", "prince", "businessman",
]
AUDIT_FEMALE = [
    "she", "her", "hers", "herself", "woman", "women", "female", "girl", "girls",
    "mother", "daughter", "sister", "wife", "aunt", "niece", "grandmother",
    "lady", "ladies", "madam", "ms", "mrs", "queen", "princess", "businesswoman",
]
AUDIT_STEREOTYPES = [
    "aggressive", "dominant", "competitive", "strong", "rational", "logical",
    "ambitious", "assertive", "independent", "leader",
    "emotional", "nurturing", "gentle", "caring", "sensitive", "passive",
    "supportive", "dependent", "collaborative", "follower",
]

# --- fixed values: gendered words of the short answer check ----------------------------------
ANSWER_MALE = [
    "he", "him", "his", "man", "men", "male", "boy", "father", "son", "brother", "husband",
]
ANSWER_FEMALE = [
    "she", "her", "hers", "woman", "women", "female", "girl", "mother", "daughter", "sister",
    "wife",
]

# --- fixed values: guard patterns, topics, statement words -----------------------------------
HARMFUL_PATTERNS = [
    r"\b(hack|exploit|attack)\b.*\b(system|database|server)\b",
    r"\b(steal|leak)\b.*\b(data|information|credentials)\b",
    r"\b(bypass|circumvent)\b.*\b(security|authentication)\b",
    r"\b(inject|execute)\b.*\b(sql|code|script)\b",
    r"\bdrop\s+table\b",
    r"\bdelete\s+from\b.*\bwhere\b",
    r"\b(password|secret|key)\s*=",
]
BLOCKED_TOPICS = [
    "personal information", "private data", "credit card",
    "social security", "password", "authentication bypass",
]
PII_PATTERNS = [
    (r"\b[\w.-]+@[\w.-]+\.\w+\b", "[EMAIL]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}[-]?\d{2}[-]?\d{4}\b", "[SSN]"),
    (r"\b\d{16}\b", "[CARD]"),
]
READ_ONLY_FORBIDDEN = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE"]
SANITIZE_FORBIDDEN = [
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE",
    "TRUNCATE", "GRANT", "REVOKE", "EXEC", "EXECUTE",
]

# --- fixed values: words that decide a question's slots --------------------------------------
NEEDS_SQL_WORDS = [
    "top", "average", "sum", "count", "group", "by", "where", "select",
    "fare", "revenue", "churn", "location", "region", "trips", "customers",
]
CUSTOMER_WORDS = ["churn", "customer", "region", "tenure", "revenue"]
ASCENDING_WORDS = ["bottom", "lowest", "least", "worst"]
MONTH_EXPRESSION = "strftime('%Y-%m', pickup_date)"

# --- fixed values: limits and defaults -------------------------------------------------------
METRICS = ["l2", "cosine", "dot", "manhattan"]
RETRIEVAL_EPS = 1e-8
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
BATCH_BUCKETS = [1.0, 2.0, 4.0, 8.0, 16.0]
IVF_CELLS, IVF_PROBES, IVF_PER_CELL = 50, 10, 25
SINGLE_PROBE_CELLS = 32

# --- fixed values: column descriptions used in the sentences ---------------------------------
COLUMN_DESCRIPTIONS = {
    "location": "NYC taxi zone",
    "region": "Geographic region",
    "tenure": "Months as customer",
    "passengers": "Passenger count",
    "fare": "Trip fare (USD)",
    "revenue": "Customer revenue (USD)",
    "churn": "Churn probability",
}

# --- fixed values: generated columns ---
ZONES = 265
DAYS = 180
FARE_SCALE, FARE_MIN = 15.0, 2.5
REVENUE_SCALE, REVENUE_MIN = 100.0, 20.0
PASSENGER_WEIGHTS = {1: 0.7, 2: 0.15, 3: 0.08, 4: 0.04, 5: 0.02, 6: 0.01}
REGION_WEIGHTS = {"North": 0.25, "South": 0.20, "East": 0.20, "West": 0.20, "Central": 0.15}
MAX_TENURE, LONG_TENURE = 72, 36
CHURN_SHARE, LONG_TENURE_CHURN_SHARE = 0.27, 0.15
