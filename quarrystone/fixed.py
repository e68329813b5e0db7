"""Word lists, patterns and constants that results depend on."""

# --- fixed values: English stop words of the sparse index -------------------------------
STOP_WORDS = [
    "a", "an", "the", "in", "on", "at", "for", "to", "of", "and", "or", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall",
    "can", "need", "dare", "ought", "used", "with", "from", "by", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "because", "but",
    "about", "it", "its", "this", "that", "these", "those", "what", "which", "who", "whom", "i", "me", "my", "we",
    "our", "you", "your", "he", "him", "his", "she", "her", "they", "them", "their", "if", "while", "also",
]

# --- fixed values: ordered suffix rules ---------------------------------------------------
SUFFIX_RULES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("ously", "ous"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("ling", ""), ("ement", ""), ("ment", ""), ("ence", ""), ("ance", ""), ("able", ""), ("ible", ""), ("tion", "t"),
    ("sion", "s"), ("ies", "i"), ("ive", ""), ("ful", ""), ("ness", ""), ("ly", ""), ("er", ""), ("ed", ""),
    ("ing", ""), ("ss", "ss"), ("s", ""),
]
UNSTEMMED_ENDINGS = ("ss", "us", "is")

# --- fixed values: companies and the words that name them ---------------------------------
TICKERS = ("MSFT", "AMZN", "META", "GOOG", "TSLA", "AAPL", "NVDA")
FILTER_KEYWORDS = (
    ("MSFT", ("microsoft", "msft")),
    ("AMZN", ("amazon", "amzn")),
    ("META", ("meta", "facebook", "meta platforms")),
    ("GOOG", ("google", "alphabet", "goog")),
    ("TSLA", ("tesla", "tsla")),
)
COMPANY_KEYWORDS = (
    ("MSFT", ("microsoft", "msft")),
    ("AMZN", ("amazon", "amzn")),
    ("META", ("meta", "facebook")),
    ("GOOG", ("google", "alphabet", "goog")),
    ("TSLA", ("tesla", "tsla")),
    ("AAPL", ("apple", "aapl")),
    ("NVDA", ("nvidia", "nvda")),
)
NORMALIZED_COMPANIES = (
    r"(?i)\b(MSFT|AMZN|TSLA|GOOG|META|AAPL|NVDA|"
    r"Microsoft|Amazon|Tesla|Google|Meta|Apple|NVIDIA)\b"
)
NORMALIZED_YEARS = r"\b(202[0-9])\b"

# --- fixed values: heading, sentence and paragraph marks ------------------------------------
HEADING = r"(?i)^(ITEM|PART|Section)\s+\d"
STRICT_HEADING = r"(?i)^(?:ITEM|PART|Section)\s+\d+[.:]\s*.*$"
SENTENCE_END = r"(?<=[.!?])\s+"
PARAGRAPH_END = r"\n\s*\n"

# --- fixed values: query rewriting -----------------------------------------------------------
REWRITES = (
    (r"(?i)\btheir\b", "the company's"),
    (r"(?i)\bit\b", "the company"),
    (r"(?i)\bthis year\b", "2024"),
    (r"(?i)\blast year\b", "2023"),
    (r"(?i)\brevenue\b", "total revenue"),
    (r"(?i)\bprofit\b", "net income"),
)
SHORT_QUERY_PREFIX = "SEC 10-K filing "
SKIP_RETRIEVAL = (
    r"^what is (the )?(capital|currency|population|language|president|ceo) of",
    r"^who (is|was|invented|discovered|founded)",
    r"^when (did|was|is)",
    r"^where (is|was|are)",
    r"^how (old|tall|far|long|many|much)",
    r"^define ",
    r"^what does .* mean",
    r"^explain (the )?(concept of|meaning of|difference between)",
    r"^what are the (rules|principles|laws|laws of)",
)
SIMPLE_KEYWORDS = ("what is", "define", "when did", "who is", "list", "show me")
COMPLEX_KEYWORDS = ("compare", "analyze", "explain why", "implications", "risk", "forecast")

# --- fixed values: guardrails ----------------------------------------------------------------
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
)
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"you\s+are\s+now\s+a",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"\[INST\]",
    r"\[/INST\]",
)
ADVICE_KEYWORDS = (
    "guarantee", "guaranteed", "certain", "definitely", "will happen", "predict", "forecast with certainty",
)
HEDGE_PHRASES = (
    "i think", "i believe", "probably", "might be", "could be", "according to my knowledge", "i recall",
)
DOLLAR_AMOUNT = r"\$[\d,.]+\s*(?:billion|million|B|M)?"
NOUN = r"\b[A-Za-z]{4,}\b"
NOUN_STOP_WORDS = [
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "been", "have", "has", "had", "not",
    "but", "will", "can", "may", "its", "their", "they", "them", "than", "also", "which", "would", "could", "should",
    "about", "into", "each", "more", "other", "very", "such", "when", "what", "there", "based", "using", "used",
]
DISCLAIMER = (
    "\n\n*Note: This information is from SEC filings and should not be considered financial advice.*"
)
CITATION_IN_CONTEXT = r"\[([A-Z]{2,5})\s+(\d{4})\]"
CITATION_IN_ANSWER = r"[\[\(]([A-Z]{2,5})\s+(\d{4})[\]\)]"
HIGH_STAKES = (
    "invest", "buy", "sell", "trade", "portfolio", "legal", "lawsuit", "regulatory", "compliance",
    "fraud", "bankruptcy", "default",
)
ESCALATION_HEDGES = ("i think", "i believe", "maybe", "possibly", "not sure")

# --- fixed values: fields of a structured reply ---------------------------------------------
REPLY_FIELDS = (
    ("answer", r'"answer"\s*:\s*"([^"]*)"'),
    ("confidence", r'"confidence"\s*:\s*([\d.]+)'),
    ("reasoning", r'"reasoning"\s*:\s*"([^"]*)"'),
)
REPLY_CITATIONS = r'"citations"\s*:\s*\[(.*?)\]'

# --- fixed values: tables, figures and metrics in text ----------------------------------------
MD_TABLE = r"(\|.+\|[\r\n]+\|[\-\| :]+\|[\r\n](?:\|.+\|[\r\n]*)+)"
BULLET_LIST = r"(?:^|\n)((?:[-•]\s+.+\n?){2,})"
REVENUE_PHRASE = r"(?i)revenue.*?\$[\d,.]+\s*(?:billion|million|B|M)"
EMPLOYEE_COUNT = r"(?i)(\d[\d,]*)\s*(?:full-time\s+)?employees"
RISK_SECTION = r"(?is)risk factors?(.*?)(?:item \d|\z)"
RISK_BULLET = r"[-•]\s+(.+)"
FIGURE_PATTERNS = (
    ("gross_margin", r"(?i)gross margin.*?(\d+\.?\d*)%"),
    ("operating_income", r"(?i)operating income.*?\$([\d,.]+)\s*(?:billion|million)"),
    ("net_income", r"(?i)net income.*?\$([\d,.]+)\s*(?:billion|million)"),
)
# per metric, in order of trial: (pattern, factor when scaled as published, factor when corrected)
METRIC_PATTERNS = {
    "revenue": (
        (r"(?i)revenue[sd]*\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)", 1, 10**9),
        (r"(?i)revenue[sd]*\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)", 10**6, 10**6),
        (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B).*?revenue", 1, 10**9),
        (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:million|M).*?revenue", 10**6, 10**6),
    ),
    "employees": (
        (r"(?i)([\d,]+(?:\.\d+)?)\s+(?:thousand|,000)\s+employees", 10**6, 10**3),
        (r"(?i)employees?\s+(?:of\s+)?([\d,]+)", 1, 1),
        (r"(?i)approximately\s+([\d,]+)\s+employees", 1, 1),
    ),
    "net_income": (
        (r"(?i)net\s+income[sd]*\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)", 1, 10**9),
        (r"(?i)net\s+income[sd]*\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)", 10**6, 10**6),
    ),
    "total_assets": (
        (r"(?i)total\s+assets\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)", 1, 10**9),
        (r"(?i)total\s+assets\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)", 10**6, 10**6),
    ),
    "other": (
        (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)", 1, 10**9),
        (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)", 10**6, 10**6),
        (r"(?i)([\d,]+(?:\.\d+)?)\s*(?:thousand|,000)", 10**6, 10**3),
    ),
}
CHART_TYPES = ("bar chart", "line graph", "pie chart", "scatter plot", "table")
INSIGHT_WORDS = ("shows", "indicates", "reveals", "trend", "increase", "decrease")

# --- fixed values: entities and statements ------------------------------------------------------
ENTITY_PATTERNS = (
    (r"(?i)\$[\d,.]+\s*(?:billion|million|B|M)", "MONEY"),
    (r"(?i)(?:Q[1-4]\s+)?(?:20[12]\d)", "DATE"),
    (r"(?i)(?:revenue|net income|earnings|profit|loss)", "METRIC"),
    (r"(?i)(?:Apple|Microsoft|Google|Amazon|Tesla|NVIDIA|Meta)", "COMPANY"),
    (r"(?i)(?:CEO|CFO|CTO|Director|Officer)\s+[A-Z][a-z]+\s+[A-Z][a-z]+", "PERSON"),
)
# predicate, confidence, pattern; money patterns have an amount and a unit group
TRIPLE_PATTERNS = (
    ("REPORTED_REVENUE", 0.9,
     r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+reported\s+\$([\d,.]+)\s*(billion|million)?\s*(?:in\s+)?(?:total\s+)?revenue"),
    ("NET_INCOME", 0.9,
     r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)'?s?\s+net\s+income\s+(?:was|were)\s+\$([\d,.]+)\s*(billion|million)?"),
    ("ACQUIRED", 0.8, r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+(?:acquired|merged\s+with)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)"),
    ("OPERATES_IN", 0.85,
     r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+operates?\s+in\s+the\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)*)\s+(?:industry|sector)"),
)

# --- fixed values: suggestions, gates, prices ------------------------------------------------------
DEFAULT_SUGGESTIONS = (
    "What was Microsoft's revenue in 2024?",
    "Compare Amazon and Google revenue growth",
    "What are Tesla's main risk factors?",
    "Analyze Apple's profit margins",
    "What is NVIDIA's market share?",
)
SOURCE_SUGGESTIONS = (
    "What is {}'s revenue in 2024?",
    "What are {}'s main risk factors?",
    "Compare {}'s financial performance",
)
CI_THRESHOLDS = {
    "overall_score": 0.6,
    "retrieval_precision": 0.5,
    "retrieval_recall": 0.5,
    "answer_faithfulness": 0.6,
    "answer_relevance": 0.5,
}
# USD per million tokens (in, out)
PRICES = {"small": (0.05, 0.10), "large": (0.25, 0.50)}
COST_BUDGET = 0.05
