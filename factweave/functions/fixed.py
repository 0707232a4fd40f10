"""Lists and thresholds that results depend on."""

# --- fixed values: entity domain -------------------------------------------------------------
ENTITY_TYPES = [
    "ORG", "PERSON", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART",
    "LAW", "DATE", "MONEY", "PERCENT", "QUANTITY", "UNKNOWN",
]
NER_TYPE_MAP = {
    "person": "PERSON", "organization": "ORG", "company": "ORG", "location": "LOC",
    "city": "GPE", "country": "GPE", "product": "PRODUCT", "event": "EVENT",
    "date": "DATE", "money": "MONEY", "quantity": "QUANTITY",
}
EXTRACTION_METHODS = ["hybrid", "spacy", "split", "model"]

# --- fixed values: sentiment vocabulary ------------------------------------------------------
POSITIVE_WORDS = [
    "acquired", "announced", "launched", "released", "expanded", "grew", "increased", "improved",
    "won", "awarded", "partnered", "collaborated", "joined", "signed", "agreed", "approved",
    "completed", "achieved", "invested", "funded", "raised", "promoted", "hired", "appointed",
]
NEGATIVE_WORDS = [
    "lost", "declined", "decreased", "dropped", "fell", "failed", "fired", "laid off", "resigned",
    "sued", "accused", "charged", "investigated", "fined", "penalized", "rejected", "denied",
    "closed", "shut down", "cancelled", "terminated", "withdrew", "abandoned",
]
NEUTRAL_WORDS = [
    "said", "stated", "reported", "confirmed", "disclosed", "is", "was", "are", "were", "has",
    "have", "had", "located", "based", "headquartered", "operates", "employs",
]

# --- fixed values: web page handling ---------------------------------------------------------
DROPPED_TAGS = [
    "script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "form",
    "button", "input", "select", "textarea",
]
DROPPED_ATTR_PARTS = [
    "nav", "menu", "sidebar", "footer", "header", "comment", "advertisement", "ad-", "social",
    "share", "related", "recommended", "popup", "modal", "cookie", "banner", "promo",
]
CAPTCHA_PHRASES = [
    "captcha", "cloudflare", "checking your browser", "please verify you are a human",
    "access denied", "bot protection", "ddos protection", "just a moment", "enable javascript",
    "please enable cookies", "verify you are human", "security check",
]
CAPTCHA_MAX_CHARS = 50000
MIN_PAGE_TEXT = 50
MIN_CONTENT_TEXT = 100
PDF_METADATA_KEYS = {
    "title": "title", "author": "author", "subject": "subject", "keywords": "keywords",
    "creator": "creator", "producer": "producer", "creationDate": "created", "modDate": "modified",
}

# --- fixed values: person and organisation matching ------------------------------------------
PERSON_TITLES = ["dr.", "dr ", "mr.", "mr ", "mrs.", "mrs ", "ms.", "ms ", "prof.", "prof "]
ORG_SUFFIXES = [
    " inc.", " inc", " corp.", " corp", " corporation", " ltd.", " ltd", " limited", " llc",
    " plc", " co.", " co", " company",
]
FILER_SUFFIXES = [" inc", " inc.", " corp", " corp.", " co", " co.", " ltd", " llc"]
ROLE_SYNONYMS = [
    ["ceo", "chief executive", "chief executive officer"],
    ["cfo", "chief financial officer"],
    ["president", "chairman", "chairman and ceo"],
    ["founder", "co-founder", "cofounder", "founding member"],
]
ROLE_PATTERNS = [
    r"\b(CEO|CFO|CTO|COO|CMO|CIO|CISO|CSO)\b",
    r"\b(Chief\s+\w+\s+Officer)\b",
    r"\b(President|Chairman|Director|Manager|Executive|Founder|Co-Founder)\b",
    r"\b(Vice\s+President|VP)\b",
    r"\b(Head\s+of\s+\w+)\b",
    r"\b(Senior\s+\w+|Lead\s+\w+|Principal\s+\w+)\b",
]
ORG_NAME_PATTERN = r"[A-Z][A-Za-z\s&]+(?:Inc|Corp|Ltd|LLC|Company|Co)?\.?"
SOURCE_PREFIXES = {
    "gleif": "LEI", "sec_edgar": "SEC-CIK", "companies_house": "UK-CH", "wikidata": "WIKIDATA",
}
SOURCE_NUMBERS = {"gleif": 1, "sec_edgar": 2, "companies_house": 3, "wikipedia": 4, "wikidata": 4}

# --- fixed values: canonical predicates ------------------------------------------------------
CANONICAL_PREDICATES = [
    "owned by", "parent organization", "ultimate parent", "has subsidiary",
    "acquired", "merged with", "spun off from", "controlling shareholder",
    "minority shareholder", "beneficial owner", "person of significant control",
    "nominee for", "succeeded by", "preceded by",
    "investor", "funded by", "creditor", "debtor", "vc backed by", "pe backed by",
    "ipo underwriter", "bond holder",
    "chief executive officer", "chief financial officer", "chief operating officer",
    "founder", "board member", "chairperson", "company secretary", "employee",
    "former employee", "former director", "advisor", "consultant",
    "division of", "department of",
    "supplier", "customer", "manufacturer", "distributor", "contractor",
    "outsources to", "subcontractor", "raw material source",
    "headquarters", "located in", "operates in", "facility in", "registered in",
    "tax residence", "offshore entity in", "branch in", "citizenship", "formed in", "residence",
    "sued", "sued by", "fined by", "regulated by", "licensed by", "sanctioned by",
    "investigated by", "settled with", "consent decree with", "debarred by",
    "lobbies", "donated to", "endorsed by", "member of", "sponsored by",
    "lobbied by", "pac contribution", "revolving door",
    "polluted", "affected community", "displaced", "deforested", "benefited",
    "restored", "employed in", "invested in community", "violated rights",
    "emitted ghg", "water usage", "waste disposal",
    "brand of", "product of", "trademark of", "licensed from", "white label for",
    "recalls", "developer", "publisher",
    "partner", "joint venture with", "franchisee of", "distributor for",
    "licensed to", "exclusive dealer", "operator",
    "spouse", "relative", "associate", "co-founder", "classmate", "club member",
    "industry", "competitor", "similar to", "same sector", "peer of", "instance of",
    "mentioned with", "accused of", "praised for", "criticized for",
    "announced", "rumored", "participant",
]

# --- fixed values: taxonomy categories -------------------------------------------------------
TAXONOMY_CATEGORIES = [
    "environment", "society", "governance", "animals", "industry", "human_harm",
    "human_benefit", "animal_harm", "animal_benefit", "environment_harm", "environment_benefit",
]

# --- our own tables, authored here because no public ones exist
# (category, predicate, description)
PREDICATE_TABLE = [
    ("ownership", "acquired", "bought a company or asset"),
    ("ownership", "owned_by", "is owned by"),
    ("ownership", "has_subsidiary", "controls a subsidiary"),
    ("people", "works_for", "is employed by"),
    ("people", "founded", "started an organisation"),
    ("people", "led_by", "is led by a person"),
    ("supply", "supplies", "provides goods"),
    ("supply", "ships", "delivers goods"),
    ("supply", "takes_back", "accepts returned goods"),
    ("place", "located_in", "is located in"),
    ("place", "operates_in", "has operations in"),
    ("product", "announced", "made something public"),
    ("product", "released", "brought to market"),
    ("legal", "sued", "took legal action"),
    ("legal", "fined_by", "was fined by"),
    ("trade", "placed", "placed an order"),
]
# (category, label)
TAXONOMY_TABLE = [
    ("environment", "climate"), ("environment", "water"), ("environment", "waste"),
    ("society", "education"), ("society", "health"), ("society", "housing"),
    ("governance", "board"), ("governance", "audit"), ("governance", "lobbying"),
    ("animals", "wildlife"), ("animals", "livestock"),
    ("industry", "manufacturing"), ("industry", "logistics"), ("industry", "energy"),
    ("human_harm", "injury"), ("human_harm", "forced labour"),
    ("human_benefit", "jobs"), ("human_benefit", "donations"),
    ("animal_harm", "testing"), ("animal_benefit", "sanctuary"),
    ("environment_harm", "pollution"), ("environment_harm", "deforestation"),
    ("environment_benefit", "reforestation"), ("environment_benefit", "recycling"),
]

# --- fixed values: repair of model answers in XML ----------------------------------------------
TRUNCATED_CLOSERS = [
    (r"</statement[^s>]*$", "</statements>"), (r"</stm[^t>]*$", "</stmt>"),
    (r"</subjec[^t>]*$", "</subject>"), (r"</objec[^t>]*$", "</object>"),
    (r"</predica[^t>]*$", "</predicate>"), (r"</tex[^t>]*$", "</text>"),
]
SPLIT_SENTENCE = r"(?s)<stmt>.*?<text>(.*?)</text>.*?</stmt>"
BARE_AMPERSAND = r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"

# --- fixed values: sentence marks and white space --------------------------------------------
SENTENCE_MARKS = ".!?\n"
BLANK_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
