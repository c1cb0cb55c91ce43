"""Word lists and patterns that results depend on.

Fixed values: every list, pattern and constant of this module is given by the results to match.
"""

MANDATORY_CUES = r"\b(shall|must|required|mandatory|is\s+to\s+be|obligated)\b"
WEIGHTED_CUES = r"\b(should|scored|weighted|will\s+be\s+evaluated|expected\s+to)\b"
OPTIONAL_CUES = r"\b(may|preferred|desirable|desired|nice[-\s]to[-\s]have|optional)\b"
IMPERATIVE = r"^\s*(submit|provide|include|attach|furnish|supply|deliver|complete|enclose|demonstrate|describe|detail|list|specify|state|confirm|ensure)\b"
DECLARATIVE_RULE = r"^\s*(deadline|due date|closing date|submission|required formats?|format|validity|bid bond|emd)\b\s*[:–-]"
SECTION_OPTIONAL = r"nice[-\s]?to[-\s]?have|optional|desirable|\bpreferred\b"
SECTION_MANDATORY = r"\bmandatory\b|\bshall\b|\brequired\b|\bsubmission\b|instructions to bidders"
SECTION_WEIGHTED = r"\bweighted\b|\bscored\b|\bshould\b|\bevaluation\b"
LABELLED = r"^\s*\**\s*([A-Z]{1,4}-\d{1,4})\s*\**\s*[:.–-]\s*(.+)$"
REQUIREMENT_ID = r"[A-Z]{1,4}-\d{1,4}"
LONG_REQUIREMENT_ID = r"\b[A-Z]{1,4}-\d{2,4}\b"
MIN_REQUIREMENT_WORDS = 4
SUBMISSION_TITLE = r"submission|how to submit|instructions to bidders|annexure"
EVALUATION_TITLE = r"evaluation|scoring|award|weighting"
SUBMISSION_TEXT = r"\b(submit|submission|deadline|format|prescribed|annexure|portal|upload)\b"
CONSTRAINT_TEXT = r"\b(comply|compliance|regulat|guideline|law|act\b|gdpr|rbi|availability|uptime|sla|penalt)\w*"
FORM_HINTS = [
    ("MATRIX", r"\b(?:compliance matrix|traceability matrix|requirements? matrix)\b"),
    ("GANTT", r"\b(?:timeline|milestones?|schedule|roadmap|phasing|implementation plan|project plan)\b"),
    ("COSTING", r"\b(?:cost|costs|costing|price|pricing|financial|commercials?|budget|fees?|rate card)\b"),
    ("CHART", r"\b(?:architecture diagram|diagrams?|heat ?map|charts?|dashboards?)\b"),
    ("APPENDIX", r"\b(?:annexures?|appendix|appendices|attachments?|templates?|escrow|nda|non-disclosure agreement)\b"),
    ("TABLE", r"\b(?:tables?|list of|matrix|kpis?|slas?|references?|cvs?|team structure|resource plan|scoring)\b"),
]
DEDUPE_WORDS = r"\b(the|a|an|of|to|for|and|with|shall|must|should|may|will|vendor|supplier|bidder|provide|include)\b"
ABBREVIATIONS = ["No.", "Ltd.", "Pvt.", "Inc.", "e.g.", "i.e.", "etc.", "vs.", "Rs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Sr.", "Jr.", "Fig.", "Sec.", "Art."]
PROOF_STOPWORDS = "the a an of to for and with in on by is are be as at or that this it its from vendor supplier bidder shall must should may will provide include our we you your system solution support using based".split()
COMPLIANCE_STOPWORDS = "the a an of to for and with in on by is are be as at or that this it its from shall must should may will vendor supplier bidder provide include".split()
QUERY_STOPWORDS = "what which how does do your you the a an of to for and with in on is are describe explain provide please can we our us".split()
MAX_CHARS, OVERLAP_CHARS, MIN_CHARS = 1400, 180, 320
RRF_K, RANK_DEPTH, RERANK_DEPTH, TOP_K = 60, 60, 30, 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
ADDRESSED_FLOOR, THREAD_FLOOR, MIN_SHARED_TOKENS = 0.30, 0.10, 2
PARTIAL_FLOOR, STRONG_FLOOR = 0.12, 0.28
VOICE_SIGMA, VOICE_MIN_SECTIONS, VOICE_MIN_WORDS = 1.8, 4, 60
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE, DURATION_TOLERANCE, WEEKS_PER_MONTH = 0.02, 0.01, 0.12, 4.345
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
TOTAL_LABEL = r"(?i)\b(total|sum|grand total)\b"
TABLE_SEPARATOR = r"^\s*\|[\s:|-]+\|\s*$"
MEASURABLE = {
    "currency": r"(?i)(?:[₹€$£]|INR|EUR|USD|GBP)\s*(-?\d[\d,]*(?:\.\d+)?)",
    "percentage": r"(-?\d[\d,]*(?:\.\d+)?)\s*%",
    "weeks": r"(?i)\b(-?\d[\d,]*(?:\.\d+)?)\s*weeks?\b",
    "months": r"(?i)\b(-?\d[\d,]*(?:\.\d+)?)\s*months?\b",
    "FTE": r"(?i)\b(-?\d[\d,]*(?:\.\d+)?)\s*FTEs?\b",
    "person-days": r"(?i)\b(-?\d[\d,]*(?:\.\d+)?)\s*person[- ]days?\b",
    "year": r"\b(20\d{2})\b",
}
TRACKED = {  # pattern and number of its groups
    "peak FTE": (r"(?i)peak(?:\s+\w+){0,3}?\s+of\s+\*{0,2}(-?\d[\d,]*(?:\.\d+)?)\*{0,2}\s*FTE|peak\s+strength\s+of\s+\*{0,2}(-?\d[\d,]*(?:\.\d+)?)\*{0,2}\s*FTE|\*{0,2}(-?\d[\d,]*(?:\.\d+)?)\*{0,2}\s*FTEs?\s+(?:at\s+)?peak", 3),
    "programme duration in months": (r"(?i)(?:completed|delivered|runs?|lasts?|duration|span)\D{0,40}?(-?\d[\d,]*(?:\.\d+)?)\s*months", 1),
}
DURATION_MONTHS = r"(?i)(?:completed|delivered|runs?|lasts?|duration|span)\D{0,40}?(-?\d[\d,]*(?:\.\d+)?)\s*months"
RISKS = [
    ("unqualified guarantee", "BLOCKER", r"(?i)\b(?:we\s+)?guarantee\w*\b(?![^.]{0,40}\bsubject to\b)"),
    ("absolute performance claim", "BLOCKER", r"(?i)\b100\s*%\s*(?:uptime|availability|accuracy|success|satisfaction)"),
    ("unbounded liability", "BLOCKER", r"(?i)\bunlimited\s+(?:liability|indemnit\w+|coverage|support)"),
    ("unbounded commitment", "BLOCKER", r"(?i)\bfull\s+and\s+unlimited\b"),
    ("absolute quality claim", "BLOCKER", r"(?i)\bzero\s+(?:bugs?|defects?|downtime|risk|errors?)\b"),
    ("absolute reliability claim", "BLOCKER", r"(?i)\bnever\s+(?:fail\w*|make\w*\s+mistakes?|experience\s+downtime)\b"),
    ("universal claim", "WARN", r"(?i)\b(?:all|every)\s+(?:our\s+)?(?:clients?|implementations?|projects?)\s+(?:have\s+)?(?:achiev\w+|deliver\w+|complet\w+)"),
    ("unbounded responsibility", "BLOCKER", r"(?i)\bwe\s+accept\s+full\s+responsibility\b"),
    ("absolute commitment", "WARN", r"(?i)\bno\s+exceptions?\b"),
    ("unqualified financial promise", "BLOCKER", r"(?i)\bat\s+least\s+\d+\s*%\s+under\s+budget\b"),
    ("absolute negative commitment", "WARN", r"(?i)\bwill\s+never\b"),
    ("absolute claim", "WARN", r"(?i)\b(?:always|invariably)\s+(?:deliver|achiev|exceed)\w*"),
]
CHECKABLE = r"(?i)\d|\b(?:all|every|never|always|only|first|best|largest|fastest|leading|unique|guarantee\w*|proven|certified|accredited|award[- ]winning)\b"
ACRONYM = r"\b[A-Z]{2,}\b"
THEME_STOPWORDS = "the a an of to for and with in on by is are be as at or that this it its from your you our we will can shall must should may vendor supplier bidder provide include system solution platform".split()
GROUNDING_BATCH, GROUNDING_SOURCE_CHARS = 8, 700
CONTEXT_CHARS, SNIPPET_CHARS = 4500, 1100
EVALUATION_SECTION = r"evaluation|scoring|award|weighting|criteria"
SUBMISSION_SECTION = r"submission|how to submit|instructions to bidders|proposal format"
RED_LINE = r"\b(disqualif\w*|non[- ]?compliant|will be rejected|shall not be considered|mandatory pass|pass/fail|must pass|failure to comply|automatic rejection)\b"
CONSTRAINT = r"\b(budget|ceiling|not to exceed|cap(?:ped)?|deadline|by \d{1,2} \w+|availability|uptime|sla|penalt\w*|compl\w+ with|guidelines?|regulat\w+|act\b|bill\b|gdpr|rbi|dpdp|iso ?\d+|soc ?2)\b"
ROLE = r"\b(chief \w+ officer|CIO|CTO|CFO|CEO|COO|CISO|head of [\w ]{3,30}|group head|programme director|project director|procurement (?:head|manager|team)|evaluation committee|expert review committee|steering committee|board)\b"
RULE_CAP, ROLE_CAP = 25, 12
LIBRARY_STRENGTH = {"STRONG": 2, "MEDIUM": 1, "MODERATE": 1, "WEAK": 0}
SELLER_SIDE = r"\b(we are|we're|our company is|industry[- ]leading|world[- ]class|best[- ]in[- ]class|market leader|leading provider|award[- ]winning|trusted partner|we offer|we provide)\b"
MIN_THREADS, MAX_SUPPORTING = 2, 4
COMPLIANCE_SIGNALS = r"prescribed (?:format|template|structure)|in the order|follow the structure|mirror|questionnaire|respond to each|answer each|section by section|annexure [a-z]|prescribed excel|required formats?"
NARRATIVE_SPINE = [
    ("Executive summary", 500, []),
    ("Our understanding of your situation", 600, ["objective", "background", "current state", "challenge", "problem", "context"]),
    ("Recommended approach", 900, ["platform", "system", "implement", "integrate", "solution", "architecture", "migration", "ai", "ml", "analytics", "dashboard", "chatbot", "mobile", "api", "automation"]),
    ("Delivery plan and timeline", 500, ["timeline", "milestone", "schedule", "roadmap", "phase", "implementation plan", "deadline"]),
    ("Team and resourcing", 400, ["team", "resource", "cv", "staff", "expertise", "support", "24x7", "dedicated"]),
    ("Governance and assurance", 450, ["governance", "sla", "penalt", "report", "review", "escalation", "monitoring", "audit trail"]),
    ("Security, data protection and compliance", 500, ["security", "compliance", "rbi", "gdpr", "dpdp", "data protection", "privacy", "rbac", "penetration", "escrow", "availability", "uptime"]),
    ("Evidence and references", 400, ["reference", "case study", "client", "testimonial", "credential"]),
    ("Commercials", 400, ["cost", "price", "pricing", "financial", "commercial", "fee", "budget", "discount"]),
    ("Assumptions, risks and exclusions", 450, ["assumption", "risk", "exclusion", "out of scope", "dependency"]),
    ("Submission compliance", 250, []),
    ("Additional requirements", 400, []),
]
FORM_AFFINITY = {"GANTT": "Delivery plan and timeline", "COSTING": "Commercials", "CHART": "Recommended approach", "MATRIX": "Governance and assurance", "TABLE": "Team and resourcing", "APPENDIX": "Submission compliance"}
MATCH_SIMILARITY, MATCH_CONTAINMENT = 0.45, 0.75
RETRIEVAL_QUERY_CHARS, PARAPHRASE_CHARS = 900, 400
HEADING = r"^(#{1,6})\s+(.*?)\s*$"
NUMBERING = r"^\s*((?:\d+|[A-Z])(?:\.\d+)*)[.)]?\s+(.*)$"
UNTITLED, TITLE_WORDS, TITLE_END = "Untitled section", 14, "[.;,]$"
TABLE_ROW = r"^\s*\|(.+)\|\s*$"
BLANK_CELL = r"\A[-: ]*\z"
LIST_MARK = r"^\s*(?:[-*+]|\d+[.)])\s+"
PERCENT_WEIGHT, POINTS_WEIGHT = r"(\d{1,3}(?:\.\d+)?)\s*%", r"(?i)\b(\d{1,3})\s*(?:points?|pts?|marks?)\b"
CRITERION_HEADS = ["criterion", "criteria", "requirement"]
SCAFFOLDING = r"(^|\s)---+(\s|$)|(^|\s)###?\s"
QUESTION = r"\?\s*\z"
