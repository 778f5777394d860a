"""Word lists, thresholds and formats that decide results.

They are data, kept in one place and in natural order. Names inside the texts
(handbook, inventory product) belong to the corpus the rules were written for.
"""

# Openings that mark a definition as absent.
NO_DEFINITION = (
    "not defined in fa handbook",
    "not defined or referenced",
    "the provided context does not contain",
    "the provided handbook documents do not contain",
    "the provided text does not",
    "not defined in the fa handbook",
    "no formal definition",
)

# Openings that mark governance text as absent.
NO_GOVERNANCE = (
    "not documented",
    "no specific",
    "no documented",
    "no governance",
    "outside governance scope",
)

# Fragments of an empty answer, looked for in its first 400 characters.
BOILERPLATE = (
    "not defined in fa handbook",
    "not specified in fa handbook",
    "not listed in the document",
    "not mentioned in the",
    "no governance rules are imposed",
    "no specific rules imposed",
    "no specific governance",
    "no authority is explicitly",
    "does not exercise any authority",
    "is absent",
    "no information available",
    "the provided text does not",
    "i was unable to",
    "i cannot find",
    "no equivalent definition",
    "no explicit governance",
)
BOILERPLATE_SPAN = 400

# Phrases of a generic answer, looked for in its first 300 characters.
GENERIC = (
    "i don't have enough information",
    "i cannot find",
    "no information available",
    "not mentioned in the",
    "the provided text does not",
    "i was unable to",
    "empty response",
    "based on the context provided, i cannot",
)
GENERIC_SPAN = 300

# Phrases that make a short answer (under 300 characters) a mere denial.
DENIALS = (
    "not defined in fa handbook",
    "not defined in the fa handbook",
    "no formal definition",
    "the provided handbook documents do not contain",
)
DENIAL_LENGTH = 300

# Quality gate. The citation pattern is applied to lower-cased text.
QUALITY_MIN_LENGTH = 150
QUALITY_PASS = 0.5
CITATION = r"\b(?:section\s+\d|s\d{2}\b|rule\s+e\d|article\s+\d|clause\s+\d|paragraph\s+\d)"

# Entity buckets by label fragment; the first bucket that matches wins.
BUCKETS = (
    ("party", (
        "player", "club", "team", "individual", "organisation", "employee", "customer", "member",
        "official", "learner", "prospect", "supplier", "county", "charity", "government", "school",
        "authority", "candidate", "mentor", "developer", "household", "unit", "supporter", "attendee",
    )),
    ("channel", (
        "channel", "broadcast", "streaming", "tv", "radio", "sms", "email", "mobile", "web", "portal",
        "social", "push", "live", "chat", "call centre", "concierge", "in person", "pos", "turnstile",
        "merchandise",
    )),
    ("account", ("account",)),
    ("asset", ("asset", "data", "property")),
)

# Diagram arrow heads, edge styles and the phrases for cardinalities.
ARROWS = (
    ("ERzeroToMany", "0..*"),
    ("ERoneToMany", "1..*"),
    ("ERoneToOne", "1..1"),
    ("ERzeroToOne", "0..1"),
)
EDGE_STYLES = (
    ("entityRelationEdgeStyle", "Entity Relationship"),
    ("orthogonalEdgeStyle", "Orthogonal"),
    ("elbowEdgeStyle", "Elbow"),
)
CARDINALITY_PHRASES = (
    ("0..*-0..*", "relates to (zero or more to zero or more)"),
    ("1..*-0..*", "relates to (one or more to zero or more)"),
    ("0..*-1..*", "relates to (zero or more to one or more)"),
    ("1..1-0..*", "relates to (exactly one to zero or more)"),
    ("0..*-1..1", "relates to (zero or more to exactly one)"),
    ("1..1-1..1", "relates to (exactly one to exactly one)"),
)

# Inventory types that get a collection of their own.
INVENTORY_TYPES = (
    ("DataObject", "dataobject", "DataObject Inventory"),
    ("Interface", "interface", "Interface Inventory (Data Flows)"),
    ("Application", "application", "Application Inventory"),
    ("BusinessCapability", "capability", "Business Capability Inventory"),
    ("Organization", "organization", "Organization Inventory"),
    ("ITComponent", "itcomponent", "IT Component Inventory"),
    ("Provider", "provider", "Provider Inventory"),
    ("Objective", "objective", "Objective Inventory"),
)

# Defined-term patterns (inline sentence, table row), multi-line.
DEFINITION_INLINE = (
    r"(?m)\*{0,2}\"?([A-Z][A-Za-z0-9\s/()'\-]{1,60}?)\"?\*{0,2}\s+means\s+(.+?)(?:\s*;)?\s*$"
)
DEFINITION_ROW = r"(?m)^\|([A-Z][A-Za-z0-9\s<>/\"'()\-]{1,100}?)\|means\s+(.+?)\|?\s*$"
DEFINITION_LENGTH = (10, 1500)

# Numbered section headings as (pattern, name, priority).
SECTION_HEADINGS = (
    (r"^#\s+(\d+)\s*[-–]\s*(.+?)$", "H1_NUM", 1),
    (r"^##\s+(\d+)\s*[-–]\s*(.+?)$", "H2_NUM", 2),
    (r"^##\s+Section\s+(\d+)", "H2_SECTION", 2),
    (r"^#\s+Section\s+(\d+)", "H1_SECTION", 1),
    (r"^###\s+(\d+)\s*[-–]", "H3_NUM", 3),
    (r"^####\s+(\d+)\s*[-–]", "H4_NUM", 4),
)
HEADING_GAP = 100
MIN_SECTION_CHARS = 100

# Retrieval defaults.
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
RETRIEVE_K = 88
RERANK_K = 25
MMR_LAMBDA = 0.7
COVERAGE_TOP_K = 5
COVERAGE_BANDS = ((0.70, "STRONG"), (0.55, "MODERATE"), (0.40, "THIN"))

# Labels of a synthesised answer and the columns they fill.
CONTEXT_FIELDS = (
    ("FORMAL_DEFINITION", "formal_definition"),
    ("DOMAIN_CONTEXT", "domain_context"),
    ("GOVERNANCE", "governance_rules"),
    ("BUSINESS_RULES", "business_rules"),
    ("LIFECYCLE_STATES", "lifecycle_states"),
    ("DATA_CLASSIFICATION", "data_classification"),
    ("REGULATORY_CONTEXT", "regulatory_context"),
    ("ASSOCIATED_AGREEMENTS", "associated_agreements"),
)
TERM_FIELDS = ("TERM", "DEFINITION", "CATEGORY", "GOVERNANCE")
REFERENCE_FIELDS = ("FORMAL_DEFINITION", "CATEGORY", "GOVERNANCE_RULES", "RELATED_TERMS")
RELATION_FIELDS = ("RELATIONSHIP", "DIRECTION", "RULES")

# Catalog defaults.
NO_DESCRIPTION = "Not documented in LeanIX inventory"
CHAT_LIMIT = 50
