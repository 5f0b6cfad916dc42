"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

# Stop words removed from clause text. Contractions are left out
# because the apostrophe has already become a space when the list is applied.
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are as at
    be because been before being below between both but by
    can cannot could
    did do does doing down during
    each
    few for from further
    had has have having he her here hers herself him himself his how
    i if in into is it its itself
    me more most my myself
    no nor not
    of off on once only or other ought our ours ourselves out over own
    same she should so some such
    than that the their theirs them themselves then there these they this those through to too
    under until up
    very
    was we were what when where which while who whom why with would
    you your yours yourself yourselves
    shall may including without limitation pursuant herein thereof therein thereby
    within upon prior thereafter thereon therefrom hereby herewith
    """.split()
)

# Spelled-out numbers masked as "num".
NUMBER_WORDS = tuple(
    """
    zero one two three four five six seven eight nine ten eleven twelve
    thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety
    hundred thousand million billion
    """.split()
)

# Redaction marks in order of precedence (RE2-compatible).
REDACTION_PATTERNS = (
    r"(?i:\[REDACTED\])",
    r"(?i:x{3,})",
    "\u2588+",
    r"\[\[.+?\]\]",
)

# Rule vocabulary, reported as "<group>: <pattern>" in this order.
RULE_PATTERNS = (
    ("exceptions", r"\bexcept\b"),
    ("exceptions", r"\bunless\b"),
    ("exceptions", r"\bprovided that\b"),
    ("exceptions", r"\bsubject to\b"),
    ("exceptions", r"\bnotwithstanding\b"),
    ("exceptions", r"\bhowever\b"),
    ("exceptions", r"\bbut\b"),
    ("methodology_shift", r"\bmedicare\b"),
    ("methodology_shift", r"\bucr\b"),
    ("methodology_shift", r"\brbrvs\b"),
    ("methodology_shift", r"\bper diem\b"),
    ("methodology_shift", r"\bcapitation\b"),
    ("methodology_shift", r"\bbundled\b"),
    ("methodology_shift", r"\bstop.loss\b"),
    ("reanchoring", r"\blesser of charges\b"),
    ("reanchoring", r"\bpayer allowed amount\b"),
    ("reanchoring", r"\bmost favored nation\b"),
    ("reanchoring", r"\blowest rate\b"),
    ("forbidden_conditions", r"\bindemnify\b"),
    ("forbidden_conditions", r"\bhold harmless\b"),
    ("forbidden_conditions", r"\bsole discretion\b"),
    ("forbidden_conditions", r"\bat will\b"),
    ("forbidden_conditions", r"\bunilateral\b"),
)

# Flag name -> substrings searched in lower-cased chunk content.
CHUNK_CONTENT_TERMS = {
    "contains_compensation": ("compensation", "payment", "reimbursement", "rate"),
    "contains_provider": ("provider",),
    "contains_member": ("member",),
    "contains_medicaid": ("medicaid",),
    "contains_medicare": ("medicare",),
    "contains_claims": ("claim",),
    "contains_network": ("network",),
}

# Flag name -> substrings searched in lower-cased attribute content.
ATTRIBUTE_TERMS = {
    "has_medicaid": ("medicaid",),
    "has_medicare": ("medicare",),
    "has_timely_filing": ("timely filing",),
    "has_fee_schedule": ("fee schedule",),
    "has_claims": ("claims",),
    "has_provider": ("provider",),
}

# Matches kept per attribute number; other numbers are not limited.
ATTRIBUTE_CAPS = {1: 7, 2: 7, 3: 3, 4: 5, 5: 5}

# Collection key -> state.
COLLECTION_STATES = {
    "TNstandard": "TN",
    "WAstandard": "WA",
    "TNredacted": "TN",
    "WAredacted": "WA",
}
TEMPLATE_COLLECTIONS = ("TNstandard", "WAstandard")

# Words a word cloud skips.
WORDCLOUD_STOP_WORDS = tuple(
    """
    the and for are with this that from they have will been said each which their
    """.split()
)

# Words treated as negators.
NEGATORS = ("not", "no", "without", "except")

# Chat hints in order of precedence, message substring -> file filter.
# The last two are matched as separate words.
CONTRACT_HINTS = (
    ("tn contract 1", "TN_Contract1"),
    ("contract1", "TN_Contract1"),
    ("tn contract 2", "TN_Contract2"),
    ("tn contract 3", "TN_Contract3"),
    ("tn contract 4", "TN_Contract4"),
    ("tn contract 5", "TN_Contract5"),
    (" wa ", "WA"),
    (" tn ", "TN"),
)

# Sentences that explain a decision; users match on them.
NLI_UNAVAILABLE_HIGH = "NLI unavailable, high paraphrase similarity: "
NLI_UNAVAILABLE_LOW = "NLI unavailable, moderate paraphrase similarity"
NLI_ALIGNED = "Both-way entailment: meanings aligned"
NLI_CONTRADICTION = "Contradiction detected"
NLI_NEUTRAL_HIGH = "Neutral NLI but high paraphrase similarity: "
NLI_ONE_WAY = "One-way or neutral entailment (pred1=%s, pred2=%s)"
NEGATION_UNAVAILABLE = "Negation analysis unavailable"
NEGATION_COUNTS = "Different negation counts: candidate=%d, template=%d"
NEGATION_NONE = "No negations in either text"
NEGATION_SCOPE = "Negation scope similarity: %.2f"
EXACT_MATCH = "Exact structural match with template"
NO_CONTENT = "No preprocessed content"
UNKNOWN_STATE = "Unknown state for collection"
SEMANTIC_SCORE = "Semantic similarity: "
PARAPHRASE_SCORE = "Paraphrase similarity: "
RULE_FLAGS = "Rule flags triggered: "
NEGATION_MISMATCH = "Negation scope mismatch: "
NLI_PASSED = "NLI passed: "
NLI_FAILED = "NLI failed: "

# The line shown where no model answers.
ANSWER_NOTHING = "No relevant information found"
ANSWER_COUNT = " non-standard clauses"
