"""Fixed values.

Everything in this file is a constant whose value decides results: word
lists, patterns, thresholds and labels. Nothing here is logic.
"""

# --- Fixed values: white space and token patterns -------------------------
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES = r"(?U)\s+"
WORD = r"[A-Za-z][A-Za-z0-9&'/-]*|[가-힣][가-힣0-9·/-]*"
SEARCH_TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[가-힣]+"
ACRONYM = r"(?U)\b[A-Z][A-Z0-9&/-]{1,}\b"
PAREN_PAIR = (
    r"(?U)\b([A-Z][A-Za-z0-9&'/-]*(?:\s+[A-Z][A-Za-z0-9&'/-]*){1,8})\s*"
    r"\(([A-Z][A-Z0-9&/-]{1,})\)"
)
KOREAN_PAREN_PAIR = r"([가-힣A-Za-z0-9·/\-& ]{2,80}?)(?U:\s*)\(([A-Z][A-Z0-9&/-]{1,})\)"
SEGMENT_SPLIT = r"[,;:.!?。！？()\[\]\n\r]+"
SENTENCE_SPLIT = r"(?U)(?<=[.!?。！？])\s+"
SENTENCE_END = r"""(?U)[.!?。！？]["'”’»)\]]*(?:\s+|$)"""
ROMAN_NUMERAL = r"(?i)^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\z"
SOURCE_SEPARATORS = r"(?iU)\s*,\s*|\s*/\s*|\s+and\s+|\s+&\s+"
TARGET_SEPARATORS = r"(?U)\s*,\s*|\s*/\s*|\s+및\s+|\s+과\s+|\s+와\s+"
TARGET_BOUNDARY = r"(?U)[.。,:;，；]\s*"
TOPIC_PREFIX = r"(?U).*(?:은|는|이|가)\s+"
OBJECT_PREFIX = r"(?U).*(?:을|를|에게|에서|으로|로)\s+"
ENGLISH_POSSESSIVE_PREFIX = r"(?U)^[A-Za-z0-9&/-]+\s+의\s+"
CONTEXT_LABEL = r"(?iU)\b(?:PREVIOUS|NEXT|SECTION_HEADING|TABLE_TITLE|ABBREVIATION_HINTS):"
KOREAN_PARTICLE_END = r"(?:에서|으로|부터|까지|에게|께서|은|는|이|가|을|를|과|와|의|에|로|도|만)$"
KOREAN_PREDICATE_ENDINGS = ["합니다", "한다", "했다", "된다", "이다", "있다", "없다"]
EDGE_LEFT = r"(?<![A-Za-z0-9가-힣])"
EDGE_RIGHT = r"(?![A-Za-z0-9가-힣])"

# --- Fixed values: term word lists ---------------------------------------
LEADING_STOPWORDS = "the this that these those a an".split()
FUNCTION_WORDS = "and or of in to for with by from as".split()
PLACEHOLDERS = "blank n/a na none null".split()
SENTENCE_MARKERS = (
    "am are be been being can could did do does had has have is may might must shall "
    "should was were will would"
).split()
NAME_STOPWORDS = (
    "a about after all also although an and another any as at because before but by chapter "
    "could did do does during each even every for from had has have he her here his how "
    "however if in into is it its may more most must no not now of on one only or other our "
    "shall she should since so some such than that the their then there these they this those "
    "through to under was we were when where which while will with would you"
).split()
TITLECASE_NOISE = (
    "A An And But For If In It No Not Of On Or So The This To What When Where Which Who Why With"
).split()
TITLECASE_GENERIC_NOISE = TITLECASE_NOISE + (
    "Access Actually Adults Again Agreement Agreements Almost Alone Always Annex Anyway "
    "Assistant Attendant Auditorium Back Begin Beyond Book Books Both Call Can Caretaker Center "
    "Close Come Congratulations Content Courage Crew Crews December Delivery Department "
    "Director Doctor Downward Chapter Contents Copyright Foreword Introduction Page Part "
    "Section Table Title"
).split()
COMMON_SOURCE_WORDS = (
    "a about after all also am an and are area as at attention be because been but by can "
    "could did do does for finally from had hair has have he her his how if in into "
    "immediately indirect is it its it's lets let's maybe me my no not notice of on or other "
    "our page please recreation released reminder she so special that that's thats the their "
    "them then there there's theres they this to was we were what what's whats when where "
    "which who why will with would you your"
).split()

# --- Fixed values: thresholds --------------------------------------------
MAX_OCCURRENCES = 128
MAX_RELEVANT_TERMS = 18
MAX_RELEVANT_DOCUMENT_TERMS = 12
MEMORY_TTL_SECONDS = 6 * 60 * 60
LOCK_MIN_SCORE = 0.55
LOCK_MIN_OBSERVED_SCORE = 0.4
LOCK_MIN_TARGET_COUNT = 2
LOCK_MIN_TARGET_SHARE = 0.6
LOCK_MAX_TARGET_ENTROPY = 0.8
AMBIGUOUS_BASE_MIN_TERMS = 4
RELATED_BASE_MIN_TERMS = 3
SPLIT_CHARS, HARD_SPLIT_CHARS = 500, 800
NEIGHBOUR_CHARS, FRAGMENT_CHARS, TITLE_CHARS, CELL_CHARS = 220, 260, 220, 120
CELL_CONTEXT_ITEMS = 6
SCOPE_MAX_CHARS, SCOPE_MAX_ITEMS = 6000, 20
BATCH_MAX_CHARS, BATCH_MAX_ITEMS, BATCH_UNIT_CHARS = 9000, 24, 100
BM25_K1, BM25_B = 1.5, 0.75
EVIDENCE_PER_ENTRY, EVIDENCE_CHARS, INFORMATIVE_CHARS = 4, 220, 60
REVIEW_EVIDENCE_CHARS, REVIEW_CHUNK = 420, 40
TARGET_DUPLICATE_SIMILARITY, SOURCE_DUPLICATE_SIMILARITY = 0.88, 0.78
REVIEW_CONFIDENCE_CAP = 0.74

# --- Fixed values: kinds, statuses and ranks -----------------------------
CONTEXT_KINDS = ["term_family", "source_note", "source_meaning"]
TARGET_KINDS = ["term", "acronym", "raw_evidence_candidate", "analysis_candidate", "resolver_added"]
CONTEXT_ACTIONS = ["add_family_evidence", "update_family_pattern", "update_note", "no_update", "request_repair"]
TARGET_ACTIONS = [
    "add_sense", "update_sense", "set_active_sense", "add_target_candidate", "mark_preferred",
    "mark_avoid", "request_repair", "no_update",
]
ALL_ACTIONS = [
    "add_sense", "update_sense", "set_active_sense", "add_target_candidate", "add_child_term",
    "add_family_evidence", "update_family_pattern", "update_note", "mark_preferred", "mark_avoid",
    "deprecate_target", "request_repair", "no_update",
]
RELATIONS = ["same_meaning_variant", "acceptable_variant", "different_sense", "sibling_term", "invalid_candidate"]
CONFIRMED_STATUSES = ["preferred", "active", "confirmed", "locked", "soft_locked"]
MATCH_STATUS_RANK = {
    "locked": 100, "confirmed": 95, "preferred": 90, "active": 85, "soft_locked": 80,
    "initial_seed": 70, "review_required": 55, "analysis_candidate": 50, "analysis_hint": 20,
}
PROMPT_STATUS_RANK = {
    "locked": 100, "confirmed": 95, "preferred": 90, "active": 85, "soft_locked": 80,
    "initial_seed": 70, "review_required": 60, "analysis_candidate": 55, "analysis_hint": 20,
}
PROMPT_KIND_RANK = {
    "term": 60, "acronym": 50, "resolver_added": 45, "raw_evidence_candidate": 30,
    "source_note": 20, "source_meaning": 20, "term_family": 10,
}
REVIEW_KIND_PRIORITY = {
    "analysis_candidate": 0, "name": 1, "proper_noun": 1, "acronym": 2, "term": 3,
    "raw_evidence_candidate": 4,
}
BLOCKED_POLICIES = ["blocked", "drop", "drop_candidate", "do_not_inject", "unresolved"]
TERM_BUCKETS = ["pending", "review", "soft_locked", "locked"]
TABLE_ELEMENTS = ["table_cell", "column_header", "row_header"]
HEADING_ELEMENTS = ["heading", "slide_title"]

# --- Fixed values: language names ----------------------------------------
LANGUAGE_ALIASES = {
    "ko": ["ko", "kor", "korean", "한국어"],
    "en": ["en", "eng", "english", "영어"],
    "ja": ["ja", "jp", "jpn", "japanese", "일본어"],
    "zh": ["zh", "cn", "chi", "zho", "chinese", "중국어"],
}
