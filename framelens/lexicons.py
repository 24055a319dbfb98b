"""Word lists and patterns of the frame analysis. Results depend on them exactly as they stand here."""

from __future__ import annotations

FRAMES = ("underrepresentation", "overrepresentation", "obstacles", "successes")
SUMMARY_GROUPS = ("women", "men", "white_women", "white_men", "women_of_color", "men_of_color")
ALL_GROUPS = (*SUMMARY_GROUPS, "people_of_color", "white_people")

#: Whole words that mention a group of people. The plural forms only, as the study's patterns have them.
GROUP_PATTERNS = {
    "women": "women?|females?|girls?",
    "men": "men|males?|boys?",
    "white": "white|caucasian",
    "black": "black|african[- ]american",
    "hispanic": "hispanic|latinx?|latina|latino",
    "asian": "asian|asian[- ]american",
    "poc": "people of color|minority|minorities",
}
OF_COLOR = ("black", "hispanic", "asian", "poc")

LEADERSHIP_TERMS = ("ceo", "executive", "director", "manager", "leader", "president", "vp", "vice president", "board", "c-suite", "leadership", "management", "supervisor", "chief", "head", "chair", "partner", "principal")
SEGMENT_KEYWORDS = ("CEO", "executive", "director", "president", "leadership", "board", "management")
POSITION_TERMS = ("ceo", "executive", "director", "manager", "president", "vice president", "vp", "chief", "head", "leader")

FRAME_INDICATORS = {
    "underrepresentation": ("underrepresented", "lower rates", "less than", "only", "just", "few", "lacking", "scarce", "minority", "small percentage", "rarely"),
    "overrepresentation": ("overrepresented", "dominate", "majority", "most", "predominantly", "disproportionately", "overwhelmingly", "comprise", "hold most"),
    "obstacles": ("barrier", "ceiling", "discrimination", "harder", "challenges", "difficulty", "struggle", "bias", "stereotypes", "prejudice", "hurdles", "impediments"),
    "successes": ("first", "breakthrough", "achievement", "milestone", "appointed", "promoted", "advanced", "succeeded", "accomplished", "pioneering", "historic", "landmark"),
}

FRAME_LEXICONS = {
    "underrepresentation": {
        "strong": ("underrepresented", "lacking", "absence", "scarcity", "dearth"),
        "moderate": ("few", "only", "just", "merely", "small number"),
        "comparative": ("less than", "fewer than", "below", "under"),
        "statistical": ("percent", "percentage", "minority", "fraction"),
    },
    "overrepresentation": {
        "strong": ("overrepresented", "dominate", "monopolize", "control"),
        "moderate": ("majority", "most", "predominant", "prevailing"),
        "comparative": ("more than", "exceed", "surpass", "above"),
        "statistical": ("percent", "percentage", "lion's share"),
    },
    "obstacles": {
        "structural": ("barrier", "ceiling", "wall", "block", "impediment"),
        "discrimination": ("bias", "discrimination", "prejudice", "stereotypes"),
        "difficulty": ("struggle", "challenge", "difficulty", "hardship"),
        "systemic": ("systemic", "institutional", "structural", "entrenched"),
    },
    "successes": {
        "achievement": ("achievement", "accomplishment", "success", "triumph"),
        "milestone": ("first", "breakthrough", "milestone", "landmark"),
        "advancement": ("promoted", "appointed", "elevated", "advanced"),
        "recognition": ("award", "honor", "recognition", "celebrated"),
    },
}
#: Weight of a category in the frame's total score; 1 where nothing is said.
CATEGORY_WEIGHTS = {"strong": 2.0}

DEMOGRAPHIC_TERMS = {
    "gender": {"women": ("women", "woman", "female", "females", "she", "her"), "men": ("men", "man", "male", "males", "he", "his")},
    "race": {
        "white": ("white", "caucasian"),
        "black": ("black", "african american", "african-american"),
        "hispanic": ("hispanic", "latino", "latina", "latinx"),
        "asian": ("asian", "asian american", "asian-american"),
        "indigenous": ("indigenous", "native american", "native"),
        "poc": ("people of color", "minority", "minorities", "diverse"),
    },
    "intersectional": {
        "women_of_color": ("women of color", "black women", "latina women", "asian women"),
        "white_women": ("white women", "caucasian women"),
        "white_men": ("white men", "caucasian men"),
        "men_of_color": ("men of color", "black men", "latino men", "asian men"),
    },
}

LINGUISTIC_PATTERNS = {
    "passive_voice": r"\b(was|were|been|being|is|are|am)\s+\w+ed\b",
    "active_voice": r"\b(holds?|leads?|manages?|directs?|heads?)\b",
    "comparison": r"\b(more|less|fewer|greater|higher|lower)\s+than\b",
    "statistics": r"\b\d+\.?\d*\s*(?:percent|%|percentage)\b",
    "absolute": r"\b(all|every|none|never|always|only)\b",
}
PERCENTAGE = r"(\d+(?:\.\d+)?)\s*(?:percent|%)"
COMPARISON = r"(\d+(?:\.\d+)?)\s*times\s*(more|less|higher|lower)"
NUMBER = r"\b\d+\b"
QUOTE_PATTERNS = (
    r'"([^"]+)"\s*,?\s*(?:said|says|according to)\s+([^,.]+)',
    r'([^,]+?)\s+(?:said|says|stated)\s*,?\s*"([^"]+)"',
    r'"([^"]{20,})"',
)

#: Substrings whose number over a corpus is reported per frame (no word boundaries).
CORPUS_KEYWORDS = {
    "underrepresentation": ("underrepresented", "lower rates", "less than", "only", "just"),
    "overrepresentation": ("overrepresented", "dominate", "majority", "most"),
    "obstacles": ("barrier", "ceiling", "discrimination", "harder", "challenges"),
    "successes": ("first", "breakthrough", "achievement", "milestone", "appointed"),
}
#: The simpler demographic patterns of the demonstration.
SIMPLE_GROUPS = {"women": "women|woman|female|females", "men": "men|man|male|males", "white": "white|caucasian", "black": "black|african american", "poc": "people of color|hispanic|latino|latina|asian"}
#: Descriptions by which a zero-shot model knows the frames.
ZERO_SHOT_LABELS = {
    "underrepresentation": "underrepresentation in leadership positions",
    "overrepresentation": "overrepresentation in leadership positions",
    "obstacles": "barriers and obstacles to leadership",
    "successes": "achievements and successes in leadership",
}

#: Wordings of each frame; what stands in brackets is filled from TEMPLATE_TERMS, X% is a percentage.
FRAME_TEMPLATES = {
    "underrepresentation": ("only X% are [demographic]", "[demographic] make up just X%", "[demographic] are hired at much lower rates", "few [demographic] hold [leadership position]"),
    "overrepresentation": ("[demographic] comprise X% of [leadership roles]", "[demographic] remain overrepresented", "[demographic] dominate [sector/position]", "X% of [leadership positions] are held by [demographic]"),
    "obstacles": ("[demographic] face barriers", "harder time for [demographic]", "[discrimination type] impact [demographic]", "[demographic] are up against [obstacle metaphor]"),
    "successes": ("[demographic] became the first [position]", "[demographic] are making great strides", "[demographic] achieved [milestone]", "breakthrough for [demographic]"),
}
#: Function words by which a text in Latin letters is known for its language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "at", "by", "has", "from", "are", "said"),
    "de": ("der", "die", "das", "und", "nicht", "ist", "von", "mit", "den", "für", "auf", "ein", "eine", "im", "dem", "sich"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "dans", "pour", "que", "qui", "du", "au", "sur", "pas", "plus"),
    "es": ("el", "la", "los", "las", "de", "que", "en", "una", "por", "con", "para", "del", "se", "su", "fue", "más"),
}
#: Languages known by their script: the class of their letters.
SCRIPTS = {"ja": r"[\x{3040}-\x{30FF}]", "zh": r"[\x{4E00}-\x{9FFF}]", "ru": r"[\x{0400}-\x{04FF}]", "ar": r"[\x{0600}-\x{06FF}]", "hi": r"[\x{0900}-\x{097F}]", "th": r"[\x{0E00}-\x{0E7F}]", "am": r"[\x{1200}-\x{139F}]", "ko": r"[\x{AC00}-\x{D7A3}]"}
