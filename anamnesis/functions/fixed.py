"""Values that results depend on, stated as they are."""

# Patterns of rule-based text operators.
TOKEN = "[a-z0-9]+"
TOPIC_WORD = "[a-zA-Z][a-zA-Z'-]{3,}"
CONTENT_WORD = "[a-zA-Z][a-zA-Z'-]+"
ENTITY = r"\b[A-Z][a-zA-Z'-]{1,}(?:\s+[A-Z][a-zA-Z'-]{1,})*\b"
UPDATE_MARKERS = (
    r"\b(actually|now|updated?|changed?|reschedul\w*|no longer|previously|instead of|decided to|switch(?:ed)?(?: to)?|moved to|revised|"
    r"new (?:target|goal|deadline|date|schedule|budget|number|total)|bumped|increased to|decreased to|reduced to|raised to|lowered to|"
    r"cut (?:it|down) to|upped? (?:it|to)|set (?:it|the \w+) to|adjusted to|final(?:ly)? (?:date|deadline|target)|as of (?:now|today))\b"
)
NEGATIONS = r"\b(never|not|n't|no longer|haven'?t|hasn'?t|didn'?t|don'?t|doesn'?t|won'?t|can'?t)\b"
VALUE = (
    r"(\$?\d[\d,.]*\s*(?:%|k|hours?|hrs?|words?|dollars?|bucks?|miles?|km|minutes?|mins?|days?|weeks?|months?|years?)?|"
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b|\b\d{1,2}:\d{2}\s?(?:AM|PM|am|pm)?\b)"
)
VALUE_EXPECTED = (
    r"\b(how\s+many|how\s+much|how\s+long|what\s+is|what\s+are|what\s+was|when\s+is|when\s+was|when\s+does|when\s+did|which\s+\w+|do\s+i|am\s+i|"
    r"have\s+i|is\s+my|are\s+my|was\s+my|what(?:'s| is)\s+my|current|latest|target|budget|deadline|total)\b"
)
TIMELINE = r"\b(when\b|order(?:ed|ing)?\b|before\b|after\b|first\b|last\b|between\b|sequence\b|chronolog\w+|how\s+many\s+(?:days|weeks|months|years)|how\s+long\s+(?:did|does|ago|between))"
DELTA = r"\bhow\s+many\s+(?:days|weeks|months|years)|how\s+long\b|\bbetween\b"
AGO = r"\bhow\s+(?:many\s+)?(?:long|days?|weeks?|months?|years?)\s+ago\b|\bago\b"
PERSONA_SKIP = (
    r"\b(pain|doctor|doctors|medic\w*|diagnos\w*|symptom\w*|condition|treatment|therap\w+|appointment|clinic|hospital|insurance|claim|"
    r"address|social\s+security|ssn|password|invoice|billing|what\s+did|when\s+did|where\s+did|who\s+did|how\s+many)\b"
)
TIME_ANSWER = (
    r"\b(20\d{2}|January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec|yesterday|today|tomorrow|ago|last|next)\b"
)
RELATIVE_ANSWER = r"\b(yesterday|today|tomorrow|last\s+\w+|next\s+\w+|\w+\s+ago)\b"
N_AGO = r"\b(a|an|one|two|three|four|five|\d+)\s+(day|week|month|year)s?\s+ago\b"

# Suffixes of the light stemmer and what replaces them, in order of trial.
SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("ly", ""), ("es", ""), ("s", ""))

# Words that are no topic.
TOPIC_STOP = """actually now updated changed rescheduled longer previously instead decided
switched moved revised bumped increased decreased reduced raised lowered adjusted finally
will would have has had the a an and or but for with about from this that these those your
you i we they it its was were is are been said says just really very much more most some any
all can could should may might want wanted think thought know knew like love enjoy prefer
favorite thing things time today tomorrow yesterday one two three four five six seven eight nine ten
what which who whom whose when where why how""".split()

# Words that are no content, for evidence recall.
CONTENT_STOP = """the a an and or but if then else of to in on at by for with about as is are was were be been being
do does did done have has had having will would can could should may might must shall this that these those there
here it its from not no nor so than too very just also only own same such then once
i you he she we they me him her us them my your his their our
what which who whom whose when where why how
say says said get got go goes went make makes made take takes took know knows knew""".split()

# Capitalised words that are no entity by themselves.
NO_ENTITY = """I My Me We Our You Your He His She Her They Them Their It Its What When Where Why How Who
The A An And But Or So If Then This That These Those There Here Was Is Are Were Been Have
Has Had Do Does Did Will Would Can Could Should Not No Yes Also Just Really Actually Well Okay Ok
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December Today Tomorrow Yesterday""".split()

# Counts that words stand for.
QUANTITIES = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5}

# Characters that some readers take for line ends.
LINE_BREAKERS = "  \u0085\u000b\u000c\u001c\u001d\u001e"

# Rank fusion and BM25 parameters.
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 1.0, 0.5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
# Weights of units that came after an index was built.
DELTA_K1, DELTA_B = 1.2, 0.75
