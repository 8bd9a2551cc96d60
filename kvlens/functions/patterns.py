"""Fixed values.

Keyword lists, regular expressions and lookup maps that must equal the
reference's for identical results.  They are stated plainly, in the
reference's order; the composition into Spark expressions lives in
``classify.py``, ``text.py`` and ``metrics.py``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: word maps
# ---------------------------------------------------------------------------

# number words -> digits, applied in this order, no word boundaries (answers)
NUMBER_WORDS_10 = [
    ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"),
    ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"), ("ten", "10"),
]
# same plus two month spellings (questions, taxonomy)
NUMBER_WORDS_12 = NUMBER_WORDS_10 + [("sept", "september"), ("novemeber", "november")]

ITALIAN_MONTHS = [
    ("gennaio", "january"), ("febbraio", "february"), ("marzo", "march"),
    ("aprile", "april"), ("maggio", "may"), ("giugno", "june"), ("luglio", "july"),
    ("agosto", "august"), ("settembre", "september"), ("ottobre", "october"),
    ("novembre", "november"), ("dicembre", "december"),
]

# number names summed by the relaxed matcher
NUMBER_NAMES = [
    ("zero", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5),
    ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10),
    ("eleven", 11), ("twelve", 12), ("thirteen", 13), ("fourteen", 14),
    ("fifteen", 15), ("sixteen", 16), ("seventeen", 17), ("eighteen", 18),
    ("nineteen", 19), ("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50),
    ("sixty", 60), ("seventy", 70), ("eighty", 80), ("ninety", 90),
    ("hundred", 100), ("thousand", 1000), ("million", 1000000),
    ("billion", 1000000000), ("trillion", 1000000000000),
]

MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]

# ---------------------------------------------------------------------------
# FIXED VALUES: operator keywords (question taxonomy)
# ---------------------------------------------------------------------------

MAX_WORDS = ["max", "maximum", "highest", "most"]
MIN_WORDS = ["min", "minimum", "least", "lowest"]
COUNT_WORDS = ["how many", "frequency", "count"]
SUM_WORDS = ["sum", "add", "total", "aggregate"]
DIFF_WORDS = ["difference", "subtract", "change", "delta", "increase", "decrease"]
AVG_WORDS = ["avg", "average", "mean", "median", "mode", " net ", "fair value"]
COMPARE_WORDS = ["higher", "lower", "more", "less", "bigger", "smaller", "larger", "lesser", "exceed"]
BEFORE_WORDS = ["before", "previous to", "prior to", "preceding", "past", "earlier", "ago ", " last "]
AFTER_WORDS = ["after ", "following", "followed by", "later"]
# 'from.*and' is a pattern, the rest are literal
DURATION_WORDS = ["between", "during", "meanwhile", "how long", "longer", "since", "until", "from.*and"]
ORDINAL_WORDS = ["first", "last ", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth"]

# ---------------------------------------------------------------------------
# FIXED VALUES: yes/no question shapes (each is later wrapped as
# "(in SHAPE )?(did|is|was|were|are|does|has|have).*")
# ---------------------------------------------------------------------------

YES_NO_SHAPES = [
    r"((\d{2}|\d)(/|-)(\d{2}|\d)(/|-)(\d{2})|(\d{4}(/|-)\d{2}))",
    r"(both )*(the )*(year )*(jan(?:uary)|feb(?:ruary)|mar(?:ch)|apr(?:il)|may|jun(?:e)|jul(?:y)|aug(?:ust)|sep(?:tember)|oct(?:ober)|nov(?:ember)|dec(?:ember))*\s*\d{4}",
    r"(\d{2}|\d)*\s*((J|j)an(?:uary)|(F|f)eb(?:ruary)|(M|m)ar(?:ch)|(A|a)pr(?:il)|(M|m)ay|(J|j)un(?:e)|(J|j)ul(?:y)|(A|a)ug(?:ust)|(S|s)ep(?:tember)|(O|o)ct(?:ober)|(N|n)ov(?:ember)|(D|d)ec(?:ember))\s+(\d{4}|\d{2})",
    r"\d(th)*, \d{4}",
    r"\d+(th)* (year|day|week|month|hour|century|second|minute|hour)",
    r"((J|j)an(?:uary)|(F|f)eb(?:ruary)|(M|m)ar(?:ch)|(A|a)pr(?:il)|(M|m)ay|(J|j)un(?:e)|(J|j)ul(?:y)|(A|a)ug(?:ust)|(S|s)ep(?:tember)|(O|o)ct(?:ober)|(N|n)ov(?:ember)|(D|d)ec(?:ember)) \d+(th)*(,|\s)\d+",
    r"\d{4}('s|s)",
    r"(\d{2}|\d|date)(th)*\s*(of|-)*\s*((J|j)an(?:uary)?|(F|f)eb(?:ruary)?|(M|m)ar(?:ch)?|(A|a)pr(?:il)?|(M|m)ay|(J|j)un(?:e)?|(J|j)ul(?:y)?|(A|a)ug(?:ust)?|(S|s)ep(?:tember)?|(O|o)ct(?:ober)?|(N|n)ov(?:ember)?|(D|d)ec(?:ember)?)",
    r"((J|j)an(?:uary)?|(F|f)eb(?:ruary)?|(M|m)ar(?:ch)?|(A|a)pr(?:il)?|(M|m)ay|(J|j)un(?:e)?|(J|j)ul(?:y)?|(A|a)ug(?:ust)?|(S|s)ep(?:tember)?|(O|o)ct(?:ober)?|(N|n)ov(?:ember)?|(D|d)ec(?:ember)?)(-|\s+)(\d)",
    r"((\d+ (winter|summer|autumn|spring))|((summer|winter|autumn|spring) \d+))",
    r"january|february|march|april|may|june|july|august|september|october|november|december",
    r"night|morning|evening|midnight|noon|sunset|afternoon|daylight|winter|summer|autumn|spring",
]
YES_NO_VERBS = r"(did|is|was|were|are|does|has|have).*"
YES_NO_WORDING = r".*(yes or no)|(true/false)|(false/true)|(true or false)|(false or true).*"
YES_NO_CHOICE = r"(.* or .*)|(.*[a-z]/[a-z].*)"
YES_NO_OR_NOT = r".* or( |.* )not.*"
YES_NO_ANSWERS = ["yes", "no", "true", "false"]

# ---------------------------------------------------------------------------
# FIXED VALUES: explicit-time question patterns (taxonomy)
# ---------------------------------------------------------------------------

YEAR_NUMBER0 = r".*(/| |,)*\d{4}('|s|\?| )*.*"
YEAR_NUMBER1 = r"\d{4}('|s)* .*"
MONTH_KEY = r".*(january|february|march|april|may|june|july|august|september|october|november|december) .*"
DAY_KEY = r".*(mon|tues|wednes|thurs|fri|sat|sun)day.*"
DATE_PATTERN = r".*((\d{2}|\d)(/|-)(\d{2}|\d)(/|-)(\d{2})|(\d{4}(/|-)\d{2})).*"
TIME_PATTERN = r".*(\d+|(\d+.\d+))(:(\d+|(\d+.\d+)))+.*"
BC_AD = r".*\d (bc|ad).*"
TIME_KEYWORD0 = r".*(longer|longest|faster|slower|highest|lower|higher|lowest|slowest|fastest|shortest|shorter|what|difference|at the|top|consecutive|least|most|less|more|finish)\s*((between|the|in|was|total|than|amount|of|a|\d+)\s)*\s*time.*"
TIME_KEYWORD1 = r".*time\s*(of|is)*\s*(difference|more|less|more|less|above|below|quicker|faster|slower|( .*\d+.*)).*"
TEMPORAL_KEYWORDS = r".*(decade|season|year|day|week|month|hour|century|minute).*"

EXPLICIT_PATTERNS = [YEAR_NUMBER0, YEAR_NUMBER1, MONTH_KEY, DAY_KEY, DATE_PATTERN,
                     TIME_PATTERN, TIME_KEYWORD0, TIME_KEYWORD1, TEMPORAL_KEYWORDS, BC_AD]

ORDINAL_DIGIT = r".*\d(st|nd|rd|th).*"
ORDINAL_DATE = r".*\d(st|nd|rd|th)(.{1,15}\d{4}| century).*"
ORDINAL_MONTH = r".*(january|february|march|april|may|june|july|august|september|october|november|december).{1,10}\d(st|nd|rd|th).*"
ORDINAL_RANK = r".* rank.*"

# ---------------------------------------------------------------------------
# FIXED VALUES: answer-type patterns (taxonomy)
# ---------------------------------------------------------------------------

_MONTHS_OPT = r"((J|j)an(?:uary)?|(F|f)eb(?:ruary)?|(M|m)ar(?:ch)?|(A|a)pr(?:il)?|(M|m)ay|(J|j)un(?:e)?|(J|j)ul(?:y)?|(A|a)ug(?:ust)?|(S|s)ep(?:tember)?|(O|o)ct(?:ober)?|(N|n)ov(?:ember)?|(D|d)ec(?:ember)?)"
_MONTHS_REQ = r"((J|j)an(?:uary)|(F|f)eb(?:ruary)|(M|m)ar(?:ch)|(A|a)pr(?:il)|(M|m)ay|(J|j)un(?:e)|(J|j)ul(?:y)|(A|a)ug(?:ust)|(S|s)ep(?:tember)|(O|o)ct(?:ober)|(N|n)ov(?:ember)|(D|d)ec(?:ember))"

TA_DATE1 = r".*in (the)*\s*(year)*\s*" + _MONTHS_OPT + r"*\s*\d{4}.*"
TA_DATE3 = r".*(from|between)\s*(the years of)*\s*\d{4}\s*(to|and|-)\s*\d{4}.*"
TA_DATE4 = r".*\d(th)*, \d{4}.*"
TA_DATE7 = r".*(before|after|at the|of|since|as early as) \d{4}.*"
TA_DATE8 = r".*" + _MONTHS_OPT + r" \d+(th)*(,|\s)\d+.*"
TA_DATE9 = r".*\d{4}('s|s).*"
TA_DATE10 = r".*(\d{2}|\d|date)(th)*\s*(of)*\s*" + _MONTHS_OPT + r" .*"
TA_DATE11 = r".*" + _MONTHS_OPT + r"\s+(\d).*"
TA_DATE12 = r".*((\d+ (winter|summer|autumn|spring))|((summer|winter|autumn|spring) \d+)).*"
TA_YEAR = r"(^\s*\d{4}[^\d])|(^\s*\d{4}\s*$)"

TEMPORAL_ANSWER_PATTERNS = [
    TIME_PATTERN, MONTH_KEY, DAY_KEY, TEMPORAL_KEYWORDS, TIME_PATTERN, DATE_PATTERN,
    TA_DATE1, TA_DATE3, TA_DATE4, TA_DATE7, TA_DATE8, TA_DATE9, TA_DATE10, TA_DATE11,
    TA_DATE12, TIME_KEYWORD0, TIME_KEYWORD1,
]
TA_QUESTION_YEAR = r".*((around|in|during|from|at) )?(what|which) ((was|is) the )?((last|first|final|only|release|birth) )?(two )?(olympics )?year.*"
TA_QUESTION_WHEN = r"(when|(what|which) ((youth|winter) )?olympic).*"
TA_QUESTION_SOON = r"how soon.*"

COUNT_HOW_MANY = r".*how many.*"
COUNT_NUMBER_OF = r".*number of.*"
ANY_DIGIT = r".*\d.*"

AGE_QUESTION = r"(((at )?(what|which) ((was|is) (the )?)?age)|(how old)).*"
AGE_SUFFIX = r".* age( of)?\?"

MONEY_SYMBOL = r".*[$|€].*"
MONEY_MAGNITUDE = r".*(trillion|billion|million).*"
MONEY_TOPIC = r".*(import|export|stock|dollar|budget|gross|money|gpd|gdp|revenue|income|cost).*"
MONEY_QUESTION = r"what ((was|is) the )?((annual|nominal|total|operating|estimated|construction) )?(import|export|stock|dollar|budget|gross|money|gpd|gdp|revenue|income|cost)"

PERCENT_QUESTION = r"(what|how much) ((was|is) the )?(difference in )?percent"
PERCENT_ANSWER = r".*%.*"

RANK_WHERE = r".*where.*"
RANK_WORD = r".*rank.*"
RANK_WHAT = r"what (is|was)( the )?.{0,30} rank.*"
RANK_SUFFIX = r".*\d(st|nd|rd|th)( place)?$"
RANK_PLACE = r".*(place|spot).*"

PLACE_QUESTION = r"((on|in|with|against|for) )?(who|which|what) ((was|is) the )?((last|first|modern|present day|defunct|largest|other|(name (of )?the)|two) )?(country|continent|city|cities|countries|province|capital|location)"
PERSON_QUESTION = r"who.*"
ORGANIZATION_QUESTION = r"((on|in|with|against|for) )?(who|which|what) ((was|is) the )?((last|first|second|third|modern|present day|defunct|largest|other|(name (of the)?(of)?(the)?)) )?((two|most recent|youth|national|professional|senior|domestic) )?((year|club) )?.{0,4}(club|team|university|universities|college).*"
PRODUCT_QUESTION = r"(what|which) ((was|is) the )?((last|first|main) )?(medal|color)"

ANSWER_TYPES = ["YES/NO", "TEMPORAL", "COUNT", "AGE", "MONEY", "PERCENTAGE", "ORDINAL",
                "PLACE", "PERSON", "ORGANIZATION", "PRODUCT", "UNKNOWN"]

# ---------------------------------------------------------------------------
# FIXED VALUES: temporal-question predicate
# ---------------------------------------------------------------------------

IT_BEFORE = ["yesterday", "previous to", "prior to", "soon before"]
IT_AFTER = ["tomorrow", "since", "soon after"]
IT_DURING = ["when at the time"]
IT_NOW = [" now", "currently", "at the same time", "daily", "recently", "recent"]
IT_PAST = ["earlier", "in the past"]
IT_BEGIN = ["at the beginning"]
IT_KEYWORDS = IT_BEFORE + IT_AFTER + IT_DURING + IT_NOW + IT_PAST + IT_BEGIN

IT_DATE0 = DATE_PATTERN
IT_DATE1 = r".*in (both )*(the )*(year )*(jan(?:uary)|feb(?:ruary)|mar(?:ch)|apr(?:il)|may|jun(?:e)|jul(?:y)|aug(?:ust)|sep(?:tember)|oct(?:ober)|nov(?:ember)|dec(?:ember))*\s*\d{4}.*"
IT_DATE2 = r"(\d{2}|\d)*\s*" + _MONTHS_REQ + r"\s+(\d{4}|\d{2}).*"
IT_DATE3 = r".*(from|between)\s*((the years of)|(the))*\s*\d{4}\s*(to|and|-)\s*\d{4}.*"
IT_DATE4 = r".*\d(th)*, \d{4}.*"
IT_DATE5 = r".*\d+(th)* (year|day|week|month|hour|century|second|minute|hour).*"
IT_DATE6 = r".*(year|day|week|month|hour|century|second|minute|hour)(s)* \d+.*"
IT_DATE7 = r".*(before|after|at the|of|since|as early as|through|unitl) (\d{4}).*"
IT_DATE15 = r".*(as|of the|from|around|the|for|by) (((18|19)\d{2})|(2\d{3})) .*"
IT_DATE8 = r".*" + _MONTHS_REQ + r" \d+(th)*(,|\s)\d+.*"
IT_DATE9 = r".*\d{4}('s|s).*"
IT_DATE10 = r".*(\d{2}|\d|date)(th)*\s*(of|-)*\s*" + _MONTHS_OPT + r" .*"
IT_DATE11 = r".*" + _MONTHS_OPT + r"(-|\s+)(\d).*"
IT_DATE12 = TA_DATE12
IT_DATE13 = r".*(((around|season|from|to|during|which|until|by|early|late) \d{4}(\?| ))|( \d{4} ((pre-)?season|election))).*"
IT_DATE16 = r".*\d\s*(pm|am).*"
IT_DATE17 = r".*which.* (18|19|20)\d{2}.* (18|19|20)\d{2}.*"
IT_DATE18 = r".*\d{4}-present.*"
IT_MONTHS = r".*(((J|j)anuary)|((F|f)ebruary)|((M|m)arch)|((A|a)pril)|((M|m)ay)|((J|j)une)|((J|j)uly)|((A|a)ugust)|((S|s)eptember)|((O|o)ctober)|((N|n)ovember)|((D|d)ecember)).*"
IT_DAYS = r".*((M|m)onday|(T|t)uesday|(W|w)ednesday|(t|T)hursday|(f|F)riday|(S|s)aturday|(S|s)unday).*"
IT_YEAR0 = r".*(what|which|how many|consecutive).*(decade|season|year|day|week|month|hour|century|second|minute|hour|time).*"
IT_YEAR1 = r".*(same|last|first|this|only|number of|in|per|that|each|more|less)( the)? (decade|season|year|day|week|month|hour|century|second|minute|hour|time).*"
IT_YEAR2 = r".*(decade|season|year|day|week|month|hour|century|second|minute|hour|time)(s)* (before|after).*"
IT_ALBUM = r".*((came\s*(in)*\s*(first|last))|(released\s*(album|single)*\s*(first|last|earliest))|((first|last|earliest)\s*(album|single)*\s*(that was)*\s*released)).*"
IT_FINANCIAL = r".*fiscal \d{4}.*"
# the missing comma after "movie" joins two items into one keyword: kept
IT_PROPER_NOUNS = ["afc", "fifa", "eaff", "eurobasket", "olympic", "fiba",
                   "brazilian football team", "film", "moviebattle", "revenue",
                   "population", "census"]
IT_KEYWORD_TIME = [r".*year.*", r"now( |,).*"]
IT_TIMES_OF_DAY = ["night", "evening", "morning", "midnight", "dawn", "sunrise", "midday",
                   "noon", "sunset", "afternoon", "daylight", "winter", "summer", "autumn", "spring"]
IT_ANSWER_QUESTION = [r"when.*", r".*year.*"]
IT_ANSWER_YEAR = r"\d{4}"

# ---------------------------------------------------------------------------
# FIXED VALUES: answer normalisation (voting)
# ---------------------------------------------------------------------------

STRIP_CHARS = ['"', "~", "#", "%", ">", "+"]
CURRENCY_TOKENS = ["us$", "usd$", "$"]
TRAILING_PAREN = r" (\()(.*)(\))$"
ORDINAL_SUFFIX = r"(\d)(rd|th|st|nd)"
GOLD_UNITS = r"^(almost |over |after |in or before |at age |in the year |at the age of |age |age of |he was )?(\d+)( active)? (gold |bronze |silver )?(goal|vehicle|win|race|episode|single|langley|album|team|hurricane|time|year|month|day|week|month|season|medal|minute|hour|second)(s)?(( ago)|( old)|( longer)|( almost)|( after))?(.)?$"
GOLD_PREFIX = r"^(at least|at the age of |after the age of |nearly |age of )(\d+)$"
ANSWER_UNITS = r"^(over |after |in or before |at age |in the year |at the age of |age |age of |he was )?(\d+)( active)? (gold |bronze |silver )?(episode|single|langley|album|team|hurricane|time|year|month|day|week|month|season|medal|minute|hour|second)(s)?(( ago)|( old)|( longer)|( almost)|( after))?(.)?$"
ALIGN_PREFIX_SUFFIXES = [" ", ",", "-year", "-minute"]
ALIGN_PAREN = r".*(\()(.*)(\))$"

# ---------------------------------------------------------------------------
# FIXED VALUES: relaxed answer matching
# ---------------------------------------------------------------------------

TIME_RE = r"(\d{1,2})(:|.)(\d{2})\s*(AM|PM|am|pm)?"
DDMM_DAY_MONTH = r"(\d{1,2})(?:th|st|nd|rd)?\s+(?:of\s+)?(January|February|March|April|May|June|July|August|September|October|November|December)"
DDMM_DAY_ABBR = r"(\d{1,2})(?:th|st|nd|rd)?\s+(?:of\s+)?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Oct|Nov|Dec)"
DDMM_MONTH_DAY = r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:of\s+)?(\d{1,2})(?:th|st|nd|rd)?"
DDMM_ABBR_DAY = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Oct|Nov|Dec)\s+(?:of\s+)?(\d{1,2})(?:th|st|nd|rd)?"
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# D-M-YYYY inside text (intended form; ISO dates are left as they are)
DMY_DATE = r"\b(0?[1-9]|[12]\d|3[01])[-/](0?[1-9]|1[0-2])[-/](\d{4})\b"

# SQuAD answer normalisation: ASCII punctuation and English articles
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"\b(a|an|the)\b"

# ---------------------------------------------------------------------------
# FIXED VALUES: infobox cleaning
# ---------------------------------------------------------------------------

CLEAN_CHARS = ["\n", "\u00a0", "\u200b", "\u2022"]
COLONS = [":", "\uff1a"]
PIECE_SEP = " | "
FAILED_SENTINELS = ["res", "haa"]
TRIPLE_ENVELOPES = ["knowledge_graph", "edges", "graph", "graphs", "KnowledgeGraph",
                    "knowledgeGraph.nodes", "knowledgeGraph", "triples"]
