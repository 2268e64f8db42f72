"""Word lists and patterns that the text functions share.

Fixed values: results depend on each of them, and on the order of ordered ones.
"""

from __future__ import annotations

QUESTION_STARTERS = ["what", "when", "where", "who", "why", "how", "which", "whose", "can", "could", "would", "should", "will", "do", "does", "did", "is", "are", "was", "were"]
INTERROGATIVES = ["what", "how", "when", "where", "why", "who", "which", "can", "could", "would", "should"]

QUESTION_SIGNS = [
    r"\?$",
    r"^(what|how|when|where|why|who|which|can|could|would|should|is|are|do|does|did)",
    r"^q\d*[:\.]",
    r"^question\s*\d*[:\.]",
    r"^faq\s*\d*[:\.]",
    r"^query\s*\d*[:\.]",
    r"^\d+[️⃣⃣]*[:\.\-\s]+",
]
ANSWER_SIGNS = [r"^a\d*[:\.]", r"^answer\s*\d*[:\.]", r"^response\s*\d*[:\.]", r"^solution\s*\d*[:\.]"]
ANSWER_STARTERS = ["yes", "no", "you can", "you should", "to", "the", "this", "that", "it"]

PLACEHOLDERS = ["todo", "tbd", "placeholder", "example", "sample", "test", "dummy", "lorem", "ipsum", "xxx", "yyy", "zzz", "[placeholder]", "[todo]"]

CATEGORIES = {
    "installation": ["install", "setup", "download", "configure", "installation"],
    "usage": ["how", "use", "using", "usage", "tutorial", "guide"],
    "troubleshooting": ["error", "problem", "issue", "fix", "troubleshoot", "debug"],
    "configuration": ["config", "setting", "configure", "configuration", "customize"],
    "features": ["feature", "capability", "function", "functionality", "what"],
    "api": ["api", "endpoint", "request", "response", "integration"],
    "security": ["security", "authentication", "authorization", "permission", "access"],
    "performance": ["performance", "speed", "optimization", "slow", "fast"],
}

SECTION_CATEGORIES = {
    "onboarding": ["onboarding", "apply", "join"],
    "leave": ["leave", "holiday", "absent", "vacation"],
    "payroll": ["salary", "payment", "payroll", "stipend"],
    "policy": ["policy", "rule", "protocol", "notice"],
    "hierarchy": ["hierarchy", "report", "manager", "senior"],
    "sales": ["sales", "lead", "client"],
    "technical": ["domain", "portal", "system", "error", "bot"],
}
AUDIENCES = {
    "intern": ["intern", "internship", "trainee"],
    "sales_internal": ["sales", "lead", "deal"],
    "applicant": ["apply", "applicant", "vacancy"],
    "full_time": ["full-time", "employee", "staff"],
}
#: Intent, the words that show it, and whether only the question is searched for them.
ENTRY_INTENTS = [
    ("process", ["how", "process", "steps", "procedure"], True),
    ("reason", ["why", "reason"], True),
    ("policy", ["rule", "policy", "must", "required"], False),
    ("reporting", ["who", "whom", "contact"], True),
]
CONDITIONS = {"urgent": ["urgent", "emergency", "immediate"], "3_months_plus": ["3 month", "three month"], "violation": ["unauthorized", "violation"]}

POSITIVE = ["good", "great", "excellent", "helpful", "accurate", "fast", "perfect", "love", "amazing"]
NEGATIVE = ["bad", "terrible", "wrong", "slow", "useless", "hate", "awful", "poor", "disappointing"]
PRAISE = {"performance_praise": ["fast", "quick", "speed"], "accuracy_praise": ["accurate", "correct", "right"]}
COMPLAINTS = {"performance_complaint": ["slow", "timeout", "wait"], "accuracy_complaint": ["wrong", "incorrect", "bad"], "usability_complaint": ["confusing", "unclear", "hard"]}
THEME_STOP = ["this", "that", "with", "from", "they", "were", "been", "have", "will"]

QUERY_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was",
    "will", "with", "i", "me", "my", "you", "your", "we", "our", "they", "their", "this", "these", "those", "but", "or", "if", "then", "so", "can",
    "could", "should", "would",
]
MATCHER_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "i", "you", "he", "she", "it", "we",
    "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "that", "these", "those",
]
EXTRACT_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "i", "you", "he", "she",
    "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
]
SUFFIXES = ["ation", "tion", "sion", "ment", "ness", "ing", "est", "ity", "ies", "ed", "er", "ly", "s"]

SYNONYMS = {
    "internship": ["intern", "training", "trainee", "placement"],
    "terminate": ["termination", "terminated", "end", "exit", "leave", "quit", "resign", "fired", "removal"],
    "leave": ["leaves", "absence", "vacation", "off", "day off", "time off"],
    "apply": ["application", "applying", "register", "join", "enroll", "signup"],
    "stipend": ["payment", "salary", "pay", "paid", "money", "compensation", "allowance"],
    "certificate": ["certification", "certificated", "letter", "document", "proof"],
    "placement": ["job", "offer", "ppo", "employment", "hire", "hired"],
    "duration": ["length", "period", "time", "months", "weeks", "long"],
    "hours": ["timing", "schedule", "shift", "time", "working"],
    "meeting": ["meetings", "session", "call", "club"],
    "deadline": ["deadlines", "due", "submission", "submit"],
    "report": ["reporting", "reports", "hierarchy", "manager", "head"],
    "policy": ["policies", "rules", "guidelines", "conduct"],
    "domain": ["domains", "department", "role", "field", "area"],
    "project": ["projects", "work", "task", "assignment"],
    "verification": ["verify", "verified", "portal", "check"],
    "planner": ["plan", "planning", "schedule", "calendar"],
    "login": ["sign in", "log in", "access", "enter", "authenticate"],
    "password": ["pass", "pwd", "passcode", "secret", "credentials"],
    "account": ["profile", "user", "member", "registration"],
    "error": ["problem", "issue", "bug", "trouble", "fault", "failure"],
    "broken": ["not working", "failed", "down", "offline", "unavailable"],
    "help": ["assistance", "support", "aid", "guidance", "tutorial"],
    "contact": ["reach", "get in touch", "communicate", "call", "email"],
    "support": ["help desk", "customer service", "assistance", "hr"],
}

#: Question types in the order they are tried, and the patterns that show them.
QUESTION_TYPES = {
    "what": r"\bwhat\s+(is|are|does|do|can|should|would|will|about|if|kind|type)\b",
    "how": r"\bhow\s+(do|can|to|does|should|would|will|much|many|long|often)\b",
    "where": r"\bwhere\s+(is|are|can|do|should|would|will)\b",
    "when": r"\bwhen\s+(is|are|can|do|should|would|will|did)\b",
    "who": r"\bwho\s+(is|are|can|should|would|will|did)\b",
    "why": r"\bwhy\s+(is|are|can|do|should|would|will|did)\b",
    "which": r"\bwhich\s+(is|are|one|ones|should|would|will)\b",
    "yes_no": r"\b(is\s+it|are\s+they|can\s+i|can\s+you|should\s+i|would\s+it|will\s+it|does\s+it|do\s+you|did\s+you)\b",
}

INTENT_SEEDS = {
    "what": {"information": 0.7, "definition": 0.6},
    "which": {"information": 0.7, "definition": 0.6},
    "how": {"instruction": 0.8, "method": 0.7},
    "where": {"location": 0.8},
    "when": {"time": 0.8},
    "who": {"person": 0.8},
    "why": {"reason": 0.8},
    "yes_no": {"confirmation": 0.7},
}
INTENT_WORDS = {
    "help": ["help", "assist", "support", "guide", "aid", "advice", "guidance", "stuck", "confused", "lost", "need help", "can you help"],
    "problem": ["problem", "issue", "error", "bug", "broken", "not working", "failed", "trouble", "difficulty", "wrong", "incorrect", "fix", "repair", "solve", "resolve", "troubleshoot"],
    "instruction": ["how to", "step by step", "instructions", "guide", "tutorial", "walkthrough", "procedure", "process", "method", "way to", "show me", "teach me", "explain how"],
    "information": ["information", "details", "about", "regarding", "concerning", "tell me", "know about", "learn about", "find out", "discover"],
    "definition": ["what is", "what are", "define", "definition", "meaning", "means", "explain", "description", "clarify", "understand"],
    "comparison": ["compare", "comparison", "difference", "differences", "versus", "vs", "better", "best", "worse", "worst", "which is", "pros and cons", "advantages", "disadvantages"],
    "confirmation": ["confirm", "verify", "check", "make sure", "is it true", "correct", "right", "accurate", "valid", "confirm that"],
}

ENTITIES = {
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"],
    "phone": [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\(\d{3}\)\s*\d{3}[-.]?\d{4}\b"],
    "url": [r"https?://[^\s]+", r"www\.[^\s]+"],
    "money": [r"\$\d+(?:\.\d{2})?", r"\b\d+\s*dollars?\b", r"\b\d+\s*cents?\b"],
    "date": [r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b"],
    "time": [r"\b\d{1,2}:\d{2}(?:\s*[AP]M)?\b"],
    "number": [r"\b\d+\b"],
}
MODIFIERS = {
    "urgent": [r"\burgent\b", r"\basap\b", r"\bimmediately\b", r"\bquickly\b", r"\bright now\b", r"\bemergency\b", r"\bhelp\b.*\bnow\b"],
    "polite": [r"\bplease\b", r"\bthank you\b", r"\bthanks\b", r"\bkindly\b", r"\bwould you\b", r"\bcould you\b", r"\bif you could\b"],
    "uncertain": [r"\bmaybe\b", r"\bperhaps\b", r"\bi think\b", r"\bi guess\b", r"\bnot sure\b", r"\bunsure\b", r"\bmight be\b"],
}

#: Rewrites of informal grammar, applied in this order; $n are groups.
INFORMAL = [
    (r"\b(need|want|looking for|find)\s+(\w+)", "$1 a $2"),
    (r"\b(have|got)\s+(problem|issue|question)\s+with\s+(\w+)", "$1 a $2 with $3"),
    (r"\b(you|i|we|they)\s+(going|coming|working|trying)", "$1 are $2"),
    (r"\b(it|this|that)\s+(working|broken|good|bad)", "$1 is $2"),
    (r"^(what|how|where|when|who|why)\s+about\s+(.+)", "$1 is $2"),
    (r"^(tell me|show me)\s+about\s+(.+)", "what is $2"),
    (r"\b(this|that|it)\s+(good|bad|working|broken|available|possible)", "$1 is $2"),
    (r"\b(you|we|they)\s+(sure|certain|ready|available)", "$1 are $2"),
    (r"\bhow come\b", "why"),
    (r"\bwanna\b", "want to"),
    (r"\bgonna\b", "going to"),
    (r"\bkinda\b", "kind of"),
    (r"\bsorta\b", "sort of"),
    (r"\b(help)\s+(me)\s+(\w+)", "$1 $2 with $3"),
    (r"\b(tell)\s+(me)\s+(\w+)", "$1 $2 about $3"),
]
FRAGMENT_QUESTIONS = ["what", "how", "where", "when", "who", "why", "which", "can", "is", "are", "do", "does", "did", "will", "would", "could", "should", "may", "might"]
CONTRACTIONS = [
    (r"^(whats|what's)\b", "what is"),
    (r"^(hows|how's)\b", "how is"),
    (r"^(wheres|where's)\b", "where is"),
    (r"^(whens|when's)\b", "when is"),
    (r"^(whos|who's)\b", "who is"),
    (r"^(whys|why's)\b", "why is"),
    (r"\b(dont|don't)\b", "do not"),
    (r"\b(cant|can't)\b", "cannot"),
    (r"\b(wont|won't)\b", "will not"),
    (r"\b(isnt|isn't)\b", "is not"),
    (r"\b(arent|aren't)\b", "are not"),
]

#: Known typos and what they stand for.
TYPOS = {
    "teh": "the", "adn": "and", "nad": "and", "hte": "the", "taht": "that", "thta": "that", "waht": "what", "hwat": "what", "wnat": "want",
    "whne": "when", "wehn": "when", "whre": "where", "wher": "where", "whihc": "which", "whcih": "which", "wich": "which", "recieve": "receive",
    "recive": "receive", "seperate": "separate", "definately": "definitely", "occured": "occurred", "occurance": "occurrence",
    "accomodate": "accommodate", "begining": "beginning", "beleive": "believe", "calender": "calendar", "cemetary": "cemetery",
    "changable": "changeable", "collegue": "colleague", "comming": "coming", "commited": "committed", "concious": "conscious",
    "definite": "definite", "dilemna": "dilemma", "embarass": "embarrass", "enviroment": "environment", "existance": "existence",
    "experiance": "experience", "familar": "familiar", "finaly": "finally", "foriegn": "foreign", "freind": "friend", "goverment": "government",
    "grammer": "grammar", "harrass": "harass", "independant": "independent", "intrest": "interest", "knowlege": "knowledge", "lenght": "length",
    "liason": "liaison", "libary": "library", "maintainance": "maintenance", "neccessary": "necessary", "occassion": "occasion",
    "perseverence": "perseverance", "posession": "possession", "prefered": "preferred", "priviledge": "privilege", "publically": "publicly",
    "reccomend": "recommend", "refered": "referred", "relevent": "relevant", "resistence": "resistance", "seperation": "separation",
    "succesful": "successful", "supress": "suppress", "tommorow": "tomorrow", "truely": "truly", "untill": "until", "usefull": "useful",
    "wierd": "weird", "dont": "don't", "doesnt": "doesn't", "cant": "can't", "wont": "won't", "isnt": "isn't", "arent": "aren't", "wasnt": "wasn't",
    "werent": "weren't", "hasnt": "hasn't", "havent": "haven't", "hadnt": "hadn't", "shouldnt": "shouldn't", "wouldnt": "wouldn't",
    "couldnt": "couldn't", "mustnt": "mustn't", "neednt": "needn't", "darent": "daren't", "u": "you", "ur": "your", "youre": "you're",
    "theres": "there's", "theyre": "they're", "its": "it's", "hes": "he's", "shes": "she's", "weve": "we've", "youve": "you've", "theyve": "they've",
    "ive": "I've", "im": "I'm", "id": "I'd", "ill": "I'll", "wed": "we'd", "youd": "you'd", "theyd": "they'd", "shed": "she'd", "hed": "he'd",
}

#: Common words, question words and patterns of each language, in the order in which ties are decided.
LANGUAGES = {
    "en": {
        "common": [
            "the", "and", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "what",
            "how", "where", "when", "who", "why", "which", "that", "this", "these", "those", "with", "for", "from", "about",
        ],
        "asking": ["what", "how", "where", "when", "who", "why", "which"],
        "patterns": [r"\b(ing|ed|ly|tion|sion)\b", r"\b(a|an|the)\s+\w+"],
    },
    "es": {
        "common": [
            "el", "la", "los", "las", "un", "una", "y", "es", "son", "está", "están", "ser", "estar", "tener", "hacer", "poder", "deber", "qué",
            "cómo", "dónde", "cuándo", "quién", "cuál", "que", "con", "para", "por", "de", "en", "sobre",
        ],
        "asking": ["qué", "cómo", "dónde", "cuándo", "quién", "cuál"],
        "patterns": [r"\b(ción|sión|mente|ando|iendo)\b", r"\b(el|la|los|las)\s+\w+"],
    },
    "fr": {
        "common": [
            "le", "la", "les", "un", "une", "des", "et", "est", "sont", "être", "avoir", "faire", "pouvoir", "devoir", "aller", "venir", "que",
            "quoi", "comment", "où", "quand", "qui", "pourquoi", "avec", "pour", "par", "de", "dans", "sur", "sous",
        ],
        "asking": ["que", "quoi", "comment", "où", "quand", "qui", "pourquoi"],
        "patterns": [r"\b(tion|sion|ment|ant|ent)\b", r"\b(le|la|les)\s+\w+"],
    },
    "de": {
        "common": [
            "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "und", "ist", "sind", "war", "waren", "haben", "hat", "hatte", "was",
            "wie", "wo", "wann", "wer", "warum", "welche", "welcher", "mit", "für", "von", "zu", "in", "auf", "über", "unter",
        ],
        "asking": ["was", "wie", "wo", "wann", "wer", "warum", "welche"],
        "patterns": [r"\b(ung|keit|heit|lich|isch)\b", r"\b(der|die|das)\s+\w+"],
    },
    "it": {
        "common": [
            "il", "la", "lo", "gli", "le", "un", "una", "e", "è", "sono", "essere", "avere", "fare", "potere", "dovere", "andare", "che", "cosa",
            "come", "dove", "quando", "chi", "perché", "con", "per", "da", "di", "in", "su", "sotto",
        ],
        "asking": ["che", "cosa", "come", "dove", "quando", "chi", "perché"],
        "patterns": [r"\b(zione|sione|mente|ando|endo)\b", r"\b(il|la|lo)\s+\w+"],
    },
    "pt": {
        "common": [
            "o", "a", "os", "as", "um", "uma", "e", "é", "são", "está", "estão", "ser", "estar", "ter", "fazer", "poder", "dever", "que", "como",
            "onde", "quando", "quem", "com", "para", "por", "de", "em", "sobre", "sob",
        ],
        "asking": ["que", "como", "onde", "quando", "quem"],
        "patterns": [r"\b(ção|são|mente|ando|endo)\b", r"\b(o|a|os|as)\s+\w+"],
    },
}
SCRIPTS = {"ru": r"[а-яёА-ЯЁ]", "zh": r"[一-鿿]", "ja": r"[぀-ゟ゠-ヿ]", "ko": r"[가-힯]", "ar": r"[؀-ۿ]"}

PRONOUNS = ["it", "this", "that", "they", "them", "these", "those"]
ASKING = ["what", "how", "where", "when", "who", "why", "which"]
CONJUNCTIONS = ["and", "or", "but"]
CONTEXT_PHRASES = ["like before", "as mentioned", "the same", "similar to", "like that", "like this", "as usual", "again"]
VAGUE = ["thing", "stuff", "issue", "problem", "matter", "situation", "something", "anything", "everything", "nothing"]

# Forms that a query is varied in, by intent, and casual ones; {} stands for the query.
TEMPLATES = {
    "instruction": ["how to {}", "steps to {}", "instructions for {}", "guide to {}", "tutorial on {}", "way to {}"],
    "definition": ["what is {}", "define {}", "meaning of {}", "explanation of {}", "{} definition", "what does {} mean"],
    "problem": ["fix {}", "solve {}", "troubleshoot {}", "resolve {}", "repair {}", "{} not working"],
    "information": ["information about {}", "details about {}", "learn about {}", "find out about {}", "{} information", "tell me about {}"],
    "help": ["help with {}", "assistance with {}", "support for {}", "guidance on {}", "need help with {}"],
    "comparison": ["compare {}", "difference between {}", "{} vs", "{} comparison", "which is better {}"],
}
CASUAL = ["help me {}", "i need to {}", "how do i {}", "can you {}", "show me how to {}", "i want to know about {}", "tell me about {}"]
FOLLOW_UP = ["also", "too", "additionally", "furthermore", "moreover", "what about", "how about", "and", "plus", "besides"]
CONTINUED = ["continue", "more", "next", "then", "after", "following"]
REFERENCES = ["it", "this", "that", "they", "them", "these", "those", "above", "previous", "earlier", "before"]
QUERY_CATEGORIES = {"leave": ["leave"], "payroll": ["payroll", "salary"], "policy": ["policy"]}

# The shorter set of grammar rewrites, in its order; $n are groups.
PLAIN_GRAMMAR = [
    (r"\b(need|want|looking for)\s+(\w+)", "$1 a $2"),
    (r"\b(you|i|we|they)\s+(going|coming|working)", "$1 are $2"),
    (r"^(what|how|where|when|who|why)\s+about\s+", "$1 is "),
    (r"\b(this|that|it)\s+(good|bad|working|broken)", "$1 is $2"),
]
ASKING_ANYWHERE = ["what", "how", "where", "when", "who", "why", "can", "is", "are", "do", "does"]
