"""Fixed values that results depend on: patterns, word lists and look-up tables, in natural order."""

# Statute names and the patterns (ignoring case) that name them; the first match wins,
# and "Delimitation" must precede "Limitation", which it contains.
ACT_PATTERNS = [
    (r"\bBNS\b|Bharatiya\s+Nyaya\s+Sanhita", "Bharatiya Nyaya Sanhita"),
    (r"\bIPC\b|Indian\s+Penal\s+Code", "Indian Penal Code"),
    (r"\bCPC\b|Code\s+of\s+Civil\s+Procedure", "Code of Civil Procedure"),
    (r"\bCrPC\b|Code\s+of\s+Criminal\s+Procedure", "Code of Criminal Procedure"),
    (r"\bBNSS\b|Bharatiya\s+Nagarik\s+Suraksha\s+Sanhita", "Bharatiya Nagarik Suraksha Sanhita"),
    (r"\bBSA\b|Bharatiya\s+Sakshya\s+Adhiniyam", "Bharatiya Sakshya Adhiniyam"),
    (r"Indian\s+Contract\s+Act", "Indian Contract Act"),
    (r"Arbitration\s+and\s+Conciliation\s+Act", "Arbitration and Conciliation Act"),
    (r"Consumer\s+Protection\s+Act", "Consumer Protection Act"),
    (r"Specific\s+Relief\s+Act", "Specific Relief Act"),
    (r"Transfer\s+of\s+Property\s+Act", "Transfer of Property Act"),
    (r"Motor\s+Vehicles\s+Act", "Motor Vehicles Act"),
    (r"Indian\s+Succession\s+Act", "Indian Succession Act"),
    (r"Hindu\s+Marriage\s+Act", "Hindu Marriage Act"),
    (r"\bDivorce\s+Act\b|Indian\s+Divorce\s+Act", "Indian Divorce Act"),
    (r"Hindu\s+Minority\s+and\s+Guardianship\s+Act", "Hindu Minority and Guardianship Act"),
    (r"Hindu\s+Adoptions\s+and\s+Maintenance\s+Act", "Hindu Adoptions and Maintenance Act"),
    (r"Delimitation\s+Act", "Delimitation Act"),
    (r"Limitation\s+Act", "Limitation Act"),
    (r"Constitution\s+of\s+India", "Constitution of India"),
    (r"\bRTI\b|Right\s+to\s+Information\s+Act", "Right to Information Act"),
    (r"Protection\s+of\s+Women\s+from\s+Domestic\s+Violence\s+Act", "Protection of Women from Domestic Violence Act"),
]

# Question words and function words that carry no topic.
STOPWORDS = (
    "what which who whom whose why how when where is are was were be been being do does did can could would should will may might "
    "tell explain define meaning overview summary about the a an and or of to for in on at by with from"
).split()

# Substrings of questions that ask for an overview.
OVERVIEW_CUES = [
    "overview", "summary", "general", "introduction", "explain", "what is", "describe", "elaborate", "tell me about", "about",
    "outline", "guide", "background", "understand", "meaning", "definition", "scope", "purpose", "key features", "main points",
]

# Substrings of the sections that outline a statute.
OUTLINE_CUES = [
    "short title", "extent", "commencement", "application", "definitions", "interpretation", "contract", "agreement",
    "consideration", "proposal", "acceptance", "competent", "free consent", "void", "voidable", "unlawful", "performance",
    "breach", "damages", "compensation", "remedy", "indemnity", "guarantee",
]

# What speaks for the substance of a question and what for mere procedure.
SUBSTANCE_CUES = ["whether", "entitled", "right", "disability", "scribe", "reasonable accommodation", "examination", "candidate"]
PROCEDURE_CUES = ["high court", "appeal", "dismiss", "justified", "procedural", "jurisdiction"]

# Tags of a question and the substrings of which any one sets them.
TAG_CUES = {
    "contract_clause": ["contract", "agreement", "clause", "terms", "offer letter", "bond"],
    "contract_concepts": [
        "consideration", "offer", "acceptance", "proposal", "free consent", "coercion", "undue influence", "misrepresentation",
        "breach of contract", "damages", "compensation for breach", "indemnity", "guarantee",
    ],
    "non_compete": [
        "non compete", "non-compete", "noncompete", "competitor", "same industry", "restraint of trade", "cant work",
        "cannot work", "work for another company", "join another company",
    ],
    "penalty_or_bond": ["bond", "penalty", "liquidated", "damages", "forfeit", "forfeiture"],
    "restraint_legal_proceedings": [
        "sue", "lawsuit", "legal proceedings", "cannot go to court", "no court", "cannot sue", "no legal action", "no claim",
        "no claims", "cannot file case", "time limit to sue", "time limit to file", "waive", "waiver",
    ],
    "arbitration": ["arbitration", "arbitral", "arbitrator", "arbitrable"],
    "limitation": ["limitation", "time barred", "time-barred", "barred by limitation"],
    "evidence": [
        "evidence", "admissible", "admissibility", "burden of proof", "presumption", "witness", "testimony",
        "cross examination", "cross-examination", "affidavit", "documentary evidence", "primary evidence",
        "secondary evidence", "electronic record", "relevancy", "relevance",
    ],
    "civil_procedure": [
        "cpc", "code of civil procedure", "civil procedure", "suit", "plaint", "written statement", "summons", "injunction",
        "stay", "decree", "execution", "appeal", "revision", "jurisdiction", "interim order",
    ],
    "criminal": [
        "bns", "ipc", "criminal", "crime", "offence", "offense", "fir", "police", "arrest", "bail", "chargesheet",
        "charge sheet", "charge-sheet", "punishment", "imprisonment", "fine", "theft", "cheating", "fraud", "forgery",
        "assault", "murder", "homicide", "kidnapping", "extortion",
    ],
    "marriage": [
        "marriage", "hindu marriage", "hindu marriage act", "hma", "restitution of conjugal rights", "conjugal rights",
        "judicial separation", "annulment", "bigamy",
    ],
    "divorce": ["divorce", "dissolution", "alimony", "indian divorce act"],
    "delimitation": ["delimitation", "constituency", "constituencies", "electoral boundaries"],
    "consumer": ["refund", "replacement", "defect", "defective", "deficiency", "consumer", "unfair trade", "warranty"],
    "property": ["property", "sale deed", "gift deed", "lease", "rent", "tenant", "landlord", "mortgage"],
    "motor_vehicle": ["motor vehicle", "vehicle accident", "road accident", "driving licence", "driving license", "insurance claim"],
    "guardianship": ["guardian", "guardianship", "minor custody"],
    "adoption_maintenance": ["adoption", "maintenance"],
    "succession": ["succession", "inheritance", "will", "probate"],
    "specific_relief": ["specific performance", "injunction"],
}

# Tags set when a substring of each group occurs.
TAG_PAIRS = [
    ("penalty_or_bond", ["training", "service bond"], ["pay", "recover", "recovery", "deduct", "amount", "cost"]),
    ("penalty_or_bond", ["leave before", "resign", "notice period"], ["pay", "recover", "deduct", "penalty", "bond"]),
]

# Sources that answer a tag.
TAG_SOURCES = {
    "contract_clause": ["Indian Contract Act 1872.md"],
    "contract_concepts": ["Indian Contract Act 1872.md"],
    "non_compete": ["Indian Contract Act 1872.md"],
    "penalty_or_bond": ["Indian Contract Act 1872.md"],
    "restraint_legal_proceedings": ["Indian Contract Act 1872.md"],
    "arbitration": ["Arbitration and Conciliation Act 1996.md"],
    "limitation": ["Limitation Act 1963.md", "Indian Contract Act 1872.md"],
    "evidence": ["bsa_final.md", "indiaCodeBSA.pdf"],
    "criminal": ["the-bharatiya-nyaya-sanhita-2023-485731.pdf", "BNS2023.pdf", "BNS Book_After Correction.pdf"],
    "civil_procedure": ["cpc.json", "the_code_of_civil_procedure,_1908.pdf", "Civil-Procedure-Code-and-Limitation-Act.pdf"],
    "consumer": ["Consumer Protection Act 2019.md", "Consumer Protection Act 1986.md"],
    "property": ["Transfer of Property Act 1882.md"],
    "motor_vehicle": ["Motor Vehicles Act 1988.md"],
    "guardianship": ["Hindu Minority and Guardianship Act 1956.md"],
    "adoption_maintenance": ["Hindu Adoptions and Maintenance Act 1956.md"],
    "succession": ["Indian Succession Act 1925.md"],
    "specific_relief": ["Specific Relief Act 1963.md"],
    "marriage": ["hma.json"],
    "divorce": ["ida.json", "hma.json"],
    "delimitation": ["Delimitation Act 2002.md"],
}

# Sections that answer a tag.
TAG_SECTIONS = {
    "non_compete": {"Indian Contract Act 1872.md": ["27"]},
    "penalty_or_bond": {"Indian Contract Act 1872.md": ["73", "74"]},
    "restraint_legal_proceedings": {"Indian Contract Act 1872.md": ["28"]},
    "arbitration": {"Arbitration and Conciliation Act 1996.md": ["7"]},
}

# Questions that stand for a tag, in the order in which variants are tried.
TAG_ANCHORS = [
    ("non_compete", "section 27 agreement in restraint of trade void indian contract act 1872"),
    ("non_compete", "agreement in restraint of trade void section 27"),
    ("contract_concepts", "indian contract act 1872 consideration offer acceptance free consent coercion undue influence misrepresentation breach damages"),
    ("penalty_or_bond", "section 74 penalty stipulated compensation breach contract indian contract act 1872"),
    ("penalty_or_bond", "section 73 compensation for breach of contract indian contract act 1872"),
    ("restraint_legal_proceedings", "section 28 agreements in restraint of legal proceedings void indian contract act 1872"),
    ("restraint_legal_proceedings", "contract clause time limit to sue void section 28"),
    ("arbitration", "section 7 arbitration agreement arbitration and conciliation act 1996"),
    ("arbitration", "arbitration clause in a contract section 7"),
    ("limitation", "limitation act 1963 time barred period of limitation"),
    ("limitation", "barred by limitation limitation act 1963"),
    ("consumer", "consumer protection act 2019 defect deficiency unfair trade practice"),
    ("consumer", "consumer refund replacement warranty deficiency"),
    ("property", "transfer of property act 1882 lease rent mortgage sale gift"),
    ("motor_vehicle", "motor vehicles act 1988 accident compensation insurance"),
    ("guardianship", "hindu minority and guardianship act 1956 guardian minor custody"),
    ("adoption_maintenance", "hindu adoptions and maintenance act 1956 adoption maintenance"),
    ("succession", "indian succession act 1925 will probate succession inheritance"),
    ("specific_relief", "specific relief act 1963 specific performance injunction"),
    ("civil_procedure", "code of civil procedure cpc suit plaint written statement decree execution injunction"),
    ("civil_procedure", "cpc order rule decree execution"),
    ("evidence", "bharatiya sakshya adhiniyam 2023 evidence admissibility relevancy burden of proof"),
    ("evidence", "relevancy of facts bharatiya sakshya adhiniyam 2023"),
    ("criminal", "bharatiya nyaya sanhita bns offence punishment imprisonment fine"),
    ("criminal", "bns section punishment for offence"),
    ("marriage", "hindu marriage act 1955 marriage judicial separation restitution of conjugal rights"),
    ("divorce", "divorce act 1869 dissolution of marriage grounds"),
    ("delimitation", "delimitation act 2002 delimitation of constituencies"),
]

# Terms and what else they are called, in the order in which variants are tried.
SYNONYMS = {
    "punishment": ["penalty", "sentence", "imprisonment"],
    "offence": ["offense", "crime", "criminal act"],
    "section": ["article", "provision", "clause"],
    "act": ["law", "statute", "legislation"],
    "court": ["tribunal", "judicial body"],
    "judgment": ["verdict", "ruling", "decision", "holding"],
    "culpable homicide": ["murder", "killing", "manslaughter"],
    "bns": ["bharatiya nyaya sanhita", "indian penal code"],
    "ipc": ["indian penal code", "penal code"],
    "right": ["privilege", "entitlement", "liberty"],
    "liability": ["responsibility", "legal obligation"],
    "non compete": ["non-compete", "restraint of trade"],
    "non-compete": ["non compete", "restraint of trade"],
    "noncompete": ["non compete", "restraint of trade"],
    "cant work": ["cannot work", "restraint of trade"],
    "cannot work": ["cant work", "restraint of trade"],
    "same industry": ["restraint of trade", "trade restriction"],
    "bond": ["penalty", "liquidated damages", "compensation for breach"],
    "liquidated damages": ["penalty", "compensation for breach"],
    "sue": ["legal proceedings", "court"],
    "lawsuit": ["legal proceedings", "court"],
    "evidence": ["sakshya", "bharatiya sakshya adhiniyam", "relevancy of facts"],
    "admissible": ["admissibility", "relevant", "relevancy"],
    "burden": ["burden of proof"],
    "injunction": ["temporary injunction", "interim order"],
    "decree": ["execution of decree"],
    "divorce": ["dissolution of marriage", "judicial separation", "alimony"],
}

# Substrings of questions whether a clause holds, and of those that have a clause in view.
ENFORCEABLE_CUES = ["allowed", "legal", "valid", "enforceable", "binding", "void", "illegal", "can they", "can i"]
CLAUSE_CUES = ["contract", "agreement", "clause", "terms", "bond", "offer letter", "sign"]
CLAUSE_TAGS = ["non_compete", "penalty_or_bond", "restraint_legal_proceedings", "arbitration"]

# Abbreviations in questions, and the words of file names that they stand for.
NAME_EXPANSIONS = [
    (["bns"], ["bharatiya", "nyaya", "sanhita"]),
    (["cpc"], ["civil", "procedure"]),
    (["hma"], ["hindu", "marriage"]),
    (["ida"], ["divorce"]),
    (["bsa"], ["bharatiya", "sakshya", "adhiniyam"]),
    (["sakshya"], ["bharatiya", "sakshya", "adhiniyam"]),
    (["evidence"], ["bharatiya", "sakshya", "adhiniyam"]),
    (["bharatiya", "nyaya", "sanhita"], ["bns"]),
    (["bharatiya", "sakshya", "adhiniyam"], ["bsa"]),
    (["civil", "procedure"], ["cpc"]),
    (["hindu", "marriage"], ["hma"]),
    (["divorce", "act"], ["ida"]),
]

# Sizes, overlaps and separators of the three splitters.
SPLITTERS = {
    "section": (1600, 150, ["\n\nSection", "\n\n", "\n", ". ", " "]),
    "qa": (1200, 150, ["\n\nQuestion:", "\n\nAnswer:", "\n\n", "\n", ". "]),
    "md": (1400, 150, ["\n# ", "\n## ", "\n\nSection", "\n\n", "\n", ". ", " "]),
}
