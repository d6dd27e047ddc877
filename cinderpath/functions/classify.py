"""Classification of texts and questions as columns: domain, intent, question type, complexity, mentions, named patterns, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import entities

# Keywords of domains, in order; the first of the best wins.
DOMAINS = {
    "security": ("보안", "취약점", "해킹", "공격", "방어", "암호", "인증", "권한", "침입", "악성코드", "랜섬웨어", "피싱", "CVE", "레드팀", "블루팀", "침투테스트", "SIEM", "SOC",
                 "security", "vulnerability", "attack", "defense", "encryption", "authentication", "malware", "ransomware", "phishing", "penetration", "CVE", "red team", "blue team", "SIEM", "SOC", "threat", "exploit", "firewall", "IDS", "IPS"),
    "finance": ("금융", "투자", "주식", "채권", "펀드", "은행", "대출", "이자", "수익률", "리스크", "finance", "investment", "stock", "bond", "fund", "bank", "loan", "interest", "return", "risk", "portfolio", "trading", "market", "asset", "equity"),
    "medical": ("의료", "질병", "치료", "진단", "증상", "약물", "환자", "수술", "병원", "medical", "disease", "treatment", "diagnosis", "symptom", "drug", "patient", "surgery", "hospital", "clinical", "therapy", "pharmaceutical"),
    "legal": ("법률", "판례", "소송", "계약", "규정", "조항", "재판", "변호사", "법원", "legal", "law", "case", "contract", "regulation", "statute", "court", "attorney", "litigation", "jurisdiction", "precedent", "compliance"),
    "tech": ("기술", "소프트웨어", "프로그래밍", "API", "서버", "클라우드", "데이터베이스", "네트워크", "technology", "software", "programming", "API", "server", "cloud", "database", "network", "system", "framework", "architecture", "deployment", "kubernetes"),
    "academic": ("연구", "논문", "학술", "이론", "실험", "방법론", "분석", "결과", "research", "paper", "academic", "theory", "experiment", "methodology", "analysis", "study", "findings", "hypothesis", "peer review"),
}

# Patterns of intents, of whole questions in lower case.
INTENTS = {
    "GREETING": (r"^안녕[하세요]*[?!]*$", r"^안뇽[?!]*$", r"^하이[?!]*$", r"^헬로[?!]*$", r"^반가워[요]?[?!]*$", r"^처음 뵙겠습니다[?!\.]*$", r"^좋은 ?(아침|오후|저녁)[이에요요]*[?!\.]*$",
                 r"^h(i|ello|ey)[?!\.]*$", r"^good ?(morning|afternoon|evening|night)[?!\.]*$", r"^greetings?[?!\.]*$", r"^what'?s? ?up[?!\.]*$", r"^how are you[?!\.]*$", r"^howdy[?!\.]*$"),
    "SMALL_TALK": (r"^뭐해[요]?[?]*$", r"^뭐하고 ?있어[요]?[?]*$", r"^잘 ?지내[요]?[?]*$", r"^오늘 ?날씨[는가]?[?]*$", r"^심심해[요]?[?]*$", r"^배고파[요]?[?]*$", r"^how'?s? ?it ?going[?]*$", r"^what'?s? ?new[?]*$", r"^how'?s? ?your ?day[?]*$"),
    "SYSTEM": (r"^너는? ?누구[야니]?[?]*$", r"^넌? ?뭐야[?]*$", r"^뭘? ?할 ?수 ?있어[?]*$", r"^어떻게 ?사용해[?]*$", r"^도움말[?!\.]*$", r"^who ?are ?you[?]*$", r"^what ?are ?you[?]*$", r"^what ?can ?you ?do[?]*$", r"^help[?!\.]*$", r"^how ?do ?i ?use[?]*$"),
}

# Patterns of question types, in the order in which they are tried; then parts of texts of the types after them.
DEFINITION = (r"what is\s+(?:a|an|the)?\s*\w+", r"^define\b", r"definition of\b", r"explain what\b", r"describe what\b", r"란\s*(?:무엇|뭐)", r"이란\s*(?:무엇|뭐)", r"정의(?:는|가|를)", r"개념(?:은|이)", r"무엇(?:인가|입니까|인지|이야)", r"뭐(?:야|예요|인가요)")
FACTS = ("capital of", "name of", "수도는", "이름은")
PROCEDURE = (r"how (?:do|can|to|should)\s+(?:i|we|you)", r"steps (?:to|for)\b", r"process (?:of|for)\b", r"way to\b", r"method (?:to|for|of)\b", r"guide (?:to|for)\b", r"tutorial\b", r"instruction", r"어떻게\s+(?:하|만들|설정|사용|구현)", r"방법(?:은|이|을)", r"절차(?:는|가)", r"과정(?:은|이)", r"하는\s*(?:법|방법)", r"만드는\s*(?:법|방법)")
CAUSE = (r"^why\b", r"why (?:is|are|does|do|did|was|were)\b", r"what (?:causes|caused|leads to|led to)\b", r"reason (?:for|why|behind)\b", r"because of what\b", r"due to what\b", r"result in\b", r"consequence of\b", r"^왜\b", r"왜\s+(?:그런|이런|저런)", r"이유(?:는|가|를)", r"원인(?:은|이|을)", r"때문(?:에|인지)", r"결과(?:로|는)")
LIST = (r"^list\b", r"enumerate\b", r"what are (?:the|some|all)\s+(?:types|kinds|examples)", r"give (?:me\s+)?(?:some\s+)?examples of\b", r"types of\b", r"kinds of\b", r"categories of\b", r"나열", r"종류(?:는|가|를)", r"유형(?:은|이|을)", r"예(?:시|를)\s*(?:들어|줘)", r"목록")
NARRATIVE = (r"explain\s+(?:in\s+detail|how|why|the)", r"describe\s+(?:in\s+detail|how|the)", r"elaborate\b", r"discuss\b", r"analyze\b", r"analyse\b", r"what do you think\b", r"your opinion\b", r"assessment of\b", r"설명(?:해|하다|해\s*줘)", r"분석(?:해|하다)", r"자세히", r"상세(?:히|하게)")
OPINIONS = ("think", "opinion", "believe", "view", "perspective", "생각", "의견", "견해", "평가")
YESNO = ("is ", "are ", "was ", "were ", "does ", "do ", "did ", "can ", "could ", "will ", "would ", "has ", "have ", "had ", "인가요", "입니까", "맞나요", "인지", "할까요")
BOTH = ("both", "같이", "둘 다", "either")
COMPARISON = ("compare", "difference", "similar", "versus", "vs", "between", "better", "worse", "more", "less", "같은", "다른", "차이", "비교", "어느 것이", "which one")
MULTIHOP = ("who also", "which also", "that also", "where did .* work", "what did .* do after", "who was .* 's", "who is .* 's", "the .* of the .* of", "in which .* did", "born in the same", "worked with", "collaborated", "와/과 함께", "의 .* 의", "어디서", "누구와", "그 후에", "이전에")
BRIDGE = ("what connects", "how is .* related to", "relationship between", "link between", "connection", "연결", "관계", "연관")
AGGREGATION = ("how many", "how much", "count", "total", "all", "list all", "what are all", "몇 개", "얼마나", "모든", "전부")

# Words that show several concepts; words that begin questions; names of kinds of things.
LINKING = ("and", "또한", "그리고", "관계", "relationship", "between", "compared to", "비교", "차이", "통해", "through")
STARTERS = ("What", "Who", "Where", "When", "How", "Why", "Which", "Find", "Show", "List", "Get", "Tell", "Give", "The", "This", "That", "These", "Those")
NAMED = (
    ("TECHNOLOGY", r"\b(Python|Java|JavaScript|TypeScript|C\+\+|C#|Ruby|Go|Rust|Kotlin|Swift|PHP|Scala|R|MATLAB)\b"),
    ("TECHNOLOGY", r"\b(React|Angular|Vue|Django|Flask|FastAPI|Spring|Node\.js|Express|Rails|Laravel)\b"),
    ("TECHNOLOGY", r"\b(MySQL|PostgreSQL|MongoDB|Redis|Neo4j|Elasticsearch|DynamoDB|Cassandra|SQLite)\b"),
    ("TECHNOLOGY", r"\b(AWS|Azure|GCP|Docker|Kubernetes|Terraform|Jenkins|GitHub|GitLab|CircleCI)\b"),
    ("TECHNOLOGY", r"\b(TensorFlow|PyTorch|Keras|scikit-learn|OpenAI|GPT-\d|Claude|LangChain|HuggingFace)\b"),
    ("ORGANIZATION", r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc\.|Corp\.|LLC|Ltd\.|Co\.|Group|Holdings|Partners))\b"),
    ("ORGANIZATION", r"\b(Google|Microsoft|Apple|Amazon|Meta|Facebook|Netflix|Tesla|Nvidia|Intel|AMD|IBM|Oracle|Salesforce)\b"),
    ("ORGANIZATION", r"\b((?:University of\s+)?[A-Z][a-zA-Z]+(?:\s+(?:University|Institute|College)))\b"),
    ("CONCEPT", r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Theory|Method|Algorithm|Pattern|Framework|Architecture|Protocol|Model))\b"),
    ("CONCEPT", r"\b((?:Agile|Scrum|Kanban|DevOps|CI/CD|TDD|BDD|DDD|SOLID|REST|GraphQL|gRPC))\b"),
    ("DATE", r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"),
    ("DATE", r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"),
    ("DATE", r"\b(Q[1-4]\s+\d{4})\b"),
    ("DATE", r"\b(FY\s*\d{4})\b"),
    ("METRIC", r"\b(\d+(?:\.\d+)?%)\b"),
    ("METRIC", r"\b(\$\d+(?:\.\d+)?(?:M|B|K|million|billion)?)\b"),
    ("METRIC", r"\b(\d+(?:\.\d+)?\s*(?:GB|MB|TB|KB|ms|sec|min|hr|days?))\b"),
)
SECRETS = ("password", "api_key", "secret", "token", "authorization", "apikey", "api-key", "bearer", "credential", "private_key")
FORMATS = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json", "jsonl": "json", "csv": "csv", "xml": "xml", "yaml": "yaml", "yml": "yaml", "pdf": "pdf", "docx": "docx"}


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def _has(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w.lower())).cast("int") for w in words))


def domain(text: Column) -> Column:
    """(domain, confidence): that of the most keywords, two at least, else general with 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = F.array(*(F.struct(_hits(low, words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("domain"), F.lit(max(len(words) * 0.3, 1.0)).alias("base")) for i, (name, words) in enumerate(DOMAINS.items())))
    best = F.array_max(rows)
    return F.when(best["hits"] < 2, F.struct(F.lit("general").alias("domain"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(best["domain"].alias("domain"), F.least(F.lit(1.0), best["hits"] / best["base"]).alias("confidence")))


def intent(question: Column) -> Column:
    low = F.lower(F.trim(question))
    out = None
    for name, patterns in INTENTS.items():
        out = F.when(_any(low, patterns), name) if out is None else out.when(_any(low, patterns), name)
    return out.otherwise("KNOWLEDGE")


def question_type(question: Column) -> Column:
    """The first type whose rule holds; factoid if none does."""
    q = F.lower(question)
    return (
        F.when(_any(q, DEFINITION) & ~_has(q, FACTS), "definition")
        .when(_any(q, PROCEDURE), "procedure")
        .when(_any(q, CAUSE), "cause_effect")
        .when(_any(q, LIST), "list")
        .when(_any(q, NARRATIVE), F.when(_has(q, OPINIONS), "opinion").otherwise("narrative"))
        .when(_has(q, YESNO), F.when(_has(q, BOTH), "comparison").otherwise("yesno"))
        .when(_has(q, COMPARISON), "comparison")
        .when(_has(q, MULTIHOP), "multihop")
        .when(_has(q, BRIDGE), "bridge")
        .when(_has(q, AGGREGATION), "aggregation")
        .otherwise("factoid")
    )


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def concepts(question: Column) -> Column:
    """Distinct capitalised words, Hangul before a particle, quoted terms and acronyms."""
    return F.array_distinct(F.concat(_all(question, r"\b[A-Z][a-zA-Z]+\b", 0), _all(question, "[가-힣]+(?=[은는이가을를])", 0), _all(question, "[\"']([^\"']+)[\"']"), _all(question, r"\b[A-Z]{2,}(?:-\d+)*\b", 0)))


def complexity(question: Column) -> Column:
    """simple, moderate, complex or multi_hop by the number of concepts; two linking words make it one step harder."""
    n = F.size(concepts(question))
    level = F.when(n <= 1, 0).when(n <= 3, 1).when(n <= 5, 2).otherwise(3)
    level = F.least(F.lit(3), level + F.when(_hits(F.lower(question), LINKING) >= 2, 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ("simple", "moderate", "complex", "multi_hop"))), level + 1)


def mentions(question: Column) -> Column:
    """Distinct quoted strings, and phrases of up to four capitalised words that aren't mere question words."""
    phrases = F.array_except(_all(question, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"), F.array(*map(F.lit, STARTERS)))
    return F.array_distinct(F.concat(_all(question, '"([^"]+)"'), _all(question, "'([^']+)'"), phrases))


def named(text: Column) -> Column:
    """(kind, text) of all matches of the named patterns; of equal texts, whatever their case, the first kind's."""
    def each(kind: str, pattern: str) -> Column:
        return F.transform(_all(text, pattern, 0), lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(m).alias("text")))

    found = F.concat(*(each(kind, p) for kind, p in NAMED))
    lower = F.transform(found, lambda x: F.lower(x["text"]))
    return F.filter(found, lambda x, i: F.array_position(lower, F.lower(x["text"])) == i + 1)


def answer(text: Column, kind: str) -> Column:
    """(score, answer) for an expected person, organization, location or date; 0.5 for a text with any entity, 0 for one without."""
    names = _all(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")
    every = entities(text)
    got = lambda score, value: F.struct(F.lit(score).alias("score"), value.alias("answer"))
    none, general = got(0.0, F.lit(None).cast("string")), got(0.5, F.get(every, F.lit(0)))
    if kind == "organization":
        firm = F.filter(every, lambda e: _has(e, ("inc", "corp", "ltd", "llc", "fc", "club", "team")))
        rule = F.when(F.size(firm) > 0, got(1.0, F.get(firm, F.lit(0)))).when(F.size(names) > 0, got(0.7, F.get(names, F.lit(0))))
    else:
        found, score = {
            "person": (names, 1.0), "location": (_all(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 0.8), "date": (_all(text, r"\b(\d{4}|\w+\s+\d{1,2},?\s+\d{4})\b"), 1.0),
        }[kind]
        rule = F.when(F.size(found) > 0, got(score, F.get(found, F.lit(0))))
    return F.when(F.size(every) == 0, none).otherwise(F.coalesce(rule, general))


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.coalesce(known[suffix], F.lit("unknown"))


def escape_search(text: Column) -> Column:
    """The text with a backslash before each special character of the search syntax."""
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def censored(values: Column) -> Column:
    """A map with the values of secret keys hidden."""
    return F.transform_values(values, lambda k, v: F.when(_has(F.lower(k), SECRETS), "***REDACTED***").otherwise(v))
