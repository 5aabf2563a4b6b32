"""What a text is about, as column expressions: topics, families, facets, visual intent.  A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import normalize_text

# Patterns of market sources, matched in any case.
MARKET_PAPER = "market|economic|adoption|pricing|serving cost"
ACRONYM = r"\brdkv\b|rdk[^\n]video"
ACRONYM_TOPIC = r"kv[\s_-]*cache|rate[^\n]distortion|\bllm\b|language model|quantization|attention"
BROAD = r"inference|data[^\n]?cent[er]+|memory|server|GPU|accelerator|추론|메모리|데이터센터"
DIRECT = (
    r"kv[\s_-]*cache|key[\s_-]*value[\s_-]*cache|\bcxl\b|compute express link|photonic[^\n]{0,30}memory|llm[^\n]{0,30}(memory|inference)"
    r"|ai[\s_-]+(server|infrastructure|accelerator)|추론[^\n]{0,15}(메모리|인프라)|인공지능[^\n]{0,10}서버"
)
# Patterns of technology families.
KV_CACHE = r"\b(?:kv|key[\s_-]*value)[\s_-]*caches?\b|kv\s*캐시|키[\s-]*값\s*캐시"
SW_METHOD = r"\b(?:quanti[sz]\w*|compress\w*|evict\w*)\b|양자화|압축|삭제|제거"
INTERCONNECT = r"\bcxl\b|\bphotonic\w*\b|광학|광자"
AI_CONTEXT = r"\b(?:llms?|ai|inference|large[\s_-]+language[\s_-]+models?)\b|인공지능|추론|언어\s*모델"
MEMORY = r"\b(?:memory|dram|hbm)\b|메모리"
MEMORY_OPERATION = r"\b(?:expand\w*|expansion|extend\w*|extension|pool\w*|offload\w*|disaggregat\w*|tier\w*)\b|확장|풀링|오프로딩|분리|계층"
ARXIV_ID = r"(?<![\d.])\d{4}\.\d{4,5}(?!\d)"
# Words that speak of a criterion, and hosts of the makers themselves.
CRITERION_TERMS = {
    "market_size_growth": ("market size", "forecast", "billion", "cagr", "시장", "growth"),
    "commercialization": ("product", "license", "release", "available", "implementation", "제품", "commercial"),
    "adoption": ("customer", "production", "deploy", "pilot", "고객", "adopt"),
    "ecosystem_support": ("support", "integration", "compatible", "framework", "지원"),
    "standardization": ("standard", "cxl", "pcie", "specification", "표준"),
    "business_value": ("cost", "memory", "efficiency", "price", "비용", "latency"),
}
FIRST_PARTY = ("github.com", "docs.vllm.ai", "marvell.com", "www.marvell.com", "computeexpresslink.org")
# Patterns of questions that a table or figure answers.
VISUAL_REFERENCE = r"\b(table|fig(?:ure)?\.?|chart|diagram)\s*(?:no\.?\s*)?([0-9]+|[ivxlcdm]+)\b|(표|그림|도표)\s*([0-9]+|[ivxlcdm]+)"
VISUAL_CUE = r"\b(?:table|fig(?:ure)?\.?|chart|diagram)\b|표|그림|도표"
NUMBER = r"(?<![\w.+-])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*(?:%|×|x|ki?b|mi?b|gi?b|ti?b|ms|ns|us|k|m|g|t|s))?(?![a-z])"
NUMERIC_QUESTION = r"\b(?:how\s+(?:many|much)|by\s+what|what|which|compare)\b|몇|얼마|어느|비교"
NUMERIC_METRIC = (
    r"\b(?:number|numeric|value|percent(?:age)?|ratio|rate|range|speedups?|latenc(?:y|ies)|throughput|bandwidth|capacity|memory|tokens?"
    r"|batch(?:\s+size)?|context(?:\s+length)?|overhead|accuracy|scores?|time|bytes?)\b"
    "|수치|값|범위|백분율|퍼센트|배속|지연|처리량|대역폭|용량|메모리|토큰|배치|컨텍스트|오버헤드|정확도|점수|시간"
)
LEXICAL_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*|[가-힣]{2,}"
STOP_WORDS = tuple("""
a an and are at between by compare compared does for from how in is many much number numeric of on or paper percent percentage
range ranges report reported result results show shown the to value values versus vs what which with 그림 도표 보고 비교 수치 어느 얼마 결과
""".split())  # Fixed values: words that do not make a question lexical.
# Terms of facets; limitations come before scope.
FACETS = {
    "limitations": (
        "limitation", "constraint", "failure case", "future work", "pending validation", "pending physical", "physical validation",
        "reproduc", "generaliz", "not validated", "unverified", "한계", "제약", "실패", "재현", "일반화", "미검증",
    ),
    "scope": (
        "scope", "operating condition", "applicable", "target task", "domain", "modality", "evaluated setting", "dataset", "workload",
        "범위", "조건", "대상", "도메인", "모달리티", "데이터셋", "워크로드",
    ),
}
# Marks of a topic that asks for a whole table, and of one that is about the form of evidence ids.
EXHAUSTIVE = (
    "complete per budget", "complete per row", "every row", "full row", "all row", "per row range", "row level condition",
    "task by method", "method task result",
)
ID_FORMAT = ("evidence-id", "evidence id", "근거 id")
EFFECT = r"reduc\w*|sav\w*|capacity|latency|throughput|speedup|절감|절약|용량|지연"  # Fixed value.


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def has(x: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, letters and digits of every script counting as such."""
    return F.regexp_like(_text(x), F.lit("(?iU)" + pattern))


def contains_any(x: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(x, F.lit(term))
    return found


def host(url: Column) -> Column:
    """Lower-case host, empty where there is none."""
    return F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def joined(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", _text(title), _text(content))


def market_candidate(approach: Column, name: Column, url: Column, title: Column, content: Column, level: Column) -> Column:
    """Whether a search hit may be fetched: papers that do not name the technology have to speak of a market, hits of the
    acronym of a software technology of its topic; from level 1 on broad words do, else a direct pattern."""
    text = joined(title, content)
    foreign = (host(url) == "arxiv.org") & ~F.contains(F.lower(text), F.lower(_text(name)))
    return (
        F.when(foreign, has(text, MARKET_PAPER))
        .when((_text(approach) == "SW") & has(text, ACRONYM), has(text, ACRONYM_TOPIC))
        .otherwise(((F.coalesce(level, F.lit(0)) >= 1) & has(text, BROAD)) | has(text, DIRECT))
    )


def family_matches(kind: Column, x: Column) -> Column:
    """SW: the cache and a method; HW: interconnect, memory, operation, and the cache or a model."""
    software = has(x, KV_CACHE) & has(x, SW_METHOD)
    hardware = has(x, INTERCONNECT) & has(x, MEMORY) & has(x, MEMORY_OPERATION) & (has(x, KV_CACHE) | has(x, AI_CONTEXT))
    kind = F.upper(_text(kind))
    return F.when(kind == "SW", software).when(kind == "HW", hardware).otherwise(F.lit(False))


def _unquoted(x: Column) -> Column:
    """Percent signs decoded; a text that is not decodable stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(_text(x), F.lit("+"), F.lit("%2B"))), _text(x))


def same_paper(a: Column, b: Column) -> Column:
    """Two URLs of one paper: a shared arXiv number, or equal host, with port and user, and path."""
    ids = [F.regexp_extract_all(_unquoted(u), F.lit(ARXIV_ID), F.lit(0)) for u in (a, b)]
    place = [F.rtrim(F.regexp_extract(_unquoted(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/")) for u in (a, b)]
    site = [F.lower(F.regexp_extract(F.trim(_text(u)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)) for u in (a, b)]
    whole = (site[0] != "") & (F.regexp_extract(_text(a), r"://[^/?#]*(/)", 1) != "") & (site[0] == site[1]) & (place[0] == place[1])
    return F.arrays_overlap(*ids) | whole


def family_candidate(kind: Column, name: Column, paper_url: Column, url: Column, title: Column, snippet: Column) -> Column:
    """Whether a hit names the technology or is of its family, and is not the given paper itself."""
    text = F.lower(_unquoted(F.concat_ws(" ", _text(title), _text(url), _text(snippet))))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(_unquoted(x)), r"(?U)[\W_]+", " "))
    padded, wanted = F.concat(F.lit(" "), plain(text), F.lit(" ")), plain(name)
    named = (wanted != "") & F.contains(padded, F.concat(F.lit(" "), wanted, F.lit(" ")))
    short = F.array_contains(F.split(wanted, " "), "rdkv") & has(text, r"\brdkv\b")
    photonic = F.contains(wanted, F.lit("photonic cxl")) & F.contains(padded, F.lit(" photonic cxl "))
    return ~same_paper(paper_url, url) & (named | short | photonic | family_matches(kind, text))


def source_available(verified: Column, how: Column, same_hash: Column, run_status: Column, original_id: Column, quote_matched: Column, collector: Column) -> Column:
    """Verified, or inherited from a successful run over the same file, or collected with a matching quote."""
    given = lambda x: _text(x.cast("string")) != ""
    inherited = (how == "inherited_source_record") & same_hash & (run_status == "succeeded") & given(original_id)
    collected = (how == "collected_excerpt") & quote_matched & given(collector)
    return F.coalesce(verified, F.lit(False)) | F.coalesce(inherited, F.lit(False)) | F.coalesce(collected, F.lit(False))


def visual_intent(x: Column) -> Column:
    """Whether a query names a table or figure, has a number, has a visual cue beside another word, or asks for a metric."""
    words = F.regexp_extract_all(_text(x), F.lit(LEXICAL_TOKEN), F.lit(0))
    lexical = F.exists(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return has(x, VISUAL_REFERENCE) | has(x, NUMBER) | (has(x, VISUAL_CUE) & lexical) | (has(x, NUMERIC_QUESTION) & has(x, NUMERIC_METRIC))


def topic_facet(x: Column) -> Column:
    """Limitations, scope, or else the overview."""
    plain = F.replace(F.lower(_text(x)), F.lit("_"), F.lit(" "))
    facet = F.lit("technical_overview")
    for name, terms in reversed(FACETS.items()):
        facet = F.when(contains_any(plain, terms), F.lit(name)).otherwise(facet)
    return facet


def set_aside_topic(x: Column) -> Column:
    """Topics that ask for all rows of an Arabic table 1, or comment on the form of evidence ids."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(_text(x)), F.lit("-"), F.lit(" ")), r"(?U)\s+", " "))
    comment = contains_any(F.replace(F.lower(_text(x)), F.lit("_"), F.lit(" ")), ID_FORMAT)
    return (has(x, r"\btable\s+1\b") & contains_any(plain, EXHAUSTIVE)) | comment


def title_line(x: Column) -> Column:
    """Of the first twelve lines that are not blank, the first of 8 to 300 characters; null if none."""
    lines = F.filter(F.transform(F.split(_text(x), r"\r\n|[\n\r]"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    return F.get(F.filter(F.slice(lines, 1, 12), lambda s: F.length(s).between(8, 300)), F.lit(0))


def abstract_part(x: Column) -> Column:
    """What stands between the word abstract and the introduction, normalised, 8,000 characters at most; null if nothing."""
    part = F.regexp_extract(_text(x), r"(?is)\babstract\b\s*[:—-]?\s*(.+?)(?=\n\s*(?:1\.?\s+)?introduction\b)", 1)
    part = normalize_text(part)
    return F.when(part != "", F.substring(part, 1, 8000))


def relevance_score(x: Column, name: Column, criteria: tuple[str, ...]) -> Column:
    """12 for the name, 2 for each topical word up to 8, 3 for each term of a criterion."""
    low = F.lower(_text(x))
    topical = 2 * F.regexp_count(low, F.lit(r"(?U)kv[\s_-]*cache|\bcxl\b|photonic|llm|메모리"))
    score = F.when(F.contains(low, F.lower(_text(name))), 12).otherwise(0) + F.least(topical, F.lit(8))
    for criterion in criteria:
        for term in CRITERION_TERMS[criterion]:
            score = score + F.when(F.contains(low, F.lit(term)), 3).otherwise(0)
    return score


def effect_count(x: Column) -> Column:
    """Words of an effect on resources."""
    return F.regexp_count(_text(x), F.lit("(?iU)" + EFFECT))


# Marks of a text that speaks of the extraction and not of its subject.
META_ALWAYS = ("required critical topic", "previous draft json")
META_INVALID = ("invalid", "malformed", "unknown evidence", "유효하지", "형식 오류", "id 오류")
META_PROCESS = ("extract", "generate", "response", "output", "수정 필요", "추출", "생성", "입력")
# Marks of metrics that compare, a capacity that is called a baseline, and words of a possibility.
COMPARATIVE = ("ratio", "speedup", "improvement", "reduction", "gap", "versus", "relative")
CAPACITY_BASELINE = r"(?<![A-Za-z0-9])(\d+(?:\.\d+)?\s*(?:KB|MB|GB|TB|PB))(?:\s+[A-Za-z][A-Za-z0-9_-]*){0,3}\s+baseline\b"
HEDGED = r"\b(could|may|might|potential(?:ly)?|expected|plans? to)\b|가능성"


def about_extraction(x: Column) -> Column:
    """Whether a text reports invalid evidence ids of an extraction, or names the draft's own parts."""
    plain = F.trim(F.regexp_replace(F.lower(_text(x)), r"(?U)\s+", " "))
    plain = F.translate(plain, "_-", "  ")
    about_ids = F.regexp_like(plain, F.lit(r"(?U)\bevidence\s*id(?![a-z0-9])|근거\s*id"))
    return contains_any(plain, META_ALWAYS) | (about_ids & contains_any(plain, META_INVALID) & contains_any(plain, META_PROCESS))


def stated_baseline(metric: Column, workload: Column, baseline: Column) -> Column:
    """``baseline``, or the capacity that the workload itself calls one where the metric does not compare."""
    capacity = F.regexp_extract(_text(workload), "(?i)" + CAPACITY_BASELINE, 1)
    replaced = ~contains_any(F.lower(_text(metric)), COMPARATIVE) & (capacity != "")
    return F.when(replaced, F.concat(capacity, F.lit(" baseline"))).otherwise(baseline)
