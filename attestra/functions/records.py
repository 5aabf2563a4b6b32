"""Rules on single records as column expressions: dates, quantities, criteria, locators, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.quantities import exact

# Date formats after the ISO one, in the order in which they are tried.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy.M.d", "yyyy년 M월 d일")
# Factors of scale words, and names of currencies.
SCALES = {
    "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12,
    "천": 10**3, "만": 10**4, "백만": 10**6, "억": 10**8, "조": 10**12,
}
CURRENCIES = {"USD": ("usd", "$", "dollar", "dollars", "us dollar", "us dollars"), "EUR": ("eur", "€", "euro", "euros"), "KRW": ("krw", "₩")}
SENTINELS = ("미표기", "미확인", "unknown", "none", "n/a", "없음")
# What a quote has to speak of, by criterion.
QUOTE_PATTERNS = {
    "market_size_growth": "market|revenue|production|forecast|growth|cagr|시장|매출|생산량",
    "commercialization": "product|commercial|launch|releas|licen[cs]e|available|repository|github|제품|출시|라이선스",
    "adoption": "customer|production|deployed|adopted|uses? |using |고객|도입|운영",
    "ecosystem_support": "support|integrat|compatib|framework|library|runtime|interoperab|지원|통합",
    "standardization": "standard|specification|consortium|ieee|jedec|표준|규격",
    "business_value": (
        "cost|price|memory efficiency|energy efficiency|latency|throughput|speedup|speed[^\n]up|footprint|reduc[^\n]{0,45}memory"
        "|memory[^\n]{0,45}(reduc|sav|capac|utiliz)|utilization|energy|비용|메모리[^\n]{0,20}절약"
    ),
}
# Criteria that related evidence may support on a condition, with the caveat to state.
CONDITIONAL = {
    "market_size_growth": "관련 시장의 규모·성장 신호이며 선정 기술의 매출·점유율·TAM을 입증하지 않음",
    "ecosystem_support": "관련 기술군의 지원 경로이며 선정 구현의 플러그인·커널·인터페이스 호환성 검증 필요",
    "standardization": "활용 가능한 관련 규격이며 선정 구현의 규격 준수·인증을 입증하지 않음",
    "business_value": "기술 효과가 고객 비용 절감으로 이어지는지는 워크로드·품질·통합비·운영비 검증 필요",
}
WORDS_SET_ASIDE = ("the", "and", "with", "from", "that", "this", "result", "results")  # Fixed values.
KINDS = {"text": 0, "caption": 1, "table": 2, "figure": 3, "chart": 3, "diagram": 3}  # Fixed values: order on a page.


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key`` in a fixed table; null where it has none."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def normalized_date(x: Column) -> Column:
    """The day of an ISO date or time (with or without hyphens, or by week), a mail date (the day it names), or one of the
    formats, months in any case; null for anything else."""
    x = F.trim(x)
    titled = F.initcap(x)
    mail = F.regexp_extract(titled, r"^(?:[A-Za-z]{3}, )?([0-9]{1,2} [A-Za-z]{3} [0-9]{4}) [0-9]{2}:[0-9]{2}", 1)
    day = lambda text, form: F.try_to_timestamp(text, F.lit(form)).cast("date")
    iso = day(F.regexp_extract(x, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})($|[T ])", 1), "yyyy-MM-dd")
    basic = day(F.regexp_extract(x, r"^([0-9]{8})($|T)", 1), "yyyyMMdd")
    part = lambda k: F.regexp_extract(x, r"^([0-9]{4})(?:-W([0-9]{2})(?:-([1-7]))?|W([0-9]{2})([1-7])?)($|T)", k)
    year, week = part(1).try_cast("int"), F.concat(part(2), part(4)).try_cast("int")
    weekday = F.coalesce(F.concat(part(3), part(5)).try_cast("int"), F.lit(1))
    # the fourth of January is in week 1; a week 53 that a year lacks is in another year
    found = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7 + weekday - 1)
    by_week = F.when((week > 0) & (F.extract(F.lit("YEAROFWEEK"), found) == year), found)
    return F.coalesce(iso, basic, by_week, day(mail, "d MMM yyyy"), *[day(titled, form) for form in DATE_FORMATS])


def scaled_quantities(x: Column) -> Column:
    """Distinct numbers of a text times their scale word, ascending, as digits and a power of ten: 1.5 million is 15e5.

    A number follows no letter or digit; commas are dropped.  Numbers of any length are exact.  A text without numbers, or
    null, gives an empty array."""
    number, word = r"[0-9][0-9,]*(?:\.[0-9]+)?", "|".join(sorted(SCALES, key=len, reverse=True))
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"(?i)(?:^|[^A-Za-z0-9])({number}(?:\\s*(?:{word}))?)"), F.lit(1))

    def value(token):
        digits = F.regexp_replace(F.regexp_extract(token, f"^({number})", 1), ",", "")
        power = F.coalesce(lookup({w: len(str(f)) - 1 for w, f in SCALES.items()}, F.lower(F.regexp_replace(token, f"^{number}\\s*", ""))), F.lit(0))
        return exact(digits, power)

    def ordered(v):
        """The place of the first digit, then the digits."""
        digits = F.substring_index(v, "e", 1)
        return F.struct(F.when(v != "0", F.length(digits) + F.substring_index(v, "e", -1).cast("int")).alias("place"), digits.alias("digits"), v.alias("v"))

    distinct = F.array_distinct(F.transform(found, value))
    return F.transform(F.array_sort(F.transform(distinct, ordered)), lambda x: x["v"])


def currency(x: Column) -> Column:
    """The code of a currency's name or sign; null for others."""
    return lookup({name: code for code, names in CURRENCIES.items() for name in names}, F.lower(F.trim(x)))


def scale(x: Column) -> Column:
    """The factor of the first English scale word of the list that the text holds, else 1."""
    words = [(w, f) for w, f in SCALES.items() if w.isascii()]
    return F.coalesce(*[F.when(x.rlike(f"(?i)\\b{w}\\b"), F.lit(f)) for w, f in words], F.lit(1)).cast("long")


def dimension(x: Column) -> Column:
    """count, percent or null."""
    return F.when(x.rlike(r"(?i)\b(units?|modules?)\b"), "count").when(x.contains("%") | x.rlike(r"(?i)\bpercent\b"), "percent")


def blank_missing(x: Column) -> Column:
    """The text without white space at its ends; null and words that stand for a missing value become empty."""
    x = F.coalesce(F.trim(x), F.lit(""))
    return F.when(F.lower(x).isin(*SENTINELS), F.lit("")).otherwise(x)


def relevant_criteria(x: Column) -> Column:
    """Criteria whose words a text holds, in the order of the list, two misleading phrases set aside."""
    plain = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "no cost to efficiency", "")
    masked = F.regexp_replace(plain, "hardware[- ]supported(?: bit[- ]widths)?", "")
    hits = [F.when((masked if name == "ecosystem_support" else plain).rlike(pattern), F.lit(name)) for name, pattern in QUOTE_PATTERNS.items()]
    return F.array_compact(F.array(*hits))


def assessment_eligible(relation: Column, criterion: Column) -> Column:
    """Evidence of the technology itself, or of a related one for a conditional criterion."""
    return F.coalesce((relation == "exact") | criterion.isin(*CONDITIONAL), F.lit(False))


def conditional_scope(relation: Column, criterion: Column) -> Column:
    """(scope, caveat) to state with a conditional assessment; the caveat is null for other criteria."""
    kind = F.when(relation == "method_family", "관련 기술군").otherwise("인접 시장")
    return F.struct(F.concat(kind, F.lit(" 근거에 따른 조건부 평가")).alias("scope"), lookup(CONDITIONAL, criterion).alias("caveat"))


def cell_suffix(row: Column, column: Column) -> Column:
    return F.format_string("cell-r%02d-c%02d", row, column)


def aggregate_suffix(whole: Column, rows: Column, chunk_id: Column) -> Column:
    """Names a table (``whole``), the data rows of a group (row 0 is the header), or else the chunk."""
    data = F.filter(rows, lambda r: r > 0)
    span = F.format_string("rows-r%02d-r%02d", F.array_min(data), F.array_max(data))
    return F.when(whole, "whole").when(F.size(data) > 0, span).otherwise(F.concat(F.lit("rows-"), F.substring(chunk_id, 1, 12)))


def evidence_method(mode: Column, hardware: Column) -> Column:
    """How a result came about; a measurement on named accelerators is an experiment on them."""
    gpu = F.coalesce(hardware, F.lit("")).rlike("(?i)GPU|[AH][12]00|RTX|CUDA")
    known = lookup({"emulated": "emulation", "simulated": "simulation", "analytical": "analysis"}, mode)
    return F.when(mode == "measured", F.when(gpu, "gpu_experiment").otherwise("measurement")).otherwise(F.coalesce(known, F.lit("unknown")))


def lexical_words(x: Column) -> Column:
    """Distinct Latin words of three characters and more, lower case, no marks at their ends, without stop words, sorted."""
    words = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_.+/-]{2,}"), F.lit(0))
    # a word begins with a letter, so marks are at its end only
    bare = F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit("._+/-")))
    return F.array_sort(F.array_except(bare, F.array(*map(F.lit, ("", *WORDS_SET_ASIDE)))))


def kind_order(x: Column) -> Column:
    return F.coalesce(lookup(KINDS, x), F.lit(9))
