"""Text functions as column expressions; what only Python can do is in arrow.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grades import col

#: Personal-data patterns, in the order in which they are applied, and their marks.
PII = (
    ("rrn", r"(?<!\d)\d{6}[- ]?[1-4]\d{6}(?!\d)", "[RRN]"),
    ("frn", r"(?<!\d)\d{6}[- ]?[5-8]\d{6}(?!\d)", "[FRN]"),
    ("corp_reg", r"(?<!\d)\d{6}-\d{7}(?!\d)", "[CORPNO]"),
    ("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "[CARD]"),
    ("phone_mobile", r"\b01[016789]-?\d{3,4}-?\d{4}\b", "[PHONE]"),
    ("phone_land", r"\b0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])-\d{3,4}-\d{4}\b", "[PHONE]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("passport_kr", r"\b[MHS]\d{8}\b", "[PASSPORT]"),
    ("ipv4", r"(?<!\d)(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?!\d)", "[IP]"),
    ("employee_id", r"\b(?:사번|직원번호|EMP|emp)[\s:#]*\d{5,10}\b", "[EMP]"),
)
#: Business numbers with a separator (those without need a fitting check digit), and the weights of the first nine digits.
BUSINESS = r"(?<!\d)(?:\d{3}[- ]\d{2}[- ]?\d{5}|\d{5}[- ]\d{5})(?!\d)"
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
#: Numbers with units, led by up to 14 characters, and quoted phrases.
BODY_NUMBER = r"[가-힣A-Za-z][가-힣A-Za-z·\s]{0,12}?\s?\d{1,4}(?:[.,]\d+)?\s?(?:%|nm|fps|ms|μm|GHz|MHz|kW|W|V|℃|배|억원|억|만원|만|건|개월|분기|차)"
BODY_QUOTE = r"[「『\"']([가-힣A-Za-z0-9][^「『\"'」』]{1,28})[」』\"']"
#: Grades written into a text, broken encodings, and marks of made-up texts.
BRACKET_GRADES = r"\[특급기밀\]|\[1급\s*비밀\]|\[2급\s*비밀\]|\[3급\s*공개\]|\[TS\]|\[S1\]|\[S2\]|\[S3\]|특급기밀\s*관련\s*사항|비밀\s*관련\s*사항"
MOJIBAKE = r"[愿蹂諛以]|\\ufffd|\?{3,}"
SYNTHETIC = r"\[가상기업[A-Z가-힣]\]|\[홍길동\(가명\)\]|\[등급분류\]|\[기밀자료\]|\[내부자료\]|\[등급코드\]|Noop fallback"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


#: White space of any script, as patterns of strings know it.
WHITE = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def business_number_ok(digits: Column) -> Column:
    """Whether ten digits end in the check digit: the weighted sum, plus the tens of five times the ninth digit."""
    d = [F.substring(digits, k + 1, F.lit(1)).cast("int") for k in range(10)]
    total = sum((d[k] * w for k, w in enumerate(BUSINESS_WEIGHTS)), F.lit(0)) + F.floor(d[8] * 5 / 10).cast("int")
    return F.pmod(10 - total % 10, F.lit(10)) == d[9]


def _bare_business(text: Column) -> Column:
    """The distinct runs of exactly ten digits that are business numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: (F.length(x) == 10) & business_number_ok(x)))


def mask_pii(df: DataFrame, column: str, skip: tuple[str, ...] = (), extra: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """df with masked, the text with personal data replaced by marks, and the numbers of marks put in by kind: each pattern works on what the ones before it left.

    Each step is a column of its own, so that Catalyst doesn't repeat the steps before
    it, and numbers are counted by how many marks are there more. Texts without a digit
    of any script or an @ skip all of it. Null texts give an empty text. extra: further patterns.
    """
    t = F.col(f"`{column}`")
    out = df.withColumn("_masked", F.when(t.rlike(r"(?U)[\d@]"), t))
    marks = lambda c, mark: (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark)
    steps = [(k, lambda c, p=p, m=m: F.regexp_replace(c, "(?U)" + p, m), m) for k, p, m in (*PII, *extra) if k not in skip]
    bare = lambda c: F.aggregate(_bare_business(c), c, lambda s, n: F.regexp_replace(s, F.concat(F.lit("(?<![0-9])"), n, F.lit("(?![0-9])")), F.lit("[BIZNO]")))
    steps.append(("business_no", lambda c: bare(F.regexp_replace(c, "(?U)" + BUSINESS, "[BIZNO]")), "[BIZNO]"))
    for kind, step, mark in steps:
        before = F.col("_masked")
        out = out.withColumn("_next", step(before))
        out = out.withColumn(kind, F.coalesce(marks(F.col("_next"), mark) - marks(before, mark), F.lit(0)).cast("int")).drop("_masked").withColumnRenamed("_next", "_masked")
    return out.withColumn("masked", F.coalesce("_masked", t, F.lit(""))).drop("_masked")


def body_facts(text: Column | str, most: int = 3, least: int = 3) -> Column:
    """Numbers with units, then quoted phrases, of a text without its first line (or of a text of one line), distinct in order, the first most."""
    t = F.coalesce(col(text), F.lit(""))
    body = F.when(F.contains(t, F.lit("\n")), F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(t)
    numbers = F.regexp_extract_all(body, F.lit(f"(?U)({BODY_NUMBER})"), F.lit(1))
    quotes = F.transform(F.regexp_extract_all(body, F.lit("(?U)" + BODY_QUOTE), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.slice(F.array_distinct(F.filter(F.concat(numbers, quotes), lambda x: F.length(x) >= least)), 1, most)


def required_tokens(text: Column | str, spans: Column, basis: Column, domain: Column, most: int = 4, least: int = 2) -> Column:
    """array<struct<token, source>> of what a rewording must keep: the evidence spans (array<struct<start, end>>, from 0, end exclusive), then body facts, then the keyword of a basis TS-kw:..., and the domain only where there is nothing else; the first of each token, at most most.

    A span that isn't within the text is left out. A token is a span's text up to the
    first line end or one of . ; : 。, at most 40 characters, cut at a blank.
    """
    t = F.coalesce(col(text), F.lit(""))
    entry = lambda token, source: F.struct(token.alias("token"), source.alias("source"))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def evidence(span):
        part = strip(F.regexp_extract(strip(F.substring(t, span["start"] + 1, span["end"] - span["start"])), r"^[^\n。.;:]*", 0))
        part = F.when(F.length(part) > 40, strip(F.regexp_replace(F.substring(part, 1, 40), " [^ ]*$", ""))).otherwise(part)
        return entry(part, F.when(span["start"] == 0, "evidence@0").otherwise("evidence@N"))

    within = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")), lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(t)))
    found = F.filter(F.transform(within, evidence), lambda x: F.length(x["token"]) >= least)
    facts = F.transform(body_facts(t), lambda x: entry(x, F.lit("body_fact")))
    keyword = F.regexp_extract(F.coalesce(basis, F.lit("")), r"(?U)TS-kw:([^:|\s]+)", 1)
    none = F.array().cast("array<struct<token:string,source:string>>")
    known = F.concat(found, facts, F.when(keyword != "", F.array(entry(keyword, F.lit("ts_kw")))).otherwise(none))
    d = F.trim(F.coalesce(domain, F.lit("")))
    fallback = F.when((F.length(d) >= least) & ~F.lower(d).isin("mixed", "?", "unknown"), F.array(entry(d, F.lit("domain")))).otherwise(none)
    every = F.when(F.size(known) > 0, known).otherwise(fallback)
    tokens = F.transform(every, lambda x: x["token"])
    first = F.filter(every, lambda x, i: F.array_position(tokens, x["token"]) == i + 1)
    return F.slice(first, 1, most)


def text_key(text: Column | str, mode: str = "strip", lower: bool = False) -> Column:
    """SHA-1 of the text without white space of any script (strip), or with it collapsed and trimmed (collapse)."""
    t = F.coalesce(col(text), F.lit(""))
    t = F.regexp_replace(t, WHITE, "") if mode == "strip" else F.trim(F.regexp_replace(t, WHITE, " "))
    return F.sha1(F.lower(t) if lower else t)


def strip_html(html: Column | str) -> Column:
    """Text of a page: scripts, styles and comments out, tags to spaces, the basic entities resolved, white space collapsed."""
    t = F.regexp_replace(col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def collapse_lines(text: Column | str) -> Column:
    """Line ends to \\n, runs of blanks to one, three and more line ends to two, each line and the whole trimmed."""
    t = F.regexp_replace(col(text), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"))


def quality_score(raw: Column | str, normal: Column | str) -> Column:
    """0 for an empty raw text, .2 under 50 characters, else half the kept share plus half of ten times the Hangul share, at most 1."""
    r, n = col(raw), col(normal)
    kr = (F.length(n) - F.length(F.regexp_replace(n, "[가-힯]", ""))) / F.greatest(F.length(n), F.lit(1))
    score = 0.5 * F.length(n) / F.greatest(F.length(r), F.lit(1)) + 0.5 * F.when(kr > 0.1, 1.0).otherwise(10 * kr)
    return F.when(F.coalesce(F.length(r), F.lit(0)) == 0, 0.0).when(F.length(n) < 50, 0.2).otherwise(F.least(F.lit(1.0), score))


def bigrams(text: Column | str) -> Column:
    """Runs of a-z and 0-9, then overlapping pairs of each Hangul run (a single character as it is)."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"([a-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(t, F.lit("([가-힣]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda k: F.substring(r, k, F.lit(2))))))
    return F.concat(words, pairs)


def words(text: Column | str) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def occurrences(text: Column | str, keyword: str) -> Column:
    """Non-overlapping occurrences of a keyword."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(keyword), F.lit("")))) / len(keyword)).cast("long")


def evidence_span(text: Column | str, keyword: str) -> Column:
    """(start, end) of the first occurrence, from 0, or of the whole text."""
    t = col(text)
    at = F.instr(t, keyword) - 1
    return F.struct(F.when(at >= 0, at).otherwise(0).alias("start"), F.when(at >= 0, at + len(keyword)).otherwise(F.length(t)).alias("end"))


def citations(text: Column | str) -> Column:
    """The distinct numbers in [n] marks, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def safe_token(text: Column | str) -> Column:
    """Lower case, / and blanks to -, other characters than a-z 0-9 . _ - to -, trimmed of -; long ones cut with a hash."""
    t = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[/ ]", "-"), r"[^a-z0-9._-]", "-")
    t = F.regexp_replace(t, r"^-+|-+$", "")
    return F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 41), F.lit("-"), F.substring(F.sha1(t), 1, 8))).otherwise(t)


def json_block(text: Column | str) -> Column:
    """The outermost {...} of a model's answer, its reasoning and fences aside; {} where there is none."""
    t = F.regexp_replace(col(text), r"(?s)<think>.*?</think>|```(?:json)?", "")
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNull() | (found == ""), "{}").otherwise(found)


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("int"))


#: What negates a fact close to it.
NEGATIONS = ("아니", "아닌", "않", "없", "미해당", "해당 없", "해당없", "비해당", "제외", "not ", "n't", "no ", "non-", "없음")


def facts_kept(text: Column | str, facts: Column, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """missing, negated (a negation within 20 characters of a fact's first occurrence) and admitted."""
    t = col(text)
    missing = F.filter(facts, lambda f: F.instr(t, f) == 0)
    near = lambda f: F.substring(t, F.greatest(F.instr(t, f) - 20, F.lit(1)), F.least(F.instr(t, f) - 1, F.lit(20)) + F.length(f) + 20)
    negated = F.filter(facts, lambda f: (F.instr(t, f) > 0) & F.exists(F.array(*[F.lit(n) for n in negations]), lambda n: F.contains(near(f), n)))
    return F.struct(missing.alias("missing"), negated.alias("negated"), ((F.size(facts) > 0) & (F.size(missing) == 0) & (F.size(negated) == 0)).alias("admitted"))


def windows(text: Column | str, size: int, overlap: int) -> Column:
    """Sliding windows of size characters, each starting size - overlap after the one before, up to the first that reaches the end."""
    t, step = col(text), max(1, size - overlap)
    last = F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("idx"), F.substring(t, k * step + 1, F.lit(size)).alias("content")))
