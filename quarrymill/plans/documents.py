"""Queries: text functions, chunks, vectors, retrieval, labels and routing; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import arrow, grades, stats, text
from quarrymill.operators import labeling as lb
from quarrymill.operators import lexical
from quarrymill.operators import retrieval as ir

from quarrymill.session import shipped

from .projections import GOLD, PRED, gold, predictions, read
from .relational import ORDER_SQL, WHITE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return read(spark, d, "documents")


def docs_for_python(spark, d):
    """documents, and this package on the path of the Python workers."""
    shipped(spark)
    return docs(spark, d)


def rounded(df, *columns: str, places: int = 9):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query()
def txt01_normalize(spark, d):
    """TXT-01, TXT-02: an Arrow UDF, as NFKC has no built-in."""
    return docs_for_python(spark, d).select("doc_id", F.sha1(arrow.normalize("text")).alias("normal_sha1"))


_COLLAPSED = r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)))"""


@query(f"""WITH n AS (SELECT doc_id, text, {_COLLAPSED} AS n FROM documents), k AS (SELECT *, (length(n) - length(regexp_replace(n, '[가-힯]', '', 'g'))) / greatest(length(n), 1)::DOUBLE AS kr FROM n)
SELECT doc_id, sha1(n) AS lines_sha1, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0::DOUBLE WHEN length(n) < 50 THEN 0.2::DOUBLE ELSE round(least(1.0::DOUBLE, 0.5 * length(n) / length(text) + 0.5 * CASE WHEN kr > 0.1 THEN 1 ELSE 10 * kr END), 9) END AS quality FROM k""")
def txt03_quality(spark, d):
    """TXT-03, and the line rules of TXT-01, of every document."""
    normal = text.collapse_lines("text")
    return docs(spark, d).select("doc_id", F.sha1(normal).alias("lines_sha1"), F.round(text.quality_score("text", normal), 9).alias("quality"))


#: (kind, pattern, mark, whether the pattern stands between characters that are no digits)
_MASKS = (
    ("rrn", r"\d{6}[- ]?[1-4]\d{6}", "[RRN]", True),
    ("frn", r"\d{6}[- ]?[5-8]\d{6}", "[FRN]", True),
    ("corp_reg", r"\d{6}-\d{7}", "[CORPNO]", True),
    ("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "[CARD]", False),
    ("phone_mobile", r"\b01[016789]-?\d{3,4}-?\d{4}\b", "[PHONE]", False),
    ("phone_land", r"\b0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])-\d{3,4}-\d{4}\b", "[PHONE]", False),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]", False),
    ("passport_kr", r"\b[MHS]\d{8}\b", "[PASSPORT]", False),
    ("ipv4", r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)", "[IP]", True),
    ("employee_id", r"\b(?:사번|직원번호|EMP|emp)[\s:#]*\d{5,10}\b", "[EMP]", False),
    ("_separated", r"(?:\d{3}[- ]\d{2}[- ]?\d{5}|\d{5}[- ]\d{5})", "[BIZNO]", True),
)


def _masked_sql(t, pattern, mark, apart):
    """Twice where the characters around are read too, as two matches can share one."""
    pattern = pattern.replace(r"\d", r"\p{Nd}")
    if not apart:
        return f"regexp_replace({t}, '{pattern}', '{mark}', 'g')"
    once = "regexp_replace({}, '(^|[^\\p{{Nd}}])" + pattern.replace("{", "{{").replace("}", "}}") + "([^\\p{{Nd}}]|$)', '\\1" + mark + "\\2', 'g')"
    return once.format(once.format(t))


_MARKS = "((length({0}) - length(replace({0}, '{1}', ''))) // {2})"
_OK = "(10 - (" + " + ".join(f"substr(x, {k + 1}, 1)::INT * {w}" for k, w in enumerate((1, 3, 7, 1, 3, 7, 1, 3, 5))) + " + substr(x, 9, 1)::INT * 5 // 10) % 10) % 10 = substr(x, 10, 1)::INT"
_BARE = f"list_distinct(list_filter(regexp_extract_all(t, '\\d+'), lambda x: length(x) = 10 AND CASE WHEN length(x) = 10 THEN {_OK} ELSE FALSE END))"


@query("WITH s0 AS (SELECT doc_id, CASE WHEN doc_id % 40 = 3 THEN '가 １２３４５６-１２３４５６７ 나' ELSE coalesce(text, '') END AS t FROM documents)" + "".join(f", s{i + 1} AS (SELECT * EXCLUDE (t, u), u AS t, {_MARKS.format('u', m, len(m))} - {_MARKS.format('t', m, len(m))} AS {k} FROM (SELECT *, {_masked_sql('t', p, m, a)} AS u FROM s{i}))" for i, (k, p, m, a) in enumerate(_MASKS)) + f""", b AS (SELECT * EXCLUDE (t), t, CASE WHEN len({_BARE}) = 0 THEN t ELSE list_reduce(list_concat([t], list_concat({_BARE}, {_BARE})), lambda s, x: regexp_replace(s, '(^|\\D)' || x || '(\\D|$)', '\\1[BIZNO]\\2', 'g')) END AS u FROM s{len(_MASKS)})
SELECT doc_id, {', '.join(f'CAST({k} AS INT) AS {k}' for k, *_ in _MASKS[:-1])}, CAST(_separated + {_MARKS.format('u', '[BIZNO]', 7)} - {_MARKS.format('t', '[BIZNO]', 7)} AS INT) AS business_no, sha1(u) AS masked_sha1 FROM b""")
def txt04_mask_pii(spark, d):
    """TXT-04, TXT-05, TXT-20: each pattern counted on what the ones before it left; bare ten-digit business numbers only if their check digit fits. Some texts have digits of another script only."""
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 40 == 3, "가 １２３４５６-１２３４５６７ 나").otherwise(F.col("text")).alias("text"))
    out = text.mask_pii(rows, "text")
    return out.select("doc_id", *[k for k, *_ in text.PII], "business_no", F.sha1("masked").alias("masked_sha1"))


@query(f"SELECT doc_id, CAST({_OK} AS INT) AS ok FROM (SELECT doc_id, lpad((doc_id * 7919)::VARCHAR, 10, '1208100000') AS x FROM documents)")
def txt05_business_numbers(spark, d):
    """TXT-05: the check digit of a ten-digit number."""
    n = F.lpad((F.col("doc_id") * 7919).cast("string"), 10, "1208100000")
    return docs(spark, d).select("doc_id", text.business_number_ok(n).cast("int").alias("ok"))


#: Some texts with white space of other scripts, as the tables have none.
_SPACED = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN chr(160) || 'a ' || chr(12288) || 'b' || chr(8201) || chr(31) ELSE '' END || text AS text FROM documents"


@query(f"SELECT doc_id, sha1(regexp_replace(coalesce(text, ''), '{WHITE_SQL}', '', 'g')) AS strip_key, sha1(lower(trim(regexp_replace(coalesce(text, ''), '{WHITE_SQL}', ' ', 'g')))) AS collapse_key FROM ({_SPACED})")
def txt07_text_keys(spark, d):
    """TXT-07: keys of texts, white space of any script aside."""
    spaced = docs(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 9 == 0, "\xa0a \u3000b\u2009\x1f").otherwise(""), "text").alias("text"))
    return spaced.select("doc_id", text.text_key("text").alias("strip_key"), text.text_key("text", "collapse", True).alias("collapse_key"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS INT) AS n_words, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS INT) AS n_ascii FROM documents")
def txt08_tokens(spark, d):
    """TXT-08, TXT-09."""
    return docs(spark, d).select("doc_id", F.size(text.words("text")).alias("n_words"), F.size(text.bigrams("text")).alias("n_ascii"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') - 1 ELSE 0 END AS start, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') + 2 ELSE length(text) END AS \"end\" FROM documents")
def txt10_keyword_counts(spark, d):
    """TXT-10, TXT-11: occurrences and the first one's span."""
    s = text.evidence_span("text", "the")
    return docs(spark, d).select("doc_id", text.occurrences("text", "the").alias("n_the"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))


_BODY = "CASE WHEN contains(coalesce(text, ''), chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE coalesce(text, '') END"
_FACTS = rf"""list_concat(regexp_extract_all({_BODY}, '[가-힣A-Za-z][가-힣A-Za-z·\s]{{0,12}}?\s?\d{{1,4}}(?:[.,]\d+)?\s?(?:%|nm|fps|ms|μm|GHz|MHz|kW|W|V|℃|배|억원|억|만원|만|건|개월|분기|차)'),
list_transform(regexp_extract_all({_BODY}, '[「『"''"'']([가-힣A-Za-z0-9][^「『"''」』]{{1,28}})[」』"'']', 1), lambda q: regexp_replace(q, '\s+$', '')))"""
_DISTINCT = "list_filter({0}, lambda y, i: list_position({0}, y) = i)"
_FACT_ROWS = f"SELECT doc_id, lang, text, list_slice({_DISTINCT.format('f')}, 1, 3) AS facts FROM (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter({_FACTS}, lambda v: length(v) >= 3) AS f FROM documents)"


@query(f"SELECT doc_id, array_to_string(facts, '|') AS facts FROM ({_FACT_ROWS})")
def txt12_body_facts(spark, d):
    """TXT-12: numbers with units and quoted phrases, distinct in order, the first three (the operator's limit)."""
    return docs(spark, d).select("doc_id", F.array_join(text.body_facts("text"), "|").alias("facts"))


_PART = r"trim(regexp_extract(trim(substr(text, a + 1, b - a), E' \t\n\r'), '^[^\n。.;:]*'), E' \t\n\r')"
_REQUIRED = rf"""WITH s AS (SELECT doc_id, unnest([0, 5]) AS a, unnest([60, 90]) AS b, text FROM documents), e AS (SELECT doc_id, a, {_PART} AS p FROM s WHERE b <= length(text)),
c AS (SELECT doc_id, a, CASE WHEN length(p) > 40 THEN trim(regexp_replace(substr(p, 1, 40), ' [^ ]*$', ''), E' \t\n\r') ELSE p END AS p FROM e),
ev AS (SELECT doc_id, list({{'token': p, 'source': CASE WHEN a = 0 THEN 'evidence@0' ELSE 'evidence@N' END}} ORDER BY a) AS ev FROM c WHERE length(p) >= 2 GROUP BY doc_id),
k AS (SELECT f.doc_id, list_concat(list_concat(coalesce(ev, []), list_transform(facts, lambda v: {{'token': v, 'source': 'body_fact'}})), CASE WHEN f.doc_id % 5 = 0 THEN [{{'token': 'key' || lang, 'source': 'ts_kw'}}] ELSE [] END) AS k, lang FROM ({_FACT_ROWS}) f LEFT JOIN ev ON f.doc_id = ev.doc_id),
q AS (SELECT doc_id, CASE WHEN len(k) > 0 THEN k WHEN length(lang) >= 2 THEN [{{'token': lang, 'source': 'domain'}}] ELSE [] END AS k FROM k),
r AS (SELECT doc_id, list_slice(list_filter(k, lambda y, i: list_position(list_transform(k, lambda z: z.token), y.token) = i), 1, 4) AS k FROM q)"""


def _required(spark, d):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 60), (5, 90))])
    basis = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("TS-kw:key"), "lang"))
    return docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text.required_tokens("text", spans, basis, F.col("lang")).alias("k"))


@query(_REQUIRED + " SELECT doc_id, array_to_string(list_transform(k, lambda z: z.source || '=' || z.token), '|') AS required FROM r")
def txt13_required_tokens(spark, d):
    """TXT-13: evidence, then facts, then a keyword, else the domain; four at most (the operator's limit)."""
    return _required(spark, d).select("doc_id", F.array_join(F.transform("k", lambda x: F.concat(x["source"], F.lit("="), x["token"])), "|").alias("required"))


_NEGATED = " OR ".join("contains(near, '" + n.replace("'", "''") + "')" for n in ("아니", "아닌", "않", "없", "미해당", "해당 없", "해당없", "비해당", "제외", "not ", "n't", "no ", "non-", "없음"))


@query(_REQUIRED + f""", t AS (SELECT r.doc_id, reverse(coalesce(text, '')) AS text, unnest(list_transform(k, lambda z: z.token)) AS f FROM r JOIN documents USING (doc_id) WHERE r.doc_id % 2 = 1 UNION ALL SELECT r.doc_id, coalesce(text, ''), unnest(list_transform(k, lambda z: z.token)) FROM r JOIN documents USING (doc_id) WHERE r.doc_id % 2 = 0),
g AS (SELECT doc_id, f, instr(text, f) AS pos, substr(text, greatest(instr(text, f) - 20, 1)::BIGINT, least(instr(text, f) - 1, 20)::BIGINT + length(f) + 20) AS near FROM t)
SELECT doc_id, count(*) FILTER (WHERE pos = 0)::INT AS missing, count(*) FILTER (WHERE pos > 0 AND ({_NEGATED}))::INT AS negated, count(*) FILTER (WHERE pos = 0) = 0 AND count(*) FILTER (WHERE pos > 0 AND ({_NEGATED})) = 0 AS admitted FROM g GROUP BY doc_id""")
def txt14_facts_kept(spark, d):
    """TXT-14: whether the required tokens of a document are still there, and not negated, in a text made of it (here itself, or for odd ids its reverse)."""
    r = _required(spark, d)
    made = F.when(F.col("doc_id") % 2 == 1, F.reverse("text")).otherwise(F.col("text"))
    k = text.facts_kept(made, F.transform("k", lambda x: x["token"]))
    return r.where(F.size("k") > 0).select("doc_id", k.alias("r")).select("doc_id", F.size("r.missing").alias("missing"), F.size("r.negated").alias("negated"), "r.admitted")


@query(r"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [3] [1] [3] [12]', '\[([0-9]{1,9})\]', 1), lambda x: x::INT) AS f FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS cited, CAST(len(list_filter(f, lambda x, i: list_position(f, x) = i AND (x < 1 OR x > 5))) AS INT) AS out_of_range FROM c""")
def txt15_citations(spark, d):
    """TXT-15."""
    c = text.citations(F.concat("text", F.lit(" [3] [1] [3] [12]")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias("cited"), F.size(F.filter(c, lambda x: (x < 1) | (x > 5))).alias("out_of_range"))


@query(r"""WITH a AS (SELECT page_id, 'noise {"id": ' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE ', "a": {"b": 1}} tail' END AS t FROM pages), b AS (SELECT page_id, regexp_extract(t, '(?s)\{.*\}') AS j FROM a)
SELECT page_id, CASE WHEN j = '' OR NOT json_valid(j) THEN '{}' ELSE j END AS block FROM b""")
def txt16_json_rescue(spark, d):
    """TXT-16."""
    a = F.concat(F.lit('noise {"id": '), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "").otherwise(', "a": {"b": 1}} tail'))
    return read(spark, d, "pages").select("page_id", text.json_block(a).alias("block"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[/ ]', '-', 'g'), '[^a-z0-9._-]', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 41) || '-' || substr(sha1(t), 1, 8) ELSE t END AS token, rpad(substr(sha1(url), 1, 32), 32, '0') AS uuid, greatest(1, length(url) // 4)::INT AS tokens FROM pages JOIN a USING (page_id)""")
def txt17_safe_tokens(spark, d):
    """TXT-17, TXT-18, TXT-19."""
    return read(spark, d, "pages").select("page_id", text.safe_token("url").alias("token"), F.rpad(F.substring(F.sha1("url"), 1, 32), 32, "0").alias("uuid"), text.token_estimate("url").alias("tokens"))


@query("""SELECT doc_id, idx::INT AS idx, sha1(substr(text, idx * 1100 + 1, 1200)) AS content_sha1 FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 1200, 0) / 1100.0::DOUBLE) AS BIGINT) + 1)) AS idx FROM documents)""")
def chk05_sliding_windows(spark, d):
    """CHK-05: 1200 characters, 100 shared; pure expressions."""
    return docs(spark, d).select("doc_id", F.explode(text.windows("text", 1200, 100)).alias("w")).select("doc_id", F.col("w.idx").alias("idx"), F.sha1("w.content").alias("content_sha1"))


@query()
def chk01_split(spark, d):
    """CHK-01: recursive separators, an Arrow UDF."""
    c = docs_for_python(spark, d).select("doc_id", F.explode(arrow.split_chunks()("text")).alias("c"))
    return c.select("doc_id", "c.idx", "c.char_count", "c.overlap_prev", F.sha1("c.content").alias("content_sha1"))


@query()
def chk02_heading_split(spark, d):
    """CHK-02, 03, 04: sections by heading, packed sentences."""
    c = docs_for_python(spark, d).select("doc_id", F.explode(arrow.split_chunks(headings=True)("text")).alias("c"))
    return c.select("doc_id", "c.idx", "c.char_count", "c.heading_path", F.sha1("c.content").alias("content_sha1"))


@query("""SELECT conv_id, sha1(string_agg(text, chr(10) ORDER BY turn)) AS text_sha1, 'c' || conv_id || ':c' || (count(*) - 1) AS last_chunk FROM conversations GROUP BY conv_id HAVING length(string_agg(text, chr(10) ORDER BY turn)) >= 10""")
def chk08_reconstruction(spark, d):
    """CHK-08: chunks joined in order, short texts dropped; ids by position."""
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("c"))
    t = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return g.where(F.length(t) >= 10).select("conv_id", F.sha1(t).alias("text_sha1"), F.concat(F.lit("c"), "conv_id", F.lit(":c"), F.size("c") - 1).alias("last_chunk"))


_DOUBLE = "list_transform(embedding, lambda x: x::DOUBLE)"


def _queries(spark, d):
    e = read(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_SEARCH = f"SELECT q.vec_id AS qid, e.vec_id AS id, e.label, list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e"


@query(f"SELECT qid, id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_SEARCH})) WHERE rank <= 10")
def vec03_nearest(spark, d):
    """VEC-02, VEC-03, JN-05, SRT-01, WIN-01: the ten nearest of all vectors for each of the stated queries (ids divisible by 100)."""
    q, e = _queries(spark, d)
    return ir.nearest(q, e.select("id", "vec"), 10).select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query(f"SELECT label, dim::INT AS dim, round(avg(v), 9) AS mean FROM (SELECT label, unnest({_DOUBLE}) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2")
def vec04_centroids(spark, d):
    """VEC-04."""
    return read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("mean"))


@query()
def vec01_hash_embedding(spark, d):
    """VEC-01: distinct texts are embedded once and joined back by key."""
    t = docs_for_python(spark, d).select("doc_id", "text", F.sha1("text").alias("key"))
    once = t.groupBy("key").agg(F.min("text").alias("text")).select("key", arrow.hash_embedding(64)("text").alias("v"))
    return t.select("doc_id", "key").join(once, "key").select("doc_id", F.round(F.get("v", F.lit(0)), 9).alias("v0"), F.size("v").alias("dims"))


_BENCH = "SELECT item_id AS qid, term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS term FROM benchmark)"
_DOCT = "SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{4,}') AS t FROM documents"
_BM25 = f"""SELECT qid, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM (SELECT id, term, count(*)::DOUBLE AS tf, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM ({_DOCT})) WHERE term IN (SELECT term FROM ({_BENCH})) GROUP BY id, term) tf
JOIN (SELECT term, count(*)::DOUBLE AS df FROM (SELECT id, unnest(list_distinct(t)) AS term FROM ({_DOCT})) GROUP BY term) d ON tf.term = d.term JOIN ({_BENCH}) q ON q.term = tf.term, (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM ({_DOCT})) GROUP BY qid, tf.id"""


def _tokens4(c):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{4,})"), F.lit(1))


def _passage_terms(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(_tokens4(F.col("text")))).alias("term"))


@query(f"SELECT qid, id, rank::INT AS rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ({_BM25}) WHERE score > 0) WHERE rank <= 10")
def ir01_bm25(spark, d):
    """IR-01, IR-03, WIN-02: the ten best documents of each benchmark passage, from a stored index."""
    corpus = docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    index = lexical.stored(corpus, _tokens4(F.col("text")), lexical.bm25_scoring(), "bm25")
    return lexical.search(index, _passage_terms(spark, d), 10).select("qid", "id", "rank")


#: Hangul texts made from ids, as the tables hold none: documents for each twentieth doc_id, and queries.
_HANGUL = ("보안등급", "비밀문서", "공개", "분류기준", "검토자료", "대외비", "접근권한", "등급표시")


def _hangul(seed, words):
    return F.array_join(F.transform(F.sequence(F.lit(1), words.cast("int")), lambda i: F.element_at(F.array(*[F.lit(w) for w in _HANGUL]), ((seed * i + i * i) % 8 + 1).cast("int"))), " ")


_HANGUL_SQL = "array_to_string(list_transform(range(1, {words} + 1), lambda i: " + str(list(_HANGUL)) + "[({seed} * i + i * i) % 8 + 1]), ' ')"
_PAIRS = "list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+'), lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda k: substring(r, CAST(k AS INT), 2)) END)))"
_RANKED = f"""WITH c AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT doc_id + 10000000, {_HANGUL_SQL.format(seed="doc_id", words="(3 + doc_id % 40)")} FROM documents WHERE doc_id % 20 = 0),
q AS (SELECT qid, unnest(list_distinct({_PAIRS})) AS term FROM (SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT item_id + 10000000, {_HANGUL_SQL.format(seed="item_id", words="(2 + item_id % 3)")} FROM benchmark)),
t AS (SELECT id, {_PAIRS} AS t FROM c),
tf AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
s AS (SELECT qid, id, round(sum(list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0::DOUBLE / (j * j))) * 0.1::DOUBLE / 1.64493406685::DOUBLE / log2(n + 1) / terms), 9) AS score FROM tf JOIN q USING (term) JOIN (SELECT qid, count(*) AS terms FROM q GROUP BY qid) USING (qid) GROUP BY qid, id)
SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


@query(_RANKED)
def ir02_lexical_rank(spark, d):
    """IR-02: words and Hangul pairs, any of which may match, ranked by their positions and the length; from a stored index."""
    made = docs(spark, d).where("doc_id % 20 = 0").select((F.col("doc_id") + 10_000_000).alias("id"), _hangul(F.col("doc_id"), 3 + F.col("doc_id") % 40).alias("text"))
    corpus = docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(made)
    b = read(spark, d, "benchmark")
    queries = b.select(F.col("item_id").alias("qid"), "text").unionByName(b.select((F.col("item_id") + 10_000_000).alias("qid"), _hangul(F.col("item_id"), 2 + F.col("item_id") % 3).alias("text")))
    index = lexical.stored(corpus, text.bigrams("text"), lexical.ts_rank_scoring(), "pairs")
    terms = queries.select("qid", F.explode(F.array_distinct(text.bigrams("text"))).alias("term"))
    return lexical.search(index, terms, 20).select("qid", "id", "score", "rank")


_CHANNEL_A = f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, score FROM ({_SEARCH}) WHERE score > 0"
_CHANNEL_B = "SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1.0::DOUBLE / (1 + abs(q.label - e.label)) DESC, e.vec_id) AS rank, 1.0::DOUBLE / (1 + abs(q.label - e.label)) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e"


def _channels(spark, d, n=50):
    """The nearest vectors, and those of the nearest labels: of each label the n smallest ids are enough for any query's n best, so only these meet the query's label."""
    q, e = _queries(spark, d)
    a = ir.nearest(q, e.select("id", "vec"), n).select("qid", "id", "score", "rank").where("score > 0")
    few = e.select("label", "id").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("k") <= n)
    asked = read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    # a row for each pair of labels
    met = few.crossJoin(asked.select("ql").distinct()).select("ql", "id", (F.lit(1.0) / (1 + F.abs(F.col("ql") - F.col("label")))).alias("score"))
    best = ir.ranked(met.withColumnRenamed("ql", "qid"), n).withColumnRenamed("qid", "ql")
    return a, asked.join(best, "ql").select("qid", "id", "score", "rank")


@query(f"""WITH u AS (SELECT qid, id, rank FROM ({_CHANNEL_A}) WHERE rank <= 50 UNION ALL SELECT qid, id, rank FROM ({_CHANNEL_B}) WHERE rank <= 50), f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)
SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def ir04_rrf(spark, d):
    """IR-04, JN-04, SET-05, SRT-02: fusion of two channels of fifty, cut to ten."""
    return ir.ranked(ir.rrf(list(_channels(spark, d))).withColumn("score", F.round("score", 9)), 10).select("qid", "id", "score", "rank")


_MM = "CASE WHEN max(score) OVER (PARTITION BY qid) = min(score) OVER (PARTITION BY qid) THEN 0.5::DOUBLE ELSE (score - min(score) OVER (PARTITION BY qid)) / (max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid)) END"


@query(f"""WITH a AS (SELECT qid, id, {_MM} AS s FROM ({_CHANNEL_A}) WHERE rank <= 50), b AS (SELECT qid, id, {_MM} AS s FROM ({_CHANNEL_B}) WHERE rank <= 50)
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(0.6 * coalesce(a.s, 0) + 0.4 * coalesce(b.s, 0), 9) AS score FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id""")
def ir05_weighted(spark, d):
    """IR-05."""
    a, b = _channels(spark, d)
    return rounded(ir.weighted(a, b, 0.6), "score")


_REL = "SELECT q.vec_id AS qid, e.vec_id AS id FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings e ON q.label = e.label"


def _told(spark, d, ranks):
    """ranks (qid, id, ...) with relevant (of the query's label), and (qid, n), how many rows are."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("label").alias("ql"))
    totals = asked.join(e.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n")), "ql").select("qid", "n")
    return ranks.join(asked, "qid").join(e, "id").withColumn("relevant", F.col("ql") == F.col("label")), totals


@query(f"""WITH r AS (SELECT qid, id, rank FROM ({_CHANNEL_A}) WHERE rank <= 10), n AS (SELECT qid, count(*) AS n FROM ({_REL}) GROUP BY qid),
h AS (SELECT r.qid, count(*) AS h, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN ({_REL}) x ON r.qid = x.qid AND r.id = x.id GROUP BY r.qid)
SELECT n.qid, round(coalesce(h / n::DOUBLE, 0), 9) AS recall, round(coalesce(h / 10.0::DOUBLE, 0), 9) AS precision, round(coalesce(1 / f::DOUBLE, 0), 9) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg FROM n LEFT JOIN h ON n.qid = h.qid""")
def ir13_metrics(spark, d):
    """IR-13, WIN-13."""
    q, e = _queries(spark, d)
    ranks, totals = _told(spark, d, ir.nearest(q, e.select("id", "vec"), 10).where("score > 0").select("qid", "id", "rank"))
    return rounded(ir.hit_metrics(ranks, totals, 10), "recall", "precision", "mrr", "ndcg")


_ALPHAS = [round(k / 10, 4) for k in range(11)]


@query(f"""WITH a AS (SELECT qid, id, {_MM} AS s FROM ({_CHANNEL_A}) WHERE rank <= 50), b AS (SELECT qid, id, {_MM} AS s FROM ({_CHANNEL_B}) WHERE rank <= 50),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, coalesce(a.s, 0) AS d, coalesce(b.s, 0) AS x FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id),
g AS (SELECT *, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS alpha FROM f), r AS (SELECT alpha, qid, id, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * d + (1 - alpha) * x, 9) DESC, id) AS rank FROM g),
n AS (SELECT qid, count(*) AS n FROM ({_REL}) GROUP BY qid), h AS (SELECT r.alpha, r.qid, count(*) FILTER (WHERE rank <= 5) AS h5, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN ({_REL}) x ON r.qid = x.qid AND r.id = x.id WHERE rank <= 10 GROUP BY 1, 2)
SELECT alpha, round(sum(h5 / n::DOUBLE) / max(q), 9) AS recall_5, round(sum(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))) / max(q), 9) AS ndcg_10, round(sum(1 / f::DOUBLE) / max(q), 9) AS mrr FROM h JOIN n ON h.qid = n.qid, (SELECT count(*) AS q FROM n) GROUP BY alpha""")
def ir14_alpha_grid(spark, d):
    """IR-14: recall at 5, ndcg at 10 and mrr of the weighted fusion for eleven weights, means over the queries."""
    a, b = _channels(spark, d)
    told, totals = _told(spark, d, ir.alpha_grid(a, b, _ALPHAS))
    every = totals.select("qid", "n", F.explode(F.array(*[F.lit(x) for x in _ALPHAS])).alias("alpha"))
    ten = ir.hit_metrics(told, every, 10, ("alpha", "qid")).select("alpha", "qid", "ndcg", "mrr")
    out = ir.hit_metrics(told, every, 5, ("alpha", "qid")).select("alpha", "qid", "recall").join(ten, ["alpha", "qid"])
    return out.groupBy("alpha").agg(F.round(F.avg("recall"), 9).alias("recall_5"), F.round(F.avg("ndcg"), 9).alias("ndcg_10"), F.round(F.avg("mrr"), 9).alias("mrr"))


_VARIANTS = f"SELECT qid - qid % 100 AS qid, qid % 100 AS variant, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_SEARCH.replace('vec_id % 100 = 0', 'vec_id % 100 = 0 OR vec_id % 200 = 1')}) WHERE score > 0) WHERE rank <= 20"


@query(f"""WITH v AS ({_VARIANTS}), s AS (SELECT qid, id, round(CASE WHEN max(n) > 1 THEN sum(1.0::DOUBLE / (60 + rank)) ELSE sum(score) END, 9) AS score FROM v JOIN (SELECT qid, count(DISTINCT variant) AS n FROM v GROUP BY qid) USING (qid) GROUP BY qid, id)
SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def ir06_multi_query(spark, d):
    """IR-06: every second query has a second variant; those with one keep their own scores."""
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0 or vec_id % 200 = 1").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    found = ir.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 20).where("score > 0")
    found = found.select((F.col("qid") - F.col("qid") % 100).alias("qid"), (F.col("qid") % 100).alias("variant"), "id", "rank", "score")
    return ir.ranked(ir.multi_query(found).withColumn("score", F.round("score", 9)), 10).select("qid", "id", "score", "rank")


_TOP5 = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_SEARCH}) WHERE qid <> id) WHERE rank <= 5"
_VOTE = f"SELECT qid, label, sum(score) AS s, sum(sum(score)) OVER (PARTITION BY qid) AS t, row_number() OVER (PARTITION BY qid ORDER BY sum(score) DESC, label) AS r, count(*) OVER (PARTITION BY qid) AS labels FROM ({_TOP5}) GROUP BY qid, label"


def _votes(spark, d):
    q, e = _queries(spark, d)
    top = ir.nearest(q, e.select("id", "vec"), 6).where("qid <> id")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    return ir.votes(top.join(e.select("id", "label"), "id"), "label")


@query(f"SELECT qid, max(label) FILTER (WHERE r = 1) AS voted, round(max(s) FILTER (WHERE r = 1) / max(t), 9) AS share, round((max(s) FILTER (WHERE r = 1) - coalesce(max(s) FILTER (WHERE r = 2), 0)) / max(t), 9) AS margin, max(labels) = 1 AS unanimous FROM ({_VOTE}) GROUP BY qid")
def ir12_votes(spark, d):
    """IR-12, AGG-17."""
    return rounded(_votes(spark, d), "share", "margin")


@query(f"""WITH v AS (SELECT v.qid, max(v.label) FILTER (WHERE r = 1) AS voted, max(s) FILTER (WHERE r = 1) / max(t) AS share FROM ({_VOTE}) v GROUP BY v.qid), x AS (SELECT tau, share >= tau AS c, voted <> label AS w FROM v JOIN embeddings e ON v.qid = e.vec_id, (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS tau))
SELECT tau, round(avg(c::INT), 9) AS coverage, round(coalesce(count(*) FILTER (WHERE c AND w) / nullif(count(*) FILTER (WHERE c), 0)::DOUBLE, 0), 9) AS error FROM x GROUP BY tau""")
def ir11_vote_sweep(spark, d):
    """IR-11: coverage and error of the vote over a fixed list of thresholds."""
    truth = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    x = _votes(spark, d).join(truth, "qid").select(F.explode(F.array(*[F.lit(t) for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)])).alias("tau"), "share", (F.col("voted") != F.col("label")).alias("w")).withColumn("c", F.col("share") >= F.col("tau"))
    return rounded(x.groupBy("tau").agg(F.avg(F.col("c").cast("double")).alias("coverage"), stats.ratio(F.count_if(F.col("c") & F.col("w")), F.count_if(F.col("c"))).alias("error")), "coverage", "error")


_SYN = {"the": ["a", "this"], "que": ["qui"], "der": ["die", "das"]}


@query("""SELECT item_id, array_to_string(list_concat(CASE WHEN contains(lower(text), 'the') THEN list_filter(['a', 'this'], lambda s: NOT contains(lower(text), s)) ELSE [] END, list_concat(CASE WHEN contains(lower(text), 'que') THEN list_filter(['qui'], lambda s: NOT contains(lower(text), s)) ELSE [] END,
CASE WHEN contains(lower(text), 'der') THEN list_filter(['die', 'das'], lambda s: NOT contains(lower(text), s)) ELSE [] END)), ',') AS added FROM benchmark""")
def ir07_expansion(spark, d):
    """IR-07, SET-04: synonyms of the keys in a query that it doesn't hold yet."""
    t = F.lower("text")
    parts = [F.when(F.contains(t, F.lit(k)), F.filter(F.array(*[F.lit(s) for s in v]), lambda s: ~F.contains(t, s))).otherwise(F.array().cast("array<string>")) for k, v in _SYN.items()]
    return read(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.concat(*parts)), ",").alias("added"))


@query(f"SELECT qid, id, round(1 - (rank - 1) / 10.0::DOUBLE, 9) AS reranked, CAST(greatest(100, 20 * 10) AS INT) AS candidates FROM ({_CHANNEL_A}) WHERE rank <= 10")
def ir09_rerank(spark, d):
    """IR-09, IR-10: the order-keeping scorer, and candidate sizing."""
    q, e = _queries(spark, d)
    a = ir.nearest(q, e.select("id", "vec"), 10).where("score > 0")
    return a.select("qid", "id", F.round(1 - (F.col("rank") - 1) / F.lit(10.0), 9).alias("reranked"), F.greatest(F.lit(100), F.lit(200)).alias("candidates"))


_HITS = f"SELECT a.qid, a.id, a.rank, a.score, CASE WHEN a.id % 7 <> 0 THEN d.text END AS text FROM ({_CHANNEL_A}) a LEFT JOIN documents d ON d.doc_id = a.id WHERE a.rank <= 200"


@query(f"""WITH h AS ({_HITS}), s AS (SELECT *, qid % 300 = 0 AS failed, coalesce(text, '') <> '' AS has, CASE WHEN coalesce(text, '') <> '' THEN (length(text) * 31 + qid) % 97 / 97.0::DOUBLE END AS new FROM h),
o AS (SELECT qid, id, CASE WHEN has AND NOT failed THEN new ELSE score END AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN failed THEN 0 WHEN has THEN 0 ELSE 1 END, CASE WHEN has AND NOT failed THEN -new ELSE 0 END, rank) AS rank FROM s)
SELECT qid, id, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM o WHERE rank <= 10""")
def ir09_reranked(spark, d):
    """IR-09, IR-10: as many candidates as ten hits take, scored by their texts; some hits have none, and for some queries the scorer fails."""
    q, e = _queries(spark, d)
    a = ir.nearest(q, e.select("id", "vec"), ir.candidates_for(10)).where("score > 0")
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    hits = a.join(t, "id", "left").withColumn("query", F.col("qid").cast("string"))

    def scorer(query, texts):
        if int(query) % 300 == 0:
            raise ValueError("no model for this query")
        return [(len(x) * 31 + int(query)) % 97 / 97.0 for x in texts]

    return rounded(ir.reranked(hits, scorer, 10), "score")


_MORE = {"the": ["zza", "this", "that", "these"], "QUE": ["qui", "zzb"], "der": ["die", "das"]}
_MORE_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{k.lower()}') THEN {v} ELSE [] END" for k, v in _MORE.items())


@query(f"""WITH x AS (SELECT item_id, text, flatten([{_MORE_SQL}]) AS s FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, '') ), f AS (SELECT item_id, text, list_filter(s, lambda v: NOT contains(text, v)) AS s FROM x),
u AS (SELECT item_id, text, list_filter(s, lambda v, i: list_position(s, v) = i)[1:3] AS s FROM f)
SELECT item_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_concat([text], list_transform(s, lambda v: trim(text || ' ' || v))), '|') END AS queries FROM u""".replace("SELECT item_id + 1000000, '')", "SELECT item_id + 1000000, '' FROM benchmark)"))
def ir07_expanded_queries(spark, d):
    """IR-07: a query and the query with each of at most three synonyms."""
    b = read(spark, d, "benchmark").select("item_id", "text")
    rows = b.unionByName(b.select((F.col("item_id") + 1_000_000).alias("item_id"), F.lit("").alias("text")))
    return rows.select("item_id", F.array_join(ir.rule_expansion(F.col("text"), _MORE), "|").alias("queries"))


@query("""WITH c AS (SELECT conv_id, list_sort(list_distinct(list(turn % 4))) AS cited, list_sort(list_distinct(list(turn % 3))) AS gold FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, len(list_intersect(cited, gold)) AS b, len(cited) AS c, len(gold) AS g FROM c)
SELECT conv_id, round(b / c::DOUBLE, 9) AS precision, round(b / g::DOUBLE, 9) AS recall, round(CASE WHEN b = 0 THEN 0 ELSE 2 * (b / c::DOUBLE) * (b / g::DOUBLE) / (b / c::DOUBLE + b / g::DOUBLE) END, 9) AS f1, b > 0 AS grounded, b < c AS hallucination_risk FROM x""")
def ir17_citation_f1(spark, d):
    """IR-17, IR-18."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") % 4).alias("c"), F.collect_set(F.col("turn") % 3).alias("g"))
    b = F.size(F.array_intersect("c", "g"))
    p, r = stats.ratio(b, F.size("c")), stats.ratio(b, F.size("g"))
    return rounded(c.select("conv_id", p.alias("precision"), r.alias("recall"), stats.ratio(2 * p * r, p + r).alias("f1"), (b > 0).alias("grounded"), (b < F.size("c")).alias("hallucination_risk")), "precision", "recall", "f1")


_HIT = r"SELECT *, ((turn * 37 + conv_id) % 100) / 100.0::DOUBLE AS score, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations"


@query(f"WITH h AS (SELECT conv_id, turn, role, score, substr(t, 1, 1000) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM ({_HIT})) SELECT conv_id, string_agg('[' || n || '] ' || role || ' (' || printf('%.3f', score) || ') ' || t, chr(10) ORDER BY n) AS prompt FROM h WHERE n <= 5 GROUP BY conv_id")
def ir19_prompt(spark, d):
    """IR-19: the five best hits by score, with white space run together, 1,000 characters of each (the operator's limits)."""
    score = ((F.col("turn") * 37 + F.col("conv_id")) % 100) / F.lit(100.0)
    t = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, 1000)
    hit = F.struct((-score).alias("m"), "turn", F.concat("role", F.lit(" ("), F.format_string("%.3f", score), F.lit(") "), t).alias("l"))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(hit)), 1, 5).alias("s"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["l"])), "\n").alias("prompt"))


@query(r"SELECT DISTINCT regexp_replace(CASE WHEN turn % 2 = 0 THEN conv_id || ':c' || turn ELSE conv_id || '-c' || turn END, '[-:]c[0-9]+$', '') AS base_id FROM conversations")
def ir15_base_ids(spark, d):
    """IR-15."""
    i = F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, ":c").otherwise("-c"), F.col("turn").cast("string"))
    return read(spark, d, "conversations").select(F.regexp_replace(i, "[-:]c[0-9]+$", "").alias("base_id")).distinct()


SEEDS = [("TS", "scum", 1.5), ("TS", "moron", 1.2), ("S1", "idiot", 1.0), ("S1", "License", 0.8), ("S2", "the ", 0.01), ("S3", "que ", 0.02), ("S3", " der ", 0.03)]
BOOSTS = [("TS", "password", 2.0), ("S1", "token", 1.0)]
_SCORE = {g: " + ".join([f"((length(text) - length(replace(text, '{k}', ''))) // {len(k)}) * {w}::DOUBLE" for x, k, w in SEEDS if x == g] + [f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w}::DOUBLE ELSE 0 END" for x, p, w in BOOSTS if x == g]) for g in grades.GRADES}


@query(f"""WITH s AS (SELECT doc_id, {", ".join(f"{e} AS {g.lower()}" for g, e in _SCORE.items())} FROM documents), t AS (SELECT *, ts + s1 + s2 + s3 AS total, greatest(ts, s1, s2, s3) AS top FROM s)
SELECT doc_id, CASE WHEN total = 0 THEN 'S3' WHEN ts = top THEN 'TS' WHEN s1 = top THEN 'S1' WHEN s2 = top THEN 'S2' ELSE 'S3' END AS grade, round(ts, 6) AS ts, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3 FROM t""")
def lab01_rules(spark, d):
    """LAB-01, LAB-02."""
    s = docs(spark, d).select("doc_id", lb.rule_scores(F.col("text"), SEEDS, BOOSTS).alias("s"))
    return s.select("doc_id", lb.rule_label(F.col("s"))["grade"].alias("grade"), *[F.round(F.get("s", F.lit(k))["score"], 6).alias(g.lower()) for k, g in enumerate(grades.GRADES)])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND n_chars % 3 = 2 THEN CASE WHEN 4 * (doc_id // 3 % 3) >= 4 THEN 'TS' ELSE 'S1' END WHEN (doc_id % 3) * (n_chars % 3) * (doc_id // 3 % 3) >= 1 THEN 'S2' ELSE 'S3' END AS grade FROM documents""")
def lab03_svm(spark, d):
    """LAB-03."""
    return docs(spark, d).select("doc_id", lb.svm_grade(F.col("doc_id") % 3, F.col("n_chars") % 3, F.floor(F.col("doc_id") / 3) % 3).alias("grade"))


@query(f"""WITH b AS (SELECT doc_id, pred AS c, doc_id % 5 = 0 AS public, doc_id % 3 = 0 AS managed FROM ({PRED})), l AS (SELECT *, CASE WHEN public OR c = 'S3' THEN 0 WHEN c IN ('TS', 'S1') THEN 2 ELSE 1 END AS s, CASE WHEN c = 'S3' THEN 0 WHEN c IN ('TS', 'S1') THEN 2 ELSE 1 END AS v, CASE WHEN managed THEN 2 WHEN c IN ('S3', 'S1') THEN 0 ELSE 1 END AS m FROM b),
g AS (SELECT *, CASE WHEN s = 2 AND v = 2 THEN CASE WHEN s * v * m >= 4 THEN 'TS' ELSE 'S1' END WHEN s * v * m >= 1 THEN 'S2' ELSE 'S3' END AS svm FROM l), f AS (SELECT *, CASE WHEN {ORDER_SQL.format('svm')} <= {ORDER_SQL.format('c')} THEN svm ELSE c END AS grade FROM g)
SELECT doc_id, grade, svm, CASE WHEN svm = grade THEN [s, v, m] WHEN grade = 'TS' THEN [2, 2, 2] WHEN grade = 'S1' THEN [2, 2, 0] WHEN grade = 'S2' THEN [1, 1, 1] ELSE [0, 0, 0] END[1]::INT * 100 + CASE WHEN svm = grade THEN [s, v, m] WHEN grade = 'TS' THEN [2, 2, 2] WHEN grade = 'S1' THEN [2, 2, 0] WHEN grade = 'S2' THEN [1, 1, 1] ELSE [0, 0, 0] END[2]::INT * 10 + CASE WHEN svm = grade THEN [s, v, m] WHEN grade = 'TS' THEN [2, 2, 2] WHEN grade = 'S1' THEN [2, 2, 0] WHEN grade = 'S2' THEN [1, 1, 1] ELSE [0, 0, 0] END[3]::INT AS levels FROM f""")
def lab03_guarded(spark, d):
    """LAB-03: the content guard, and the levels shown."""
    g = lb.guarded_grade(F.col("pred"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 == 0)
    return predictions(spark, d).select("doc_id", g.alias("g")).select("doc_id", "g.grade", "g.svm", (F.col("g.secrecy") * 100 + F.col("g.value") * 10 + F.col("g.management")).alias("levels"))


_L, _P = ORDER_SQL.format("label"), ORDER_SQL.format("pred")


@query(f"SELECT doc_id, CASE WHEN confidence < 0.3 AND {_P} < {_L} THEN pred ELSE label END AS merged FROM ({PRED})")
def lab04_merge(spark, d):
    """LAB-04, MSC-02."""
    return predictions(spark, d).select("doc_id", lb.merged_label(F.col("label"), F.col("confidence"), F.col("pred")).alias("merged"))


_V = "SELECT doc_id, ['TS', 'S1', 'S2', 'S3', 'bad'][(doc_id * k + k * k) % 5 + 1] AS vote FROM documents, (SELECT unnest([1, 2, 3, 4, 5]) AS k)"


@query(f"""WITH c AS (SELECT doc_id, vote, count(*) AS c FROM ({_V}) WHERE vote <> 'bad' GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, {ORDER_SQL.format('vote')}) AS rn FROM c)
SELECT doc_id, vote AS label, round(c / n::DOUBLE, 9) AS self_consistency, CAST(n AS BIGINT) AS n FROM r WHERE rn = 1""")
def lab05_votes(spark, d):
    """LAB-05."""
    k = F.explode(F.array(*[F.lit(x) for x in range(1, 6)])).alias("k")
    g = F.array(*[F.lit(x) for x in (*grades.GRADES, "bad")])
    v = docs(spark, d).select("doc_id", k).select("doc_id", F.element_at(g, ((F.col("doc_id") * F.col("k") + F.col("k") * F.col("k")) % 5 + 1).cast("int")).alias("vote"))
    return rounded(lb.majority(v, "doc_id", "vote"), "self_consistency")


_ASKED = "SELECT doc_id, k, CASE WHEN doc_id % 11 = 0 THEN 'bad' WHEN doc_id % 5 < 2 THEN ['TS', 'S2'][doc_id % 5 + 1] ELSE ['TS', 'S1', 'S2', 'S3', 'bad'][(doc_id * k + k * k) % 5 + 1] END AS vote FROM documents, (SELECT unnest([1, 2, 3, 4, 5]) AS k)"


@query(f"""WITH v AS ({_ASKED}), s AS (SELECT doc_id, count(DISTINCT CASE WHEN vote = 'bad' THEN '' ELSE vote END) > 1 AS split FROM v WHERE k <= 3 GROUP BY doc_id), a AS (SELECT v.*, split FROM v JOIN s USING (doc_id) WHERE k <= 3 OR split),
c AS (SELECT doc_id, vote, count(*) AS c FROM a WHERE vote <> 'bad' GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, {ORDER_SQL.format('vote')}) AS rn FROM c)
SELECT doc_id, coalesce(vote, 'S3') AS label, round(coalesce(c / n::DOUBLE, 0), 9) AS self_consistency, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(CASE WHEN split THEN 5 ELSE 3 END AS BIGINT) AS asked FROM s LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (doc_id)""")
def lab05_adaptive(spark, d):
    """LAB-05: three votes an item, two more where they differ; items without a valid vote come back as S3 with 0."""
    i, k = F.col("doc_id"), F.col("k")
    g = lambda *x: F.array(*[F.lit(v) for v in x])
    vote = F.when(i % 11 == 0, "bad").when(i % 5 < 2, F.element_at(g("TS", "S2"), (i % 5 + 1).cast("int"))).otherwise(F.element_at(g(*grades.GRADES, "bad"), ((i * k + k * k) % 5 + 1).cast("int")))
    return rounded(lb.adaptive_vote(docs(spark, d), "doc_id", lambda rows: rows.withColumn("vote", vote)), "self_consistency")


_SHADOW = "CASE WHEN doc_id % 3 = 0 THEN ['TS', 'S1', 'S2', 'S3'][doc_id % 4 + 1] END"


@query(f"""WITH b AS (SELECT doc_id, label AS rule, pred AS judge, confidence AS agreed, contains(text, 'the') AS evidence, {_SHADOW} AS shadow, doc_id % 6 = 0 AS airgap, (n_chars % 100) / 100.0::DOUBLE AS c, {_P} AS rank FROM ({PRED})),
t AS (SELECT *, (rule IN ('TS', 'S1') AND {ORDER_SQL.format('rule')} < rank) OR coalesce(shadow IN ('TS', 'S1') AND {ORDER_SQL.format('shadow')} < rank, FALSE) AS lowered, coalesce(shadow <> judge, FALSE) AS suspect, agreed < 0.67 AS low, airgap AND rank <= 2 AS lonely FROM b),
r AS (SELECT *, CASE WHEN lowered THEN 'ts_downgrade' WHEN NOT evidence THEN 'no_evidence' WHEN rule <> judge THEN 'disagree' WHEN low THEN 'low_agreement' WHEN lonely THEN 'airgap_upper' WHEN suspect THEN 'production_suspect' END AS reason FROM t)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'gold_candidate' ELSE 'needs_review_' || reason END AS status, CASE WHEN reason IS NULL THEN 'rule_llm_agreement' ELSE 'needs_review' END AS label_source, reason IS NULL AS is_gold,
array_to_string(list_filter([CASE WHEN lowered THEN 'ts_downgrade_suspect' END, CASE WHEN suspect THEN 'production_suspect' END, CASE WHEN low THEN 'low_agreement' END, CASE WHEN NOT evidence THEN 'no_evidence' END, CASE WHEN lonely THEN 'airgap_upper' END], lambda x: x IS NOT NULL), ',') AS flags,
round(CASE WHEN lowered THEN 100 ELSE 0 END + CASE WHEN rank <= 2 THEN 10 ELSE 0 END + CASE WHEN suspect THEN 5 ELSE 0 END + 2 * (1 - agreed) + (1 - c), 9) AS priority FROM r""")
def lab06_consensus(spark, d):
    """LAB-06, SRT-04."""
    i = F.col("doc_id")
    shadow = F.when(i % 3 == 0, F.element_at(F.array(*[F.lit(g) for g in grades.GRADES]), (i % 4 + 1).cast("int")))
    c = lb.consensus(F.col("label"), F.col("pred"), F.col("confidence"), F.contains("text", F.lit("the")), shadow, i % 6 == 0, (F.col("n_chars") % 100) / F.lit(100.0))
    out = predictions(spark, d).select("doc_id", c.alias("c"))
    return rounded(out.select("doc_id", "c.status", "c.label_source", "c.is_gold", F.array_join("c.flags", ",").alias("flags"), "c.priority"), "priority")


@query(f"""WITH m AS (SELECT doc_id, pred, ['top_secret', 'secret', 'confidential', 'none', ''][doc_id % 5 + 1] AS marking, ['approved_only', 'designated', 'department', 'all'][doc_id % 4 + 1] AS scope FROM ({PRED})),
f AS (SELECT *, CASE marking WHEN 'top_secret' THEN 'TS' WHEN 'secret' THEN 'S1' WHEN 'confidential' THEN 'S2' END AS floor FROM m)
SELECT doc_id, CASE WHEN floor IS NOT NULL AND {ORDER_SQL.format('floor')} < {_P} THEN floor ELSE pred END AS grade, floor IS NOT NULL AND {ORDER_SQL.format('floor')} < {_P} AS raised, marking IN ('', 'none') AND CASE scope WHEN 'approved_only' THEN {_P} > 2 WHEN 'designated' THEN {_P} > 3 WHEN 'department' THEN {_P} > 3 ELSE FALSE END AS conflict FROM f""")
def inf06_metadata_floor(spark, d):
    """INF-06: markings raise a grade; a restricted scope with a low grade is a conflict."""
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    m = lb.metadata_floor(F.col("pred"), at(("Top_Secret", " secret", "confidential", "none", ""), 5), at(("approved_only", "designated", "department", "all"), 4))
    return predictions(spark, d).select("doc_id", m.alias("m")).select("doc_id", "m.grade", "m.raised", "m.conflict")


_PROBS = "SELECT conv_id, length(text) AS w, ((turn * 37 + conv_id) % 100) / 100.0::DOUBLE AS p_ts, ((turn * 17 + conv_id) % 100) / 200.0::DOUBLE AS p_s1, ((turn * 7) % 100) / 100.0::DOUBLE AS p_s2 FROM conversations"


@query(f"""WITH a AS (SELECT conv_id, greatest(sum(p_ts * w) / sum(w), max(p_ts)) AS p_ts, greatest(sum(p_s1 * w) / sum(w), max(p_s1)) AS p_s1, sum(p_s2 * w) / sum(w) AS p_s2 FROM ({_PROBS}) GROUP BY conv_id)
SELECT conv_id, round(p_ts, 9) AS p_ts, round(p_s1, 9) AS p_s1, round(p_s2, 9) AS p_s2, CASE WHEN p_ts >= 0.6 THEN 'TS' WHEN p_s1 >= 0.6 THEN 'S1' WHEN p_ts >= p_s1 AND p_ts >= p_s2 AND p_ts >= 0.1 THEN 'TS' WHEN p_s1 >= p_s2 AND p_s1 >= 0.1 THEN 'S1' WHEN p_s2 >= 0.1 THEN 'S2' ELSE 'S3' END AS grade FROM a""")
def inf01_chunk_aggregation(spark, d):
    """INF-01, INF-02."""
    c = F.col
    p = read(spark, d, "conversations").select("conv_id", F.length("text").alias("w"), (((c("turn") * 37 + c("conv_id")) % 100) / F.lit(100.0)).alias("p_ts"), (((c("turn") * 17 + c("conv_id")) % 100) / F.lit(200.0)).alias("p_s1"), (((c("turn") * 7) % 100) / F.lit(100.0)).alias("p_s2"))
    a = lb.chunk_probabilities(p, "conv_id", "w", ["p_ts", "p_s1", "p_s2"])
    return rounded(a.withColumn("grade", lb.escalated([c("p_ts"), c("p_s1"), c("p_s2"), F.lit(0.1)], 0.6)), "p_ts", "p_s1", "p_s2")


_OV, _OV1, _OV2 = (f"((doc_id * {k}) % 40) / 10.0::DOUBLE" for k in (13, 7, 3))


@query(f"""WITH o AS (SELECT *, {_OV} AS s, CASE WHEN {_OV} >= 3.0 THEN 'TS' WHEN {_OV1} >= 2.2 THEN 'S1' WHEN {_OV2} >= 1.6 THEN 'S2' END AS ruled FROM ({PRED})), r AS (SELECT *, CASE WHEN ruled IS NOT NULL AND {ORDER_SQL.format('ruled')} < {_P} THEN ruled ELSE pred END AS g, source IN ('src7', 'src12') AS public FROM o)
SELECT doc_id, CASE WHEN public THEN 'S3' ELSE g END AS grade, CASE WHEN public THEN least(confidence, 0.7::DOUBLE) ELSE confidence END AS confidence, public AND g IN ('TS', 'S1') AS conflict,
CASE WHEN CASE WHEN public THEN least(confidence, 0.7::DOUBLE) ELSE confidence END < 0.7 OR (public AND g IN ('TS', 'S1')) OR (s > 0 AND s < 0.9) THEN 'needs_review' ELSE 'staging' END AS status FROM r""")
def inf08_routing(spark, d):
    """INF-04, 05, 07, 08."""
    s, s1, s2 = (((F.col("doc_id") * k) % 40) / F.lit(10.0) for k in (13, 7, 3))
    p = predictions(spark, d).withColumn("s", s).withColumn("g", lb.overridden(F.col("pred"), s, s1, s2))
    p = p.withColumn("c", lb.capped_public(F.col("g"), F.col("confidence"), F.col("source").isin("src7", "src12")))
    r = lb.routed(F.col("c.confidence"), F.col("c.conflict"), (F.col("s") > 0) & (F.col("s") < 0.9))
    return p.select("doc_id", "c.grade", "c.confidence", "c.conflict", r["status"].alias("status"))


@query(f"""WITH l AS (SELECT *, CASE source WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 99 END AS p FROM ({GOLD})) SELECT domain, doc_id, label, source AS label_source FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY p, doc_id) AS rn FROM l) WHERE rn = 1""")
def inf09_label_reuse(spark, d):
    """INF-09."""
    return lb.reused_label(gold(spark, d).withColumn("label_source", F.col("source")), "domain", {"src1": 1, "src2": 2}).select("domain", "doc_id", "label", "label_source")


@query("""WITH r AS (SELECT embedding[1]::DOUBLE * 8 AS a, embedding[2]::DOUBLE * 8 AS b, embedding[3]::DOUBLE * 8 AS c, label % 3 AS t FROM embeddings), g AS (SELECT unnest(list_append(list_transform(range(201), lambda k: 0.05::DOUBLE + 0.05::DOUBLE * k), 1.0::DOUBLE)) AS temperature),
x AS (SELECT temperature, avg(-ln(greatest(CASE t WHEN 0 THEN exp((a - m) / temperature) WHEN 1 THEN exp((b - m) / temperature) ELSE exp((c - m) / temperature) END / (exp((a - m) / temperature) + exp((b - m) / temperature) + exp((c - m) / temperature)), 1e-12))) AS nll FROM (SELECT *, greatest(a, b, c) AS m FROM r), g GROUP BY temperature)
SELECT round(arg_min(temperature, round(nll, 9)), 9) AS temperature, round(min(nll), 6) AS nll FROM x""")
def inf10_temperature(spark, d):
    """INF-10: the temperature of least mean loss on a fixed grid."""
    e = read(spark, d, "embeddings")
    logits = F.array(*[F.get("embedding", F.lit(k)).cast("double") * 8 for k in range(3)])
    return rounded(lb.best_temperature(e.select(logits.alias("l"), (F.col("label") % 3).alias("t")), "l", "t"), "temperature")
