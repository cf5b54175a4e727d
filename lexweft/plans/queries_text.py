"""Queries of text functions, abbreviations, extraction, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abbrev as A
from ..functions import fixed
from ..functions import text as X
from ..functions.answers import answers_in_reasoning, parse_expansions
from ..operators import disambiguate as D
from ..operators import extract as E
from . import tables as T

SAMPLES = ["TNF-α", "Crohn's disease", "Type II diabetes", "seizures", "aspirin (oral)", "non-small cell", "loss", "  wide   gap ", "β-blocker's II", "virus", "IX XII iv", "(NOS)"]


def _texts(spark, d) -> DataFrame:
    names = T.table(spark, d, "part").select("p_name").distinct().select(F.explode(F.array("p_name", F.concat("p_name", F.lit("'s II")), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("s (new)")))).alias("text"))
    return names.union(spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SAMPLES]))))


_TEXTS = "texts AS (SELECT unnest([p_name, p_name || '''s II', replace(p_name, ' ', '-') || 's (new)']) AS text FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT unnest([" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES) + "]))"


def variants_explode(spark, d) -> DataFrame:
    return _texts(spark, d).select("text", F.posexplode(X.variants("text")).alias("place", "variant"))


def normalise_mentions(spark, d) -> DataFrame:
    return _texts(spark, d).select("text", X.normalise("text").alias("normal"), F.array_join(X.label_tokens("text"), " ").alias("tokens"), F.array_join(X.significant_words("text"), " ").alias("words"))


def abbrev_likely(spark, d) -> DataFrame:
    p = T.table(spark, d, "part").select("p_brand", "p_type", F.upper(F.substring("p_name", 1, 3)).alias("short")).distinct()
    forms = p.select(F.explode(F.array("p_brand", "p_type", "short", F.lower("short"), F.concat("short", F.lit("s")), F.concat(F.lower("short"), F.lit("9x")))).alias("text")).union(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("ALL", "T2DM", "x", "CASE", "interleukins", "IL-2", "aB")]))))
    return forms.distinct().select("text", X.likely_abbreviation("text").alias("likely"))


def _defined(spark, d) -> DataFrame:
    p = T.part_labels(spark, d)
    w = F.split("label", " ")
    short = F.upper(F.concat(F.substring(w[0], 1, 1), F.substring(w[1], 1, 1), F.lit("X")))
    return p.select(F.col("entity_id").alias("doc_id"), F.concat(F.lit("We saw a "), "label", F.lit(" xylem ("), short, F.lit(") again. Then ("), F.reverse(short), F.lit(") "), F.lit("xylem "), w[1], F.lit(" "), w[0], F.lit(" came.")).alias("text"), short.alias("short"))


def abbrev_extract(spark, d) -> DataFrame:
    return A.extract_abbreviations(_defined(spark, d))


def abbrev_expand(spark, d) -> DataFrame:
    docs = _defined(spark, d)
    m = docs.select(F.col("doc_id").alias("mention_id"), "doc_id", F.explode(F.array("short", F.concat("short", F.lit("s")), F.lit("COPD"), F.lit("all"))).alias("mention"))
    return A.expand_mentions(m, A.extract_abbreviations(docs)).select("mention_id", "mention", "expansion")


def mention_extract(spark, d) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    return E.extract(docs)


def _context(spark, d) -> DataFrame:
    c = T.table(spark, d, "conversations").filter("text IS NOT NULL")
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 4)
    return c.select("conv_id", "turn", "text", F.coalesce(F.try_element_at(words, F.lit(3)), F.lit("zzz")).alias("mention"))


_CONTEXT = "c AS (SELECT conv_id, turn, text, coalesce([w FOR w IN string_split(text, ' ') IF length(w) > 4][3], 'zzz') AS mention FROM conversations WHERE text IS NOT NULL)"


def mention_window(spark, d) -> DataFrame:
    return _context(spark, d).select("conv_id", "turn", X.mention_window("text", "mention", 1).alias("found"))


def sentence_snippet(spark, d) -> DataFrame:
    return _context(spark, d).select("conv_id", "turn", X.sentence_snippet("text", "mention").alias("snippet"))


def offset_snippet(spark, d) -> DataFrame:
    c = _context(spark, d).withColumn("s", (F.instr("text", F.col("mention")) - 1).cast("int")).filter("s >= 0")
    return c.select("conv_id", "turn", X.offset_snippet("text", F.col("s"), F.col("s") + F.length("mention"), 80).alias("snippet"))


def expansion_prompts(spark, d) -> DataFrame:
    return _context(spark, d).select("conv_id", "turn", X.expansion_prompt("mention", "text", F.lit("A title")).alias("prompt"))


def _candidates(spark, d) -> DataFrame:
    p = T.table(spark, d, "part")
    trees = F.array(F.concat(F.element_at(F.array(*[F.lit(x) for x in "CDBZ"]), (F.col("p_size") % 4 + 1).cast("int")), F.lpad(F.col("p_size").cast("string"), 2, "0")))
    return p.select((F.col("p_partkey") - F.col("p_partkey") % 4).alias("mention_id"), (F.col("p_partkey") % 4 + 1).cast("int").alias("rank"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("preferred_label"), trees.alias("tree_numbers"), F.concat("p_type", F.lit(" part "), F.repeat("p_brand", 20)).alias("definition"), F.array(F.upper("p_name"), "p_brand", "p_type").alias("synonyms"), F.col("p_retailprice").alias("score"))


_PROMPT_ROWS = """c AS (SELECT p_partkey - p_partkey % 4 AS mention_id, CAST(p_partkey % 4 + 1 AS INTEGER) AS rank, p_partkey AS entity_id, p_name, p_retailprice,
  ['Diseases', 'Chemicals and Drugs', 'Organisms', 'Z'][p_size % 4 + 1] AS cat, p_type || ' part ' || repeat(p_brand, 20) AS def, p_brand, p_type FROM part)"""


def prompt_build(spark, d) -> DataFrame:
    m = T.table(spark, d, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"), F.concat(F.lit("First one. A "), "p_name", F.lit(" here! Last?")).alias("context"), F.when(F.col("p_size") > 25, F.lit("A title")).alias("title"))
    return D.prompts(_candidates(spark, d), m, 3).select("mention_id", "prompt", "n")


def _answers(spark, d) -> DataFrame:
    p = T.table(spark, d, "part").filter("p_partkey % 4 = 0")
    forms = ["'NONE'", "concat('<think>maybe 2\n</think>\n', p_size % 6)", "concat('I think 3 is good\nAnswer: ', p_size % 6)", "concat('options 1 and 2\nthe last says ', 99)", "'no number'", "concat('**', p_size % 6, '**')", "'2\n\nNONE'"]
    pick = F.expr(f"element_at(array({', '.join(forms)}), cast(p_partkey / 4 % {len(forms)} + 1 as int))")
    return p.select(F.col("p_partkey").alias("mention_id"), pick.alias("answer"), F.lit(4).cast("long").alias("n"))


_ANSWERS = r"""a AS (SELECT p_partkey AS mention_id, ['NONE', '<think>maybe 2' || chr(10) || '</think>' || chr(10) || (p_size % 6), 'I think 3 is good' || chr(10) || 'Answer: ' || (p_size % 6), 'options 1 and 2' || chr(10) || 'the last says ' || 99, 'no number', '**' || (p_size % 6) || '**', '2' || chr(10) || chr(10) || 'NONE'][CAST(p_partkey // 4 % 7 + 1 AS INTEGER)] AS answer FROM part WHERE p_partkey % 4 = 0),
s AS (SELECT mention_id, answer, trim(regexp_replace(answer, '<think>.*?</think>', '', 's'), chr(10) || ' ') AS t FROM a),
l AS (SELECT *, TRY_CAST(regexp_extract(string_split(t, chr(10))[-1], '\b(\d+)\b', 1) AS INTEGER) AS f, TRY_CAST(regexp_extract_all(t, '\b(\d+)\b', 1)[-1] AS INTEGER) AS g FROM s),
ch AS (SELECT mention_id, CASE WHEN upper(t) = 'NONE' THEN NULL ELSE coalesce(CASE WHEN f BETWEEN 1 AND 4 THEN f END, CASE WHEN g BETWEEN 1 AND 4 THEN g END) END AS choice FROM l)"""


def llm_parse(spark, d) -> DataFrame:
    return _answers(spark, d).select("mention_id", F.coalesce(X.choice("answer", F.col("n").cast("int")), F.lit(0)).alias("choice"))


def llm_decide(spark, d) -> DataFrame:
    c = _candidates(spark, d).select("mention_id", "rank", "entity_id")
    return D.decide(_answers(spark, d), c)


def _reads_the_number_of_words():
    return lambda prompt: str(len(prompt.split()) % 3 + 1)


def llm_disambiguate_fake(spark, d) -> DataFrame:
    rows = prompt_build(spark, d)
    c = _candidates(spark, d)
    chosen = D.decide(D.ask(rows, _reads_the_number_of_words), c.select("mention_id", "rank", "entity_id"))
    return chosen.join(c.select("mention_id", F.col("rank").alias("chosen_rank"), "preferred_label"), ["mention_id", "chosen_rank"])


def answer_cleaning(spark, d) -> DataFrame:
    n = T.table(spark, d, "part").select("p_name").distinct()
    forms = [F.col("p_name"), F.concat(F.lit("<think>x</think>\n**"), "p_name", F.lit("**.")), F.concat(F.lit("RB stands for "), "p_name", F.lit(".")), F.concat(F.lit("Let me see.\nThe expansion is: "), "p_name"), F.lit("UNKNOWN."), F.concat(F.lit('"'), "p_name", F.lit('"'))]
    a = n.select("p_name", F.posexplode(F.array(*forms)).alias("form", "answer"))
    return a.select("p_name", "form", parse_expansions("answer").alias("expansion"), answers_in_reasoning("answer").alias("reasoned"))


def _fake_expander():
    return lambda prompt: f"It stands for long {prompt.rsplit(': ', 1)[1].lower()} form"


def llm_abbreviations(spark, d) -> DataFrame:
    m = _defined(spark, d).select(F.col("doc_id").alias("mention_id"), F.col("short").alias("mention"), F.col("text").alias("context"), F.lit("T").alias("title"))
    r = D.expand_abbreviations(m, _fake_expander)
    return D.call_statistics(m, r)


QUERIES = {
    f.__name__: f
    for f in (variants_explode, normalise_mentions, abbrev_likely, abbrev_extract, abbrev_expand, mention_extract, mention_window, sentence_snippet, offset_snippet, expansion_prompts, prompt_build, llm_parse, llm_decide, llm_disambiguate_fake, answer_cleaning, llm_abbreviations)
}

_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _greek_sql(x: str) -> str:
    for k, v in fixed.GREEK.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


def _roman_sql(x: str) -> str:
    for r in sorted(fixed.ROMAN, key=lambda r: (-len(r), r)):
        x = rf"regexp_replace({x}, '\b{r}\b', '{fixed.ROMAN[r]}', 'g')"
    return x


_PAREN = r"regexp_replace({0}, '\s*\([^)]{{1,20}}\)\s*$', '')"
_BARE = "CASE WHEN trim(" + _PAREN + ") = '' THEN {0} ELSE trim(" + _PAREN + ") END"
_POSS = r"regexp_replace({}, '''s\b', '', 'g')"
_LIST = ", ".join(f"'{w}'" for w in fixed.MENTION_STOPWORDS)
_SHORT = ", ".join(f"'{w}'" for w in fixed.COMMON_SHORT)

_IN = lambda x, words: f"{x} IN ({', '.join(chr(39) + w + chr(39) for w in words)})"
_MENTIONS = rf"""WITH l AS (SELECT doc_id, text, regexp_extract_all(text, '\s*(?:\d+(?:\.\d+)?|[\p{{L}}\p{{M}}\p{{N}}]+(?:''[\p{{L}}]+)?|[^\s])') AS l FROM documents),
r AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM l),
w AS (SELECT *, ltrim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS w FROM r),
s AS (SELECT *, sum(length(raw)) OVER d - length(w) AS start, lower(w) AS lo, coalesce(lag(w) OVER d IN ('.', '!', '?') AND length(raw) > length(w), false) AS e FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT *, sum(CAST(e AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sent, {_IN('lo', [*fixed.STOPWORDS, *fixed.ADPOSITIONS, *fixed.DETERMINERS, *fixed.OTHER_STOPWORDS])} AS stop, {_IN('lo', fixed.ADPOSITIONS)} OR {_IN('lo', fixed.DETERMINERS)} AS link,
 {_IN('lo', fixed.VERBS)} OR (regexp_matches(lo, '(ing|ed)$') AND length(w) > 4) AS verb, regexp_full_match(w, '[0-9.,]*[0-9][0-9.,]*') AS num, regexp_full_match(w, '\p{{P}}') AS punct FROM s),
c AS (SELECT *, NOT punct AND NOT stop AND (link OR NOT verb) AS c0 FROM t),
h AS (SELECT *, c0 OR (w = '-' AND coalesce(lag(c0) OVER d, false) AND coalesce(lead(c0) OVER d, false)) AS c FROM c WINDOW d AS (PARTITION BY doc_id, sent ORDER BY i)),
g AS (SELECT *, sum(CAST(NOT c AS INTEGER)) OVER d AS run, sum(CAST(stop AND link AS INTEGER)) OVER d AS links FROM h WINDOW d AS (PARTITION BY doc_id, sent ORDER BY i)),
sp AS (SELECT doc_id, sent, run, min(i) AS first, max(i) AS last, min(start) AS start, max(start + length(w)) AS stop, min(links) AS links, bool_and(num OR w = '-') AS bare FROM g WHERE c GROUP BY 1, 2, 3),
j AS (SELECT *, first - lag(last) OVER d - 1 AS gap, links - lag(links) OVER d AS li FROM sp WINDOW d AS (PARTITION BY doc_id, sent ORDER BY first)),
k AS (SELECT *, sum(CAST(NOT coalesce(gap BETWEEN 1 AND 3 AND li = gap, false) AS INTEGER)) OVER (PARTITION BY doc_id, sent ORDER BY first) AS grp FROM j),
m AS (SELECT doc_id, min(start) AS a, max(stop) AS b FROM k GROUP BY doc_id, sent, grp HAVING NOT bool_and(bare) OR count(*) > 1)
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS mention FROM m JOIN l USING (doc_id)"""

ORACLES = {
    "mention_extract": _MENTIONS,
    "variants_explode": f"""WITH {_TEXTS}, f AS (SELECT text, [text, {_greek_sql('text')}, {_POSS.format('text')}, {_BARE.format('text')},
 CASE WHEN contains(text, '-') THEN replace(text, '-', '') END, CASE WHEN contains(text, '-') THEN replace(text, '-', ' ') END,
 CASE WHEN length(lower(trim(text))) > 3 AND lower(trim(text)) LIKE '%s' AND NOT regexp_matches(lower(trim(text)), '(ss|is|us)$') THEN left(text, -1) END, {_roman_sql('text')}] AS v FROM texts),
c AS (SELECT text, [x FOR x IN list_transform([y FOR y IN v IF y IS NOT NULL], lambda y: {_WS.format('y')}) IF x <> ''] AS v FROM f),
u AS (SELECT text, [v[i] FOR i IN range(1, len(v) + 1) IF NOT list_contains(v[1:i - 1], v[i])] AS v FROM c)
SELECT text, CAST(unnest(range(0, len(v))) AS INTEGER) AS place, unnest(v) AS variant FROM u""",
    "normalise_mentions": f"""WITH {_TEXTS}, g AS (SELECT text, {_greek_sql('text')} AS g FROM texts), b AS (SELECT text, {_BARE.format('g')} AS b FROM g)
SELECT text, {_WS.format(_POSS.format('b'))} AS normal, array_to_string([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9]+') IF length(x) >= 2], ' ') AS tokens,
 array_to_string([x FOR x IN regexp_split_to_array(lower(trim(text)), '\\s+') IF length(x) >= 3 AND x NOT IN ({_LIST})], ' ') AS words FROM b""",
    "abbrev_likely": f"""WITH p AS (SELECT DISTINCT p_brand, p_type, upper(left(p_name, 3)) AS s FROM part), f AS (SELECT DISTINCT text FROM (SELECT unnest([p_brand, p_type, s, lower(s), s || 's', lower(s) || '9x']) AS text FROM p UNION ALL SELECT unnest(['ALL', 'T2DM', 'x', 'CASE', 'interleukins', 'IL-2', 'aB'])))
SELECT text, length(text) BETWEEN 2 AND 10 AND lower(text) NOT IN ({_SHORT}) AND (length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) >= 0.5 OR (length(text) > 4 AND regexp_matches(text, '[0-9]'))) AS likely FROM f""",
    "mention_window": f"""WITH {_CONTEXT}, s AS (SELECT conv_id, turn, text, mention, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM c),
i AS (SELECT *, list_position(list_transform(s, lambda x: contains(lower(x), lower(mention))), true) AS i FROM s),
w AS (SELECT *, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS w FROM i),
h AS (SELECT *, CASE WHEN i IS NULL THEN instr(text, mention) ELSE instr(lower(w), lower(mention)) END AS p, CASE WHEN i IS NULL THEN text ELSE w END AS x FROM w)
SELECT conv_id, turn, CASE WHEN p > 0 THEN left(x, p - 1) || '**' || substr(x, p, length(mention)) || '**' || substr(x, p + length(mention)) ELSE x END AS found FROM h""",
    "sentence_snippet": f"""WITH {_CONTEXT}, p AS (SELECT *, instr(lower(text), lower(mention)) AS p FROM c),
k AS (SELECT *, substr(text, greatest(p - 101, 0) + 1, least(length(text), p - 1 + length(mention) + 100) - greatest(p - 101, 0)) AS k FROM p),
f AS (SELECT *, CASE WHEN instr(k, '. ') > 1 AND instr(k, '. ') - 1 < length(k) // 3 THEN substr(k, instr(k, '. ') + 2) ELSE k END AS f FROM k),
l AS (SELECT *, length(f) - instr(reverse(f), ' .') - 1 AS l FROM f)
SELECT conv_id, turn, CASE WHEN p = 0 THEN left(text, 200) ELSE trim(CASE WHEN instr(f, '. ') > 0 AND l > length(f) * 2 // 3 THEN left(f, l + 1) ELSE f END) END AS snippet FROM l""",
    "offset_snippet": f"""WITH {_CONTEXT}, p AS (SELECT *, instr(text, mention) - 1 AS s, length(mention) AS n FROM c WHERE instr(text, mention) > 0),
k AS (SELECT *, greatest(s - 80, 0) AS lo, substr(text, greatest(s - 80, 0) + 1, least(length(text), s + n + 80) - greatest(s - 80, 0)) AS k FROM p),
f AS (SELECT *, left(k, s - lo) AS pre, s - lo + n AS tail FROM k),
g AS (SELECT *, CASE WHEN instr(pre, '. ') > 0 THEN substr(k, length(pre) - instr(reverse(pre), ' .') + 2) ELSE k END AS cut FROM f)
SELECT conv_id, turn, trim(CASE WHEN instr(substr(cut, tail + 1), '. ') > 0 THEN left(cut, tail + instr(substr(cut, tail + 1), '. ')) ELSE cut END) AS snippet FROM g""",
    "expansion_prompts": f"""WITH {_CONTEXT}, p AS (SELECT *, instr(lower(text), lower(mention)) - 1 AS p, length(mention) AS n FROM c),
s AS (SELECT *, greatest(p - 150, 0) AS lo, least(length(text), p + n + 150) AS hi FROM p)
SELECT conv_id, turn, '/no_think' || chr(10) || chr(10) || 'Title: A title' || CASE WHEN text = '' THEN '' ELSE chr(10) || 'Context: ' || CASE WHEN p >= 0 THEN CASE WHEN lo > 0 THEN '...' ELSE '' END || trim(substr(text, lo + 1, hi - lo)) || CASE WHEN hi < length(text) THEN '...' ELSE '' END ELSE left(text, 300) || '...' END END || chr(10) || 'Abbreviation: ' || mention AS prompt FROM s""",
    "prompt_build": f"""WITH {_PROMPT_ROWS},
b AS (SELECT mention_id, count(*) AS n, string_agg(rank || '. **' || p_name || '** [' || entity_id || ']' || chr(10) || '   Category: ' || cat || chr(10) || '   Definition: ' || CASE WHEN length(def) > 150 THEN left(def, 150) || '...' ELSE def END || chr(10) || '   Synonyms: ' || p_brand || ', ' || p_type || chr(10) || '   Match score: ' || printf('%.1f', p_retailprice) || chr(10), chr(10) ORDER BY rank) AS c FROM c WHERE rank <= 3 GROUP BY 1)
SELECT mention_id, '## Biomedical Text' || chr(10) || CASE WHEN p_size > 25 THEN '**Title:** A title' || chr(10) ELSE '' END || '**Text:** First one. A ' || p_name || ' here! Last?' || chr(10) || chr(10) || '## Mention to Link: "' || p_name || '"' || chr(10) || '**Context window:** First one. A **' || p_name || '** here! Last?' || chr(10) || chr(10) || '## Candidates' || chr(10) || c || chr(10) || 'Which candidate best matches the mention in the given context? Reply with ONLY the number.' AS prompt, n
FROM b JOIN part ON p_partkey = mention_id""",
    "llm_parse": f"WITH {_ANSWERS} SELECT mention_id, coalesce(choice, 0) AS choice FROM ch",
    "llm_decide": f"WITH {_ANSWERS} SELECT mention_id, mention_id + coalesce(choice, 1) - 1 AS entity_id, CAST(coalesce(choice, 1) AS INTEGER) AS chosen_rank, CASE WHEN choice IS NULL THEN 'fallback' ELSE 'llm' END AS confidence FROM ch JOIN part ON p_partkey = mention_id + coalesce(choice, 1) - 1",
}
_SHORTS = f"WITH {T.KB}, k AS (SELECT entity_id, label, split_part(label, ' ', 1) AS a, split_part(label, ' ', 2) AS b FROM kb), s AS (SELECT *, upper(left(a, 1) || left(b, 1) || 'X') AS short FROM k)"
ORACLES["abbrev_extract"] = f"""{_SHORTS}
SELECT entity_id AS doc_id, short AS short_upper, short, label || ' xylem' AS expansion, 'parenthetical' AS confidence FROM s
UNION ALL SELECT entity_id, reverse(short), reverse(short), 'xylem ' || b || ' ' || a, 'reverse_parenthetical' FROM s"""
ORACLES["abbrev_expand"] = f"""{_SHORTS}
SELECT entity_id AS mention_id, short AS mention, label || ' xylem' AS expansion FROM s UNION ALL SELECT entity_id, short || 's', label || ' xylem' FROM s
UNION ALL SELECT entity_id, 'COPD', 'chronic obstructive pulmonary disease' FROM s UNION ALL SELECT entity_id, 'all', NULL FROM s"""
ORACLES["llm_abbreviations"] = f"""{_SHORTS}
SELECT count(DISTINCT short) AS calls, count(*) - count(DISTINCT short) AS cached, count(DISTINCT short) AS expanded, CAST(0 AS BIGINT) AS failed FROM s"""
#: By form: what the answer means, and what its last line says.
ORACLES["answer_cleaning"] = """WITH n AS (SELECT DISTINCT p_name FROM part), f AS (SELECT p_name, CAST(unnest(range(0, 6)) AS INTEGER) AS form FROM n)
SELECT p_name, form, CASE form WHEN 3 THEN 'Let me see' WHEN 4 THEN NULL ELSE p_name END AS expansion,
 CASE form WHEN 1 THEN '<think>x</think>' WHEN 3 THEN 'The expansion is: ' || p_name WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN '"' || p_name || '"' ELSE p_name END AS reasoned FROM f"""
ORACLES["llm_disambiguate_fake"] = f"""WITH p AS ({ORACLES["prompt_build"]}), a AS (SELECT mention_id, n, len(regexp_extract_all(prompt, '[^\\s]+')) % 3 + 1 AS c FROM p)
SELECT mention_id, p_partkey AS entity_id, CAST(CASE WHEN c <= n THEN c ELSE 1 END AS INTEGER) AS chosen_rank, CASE WHEN c <= n THEN 'llm' ELSE 'fallback' END AS confidence, p_name AS preferred_label
FROM a JOIN part ON p_partkey = mention_id + CASE WHEN c <= n THEN c ELSE 1 END - 1"""
