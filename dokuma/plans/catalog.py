"""All core queries with the SQL that gives the same rows.

A query without SQL is one that SQL can't say (reversible masks, greedy phrase merging, fitted models) or where the two
engines' primitives differ; those are tested against brute force in tests/.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, masks
from ..operators import corpus, evaluate, features, graph, normalize, records, sentences, stem, tokenize
from ..session import spread, table
from ..sources import readers
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__.strip("_")] = f
        if sql:
            _SQL[f.__name__.strip("_")] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL pieces -------------------------------------------------------------------------------------------------------


def _trl(x: str) -> str:
    return f"lower(translate({x}, 'İIÜŞÖÇĞ', 'iıüşöçğ'))"


def _ii(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def _plain(x: str) -> str:
    return f"translate({x}, '{chars.MARKED}', '{chars.PLAIN}')"


def _upper_first(x: str) -> str:
    g = lambda k: rf"regexp_extract({x}, '(?s)^(\P{{L}}*)(\p{{L}})(.*)$', {k})"
    return rf"case when regexp_matches({x}, '\p{{L}}') then {g(1)} || upper(translate({g(2)}, 'iı', 'İI')) || {g(3)} else {x} end"


def _compatibility() -> str:
    """Map literal of the characters whose compatibility form is another one; composition is left to nfc_normalize."""
    pairs = [(chr(i), n) for i in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F252)) if (n := unicodedata.normalize("NFKC", chr(i))) != chr(i)]
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return f"map([{', '.join(text(a) for a, _ in pairs)}], [{', '.join(text(b) for _, b in pairs)}])"


_FORMS = f"(select {_compatibility()} as m)"


def _nfkc(rows: str, *columns: str) -> str:
    """The rows with columns in NFKC; texts of usual characters pass."""
    each = lambda c: f"case when regexp_matches({c}, '[^\\x00-\\x7FçğıöşüÇĞİÖŞÜ]') then nfc_normalize(array_to_string(list_transform(string_split({c}, ''), lambda c: coalesce(m[c], c)), '')) else {c} end as {c}"
    return f"(select * exclude (m) replace ({', '.join(map(each, columns))}) from {rows}, {_FORMS})"


_LOWJ = lambda x: f"lower(replace({x}, 'İ', 'i' || chr(775)))"
_WS = r"[\s\x0b\x{85}\p{Z}]+"
_WST = lambda x: f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda t: t <> '')"
_SAN = lambda x: f"replace(translate({x}, chr(8217)||chr(8216)||chr(8220)||chr(8221)||chr(8211)||chr(8212)||chr(160)||chr(8203)||chr(8204)||chr(8205)||chr(65279), chr(39)||chr(39)||'\"\"-- '), chr(8230), '...')"
_CONLLU = "(select distinct * from conllu_tokens where form is not null and id is not null)"
_TOKENS = "(select distinct t as token from (select unnest(gold_tokens) as t from examples) where t is not null and t <> '')"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "examples").select(F.explode("gold_tokens").alias("token"))
    return t.where("token is not null and token <> ''").distinct()


def _conllu(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conllu_tokens").where("form is not null and id is not null").distinct()


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Treebank rows as (ex_id, sentence, pos, token)."""
    t = _conllu(spark, d).groupBy("ex_id", "id").agg(F.min("form").alias("token"))
    return t.select("ex_id", F.lit(0).alias("sentence"), F.col("id").alias("pos"), "token")


_SENT = "(select ex_id, id as pos, min(form) as token from conllu_tokens where form is not null and id is not null group by ex_id, id)"


# problem 6 --------------------------------------------------------------------------------------------------------


_ROWS = "(" + " union all ".join(
    f"""select line_id, regexp_full_match(line, '(?s)("(?:[^"]|"")*"|[^"{x}]*)({x}("(?:[^"]|"")*"|[^"{x}]*))*') as well, regexp_extract_all({y} || line, '(?s){x}("(?:[^"]|"")*"|[^"{x}]*)', 1) as cells
    from (select line_id, delim, regexp_replace(line, '\\r$', '') as line from raw_records where line is not null) where delim = {y}"""
    for x, y in ((",", "','"), (";", "';'"), ("\\t", "chr(9)"))
) + ")"
_CELLS = f"(select line_id, well, list_transform(cells, lambda c: case when starts_with(c, '\"') then replace(substr(c, 2, length(c) - 2), '\"\"', '\"') else c end) as c from {_ROWS})"
_REASON = rf"""(select line_id, c, case when not well then 'quoting' when len(c) <> 7 then 'column_count' when c[2] not in ('boun', 'iwt') or c[3] not in ('train', 'dev', 'test') or regexp_full_match(c[4], '[\s\p{{Z}}]*')
    or not regexp_full_match(c[6], '[0-9]+') or not regexp_full_match(c[7], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(c[7] as date) is null or contains(array_to_string(c, ''), chr(65533)) then 'value' end as reason from {_CELLS})"""


@query(f"select line_id, reason from {_REASON} where reason is not null")
def p6_found(spark, d):
    return records.found(table(spark, d, "raw_records"))


@query(
    f"""select line_id, nullif(c[1], '') as sent_id, c[2] as domain, c[3] as split, c[4] as raw_text, nullif(c[5], '') as gold_text, cast(c[6] as bigint) as n_tokens, cast(c[7] as date) as created_on from {_REASON} where reason is null"""
)
def p6_typed(spark, d):
    return records.typed(table(spark, d, "raw_records"))


# characters -------------------------------------------------------------------------------------------------------


@query(
    f"select ex_id, {_trl('raw_text')} as lower_tr, {_ii('raw_text')} as lower_ii, replace(lower(translate(raw_text, 'İ', 'i')), 'ß', 'ss') as folded from examples"
)
def tr_lower(spark, d):
    c = F.col("raw_text")
    return table(spark, d, "examples").select("ex_id", chars.tr_lower(c).alias("lower_tr"), chars.tr_lower(c, "ii").alias("lower_ii"), chars.tr_lower(c, "casefold").alias("folded"))


@query(f"select ex_id, {_upper_first('raw_text')} as capitalised from examples")
def upper_first(spark, d):
    return table(spark, d, "examples").select("ex_id", chars.tr_upper_first(F.col("raw_text")).alias("capitalised"))


@query(f"select doc_id, {_plain('text')} as plain from documents")
def strip_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", chars.strip_diacritics(F.col("text")).alias("plain"))


@query(f"select ex_id, {_SAN('raw_text')} as sanitized, trim(regexp_replace({_SAN('raw_text')}, '{_WS}', ' ', 'g')) as compact from examples")
def sanitize(spark, d):
    s = chars.sanitize(F.col("raw_text"))
    return table(spark, d, "examples").select("ex_id", s.alias("sanitized"), chars.compact_ws(s).alias("compact"))


_TIGHT = r"regexp_replace(raw_text, '\s*''\s*', '''', 'g')"


@query(
    rf"""select ex_id, regexp_replace(regexp_replace({_TIGHT}, '([,!?;:])([^\s"])', '\1 \2', 'g'), '\.([^\s".])', '. \1', 'g') as spaced, regexp_replace({_TIGHT}, '([.,!?;:])([^\s"])', '\1 \2', 'g') as historical from examples"""
)
def fix_spacing(spark, d):
    c = F.col("raw_text")
    return table(spark, d, "examples").select("ex_id", chars.fix_spacing(c).alias("spaced"), chars.fix_spacing(c, protect_ellipsis=False).alias("historical"))


@query(
    """select ex_id, list_reduce(list_concat([''], string_split(raw_text, '')), lambda a, x: case when right(a, 2) = x || x and x not in (chr(10), chr(13), chr(133), chr(8232), chr(8233)) then a else a || x end) as shrunk,
    list_reduce(list_concat([''], string_split(raw_text, '')), lambda a, x: case when right(a, 1) = x and x not in (chr(10), chr(13), chr(133), chr(8232), chr(8233)) then a else a || x end) as single
    from examples where raw_text is not null"""
)
def shrink_runs(spark, d):
    c = F.col("raw_text")
    rows = table(spark, d, "examples").where(c.isNotNull())
    return rows.select("ex_id", chars.shrink_runs(c, 2, False).alias("shrunk"), chars.shrink_repetitions_to(c, 1).alias("single"))


@query(
    r"""with c as (select unnest(string_split(raw_text, '')) as ch from examples where raw_text is not null)
    select category, count(*) as n from (select case when regexp_matches(ch, '^[\s\x0b\p{Z}]$') then 'WS' when regexp_matches(ch, '^\p{L}$') then 'L'
    when regexp_matches(ch, '^\p{Nd}$') then 'D' when regexp_matches(ch, '^\p{P}$') then 'P' else 'O' end as category from c where ch <> '') group by category"""
)
def char_categories(spark, d):
    c = table(spark, d, "examples").select(F.explode(F.split("raw_text", "")).alias("ch")).where("ch <> ''")
    return c.groupBy(chars.char_category(F.col("ch")).alias("category")).agg(F.count("*").alias("n"))


@query(
    rf"""select token, regexp_matches(token, '^\P{{L}}*\p{{Ll}}') as starts_lower, not regexp_matches(token, '[\p{{Lu}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') as all_lower,
    regexp_matches(token, '\p{{Lu}}') and not regexp_matches(token, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') and length(token) <= 8 as acronym,
    regexp_matches(token, '^\P{{L}}*\p{{Lu}}') and regexp_matches(token, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') as proper from {_TOKENS}"""
)
def word_shapes(spark, d):
    t = F.col("token")
    return _tokens(spark, d).select(
        "token", chars.starts_lower(t).alias("starts_lower"), chars.is_all_lower(t).alias("all_lower"), chars.is_acronym(t).alias("acronym"), chars.is_proper_case(t).alias("proper")
    )


@query(f"select token, left(token, length(token) - 1) || translate(right(token, 1), 'bcdgğ', 'pçtkk') as devoiced from {_TOKENS}")
def final_devoicing(spark, d):
    return _tokens(spark, d).select("token", chars.final_devoicer(F.col("token")).alias("devoiced"))


@query(
    r"""select ex_id, trim(regexp_replace(raw_text, '\s*\(.*?\)\s*', '', 'g')) as title,
    replace(trim(regexp_replace(raw_text, '[^\p{L}\p{N}_\- ]+', '', 'g')), ' ', '_') as filename from examples"""
)
def title_forms(spark, d):
    c = F.col("raw_text")
    return table(spark, d, "examples").select("ex_id", chars.clean_title(c).alias("title"), chars.safe_filename(c).alias("filename"))


@query(
    rf"""with a as (select ex_id, trim(regexp_replace(regexp_replace(regexp_replace({_trl("trim(translate(gold_text, '_', ' '))")}, '''?d[ae]ki($|[^\p{{L}}])', '\1', 'g'),
    'ndeki($|[^\p{{L}}])', '\1', 'g'), '\s{{2,}}', ' ', 'g')) as c from examples)
    select ex_id, case when contains(c, ' ') then trim(regexp_replace(c, '(ları|leri)$', '')) else c end as category from a"""
)
def category_forms(spark, d):
    return table(spark, d, "examples").select("ex_id", chars.clean_category(F.col("gold_text")).alias("category"))


@query(
    rf"""with t as (select distinct unnest({_WST('raw_text')}) as token from examples where raw_text is not null), m as (select token, regexp_matches(token, '^(\p{{P}}+)?([\p{{L}}\p{{N}}]+)(\p{{P}}+)?$') as w from t)
    select token, case when w then regexp_extract(token, '^(\p{{P}}+)?([\p{{L}}\p{{N}}]+)(\p{{P}}+)?$', 1) else '' end as lead, case when w then regexp_extract(token, '^(\p{{P}}+)?([\p{{L}}\p{{N}}]+)(\p{{P}}+)?$', 2) else token end as core,
    case when w then regexp_extract(token, '^(\p{{P}}+)?([\p{{L}}\p{{N}}]+)(\p{{P}}+)?$', 3) else '' end as trail, regexp_replace(token, '^\p{{P}}+|\p{{P}}+$', '', 'g') as stripped from m"""
)
def split_core(spark, d):
    t = table(spark, d, "examples").select(F.explode(chars.ws_tokens(F.col("raw_text"))).alias("token")).distinct()
    return t.select("token", chars.split_core(F.col("token")).alias("c"), chars.edge_strip(F.col("token")).alias("stripped")).select("token", "c.*", "stripped")


# duckdb counts bytes in levenshtein: every letter becomes one byte first
_BYTES = lambda x: f"regexp_replace(translate({x}, 'çğıöşüâîû’‘“”–…', chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21)), '[^\\x00-\\x7F]', chr(1), 'g')"
_FOLDED = lambda x: f"replace(lower(translate({x}, 'İ', 'i')), 'ß', 'ss')"


@query(
    f"""with p as (select distinct {_plain('raw')} as a, {_plain('gold')} as b from noisy_pairs where raw is not null and gold is not null),
    x as (select a, b, levenshtein({_BYTES(_FOLDED('a'))}, {_BYTES(_FOLDED('b'))}) as d, levenshtein({_BYTES('a')}, {_BYTES('b')}) as e from p)
    select a, b, cast(d as int) as distance, e <= 1 as within_one, cast(least(e, 3) as int) as estimate from x"""
)
def edit_distances(spark, d):
    p = table(spark, d, "noisy_pairs").where("raw is not null and gold is not null")
    p = p.select(chars.strip_diacritics(F.col("raw")).alias("a"), chars.strip_diacritics(F.col("gold")).alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", chars.edit_distance(a, b).alias("distance"), chars.within_edits(a, b, 1).alias("within_one"), chars.edit_estimate(a, b).alias("estimate"))


_OPTIONS = "case x " + " ".join(f"when '{a}' then ['{a}', '{b}']" for a, b in zip("cgosui", "çğöşüı")) + " else [x] end"
_VARIANTS = lambda w: f"list_reduce(list_concat([['']], list_transform(string_split({w}, ''), lambda x: {_OPTIONS})), lambda acc, o: list_slice(flatten(list_transform(acc, lambda a: list_transform(o, lambda y: a || y))), 1, 64))"


@query(f"select source, array_to_string({_VARIANTS(_FOLDED('source'))}, '|') as variants from (select distinct {_LOWJ('source')} as source from lexicon where source <> '')")
def diacritic_variants(spark, d):
    s = table(spark, d, "lexicon").where("source <> ''").select(F.lower("source").alias("source")).distinct()
    return s.select("source", F.array_join(chars.diacritic_variants(F.col("source")), "|").alias("variants"))


@query(
    f"""select ex_id, case when regexp_matches(raw_text, '[^\\x00-\\x7FçğıöşüÇĞİÖŞÜ]') then nfc_normalize({_SAN('raw_text')}) else raw_text end as unicode, trim(regexp_replace(raw_text, '{_WS}', ' ', 'g')) as clean from {_nfkc('(select ex_id, raw_text from examples)', 'raw_text')}"""
)
def nfkc_text(spark, d):
    c = F.col("raw_text")
    return table(spark, d, "examples").select("ex_id", chars.normalize_unicode(c).alias("unicode"), chars.clean(c).alias("clean"))


@query(r"""select ex_id, regexp_replace(raw_text, '@([A-Za-z_]+)\[([^\]]*)\]', '\2', 'g') as stripped from examples""")
def strip_tags(spark, d):
    return table(spark, d, "examples").select("ex_id", chars.strip_itu_tags(F.col("raw_text")).alias("stripped"))


@query("select ex_id, array_to_string(list_filter(gold_tokens, lambda t: t is not null), ' ') as joined from examples where gold_tokens is not null")
def join_tokens(spark, d):
    return table(spark, d, "examples").where("gold_tokens is not null").select("ex_id", chars.join_simple(F.col("gold_tokens")).alias("joined"))


_IN = lambda x, signs: f"{x} in (" + ", ".join(f"'{c}'" for c in signs) + ")"


@query(
    f"""with t as (select ex_id, list_filter(gold_tokens, lambda t: t is not null) as t from examples where gold_tokens is not null)
    select ex_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when i = 1 or array_to_string(t[1:i - 1], '') = '' or {_IN('t[i]', chars.NO_BLANK_BEFORE)} or regexp_matches(t[i], '^[''’]') or {_IN('t[i - 1]', chars.NO_BLANK_AFTER)} then '' else ' ' end || t[i]), '') as text from t"""
)
def detokenized(spark, d):
    return table(spark, d, "examples").where("gold_tokens is not null").select("ex_id", chars.detok(F.col("gold_tokens")).alias("text"))


@query(
    f"""with t as (select ex_id, {_WST('raw_text')} as a, {_WST('gold_text')} as b from examples where raw_text is not null and gold_text is not null),
    z as (select ex_id, list_transform(list_zip(a, b), lambda x: case when coalesce(x[1], '∅') = coalesce(x[2], '∅') then x[1] else '[' || coalesce(x[1], '∅') || ' -> ' || coalesce(x[2], '∅') || ']' end) as p from t)
    select ex_id, array_to_string(p, ' ') as diff from z"""
)
def inline_diff(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null and gold_text is not null")
    return e.select("ex_id", chars.inline_diff(F.col("raw_text"), F.col("gold_text")).alias("diff"))


# masks ------------------------------------------------------------------------------------------------------------


_URL, _MAIL = r"(?i)\bhttps?://\S+", r"(?i)\b[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{2,}\b"
_FACE = r"(?::-?\)|:-?D|:-?\(|:''\(|;-?\)|:-?P|:-?/|:-?\\|:-?\*|:-?\||:-?O|<3|xD|XD|=\)|=\(|:3)"


@query(
    rf"""select ex_id, len(regexp_extract_all(raw_text, '{_URL}')) as url, len(regexp_extract_all(raw_text, '{_MAIL}')) as email,
    len(regexp_extract_all(raw_text, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])@[\p{{L}}\p{{N}}_]{{2,32}}')) as user, len(regexp_extract_all(raw_text, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])#[\p{{L}}\p{{N}}_]{{2,64}}')) as hashtag,
    len(regexp_extract_all(raw_text, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}\x{{2190}}-\x{{21FF}}\x{{2300}}-\x{{23FF}}©®]')) as emoji,
    len(list_filter(regexp_split_to_array(raw_text, '[ \t\n\r\f\x0b]+'), lambda t: regexp_full_match(t, '{_FACE}'))) as emoticon from examples where raw_text is not null"""
)
def mask_counts(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null").select("ex_id", masks.counts(F.col("raw_text")).alias("m"))
    return e.select("ex_id", *(F.col(f"m.{c}").cast("long").alias(c) for c in ("url", "email", "user", "hashtag", "emoji", "emoticon")))


@query()
def masked_text(spark, d):
    e = table(spark, d, "examples").select("ex_id", masks.mask(F.col("raw_text")).alias("m"))
    return e.select("ex_id", "m.text", F.size("m.masks").alias("masks"))


@query(
    f"""select ex_id, raw_text as restored, len(regexp_extract_all(raw_text, '{_URL}')) as urls, len(regexp_extract_all(regexp_replace(raw_text, '{_URL}', '<>', 'g'), '{_MAIL}')) as emails, false as left_over
    from examples where raw_text is not null"""
)
def mask_roundtrip(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null").select("ex_id", "raw_text", masks.mask(F.col("raw_text")).alias("m"))
    of = lambda tag: F.size(F.filter("m.masks", lambda x: x["key"].startswith(f"<{tag}"))).cast("long")
    open_ = F.col("m.text").rlike(masks.URL) | F.col("m.text").rlike(masks.EMAIL)
    return e.select("ex_id", masks.unmask(F.col("m.text"), F.col("m.masks")).alias("restored"), of("URL").alias("urls"), of("EMAIL").alias("emails"), open_.alias("left_over"))


# tokens and sentences ---------------------------------------------------------------------------------------------

_PROTECT = lambda x, s, e: f"replace(replace(regexp_replace(regexp_replace({x}, '(\\d){e}', '\\1' || chr(2), 'g'), '{e}(\\d)', chr(2) || '\\1', 'g'), '{s}', ' {s} '), chr(2), '{s}')"
_SPACED = "regexp_replace(replace({t}, '...', ' ' || chr(1) || ' '), '([?!;(){{}}\\[\\]])', ' \\1 ', 'g')".format(t="raw_text")
for _s, _e in ((",", ","), (":", ":"), (".", r"\.")):
    _SPACED = _PROTECT(_SPACED, _s, _e)
_SPACED = f"replace(trim(regexp_replace(regexp_replace({_SPACED}, '([\"“”«»])', ' \\1 ', 'g'), '{_WS}', ' ', 'g')), chr(1), '...')"


@query(f"select ex_id, {_SPACED} as spaced from examples")
def spaced_text(spark, d):
    return table(spark, d, "examples").select("ex_id", tokenize.add_spaces(F.col("raw_text")).alias("spaced"))


@query(f"select ex_id, array_to_string({_WST(_SPACED)}, '|') as tokens from examples where raw_text is not null")
def plain_tokens(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null")
    return e.select("ex_id", F.array_join(tokenize.rule_tokens(F.col("raw_text"), copulas=False), "|").alias("tokens"))


@query(
    f"""with t as (select ex_id, {_WST(_SPACED)} as t from examples where raw_text is not null) select ex_id, 0 as sentence, cast(i - 1 as int) as pos, t[i] as token from (select ex_id, t, unnest(range(1, len(t) + 1)) as i from t)"""
)
def sentence_words(spark, d):
    return tokenize.sentence_words(table(spark, d, "examples").where("raw_text is not null"), "ex_id", "raw_text")


_LOW = _LOWJ("token")


@query(
    f"""with t as (select token, {_LOW} as low, length(token) as n from (select distinct unnest({_WST(_SPACED)}) as token from examples where raw_text is not null))
    select token, case when regexp_matches(low, '(acak|ecek)(tı|ti|tu|tü)$') then left(token, n - 2) || '+' || right(token, 2)
    when regexp_matches(low, '(ymiş|yken)$') and n > 5 then left(token, n - 4) || '+' || right(token, 4)
    when regexp_matches(low, 'ydi$') and n > 4 then left(token, n - 3) || '+' || right(token, 3)
    when regexp_matches(low, 'bilirdik$') then left(token, n - 3) || '+' || right(token, 3)
    when regexp_matches(low, '{tokenize.COPULA}') and not regexp_matches(low, '{tokenize.VERB_ENDING}') and n >= 5 and regexp_matches(left(token, n - 3), '{tokenize.VOWELS}') then left(token, n - 3) || '+' || right(token, 3)
    else token end as parts from t"""
)
def copula_split(spark, d):
    t = table(spark, d, "examples").select(F.explode(tokenize.rule_tokens(F.col("raw_text"), copulas=False)).alias("token")).distinct()
    return t.select("token", F.array_join(tokenize.split_copula(F.col("token")), "+").alias("parts"))


_PARTS = lambda t: f"""case when regexp_matches(lower(translate({t}, 'İ', 'i')), '(acak|ecek)(tı|ti|tu|tü)$') then left({t}, length({t}) - 2) || '|' || right({t}, 2)
    when regexp_matches(lower(translate({t}, 'İ', 'i')), '(ymiş|yken)$') and length({t}) > 5 then left({t}, length({t}) - 4) || '|' || right({t}, 4) when regexp_matches(lower(translate({t}, 'İ', 'i')), 'ydi$') and length({t}) > 4 then left({t}, length({t}) - 3) || '|' || right({t}, 3)
    when regexp_matches(lower(translate({t}, 'İ', 'i')), 'bilirdik$') then left({t}, length({t}) - 3) || '|' || right({t}, 3) when regexp_matches(lower(translate({t}, 'İ', 'i')), '{tokenize.COPULA}') and not regexp_matches(lower(translate({t}, 'İ', 'i')), '{tokenize.VERB_ENDING}')
    and length({t}) >= 5 and regexp_matches(left({t}, length({t}) - 3), '{tokenize.VOWELS}') then left({t}, length({t}) - 3) || '|' || right({t}, 3) else {t} end"""  # noqa: E731


@query(
    f"with t as (select ex_id, {_WST(_SPACED)} as t from examples where raw_text is not null) select ex_id, array_to_string(list_transform(t, lambda x: {_PARTS('x')}), '|') as boun, array_to_string(t, '|') as iwt from t"
)
def rule_tokens(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null")
    return e.select("ex_id", F.array_join(tokenize.rule_tokens(F.col("raw_text")), "|").alias("boun"), F.array_join(tokenize.rule_tokens(F.col("raw_text"), "iwt"), "|").alias("iwt"))


@query(
    """with e as (select ex_id as doc_id, list_filter(gold_tokens, lambda t: t is not null) as t from examples where gold_tokens is not null),
    p as (select list(p) as p from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as p from e) where false or p is not null and p in (select p from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as p from e) group by p having count(*) >= 5)),
    q as (select list_distinct(coalesce(p, [])) as p from p),
    m as (select doc_id, list_reduce(list_concat([{'d': cast([] as varchar[]), 'o': cast(null as varchar)}], list_transform(t, lambda x: {'d': cast([] as varchar[]), 'o': x})), lambda a, x: case when a.o is not null and list_contains(p, a.o || ' ' || x.o)
      then {'d': list_append(a.d, a.o || ' ' || x.o), 'o': cast(null as varchar)} else {'d': case when a.o is null then a.d else list_append(a.d, a.o) end, 'o': x.o} end) as m from e, q)
    select doc_id, array_to_string(case when m.o is null then m.d else list_append(m.d, m.o) end, '|') as tokens from m"""
)
def mwe_merge(spark, d):
    e = table(spark, d, "examples").where("gold_tokens is not null").select(F.col("ex_id").alias("doc_id"), F.filter("gold_tokens", lambda t: t.isNotNull()).alias("tokens"))
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, 2), " "))
    phrases = e.where(F.size("tokens") > 1).select(F.explode(pair).alias("phrase")).groupBy("phrase").count().where("count >= 5").select("phrase")
    return tokenize.merge_phrases(e, phrases).select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query(
    """with recursive t as (select ex_id, id, any_value(form) as form, any_value(coalesce(head, 0)) as head, any_value(deprel) as deprel from (select distinct ex_id, id, form, head, deprel from conllu_tokens where id is not null and form is not null) group by ex_id, id),
    p as (select *, deprel in ('flat', 'fixed', 'mwe', 'compound') and head <> 0 and (ex_id, head) in (select (ex_id, id) from t) as part from t),
    w(ex_id, id, top) as (select ex_id, id, case when part then head else id end from p union select w.ex_id, w.id, p.head from w join p on p.ex_id = w.ex_id and p.id = w.top and p.part),
    g as (select w.ex_id, w.id, w.top from w join p on p.ex_id = w.ex_id and p.id = w.top where not coalesce(p.part, false)),
    j as (select g.ex_id, g.top, string_agg(form, ' ' order by t.id) as form from g join t on t.ex_id = g.ex_id and t.id = g.id group by g.ex_id, g.top)
    select ex_id, string_agg(form, '|' order by top) as tokens from j group by ex_id"""
)
def dependency_mwe(spark, d):
    t = tokenize.merge_dependents(_conllu(spark, d))
    return t.select("ex_id", F.array_join("tokens", "|").alias("tokens"))


@query(
    r"""with m as (select doc_id, replace(replace(text, chr(10), ' '), '', '') as t from documents where text is not null),
    p as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\d)\.', '\1' || chr(2), 'g'), '\.(\d)', chr(2) || '\1', 'g'), '(^|[\s("])([A-Za-z])\.', '\1\2' || chr(2), 'g') as t from m),
    s as (select doc_id, list_filter(list_transform(string_split(replace(regexp_replace(t, '(\.|[!?]{1,3})', '\1' || chr(1), 'g'), chr(2), '.'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from p)
    select doc_id, len(s) as sentences, array_to_string(s, '|') as joined from s"""
)
def sentence_split(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", sentences.simple_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_join("s", "|").alias("joined"))


def _rule_sentences_sql() -> str:
    """Tokens hide the marks that end nothing, the rest is cut at its marks; parts join while a quote is open."""
    hide = lambda u: f"translate({u}, '{sentences.MARKS}', chr(57344) || chr(57345) || chr(57346) || chr(57347)) || chr(57348)"
    quotes = sentences.QUOTES.replace("'", "''")
    url, short = sentences.URL.replace("'", "''"), "|".join(w.replace(".", r"\.") for w in sorted(sentences.ABBREVIATIONS, key=lambda w: (-len(w), w)) if w.endswith("."))
    x = "x"
    for pattern in (url, sentences.EMAIL, sentences.DOTTED):
        x = f"list_reduce(list_concat([{x}], regexp_extract_all({x}, '{pattern}')), lambda a, u: replace(a, u, {hide('u')}))"
    start = rf"'^[{quotes}]{{0,3}}((?i:{short})|{sentences.INITIALS})'"
    x = f"list_transform([{x}], lambda y: case when regexp_matches(y, {start}) then replace(y, regexp_extract(y, {start}, 1), {hide(f'regexp_extract(y, {start}, 1)')}) else y end)[1]"
    closing = sentences.CLOSING.replace("'", "''")
    return rf"""with m as (select doc_id, array_to_string(list_transform(string_split(translate(text, chr(10), ' '), ' '), lambda x: {x}), ' ') as t from documents where text is not null),
    e as (select doc_id, replace(regexp_replace(t, '(\.\.\.|…)([ \t]*)(\p{{Lu}}|$)', '\1' || chr(57350) || '\2\3', 'g'), '...', chr(57351)) as t from m),
    d as (select doc_id, regexp_replace(regexp_replace(t, '(\d)\.', '\1' || chr(2), 'g'), '\.(\d)', chr(2) || '\1', 'g') as t from e),
    p as (select doc_id, string_split(regexp_replace(t, '((?:[!?]{{1,3}}|\.{{1,2}}){closing})', '\1' || chr(57349), 'g'), chr(57349)) as p from d),
    q as (select doc_id, list_transform(p, lambda x: string_split(x, chr(57350))) as q from p),
    j as (select doc_id, flatten(list_transform(q, lambda x: string_split(list_reduce(x, lambda a, b: case when length(regexp_replace(a, '[^''"]', '', 'g')) % 2 = 0 then a || chr(57350) || b else a || b end), chr(57350)))) as j from q),
    s as (select doc_id, list_filter(list_transform(j, lambda x: trim(replace(translate(x, chr(57344) || chr(57345) || chr(57346) || chr(57347) || chr(2) || chr(57348), '.!?….'), chr(57351), '...'), ' ' || chr(9))), lambda x: x <> '') as s from j)
    select doc_id, len(s) as sentences, array_to_string(s, '|') as joined from s"""


@query(_rule_sentences_sql())
def rule_sentences(spark, d):
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    s = docs.select("doc_id", sentences.rule_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_join("s", "|").alias("joined"))


@query(
    f"""select token from (select distinct unnest({_WST('raw_text')}) as token from examples where raw_text is not null)
    where lower(translate(token, 'İ', 'i')) in ({', '.join("'" + a + "'" for a in sorted(sentences.ABBREVIATIONS))}) or regexp_matches(token, '^(?:[A-Za-z]\\.|(?:[A-Z]\\.){{2,}})$')"""
)
def abbreviations(spark, d):
    t = table(spark, d, "examples").select(F.explode(chars.ws_tokens(F.col("raw_text"))).alias("token")).distinct()
    return t.where(sentences.is_abbreviation(F.col("token")))


# stems ------------------------------------------------------------------------------------------------------------

_SUFFIXES = f"""select distinct substr({_ii('form')}, length({_ii('lemma')}) + 1) as suffix from conllu_tokens
    where form is not null and lemma is not null and coalesce(upos, '') <> 'AUX' and starts_with({_ii('form')}, {_ii('lemma')}) and length({_ii('form')}) - length({_ii('lemma')}) > 1"""


@query(_SUFFIXES)
def suffix_pairs(spark, d):
    return stem.suffix_pairs(table(spark, d, "conllu_tokens"))


@query(
    f"""with s as ({_SUFFIXES}), t as (select token as word from {_TOKENS}), b as (select word, max(length(suffix)) as n from t, s
    where not contains(word, '''') and length(word) > 3 and length(word) - length(suffix) >= 2 and right(word, length(suffix)) = suffix group by word),
    c as (select t.word, left(t.word, length(t.word) - coalesce(n, 0)) as cut from t left join b on t.word = b.word)
    select word, case when contains(word, '''') then split_part(word, '''', 1) else {_ii("left(cut, length(cut) - 1) || translate(right(cut, 1), 'bcdgğ', 'pçtkk')")} end as stem from c"""
)
def stem_words(spark, d):
    return stem.stems(_tokens(spark, d), stem.suffix_pairs(table(spark, d, "conllu_tokens")), "token")


# frequencies, vocabularies, stopwords ------------------------------------------------------------------------------

_WORDS = f"(select unnest(regexp_extract_all({_trl('text')}, '\\p{{L}}+')) as word from documents where text is not null)"
_FREQ = f"(select word, count(*) as freq from {_WORDS} group by word)"


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_counts(table(spark, d, "documents"))


@query(f"select word, freq from {_FREQ} where freq >= 2")
def word_freq(spark, d):
    return corpus.word_counts(table(spark, d, "documents"), least=2)


@query(rf"select word, freq from {_FREQ} where freq >= 5 and length(word) between 2 and 40 and not regexp_matches(word, '\p{{Nd}}')")
def safe_vocab(spark, d):
    return corpus.valid_tokens(_freq(spark, d))


@query(f"select word, freq from {_FREQ} order by freq desc, word limit 100")
def top_stopwords(spark, d):
    return corpus.top_words(_freq(spark, d))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(corpus.STOPWORDS)) + "]"


@query(
    f"select ex_id, array_to_string(list_filter(gold_tokens, lambda t: t is not null and not list_contains({_STOP}, lower(translate(t, 'İ', 'i')))), '|') as kept from examples where gold_tokens is not null"
)
def static_stop_filter(spark, d):
    e = table(spark, d, "examples").where("gold_tokens is not null")
    return e.select("ex_id", F.array_join(corpus.filter_stopwords(F.col("gold_tokens")), "|").alias("kept"))


_CORPUS = rf"""(select ex_id, id, {_LOWJ('form')} as token from {_CONLLU} where not regexp_matches(form, '^\s*[+-]?\d+\s*$') and coalesce(upos, '') <> 'AUX'
    and not regexp_matches(form, '^(?:[!-/:-@\[-`{{-~]|\.\.\.|\."?)$'))"""


@query(
    f"""with t as {_CORPUS}, s as (select token, count(*) as freq from t group by token order by freq desc, token limit 100)
    select token, count(*) as freq from t where token not in (select token from s) group by token"""
)
def dynamic_stop_filter(spark, d):
    t = corpus.corpus_tokens(_conllu(spark, d))
    stop = corpus.top_words(t.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("freq")))
    return corpus.filter_by_table(t, stop).groupBy("token").agg(F.count("*").alias("freq"))


_IGNORE = lambda c: rf"""({c} = '' or length({c}) > 40 or {c} in ({', '.join("'" + s + "'" for s in corpus.SKIPPED)}) or regexp_matches({c}, '^\p{{P}}+$') or regexp_matches({c}, '(?i)^https?://\S+$')
    or regexp_matches({c}, '(?i)^[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{{2,}}$') or regexp_matches({c}, '^\d+(?:[.,]\d+)?$'))"""  # noqa: E731
_SURFACE = rf"""(select word, count(*) as freq from (select regexp_replace(t, '^\p{{P}}+|\p{{P}}+$', '', 'g') as word from (select unnest({_WST('gold_text')}) as t from {_nfkc('(select gold_text from examples where gold_text is not null)', 'gold_text')})) where not {_IGNORE('word')} group by word)"""


def _surface(spark: SparkSession, d: str) -> DataFrame:
    return corpus.surface_vocabulary(table(spark, d, "examples"), "gold_text")


@query(f"select word, freq from {_SURFACE}")
def surface_vocab(spark, d):
    return _surface(spark, d)


@query(
    f"""select word, cast(sum(freq) as bigint) as freq from (select replace(lower(translate(word, 'İ', 'i')), 'ß', 'ss') as word, coalesce(frequency, 0) as freq from word_freq where word is not null) group by word"""
)
def summed_freq(spark, d):
    return corpus.summed_frequencies(table(spark, d, "word_freq"))


@query("select trim(word) as word, cast(frequency as bigint) as frequency from word_freq where regexp_matches(trim(word), '^[A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû]') and frequency >= 2")
def clean_wordlist(spark, d):
    return corpus.clean_wordlist(table(spark, d, "word_freq"))


# lexicons ---------------------------------------------------------------------------------------------------------

_PAIRS = rf"""(select {_ii('r')} as key, g as target, count(*) as freq from (select trim(regexp_replace(raw, '{_WS}', ' ', 'g')) as r, trim(regexp_replace(gold, '{_WS}', ' ', 'g')) as g
    from {_nfkc('(select distinct * from noisy_pairs where raw is not null and gold is not null)', 'raw', 'gold')}) where r <> g and not {_IGNORE('r')} and not {_IGNORE('g')} group by 1, 2)"""


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noisy_pairs").distinct()


@query(f"select key, target, freq from {_PAIRS}")
def pair_counts(spark, d):
    return corpus.pair_counts(_noisy(spark, d))


_BEST = f"""(select key, target from (select p.key, p.target, row_number() over (partition by p.key order by p.freq + case when s.word is null then 0 else 1 end desc, p.target) as r
    from {_PAIRS} p left join {_SURFACE} s on s.word = p.target) where r = 1)"""


@query(f"select key, target from {_BEST}")
def best_target(spark, d):
    return corpus.best_targets(corpus.pair_counts(_noisy(spark, d)), _surface(spark, d))


_CANON = f"(select key, word as target from (select {_ii('word')} as key, word, row_number() over (partition by {_ii('word')} order by freq desc, word) as r from {_SURFACE}) where r = 1)"


@query(f"select key, target from {_CANON}")
def canonical_case(spark, d):
    return corpus.canonical_casing(_surface(spark, d))


@query(f"select key, target, 'pairs' as origin from {_BEST} union all select key, target, 'corpus' from {_CANON} where key not in (select key from {_BEST})")
def lexicon_backfill(spark, d):
    return corpus.build_lexicon(_noisy(spark, d), _surface(spark, d))


_REWRITTEN = ", ".join(f"replace(base, '{a}', '{b}')" for a, b in corpus.REWRITES)
_SUMMED = f"(select word, cast(sum(freq) as bigint) as freq from (select {_FOLDED('word')} as word, coalesce(frequency, 0) as freq from word_freq where word is not null) group by word)"


@query(
    f"""with n as (select {_LOWJ('raw')} as noisy, count(*) as noisy_count from (select distinct * from noisy_pairs) where raw is not null group by 1),
    b as (select *, list_reduce(list_concat([''], string_split(noisy, '')), lambda a, x: case when right(a, 2) = x || x then a else a || x end) as base from n),
    c as (select distinct noisy, noisy_count, unnest(list_concat([base], {_VARIANTS(_FOLDED('base'))}, [{_REWRITTEN}])) as candidate from b),
    r as (select *, freq - 2.0 * dist as score from (select noisy, noisy_count, candidate, freq, levenshtein({_BYTES(_FOLDED('noisy'))}, {_BYTES(_FOLDED('candidate'))}) as dist from c join {_SUMMED} on word = candidate)),
    k as (select *, row_number() over (partition by noisy order by score desc, candidate desc) as rank from r)
    select noisy as noisy_form, any_value(candidate) filter (where rank = 1) as best_candidate, string_agg(candidate, ';' order by rank) as candidates, any_value(noisy_count) as noisy_count,
    any_value(freq) filter (where rank = 1) as best_freq, cast(any_value(dist) filter (where rank = 1) as int) as edit_distance, cast(round(any_value(score) filter (where rank = 1), 2) as double) as score from k where rank <= 6 group by noisy"""
)
def tweet_lexicon(spark, d):
    noisy = _noisy(spark, d).where("raw is not null").select(F.lower("raw").alias("noisy"))
    return corpus.ranked_candidates(noisy, corpus.summed_frequencies(table(spark, d, "word_freq")))


_LEX = f"(select {_trl('trim(source)')} as key, min(trim(target)) as target from lexicon where trim(source) <> '' and trim(target) <> '' group by 1)"


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return normalize.lexicon_table(table(spark, d, "lexicon"))


def _prior(spark: SparkSession, d: str) -> DataFrame:
    return normalize.frequency_table(table(spark, d, "word_freq"))


@query(f"select key, target from {_LEX}")
def lexicon_table(spark, d):
    return _lexicon(spark, d)


_NOISY = "(select distinct raw as token from noisy_pairs where raw is not null)"
_PRIOR = f"(select {_trl('trim(word)')} as word, cast(sum(coalesce(frequency, 0)) as bigint) as freq from word_freq where word is not null group by 1)"


def _noisy_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noisy_pairs").where("raw is not null").select(F.col("raw").alias("token")).distinct()


@query(
    f"""select token, target, coalesce(freq, 0) as freq from {_NOISY} t left join {_LEX} l on l.key = {_trl('t.token')} left join {_PRIOR} p on p.word = {_trl('l.target')}"""
)
def exact_lookup(spark, d):
    t = _noisy_tokens(spark, d).withColumn("key", chars.tr_lower(F.col("token")))
    j = t.join(_lexicon(spark, d), "key", "left").join(_prior(spark, d), chars.tr_lower(F.col("target")) == F.col("word"), "left")
    return j.select("token", "target", F.coalesce("freq", F.lit(0)).alias("freq"))


@query(
    f"""with v as (select distinct word from word_freq where word is not null) select token, token in (select word from v) or {_trl('token')} in (select {_trl('word')} from v) as safe from {_NOISY}"""
)
def safe_vocab_flag(spark, d):
    check = normalize.vocabulary_validator(table(spark, d, "word_freq").where("word is not null"))
    return check(_noisy_tokens(spark, d), "token").select("token", F.col("token_ok").alias("safe"))


@query(
    f"""with k as (select distinct {_trl('token')} as key from {_NOISY}), l as {_LEX},
    p as (select k.key, l.key as near, l.target, list_filter(range(1, length(k.key) + 1), lambda i: substr(k.key, i, 1) <> substr(l.key, i, 1)) as pos from k join l
      on length(k.key) = length(l.key) and {_plain('k.key')} = {_plain('l.key')} and k.key <> l.key)
    select key, target from (select key, target, row_number() over (partition by key order by len(pos), pos) as r from p where len(pos) <= case when length(key) <= 6 then 2 else 1 end) where r = 1"""
)
def flip_candidates(spark, d):
    keys = _noisy_tokens(spark, d).select(chars.tr_lower(F.col("token")).alias("key")).distinct()
    return normalize.flip_hits(keys, _lexicon(spark, d))


def _near_sql(keys: str, edits: int, extra: str = "true") -> str:
    """key, target, edits, freq of the nearest lexicon key."""
    return f"""(select key, target, edits, freq from (select *, row_number() over (partition by key order by edits, freq desc, marks desc, length(target), near) as r from (
      select k.key, l.key as near, l.target, cast(levenshtein({_BYTES('k.key')}, {_BYTES('l.key')}) as int) as edits, coalesce(freq, 0) as freq, length(regexp_replace(l.target, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) as marks
      from {keys} k join {_LEX} l on abs(length(k.key) - length(l.key)) <= {edits} left join {_PRIOR} p on p.word = {_trl('l.target')}) where edits <= {edits} and {extra}) where r = 1)"""


def _flip_sql(keys: str) -> str:
    """key, target of the first lexicon hit with swapped letters."""
    return f"""(select key, target from (select key, target, row_number() over (partition by key order by len(pos), pos) as r from (
      select k.key, l.target, list_filter(range(1, length(k.key) + 1), lambda i: substr(k.key, i, 1) <> substr(l.key, i, 1)) as pos from {keys} k join {_LEX} l
      on length(k.key) = length(l.key) and {_plain('k.key')} = {_plain('l.key')} and k.key <> l.key) where len(pos) <= case when length(key) <= 6 then 2 else 1 end) where r = 1)"""


_KEYS = f"(select distinct {_trl('token')} as key from {_NOISY})"


@query(f"select key, target, edits from {_near_sql(_KEYS, 1)}")
def ed1_candidates(spark, d):
    return _near(spark, d, 1)


@query(f"select key, target, edits from {_near_sql(_KEYS, 2)}")
def ed2_candidates(spark, d):
    return _near(spark, d, 2)


@query(f"select key, target, edits from {_near_sql(_KEYS, 2, 'freq >= 1 and near <> key')}")
def ed2_frequent(spark, d):
    keys = _noisy_tokens(spark, d).select(chars.tr_lower(F.col("token")).alias("key")).distinct()
    return normalize.near_hits(keys, _lexicon(spark, d), _prior(spark, d), 2, 1).select("key", "target", "edits")


def _near(spark: SparkSession, d: str, edits: int) -> DataFrame:
    keys = _noisy_tokens(spark, d).select(chars.tr_lower(F.col("token")).alias("key")).distinct()
    return normalize.near_hits(keys, _lexicon(spark, d), _prior(spark, d), edits).select("key", "target", "edits")


_CASED = lambda x: f"translate({x}, 'İ', chr(1))"
_RUN3 = lambda x: f"len(list_filter(range(1, length({x}) - 1), lambda i: {_ONE(x, 'i')} = {_ONE(x, 'i + 1')} and {_ONE(x, 'i')} = {_ONE(x, 'i + 2')})) > 0"
_ONE = lambda x, i: f"lower(upper(translate(substr({x}, {i}, 1), 'İ', 'i')))"
_LOOKS_NOISY = lambda a, b: f"({_RUN3(a)} or (lower({_plain(a)}) = lower({_plain(b)}) and lower({_CASED(a)}) <> lower({_CASED(b)})))"


def _base_sql(tokens: str) -> str:
    """token, normalized, stage of the base normaliser without a safe vocabulary."""
    keys = f"(select distinct {_trl('token')} as key from {tokens} where not regexp_full_match(token, '\\p{{P}}*'))"
    left = f"(select key from {keys} where key not in (select key from {_LEX}))"
    last = f"(select key from {left} where key not in (select key from {_flip_sql(left)}))"
    return f"""(select token, case when kept then token else coalesce(exact, flip, near, token) end as normalized,
      case when kept then 'kept' when exact is not null then 'exact' when flip is not null then 'flip' when near is not null then 'near' else 'none' end as stage from (
      select t.token, regexp_full_match(t.token, '\\p{{P}}*') as kept, l.target as exact, f.target as flip, case when n.target = t.token or n.freq >= 1 or {_LOOKS_NOISY('t.token', 'n.target')} then n.target end as near
      from {tokens} t left join {_LEX} l on l.key = {_trl('t.token')} left join {_flip_sql(left)} f on f.key = {_trl('t.token')} left join {_near_sql(last, 1)} n on n.key = {_trl('t.token')}))"""


@query(f"select * from {_base_sql(_NOISY)}")
def normalized_tokens(spark, d):
    return normalize.normalize_tokens(_noisy_tokens(spark, d), _lexicon(spark, d), _prior(spark, d))


_SLANG = lambda x: "case lower(" + _TRL1(x) + ") " + " ".join(f"when '{k}' then '{v}'" for k, v in chars.SLANG.items()) + f" else {_SIGNS(x)} end"
_TRL1 = lambda x: _trl(_SIGNS(x))


def _SIGNS(x: str) -> str:
    for sign, letter in (("\\$", "s"), ("@", "a")):
        for _ in range(2):  # matches may share a letter
            x = f"regexp_replace({x}, '(\\p{{L}}){sign}(\\p{{L}})', '\\1{letter}\\2', 'g')"
    return x


_VALID = lambda x: f"{_trl(x)} in (select {_trl('word')} from word_freq where word is not null)"
_CORE = r"'^(\p{P}+)?([\p{L}\p{N}]+)(\p{P}+)?$'"
_CASCADE = f"""with a as (select token, case when regexp_matches(token, {_CORE}) then regexp_extract(token, {_CORE}, 2) else token end as core,
      case when regexp_matches(token, {_CORE}) then regexp_extract(token, {_CORE}, 1) else '' end as lead, case when regexp_matches(token, {_CORE}) then regexp_extract(token, {_CORE}, 3) else '' end as trail from {_NOISY}),
    b as (select a.token, case when regexp_full_match(a.token, '\\p{{P}}*') then a.token when freq >= 1 or {_LOOKS_NOISY('core', 'l.target')} then lead || l.target || trail end as out, {_SLANG('a.token')} as x
      from a left join {_LEX} l on l.key = {_trl('core')} left join {_PRIOR} p on p.word = {_trl('l.target')}),
    c as materialized (select token, coalesce(out, case when x <> token and {_VALID('x')} then x end) as out, x from b),
    g as (select distinct {_trl('lemma')} as key from conllu_tokens where upos = 'PROPN' and lemma is not null),
    e as materialized (select token, coalesce(out, case when y <> x then y end) as out, y as x from (select *, case when out is null and {_trl('x')} in (select key from g) then {_upper_first('x')} else x end as y from c)),
    ek as (select distinct {_trl('x')} as key from e where out is null),
    f as materialized (select token, coalesce(out, case when f.target <> x then f.target end) as out, coalesce(f.target, x) as x from e left join {_flip_sql('ek')} f on f.key = {_trl('x')} and out is null),
    ft as (select distinct x as token from f where out is null),
    h as materialized (select f.token, coalesce(out, case when n.normalized <> x then n.normalized end) as out, coalesce(n.normalized, x) as x from f left join {_base_sql('ft')} n on n.token = f.x and out is null),
    hk as (select distinct {_trl('x')} as key from h where out is null and {_RUN3('x')})
    select token, coalesce(out, case when {_RUN3('x')} then two.target end, x) as normalized from h left join {_near_sql('hk', 2, f"freq >= 1 and near <> key and {_VALID('target')}")} two on two.key = {_trl('x')}"""


def _cascade(spark: SparkSession, d: str, **stages: bool) -> DataFrame:
    names = table(spark, d, "conllu_tokens").where("upos = 'PROPN' and lemma is not null").select(F.lit("treebank").alias("gazetteer"), F.col("lemma").alias("word")).distinct()
    check = normalize.vocabulary_validator(table(spark, d, "word_freq").where("word is not null"))
    return normalize.cascade(_noisy_tokens(spark, d), _lexicon(spark, d), _prior(spark, d), gazetteers=names, slang=True, validator=check, **stages)


@query()
def cascade_tokens(spark, d):
    return _cascade(spark, d)


@query(_CASCADE)
def cascade_lexical(spark, d):
    return _cascade(spark, d, vowels=False, accents=False)


@query()
def cascade_text(spark, d):
    lex, prior = _lexicon(spark, d), _prior(spark, d)
    n = normalize.texts(table(spark, d, "examples"), lambda t: normalize.cascade(t, lex, prior, slang=True), "ex_id", "raw_text", lambda c: chars.shrink_repetitions_to(c, 2))
    return n.select("ex_id", "normalized", F.size("masks").alias("masks"))


def _spoken_sql(x: str) -> str:
    """The first spoken ending that changes the word; all four i are one letter where case doesn't count."""
    any_i = lambda p: "".join("[iıIİ]" if c in "iı" else c for c in p)
    rules = []
    for shape, spoken, written in chars.ACCENT_RULES:
        p = f"'(?i)^({shape.replace('[ıiuü]', '[ıiIİuü]')}){any_i(spoken)}$'"
        new = f"regexp_replace({x}, {p}, '\\1{written}')"
        rules.append(f"when regexp_matches({x}, {p}) and {new} <> {x} then {new}")
    q = f"'(?i)^(.+?)({any_i('mi')}|mu|mü)(n|sun|sunuz|{any_i('siniz')})?$'"
    part = lambda k: f"regexp_extract({x}, {q}, {k})"
    ask = f"concat_ws(' ', rtrim({part(1)}), {_LOWJ(part(2))}, nullif({_LOWJ(part(3))}, ''))"
    return f"case {' '.join(rules)} when regexp_matches({x}, {q}) and not contains({x}, '’') then {ask} else {x} end"


@query(
    f"""select token, {_SLANG('token')} as replaced, {_spoken_sql('token')} as accent, regexp_replace(token, '(?i)(\\p{{L}}{{2,}}?)([bcçdfgğhjklmnprsştvyz]{{3,}})(\\p{{L}}*)', '\\1e\\2\\3', 'g') as vowels from {_NOISY}"""
)
def spoken_forms(spark, d):
    t, c = _noisy_tokens(spark, d), F.col("token")
    return t.select("token", chars.apply_replacements(c).alias("replaced"), chars.accent_normalize(c).alias("accent"), chars.restore_vowels(c).alias("vowels"))


@query(f"select distinct raw, gold, {_LOOKS_NOISY('raw', 'gold')} as noisy, raw = gold or coalesce(freq, 0) >= 1 or {_LOOKS_NOISY('raw', 'gold')} as sure from noisy_pairs left join {_PRIOR} on word = {_trl('gold')} where raw is not null and gold is not null")
def noisy_flags(spark, d):
    p = table(spark, d, "noisy_pairs").where("raw is not null and gold is not null").select("raw", "gold").distinct()
    j = p.join(_prior(spark, d), chars.tr_lower(F.col("gold")) == F.col("word"), "left")
    raw, gold = F.col("raw"), F.col("gold")
    return j.select("raw", "gold", normalize.looks_noisy(raw, gold).alias("noisy"), normalize.confident(raw, gold, F.col("freq")).alias("sure"))


@query(f"select word, freq from (select word, freq from {_FREQ} order by freq desc, word limit 3000) where {_VALID('word')}")
def accepted_words(spark, d):
    check = normalize.vocabulary_validator(table(spark, d, "word_freq").where("word is not null"))
    return corpus.accepted_words(_freq(spark, d), check, 3000)


@query()
def normalized_text(spark, d):
    lex, prior = _lexicon(spark, d), _prior(spark, d)
    n = normalize.texts(table(spark, d, "examples"), lambda t: normalize.normalize_tokens(t, lex, prior), "ex_id", "raw_text")
    return n.select("ex_id", "normalized", F.size("masks").alias("masks"))


@query(
    f"""with g as (select distinct src_doc as gazetteer, {_trl('lemma')} as key from conllu_tokens where upos = 'PROPN' and lemma is not null and src_doc is not null), n as (select count(distinct gazetteer) as n from g),
    h as (select key, count(*) as hits from g group by key) select token, case when (coalesce(hits, 0) + 1.0) / ((select n from n) - coalesce(hits, 0) + 1) >= 0.01 then {_upper_first('token')} else token end as proper
    from {_NOISY} t left join h on h.key = {_trl('t.token')}"""
)
def proper_nouns(spark, d):
    g = table(spark, d, "conllu_tokens").where("upos = 'PROPN' and lemma is not null and src_doc is not null").select(F.col("src_doc").alias("gazetteer"), F.col("lemma").alias("word"))
    return normalize.proper_nouns(_noisy_tokens(spark, d), g, 0.01)


# gazetteers, titles, pages -----------------------------------------------------------------------------------------

_LEMMAS = "(select lemma as title from conllu_tokens where lemma is not null)"
_TITLES = rf"(select title, count(*) as freq from (select trim(nfc_normalize({_SAN('title')})) as title from {_nfkc(f"(select translate(title, '_', ' ') as title from {_LEMMAS})", 'title')}) where regexp_matches(title, '\p{{L}}') and length(title) <= 200 group by title having count(*) >= 2)"


@query(f"select title, freq from {_TITLES}")
def title_counts(spark, d):
    t = table(spark, d, "conllu_tokens").where("lemma is not null").select(F.col("lemma").alias("title"))
    return corpus.title_counts(t, least=2)


@query(
    rf"""select word, count(*) as freq from (select unnest({_WST('gold_text')}) as word from examples where gold_text is not null) where regexp_matches(word, '^\p{{L}}[\p{{L}}''’\-]*$') and length(word) between 2 and 40
    and ((regexp_matches(word, '\p{{Lu}}') and not regexp_matches(word, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') and length(word) <= 8) or (regexp_matches(word, '^\P{{L}}*\p{{Lu}}') and regexp_matches(word, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]')))
    group by word having count(*) >= 2"""
)
def title_tokens(spark, d):
    return corpus.title_tokens(table(spark, d, "examples").where("gold_text is not null").select(F.col("gold_text").alias("title")))


@query(
    f"""select e.src_doc as title, array_to_string(list_sort(list_distinct(list({_trl('trim(deprel)')}))), '|') as categories from (select distinct src_doc from examples where src_doc is not null) e
    join conllu_tokens c on c.src_doc = e.src_doc where deprel is not null group by e.src_doc"""
)
def page_categories(spark, d):
    pages = table(spark, d, "examples").where("src_doc is not null").select(F.col("src_doc").alias("page_id"), F.col("src_doc").alias("title"), F.lit(0).alias("namespace")).distinct()
    links = table(spark, d, "conllu_tokens").select(F.col("src_doc").alias("page_id"), F.col("deprel").alias("category"))
    return corpus.page_categories(pages, links).select("title", "categories")


@query("select distinct src_doc as title from examples where trim(src_doc) <> '' and src_doc not in (select src_doc from conllu_tokens where src_doc is not null)")
def missing_pages(spark, d):
    t = lambda n: table(spark, d, n).where("src_doc is not null").select(F.col("src_doc").alias("title"))
    return corpus.missing_pages(t("examples"), t("conllu_tokens").distinct())


@query(
    """with recursive e as (select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from region join nation on n_regionkey = r_regionkey
      union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
    w(node) as (select 'r' || r_regionkey from region where r_regionkey < 2 union select dst from e join w on e.src = w.node) select node from w"""
)
def recursive_closure(spark, d):
    n, c, r = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "region")
    name = lambda p, k: F.concat(F.lit(p), F.col(k))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.closure(edges, r.where("r_regionkey < 2").select(name("r", "r_regionkey").alias("node"))).select("node")


_PLAIN_TITLES = f"(select distinct title from {_TITLES} where regexp_matches(title, '^[A-Za-zÇĞİÖŞÜçğıöşü’''().,-]+$'))"


@query(
    rf"""select 'title' as kind, title as word from {_PLAIN_TITLES} union all
    select 'word', word from (select word, count(*) as n from (select unnest({_WST('title')}) as word from {_PLAIN_TITLES}) where regexp_matches(word, '^[A-Za-zÇĞİÖŞÜçğıöşü’'']+$') and length(word) between 2 and 40
      and (regexp_matches(word, '^\P{{L}}*\p{{Lu}}') and regexp_matches(word, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') or regexp_matches(word, '\p{{Lu}}') and not regexp_matches(word, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') and length(word) <= 8) group by word having count(*) >= 1)"""
)
def gazetteers(spark, d):
    t = table(spark, d, "conllu_tokens").where("lemma is not null").select(F.col("lemma").alias("title"))
    titles = corpus.title_counts(t, least=2).select("title")
    _, words = corpus.build_gazetteers(titles)
    plain = titles.where(corpus.is_plain_title(F.col("title")))
    return plain.select(F.lit("title").alias("kind"), F.col("title").alias("word")).unionByName(words.select(F.lit("word").alias("kind"), "word"))


@query(
    r"""with recursive e as (select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from region join nation on n_regionkey = r_regionkey),
    w(node) as (select 'r' || r_regionkey from region where r_regionkey < 2 union select dst from e join w on e.src = w.node)
    select distinct c_name as title from customer join w on node = 'n' || c_nationkey where regexp_matches(c_name, '^\p{Lu}') order by title limit 50"""
)
def category_members(spark, d):
    n, c, r = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "region")
    name = lambda p, k: F.concat(F.lit(p), F.col(k))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    pages = c.select(F.col("c_name").alias("title"), name("n", "c_nationkey").alias("category"))
    return graph.members(edges, r.where("r_regionkey < 2").select(name("r", "r_regionkey").alias("node")), pages, 50)


# boundary features and models ---------------------------------------------------------------------------------------


@query(
    f"""select ex_id, pos, token, lead(token) over w is null as snt_end, token in ('.', '!', '?', '...') as punct, {_ii('token')} in ({', '.join("'" + a + "'" for a in sorted(sentences.ABBREVIATIONS))}) as abbrev,
    coalesce(regexp_matches(lead(token) over w, '^\\p{{Lu}}'), false) as next_cap, coalesce(regexp_matches(lag(token) over w, '^\\p{{Ll}}'), false) as prev_not_cap,
    coalesce(lead(token) over w in ('.', '!', '?', '...'), false) as nxt_punct, coalesce(lag(token) over w in ('.', '!', '?', '...'), false) as prev_punct from {_SENT} window w as (partition by ex_id order by pos)"""
)
def boundary_feats(spark, d):
    return features.boundary_features(_sentences(spark, d)).drop("sentence")


@query(
    f"""select ex_id, pos, token, regexp_matches(token, '^[.!?…]$') as punct, regexp_matches(lead(token, 1, 'A') over w, '^\\p{{Lu}}') as next_cap, not regexp_matches(lag(token, 1, 'a') over w, '^\\p{{Lu}}') as prev_not_cap,
    regexp_matches(lead(token, 1, 'A') over w, '^[.!?…]$') as nxt_punct, regexp_matches(lag(token, 1, 'a') over w, '^[.!?…]$') as prev_punct from {_SENT} window w as (partition by ex_id order by pos)"""
)
def shift_feats(spark, d):
    return features.shift_features(_sentences(spark, d))


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_instances").dropDuplicates(["inst_id"])


_CAT = lambda c: rf"case when {c} in ('<BOS>', '<EOS>') then {c} when regexp_matches({c}, '^[\s\x0b\p{{Z}}]$') then 'WS' when regexp_matches({c}, '^\p{{L}}$') then 'L' when regexp_matches({c}, '^\p{{Nd}}$') then 'D' when regexp_matches({c}, '^\p{{P}}$') then 'P' else 'O' end"
_OFFSETS = """(select inst_id, text, i, list_contains(boundaries, i)::int as label, case when i > 0 then substr(text, i, 1) else '<BOS>' end as p, case when i < length(text) then substr(text, i + 1, 1) else '<EOS>' end as n,
    regexp_extract(left(text, i), '(\\S+)\\s*$', 1) as l, regexp_extract(substr(text, i + 1), '^\\s*(\\S+)', 1) as r
    from (select inst_id, text, boundaries, unnest(range(0, length(text) + 1))::int as i from (select distinct * from token_instances) where text is not null and boundaries is not null))"""
_FEATURES = f"""(select inst_id, i, label, unnest(list_filter(['prev_char=' || p, 'next_char=' || n, 'prev_cat=' || {_CAT('p')}, 'next_cat=' || {_CAT('n')}, 'prev_next=' || p || '|' || n,
    case when p in ('''', '’', '‘') then 'prev_is_apostrophe' end, case when n in ('''', '’', '‘') then 'next_is_apostrophe' end, case when p in ('"', '“', '”') then 'prev_is_quote' end, case when n in ('"', '“', '”') then 'next_is_quote' end,
    case when regexp_matches(l, '^\\p{{Lu}}') and (p in ('''', '’') or n in ('''', '’')) and r <> '' then 'around_apostrophe_after_capital' end, case when p in ('"', '“', '”') and regexp_matches(r, '^\\p{{Lu}}') then 'quote_before_capital' end,
    case when regexp_matches(lower(l), '(dir|dır|dur|dür)$') then 'left_endswith_dir_variant' end, case when regexp_matches(lower(l), '(dı|di|du|dü)$') then 'left_endswith_past_d' end,
    case when regexp_matches(lower(l), '(tı|ti|tu|tü)$') then 'left_endswith_past_t' end, case when regexp_matches(lower(l), 'yor$') then 'left_endswith_yor' end], lambda x: x is not null)) as feature from {_OFFSETS})"""


@query(f"select label, feature, count(*) as n from {_FEATURES} group by label, feature")
def nb_counts(spark, d):
    return features.nb_fit(_instances(spark, d))[0]


_ALL_FEATURES = _FEATURES.replace("where text is not null and boundaries is not null", "where text is not null")
_ODDS = f"""(with c as (select feature, coalesce(sum(n) filter (where label = 1), 0) as n1, coalesce(sum(n) filter (where label = 0), 0) as n0 from (select label, feature, count(*) as n from {_FEATURES} group by label, feature) group by feature),
    v as (select count(*) as v, sum(n1) as f1, sum(n0) as f0 from c), o as (select coalesce(sum(label), 0) as o1, count(*) as n from {_OFFSETS}),
    e as (select f.inst_id, f.i, sum(ln((coalesce(c.n1, 0) + 1.0) / (v.f1 + v.v)) - ln((coalesce(c.n0, 0) + 1.0) / (v.f0 + v.v))) as s from {_ALL_FEATURES} f left join c on c.feature = f.feature, v group by f.inst_id, f.i)
    select inst_id, i as pos, s + ln((o1 + 1.0) / (n + 2)) - ln((n - o1 + 1.0) / (n + 2)) as log_odds from e, o)"""


@query(f"select inst_id, pos, round(log_odds, 6) as log_odds, log_odds >= 0 as boundary from {_ODDS}")
def nb_predict(spark, d):
    inst = _instances(spark, d)
    model = features.nb_fit(inst)
    return features.nb_predict(inst, model).select("inst_id", "pos", F.round("log_odds", 6).alias("log_odds"), "boundary")


@query(
    f"""with b as (select inst_id, list(pos) as b from {_ODDS} where log_odds >= 0 group by inst_id),
    c as (select i.inst_id, text, list_sort(list_distinct(list_concat([0, length(text)], coalesce(b, [])))) as c from (select distinct * from token_instances) i left join b on b.inst_id = i.inst_id where text is not null)
    select inst_id, array_to_string(list_filter(list_transform(range(1, len(c)), lambda k: trim(substr(text, cast(c[k] + 1 as bigint), cast(c[k + 1] - c[k] as bigint)))), lambda x: x <> ''), '|') as tokens from c"""
)
def nb_tokenize(spark, d):
    inst = _instances(spark, d)
    t = features.nb_tokens(inst, features.nb_predict(inst, features.nb_fit(inst)))
    return t.select("inst_id", F.array_join("tokens", "|").alias("tokens"))


@query()
def lr_splitter(spark, d):
    f = features.boundary_features(_sentences(spark, d).withColumn("sentence", F.col("ex_id")).withColumn("ex_id", F.floor(F.col("ex_id") / 16)))
    p = features.lr_predict(f, features.lr_fit(f))
    s = sentences.by_predictions(p.withColumn("pos", F.struct(F.col("sentence").alias("s"), "pos")).drop("sentence"), "ex_id")
    return s.select("ex_id", "sentence", F.array_join("tokens", " ").alias("text"))


# evaluation -------------------------------------------------------------------------------------------------------

_ENDS = "list_transform(range(1, len(t) + 1), lambda i: list_sum(list_transform(t[1:i], lambda x: length(x))) + i - 1)"


@query(
    f"""with g as (select inst_id, list_filter(gold_tokens, lambda x: x is not null) as t from (select distinct * from token_instances) where gold_tokens is not null)
    select inst_id, array_to_string(list_transform({_ENDS}, lambda x: cast(x as bigint)), ',') as ends from g"""
)
def token_ends(spark, d):
    t = _instances(spark, d).where("gold_tokens is not null")
    return t.select("inst_id", F.array_join(evaluate.ends(F.filter("gold_tokens", lambda x: x.isNotNull())), ",").alias("ends"))


_SETS = f"""(select inst_id, list_filter(boundaries, lambda x: x is not null) as g, list_transform(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) <> ' ' and (i = length(text) or substr(text, i + 1, 1) = ' ')), lambda i: cast(i as int)) as p
    from (select distinct * from token_instances) where text is not null and boundaries is not null)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    i = _instances(spark, d).where("text is not null and boundaries is not null")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: (F.substring("text", i, F.lit(1)) != " ") & ((i == F.length("text")) | (F.substring("text", i + 1, F.lit(1)) == " ")))
    return i.select("inst_id", F.filter("boundaries", lambda x: x.isNotNull()).alias("g"), F.filter(at, lambda i: i <= F.length("text")).alias("p"))


@query(
    f"""with s as (select inst_id, len(list_distinct(g)) as ng, len(list_distinct(p)) as np, len(list_intersect(g, p)) as tp from {_SETS}),
    q as (select *, case when np > 0 then tp / np else 0 end as pr, case when ng > 0 then tp / ng else 0 end as re from s)
    select inst_id, case when ng = 0 and np = 0 then 1.0 else round(pr, 9) end as precision, case when ng = 0 and np = 0 then 1.0 else round(re, 9) end as recall,
    case when ng = 0 and np = 0 then 1.0 when pr + re > 0 then round(2 * pr * re / (pr + re), 9) else 0.0 end as f1 from q"""
)
def span_prf(spark, d):
    s = _sets(spark, d).select("inst_id", evaluate.prf_sets(F.col("g"), F.col("p")).alias("s"))
    return s.select("inst_id", *(F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1")))


@query(
    f"""select inst_id, array_to_string(list_sort(list_distinct(list_concat(g, p))), ',') as either, array_to_string(list_sort(list_distinct(list_intersect(g, p))), ',') as both_,
    array_to_string(list_sort(list_distinct(list_filter(p, lambda x: not list_contains(g, x)))), ',') as only_pred from {_SETS}"""
)
def hybrid_or_and(spark, d):
    s = _sets(spark, d)
    j = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select("inst_id", j(F.array_union("g", "p")).alias("either"), j(F.array_intersect("g", "p")).alias("both_"), j(F.array_except("p", "g")).alias("only_pred"))


_PRF = lambda g, p: f"[len(list_intersect({g}, {p})), len(list_distinct({p})), len(list_distinct({g}))]"


@query(
    f"""with s as (select inst_id, g, p, list_filter(p, lambda x: x % 2 = 0) as q from {_SETS}), e as (select unnest([{{'system': 'p', 's': {_PRF('g', 'p')}}}, {{'system': 'q', 's': {_PRF('g', 'q')}}},
    {{'system': 'either', 's': {_PRF('g', 'list_distinct(list_concat(p, q))')}}}, {{'system': 'both', 's': {_PRF('g', 'list_intersect(p, q)')}}}]) as e from s),
    f as (select e.system as system, e.s[1] as tp, e.s[2] as np, e.s[3] as ng from e), h as (select system, case when ng = 0 and np = 0 then 1.0 when np = 0 then 0.0 else tp / np end as p, case when ng = 0 and np = 0 then 1.0 when ng = 0 then 0.0 else tp / ng end as r from f)
    select system, count(*) as rows, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 6) as f1 from h group by system"""
)
def hybrid_scores(spark, d):
    s = _sets(spark, d).withColumn("q", F.filter("p", lambda x: x % 2 == 0))
    h = evaluate.hybrid_scores(s, "g", "p", "q")
    return h.select("system", "rows", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(
    """with i as (select inst_id, text, list_filter(gold_tokens, lambda t: t is not null and t <> '') as t from (select distinct * from token_instances) where text is not null and gold_tokens is not null),
    e as (select inst_id, list_reduce(list_concat([{'t': '', 'e': [0]}], list_transform(t, lambda x: {'t': x, 'e': cast([] as int[])})), lambda a, x: {'t': x.t, 'e': case when a.e[-1] < 0 then a.e when strpos(substr(text, a.e[-1] + 1), x.t) = 0 then list_append(a.e, -1)
      else list_append(a.e, cast(a.e[-1] + strpos(substr(text, a.e[-1] + 1), x.t) - 1 + length(x.t) as int)) end}).e as e from i)
    select inst_id, case when e[-1] >= 0 or len(e) = 1 then array_to_string(e[2:], ',') end as ends from e"""
)
def aligned_spans(spark, d):
    i = _instances(spark, d).where("text is not null and gold_tokens is not null")
    return i.select("inst_id", F.array_join(evaluate.boundaries(F.col("text"), F.col("gold_tokens")), ",").alias("ends"))


@query()
def hybrid_tokenizers(spark, d):
    i = _instances(spark, d)
    tokens = features.nb_tokens(i, features.nb_predict(i, features.nb_fit(i)))
    h = evaluate.hybrid_tokenizers(i, tokens)
    return h.select("system", "rows", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_FOUND_SPANS = lambda t: f"""list_reduce(list_concat([{{'t': '', 'at': 0, 'e': cast([] as varchar[])}}], list_transform(list_filter({t}, lambda x: x is not null and trim(x) <> ''), lambda x: {{'t': trim(x), 'at': 0, 'e': cast([] as varchar[])}})),
    lambda a, x: case when strpos(substr(text, a.at + 1), x.t) = 0 then a else {{'t': x.t, 'at': cast(a.at + strpos(substr(text, a.at + 1), x.t) - 1 + length(x.t) as int),
    'e': list_append(a.e, (a.at + strpos(substr(text, a.at + 1), x.t) - 1) || '-' || (a.at + strpos(substr(text, a.at + 1), x.t) - 1 + length(x.t)))}} end).e"""  # noqa: E731


@query(
    f"""with i as (select inst_id, text, gold_tokens, {_WST(_SPACED.replace('raw_text', 'text'))} as p from (select distinct * from token_instances) where text is not null and gold_tokens is not null),
    s as (select inst_id, list_distinct({_FOUND_SPANS('gold_tokens')}) as g, list_distinct({_FOUND_SPANS('p')}) as p from i),
    q as (select inst_id, len(list_intersect(g, p)) / (len(p) + 1e-12) as pr, len(list_intersect(g, p)) / (len(g) + 1e-12) as re from s)
    select inst_id, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / (pr + re + 1e-12), 6) as f1 from q"""
)
def span_scores(spark, d):
    i = _instances(spark, d).where("text is not null and gold_tokens is not null")
    s = i.select("inst_id", evaluate.span_scores(F.col("text"), F.col("gold_tokens"), tokenize.rule_tokens(F.col("text"), copulas=False)).alias("s"))
    return s.select("inst_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


_DOMAIN = "coalesce(nullif(lower(trim(domain)), ''), 'unknown')"


@query(
    f"""with t as (select ex_id, {_DOMAIN} as domain, {_WST('raw_text')} as r, {_WST(_trl('raw_text'))} as p, {_WST('gold_text')} as g from examples where raw_text is not null and gold_text is not null),
    z as (select domain, p = g as exact, len(g) as ng, list_filter(list_zip(r, p, g), lambda x: x[1] is not null and x[2] is not null and x[3] is not null) as z from t),
    s as (select domain, exact, ng, len(list_filter(z, lambda x: x[2] = x[3])) as same, len(list_filter(z, lambda x: x[1] <> x[3] and x[2] = x[3])) as tp, len(list_filter(z, lambda x: x[1] = x[3] and x[2] <> x[1])) as fp,
      len(list_filter(z, lambda x: x[1] <> x[3] and x[2] <> x[3])) as fn from z)
    select domain, count(*) as sentences, cast(sum(exact::int) as bigint) as exact, cast(sum(same) as bigint) as same, cast(sum(ng) as bigint) as tokens, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn,
    round(case when sum(tp + fp) > 0 then sum(tp) / sum(tp + fp) else 0 end, 9) as precision, round(case when sum(fn) = 0 then 1 else sum(tp) / sum(tp + fn) end, 9) as recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp + fn)), 9) as f1 from s group by domain"""
)
def edit_scores(spark, d):
    e = table(spark, d, "examples").where("raw_text is not null and gold_text is not null")
    dom = F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("unknown"))
    raw = F.col("raw_text")
    rows = e.select(dom.alias("domain"), chars.ws_tokens(raw).alias("raw"), chars.ws_tokens(chars.tr_lower(raw)).alias("pred"), chars.ws_tokens(F.col("gold_text")).alias("gold"))
    r = evaluate.score_texts(rows, ["domain"])
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "with n as (select count(*) as n, cast(floor(count(*) * 0.1) as bigint) as h from examples) select ex_id, case when row_number() over (order by ex_id desc) <= (select h from n) then 'dev' else 'train' end as part from examples"
)
def train_dev_split(spark, d):
    return evaluate.split_train_dev(table(spark, d, "examples").select("ex_id"), "ex_id")


@query("select ex_id, raw_text as pred, gold_text as gold from examples where raw_text <> gold_text order by ex_id limit 20")
def error_samples(spark, d):
    return evaluate.error_samples(table(spark, d, "examples").select("ex_id", F.col("raw_text").alias("pred"), F.col("gold_text").alias("gold")), "ex_id")


# sources over the tables --------------------------------------------------------------------------------------------


@query(
    f"""select ex_id, rtrim(string_agg(form || case when coalesce(contains(misc, 'SpaceAfter=No'), false) then '' else ' ' end, '' order by id)) as text
    from (select ex_id, id, min(form) as form, min(misc) as misc from {_CONLLU} group by ex_id, id) group by ex_id"""
)
def conllu_text(spark, d):
    t = _conllu(spark, d).groupBy("ex_id", "id").agg(F.min("form").alias("form"), F.min("misc").alias("misc"))
    s = t.groupBy("ex_id").agg(F.array_sort(F.collect_list(F.struct("id", "form", "misc"))).alias("t"))
    return s.select("ex_id", readers.surface(F.col("t")).alias("text"))


_PAIR_SENTENCES = """(with p as (select file_key, line_no, any_value(is_begin) as is_begin, any_value(raw) as raw, any_value(gold) as gold from noisy_pairs group by file_key, line_no),
    s as (select *, sum(coalesce(is_begin, false)::int) over (partition by file_key order by line_no) as sentence from p)
    select file_key, sentence, coalesce(list(raw order by line_no) filter (where raw is not null and raw <> '_'), []) as raw, coalesce(list(gold order by line_no) filter (where gold is not null and gold <> '_'), []) as gold from s group by file_key, sentence)"""


@query(f"select raw[i] as raw, gold[i] as gold, count(*) as n from (select raw, gold, unnest(range(1, len(raw) + 1)) as i from {_PAIR_SENTENCES} where len(raw) = len(gold)) group by 1, 2")
def zipped_pairs(spark, d):
    return readers.zipped_pairs(readers.pair_sentences(table(spark, d, "noisy_pairs"))).groupBy("raw", "gold").agg(F.count("*").alias("n"))


@query("select ex_id, sent_id from examples order by ex_id limit 100")
def first_sentences(spark, d):
    return readers.first_sentences(table(spark, d, "examples").select("ex_id", "sent_id"), 100, "ex_id")


_SENTENCE_ENDS = lambda c: f"list_distinct(flatten(list_transform({c}, lambda s: list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + i - 1))))"


@query(
    f"""with e as (select ex_id, [{_WST('raw_text')}, {_WST('gold_text')}] as g, [{_WST('gold_text')}] as p from examples where raw_text is not null and gold_text is not null),
    s as (select ex_id, {_SENTENCE_ENDS('g')} as g, {_SENTENCE_ENDS('p')} as p from e), q as (select ex_id, len(list_intersect(g, p)) as tp, len(g) as ng, len(p) as np from s)
    select ex_id, round(case when np > 0 then tp / np else 0 end, 9) as precision, round(case when ng = tp then 1 else tp / ng end, 9) as recall from q"""
)
def sentence_scores(spark, d):
    """Token ends of two sentences against those of one."""
    e = table(spark, d, "examples").where("raw_text is not null and gold_text is not null")
    raw, gold = chars.ws_tokens(F.col("raw_text")), chars.ws_tokens(F.col("gold_text"))
    s = e.select("ex_id", evaluate.sentence_scores(F.array(raw, gold), F.array(gold)).alias("s"))
    return s.select("ex_id", F.round("s.precision", 9).alias("precision"), F.round("s.recall", 9).alias("recall"))


@query(
    """with p as (select file_key, line_no, any_value(is_begin) as is_begin, any_value(raw) as raw, any_value(gold) as gold from noisy_pairs group by file_key, line_no),
    s as (select *, sum(coalesce(is_begin, false)::int) over (partition by file_key order by line_no) as sentence from p)
    select file_key, cast(sentence as bigint) as sentence, array_to_string(list(raw order by line_no) filter (where raw is not null and raw <> '_'), ' ') as raw, array_to_string(list(gold order by line_no) filter (where gold is not null and gold <> '_'), ' ') as gold from s group by file_key, sentence"""
)
def pair_sentences(spark, d):
    s = readers.pair_sentences(table(spark, d, "noisy_pairs"))
    return s.select("file_key", F.col("sentence").cast("long").alias("sentence"), F.nullif(F.array_join("raw", " "), F.lit("")).alias("raw"), F.nullif(F.array_join("gold", " "), F.lit("")).alias("gold"))


@query("select ex_id, lower(trim(domain)) as domain, cast(len(gold_tokens) as int) as tokens from examples where raw_text is not null and len(gold_tokens) > 0 and lower(trim(domain)) in ('boun', 'iwt')")
def tokenization_source(spark, d):
    r = readers.for_tokenization(table(spark, d, "examples"), ["boun", "iwt"])
    return r.select("ex_id", F.lower(F.trim("domain")).alias("domain"), F.size("gold_tokens").alias("tokens"))


# the whole pipeline -------------------------------------------------------------------------------------------------


def _flat(p: DataFrame) -> DataFrame:
    nested = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), "|").alias(c)
    return p.select("ex_id", "normalized", F.array_join("tokens", "|").alias("tokens"), nested("sentences"), nested("stems"), F.array_join("content", "|").alias("content"))


@query()
def _pipeline(spark, d):
    suffixes = stem.suffix_pairs(table(spark, d, "conllu_tokens"))
    return _flat(pipeline.process(table(spark, d, "examples"), _lexicon(spark, d), _prior(spark, d), suffixes=suffixes))


@query()
def pipeline_models(spark, d):
    f = features.boundary_features(_sentences(spark, d).withColumn("sentence", F.col("ex_id")).withColumn("ex_id", F.floor(F.col("ex_id") / 16)))
    bayes, regression = features.nb_fit(_instances(spark, d)), features.lr_fit(f)
    return _flat(pipeline.process(table(spark, d, "examples"), _lexicon(spark, d), _prior(spark, d), suffixes=stem.suffix_pairs(table(spark, d, "conllu_tokens")), tokenizer=bayes, splitter=regression))


_RUNS = lambda x: f"list_reduce(list_transform(string_split({x}, ''), lambda c: [c]), lambda a, c: case when {_ONE('a[len(a)]', 1)} = {_ONE('c[1]', 1)} and c[1] not in (chr(10), chr(13), chr(133), chr(8232), chr(8233)) then list_concat(a[1:len(a) - 1], [a[len(a)] || c[1]]) else list_concat(a, c) end)"
_SHRUNK = lambda x: f"case when {x} = '' then '' else array_to_string(list_transform({_RUNS(x)}, lambda r: case when length(r) > 2 then substr(r, 1, 1) || substr(r, 1, 1) else r end), '') end"
_CUT = lambda w: f"case when length({w}) > 3 and regexp_matches({w}, '(?s)^.{{2,}}?({'|'.join(stem.SUFFIXES)})$') then regexp_extract({w}, '(?s)^(.{{2,}}?)(?:{'|'.join(stem.SUFFIXES)})$', 1) else {w} end"
_STEM = lambda w: f"case when contains({w}, '''') then split_part({w}, '''', 1) else {_ii(f"left({_CUT(w)}, length({_CUT(w)}) - 1) || translate(right({_CUT(w)}, 1), 'bcdgğ', 'pçtkk')")} end"
_SIMPLE = r"""regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(10), ' '), '(\d)\.', '\1' || chr(2), 'g'), '\.(\d)', chr(2) || '\1', 'g'), '(^|[\s("])([A-Za-z])\.', '\1\2' || chr(2), 'g')"""


@query(
    f"""with n as (select ex_id, trim(regexp_replace(s, '{_WS}', ' ', 'g')) as normalized from (select ex_id, {_SHRUNK('s')} as s from (select ex_id, {_SAN('raw_text')} as s from examples where raw_text is not null))),
    t as (select *, flatten(list_transform({_WST(_SPACED.replace('raw_text', 'normalized'))}, lambda x: string_split({_PARTS('x')}, '|'))) as t,
      list_filter(list_transform(string_split(replace(regexp_replace({_SIMPLE.format(x='normalized')}, '(\\.|[!?]{{1,3}})', '\\1' || chr(1), 'g'), chr(2), '.'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from n)
    select ex_id, normalized, array_to_string(t, '|') as tokens, array_to_string(s, '|') as sentences, array_to_string(list_transform(t, lambda w: {_STEM('w')}), '|') as stems,
    array_to_string(list_filter(t, lambda w: not list_contains({_STOP}, {_LOWJ('w')})), '|') as content from t"""
)
def pipeline_light(spark, d):
    p = pipeline.process_light(table(spark, d, "examples").where("raw_text is not null"))
    return p.select("ex_id", "normalized", *(F.array_join(c, "|").alias(c) for c in ("tokens", "sentences", "stems", "content")))
