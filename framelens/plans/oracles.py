"""The same queries in SQL for DuckDB, written on their own: another engine, other functions, same rows."""

from __future__ import annotations

from framelens import lexicons as L

#: Whitespace as Unicode has it (the engine's own class is ASCII only), and what a word consists of.
WS = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]
NW = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"

ORACLES: dict[str, str] = {}


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ins(terms) -> str:
    return "(" + ", ".join(map(s, terms)) + ")"


A = "a AS (SELECT * FROM sample_articles WHERE article_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC) = 1)"
FACTS = "f AS (SELECT DISTINCT article_id, source, frame_type, demographic_group, count, coded_at FROM coding_facts)"
FRAMES = ", ".join(f"({s(f)})" for f in L.FRAMES)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def trim_ws(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def n_words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '{WS}+'), lambda x: x <> ''))"


def cleaned(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, 'https?://{NWS}+', '', 'g'), '{WS}+', ' ', 'g'), ' ')"


def sents(c: str) -> str:
    pieces = f"string_split(regexp_replace({c}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda x: {trim_ws('x')}), lambda x: length(x) > 10)"


def ascii_words(c: str) -> str:
    """Letters beyond ASCII as one ASCII letter, for the engine's word boundary knows no others. Lengths stay as they are."""
    return f"regexp_replace({c}, '[^\\x00-\\x7F\\P{{L}}]', 'z', 'g')"


def paras(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '\\n{WS}*\\n'), lambda x: {trim_ws('x')}), lambda x: length(x) > 20)"


def doubled(c: str) -> str:
    """Every character that is no part of a word twice, so that matches that touch don't share it."""
    return f"(' ' || regexp_replace(lower({c}), '({NW})', '\\1\\1', 'g') || ' ')"


def hits(p: str, pattern: str) -> str:
    """Matches of a whole-word pattern in a doubled text. The pattern's own separators must be doubled."""
    return f"regexp_extract_all({p}, '{NW}({pattern}){NW}', 1)"


def dbl(term: str) -> str:
    """A literal term for ``hits``."""
    return "".join(ch if ch.isalnum() or ch == "_" else ("''" * 2 if ch == "'" else ("\\-\\-" if ch == "-" else ch * 2)) for ch in term)


# --- corpus
ORACLES["source_counts"] = with_(A) + "SELECT source, count(*) AS n FROM a GROUP BY source"
ORACLES["canonical_sources"] = with_(A, "m AS (SELECT lower(trim(variant)) AS v, min(source) AS s FROM source_mapping GROUP BY 1)") + "SELECT lower(coalesce(m.s, trim(a.source))) AS canonical_source, count(*) AS n FROM a LEFT JOIN m ON lower(trim(a.source)) = m.v GROUP BY 1"
ORACLES["article_lengths"] = with_(A) + f"SELECT article_id, length(content) AS content_length, {n_words('content')} AS word_count FROM a"
ORACLES["source_filter"] = "WITH o AS (SELECT * FROM sample_articles WHERE source = 'Shamidun Ledger' QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC) = 1) " + f"SELECT article_id, source, length(content) AS content_length, {n_words('content')} AS word_count FROM o"
ORACLES["length_stats"] = with_(A, f"l AS (SELECT length(content) AS c, {n_words('content')} AS w FROM a)") + "SELECT round(avg(c), 6) AS mean_chars, round(avg(w), 6) AS mean_words, min(w) AS min_words, max(w) AS max_words FROM l"
ORACLES["document_lengths"] = f"SELECT doc_id, length(text) AS content_length, {n_words('text')} AS word_count FROM documents"
_UNNEST = "SELECT article_id, source, e.key AS frame_type, unnest(map_entries(e.value)) AS g FROM (SELECT article_id, source, unnest(map_entries(human_coding)) AS e FROM a) WHERE e.value IS NOT NULL"
ORACLES["coding_facts"] = with_(A) + f"SELECT article_id, source, frame_type, g.key AS demographic_group, g.value AS count FROM ({_UNNEST})"
ORACLES["parsed_coding"] = with_(A) + "SELECT article_id, " + ", ".join(f"coalesce(cardinality(human_coding[{s(f)}]), 0)::BIGINT AS {f}" for f in L.FRAMES) + " FROM a"
_N_CELLS = "coalesce(list_sum(list_transform(map_values(human_coding), lambda g: coalesce(cardinality(g), 0))), 0)"
_ISSUE = "(content IS NULL OR length(content) < 50) AS short, (human_coding IS NULL OR cardinality(human_coding) = 0) AS uncoded"
ORACLES["validation_report"] = (
    with_(A, f"i AS (SELECT *, {_ISSUE}, {_N_CELLS} AS cells FROM a)")
    + "SELECT count(*) AS total_articles, count(DISTINCT source) AS n_sources, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (content IS NULL) AS missing_content, sum(cells)::BIGINT AS total_annotations, count(*) FILTER (uncoded) AS uncoded_articles, (count(*) FILTER (short) + count(*) FILTER (uncoded)) AS n_issues, CASE WHEN sum(cells) = 0 THEN count(*) ELSE 0 END AS missing_coding, (count(*) FILTER (short OR uncoded)) = 0 AS is_valid FROM i"
)
ORACLES["validation_issues"] = with_(A, f"i AS (SELECT article_id, {_ISSUE} FROM a)") + "SELECT article_id, 'content too short or missing' AS issue FROM i WHERE short UNION ALL SELECT article_id, 'no human coding' FROM i WHERE uncoded"
_RANKED = "r AS (SELECT article_id, row_number() OVER (ORDER BY md5(article_id || '_42'), article_id) AS k, count(*) OVER () AS n FROM a)"
_SPLIT = "CASE WHEN k <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split"
ORACLES["split_sizes"] = with_(A, _RANKED) + f"SELECT split, count(*) AS n FROM (SELECT {_SPLIT} FROM r) GROUP BY split"
ORACLES["split_assignment"] = with_(A, _RANKED) + f"SELECT article_id, {_SPLIT} FROM r"
ORACLES["stratified_split"] = with_(A, "r AS (SELECT coalesce(lower(trim(source)), '') AS stratum, row_number() OVER (PARTITION BY coalesce(lower(trim(source)), '') ORDER BY md5(article_id || '_42'), article_id) AS k, count(*) OVER (PARTITION BY coalesce(lower(trim(source)), '')) AS n FROM a)") + f"SELECT stratum, split, count(*) AS n FROM (SELECT stratum, {_SPLIT} FROM r) GROUP BY 1, 2"
ORACLES["article_batches"] = with_(A, "r AS (SELECT coalesce(lower(trim(source)), '') AS stratum, row_number() OVER (PARTITION BY coalesce(lower(trim(source)), '') ORDER BY article_id) AS k FROM a)") + "SELECT stratum, ((k - 1) // 32)::BIGINT AS batch, count(*) AS n FROM r GROUP BY 1, 2"
ORACLES["current_splits"] = "SELECT split, count(*) AS n FROM (SELECT DISTINCT article_id, CASE lower(trim(split)) WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS split FROM article_splits) GROUP BY split"

# --- text
ORACLES["clean_text_stats"] = with_(A, f"c AS (SELECT article_id, {cleaned('content')} AS t FROM a)") + f"SELECT article_id, length(t) AS cleaned_length, {n_words('t')} AS cleaned_words, md5(coalesce(t, '')) AS cleaned_md5 FROM c"
_S = f"s AS (SELECT article_id, content, {sents('content')} AS s FROM a WHERE content IS NOT NULL)"
ORACLES["sentence_counts"] = with_(A, _S) + "SELECT article_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s"
ORACLES["paragraph_counts"] = with_(A, f"p AS (SELECT article_id, {paras('content')} AS p FROM a WHERE content IS NOT NULL)") + "SELECT article_id, len(p) AS n_paragraphs, md5(array_to_string(p, '|')) AS paragraphs_md5 FROM p"
_BOUNDS = "CASE WHEN len(s) <= 3 THEN [{'b': 0, 'e': len(s) - 1}] ELSE list_concat(list_transform(range(0, len(s) - 2, 2), lambda i: {'b': i, 'e': i + 2}), CASE WHEN len(s) % 2 = 0 THEN [{'b': len(s) - 2, 'e': len(s) - 1}] ELSE [] END) END"
_W = f"w AS (SELECT article_id, s, unnest({_BOUNDS}) AS w, generate_subscripts({_BOUNDS}, 1) - 1 AS window_id FROM s)"
_WT = "t AS (SELECT article_id, window_id, w.b AS start_idx, w.e AS end_idx, array_to_string(s[w.b + 1 : w.e + 1], ' ') AS text FROM w)"
ORACLES["sliding_windows"] = with_(A, _S, _W, _WT) + "SELECT article_id, window_id, start_idx, end_idx, md5(text) AS text_md5 FROM t"
_Q = [q.replace(r"\s", WS) for q in L.QUOTE_PATTERNS]
_QUOTES = " + ".join(f"len(regexp_extract_all(content, {s('(?i)' + q)}))" for q in _Q)
ORACLES["segment_metadata"] = (
    with_(A, _S)
    + f"SELECT article_id, len(s) AS total_sentences, len({paras('content')}) AS total_paragraphs, CASE WHEN len(s) <= 3 THEN 1 ELSE len(range(0, len(s) - 2, 2)) + (len(s) % 2 = 0)::INT END AS total_windows, {_QUOTES} AS total_quotes, CASE WHEN len(s) = 0 THEN 0.0 ELSE round(list_sum(list_transform(s, lambda x: {n_words('x')})) / len(s), 6) END AS avg_sentence_length FROM s"
)
ORACLES["keyword_totals"] = with_(A) + " UNION ALL ".join(f"SELECT {s(f)} AS frame, sum(len(regexp_extract_all(lower(content), {s('|'.join(t))})))::BIGINT AS occurrences FROM a" for f, t in L.CORPUS_KEYWORDS.items())


def positions(terms, size_cols: str) -> str:
    """CTEs: every whole-word match of terms with its offset, from the lengths of the pieces between and of the matches."""
    rows = ", ".join(f"({i}, {s(t)})" for i, t in enumerate(terms))
    return (
        f"terms(no, term) AS (VALUES {rows}), "
        f"l AS (SELECT article_id, content, {ascii_words('lower(content)')} AS low, no, term FROM a, terms WHERE contains(lower(content), lower(term))), "
        "m AS (SELECT *, string_split_regex(low, '\\b' || regexp_escape(lower(term)) || '\\b') AS parts FROM l), "
        f"p AS (SELECT article_id, content, no, term, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(term))) AS pos FROM m), {size_cols}"
    )


_CTX = "c AS (SELECT article_id, term, greatest(0, pos - {n})::BIGINT AS ctx_start, least(length(content), pos + length(term) + {n})::BIGINT AS ctx_end, substring(content, greatest(0, pos - {n})::BIGINT + 1, (least(length(content), pos + length(term) + {n}) - greatest(0, pos - {n}))::BIGINT) AS context FROM p)"
ORACLES["leadership_contexts"] = with_(A, positions(L.LEADERSHIP_TERMS, _CTX.format(n=100))) + "SELECT article_id, term, ctx_start, ctx_end, md5(context) AS context_md5 FROM c"


def _group_pattern(p: str) -> str:
    return p.replace("[- ]", "(?:--|  )").replace("people of color", "people  of  color")


def _restored(h: str) -> str:
    return f"list_transform({h}, lambda x: replace(replace(x, '  ', ' '), '--', '-'))"


_D = "d AS (SELECT article_id, " + ", ".join(f"{_restored(hits('p', _group_pattern(p)))} AS {g}" for g, p in L.GROUP_PATTERNS.items()) + f" FROM (SELECT article_id, {doubled('content')} AS p FROM a WHERE content IS NOT NULL))"
_COLOR = "(len(black) > 0 OR len(hispanic) > 0 OR len(asian) > 0 OR len(poc) > 0)"
_DERIVED = {"women_of_color": f"len(women) > 0 AND {_COLOR}", "white_men": "len(men) > 0 AND len(white) > 0", "white_women": "len(women) > 0 AND len(white) > 0", "men_of_color": f"len(men) > 0 AND {_COLOR}"}
ORACLES["demographic_hits"] = with_(A, _D) + " UNION ALL ".join([*(f"SELECT article_id, {s(g)} AS grp, len({g}) AS n, array_to_string({g}, ',') AS hits FROM d WHERE len({g}) > 0" for g in L.GROUP_PATTERNS), *(f"SELECT article_id, {s(g)}, 1, {s(g.replace('_', ' '))} FROM d WHERE {c}" for g, c in _DERIVED.items())])
ORACLES["intersectional_flags"] = with_(A, _D) + "SELECT article_id, " + ", ".join(f"({c})::INT AS {g}" for g, c in _DERIVED.items()) + " FROM d"
_SIMPLE = {g: f"len({hits('p', _group_pattern(p).replace('african american', 'african  american'))}) > 0" for g, p in L.SIMPLE_GROUPS.items()}
ORACLES["simple_demographics"] = (
    with_(A, "d AS (SELECT article_id, " + ", ".join(f"{c} AS {g}" for g, c in _SIMPLE.items()) + f" FROM (SELECT article_id, {doubled('content')} AS p FROM a WHERE content IS NOT NULL))")
    + "SELECT article_id, concat_ws(',', CASE WHEN women THEN 'women' END, CASE WHEN men THEN 'men' END, CASE WHEN white THEN 'white' END, CASE WHEN black THEN 'black' END, CASE WHEN poc THEN 'poc' END, CASE WHEN women AND (black OR poc) THEN 'women_of_color' END, CASE WHEN men AND white THEN 'white_men' END) AS groups FROM d"
)
_PCT = "(?i)" + L.PERCENTAGE.replace(r"\d", r"\p{Nd}").replace(r"\s", WS)
_CMP = "(?i)" + L.COMPARISON.replace(r"\d", r"\p{Nd}").replace(r"\s", WS)


def _stat(kind: str, pattern: str, direction: str) -> str:
    return (
        f"SELECT article_id, {s(kind)} AS type, content, unnest(regexp_extract_all(content, {s(pattern)}, 1)) AS value, {direction} AS direction, unnest(regexp_extract_all(content, {s(pattern)}, 0)) AS hit, "
        f"unnest(list_transform(range(1, len(regexp_extract_all(content, {s(pattern)}, 0)) + 1), lambda i: list_sum(list_transform(string_split_regex(content, {s(pattern)})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(content, {s(pattern)}, 0)[1:i - 1], lambda x: length(x))), 0))) AS pos FROM a WHERE content IS NOT NULL"
    )


_STATS = f"t AS ({_stat('percentage', _PCT, 'NULL')} UNION ALL {_stat('comparison', _CMP, f'unnest(regexp_extract_all(content, {s(_CMP)}, 2))')})"
ORACLES["statistics_extract"] = with_(A, _STATS) + "SELECT article_id, type, value, direction, md5(substring(content, greatest(0, pos - 50)::BIGINT + 1, (pos + length(hit) + 50 - greatest(0, pos - 50))::BIGINT)) AS context_md5 FROM t"
_CLEAN = f"k AS (SELECT article_id, {ascii_words('lower(' + cleaned('content') + ')')} AS low FROM a WHERE content IS NOT NULL)"
_CAND = {f: "list_concat(" + ", ".join(f"(CASE WHEN contains(low, {s(t)}) THEN regexp_extract_all(low, {s('.{0,50}' + chr(92) + 'b' + t + chr(92) + 'b.{0,50}')}) ELSE []::VARCHAR[] END)" for t in terms) + ")" for f, terms in L.FRAME_INDICATORS.items()}
ORACLES["frame_candidates"] = with_(A, _CLEAN, " , ".join([f"x AS ({' UNION ALL '.join(f'SELECT article_id, {s(f)} AS frame, {c} AS c FROM k' for f, c in _CAND.items())})"])) + "SELECT article_id, frame, len(c) AS n, md5(array_to_string(c, '|')) AS contexts_md5 FROM x WHERE len(c) > 0"


def _quote(i: int, q: str, said: int, who: int | None) -> str:
    p = s("(?i)" + q)
    w = f"unnest(regexp_extract_all(content, {p}, {who}))" if who else "NULL"
    return f"SELECT article_id, {i}::BIGINT AS pattern_id, unnest(regexp_extract_all(content, {p}, {said})) AS t, {w} AS w, unnest(regexp_extract_all(content, {p}, 0)) AS m FROM a"


ORACLES["quotes"] = with_(A, f"q AS ({_quote(1, _Q[0], 1, 2)} UNION ALL {_quote(2, _Q[1], 2, 1)} UNION ALL {_quote(3, _Q[2], 1, None)})") + f"SELECT article_id, pattern_id, {trim_ws('t')} AS text, {trim_ws('w')} AS attribution, md5(m) AS match_md5 FROM q"
_SEG = (
    "e AS (SELECT *, pos + length(term) AS fin, greatest(0, pos - 150) AS b0, least(length(content), pos + length(term) + 150) AS e0 FROM p), "
    "g AS (SELECT *, substring(content, b0::BIGINT + 1, (pos - b0)::BIGINT) AS lft, substring(content, fin::BIGINT + 1, (e0 - fin)::BIGINT) AS rgt FROM e), "
    "h AS (SELECT *, CASE WHEN contains(lft, '.') THEN pos - strpos(reverse(lft), '.') + 1 ELSE b0 END AS b, CASE WHEN contains(rgt, '.') THEN fin + strpos(rgt, '.') ELSE e0 END AS e FROM g)"
)
ORACLES["keyword_segments"] = with_(A, positions(L.SEGMENT_KEYWORDS, _SEG)) + f"SELECT article_id, term AS keyword, (pos - b)::BIGINT AS keyword_position, b::BIGINT AS seg_start, e::BIGINT AS seg_end, md5({trim_ws('substring(content, b::BIGINT + 1, (e - b)::BIGINT)')}) AS text_md5 FROM h"
_RELEVANT = " OR ".join(f"contains(lower(t), {s(t)})" for t in L.LEADERSHIP_TERMS)
_CODED = "coalesce(list_sort(map_keys(map_from_entries(list_filter(map_entries(human_coding), lambda e: cardinality(e.value) > 0)))), [])"
_PD = "d AS (SELECT *, " + ", ".join(f"{hits('p', _group_pattern(p))} AS {g}" for g, p in L.GROUP_PATTERNS.items()) + f" FROM (SELECT *, {doubled('t')} AS p FROM t WHERE {_RELEVANT}))"
_KEYS = "array_to_string(list_sort(list_filter([" + ", ".join([*(f"CASE WHEN len({g}) > 0 THEN {s(g)} END" for g in L.GROUP_PATTERNS), *(f"CASE WHEN {c} THEN {s(g)} END" for g, c in _DERIVED.items())]) + "], lambda x: x IS NOT NULL)), ',')"
ORACLES["training_examples"] = with_(A, f"t AS (SELECT article_id, {_CODED} AS labels, unnest({paras('content')}) AS t FROM a)", _PD) + f"SELECT article_id, md5(t) AS text_md5, {_KEYS} AS demographics, array_to_string(labels, ',') AS labels FROM d"


def _any_word(p: str, terms) -> str:
    return f"len({hits(p, '|'.join(dbl(t) for t in terms))}) > 0"


_EX = "d AS (SELECT *, " + ", ".join([*(f"{hits('p', _group_pattern(p))} AS {g}" for g, p in L.GROUP_PATTERNS.items()), *(f"{_any_word('p', t)} AS fr_{f}" for f, t in L.FRAME_INDICATORS.items())]) + f" FROM (SELECT article_id, {doubled('x')} AS p FROM (SELECT article_id, unnest(s) AS x FROM s)) WHERE {_any_word('p', L.LEADERSHIP_TERMS)})"
_GROUPS_LIST = "list_filter([" + ", ".join([*(f"CASE WHEN len({g}) > 0 THEN {s(g)} END" for g in L.GROUP_PATTERNS), *(f"CASE WHEN {c} THEN {s(g)} END" for g, c in _DERIVED.items())]) + "], lambda x: x IS NOT NULL)"
ORACLES["exemplar_counts"] = (
    with_(A, _S, _EX, "e AS (" + " UNION ALL ".join(f"SELECT article_id, {s(f)} AS frame_type, unnest({_GROUPS_LIST}) AS demographic_group FROM d WHERE fr_{f}" for f in L.FRAME_INDICATORS) + ")")
    + "SELECT frame_type, demographic_group, count(*) AS exemplars, count(DISTINCT article_id) AS n_articles FROM e GROUP BY 1, 2"
)
_CT = f"c AS (SELECT article_id, {cleaned('content')} AS t FROM a WHERE content IS NOT NULL)"
_PP = f"d AS (SELECT article_id, t, {ascii_words('lower(t)')} AS low, " + ", ".join(f"{hits('p', _group_pattern(p))} AS {g}" for g, p in L.GROUP_PATTERNS.items()) + f" FROM (SELECT *, {doubled('t')} AS p FROM c))"
_LEAD = " + ".join(f"(len(string_split_regex(low, {s(chr(92) + 'b' + t + chr(92) + 'b')})) - 1)" for t in L.LEADERSHIP_TERMS)
_CMD5 = "md5(concat_ws('|', " + ", ".join(f"array_to_string({c}, '|')" for f in L.FRAMES for c in [_CAND[f]]) + "))"
_CKEYS = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len({c}) > 0 THEN {s(f)} END" for f, c in _CAND.items()) + "], lambda x: x IS NOT NULL)), ',')"
ORACLES["preprocessed"] = (
    with_(A, _CT, _PP)
    + f"SELECT article_id, {n_words('t')} AS word_count, len({sents('t')}) AS sentence_count, md5(t) AS cleaned_md5, md5(array_to_string({sents('t')}, '|')) AS sentences_md5, md5(array_to_string({paras('t')}, '|')) AS paragraphs_md5, {_CMD5} AS candidates_md5, {_LEAD} AS n_leadership_contexts, len(regexp_extract_all(t, {s(_PCT)})) + len(regexp_extract_all(t, {s(_CMP)})) AS n_statistics, len({paras('t')}) AS n_paragraphs, {_KEYS} AS demographics, {_CKEYS} AS candidates FROM d"
)

# --- features
_B = f"b AS (SELECT article_id, content, string_split_regex(lower(content), '{NW}+') AS tok, {doubled('content')} AS p, {n_words('content')} AS nw FROM a WHERE content IS NOT NULL)"


def count_terms(terms) -> str:
    single = [t for t in terms if t.isalnum()]
    parts = [f"len(list_filter(tok, lambda x: x IN {ins(single)}))"] if single else []
    parts += [f"len({hits('p', dbl(t))})" for t in terms if not t.isalnum()]
    return "(" + " + ".join(parts) + ")"


_LEX: dict[str, str] = {}
for _f, _cats in L.FRAME_LEXICONS.items():
    for _c, _t in _cats.items():
        _LEX[f"{_f}_{_c}_count"] = count_terms(_t)
    _LEX[f"{_f}_total_score"] = "(" + " + ".join(f"{L.CATEGORY_WEIGHTS.get(_c, 1.0)}::DOUBLE * {_LEX[f'{_f}_{_c}_count']}" for _c in _cats) + ")"
_LEXALL = {**{k: (f"round({v}, 6)" if "total" in k else v) for k, v in _LEX.items()}, **{f"{k}_normalized": f"CASE WHEN nw > 0 THEN round({v} / nw, 6) ELSE 0.0 END" for k, v in _LEX.items()}}
_DEM = {f"demo_{kind}_{g}": count_terms(t) for kind, groups in L.DEMOGRAPHIC_TERMS.items() for g, t in groups.items()}
_DEM["demo_intersect_black_women"] = f"CASE WHEN {_DEM['demo_gender_women']} > 0 AND {_DEM['demo_race_black']} > 0 THEN 1::BIGINT END"
_DEM["demo_intersect_white_men"] = f"CASE WHEN {_DEM['demo_gender_men']} > 0 AND {_DEM['demo_race_white']} > 0 THEN 1::BIGINT END"
_LINGP = {k: "(?i)" + p.replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Pc}]").replace(r"\s", WS).replace(r"\d", r"\p{Nd}") for k, p in L.LINGUISTIC_PATTERNS.items()}
_PIECES = f"list_filter(list_transform(string_split(content, '.'), lambda x: {n_words('x')}), lambda n: n > 0)"
_LING = {f"ling_{k}_count": f"len(regexp_extract_all({ascii_words('content')}, {s(p)}))" for k, p in _LINGP.items()} | {
    "ling_avg_sentence_length": f"round(list_avg({_PIECES}), 6)",
    "ling_num_sentences": "len(string_split(content, '.'))",
    "ling_questions": "length(content) - length(replace(content, '?', ''))",
    "ling_exclamations": "length(content) - length(replace(content, '!', ''))",
}
_VALS = f"list_transform(regexp_extract_all(content, {s(_PCT)}, 1), lambda x: x::DOUBLE)"
_NUMS = f"len(list_filter(tok, lambda x: regexp_full_match(x, '\\p{{Nd}}+')))"
_STAT = {
    "stats_has_percentages": f"(len({_VALS}) > 0)::BIGINT",
    "stats_has_numbers": f"({_NUMS} > 0)::BIGINT",
    "stats_has_comparisons": f"regexp_matches(content, {s(_CMP)})::BIGINT",
    "stats_percentage_sum": f"round(coalesce(list_sum({_VALS}), 0.0), 6)",
    "stats_min_percentage": f"round(list_min({_VALS}), 6)",
    "stats_max_percentage": f"round(list_max({_VALS}), 6)",
    "stats_count_numbers": _NUMS,
}
_CX = positions(L.POSITION_TERMS, _CTX.format(n=50)) + ", x AS (SELECT article_id, count(*) AS n, string_agg(lower(context), ' ') AS j FROM c GROUP BY article_id)"
_NEAR = {"context_leadership_mentions": "coalesce(x.n, 0)"} | {f"context_{f}_near_leadership": "CASE WHEN x.n > 0 THEN (" + " + ".join(f"contains(x.j, {s(t)})::INT" for terms in cats.values() for t in terms) + ")::BIGINT END" for f, cats in L.FRAME_LEXICONS.items()}
_SIZE = {"text_length": "length(content)", "word_count": "nw"}


def _select(*parts: dict[str, str], extra: str = "") -> str:
    cols = ", ".join(f"{v} AS {k}" for p in parts for k, v in p.items())
    return f"SELECT b.article_id, {cols} FROM b {extra}"


ORACLES["lexical_features"] = with_(A, _B) + _select(_LEXALL)
ORACLES["demographic_features"] = with_(A, _B) + _select(_DEM)
ORACLES["linguistic_features"] = with_(A, _B) + _select(_LING)
ORACLES["statistical_features"] = with_(A, _B) + _select(_STAT)
ORACLES["context_features"] = with_(A, _B, _CX) + _select(_NEAR, extra="LEFT JOIN x ON x.article_id = b.article_id")
ORACLES["all_features"] = with_(A, _B, _CX) + _select(_LEXALL, _DEM, _LING, _STAT, _NEAR, _SIZE, extra="LEFT JOIN x ON x.article_id = b.article_id")
_VEC = {k: v for p in (_LEXALL, _DEM, _LING, _STAT, _NEAR, _SIZE) for k, v in p.items() if k != "stats_percentage_sum"}
ORACLES["feature_vectors"] = with_(A, _B, _CX, "v AS (" + _select(_VEC, extra="LEFT JOIN x ON x.article_id = b.article_id") + ")") + "SELECT article_id, " + " + ".join(f"(coalesce({k}, 0) <> 0)::BIGINT" for k in _VEC) + f" AS n_nonzero, {len(_VEC)}::BIGINT AS n_features, (" + " + ".join(f"round(coalesce({k}, 0) * 1000000)::BIGINT * {i + 1}" for i, k in enumerate(sorted(_VEC))) + ")::BIGINT AS millionths FROM v"
ORACLES["multihot_labels"] = with_(A) + "SELECT article_id, " + ", ".join(f"coalesce(cardinality(human_coding[{s(f)}]) > 0, false)::BIGINT AS {f}" for f in L.FRAMES) + " FROM a"

# --- detection
_UNDER, _OBST = "(contains(lower({0}), 'only') OR contains(lower({0}), 'just'))", "(contains(lower({0}), 'barrier') OR contains(lower({0}), 'challenge'))"


def _mock(c: str) -> dict[str, str]:
    return {"underrepresentation": f"CASE WHEN {_UNDER.format(c)} THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END", "overrepresentation": "0.1::DOUBLE", "obstacles": f"CASE WHEN {_OBST.format(c)} THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END", "successes": "0.1::DOUBLE"}


def _frames(cols: dict[str, str], at: float = 0.5) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cols[f]} >= {at} THEN {s(f)} END" for f in sorted(cols)) + ")"


ORACLES["mock_predictions"] = with_(A) + f"SELECT article_id, {_frames(_mock('content'))} AS frames, " + ", ".join(f"{v} AS {k}" for k, v in _mock("content").items()) + " FROM a WHERE content IS NOT NULL"
_ENS = {f: f"(0.4 * {_mock('content')[f]} + 0.6 * (1.0 - 1.0 / (1.0 + {_LEX[f + '_total_score']})))" for f in L.FRAMES}
ORACLES["ensemble_scores"] = with_(A, _B) + f"SELECT article_id, {_frames(_ENS)} AS frames, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _ENS.items()) + " FROM b"
_PS = "p AS (SELECT DISTINCT article_id, detector, predicted_at, scores FROM predictions WHERE scores IS NOT NULL)"
ORACLES["threshold_frames"] = with_(_PS) + "SELECT article_id, detector, array_to_string(list_sort(list_transform(list_filter(map_entries(scores), lambda e: e.value >= 0.5), lambda e: e.key)), ',') AS frames, array_to_string(list_sort(list_transform(list_filter(map_entries(scores), lambda e: e.value > 0.7), lambda e: e.key)), ',') AS frames_70, coalesce(list_sum(list_transform(map_values(scores), lambda v: coalesce((v >= 0.5)::INT + (v >= 0.7)::INT + (v >= 0.9)::INT, 0))), 0)::BIGINT AS bins FROM p"
_U = "u AS (SELECT article_id, text, " + ", ".join(f"{v} AS {k}" for k, v in _mock("text").items()) + ", (contains(lower(text), 'women') OR contains(lower(text), 'woman')) AS w, (contains(lower(text), 'men') OR contains(lower(text), 'man')) AS m FROM t)"
_AN = "n AS (SELECT article_id, count(*) AS segments_analyzed, " + ", ".join(f"avg({f}) AS {f}, count(*) FILTER ({f} >= 0.5) AS n_{f}" for f in L.FRAMES) + ", bool_or(w) AS w, bool_or(m) AS m FROM u GROUP BY article_id)"
ORACLES["article_analysis"] = with_(A, _S, _W, _WT, _U, _AN) + "SELECT article_id, segments_analyzed, concat_ws(',', " + ", ".join(f"CASE WHEN n_{f} > 0 THEN {s(f)} END" for f in sorted(L.FRAMES)) + ") AS frames, concat_ws(',', CASE WHEN m THEN 'men' END, CASE WHEN w THEN 'women' END) AS demographics, " + ", ".join(f"round({f}, 6) AS {f}" for f in L.FRAMES) + ", n_underrepresentation FROM n"
ORACLES["analysis_summary"] = with_(A, _S, _W, _WT, _U, _AN) + " UNION ALL ".join(f"SELECT {s(f)} AS frame, count(*) FILTER (n_{f} > 0) AS n_articles, round(avg({f}), 6) AS mean_score FROM n" for f in L.FRAMES)

# --- coding and agreement
ORACLES["frame_summary"] = with_(FACTS) + f"SELECT frame_type AS frame, demographic_group AS demographic, sum(count) AS total_count, count(DISTINCT article_id) AS num_articles FROM f WHERE frame_type IN {ins(L.FRAMES)} AND demographic_group IN {ins(L.SUMMARY_GROUPS)} GROUP BY 1, 2 HAVING sum(count) > 0"
ORACLES["frame_totals"] = with_(FACTS) + "SELECT frame_type, sum(count) AS total_count FROM f GROUP BY 1"
ORACLES["group_totals"] = with_(FACTS) + "SELECT demographic_group, sum(count) AS total_count FROM f GROUP BY 1"
ORACLES["frame_group_totals"] = with_(FACTS) + "SELECT frame_type, demographic_group, sum(count) AS total_count FROM f GROUP BY 1, 2"
ORACLES["annotation_counts"] = with_(FACTS) + "SELECT 'frame' AS kind, frame_type AS name, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'group', demographic_group, count(*) FROM f GROUP BY 2"
_P = "p AS (SELECT article_id, list_sort(coalesce(frames, [])) AS frames, detector FROM predictions WHERE article_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY predicted_at DESC, detector DESC, list_sort(coalesce(frames, [])) DESC) = 1)"
_H = f"h AS (SELECT article_id, {_CODED} AS frames FROM a)"
ORACLES["coding_merge"] = with_(A, _P, _H) + "SELECT article_id, array_to_string(h.frames, ',') AS frames_human, array_to_string(p.frames, ',') AS frames_predicted, detector FROM h JOIN p USING (article_id)"
_FL = f"fl AS (SELECT fr.f AS frame, coalesce(list_contains(h.frames, fr.f), false) AS human, coalesce(list_contains(p.frames, fr.f), false) AS ml FROM h JOIN p USING (article_id), (VALUES {FRAMES}) fr(f))"
_CONF = "c AS (SELECT frame, count(*) FILTER (human AND ml)::DOUBLE AS tp, count(*) FILTER (NOT human AND ml)::DOUBLE AS fp, count(*) FILTER (human AND NOT ml)::DOUBLE AS fn, count(*) FILTER (NOT human AND NOT ml)::DOUBLE AS tn FROM fl GROUP BY ROLLUP (frame))"
_R = "r AS (SELECT *, tp + fp + fn + tn AS n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) ** 2) AS pe FROM c)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
ORACLES["agreement_metrics"] = with_(A, _P, _H, _FL, _CONF, _R) + " UNION ALL ".join(
    [*(f"SELECT frame || '_{k}' AS metric, round({v}, 6) AS value FROM r WHERE frame IS NOT NULL" for k, v in (("precision", "p"), ("recall", "r"), ("f1", _F1), ("kappa", "((tp + tn) / n - pe) / (1 - pe)"))), *(f"SELECT 'overall_{k}', round({v}, 6) FROM r WHERE frame IS NULL" for k, v in (("precision", "p"), ("recall", "r"), ("f1", _F1), ("accuracy", "(tp + tn) / n")))]
)
ORACLES["human_vs_ml_accuracy"] = with_(A, _P, _H, _FL) + "SELECT coalesce(frame, 'overall') AS frame, round(avg((human = ml)::INT), 6) AS accuracy FROM fl GROUP BY ROLLUP (frame)"
ORACLES["icc"] = (
    with_(A, _P, _H, _FL, "x AS (SELECT human::INT::DOUBLE AS a, ml::INT::DOUBLE AS b FROM fl)", "g AS (SELECT count(*)::DOUBLE AS n, (sum(a) + sum(b)) / (2 * count(*)) AS m, sum(a) / count(*) AS ma, sum(b) / count(*) AS mb FROM x)", "q AS (SELECT any_value(n) AS n, 2 * sum(((a + b) / 2 - m) ** 2) AS bt, sum((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2) AS wt, any_value(n * ((ma - m) ** 2 + (mb - m) ** 2)) AS ct FROM x, g)", "k AS (SELECT n, bt, wt, bt / (n - 1) AS msr, ct AS msc, (wt - ct) / (n - 1) AS mse FROM q)")
    + "SELECT n::BIGINT AS n, round((bt - wt / n) / (bt + wt / n), 6) AS icc_ref, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc_2_1 FROM k"
)
ORACLES["tfidf_terms"] = with_(A, f"w AS (SELECT DISTINCT article_id, unnest(string_split_regex(lower(content), '{NW}+')) AS term FROM a WHERE content IS NOT NULL)") + "SELECT term, count(*) AS n_articles, round(ln(((SELECT count(*) FROM a WHERE content IS NOT NULL) + 1.0) / (count(*) + 1.0)) + 1.0, 6) AS idf FROM w WHERE term <> '' GROUP BY term ORDER BY n_articles DESC, term COLLATE \"C\" LIMIT 1000"
ORACLES["source_frame_ranking"] = with_(FACTS, "t AS (SELECT coalesce(lower(trim(source)), '') AS source, frame_type, sum(count) AS total FROM f WHERE count IS NOT NULL GROUP BY 1, 2)") + "SELECT source, frame_type, total, rank() OVER (PARTITION BY source ORDER BY total DESC) AS place, round(total / sum(total) OVER (PARTITION BY source), 6) AS share FROM t"

_CS = f"s AS (SELECT article_id, {sents('t')} AS s FROM c)"
_WD = "d AS (SELECT article_id, text, " + ", ".join(f"{hits('p', _group_pattern(p))} AS {g}" for g, p in L.GROUP_PATTERNS.items()) + f" FROM (SELECT *, {doubled('text')} AS p FROM t))"
ORACLES["frame_group_matrix"] = (
    with_(A, _CT, _CS, _W, _WT, _WD, "e AS (" + " UNION ALL ".join(f"SELECT article_id, {s(f)} AS frame, unnest({_GROUPS_LIST}) AS grp FROM d WHERE {c.format('text')}" for f, c in (("underrepresentation", _UNDER), ("obstacles", _OBST))) + ")")
    + "SELECT frame, grp, count(*) AS n_windows, count(DISTINCT article_id) AS n_articles FROM e GROUP BY 1, 2"
)


# --- checks of the corpus, languages, wordings, weights of terms
ORACLES["validation_counts"] = with_(A, f"u AS ({_UNNEST})") + (
    "SELECT 'source' AS kind, source AS name, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'frame', frame_type, count(*) FROM u WHERE g IS NOT NULL GROUP BY 2 UNION ALL SELECT 'group', g.key, count(*) FROM u WHERE g IS NOT NULL GROUP BY 2"
)
ORACLES["incomplete_articles"] = "SELECT DISTINCT article_id, m AS missing FROM (SELECT article_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN {s(c)} END" for c in ("article_id", "source", "date", "title", "content", "human_coding")) + ") AS m FROM sample_articles) WHERE m <> ''"
_LETTERS = "len(regexp_extract_all(content, '[\\p{L}\\p{M}]'))"
_SCRIPT = {k: f"len(regexp_extract_all(content, '{p}'))" for k, p in L.SCRIPTS.items()}
_LANG = (
    f"n AS (SELECT article_id, {_LETTERS}::DOUBLE AS letters, " + ", ".join(f"{v} AS {k}_" for k, v in _SCRIPT.items()) + f", list_filter(string_split_regex(lower(content), '{NW}+'), lambda x: x <> '') AS w FROM a), "
    "g AS (SELECT article_id, w, letters, " + ", ".join(f"least(1, {k}_ / letters) AS {k}" for k in _SCRIPT if k not in ("ja", "zh")) + ", CASE WHEN ja_ > 0 THEN least(1, least(1, ja_ / letters) + least(1, zh_ / letters)) ELSE 0 END AS ja, CASE WHEN ja_ > 0 THEN 0 ELSE least(1, zh_ / letters) END AS zh FROM n WHERE letters > 0), "
    "h AS (SELECT *, greatest(0, 1 - (" + " + ".join(_SCRIPT) + ")) AS latin FROM g), "
    "v AS (SELECT article_id, unnest([" + ", ".join([*(f"{{'l': {s(k)}, 's': {k}::DOUBLE}}" for k in _SCRIPT), *(f"{{'l': {s(k)}, 's': (latin * len(list_filter(w, lambda x: x IN {ins(ws)})) / greatest(len(w), 1))::DOUBLE}}" for k, ws in L.FUNCTION_WORDS.items())]) + "]) AS x FROM h), "
    "l AS (SELECT article_id, x.l AS lang, x.s AS score FROM v WHERE x.s > 0 QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY x.s DESC, x.l) = 1)"
)
ORACLES["languages"] = with_(A, _LANG) + "SELECT a.article_id, l.lang, round(l.score, 6) AS score FROM a LEFT JOIN l USING (article_id)"
ORACLES["quality_issues"] = with_(A, _LANG, f"d AS (SELECT article_id, row_number() OVER (PARTITION BY {cleaned('content')} ORDER BY article_id) AS k FROM a WHERE content IS NOT NULL)") + (
    "SELECT article_id, 'too short' AS issue FROM a WHERE content IS NULL OR length(content) < 100 UNION ALL SELECT article_id, 'too long' FROM a WHERE length(content) > 50000 "
    "UNION ALL SELECT article_id, 'encoding' FROM a WHERE regexp_matches(content, '[\\x{FFFD}\\x00-\\x08\\x0E-\\x1F\\x7F]') UNION ALL SELECT article_id, 'language' FROM l WHERE lang <> 'en' UNION ALL SELECT article_id, 'duplicate' FROM d WHERE k > 1"
)
ORACLES["first_articles"] = with_(A) + "SELECT article_id, source, title FROM a ORDER BY article_id LIMIT 5"
ORACLES["fold_assignment"] = with_(A) + "SELECT article_id, ('0x' || substring(md5(article_id || '_42'), 1, 8))::BIGINT % 5 AS fold FROM a"


def _template(t: str) -> str:
    """The other engine's words are ASCII; classes take the place of its own."""
    from framelens.functions.language import template_pattern

    word = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
    return template_pattern(t).replace(r"[^\w]", NW).replace(r"\w", word).replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


ORACLES["frame_templates"] = with_(A, "w AS MATERIALIZED (SELECT article_id, lower(content) AS t FROM a)") + " UNION ALL ".join(f"SELECT article_id, {s(f)} AS frame, {s(t)} AS template FROM w WHERE regexp_matches(t, {s(_template(t))})" for f, ts in L.FRAME_TEMPLATES.items() for t in ts)
ORACLES["article_analysis_preprocessed"] = (
    with_(A, _CT, _PP, "z AS (SELECT article_id, t AS text, " + ", ".join(f"{v} AS {k}" for k, v in _mock("t").items()) + f", {_KEYS} AS k, concat_ws(',', CASE WHEN contains(lower(t), 'men') OR contains(lower(t), 'man') THEN 'men' END, CASE WHEN contains(lower(t), 'women') OR contains(lower(t), 'woman') THEN 'women' END) AS own FROM d)")
    + f"SELECT article_id, 1::BIGINT AS segments_analyzed, {_frames({f: f for f in L.FRAMES})} AS frames, CASE WHEN k <> '' THEN k ELSE own END AS demographics, " + ", ".join(f"round({f}, 6) AS {f}" for f in L.FRAMES) + " FROM z"
)
ORACLES["tfidf_weights"] = (
    with_(
        A,
        f"w AS (SELECT article_id, list_filter(string_split_regex(lower(content), '{NW}+'), lambda x: length(x) > 1) AS w FROM a WHERE content IS NOT NULL)",
        "g AS (SELECT article_id, unnest(w) AS term FROM w UNION ALL SELECT article_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)",
        "top AS (SELECT term FROM g GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 1000)",
        "tf AS (SELECT article_id, term, count(*) AS tf FROM g SEMI JOIN top USING (term) GROUP BY 1, 2)",
        "i AS (SELECT term, count(*) AS n_articles, ln(((SELECT count(*) FROM w) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf GROUP BY 1)",
        "x AS (SELECT *, tf * idf AS raw FROM tf JOIN i USING (term)), m AS (SELECT article_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY 1)",
    )
    + "SELECT term, sum(tf)::BIGINT AS tf, max(n_articles) AS n_articles, round(max(idf), 6) AS idf, round(sum(raw / norm), 4) AS weight FROM x JOIN m USING (article_id) GROUP BY 1"
)
ORACLES["frame_anova"] = (
    with_(
        FACTS,
        "i AS (SELECT DISTINCT article_id FROM f WHERE article_id IS NOT NULL)",
        f"c AS (SELECT i.article_id, t.frame_type, g.g, coalesce(sum(f.count), 0) AS x FROM i, (SELECT DISTINCT frame_type FROM f WHERE frame_type IS NOT NULL AND article_id IS NOT NULL) t, (VALUES {', '.join(f'({s(g)})' for g in L.SUMMARY_GROUPS)}) g(g) LEFT JOIN f ON f.article_id = i.article_id AND f.frame_type = t.frame_type AND f.demographic_group = g.g GROUP BY 1, 2, 3)",
        "m AS (SELECT *, avg(x) OVER (PARTITION BY frame_type) AS m, avg(x) OVER (PARTITION BY frame_type, g) AS mg, avg(x) OVER (PARTITION BY frame_type, article_id) AS ma FROM c)",
        "v AS (SELECT frame_type, count(DISTINCT article_id) AS n, sum((mg - m) ** 2) AS b, sum((ma - m) ** 2) AS a, sum((x - mg - ma + m) ** 2) AS e FROM m GROUP BY 1)",
    )
    + "SELECT frame_type, n, 5::BIGINT AS df_conditions, 5 * (n - 1) AS df_error, round(b, 4) AS ss_conditions, round(a, 4) AS ss_subjects, round(e, 4) AS ss_error, round((b / 5) / (e / (5 * (n - 1))), 4) AS f, round(b / (b + e), 4) AS partial_eta2 FROM v"
)
