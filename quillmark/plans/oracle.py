"""The same queries as DuckDB SQL, for comparison. Snippets are common table expressions that queries chain."""

from __future__ import annotations

from quillmark.functions import words as W
from quillmark.operators.fingerprint import DIMENSIONS, SIZES

_B = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _in(xs: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_B}+', ''), '{_B}+$', '')"


def _bare(x: str) -> str:
    return f"length(regexp_replace({x}, '{_B}', '', 'g'))"


def _lang(x: str) -> str:
    h, e = f"length(regexp_replace({x}, '[^一-鿿]', '', 'g'))", f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return f"CASE WHEN {h} > 0 AND {e} > 0 AND least({h}, {e}) / greatest({h}, {e}) >= 0.2 THEN 'mixed' WHEN {e} > {h} THEN 'en' ELSE 'zh' END"


_JOINED = "[A-Za-z]+(?:[-''][A-Za-z]+)*"
DOCS = "docs AS (SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL)"
SAMPLES = "samples AS (SELECT grp, work, grp || '/' || work AS label, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL AND grp IS NOT NULL AND work IS NOT NULL GROUP BY grp, work)"
CORPUS_ZH = SAMPLES + ", corpus AS (SELECT * FROM samples WHERE len(regexp_extract_all(text, '[一-鿿]')) >= 200)"
CORPUS = "corpus AS (SELECT * FROM (SELECT grp, work, grp || '/' || work AS label, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL AND grp IS NOT NULL AND work IS NOT NULL GROUP BY grp, work) WHERE len(regexp_extract_all(text, '[A-Za-z]+')) >= 200)"
_ABBR, _TITLE = _in(W.ABBREVIATIONS), _in(W.TITLES)
_LOW = r"(?:\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo})"


def sentences(source: str, key: str = "key", name: str = "sents") -> str:
    """(key, pos, sentence): every full stop decides by what stands around it."""
    return rf"""st_{name} AS (SELECT {key}, {_strip('text')} AS t FROM {source}),
    ch_{name} AS (SELECT {key}, t, i, c FROM (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS i, substring(t, i, 1) AS c FROM st_{name}) WHERE c IN ('。', '！', '？', '!', '?', '.', chr(10))),
    nb_{name} AS (SELECT *, regexp_extract(substring(t, 1, i - 1), '(\p{{L}}+)$', 1) AS w, regexp_replace(substring(t, i + 1), '^[ \t]+', '') AS r FROM ch_{name}),
    ok_{name} AS (SELECT {key}, t, i FROM nb_{name} WHERE c <> '.' OR (NOT regexp_matches(r, '^\p{{Nd}}') AND lower(w) NOT IN {_TITLE} AND (
        NOT (lower(w) IN {_ABBR} OR regexp_matches(w, '^\p{{Lu}}$') OR (regexp_matches(w, '^{_LOW}$') AND regexp_matches(r, '^\p{{L}}\.')) OR regexp_matches(substring(t, greatest(1, i - 3), least(4, i)), '\p{{L}}\.{_LOW}\.$'))
        OR (regexp_matches(r, '^\p{{Lu}}') AND NOT (regexp_matches(w, '^\p{{Lu}}$') AND regexp_matches(r, '^\p{{L}}\.')))))),
    cut_{name} AS (SELECT {key}, t, coalesce(lag(i) OVER (PARTITION BY {key} ORDER BY i), 0) AS a, i AS b FROM ok_{name}
        UNION ALL SELECT s.{key}, any_value(s.t), coalesce(max(o.i), 0), length(any_value(s.t)) FROM st_{name} s LEFT JOIN ok_{name} o ON s.{key} = o.{key} GROUP BY s.{key}),
    pc_{name} AS (SELECT {key}, b, {_strip('substring(t, a + 1, b - a)')} AS sentence FROM cut_{name} WHERE b > a),
    {name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY b) - 1 AS pos, sentence FROM pc_{name} WHERE sentence <> '')"""


def _tok(kind: str, lemma: str, stop: str) -> str:
    return f"{{'text': x, 'kind': {kind}, 'lemma': {lemma}, 'is_stop': {stop}}}"


_EN_T = lambda t: f"list_transform(regexp_extract_all({t}, '{_JOINED}'), lambda x: {_tok(chr(39) + 'WORD' + chr(39), 'lower(x)', 'lower(x) IN ' + _in(W.EN_STOP))})"
_ZH_T = lambda t: f"list_transform(regexp_extract_all({t}, '[一-鿿]|[\\p{{L}}\\p{{N}}_]'), lambda x: {_tok(chr(39) + 'x' + chr(39), chr(39) * 2, 'regexp_matches(x, ' + chr(39) + '[一-鿿]' + chr(39) + ') AND x IN ' + _in(W.ZH_STOP))})"
_NUM_T = lambda t: f"list_transform([{t}], lambda x: {_tok(chr(39) + 'NUM' + chr(39), 'x', 'false')})"
_RUNS = r"[一-鿿]+|[A-Za-z][A-Za-z\s.,;:!?''\"-]*|\p{Nd}+(?:\.\p{Nd}+)*"
_MIX_T = lambda t: f"flatten(list_transform(regexp_extract_all({t}, '{_RUNS}'), lambda r: CASE WHEN regexp_matches(r, '[一-鿿]') THEN {_ZH_T('r')} WHEN regexp_matches(r, '^\\p{{Nd}}') THEN {_NUM_T('r')} ELSE {_EN_T('r')} END))"
_ANY_T = lambda t: f"CASE {_lang(t)} WHEN 'zh' THEN {_ZH_T(t)} WHEN 'en' THEN {_EN_T(t)} ELSE {_MIX_T(t)} END"
TOKENS = f"toks AS (SELECT key, pos - 1 AS pos, u.text AS token, u.kind AS kind, u.lemma AS lemma, u.is_stop AS is_stop FROM (SELECT key, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (SELECT key, {_ANY_T('text')} AS l FROM docs)))"
TERMS = r"terms AS (SELECT key, coalesce(nullif(lemma, ''), token) AS term, count(*) AS n, min(pos) AS first FROM toks WHERE regexp_matches(token, '[\p{L}\p{N}_]') AND NOT is_stop GROUP BY ALL)"


def _tokens_query(make) -> str:
    return f"SELECT doc_id, pos - 1 AS pos, u.text AS token, u.kind AS kind, u.lemma AS lemma, u.is_stop AS is_stop FROM (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {make('text')} AS l FROM documents WHERE text IS NOT NULL))"


def _plain(pattern: str) -> str:
    return f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, lower(unnest(l)) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS l FROM documents WHERE text IS NOT NULL)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def _syl(w: str) -> str:
    return f"greatest(1, len(regexp_extract_all(CASE WHEN length({w}) > 2 AND lower({w}) LIKE '%e' THEN lower({w})[:-2] ELSE lower({w}) END, '[aeiouy]+')))"


def _score(zh_pos, zh_neg, en_pos, en_neg, toks: str = "l", lang: str = "lang") -> str:
    kept = rf"list_transform(list_filter({toks}, lambda z: regexp_matches(z.text, '[\p{{L}}\p{{N}}_]')), lambda z: coalesce(nullif(z.lemma, ''), z.text))"
    n = lambda xs: f"len(list_filter({kept}, lambda y: y IN {_in(xs)}))"
    return f"CASE WHEN {lang} = 'zh' THEN {n(zh_pos)} - {n(zh_neg)} ELSE {n(en_pos)} - {n(en_neg)} END / greatest(len({kept}), 1)"


_MOOD = "CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END"


def delta_chain(n: int = 100, pattern: str = "[A-Za-z]+", source: str = "corpus", p: str = "") -> str:
    """From words to ``edges``."""
    return f"""words{p} AS (SELECT label, lower(unnest(regexp_extract_all(text, '{pattern}'))) AS word FROM {source}),
    mfw{p} AS (SELECT word, count(*) AS n FROM words{p} GROUP BY word ORDER BY n DESC, word LIMIT {n}),
    total{p} AS (SELECT label, count(*) AS total FROM words{p} GROUP BY label),
    held{p} AS (SELECT label, word, count(*) AS n FROM words{p} WHERE word IN (SELECT word FROM mfw{p}) GROUP BY ALL),
    freq{p} AS (SELECT t.label, m.word, coalesce(h.n, 0) / greatest(t.total, 1) AS f FROM total{p} t CROSS JOIN mfw{p} m LEFT JOIN held{p} h ON h.label = t.label AND h.word = m.word),
    stats{p} AS (SELECT word, avg(f) AS m, stddev_pop(f) AS s FROM freq{p} GROUP BY word HAVING max(f) > min(f)),
    z{p} AS (SELECT label, word, (f - m) / s AS z FROM freq{p} JOIN stats{p} USING (word)),
    edges{p} AS (SELECT a.label AS la, b.label AS lb, avg(abs(a.z - b.z)) AS d FROM z{p} a JOIN z{p} b ON a.word = b.word AND a.label < b.label GROUP BY ALL)"""


_RTF = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace('{\rtf1\ansi ' || regexp_replace(text, '\r\n|\r|\n', '\\par ', 'g') || '}', '\\[a-zA-Z]+[0-9]*', '', 'g'), '[\\{}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')"
#: Every sample with one more word in a fixed share, so that one feature is the same everywhere.
_ALIKE = "(SELECT label, text || repeat(' zzalike', len(regexp_extract_all(text, '[A-Za-z]+'))::INT) AS text FROM corpus)"
_G = lambda x: f"split_part({x}, '/', 1)"
_WORK = lambda x: rf"regexp_replace(regexp_replace({x}, '^[^/]*/', ''), '__chunk\d+$', '')"


def grouped(edges: str = "edges", p: str = "") -> str:
    return f"g{p} AS (SELECT *, {_G('la')} AS ga, {_G('lb')} AS gb, {_WORK('la')} AS wa, {_WORK('lb')} AS wb FROM {edges})"


def neighbours(edges: str = "edges", value: str = "d") -> str:
    return f"""twice AS (SELECT la AS label, lb AS other, round({value}, 12) AS d FROM {edges} UNION ALL SELECT lb, la, round({value}, 12) FROM {edges}),
    near AS (SELECT label, arg_min(other, (d, other)) AS nn_label, min(d) AS d FROM twice GROUP BY label),
    pred AS (SELECT label, {_G('label')} AS true_group, nn_label, {_G('nn_label')} AS nn_group, {_G('label')} = {_G('nn_label')} AS hit, d FROM near)"""


def competition(p: str = "") -> str:
    return f"""crs{p} AS (SELECT wa AS work, least(ga, gb) AS g1, greatest(ga, gb) AS g2, avg(d) AS crossed FROM g{p} WHERE wa = wb AND ga <> gb GROUP BY ALL),
    within{p} AS (SELECT ga AS g, w, avg(d) AS within FROM (SELECT ga, unnest([wa, wb]) AS w, d FROM g{p} WHERE ga = gb AND wa <> wb) GROUP BY ALL),
    comp{p} AS (SELECT c.work, g1, g2, crossed, a.within AS within_1, b.within AS within_2, CASE WHEN a.within IS NULL THEN b.within WHEN b.within IS NULL THEN a.within ELSE (a.within + b.within) / 2 END AS same
        FROM crs{p} c LEFT JOIN within{p} a ON a.g = g1 AND a.w = c.work LEFT JOIN within{p} b ON b.g = g2 AND b.w = c.work WHERE a.within IS NOT NULL OR b.within IS NOT NULL),
    won{p} AS (SELECT *, CASE WHEN round(crossed, 12) < round(same, 12) THEN 'original' WHEN round(crossed, 12) > round(same, 12) THEN 'translator' ELSE 'tie' END AS winner FROM comp{p})"""


def wins(p: str = "") -> str:
    """Counts and the exact two-sided sign test, its terms by recurrence."""
    return f"""cnt{p} AS (SELECT count(*) FILTER (winner = 'original') AS wins_original, count(*) FILTER (winner = 'translator') AS wins_translator, count(*) FILTER (winner = 'tie') AS wins_tie FROM won{p}),
    sgn{p} AS (SELECT *, wins_original + wins_translator AS n, least(wins_original, wins_translator) AS k FROM cnt{p}),
    win{p} AS (SELECT wins_original, wins_translator, wins_tie, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, k + 1) r(i))) END, 6) AS p_value FROM sgn{p})"""


def effect(value: str, source: str = "g") -> str:
    return f"""eff AS (SELECT avg({value}) FILTER (ga = gb) AS ms, avg({value}) FILTER (ga <> gb) AS mc, coalesce(stddev_samp({value}) FILTER (ga = gb), 0) AS ss, coalesce(stddev_samp({value}) FILTER (ga <> gb), 0) AS sc, count(*) FILTER (ga = gb) AS n_same, count(*) FILTER (ga <> gb) AS n_cross FROM {source}),
    pooled AS (SELECT *, sqrt(CASE WHEN n_same > 1 AND n_cross > 1 THEN ((n_same - 1) * ss * ss + (n_cross - 1) * sc * sc) / greatest(n_same + n_cross - 2, 1) ELSE (ss * ss + sc * sc) / 2 END) AS sp FROM eff),
    cohen AS (SELECT ms AS mean_same, mc AS mean_cross, n_same, n_cross, CASE WHEN sp < 1e-12 THEN 0 ELSE (ms - mc) / sp END AS cohens_d FROM pooled)"""


_COHEN = "SELECT round(mean_same, 6) AS mean_same, round(mean_cross, 6) AS mean_cross, n_same, n_cross, round(cohens_d, 6) AS cohens_d FROM cohen"

# ---- fingerprints ----
def _set(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "()-.!?[]" else ("''" if m == "'" else m) for m in sorted(set(marks))) + "]"


_HAN_T = r"[一-鿿]|[\p{L}\p{N}_]"
_WORDS = {"en": _JOINED, "zh": _HAN_T}


def words3(source: str = "corpus", lang: str = "en") -> str:
    one = "lower(unnest(l))" if lang == "en" else "unnest(l)"
    return f"w3 AS (SELECT label, generate_subscripts(l, 1) AS pos, {one} AS term FROM (SELECT label, regexp_extract_all(text, '{_WORDS[lang]}') AS l FROM {source}))"


def _terms(k: str, source: str, lang: str) -> str:
    if k == "function_words":
        return f"SELECT label, pos, term FROM w3 WHERE term IN {_in(W.EN_FUNCTION if lang == 'en' else W.ZH_FUNCTION)}"
    if k == "word_bigrams":
        return "SELECT label, pos, term || '|' || nxt AS term FROM (SELECT *, lead(term) OVER (PARTITION BY label ORDER BY pos) AS nxt FROM w3) WHERE nxt IS NOT NULL"
    if k == "punctuation":
        return f"SELECT label, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM (SELECT label, regexp_extract_all(text, '{_set(W.EN_MARKS if lang == 'en' else W.ZH_MARKS)}') AS l FROM {source})"
    clean = r"lower(regexp_replace(text, '[^\p{L}]', '', 'g'))" if lang == "en" else rf"regexp_replace(regexp_replace(text, '{_set(W.EN_MARKS + W.ZH_MARKS)}', '', 'g'), '[\x00-\x20]', '', 'g')"
    return f"SELECT label, i AS pos, substring(c, i, 4) AS term FROM (SELECT label, c, unnest(range(1, length(c) - 2)) AS i FROM (SELECT label, {clean} AS c FROM {source}))"


def kind(k: str, source: str = "corpus", lang: str = "en") -> str:
    """Terms of a kind, their vocabulary and shares."""
    return f"""t_{k} AS ({_terms(k, source, lang)}),
    v_{k} AS (SELECT row_number() OVER (ORDER BY n DESC, first) AS idx, term, n FROM (SELECT term, count(*) AS n, min((label, pos)) AS first FROM t_{k} GROUP BY term) ORDER BY n DESC, first LIMIT {SIZES[k]}),
    c_{k} AS (SELECT label, term, count(*) AS n FROM t_{k} GROUP BY ALL),
    n_{k} AS (SELECT label, count(*) AS total FROM t_{k} GROUP BY ALL),
    f_{k} AS (SELECT s.label, v.idx, v.term, coalesce(c.n, 0) / greatest(coalesce(n.total, 0), 1) AS f FROM (SELECT DISTINCT label FROM {source}) s CROSS JOIN v_{k} v LEFT JOIN c_{k} c ON c.label = s.label AND c.term = v.term LEFT JOIN n_{k} n ON n.label = s.label)"""


def base(source: str = "corpus", lang: str = "en") -> list[str]:
    """Words, lengths, richness of each label."""
    most = 10 if lang == "en" else 4
    return [
        words3(source, lang),
        f"""wl AS (SELECT s.label, b AS bin, coalesce(count(w.term), 0) / greatest(any_value(t.n), 1) AS f FROM (SELECT DISTINCT label FROM {source}) s CROSS JOIN range(1, {most + 1}) r(b) LEFT JOIN (SELECT label, count(*) AS n FROM w3 GROUP BY label) t ON t.label = s.label LEFT JOIN w3 w ON w.label = s.label AND least(length(w.term), {most}) = b GROUP BY s.label, b)""",
        sentences(source, "label", "ss"),
        f"sl AS (SELECT label, len(regexp_extract_all(sentence, '{_WORDS[lang]}')) AS n FROM ss)",
        f"sm AS (SELECT s.label, coalesce(avg(n), 0.0) AS sent_mean, coalesce(stddev_samp(n), 0.0) AS sent_sd FROM (SELECT DISTINCT label FROM {source}) s LEFT JOIN sl ON sl.label = s.label AND n > 0 GROUP BY s.label)",
        f"th AS (SELECT s.label, coalesce(count(n) / sum(n), 0.0) AS ttr, coalesce(count(*) FILTER (n = 1) / sum(n), 0.0) AS hapax FROM (SELECT DISTINCT label FROM {source}) s LEFT JOIN (SELECT label, term, count(*) AS n FROM w3 GROUP BY ALL) c ON c.label = s.label GROUP BY s.label)",
    ]


def segments(source: str, lang: str) -> str:
    """(label, segment_no, text): whole sentences gathered until they weigh 1,000, folded in order."""
    weight = rf"3 * len(list_filter(regexp_split_to_array(sentence, '[\s\p{{Z}}]+'), lambda x: x <> ''))" if lang == "en" else _bare("sentence")
    return rf"""{sentences(source, 'label', 'sg')},
    fold AS (SELECT label, list_reduce(list({{'done': []::VARCHAR[], 'open': sentence, 'w': ({weight})::BIGINT}} ORDER BY pos), lambda a, x: CASE WHEN a.w + x.w >= 1000
        THEN {{'done': list_append(a.done, a.open || x.open), 'open': '', 'w': 0::BIGINT}} ELSE {{'done': a.done, 'open': a.open || x.open, 'w': a.w + x.w}} END, {{'done': []::VARCHAR[], 'open': '', 'w': 0::BIGINT}}) AS s FROM sg GROUP BY label),
    cut AS (SELECT label, CASE WHEN s.open = '' THEN s.done WHEN len(s.done) > 0 AND {_bare('s.open')} < 333 THEN list_append(s.done[:len(s.done) - 1], s.done[len(s.done)] || s.open) ELSE list_append(s.done, s.open) END AS l FROM fold),
    segs AS (SELECT label, generate_subscripts(l, 1) - 1 AS segment_no, unnest(l) AS text FROM cut)"""


def own_centroid() -> list[str]:
    """Means by group, and each label's eight scores against its own group's."""
    g = _G("label")
    out = [f"cm AS (SELECT {g} AS grp, count(*) AS members, avg(sent_mean) AS sent_mean, avg(sent_sd) AS sent_sd, avg(ttr) AS ttr, avg(hapax) AS hapax FROM sm JOIN th USING (label) GROUP BY ALL)"]
    for k, rows, at in (("word_length", "wl", "bin"), *((k, f"f_{k}", "idx") for k in SIZES)):
        out.append(f"m_{k} AS (SELECT {g} AS grp, {at} AS at, avg(f) AS f FROM {rows} GROUP BY ALL), k_{k} AS (SELECT a.label, CASE WHEN sum(a.f * a.f) > 0 AND sum(b.f * b.f) > 0 THEN sum(a.f * b.f) / (sqrt(sum(a.f * a.f)) * sqrt(sum(b.f * b.f))) ELSE 0.0 END AS {k} FROM {rows} a JOIN m_{k} b ON b.grp = {_G('a.label')} AND b.at = a.{at} GROUP BY a.label)")
    out.append(f"own AS (SELECT s.label, c.grp, ({_like('s.sent_mean', 'c.sent_mean')} + {_like('s.sent_sd', 'c.sent_sd')}) / 2 AS sentence_stats, {_like('t.ttr', 'c.ttr')} AS ttr, {_like('t.hapax', 'c.hapax')} AS hapax FROM sm s JOIN th t ON t.label = s.label JOIN cm c ON c.grp = {_G('s.label')})")
    out.append("scored AS (SELECT * FROM own JOIN k_word_length USING (label) " + " ".join(f"JOIN k_{k} USING (label)" for k in SIZES) + ")")
    return out


def _cos(name: str, rows: str, at: str) -> str:
    return f"""nm_{name} AS (SELECT label, sqrt(sum(f * f)) AS norm FROM {rows} GROUP BY label),
    cs_{name} AS (SELECT a.label AS la, b.label AS lb, CASE WHEN any_value(na.norm) * any_value(nb.norm) > 0 THEN sum(a.f * b.f) / (any_value(na.norm) * any_value(nb.norm)) ELSE 0.0 END AS {name} FROM {rows} a JOIN {rows} b ON a.{at} = b.{at} AND a.label < b.label JOIN nm_{name} na ON na.label = a.label JOIN nm_{name} nb ON nb.label = b.label GROUP BY ALL)"""


def _like(a: str, b: str) -> str:
    return f"CASE WHEN greatest(abs({a}), abs({b})) < 1e-12 THEN 1.0 ELSE greatest(0.0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}))) END"


def scores(source: str = "corpus") -> list[str]:
    out = [*base(source), *(kind(k, source) for k in SIZES), _cos("word_length", "wl", "bin"), *(_cos(k, f"f_{k}", "idx") for k in SIZES)]
    out.append(f"sca AS (SELECT a.label AS la, b.label AS lb, ({_like('a.sent_mean', 'b.sent_mean')} + {_like('a.sent_sd', 'b.sent_sd')}) / 2 AS sentence_stats, {_like('x.ttr', 'y.ttr')} AS ttr, {_like('x.hapax', 'y.hapax')} AS hapax FROM sm a JOIN sm b ON a.label < b.label JOIN th x ON x.label = a.label JOIN th y ON y.label = b.label)")
    out.append("dims AS (SELECT * FROM sca JOIN cs_word_length USING (la, lb) " + " ".join(f"JOIN cs_{k} USING (la, lb)" for k in SIZES) + ")")
    return out


_TOTAL = " + ".join(f"{d} * {W.WEIGHTS[d]}" for d in DIMENSIONS)
SIMS = f"sims AS (SELECT la, lb, {_TOTAL} AS sim FROM dims)"
SAMPLE = f"sd AS (SELECT label, avg(sim) FILTER ({_G('label')} = {_G('other')}) - avg(sim) FILTER ({_G('label')} <> {_G('other')}) AS diff FROM (SELECT la AS label, lb AS other, sim FROM sims UNION ALL SELECT lb, la, sim FROM sims) GROUP BY label)"
WILCOXON = """nz AS (SELECT diff AS d, round(abs(diff), 12) AS a FROM sd WHERE diff <> 0),
    rk AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM nz),
    ws AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0.0) AS w_minus FROM rk)"""


_STORY = f"sd AS (SELECT wa AS work, avg(sim) FILTER (ga = gb) AS same, avg(sim) FILTER (ga <> gb) AS crossed, avg(sim) FILTER (ga = gb) - avg(sim) FILTER (ga <> gb) AS diff FROM ({grouped('sims')[6:-1]}) WHERE wa = wb GROUP BY wa HAVING same IS NOT NULL AND crossed IS NOT NULL)"
_KWIC = f"""kl AS (SELECT key, {_lang('text')} AS lang, {_ANY_T('text')} AS l FROM docs),
    kt AS (SELECT key, lang, list_transform(l, lambda x: x.text) AS w, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM kl),
    kw AS (SELECT key, p - 1 AS position, array_to_string(w[greatest(1, p - 6) : p - 1], '') AS "left", t.text AS keyword, array_to_string(w[p + 1 : p + 6], '') AS "right" FROM kt WHERE lower(t.text) LIKE '%lantern%' OR (lang = 'en' AND lower(t.lemma) LIKE '%lantern%'))"""


def _side(x: str) -> str:
    return f"src_{x} AS (SELECT bitext_id AS key, coalesce(array_to_string(list_concat(coalesce(list_transform(pairs, lambda y: y.{x}), []), coalesce(unmatched_{x}, [])), chr(10)), '') AS text FROM (SELECT DISTINCT ON (bitext_id) * FROM alignments))"


def _weights(source: str, *before: str) -> str:
    """Rows of all variants on one set of samples, as a query by itself."""
    wide = "(VALUES " + ", ".join("('" + v + "', " + ", ".join(f"{w[d]!r}::DOUBLE" for d in DIMENSIONS) + ")" for v, w in _variants()) + ") t(variant, " + ", ".join("w_" + d for d in DIMENSIONS) + ")"
    total = " + ".join(f"{d} * w_{d}" for d in DIMENSIONS)
    comp = competition().replace("GROUP BY ALL", "GROUP BY ALL")
    for x in ("crs", "within", "comp"):
        comp = comp.replace(f"{x} AS (SELECT ", f"{x} AS (SELECT variant, ")
    comp = comp.replace("(SELECT ga, unnest", "(SELECT variant, ga, unnest").replace("SELECT variant, c.work", "SELECT c.variant, c.work").replace("ON a.g = g1", "ON a.variant = c.variant AND a.g = g1").replace("ON b.g = g2", "ON b.variant = c.variant AND b.g = g2")
    return _with(*before, *scores(source), f"sw AS (SELECT variant, la, lb, {_G('la')} = {_G('lb')} AS own, {total} AS sim FROM dims CROSS JOIN {wide})",
        grouped("(SELECT variant, la, lb, 1 - sim AS d FROM sw)"), comp, "wn AS (SELECT variant, count(*) FILTER (winner = 'original') AS competition_wins, count(*) AS competition_pairs FROM won GROUP BY variant)",
        "ef AS (SELECT variant, avg(1 - sim) FILTER (own) AS within, avg(1 - sim) FILTER (NOT own) AS between, stddev_samp(sim) FILTER (own) AS ss, stddev_samp(sim) FILTER (NOT own) AS sc, count(*) FILTER (own) AS ns, count(*) FILTER (NOT own) AS nc FROM sw GROUP BY variant)",
        f"nb AS (SELECT variant, label, arg_min(other, (d, other)) AS nn FROM (SELECT variant, la AS label, lb AS other, round(1 - sim, 12) AS d FROM sw UNION ALL SELECT variant, lb, la, round(1 - sim, 12) FROM sw) GROUP BY ALL), ac AS (SELECT variant, avg(({_G('label')} = {_G('nn')})::INT) AS knn_accuracy FROM nb GROUP BY variant)",
        f"kb AS (SELECT max(n) / sum(n) AS knn_baseline FROM (SELECT count(*) AS n FROM {source} GROUP BY {_G('label')}))",
        "SELECT ef.variant, within, between, CASE WHEN sqrt(((ns - 1) * ss * ss + (nc - 1) * sc * sc) / (ns + nc - 2)) < 1e-12 THEN 0 ELSE (between - within) / sqrt(((ns - 1) * ss * ss + (nc - 1) * sc * sc) / (ns + nc - 2)) END AS cohens_d, coalesce(competition_wins, 0) AS competition_wins, coalesce(competition_pairs, 0) AS competition_pairs, knn_accuracy, knn_baseline FROM ef JOIN ac USING (variant) LEFT JOIN wn USING (variant) CROSS JOIN kb")


def _scales() -> str:
    return " UNION ALL ".join(f"SELECT '{scale}' AS scale, * FROM ({_weights('chunks', CORPUS, _chunks(size))})" for scale, size in (("1k", 100), ("2k", 200), ("4k", 400)))


_SIX = "round(within, 6) AS within, round(between, 6) AS between, round(cohens_d, 6) AS cohens_d, competition_wins, competition_pairs, round(knn_accuracy, 6) AS knn_accuracy, round(knn_baseline, 6) AS knn_baseline"


def _chunks(size: int) -> str:
    """Pieces of so many words; each piece ends with a word."""
    return rf"""pieces AS (SELECT grp, work, label, regexp_extract_all(text, '[^A-Za-z]*[A-Za-z]+') AS l FROM corpus),
    chunks AS (SELECT grp, work, label || '__chunk' || lpad(k::VARCHAR, 3, '0') AS label, k AS chunk_no, array_to_string(l[(k - 1) * {size} + 1 : k * {size}], '') AS text
        FROM (SELECT *, unnest(range(1, len(l) // {size} + CASE WHEN len(l) % {size} > 0 AND 2 * (len(l) % {size}) >= {size} THEN 2 ELSE 1 END)) AS k FROM pieces))"""


def sql() -> dict[str, str]:
    delta = [CORPUS, delta_chain(), grouped()]
    q: dict[str, str] = {
        "lang_detect": f"SELECT doc_id, {_lang('text')} AS detected FROM documents WHERE text IS NOT NULL",
        "tok_stylometry": _plain("[A-Za-z]+"),
        "tok_control": _plain("[A-Za-z'']+"),
        "tok_en": _tokens_query(_EN_T),
        "tok_zh": _tokens_query(_ZH_T),
        "tok_mixed": _tokens_query(_MIX_T),
        "punct_tokens": r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n\r\t]+')) AS piece FROM documents WHERE text IS NOT NULL) WHERE piece <> '' AND NOT regexp_matches(piece, '[\p{L}\p{N}_]') GROUP BY piece",
        "sent_split": _with(DOCS, sentences("docs"), "SELECT key AS doc_id, pos, sentence FROM sents"),
        "syllables": f"SELECT word, {_syl('word')} AS syllables FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents WHERE text IS NOT NULL)",
        "char_ngrams": r"SELECT gram, count(*) AS n FROM (SELECT substring(c, i, 4) AS gram FROM (SELECT c, unnest(range(1, length(c) - 2)) AS i FROM (SELECT lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS c FROM documents WHERE text IS NOT NULL))) GROUP BY gram",
        "word_bigrams": f"SELECT bigram, count(*) AS n FROM (SELECT w || '|' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, lower(unnest(l)) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{_JOINED}') AS l FROM documents WHERE text IS NOT NULL))) WHERE bigram IS NOT NULL GROUP BY bigram",
        "chunk_text": _with(CORPUS, _chunks(100), "SELECT label, chunk_no, text FROM chunks"),
        "work_stems": rf"SELECT DISTINCT label, {_G('label')} AS grp, {_WORK('label')} AS work, coalesce(try_cast(regexp_extract(label, '__chunk(\d+)$', 1) AS BIGINT), 0) AS chunk_no FROM segments",
        "basic_stats": _with(DOCS, sentences("docs"), TOKENS, f"SELECT key AS doc_id, {_lang('text')} AS lang, length(text) AS n_chars, {_bare('text')} AS n_chars_no_space, (SELECT count(*) FROM toks t WHERE t.key = docs.key) AS n_tokens, (SELECT count(*) FROM sents s WHERE s.key = docs.key) AS n_sentences FROM docs"),
        "term_freq": _with(DOCS, TOKENS, TERMS, "SELECT key AS doc_id, term, n FROM terms"),
        "pos_dist": _with(DOCS, TOKENS, "SELECT key AS doc_id, kind AS pos, count(*) AS n FROM toks GROUP BY ALL"),
        "keywords_topk": _with(DOCS, TOKENS, TERMS, "SELECT key AS doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rank FROM terms) WHERE rank <= 15"),
        "batch_report": _with(DOCS, sentences("docs"), TOKENS, TERMS, "rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rank FROM terms)", f"""SELECT d.doc_id, CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN text IS NULL THEN 'no text' ELSE '' END AS error, CASE WHEN text IS NOT NULL THEN {_lang('text')} END AS lang, length(text) AS n_chars,
            CASE WHEN text IS NOT NULL THEN (SELECT count(*) FROM toks t WHERE t.key = d.doc_id) END AS n_tokens, CASE WHEN text IS NOT NULL THEN (SELECT count(*) FROM sents s WHERE s.key = d.doc_id) END AS n_sentences,
            CASE WHEN text IS NOT NULL THEN (SELECT count(*) FROM terms t WHERE t.key = d.doc_id) END AS unique_terms, CASE WHEN text IS NOT NULL THEN coalesce((SELECT string_agg(term || ':' || n, ';' ORDER BY rank) FROM rk WHERE rk.key = d.doc_id AND rank <= 5), '') END AS top_terms FROM documents d"""),
        "readability_en": _with(DOCS, sentences("docs"), f"""m AS (SELECT key, len(w) AS n, list_sum(list_transform(w, lambda x: {_syl('x')})) AS s, greatest(1, (SELECT count(*) FROM sents z WHERE z.key = docs.key)) AS c FROM (SELECT key, regexp_extract_all(text, '{_JOINED}') AS w FROM docs) docs),
            r AS (SELECT key, n / c AS a, coalesce(s, 0) / greatest(n, 1) AS b FROM m), e AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * a - 84.6::DOUBLE * b AS ease FROM r)""", "SELECT key AS doc_id, round(ease, 6) AS flesch_ease, round(0.39::DOUBLE * a + 11.8::DOUBLE * b - 15.59::DOUBLE, 6) AS flesch_kincaid, round(a, 6) AS sentence_length, round(b, 6) AS syllables_per_word, CASE WHEN ease >= 90 THEN 'very easy' WHEN ease >= 70 THEN 'easy' WHEN ease >= 60 THEN 'standard' WHEN ease >= 50 THEN 'fairly hard' WHEN ease >= 30 THEN 'hard' ELSE 'very hard' END AS label FROM e"),
        "readability_zh": _with(DOCS, sentences("docs"), rf"""m AS (SELECT key, {_bare('text')} AS c, greatest(1, (SELECT count(*) FROM sents z WHERE z.key = docs.key)) AS s, regexp_extract_all(text, '[一-鿿]|[\p{{L}}\p{{N}}_]') AS t FROM docs),
            r AS (SELECT key, c / s AS a, c / greatest(len(t), 1) AS b, len(list_distinct(t)) / greatest(len(t), 1) AS d FROM m), e AS (SELECT *, greatest(0.0, least(100.0, 100 - (a - 15) * 2 - (1 - d) * 30)) AS sc FROM r)""", "SELECT key AS doc_id, round(a, 6) AS sentence_length, round(b, 6) AS token_length, round(d, 6) AS richness, round(sc, 6) AS score, CASE WHEN sc >= 80 THEN 'easy' WHEN sc >= 60 THEN 'medium' WHEN sc >= 40 THEN 'fairly hard' ELSE 'hard' END AS level FROM e"),
        "sentiment_lexicon": _with(DOCS, f"s AS (SELECT key, {_score(W.ZH_POSITIVE, W.ZH_NEGATIVE, W.EN_POSITIVE, W.EN_NEGATIVE)} AS score FROM (SELECT key, {_lang('text')} AS lang, {_ANY_T('text')} AS l FROM docs))", f"SELECT key AS doc_id, round(score, 6) AS score, {_MOOD} AS label FROM s"),
        "sentiment_by_sentence": _with(DOCS, sentences("docs"), f"s AS (SELECT key, pos, {_score(W.ZH_POSITIVE, W.ZH_NEGATIVE, W.EN_POSITIVE, W.EN_NEGATIVE)} AS score FROM (SELECT key, pos, {_lang('sentence')} AS lang, {_ANY_T('sentence')} AS l FROM sents))", f"SELECT key AS doc_id, pos + 1 AS no, round(score, 6) AS score, {_MOOD} AS label FROM s"),
        "kwic_hits": _with(DOCS, _KWIC, "SELECT key AS doc_id, position, \"left\", keyword, \"right\" FROM kw"),
        "kwic_table": _with(DOCS, _KWIC, "SELECT key AS doc_id, position, repeat(' ', (SELECT max(length(\"left\")) FROM kw) - length(\"left\")) || \"left\" || '  [' || keyword || ']  ' || \"right\" AS line FROM kw"),
        "align_by_place": _with(_side("zh"), _side("en"), sentences("src_zh", "key", "sz"), sentences("src_en", "key", "se"), rf"""pr AS (SELECT z.key, z.pos, z.sentence AS zs, e.sentence AS es, {_bare('z.sentence')} / greatest(1, len(list_filter(regexp_split_to_array(e.sentence, '[\s\p{{Z}}]+'), lambda x: x <> ''))) AS ratio FROM sz z JOIN se e ON z.key = e.key AND z.pos = e.pos),
            pk AS (SELECT * FROM pr WHERE ratio > 0.3 AND ratio < 4.0), np AS (SELECT k.key, count(pk.pos) AS n FROM src_zh k LEFT JOIN pk ON pk.key = k.key GROUP BY k.key)""", "SELECT np.key AS bitext_id, n AS n_pairs, coalesce((SELECT string_agg(zs || '|' || es, chr(10) ORDER BY pos) FROM pk WHERE pk.key = np.key), '') AS pairs, greatest(0, (SELECT count(*) FROM sz WHERE sz.key = np.key) - n) AS left_zh, greatest(0, (SELECT count(*) FROM se WHERE se.key = np.key) - n) AS left_en FROM np"),
        "weight_sensitivity": f"SELECT scale, variant, {_SIX} FROM ({_scales()})",
        "weight_sensitivity_works": f"SELECT variant, {_SIX} FROM ({_weights('corpus', CORPUS)})",
        "weight_summary": f"SELECT scale, round(min(cohens_d), 6) AS min_cohens_d, round(max(cohens_d), 6) AS max_cohens_d, min(competition_wins) AS min_competition_wins, max(competition_wins) AS max_competition_wins, round(min(knn_accuracy), 6) AS min_knn_accuracy, round(max(knn_accuracy), 6) AS max_knn_accuracy, max(competition_pairs) AS competition_pairs, round(any_value(knn_baseline), 6) AS knn_baseline, count(*) AS variants FROM ({_scales()}) GROUP BY scale",
        "equal_chunk_metrics": _with(CORPUS, _chunks(100), delta_chain(source="chunks", p="_c"), "c AS (SELECT work, grp, count(*) AS n FROM chunks GROUP BY ALL), k AS (SELECT work, min(n) AS k FROM c GROUP BY work HAVING count(*) >= 2), kept AS (SELECT label FROM (SELECT c.*, k.k, row_number() OVER (PARTITION BY c.work, grp ORDER BY chunk_no, label) AS r FROM chunks c JOIN k ON k.work = c.work) WHERE r <= k), edges AS (SELECT * FROM edges_c WHERE la IN (FROM kept) AND lb IN (FROM kept))", grouped(), competition(), wins(), effect("d"), "SELECT win.*, round(mean_same, 6) AS mean_same, round(mean_cross, 6) AS mean_cross, n_same, n_cross, round(cohens_d, 6) AS cohens_d FROM win CROSS JOIN cohen"),
        "story_diffs": _with(CORPUS, _chunks(100), *scores("chunks"), SIMS, _STORY, "SELECT work, round(same, 6) AS same, round(crossed, 6) AS \"cross\", round(diff, 6) AS diff FROM sd"),
        "story_wilcoxon": _with(CORPUS, _chunks(100), *scores("chunks"), SIMS, _STORY, WILCOXON, "SELECT n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(CASE WHEN n >= 3 THEN (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) ELSE 0 END, 6) AS z, round(CASE WHEN w_plus + w_minus > 0 THEN (w_plus - w_minus) / (w_plus + w_minus) ELSE 0 END, 6) AS r FROM ws"),
        "history_latest": "SELECT id, lang, sentiment_label, round(sentiment_score, 6) AS sentiment_score FROM (SELECT DISTINCT ON (id) * FROM history) ORDER BY ts DESC, id DESC LIMIT 200",
        "rtf_text": f"SELECT doc_id, {_strip(_RTF)} AS plain FROM documents WHERE text IS NOT NULL",
        "html_text": rf"""SELECT doc_id, {_strip("regexp_replace(regexp_replace(" + _strip("text") + " || ' ', '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")} AS plain FROM documents WHERE text IS NOT NULL""",
        "mfw_top100": _with(CORPUS, delta_chain(), "SELECT word, n FROM mfw"),
        "rel_freq": _with(CORPUS, delta_chain(), "SELECT label, word, round(f, 6) AS f FROM freq"),
        "zscore": _with(CORPUS, delta_chain(), "SELECT label, word, round(z, 6) AS z FROM z"),
        "dropped_features": _with(CORPUS, delta_chain(500, source=_ALIKE), "SELECT word FROM freq GROUP BY word HAVING max(f) = min(f)"),
        "figure_top_terms": _with(DOCS, TOKENS, TERMS, "SELECT term, sum(n)::BIGINT AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 20"),
        "figure_word_cloud": _with(DOCS, TOKENS, TERMS, "SELECT term, sum(n)::BIGINT AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 120"),
        "figure_kinds": _with(DOCS, TOKENS, "k AS (SELECT kind AS pos, count(*) AS n FROM toks GROUP BY ALL ORDER BY n DESC, pos LIMIT 8)", "SELECT pos, n, round(n / sum(n) OVER (), 6) AS share FROM k"),
        "figure_moods": _with(DOCS, sentences("docs"), f"s AS (SELECT key, pos, {_score(W.ZH_POSITIVE, W.ZH_NEGATIVE, W.EN_POSITIVE, W.EN_NEGATIVE)} AS score FROM (SELECT key, pos, {_lang('sentence')} AS lang, {_ANY_T('sentence')} AS l FROM sents))", "SELECT key AS doc_id, pos + 1 AS no, round(score, 6) AS score, CASE WHEN score > 0.15 THEN 'green' WHEN score < -0.15 THEN 'red' ELSE 'grey' END AS colour FROM s"),
        "syntax": _with(DOCS, TOKENS, TERMS, f"b AS (SELECT key, {_lang('text')} AS lang, {_score(W.ZH_POSITIVE, W.ZH_NEGATIVE, W.EN_POSITIVE, W.EN_NEGATIVE, 'l', _lang('text'))} AS score, len(l) AS tokens FROM (SELECT key, text, {_ANY_T('text')} AS l FROM docs))", f"SELECT key AS doc_id, lang, 0::BIGINT AS entities, 0::BIGINT AS dependencies, (SELECT arg_min(term, (-n, first)) FROM terms t WHERE t.key = b.key) AS first_keyword, {_MOOD} AS mood, tokens FROM b"),
        "language_names": f"SELECT doc_id, CASE l WHEN 'zh' THEN 'Chinese' WHEN 'en' THEN 'English' ELSE 'Chinese and English' END AS language FROM (SELECT doc_id, {_lang('text')} AS l FROM documents WHERE text IS NOT NULL)",
        "unmarked_text": r"SELECT doc_id, regexp_replace(text, '\x00\[\d+\]\x00', '', 'g') AS text FROM documents WHERE text IS NOT NULL",
        "basic_summaries": _with(DOCS, sentences("docs"), TOKENS, f"b AS (SELECT key, {_lang('text')} AS l, length(text) AS c, {_bare('text')} AS d, (SELECT count(*) FROM toks t WHERE t.key = docs.key) AS t, (SELECT count(*) FROM sents s WHERE s.key = docs.key) AS s FROM docs)", "SELECT key AS doc_id, 'language: ' || CASE l WHEN 'zh' THEN 'Chinese' WHEN 'en' THEN 'English' ELSE 'Chinese and English' END || chr(10) || 'characters: ' || c || ' (without blanks ' || d || ')' || chr(10) || 'tokens: ' || t || chr(10) || 'sentences: ' || s || chr(10) || 'tokens a sentence: ' || CASE WHEN s > 0 THEN printf('%.1f', t / s) ELSE '0' END AS summary FROM b"),
        "delta_pairs": _with(CORPUS, delta_chain(), "SELECT la, lb, round(d, 6) AS d FROM edges"),
        "delta_control": _with(CORPUS, delta_chain(100, "[A-Za-z'']+"), "SELECT la, lb, round(d, 6) AS d FROM edges"),
        "delta_groups_wide": _with(CORPUS, "groups AS (SELECT grp AS label, string_agg(text, chr(10) ORDER BY label) AS text FROM corpus GROUP BY grp)", delta_chain(source="groups"), "SELECT la, lb, round(d, 6) AS d FROM edges UNION ALL SELECT lb, la, round(d, 6) FROM edges UNION ALL SELECT label, label, 0.0::DOUBLE FROM groups"),
        "delta_within_cross": _with(*delta, "SELECT ga = gb AS same_group, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 6) AS sd, count(*) AS n FROM g GROUP BY ALL"),
        "nn_loo": _with(CORPUS, delta_chain(), neighbours(), "SELECT label, true_group, nn_label, nn_group, hit, round(d, 6) AS d FROM pred"),
        "nn_accuracy": _with(CORPUS, delta_chain(), neighbours(), "b AS (SELECT true_group, count(*) FILTER (hit) AS hits, count(*) AS total FROM pred GROUP BY ALL)", "SELECT true_group, hits, total, round(sum(hits) OVER () / sum(total) OVER (), 6) AS accuracy, round(max(total) OVER () / sum(total) OVER (), 6) AS baseline FROM b"),
        "nn_structure": _with(CORPUS, delta_chain(), neighbours(), f"SELECT count(*) AS n, round(avg(({_WORK('label')} = {_WORK('nn_label')} AND NOT hit)::INT), 6) AS same_work_other_group, round(avg(({_WORK('label')} = {_WORK('nn_label')})::INT), 6) AS same_work, round(avg(hit::INT), 6) AS same_group FROM pred"),
        "signal_competition": _with(*delta, competition(), "SELECT work, g1, g2, round(crossed, 6) AS \"cross\", round(within_1, 6) AS within_1, round(within_2, 6) AS within_2, round(same, 6) AS same, winner FROM won"),
        "signal_wins": _with(*delta, competition(), wins(), "SELECT * FROM win"),
        "orphans": _with(CORPUS, "SELECT work FROM corpus GROUP BY work HAVING count(DISTINCT grp) < 2"),
        "delta_excl_same_story": _with(*delta, "h AS (SELECT * FROM g WHERE wa <> wb)", effect("d", "h"), _COHEN),
        "mfw_sensitivity": " UNION ALL ".join(f"SELECT '{scale}' AS scale, {n}::BIGINT AS top_n, * FROM ({_with(CORPUS, _chunks(size), delta_chain(n, source='chunks'), grouped(), competition(), wins(), 'SELECT * FROM win')})" for scale, size in (("1k", 100), ("2k", 200), ("4k", 400)) for n in (50, 100, 200, 500)),
        "fp_dim_scores": _with(CORPUS, *scores(), "SELECT la, lb, " + ", ".join(f"round({d}, 6) AS {d}" for d in DIMENSIONS) + " FROM dims"),
        "fp_pairs": _with(CORPUS, *scores(), SIMS, "SELECT la, lb, round(sim, 6) AS sim FROM sims"),
        "fp_same_cross_d": _with(CORPUS, *scores(), SIMS, grouped("sims"), effect("sim"), "SELECT round(mean_same, 6) AS mean_same, round(mean_cross, 6) AS mean_cross, n_same, n_cross, round(cohens_d, 6) AS cohens_d, CASE WHEN abs(cohens_d) >= 0.8 THEN 'large' WHEN abs(cohens_d) >= 0.5 THEN 'medium' WHEN abs(cohens_d) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect FROM cohen"),
        "d_excl_same_story": _with(CORPUS, *scores(), SIMS, grouped("sims"), "h AS (SELECT * FROM g WHERE wa <> wb)", effect("sim", "h"), _COHEN),
        "sample_diffs": _with(CORPUS, *scores(), SIMS, SAMPLE, "SELECT label, round(diff, 6) AS diff FROM sd WHERE diff IS NOT NULL"),
        "wilcoxon_stats": _with(CORPUS, *scores(), SIMS, SAMPLE, WILCOXON, "SELECT n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(CASE WHEN n >= 3 THEN (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) ELSE 0 END, 6) AS z, round(CASE WHEN w_plus + w_minus > 0 THEN (w_plus - w_minus) / (w_plus + w_minus) ELSE 0 END, 6) AS r FROM ws"),
        "equal_chunk": _with(CORPUS, _chunks(100), "c AS (SELECT work, grp, count(*) AS n FROM chunks GROUP BY ALL), k AS (SELECT work, min(n) AS k FROM c GROUP BY work HAVING count(*) >= 2)", "SELECT label, grp, work, k FROM (SELECT c.*, k.k, row_number() OVER (PARTITION BY c.work, grp ORDER BY chunk_no, label) AS r FROM chunks c JOIN k ON k.work = c.work) WHERE r <= k"),
        "weight_variants": "SELECT variant, dimension, round(weight, 6) AS weight FROM (VALUES " + ", ".join(f"('{v}', '{d}', {w[d]!r}::DOUBLE)" for v, w in _variants() for d in DIMENSIONS) + ") t(variant, dimension, weight)",
        "permutation_md5": _with(*delta, f"sdd AS (SELECT label AS id, length(label) % 2 = 0 AS own, round(avg(d) FILTER ({_G('label')} = {_G('other')}) - avg(d) FILTER ({_G('label')} <> {_G('other')}), 6) AS x FROM (SELECT la AS label, lb AS other, d FROM edges UNION ALL SELECT lb, la, d FROM edges) GROUP BY label)",
            "v AS (SELECT * FROM sdd WHERE x IS NOT NULL), k AS (SELECT count(*) FILTER (own) AS k, avg(x) FILTER (own) - avg(x) FILTER (NOT own) AS seen FROM v)",
            "o AS (SELECT draw, x, row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substring(md5('42|' || draw || '|' || id), 1, 8))::BIGINT, id) AS nr FROM v CROSS JOIN range(0, 10000) r(draw))",
            "e AS (SELECT draw, avg(x) FILTER (nr <= k) - avg(x) FILTER (nr > k) AS d, any_value(seen) AS seen FROM o CROSS JOIN k GROUP BY draw)", "SELECT count(*) FILTER (round(d, 12) >= round(seen, 12)) AS hits, count(*) AS draws, (count(*) FILTER (round(d, 12) >= round(seen, 12)) + 1) / (count(*) + 1) AS p_value FROM e"),
        "bootstrap_md5": _with(*delta, "ps AS (SELECT least(wa, wb) AS s1, greatest(wa, wb) AS s2, ga = gb AS same, count(*) AS n, sum(d) AS s, sum(d * d) AS q FROM g GROUP BY ALL)",
            "ws AS (SELECT list_sort(list_distinct(list_concat(list(wa), list(wb)))) AS al FROM g)", "pk AS (SELECT draw, al[(('0x' || substring(md5('20260818|' || draw || '|' || slot), 1, 8))::BIGINT % len(al)) + 1] AS w FROM (SELECT draw, al, unnest(range(1, len(al) + 1)) AS slot FROM ws CROSS JOIN range(0, 10000) r(draw)))",
            "pc AS (SELECT draw, w, count(*) AS c FROM pk GROUP BY ALL)", "tt AS (SELECT a.draw, " + ", ".join(f"sum(a.c * b.c * {c}) FILTER ({'' if s else 'NOT '}same) AS {c}{s}" for c in "nsq" for s in (1, 0)) + " FROM ps JOIN pc a ON a.w = s1 JOIN pc b ON b.w = s2 AND b.draw = a.draw GROUP BY a.draw)",
            "dd AS (SELECT *, greatest(0, (q1 - s1 * s1 / n1) / (n1 - 1)) AS v1, greatest(0, (q0 - s0 * s0 / n0) / (n0 - 1)) AS v0 FROM tt WHERE n1 >= 2 AND n0 >= 2), de AS (SELECT (s1 / n1 - s0 / n0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM dd)", "SELECT count(*) AS valid, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM de"),
    }
    for lang, tail, corpus in (("en", "", CORPUS), ("zh", "_zh", CORPUS_ZH)):
        for k, short in (("function_words", "func"), ("char_ngrams", "char4"), ("word_bigrams", "bigram"), ("punctuation", "punct")):
            q[f"vocab_{short}{tail}"] = _with(corpus, words3("corpus", lang), kind(k, "corpus", lang), f"SELECT idx, term, n FROM v_{k}")
            q[f"feat_{short}{tail}"] = _with(corpus, words3("corpus", lang), kind(k, "corpus", lang), f"SELECT label, term, round(f, 6) AS f FROM f_{k}")
        q[f"feat_wordlen{tail}"] = _with(corpus, *base("corpus", lang), "SELECT label, bin - 1 AS bin, round(f, 6) AS f FROM wl")
        q[f"feat_sentlen{tail}"] = _with(corpus, *base("corpus", lang), "SELECT label, round(sent_mean, 6) AS sent_mean, round(sent_sd, 6) AS sent_sd FROM sm")
        q[f"feat_ttr_hapax{tail}"] = _with(corpus, *base("corpus", lang), "SELECT label, round(ttr, 6) AS ttr, round(hapax, 6) AS hapax FROM th")
        q[f"segment_text{tail}"] = _with(corpus, segments("corpus", lang), f"SELECT label, segment_no, text, {_bare('text')} AS n_chars FROM segs")
    q["author_validation"] = _with(SAMPLES, f"sl AS (SELECT grp, label, text, {_lang('text')} AS lang, {_bare('text')} AS n FROM samples)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY grp, lang ORDER BY n DESC, label) AS r FROM sl WHERE lang <> 'mixed')",
        "nx AS (SELECT grp, lang, unnest(['C1', 'C2', 'C3']) AS role, unnest([lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w]) AS text FROM rk WHERE r = 1 WINDOW w AS (PARTITION BY lang ORDER BY grp))",
        "cs AS (SELECT grp || '|' || lang AS \"case\", CASE r WHEN 1 THEN 'A' ELSE 'B' END AS role, text FROM rk WHERE r <= 2 UNION ALL SELECT grp || '|' || lang, role, text FROM nx WHERE text IS NOT NULL)",
        f"cl AS (SELECT *, {_lang('text')} AS l, {_bare('text')} AS n FROM cs), one AS (SELECT \"case\", coalesce(max(n) FILTER (role = 'A'), 0) AS na, count(*) FILTER (role = 'B' AND n > 0) AS nb, count(*) FILTER (role LIKE 'C%' AND n > 0) AS nc, max(l) FILTER (role = 'A') AS lang, list_sort(list_distinct(list(l) FILTER (n > 0))) AS ls FROM cl GROUP BY \"case\")",
        "SELECT \"case\", lang, CASE WHEN na < 3000 THEN 'the questioned text has ' || na || ' characters, 3000 are needed' WHEN nb = 0 THEN 'the known author has no text' WHEN nc = 0 THEN 'no control author' WHEN lang = 'mixed' THEN 'mixed languages can''t be analysed' WHEN len(list_filter(ls, lambda x: x <> lang AND x <> 'mixed')) > 0 THEN 'texts in different languages: ' || array_to_string(list_filter(ls, lambda x: x <> 'mixed'), ', ') END AS error FROM one")
    every = [CORPUS, *base(), *(kind(k) for k in SIZES), *own_centroid()]
    q["centroids"] = _with(*every, "SELECT grp, members, round(sent_mean, 6) AS sent_mean, round(ttr, 6) AS ttr, round(hapax, 6) AS hapax, round(w.f, 6) AS three_letters, round(v.f, 6) AS first_function_word FROM cm JOIN m_word_length w USING (grp) JOIN m_function_words v USING (grp) WHERE w.at = 3 AND v.at = 1")
    q["feature_scores"] = _with(*every, "SELECT label, grp, " + ", ".join(f"round({d}, 6) AS {d}" for d in DIMENSIONS) + f", round({_TOTAL}, 6) AS total FROM scored")
    return q


def _variants() -> list:
    from quillmark.operators.sensitivity import variants

    return variants()
