"""DuckDB statements for the operators that SQL can express, written apart from their code."""

from __future__ import annotations


#: Levels of the URL statement; it stands for trees of paths with up to so many segments.
_URL_LEVELS = 8


def _url_filter() -> str:
    """Shapes, variable segments level by level, then purity from the host down."""
    levels, walk = [], []
    for k in range(1, _URL_LEVELS + 1):
        levels.append(f"""
n{k} AS (SELECT node, count(*) AS kinds, sum(n) AS pages FROM (
      SELECT node, coalesce(parts[{k}], '') AS s, sum(n) AS n FROM g{k - 1} GROUP BY ALL)
      WHERE s <> '' GROUP BY node),
h{k} AS (SELECT g{k - 1}.*, coalesce(parts[{k}], '') AS s, CASE WHEN kinds >= 8
      AND kinds * 2 >= pages THEN '*' ELSE coalesce(parts[{k}], '') END AS g
      FROM g{k - 1} LEFT JOIN n{k} USING (node)),
g{k} AS (SELECT host, shape, parts, n, allowed, blocked,
      CASE WHEN s = '' THEN general ELSE list_append(general, g) END AS general,
      CASE WHEN s = '' THEN node ELSE node || '/' || g END AS node FROM h{k})""")
        walk.append(f"""
c{k} AS (SELECT template, general[{k}] AS g, sum(blocked)::DOUBLE AS b,
      sum(allowed + blocked)::DOUBLE AS m FROM q{k - 1} WHERE len(general) >= {k} GROUP BY ALL),
o{k} AS (SELECT q{k - 1}.*, c{k}.b, c{k}.m, coalesce(c{k}.m > 0
      AND abs(c{k}.b / greatest(c{k}.m, 1.0::DOUBLE) - purity) > 1.96::DOUBLE
        * sqrt(purity * (1.0::DOUBLE - purity) / greatest(c{k}.m, 1.0::DOUBLE)), false) AS own
      FROM q{k - 1} LEFT JOIN c{k} ON c{k}.template = q{k - 1}.template
        AND c{k}.g = general[{k}]),
q{k} AS (SELECT * EXCLUDE (b, m, own) REPLACE (
      CASE WHEN own THEN (b + 4.0::DOUBLE * purity) / (m + 4.0::DOUBLE) ELSE purity END AS purity,
      CASE WHEN len(general) < {k} THEN template ELSE template || '/'
        || CASE WHEN own THEN general[{k}] ELSE '~' END END AS template) FROM o{k})""")
    return f"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
         AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
         AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/'), lambda x: x <> '')
      AS parts FROM u),
v AS (SELECT page_id, host, path, rule, parts, array_to_string(parts, '/') AS shape,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END
      AS by_rule FROM r),
g0 AS (SELECT host, shape, any_value(parts) AS parts, count(*) AS n,
    count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked,
    []::VARCHAR[] AS general, host AS node FROM v GROUP BY host, shape),
{",".join(levels).strip()},
p0 AS (SELECT host, shape, general, allowed, blocked, host AS template,
       (SELECT (sum(blocked) + 0.5::DOUBLE) / (sum(allowed) + sum(blocked) + 1.0::DOUBLE)
        FROM g{_URL_LEVELS}) AS purity FROM g{_URL_LEVELS}),
c0 AS (SELECT host, sum(blocked)::DOUBLE AS b, sum(allowed + blocked)::DOUBLE AS m
       FROM p0 GROUP BY ALL),
q0 AS (SELECT p0.* REPLACE ((b + 4.0::DOUBLE * purity) / (m + 4.0::DOUBLE) AS purity)
       FROM p0 JOIN c0 USING (host)),
{",".join(walk).strip()}
SELECT page_id, host, path, rule,
    coalesce(by_rule, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
    template, round_even(purity, 9) AS purity
FROM v JOIN q{_URL_LEVELS} USING (host, shape)"""


#: Label, base or not, key phrase, where it starts in the template, template.
_TEMPLATES = [
    ("mit", True, "mit license", 0, "mit license"),
    ("apache", True, "apache license", 0, "apache license"),
    ("gpl", True, "general public license", 0, "general public license"),
    ("apache-2.0", False, "apache license version 2 0", 3,
     "licensed under the apache license version 2 0"),
    ("gpl-3.0", False, "general public license version 3", 4,
     "licensed under the gnu general public license version 3"),
    ("gpl-2.0", False, "general public license version 2", 4,
     "licensed under the gnu general public license version 2"),
    ("lgpl", False, "lesser general public license", 1, "gnu lesser general public license"),
    ("mpl-2.0", False, "mozilla public license", 0, "mozilla public license version 2 0"),
    ("mit-notice", False, "released under the mit license", 0, "released under the mit license"),
    ("mit-text", False, "permission is hereby granted free of charge", 0,
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", False, "redistribution and use in source and binary forms", 0,
     "redistribution and use in source and binary forms with or without modification are "
     "permitted"),
    ("cc-by-nc-4.0", False, "cc by nc 4 0", 2, "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", False, "cc by sa 4 0", 2, "licensed under cc by sa 4 0"),
    ("cc-by-4.0", False, "cc by 4 0", 2, "licensed under cc by 4 0"),
]


def _license_scan() -> str:
    """Every place of every key phrase, by trying each word of each file."""
    values = ",\n".join(f"('{label}', {base}, string_split('{key}', ' '), {at}, "
                        f"string_split('{body}', ' '))" for label, base, key, at, body in _TEMPLATES)
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t(label, base, key, lead, body) AS (VALUES {values}),
c AS (SELECT r, label, base, key, lead, body, words
      FROM w, t WHERE list_has_all(words, key)),
p AS (SELECT *, unnest(range(0, len(words) - len(key) + 1)) AS i FROM c),
v AS (SELECT r, label, base, i - lead AS o,
      len(list_filter(range(0, len(body)), lambda k: i - lead + k >= 0
                      AND words[(i - lead + k + 1)::INT] = body[(k + 1)::INT])) / len(body) AS share
      FROM p WHERE words[(i + 1)::INT] = key[1]
      AND list_slice(words, i + 1, i + len(key)) = key),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word,
      max(o) FILTER (base) AS last_word,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM v WHERE share >= 0.6 GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN g USING (r)"""


def _divergence() -> str:
    """Every kept term in every group, then all pairs of groups term by term."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS kinds, sum(c)::HUGEINT AS total FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term)
      GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS total FROM g
      LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n.c, 0) AS c,
      1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 1)) // (s.total + v.kinds) AS p,
      1 + (1000000000::HUGEINT * (k.c + 1)) // (v.total + v.kinds) AS q
      FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
      coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p
      WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part
      ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200"""


#: Kind, pattern, own score in tenths, words for and against it, check of a match m.
_DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 9, "email|mail|contact",
     "example", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 6, "ip|address|host|server|login",
     "version|release|section",
     "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 "
     "OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 8, "card|credit|visa|mastercard|payment",
     "isbn|tracking|order",
     f"len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, len({_DIGITS})), "
     f"lambda i: CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, len({_DIGITS}) - i, 1)::INT "
     f"WHEN substr({_DIGITS}, len({_DIGITS}) - i, 1)::INT > 4 "
     f"THEN 2 * substr({_DIGITS}, len({_DIGITS}) - i, 1)::INT - 9 "
     f"ELSE 2 * substr({_DIGITS}, len({_DIGITS}) - i, 1)::INT END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 7, "phone|tel|call|mobile|fax", "order|version",
     "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( ([0-9][A-Z0-9]{0,2}|"
     r"[A-Z][0-9][A-Z0-9]?|[A-Z]{2}[0-9]))?)\b", 9, "iban|bank|account|bic|swift", "serial",
     "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || "
     "left(m, 4), ''), lambda x: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)), "
     "lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 3, "ssn|social|security|taxpayer",
     "isbn|part|serial", "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' "
     "AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'"),
    ("aba", r"\b[0-9]{9}\b", 2, "routing|aba|bank|transit", "isbn|serial|order",
     "m <> '000000000' AND list_sum(list_transform(range(1, 10), lambda i: "
     "substr(m, i, 1)::INT * [3, 7, 1][((i - 1) % 3 + 1)::INT])) % 10 = 0"),
]


def _personal() -> str:
    """Matches and the text between them give every start; checks, scores and digests follow."""
    found = "\nUNION ALL\n".join(f"""
SELECT r, text, {k} AS o, '{kind}' AS kind, {own} AS own, '\\b({good})\\b' AS good,
    '\\b({bad})\\b' AS bad, m, s FROM (
  SELECT r, text, ms[i] AS m, (list_sum(list_transform(ss[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, text, regexp_extract_all(text, '{pattern}') AS ms,
           string_split_regex(text, '{pattern}') AS ss FROM d)))
WHERE {check}""" for k, (kind, pattern, own, good, bad, check) in enumerate(_KINDS))
    counts = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _KINDS[:4])
    sums = ", ".join(f"count(*) FILTER (o = {k}) AS n_{kind}"
                     for k, (kind, *_) in enumerate(_KINDS[:4]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
c AS (SELECT *, s + length(m) AS e, translate(substr(text, greatest(s - 48, 0) + 1,
      s - greatest(s - 48, 0)) || chr(10) || substr(text, s + length(m) + 1, 24),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS around FROM f),
p AS (SELECT *, greatest(0, least(10, own + 4 * regexp_matches(around, good)::INT
      - 3 * regexp_matches(around, bad)::INT)) AS tenths FROM c),
k AS (SELECT *, kind || ':' || s || ':' || e AS shown FROM p WHERE o < 4 OR tenths >= 5),
g AS (SELECT r, {sums}, string_agg(shown, ',' ORDER BY s, o) FILTER (o < 4) AS base,
      string_agg(shown, ',' ORDER BY s, o) AS spans,
      string_agg((tenths // 10) || '.' || (tenths % 10), ',' ORDER BY s, o) AS scores
      FROM k GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (r)"""


def _spellings() -> str:
    """Checksums byte by byte, then near words by equal rests after a deletion."""
    return """
WITH RECURSIVE z AS (SELECT list(list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k)
      AS crc FROM range(256) AS q(k)),
d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') || ':' AS head,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      AS text FROM documents),
u AS (SELECT r, head, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]{7,}')) AS w FROM d),
c AS (SELECT r, head, w, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(head || w, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))
      AS bytes FROM c),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x:
      xor(a >> 8, crc[xor(a, x) % 256 + 1])), 4294967295) AS h FROM b, z),
a AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT)
      || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM a GROUP BY word
      HAVING sum(n) >= 2 AND length(word) >= 7),
x AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest
      FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest
      AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
o AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
      row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
      CASE WHEN o.n >= 10 * v.n THEN near END AS form,
      CASE WHEN o.n >= 10 * v.n THEN o.n END AS form_n
      FROM v LEFT JOIN o ON o.word = v.word AND place = 1),
g AS (SELECT word, word AS root, form AS ahead FROM f
      UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.ahead)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word) WHERE ahead IS NULL"""


def _repeated_phrases() -> str:
    """Every window of every document by a digest of its words, and the smallest id that holds it."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT r, id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
w AS (SELECT r, id, i, md5(array_to_string(words[i:i + 49], ' ')) AS key FROM i),
least AS (SELECT key, min(id) AS first FROM w GROUP BY key),
gone AS (SELECT r, i FROM w JOIN least USING (key) WHERE first < id),
p AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
marked AS (SELECT p.r, p.pos, word, max(g.i) OVER (PARTITION BY p.r ORDER BY p.pos
    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS covered
    FROM p LEFT JOIN gone g ON g.r = p.r AND g.i = p.pos),
k AS (SELECT r, count(*) AS n_words, count(*) FILTER (covered) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (NOT covered) AS kept FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def _near_duplicates() -> str:
    """All pairs that share a shingle, their similarity, and everything that links reach."""
    return r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(
    range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b
    ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
paired AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, b FROM reach JOIN paired ON a = other),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = other
    GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)"""


ORACLES = {"op6_rare_token_index": _license_scan(), "op2_path_templates": _url_filter(),
           "op11_pair_merge": _divergence(), "op12_checked_spans": _personal(),
           "op13_bloom_edits": _spellings(), "op3_repeated_phrases": _repeated_phrases(),
           "op9_minhash": _near_duplicates()}
