"""DuckDB SQL for the operators whose results don't depend on how candidates are found."""

from __future__ import annotations

from itertools import permutations

from . import licenses
from .licenses import words_of

_CLOSURE = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""WITH RECURSIVE
parts AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
occ AS (SELECT doc_id, n, lines[n] AS line, trim(lines[n], {_BLANK}) AS s FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM parts)),
u AS (SELECT DISTINCT s, length(s) AS size FROM occ WHERE length(s) >= 32),
found AS (SELECT x.s AS a, y.s AS b FROM u x JOIN u y ON y.size BETWEEN x.size AND x.size + 2 AND x.s <> y.s AND levenshtein(x.s, y.s) <= 2),
links AS (SELECT a, b FROM found UNION SELECT b, a FROM found),
{_CLOSURE},
classes AS (SELECT a AS s, least(a, min(b)) AS class FROM reach GROUP BY a),
known AS (SELECT o.*, coalesce(c.class, o.s) AS class FROM occ o LEFT JOIN classes c USING (s) WHERE length(o.s) >= 10),
gone AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY class ORDER BY doc_id, n) AS k FROM known) WHERE k > 1),
kept AS (SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.n) AS kept FROM occ o ANTI JOIN gone g ON g.doc_id = o.doc_id AND g.n = o.n GROUP BY o.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN p.text = '' THEN 0 ELSE len(p.lines) END AS INTEGER) AS n_lines, CAST(coalesce(l.n, 0) AS INTEGER) AS n_dropped,
  length(coalesce(k.kept, '')) AS kept_chars, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM parts p LEFT JOIN kept k USING (doc_id) LEFT JOIN lost l USING (doc_id)"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_CLOSURE},
low AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN counts USING (vec_id)"""

#: The exact neighbours: operator 4 finds them all on tables of one block, where the bounds leave few out.
NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

NEAR_COPIES = f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
shingle AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
counted AS (SELECT doc_id, s, count(*) AS n FROM shingle GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY doc_id),
both AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared FROM counted x JOIN counted y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE shared * 5 >= 4 * (x.n + y.n - shared)),
{_CLOSURE},
low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS class_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN low USING (doc_id) LEFT JOIN size USING (doc_id)""".replace("both", "paired")


_SPLIT = "[^ \\t\\n\\x0B\\f\\r]+"


#: The rules of operator 13 in the order of their bits; the first seven are the policy in force.
_RULES = [
    "n_words < 50", "100 * n_repeat_words > 50 * n_words", "n_words > 1000000", "word_chars < 3 * n_words", "word_chars > 10 * n_words",
    "10 * n_symbols > n_words", "2 * n_dup_lines > n_lines", "100 * n_repeat_words > 30 * n_words", "10 * n_dup_lines > 3 * n_lines",
]


def filter_audit_sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    counted = lambda c, test: f"CAST(coalesce(sum({c}) FILTER (WHERE {test}), 0) AS BIGINT)"
    own, before = "(mask & own) <> 0", "(mask & earlier) <> 0"
    share = "CASE bit_count(mask) " + " ".join(f"WHEN {n} THEN {120 // n}" for n in range(1, 6)) + " END"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '{_SPLIT}') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < doc_id, false) AS INT) AS mask FROM w),
labelled AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN labelled USING (doc_id) GROUP BY ALL),
o AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) AS v(filter_order)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(1 AS INT) << (ascii(filter_order[step]) - 65) AS own,
  CAST(coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)]), 0) AS INT) AS earlier FROM o)
SELECT part, filter_order, step, {counted("n", f"NOT {own} AND NOT {before}")} AS kept, {counted("n", f"{own} AND NOT {before}")} AS removed,
  {counted("n", f"{own} AND {before}")} AS redundant, {counted("n", "mask = own")} AS unique_fails, {counted("good", f"{own} AND NOT {before}")} AS good_lost,
  {counted("toxic", f"{own} AND NOT {before}")} AS toxic_lost, {counted(f"n * {share}", own)} AS shapley
FROM c CROSS JOIN s GROUP BY part, filter_order, step"""


#: The CRC-32 of a string's ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) for x in string_split({}, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t),
b AS (SELECT h.conv_id, coalesce(t.turns, [])[1:h.h] || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN t ON t.conv_id = h.base),
p AS (SELECT conv_id, len(turns) AS len, d, turns[1:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.path[n.d].t)) END AS saved FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
up AS (SELECT path[1:a] AS path, a AS d, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, up.saved_tokens, f.ends_sha256
FROM f JOIN up ON up.d = f.d AND up.path = f.path LEFT JOIN n q ON q.d = f.d - 1 AND q.path = f.path[1:f.d - 1]"""

RULE_LEDGER = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPLIT}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPLIT}')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS v(j) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, [{", ".join(_RULES)}] AS fails FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed, NOT list_bool_or(fails[1:7]) AS kept, n_lines,
  CAST(list_sum([CASE WHEN fails[i + 1] THEN 1 << i ELSE 0 END for i in range(0, {len(_RULES)})]) AS BIGINT) AS failed FROM f"""


def _pattern(template: str) -> str:
    """A template as a regular expression over words that each follow a blank."""
    import re

    out = ""
    for token in re.findall(r"\[\[|\]\]|<\d+>|[^\s\[\]<>]+", template):
        if token in ("[[", "]]"):
            out += "(?:" if token == "[[" else ")?"
        elif token[0] == "<":
            out += f"(?: [^ ]+){{0,{token[1:-1]}}}"
        else:
            out += "".join(" " + re.escape(w.decode()) for w in words_of(token))
    return out + " "


def license_sql() -> str:
    places = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
        places.append((label, f"[i for i in range(0, len(w) - {len(words) - 1}) if {test}]"))
    more: dict[str, list[str]] = {}
    for label, template in licenses.TEMPLATES + licenses.WHOLE:
        more.setdefault(label, []).append(_pattern(template))
    columns = ", ".join(f"{code} AS p{k}" for k, (_, code) in enumerate(places))
    every = " || ".join(f"p{k}" for k in range(len(places)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(places))
    own = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(joined, '{p}')" for p in patterns) + f" THEN '{label}' END" for label, patterns in more.items())
    whole = " OR ".join(f"regexp_matches(joined, '{_pattern(template)}')" for _, template in licenses.WHOLE)
    clean = lambda names: f"list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL)))"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {columns} FROM w),
q AS (SELECT doc_id, len(w) AS n_words, {every} AS hits, {clean(base)} AS base, {clean(own)} AS own, {whole} AS whole FROM p)
SELECT doc_id, n_words, len(hits) AS n_base, list_min(hits) AS first_word, list_max(hits) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || own)), ',') AS labels, CASE WHEN whole THEN 1.0 WHEN len(own) > 0 THEN 0.75 WHEN len(hits) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM q"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op3_embedding_dedup": EMBEDDING_DEDUP, "op4_one_bit_codes": NEAREST, "op6_bag_minhash": NEAR_COPIES, "op9_license_templates": license_sql()} | {
        "op11_filter_audit": filter_audit_sql(), "op12_prefix_trie": PREFIX_TRIE, "op13_rule_ledger": RULE_LEDGER,
    }
