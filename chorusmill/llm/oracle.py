"""SQL of the operators that SQL can express, for DuckDB over the same tables. Each goes its own way to the result."""

from __future__ import annotations

from . import licences

#: Words of texts with the marked code points deleted; crc32 byte by byte over a table made from its polynomial.
_WORDS = """tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(s) + 1), lambda i: ('0x' || hex(s)[2 * i - 1 : 2 * i])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS s FROM each), tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums),
voc AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3)"""

OP11 = f"""WITH RECURSIVE {_WORDS},
gone AS (SELECT word, n, length(word) AS size, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM voc)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN voc b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN voc b ON a.rest = b.word),
top AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY 1),
form AS (SELECT t.word, min(other) AS form, any_value(most) AS form_n FROM top t JOIN near USING (word) JOIN voc USING (word) WHERE other_n = most AND most >= 2 * n GROUP BY 1),
walk AS (SELECT word, word AS spot, 0 AS k FROM voc UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN form f ON f.word = w.spot),
root AS (SELECT word, arg_max(spot, k) AS root FROM walk GROUP BY 1)
SELECT v.word, form, root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM voc v LEFT JOIN top USING (word) LEFT JOIN form USING (word) JOIN root USING (word)"""

OP12 = r"""WITH pieces AS (SELECT lang, doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY 1),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lists, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN total t ON t.lang = c.lang),
low AS (SELECT DISTINCT ON (lang, phrase) * FROM scored ORDER BY lang, phrase, score, k),
held AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand d ON d.lang = c.lang AND d.size > c.size AND d.a >= c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN held USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""


def _texts(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _op13() -> str:
    templates = ", ".join(f"({t}, '{label}', '{text}', {_texts(f' {k} ' for k in keys)})" for t, (label, text, keys) in enumerate(licences.TEMPLATES))
    base = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licences.BASE.items())
    return rf"""WITH tpl(t, label, body, keys) AS (VALUES {templates}), bas(phrase, blabel) AS (VALUES {base}),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT row, word, i - 1 AS spot FROM (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs)),
tw AS (SELECT t, word, i - 1 AS place FROM (SELECT t, unnest(string_split(body, ' ')) AS word, generate_subscripts(string_split(body, ' '), 1) AS i FROM tpl)),
df AS (SELECT word, count(DISTINCT row) AS df FROM pos WHERE word IN (SELECT word FROM tw) GROUP BY 1),
rare AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY df, word) AS n FROM (SELECT DISTINCT t, word FROM tw) JOIN df USING (word)),
size AS (SELECT t, len(string_split(body, ' ')) AS size, least({licences.MOST_RARE}, greatest({licences.LEAST_RARE}, len(string_split(body, ' ')) // {licences.WORDS_PER_RARE})) AS most FROM tpl),
idx AS (SELECT t, word, place FROM tw JOIN rare USING (t, word) JOIN size USING (t) WHERE n <= most),
need AS (SELECT t, count(DISTINCT word) AS rare, greatest(2, (count(DISTINCT word) * {licences.AGREE} + 99) // 100) AS need FROM idx GROUP BY 1),
hits AS (SELECT row, t, word, spot - place AS shift FROM pos JOIN idx USING (word)),
cells AS (SELECT row, t, grid, floor((shift + grid * {licences.DRIFT // 2}) / {licences.DRIFT}.0) AS cell, count(DISTINCT word) AS same, min(shift) AS shift FROM hits, (VALUES (0), (1)) g(grid) GROUP BY 1, 2, 3, 4),
near AS (SELECT c.row, c.t, same / rare AS share, size, label, keys, greatest(0, shift - {licences.SLACK}) AS begin FROM cells c JOIN need USING (t) JOIN size USING (t) JOIN tpl USING (t) WHERE same >= need),
sure AS (SELECT n.row, label, share FROM near n JOIN docs d USING (row) WHERE len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(w[begin + 1 : begin + size + {2 * licences.SLACK + licences.DRIFT}], ' ') || ' ', k))) = 0),
found AS (SELECT row, list(DISTINCT label) AS labels, max(share) AS share FROM sure GROUP BY 1),
places AS (SELECT p.row, p.spot, blabel FROM pos p JOIN bas b ON p.word = string_split(phrase, ' ')[1] JOIN docs d USING (row) WHERE array_to_string(w[p.spot + 1 : p.spot + len(string_split(phrase, ' '))], ' ') = phrase),
base AS (SELECT row, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT blabel)) AS blabels FROM places GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(blabels, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(blabels, []), coalesce(labels, [])))), ',') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {licences.BASE_SCORE} ELSE 0.0 END)::DOUBLE AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN found USING (row)"""


ORACLE_SQL = {"op11_spelling": OP11, "op12_collocations": OP12, "op13_licences": _op13()}
