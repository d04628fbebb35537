"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from spanweave.llm import chat, license_scan, piecetable

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_scan() -> str:
    rows = ",\n  ".join(
        f"({str(exact).lower()}, {n}, {_quoted(text)}, {_quoted(label)})"
        for exact, listed in ((True, license_scan.BASE), (False, license_scan.NOTICES))
        for n, (text, label) in enumerate(listed.items())
    )
    return f"""
WITH template(exact, nth, notice, label) AS (VALUES
  {rows}),
spread AS (SELECT exact, nth, label, string_split(notice, ' ') AS parts FROM template),
run AS (SELECT exact, nth, label, len(parts) AS n_template, t, parts[t + 1] AS w0, parts[t + 2] AS w1
        FROM (SELECT *, unnest(range(len(parts) - 1)) AS t FROM spread)),
split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
word AS (SELECT doc_id, i, words[i + 1] AS w0, words[i + 2] AS w1 FROM (SELECT *, unnest(range(len(words) - 1)) AS i FROM split WHERE len(words) > 1)),
hit AS (SELECT doc_id, exact, nth, label, n_template, t, i FROM word JOIN run USING (w0, w1)),
vote AS (SELECT doc_id, exact, nth, label, n_template, i - t AS diagonal, bit_or(1::BIGINT << t) AS votes, min(i) AS low, max(i) AS high
         FROM hit GROUP BY ALL),
part AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER d > {license_scan.NEIGHBOURS}, true) THEN 1 ELSE 0 END AS new
         FROM vote WINDOW d AS (PARTITION BY doc_id, exact, nth ORDER BY diagonal)),
merged AS (SELECT doc_id, exact, nth, label, n_template, bit_or(votes) AS votes, min(low) AS low, max(high) AS high
           FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, exact, nth ORDER BY diagonal) AS part FROM part)
           GROUP BY doc_id, exact, nth, label, n_template, part),
scored AS (SELECT doc_id, exact, label, low, bit_count(votes | (votes << 1))::DOUBLE
             / greatest(n_template, CASE WHEN exact THEN high - low + 2 ELSE ceil((high - low + 2) / {license_scan.STRETCH}) END)::DOUBLE AS score FROM merged),
found AS (SELECT * FROM scored WHERE CASE WHEN exact THEN score = 1 ELSE score >= {license_scan.SIMILARITY} END),
by_doc AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(low) FILTER (exact) AS first_word, max(low) FILTER (exact) AS last_word,
             coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ','), '') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, round(max(score), 6) AS score
           FROM found GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM split LEFT JOIN by_doc USING (doc_id)"""


def _chat_format() -> str:
    controls = "|".join("".join("\\" + c if c in "\\|<>[]/" and c in "\\|[]" else c for c in s) for s in ["\\", *chat.CONTROLS])
    marks = len(chat.TURN) + len(chat.BODY) + len(chat.END)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(text) + length(role) + len(regexp_extract_all(text || ' ' || role, {_quoted(controls)})) + {marks} AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) + {len(chat.BEGIN)} AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def _odd_sketches() -> str:
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END AS s FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b USING (shingle)
         WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)"""


def _piece_table() -> str:
    p, s, m = (_quoted(mark) for mark in piecetable.SENTINELS)
    draw = ", ".join(f"('0x' || h[{8 * n + 1}:{8 * n + 8}])::BIGINT AS h{n + 1}" for n in range(4))
    return f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, {draw} FROM hashed),
cut AS (SELECT doc_id, text, len(units) AS n,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    units, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM drawn),
part AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
              ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM part"""


def oracles() -> dict[str, str]:
    return {"op1_license_scan": _license_scan(), "op7_chat_format": _chat_format(), "op9_odd_sketches": _odd_sketches(), "op11_piece_table": _piece_table()}
