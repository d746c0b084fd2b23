"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"

OP3 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN repeated USING (r)
), bits AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
      + 4 * (100 * n_symbols > 25 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
      + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT
      AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  failed = 0 AS kept, failed
FROM bits
"""

# each kind: its pattern, the group whose length counts, and the length it needs
_SECRETS = {
    "assign": (
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    "private_key": ("-----BEGIN (?:[A-Z]{1,20} ){0,8}PRIVATE KEY-----", 0, 0),
    # RE2 cannot look behind; the same where no letter stands right before a token
    "web_token": (
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0,
    ),
}
_HITS = " UNION ALL ".join(
    f"""
    SELECT r, {nr} AS nr, '{kind}' AS kind, {least} AS least, unnest(range(1, len(hits) + 1)) AS i,
      hits[i] AS hit, values[i] AS value, gaps[i] AS gap
    FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS hits,
            regexp_extract_all(text, '{pattern}', {group}) AS values,
            string_split_regex(text, '{pattern}') AS gaps
          FROM t WHERE regexp_matches(text, '{pattern}'))
    """
    for nr, (kind, (pattern, group, least)) in enumerate(_SECRETS.items())
)
OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_HITS}),
spans AS (
  SELECT *, ends - length(hit) AS starts FROM (
    SELECT *, CAST(sum(length(gap) + length(hit))
      OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS ends
    FROM hits)
  WHERE length(value) >= least
), told AS (
  SELECT r,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || starts || ':' || ends, ',' ORDER BY starts, nr) AS spans,
    string_agg(kind || ':' || starts || ':' || ends, ',' ORDER BY starts, nr)
      FILTER (nr < 3) AS base
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM t LEFT JOIN told USING (r)
"""

# RE2 has no look-ahead: lines without a word are put behind the line before them
OP8 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM t WHERE text <> ''
), units AS (
  SELECT r, u, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS unit,
    trim(arg_min(line, i)) AS line
  FROM (SELECT *, sum(CASE WHEN i = 1 OR regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END)
          OVER (PARTITION BY r ORDER BY i) AS u FROM raw)
  GROUP BY r, u
), w AS (
  SELECT r, doc_id, u, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
  FROM units JOIN t USING (r) WINDOW o AS (PARTITION BY r ORDER BY u)
), later AS (
  SELECT r, u FROM w WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, u) > 1
), gone AS (SELECT DISTINCT r, u + k AS u FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (
  SELECT units.r, string_agg(unit, chr(10) ORDER BY units.u) FILTER (gone.u IS NULL) AS text,
    count(*) AS n_lines, count(gone.u) AS n_removed
  FROM units LEFT JOIN gone ON units.r = gone.r AND units.u = gone.u GROUP BY units.r
)
SELECT doc_id, coalesce(kept.text, '') AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_removed, 0) AS n_removed
FROM t LEFT JOIN kept USING (r)
"""


_TERMS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0
), item AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM item) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, total GROUP BY term, n_docs
), m AS (
  SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // all_terms AS m FROM d, total WHERE len(w) > 0
), scored AS (
  SELECT item_id, r, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (r)
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _least(*candidates: str) -> str:
    """The cheapest of some lists of edits, the ASCII-least among these; null if there is none."""
    return f"list_sort(list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL))[1]"


def _edit(told: str, cost: str, edit: str, turn: str = "''") -> str:
    """`told` with one more edit; `turn` is what it adds to the repaired conversation."""
    return (
        f"CASE WHEN {told} IS NOT NULL THEN {{'c': {told}.c + {cost},"
        f" 'a': {told}.a || '{edit}', 't': {told}.t || {turn}}} END"
    )


def _walk_sql() -> str:
    """Recursive walk of conversations, cheapest edits by place: p0 none yet, p1 s, p2 u, p3 a."""

    def insert(told: str, role: str) -> str:
        return "(" + _edit(told, "2", "I", f"chr(10) || '{role}:'") + ")"

    # before a row: with the turns inserted in front of it
    u = _least("p2", insert("p0", "user"), insert("p1", "user"), insert("p3", "user"))
    a = _least(
        "p3",
        insert("p2", "assistant"),
        *[insert(insert(p, "user"), "assistant") for p in ("p0", "p1")],
    )
    to_user = _least("p0", "p1", _least("p3", insert("p2", "assistant")))
    row, must = "chr(10) || role || ':' || text", "NOT must"

    def after(place: int) -> str:
        found = [_edit(f"p{place}", "3", "D")]
        if place == 1:
            found.append(f"CASE WHEN {must} AND initial = 's' THEN {_edit('p0', 'cut', 'K', row)} END")
        if place in (2, 3):
            role, initial, origin = (
                ("user", "u", "before_u") if place == 2 else ("assistant", "a", "before_a")
            )
            kept = _edit(origin, "cut", "K", row)
            rerole = _edit(origin, "2 + cut", "R", f"chr(10) || '{role}:' || text")
            found.append(f"CASE WHEN {must} AND initial = '{initial}' THEN {kept} END")
            found.append(f"CASE WHEN {must} THEN {rerole} END")
        return _least(*found) + f" AS p{place}"

    end = _least("p0", "p3", insert("p2", "assistant"), insert(insert("p1", "user"), "assistant"))
    return f"""
walk AS (
  SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS p0,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS p1,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS p2,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS p3
  FROM conv
  UNION ALL
  SELECT k, i, {', '.join(after(p) for p in range(4))}
  FROM (
    SELECT w.k, w.i + 1 AS i, p0, p1, p2, p3, role, text, must, cut, initial,
      {to_user} AS before_u, {_least("p2", *[f"({u})"])} AS before_a
    FROM walk w JOIN told r ON r.k = w.k AND r.i = w.i + 1
  )
), ended AS (
  SELECT k, i, {end} AS e FROM walk
)"""


OP11 = rf"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), hit AS (
  SELECT keyed.*, xor(list_reduce(
      [4294967295] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS h
  FROM keyed, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE h <> 0
), conv AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS k FROM (SELECT DISTINCT conv_id FROM conversations)
), numbered AS (
  SELECT k, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    right(regexp_replace(text, '{_SPACE}+$', ''), 1) NOT IN ('.', '!', '?') AS open
  FROM damaged d JOIN conv c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
), again AS (
  SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM numbered
), told AS (
  SELECT *, blank OR again AS must, CAST(open AS INTEGER) AS cut,
    lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM again
), counts AS (
  SELECT k, max(i) AS n,
    CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
    count_if(open AND NOT must) AS truncated, count_if(illegal) AS illegal
  FROM told GROUP BY k
), {_walk_sql()}
SELECT conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM conv LEFT JOIN counts USING (k) LEFT JOIN ended ON ended.k = conv.k AND ended.i = coalesce(n, 0)
"""


def llm_oracle() -> dict[str, str]:
    return {"op2_secret_scans": OP2, "op3_quality_rules": OP3, "op8_line_dedup": OP8, "op11_conversation_repair": OP11, "op12_lexical_search": OP12}
