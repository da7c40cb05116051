"""What four of the corpus queries must return, in SQL, by plain comparison of everything."""

from __future__ import annotations

from pairwright.llm import pii

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT coalesce(cast(item_id AS VARCHAR), '') AS item,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, s.size, k, array_to_string(w[k : k + s.size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size) s
), found AS (
  SELECT DISTINCT p.doc_id, p.k, p.size, w.item FROM places p JOIN windows w ON w.win = p.win AND w.size = p.size
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  r.root AS component_id, r.root = e.vec_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = e.vec_id
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b
  WHERE 100 * common >= 75 * (p.n + q.n - common)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id, r.root = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

#: The same patterns for an engine that finds leftmost matches without looking around.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "secret": r"(?:[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD)[\x22\x27]?\x20{0,3}[=:]"
    r"\x20{0,3}[\x22\x27]?[A-Za-z0-9+/_=-]{16,}",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_TURNED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_VALID = {
    "email": "true",
    "ip": rf"regexp_full_match(m, '{_PART}(?:\.{_PART}){{3}}')",
    "card": f"""CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN list_sum(list_transform(
        string_split(reverse({_DIGITS}), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT
        ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 ELSE false END""",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"""list_reduce(list_prepend(0, list_transform(string_split({_TURNED}, ''),
        lambda c: CASE WHEN c < 'A' THEN c::INT ELSE ascii(c) - 55 END)),
        lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1""",
    "secret": "regexp_matches(m, '[=:].*[0-9]') AND regexp_matches(m, '[=:].*[A-Za-z]')",
}


def _found(rank: int) -> str:
    kind = pii.KINDS[rank]
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind.name}' AS kind, start, start + length(m) AS stop,
    {kind.worth}::DOUBLE + CASE WHEN regexp_matches(tail, '{kind.for_it}') THEN {pii.RAISE}::DOUBLE ELSE 0 END
      - CASE WHEN regexp_matches(tail, '{kind.against_it}') THEN {pii.LOWER}::DOUBLE ELSE 0 END AS score
  FROM (
    SELECT doc_id, k, p AS m,
      sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(p) AS start,
      lower(right(lag(p) OVER (PARTITION BY doc_id ORDER BY k), {pii.CONTEXT})) AS tail
    FROM (
      SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (
        SELECT doc_id, string_split(
          regexp_replace(t, '({_PATTERNS[kind.name]})', chr(64976) || '\\1' || chr(64976), 'g'), chr(64976)) AS ps
        FROM d)))
  WHERE k % 2 = 1 AND ({_VALID[kind.name]})"""


_SPANS = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, replace(coalesce(text, ''), chr(64976), chr(64977)) AS t FROM documents
), found AS ({" UNION ALL ".join(_found(r) for r in range(len(pii.KINDS)))}
), per_doc AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {r}) AS n_{k.name}" for r, k in enumerate(pii.KINDS))},
    count(*) FILTER (score >= 0.7) AS n_likely,
    {_SPANS} FILTER (rank < {len(pii.BASE)}) AS base, {_SPANS} AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS)},
  coalesce(n_likely, 0)::BIGINT AS n_likely, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id)
"""


def crc32_sql(key: str) -> str:
    """crc32 of a text of ASCII characters: eight steps of the polynomial for each of them."""
    return f"""(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
        range(1, length({key}) + 1),
        lambda k: list_concat([ord(substr({key}, k::INT, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)
                          ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295))"""


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, {crc32_sql("cast(doc_id AS VARCHAR)")} AS h,
    CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^ 	-
]+') END AS ws
  FROM documents
), e AS (
  SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM d
), f AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e
), g AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f
), w AS (
  SELECT doc_id, n, unnest(range(0, n)) AS i,
    unnest(CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
                ELSE ws END) AS word
  FROM g WHERE n > 0
), m AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i > y.i
), s AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
  GROUP BY doc_id, q, island HAVING count(*) >= 6 AND count(*) >= q AND count(*) + q >= 12
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length
), c AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed
  FROM w LEFT JOIN (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r) gone
    ON w.doc_id = gone.doc_id AND w.i = gone.i
  WHERE gone.i IS NULL GROUP BY w.doc_id
), b AS (
  SELECT doc_id, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length,
  best.p::BIGINT AS period, (1000 * (-best.l) // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _least_way(*ways: str) -> str:
    """The cheapest of (cost, audit, lines), then the one with the least audit."""
    return f"list_sort([{', '.join(ways)}])[1]"


def _op12_sql() -> str:
    never = "{'cost': 1000000, 'audit': '', 'lines': ''}"

    def step(way: str, cost: str, letter: str, line: str = "''") -> str:
        """A way with one more edit."""
        return (
            f"{{'cost': {way}.cost + {cost}, 'audit': {way}.audit || '{letter}',"
            f" 'lines': {way}.lines || {line}}}"
        )

    def put_in(way: str, role: str) -> str:
        return step(way, "2", "I", f"'{role}:' || chr(10)")

    def only(condition: str, way: str) -> str:
        return f"CASE WHEN {condition} THEN {way} ELSE {never} END"

    kept = "r.role || ':' || r.text || chr(10)"
    states = {"n": "", "s": "s", "u": "u", "a": "a"}
    # ways to each state: by the row itself, before anything is put in
    row = {}
    for state in states:
        ways = [step(f"p.{state}", "3", "D")]
        if state == "s":
            ways.append(only("NOT r.forced AND r.ini = 's'", step("p.n", "r.cut", "K", kept)))
        if state in "ua":
            role = {"u": "user", "a": "assistant"}[state]
            for before in ("n", "s", "a") if state == "u" else ("u",):
                ways.append(
                    only(f"NOT r.forced AND r.ini = '{state}'", step(f"p.{before}", "r.cut", "K", kept))
                )
                line = f"'{role}:' || r.text || chr(10)"
                ways.append(only("NOT r.forced", step(f"p.{before}", "2 + r.cut", "R", line)))
        row[state] = f"{_least_way(*ways)} AS {state}"
    # then what may be put in behind it
    user = _least_way("u", put_in("n", "user"), put_in("s", "user"), put_in("a", "user"))
    assistant = _least_way("a", put_in("u", "assistant"))
    start = "{'cost': 0, 'audit': '', 'lines': ''}"
    key = "(coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' '))"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql(key)} % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM c WHERE kind <> 0
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text, role) AS k,
    role[1] AS ini, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open_end
  FROM d
), f AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS ini_before
  FROM e
), g AS (
  SELECT *, blank OR dup AS forced, CASE WHEN NOT blank AND NOT dup AND open_end THEN 1 ELSE 0 END AS cut
  FROM f
), w AS (
  SELECT conv_id, 0::BIGINT AS k, {start} AS n, {never} AS s, {put_in(start, "user")} AS u, {never} AS a
  FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, k, n, s, {_least_way("u", put_in("a", "user"))} AS u, a FROM (
    SELECT conv_id, k, n, s, u, {assistant} AS a FROM (
      SELECT conv_id, k, n, s, {user} AS u, a FROM (
        SELECT r.conv_id, r.k, {row["n"]}, {row["s"]}, {row["u"]}, {row["a"]}
        FROM w p JOIN g r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = p.k + 1)))
), z AS (
  SELECT conv_id, list_sort([n, a, {put_in("u", "assistant")}])[1] AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS last FROM w) WHERE last = 1
), m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id
), x AS (SELECT DISTINCT conv_id FROM conversations)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit,
  sha256(coalesce(regexp_replace(best.lines, '
\z', ''), '')) AS repaired_sha256
FROM x LEFT JOIN m ON x.conv_id IS NOT DISTINCT FROM m.conv_id
  LEFT JOIN z ON x.conv_id IS NOT DISTINCT FROM z.conv_id
"""


OP12_SQL = _op12_sql()
