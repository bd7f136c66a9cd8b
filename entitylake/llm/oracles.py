"""SQL of the operators whose statement takes more than a few lines."""

from __future__ import annotations

#: crc32 of the decimal id, bit by bit.
CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce(
        [xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _levels(name: str, depth: int) -> str:
    """``{name}0`` (tree, pos, h) and what lies above it: n nodes, each run's list; a single node stays."""
    parts = []
    for k in range(depth + 1):
        parts.append(f"{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})")
        parts.append(f"{name}{k}r AS (SELECT tree, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {name}{k}n GROUP BY 1, 2)")
        parts.append(
            f"{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{k}r)"
        )
    return ",\n".join(parts)


def _climb(name: str, depth: int, rows: str, tree: str, pos: str) -> str:
    """``rows`` with their siblings on each level appended to ``proof`` and ``x`` folded."""
    parts = []
    for k in range(depth + 1):
        at = f"(p.{pos} // {16**k}) % 16"
        step = f"{rows}_{name}{k}"
        before, after = f"array_to_string(r.hs[1:{at}], '')", f"array_to_string(r.hs[{at} + 2:], '')"
        parts.append(
            f"{step} AS (SELECT p.* REPLACE (CASE WHEN r.n = 1 THEN p.proof ELSE p.proof || {before} || {after} END AS proof, "
            f"CASE WHEN r.n = 1 THEN p.x ELSE sha256({before} || p.x || {after}) END AS x) "
            f"FROM {rows if k == 0 else f'{rows}_{name}{k - 1}'} p JOIN {name}{k}r r ON r.tree = p.{tree} AND r.run = p.{pos} // {16 ** (k + 1)})"
        )
    return ",\n".join(parts)


def merkle_sql(depth: int = 4, group_depth: int = 2) -> str:
    """Enough levels for 16 to the power of ``depth + 1`` documents a source and as many sources."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH leaves AS (
    SELECT doc_id, coalesce('+' || source, '') AS grp, {_leaf('text')} AS leaf,
        CASE WHEN {CRC} % 5 = 0 THEN {_leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS changed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), d0 AS (SELECT grp AS tree, pos, leaf AS h FROM placed),
{_levels('d', depth)},
tops AS (SELECT tree AS grp, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM d{depth + 1}),
s0 AS (SELECT 0 AS tree, place AS pos, subroot AS h FROM tops),
{_levels('s', group_depth)},
docs AS (
    SELECT p.doc_id, p.leaf, p.grp, p.pos, t.subroot, t.place, 0 AS one, '' AS proof, coalesce(p.changed, p.leaf) AS x
    FROM placed p JOIN tops t USING (grp)
),
{_climb('d', depth, 'docs', 'grp', 'pos')},
inner_docs AS (SELECT * FROM docs_d{depth}),
{_climb('s', group_depth, 'inner_docs', 'one', 'place')}
SELECT doc_id, leaf, subroot, (SELECT h FROM s{group_depth + 1}) AS root, sha256(proof) AS proof_sha256,
    x AS folded_root, x = (SELECT h FROM s{group_depth + 1}) AS verified
FROM inner_docs_s{group_depth}
"""


PASSAGES = r"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, row, i, array_to_string(words[i + 1:i + 13], ' ') AS passage
    FROM (SELECT *, unnest(range(0, greatest(len(words) - 12, 0))) AS i FROM split)
), firsts AS (
    SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage
), gone AS (
    SELECT DISTINCT row, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (passage) WHERE first < doc_id
), marked AS (
    SELECT s.doc_id, s.row, s.words, coalesce(g.places, []) AS places
    FROM split s LEFT JOIN (SELECT row, list(place) AS places FROM gone GROUP BY row) g USING (row)
), kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY place) AS text
    FROM (SELECT row, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM split) ANTI JOIN gone USING (row, place)
    GROUP BY row
)
SELECT doc_id, len(words) AS n_words, len(places) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM marked LEFT JOIN kept USING (row)
"""
