"""SQL fragments shared by the DuckDB oracle queries.

They restate, in plain SQL, the same fixed values the Spark expressions use
(patterns, punctuation, stop lists, bin edges), so an oracle disagreement
points at the Spark plan and not at a differently written constant.
"""

from __future__ import annotations

from ctrltok.functions import text as T
from ctrltok.functions import tokens as K
from ctrltok.functions.bins import EDGE_COUNT, TOKEN_NAMES
from ctrltok.functions.subword import UNKNOWN_SURFACE
from ctrltok.sources.pieces import RANK_PENALTY, RANK_SCALE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOK = lit(T.TOKEN_PATTERN)
STRIP = lit(T.STRIP_PATTERN)
NUM = lit(T.NUMBER_PATTERN)
PUNCT = lit(T.PUNCTUATION)
WORDCH = lit(T.WORD_PATTERN)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {TOK})"


def tokenized(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def stop_list(language: str) -> str:
    return "(" + ", ".join(lit(w) for w in T.stop_words(language)) + ")"


def admitted(word: str, lang: str) -> str:
    return (f"(NOT contains({PUNCT}, {word}) AND NOT regexp_matches({word}, {NUM}) AND "
            f"NOT (CASE WHEN lower({lang}) = 'de' THEN {word} IN {stop_list('german')} "
            f"ELSE {word} IN {stop_list('english')} END))")


def bin_value(x: str, feature: str) -> str:
    """Smallest float64 edge >= x, clamped to the last edge (list-filter form,
    deliberately a different formulation from the Spark arithmetic)."""
    n = EDGE_COUNT[feature]
    edges = f"list_transform(range({n}), lambda i: 0.05::DOUBLE + i::DOUBLE * 0.05::DOUBLE)"
    last = f"(0.05::DOUBLE + {n - 1}::DOUBLE * 0.05::DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL ELSE coalesce(list_min(list_filter({edges}, lambda e: e >= {x})), {last}) END)"


def token(feature: str, v: str) -> str:
    return f"('<{TOKEN_NAMES[feature]}_' || CAST(round({v}, 2) AS VARCHAR) || '> ')"


PREFIX = lit(K.PREFIX_PATTERN)
NAME = lit(K.NAME_PATTERN)
VALUE = lit(K.VALUE_PATTERN)


def pairs_cte() -> str:
    """The conversation pair corpus (turn -> next turn), stripped."""
    return f"""pairs AS (
  SELECT c.conv_id * 16777216 + c.turn AS pair_id, c.conv_id, c.turn, 'en' AS lang,
         CASE WHEN c.conv_id % 10 = 0 THEN 'test' WHEN c.conv_id % 10 = 1 THEN 'valid' ELSE 'train' END AS split,
         {strip('c.text')} AS source, {strip('n.text')} AS target
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
)"""


def ranks_cte() -> str:
    """Rank table from document token counts (count desc, then word)."""
    return f"""doc_tokens AS (
  SELECT lang, unnest({tokens('text')}) AS word FROM documents
), ranks AS (
  SELECT lang, word, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS rank
  FROM (SELECT lang, word, count(*) AS cnt FROM doc_tokens GROUP BY lang, word)
), vocab AS (
  SELECT lang, count(*) AS vocab FROM ranks GROUP BY lang
)"""


def freq_cte(pairs: str = "pairs", sfx: str = "") -> str:
    """Per pair 0.75-quantile of admitted log ranks per side, OOV default.
    Defines ``freq{sfx}(pair_id, freq_source, freq_target)``."""
    return f"""side_tok{sfx} AS (
  SELECT pair_id, lang, side, unnest({tokens('txt')}) AS word
  FROM (SELECT pair_id, lang, 0 AS side, source AS txt FROM {pairs}
        UNION ALL SELECT pair_id, lang, 1 AS side, target AS txt FROM {pairs})
), side_lr{sfx} AS (
  SELECT t.pair_id, t.side, ln(coalesce(r.rank, v.vocab)::DOUBLE + 1.0) AS lr
  FROM side_tok{sfx} t LEFT JOIN ranks r ON r.lang = t.lang AND r.word = t.word
  LEFT JOIN vocab v ON v.lang = t.lang
  WHERE {admitted('t.word', 't.lang')}
), side_q{sfx} AS (
  SELECT pair_id,
         quantile_cont(lr, 0.75) FILTER (WHERE side = 0) AS q_source,
         quantile_cont(lr, 0.75) FILTER (WHERE side = 1) AS q_target
  FROM side_lr{sfx} GROUP BY pair_id
), freq{sfx} AS (
  SELECT p.pair_id,
         coalesce(q.q_source, ln(v.vocab::DOUBLE + 1.0)) AS freq_source,
         coalesce(q.q_target, ln(v.vocab::DOUBLE + 1.0)) AS freq_target
  FROM {pairs} p LEFT JOIN side_q{sfx} q ON q.pair_id = p.pair_id LEFT JOIN vocab v ON v.lang = p.lang
)"""


def depth_cte(src: str = "pairs", sfx: str = "") -> str:
    """Max depth of the synthetic parse per pair and side, by recursion from the
    root (needs WITH RECURSIVE).  Defines ``depth{sfx}(pair_id, depth_source,
    depth_target)``."""
    return f"""dep_tok{sfx} AS (
  SELECT pair_id, side, unnest(toks) AS tok, unnest(range(len(toks))) AS i
  FROM (SELECT pair_id, 0 AS side, {tokens('source')} AS toks FROM {src}
        UNION ALL SELECT pair_id, 1 AS side, {tokens('target')} AS toks FROM {src})
), dep_head{sfx} AS (
  SELECT pair_id, side, i, CASE WHEN i = 0 THEN -1 ELSE i - 1 - (length(tok) % i) END AS head FROM dep_tok{sfx}
), dep_rec{sfx}(pair_id, side, i, d) AS (
  SELECT pair_id, side, i, 0 FROM dep_head{sfx} WHERE head = -1
  UNION ALL
  SELECT h.pair_id, h.side, h.i, r.d + 1
  FROM dep_head{sfx} h JOIN dep_rec{sfx} r ON h.pair_id = r.pair_id AND h.side = r.side AND h.head = r.i
), depth{sfx} AS (
  SELECT p.pair_id,
         coalesce(max(r.d) FILTER (WHERE r.side = 0), 0) AS depth_source,
         coalesce(max(r.d) FILTER (WHERE r.side = 1), 0) AS depth_target
  FROM {src} p LEFT JOIN dep_rec{sfx} r ON r.pair_id = p.pair_id GROUP BY p.pair_id
)"""


def features_cte(src: str = "pairs", sfx: str = "") -> str:
    """The four feature values and bins for ``src`` (needs the freq{sfx}, depth{sfx} and
    lev{sfx} CTEs).  Defines ``binned{sfx}``."""
    return f"""feat{sfx} AS (
  SELECT p.*,
         greatest(d.depth_target::DOUBLE, 0.5) / greatest(d.depth_source::DOUBLE, 0.5) AS exact_dependency,
         f.freq_target / f.freq_source AS exact_frequency,
         CASE WHEN length(p.source) = 0 THEN NULL ELSE length(p.target)::DOUBLE / length(p.source)::DOUBLE END AS exact_length,
         e.lev AS exact_levenshtein
  FROM {src} p JOIN depth{sfx} d USING (pair_id) JOIN freq{sfx} f USING (pair_id) JOIN lev{sfx} e USING (pair_id)
), binned{sfx} AS (
  SELECT *, {bin_value('exact_dependency', 'dependency')} AS bin_dependency,
            {bin_value('exact_frequency', 'frequency')} AS bin_frequency,
            {bin_value('exact_length', 'length')} AS bin_length,
            {bin_value('exact_levenshtein', 'levenshtein')} AS bin_levenshtein
  FROM feat{sfx}
)"""


def prefix() -> str:
    """The rendered prefix of binned rows."""
    return "(" + " || ".join(token(f, f"bin_{f}") for f in sorted(TOKEN_NAMES)) + ")"


def doc_lines_cte() -> str:
    """Documents as line files: (doc_id, lang, file, line_no, line)."""
    return """doc_parts AS (
  SELECT doc_id, lang, source AS file, string_split(text, chr(10)) AS parts FROM documents
), doc_lines AS (
  SELECT doc_id, lang, file, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM doc_parts
)"""


def ngrams(toks: str, n: int) -> str:
    return f"list_transform(range(len({toks}) - {n} + 1), lambda i: array_to_string({toks}[i + 1:i + {n}], ' '))"


def lcs_cte(pairs: str = "pairs", sfx: str = "") -> str:
    """Edit similarity ``2 * LCS / (|a| + |b|)`` on whole texts, by anti-diagonals
    (needs WITH RECURSIVE).  Cells on one anti-diagonal depend only on the two
    previous diagonals, so each recursion step is one ``list_transform`` over
    the valid cells of the next diagonal (stored with their first row index
    ``lo``); ``USING KEY`` keeps only the latest two diagonals per pair.  The
    shorter text indexes the diagonal.  Defines ``lev{sfx}(pair_id, lev)``."""
    diag = """list_transform(range(greatest(0, dp.d + 1 - pr.m), least(pr.n, dp.d + 1) + 1), lambda i:
           CASE WHEN i = 0 OR dp.d + 1 - i = 0 THEN 0
                WHEN pr.a[i] = pr.b[dp.d + 1 - i] THEN coalesce(dp.p2[i - dp.lo2], 0) + 1
                ELSE greatest(coalesce(dp.p1[i - dp.lo1], 0), coalesce(dp.p1[i - dp.lo1 + 1], 0)) END)"""
    return f"""lcs_in{sfx} AS (
  SELECT pair_id, CASE WHEN length(source) <= length(target) THEN source ELSE target END AS x,
                  CASE WHEN length(source) <= length(target) THEN target ELSE source END AS y
  FROM {pairs}
), lcs_pr{sfx} AS (
  SELECT pair_id, length(x) AS n, length(y) AS m,
         list_transform(range(1, length(x) + 1), lambda k: substring(x, k, 1)) AS a,
         list_transform(range(1, length(y) + 1), lambda k: substring(y, k, 1)) AS b
  FROM lcs_in{sfx}
), lcs_dp{sfx}(pair_id, d, lo2, p2, lo1, p1) USING KEY (pair_id) AS (
  SELECT pair_id, 1, 0, [0], greatest(0, 1 - m), list_transform(range(greatest(0, 1 - m), least(n, 1) + 1), lambda i: 0)
  FROM lcs_pr{sfx}
  UNION
  SELECT dp.pair_id, dp.d + 1, dp.lo1, dp.p1, greatest(0, dp.d + 1 - pr.m), {diag}
  FROM lcs_dp{sfx} dp JOIN lcs_pr{sfx} pr USING (pair_id) WHERE dp.d < pr.n + pr.m
), lev{sfx} AS (
  SELECT dp.pair_id, CASE WHEN pr.n + pr.m = 0 THEN 1.0
                          ELSE 2.0 * coalesce(dp.p1[pr.n - dp.lo1 + 1], 0) / (pr.n + pr.m) END AS lev
  FROM lcs_dp{sfx} dp JOIN lcs_pr{sfx} pr USING (pair_id)
)"""


def vocabulary_file() -> str | None:
    """The vocabulary file of the sub-word queries; None where the public tokenizers are not installed."""
    from ctrltok.plans.queries import vocabulary_path

    try:
        return vocabulary_path()
    except ImportError:
        return None


def segments_cte(path: str, texts: str) -> str:
    """Best segmentation of every word of ``texts(txt)`` over the rank file's pieces (needs WITH RECURSIVE): lattice
    edges by a join of all substrings with the pieces, then the Viterbi recursion over one list per word.
    Defines ``piece(piece, score)`` and ``encoded(word, spaced, n, decoded)``."""
    ws, mark = T.WHITESPACE_CLASS, T.PIECE_MARK
    return f"""piece AS (
  SELECT piece, max(score) AS score FROM (
    SELECT regexp_replace(tok, '^ ', '{mark}') AS piece, -floor({RANK_SCALE} * ln(r + 2))::DOUBLE AS score
    FROM (SELECT TRY(decode(from_base64(t))) AS tok, r
          FROM read_csv({lit(path)}, delim=' ', header=false, quote='', escape='', columns={{'t': 'VARCHAR', 'r': 'BIGINT'}}))
    WHERE tok IS NOT NULL)
  WHERE length(piece) > 0 AND NOT regexp_matches(piece, '[{ws}]|(?s).{mark}') GROUP BY piece
), limits AS (SELECT max(length(piece)) AS longest, min(score) - {RANK_PENALTY} AS unknown FROM piece),
words AS (
  SELECT DISTINCT '{mark}' || w AS word FROM (SELECT unnest(regexp_extract_all(txt, '[^{ws}]+')) AS w FROM {texts})
), starts AS (SELECT word, unnest(range(length(word))) AS j FROM words),
spans AS (SELECT word, j, unnest(range(1, least(longest, length(word) - j) + 1)) AS l FROM starts, limits),
edges AS (
  SELECT word, j, j + l AS e, score FROM spans JOIN piece ON piece = substring(word, j + 1, l)
  UNION ALL SELECT word, j, j + 1, unknown FROM starts, limits WHERE substring(word, j + 1, 1) NOT IN (SELECT piece FROM piece)
), incoming AS (SELECT word, e, list(struct_pack(j := j, s := score)) AS el FROM edges GROUP BY word, e),
viterbi(word, i, best, prev) USING KEY (word) AS (
  SELECT word, 0, [0.0::DOUBLE], []::BIGINT[] FROM words
  UNION
  SELECT v.word, v.i + 1, list_append(v.best, m.v), list_append(v.prev, -m.k)
  FROM (SELECT v.word, v.i, v.best, v.prev,
               list_max(list_transform(n.el, lambda x: struct_pack(v := v.best[x.j + 1] + x.s, k := -x.j))) AS m
        FROM viterbi v JOIN incoming n ON n.word = v.word AND n.e = v.i + 1) v
), route(word, prev, s, e) AS (
  SELECT word, prev, prev[i], i FROM viterbi WHERE i = length(word)
  UNION ALL SELECT word, prev, prev[s], s FROM route WHERE s > 0
), parts AS (
  SELECT word, s, part, part NOT IN (SELECT piece FROM piece) AS unknown
  FROM (SELECT word, s, substring(word, s + 1, e - s) AS part FROM route)
), marked AS (SELECT *, coalesce(unknown AND lag(unknown) OVER (PARTITION BY word ORDER BY s), false) AS joined FROM parts),
encoded AS (
  SELECT word, substring(string_agg(CASE WHEN joined THEN '' ELSE ' ' END || part, '' ORDER BY s), 2) AS spaced,
         count(*) FILTER (NOT joined) AS n,
         string_agg(CASE WHEN NOT unknown THEN part WHEN joined THEN '' ELSE {lit(UNKNOWN_SURFACE)} END, '' ORDER BY s) AS decoded
  FROM marked GROUP BY word
)"""


def encoded_texts_cte(texts: str, keys: str) -> str:
    """Texts of ``texts(<keys>, txt)`` encoded whole.  Defines ``coded(<keys>, n, spaced, decoded)``."""
    ws, mark = T.WHITESPACE_CLASS, T.PIECE_MARK
    return f"""text_words AS (
  SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
  FROM (SELECT {keys}, regexp_extract_all(txt, '[^{ws}]+') AS ws FROM {texts})
), coded0 AS (
  SELECT {keys}, sum(n) AS n, string_agg(spaced, ' ' ORDER BY k) AS spaced, string_agg(decoded, '' ORDER BY k) AS joined
  FROM text_words JOIN encoded ON word = '{mark}' || w GROUP BY {keys}
), coded AS (
  SELECT {', '.join(f't.{x.strip()}' for x in keys.split(','))}, coalesce(n, 0)::BIGINT AS n, coalesce(spaced, '') AS spaced,
         coalesce(regexp_replace(replace(joined, '{mark}', ' '), '\\A ', ''), '') AS decoded
  FROM {texts} t LEFT JOIN coded0 USING ({keys})
)"""
