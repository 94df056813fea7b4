"""DuckDB oracle SQL, one statement per registered query.

The tables of the input folder are pre-registered as views.  Every statement
computes the same thing as its Spark twin from scratch, in plain SQL, over the
whole tables.  The edit similarity (an LCS, for which SQL has no function)
is a recursive anti-diagonal dynamic program over whole texts; the tests also
check it against a plain dynamic-programming brute force.
"""

from __future__ import annotations

from ctrltok.functions import bins as B
from ctrltok.functions import text as T
from ctrltok.operators.corpus import combination_list
from ctrltok.operators.experiments import FEATURE_ABBR
from ctrltok.operators.metrics import SENTENCE_END_PATTERN, SYLLABLE_PATTERN, WORD_RUN_PATTERN
from ctrltok.plans import sqltext as S

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


CF = B.FEATURES
PIECE = S.lit(T.PIECE_MARK)
WS = T.WHITESPACE_CLASS


def _r6(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------------------
# Control corpus
# ---------------------------------------------------------------------------

def _corpus_sql(depth: str) -> str:
    return f"""
WITH RECURSIVE {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}, {depth}, {S.lcs_cte()}, {S.features_cte()}
SELECT pair_id, split, 'dependency_frequency_length_levenshtein' AS feature_set,
       {', '.join(f'round(exact_{f}, 6) AS exact_{f}' for f in CF)},
       {S.prefix()} AS prefix, {S.prefix()} || {S.tokenized('source')} AS source_line,
       {S.tokenized('target')} AS target_line
FROM binned
"""


#: Depths where every line of a text is a sentence of its own.
_LINE_DEPTH = f"""sent_txt AS (
  SELECT pair_id, side, unnest(range(len(ls))) AS sent_no, unnest(ls) AS line
  FROM (SELECT pair_id, 0 AS side, string_split(source, chr(10)) AS ls FROM pairs
        UNION ALL SELECT pair_id, 1 AS side, string_split(target, chr(10)) AS ls FROM pairs)
), sent_tok AS (
  SELECT pair_id, side, sent_no, unnest(toks) AS tok, unnest(range(len(toks))) AS i
  FROM (SELECT pair_id, side, sent_no, {S.tokens('line')} AS toks FROM sent_txt)
), sent_head AS (
  SELECT pair_id, side, sent_no, i, CASE WHEN i = 0 THEN -1 ELSE i - 1 - (length(tok) % i) END AS head FROM sent_tok
), sent_rec(pair_id, side, sent_no, i, d) AS (
  SELECT pair_id, side, sent_no, i, 0 FROM sent_head WHERE head = -1
  UNION ALL
  SELECT h.pair_id, h.side, h.sent_no, h.i, r.d + 1
  FROM sent_head h JOIN sent_rec r ON h.pair_id = r.pair_id AND h.side = r.side AND h.sent_no = r.sent_no AND h.head = r.i
), depth AS (
  SELECT p.pair_id, coalesce(max(r.d) FILTER (WHERE r.side = 0), 0) AS depth_source,
         coalesce(max(r.d) FILTER (WHERE r.side = 1), 0) AS depth_target
  FROM pairs p LEFT JOIN sent_rec r ON r.pair_id = p.pair_id GROUP BY p.pair_id
)"""

oracle("control_corpus", _corpus_sql(S.depth_cte()))
oracle("control_corpus_all", _corpus_sql(_LINE_DEPTH))

oracle("depth_from_heads", f"""
WITH RECURSIVE {S.pairs_cte()}, {_LINE_DEPTH}
SELECT pair_id, side, max(d)::BIGINT AS depth FROM sent_rec GROUP BY pair_id, side
""")

oracle("control_corpus_length", f"""
WITH {S.pairs_cte()},
feat AS (
  SELECT *, CASE WHEN length(source) = 0 THEN NULL ELSE length(target)::DOUBLE / length(source)::DOUBLE END AS exact_length
  FROM pairs
), binned AS (SELECT *, {S.bin_value('exact_length', 'length')} AS bin_length FROM feat)
SELECT pair_id, split, round(exact_length, 6) AS exact_length,
       CAST(round((bin_length - 0.05) / 0.05) AS INTEGER) AS bin_idx_length,
       {S.token('length', 'bin_length')} AS prefix,
       {S.token('length', 'bin_length')} || {S.tokenized('source')} AS source_line,
       {S.tokenized('target')} AS target_line
FROM binned
""")

# ---------------------------------------------------------------------------
# Scans, pairing, shards
# ---------------------------------------------------------------------------

_DOC_FILES = f"""{S.doc_lines_cte()},
src AS (SELECT doc_id // 2 AS unit, line_no, line FROM doc_lines WHERE doc_id % 2 = 0),
tgt AS (SELECT (doc_id - 1) // 2 AS unit, line_no, line FROM doc_lines WHERE doc_id % 2 = 1)"""

oracle("pairs_scan", f"""
WITH {_DOC_FILES}
SELECT coalesce(s.unit, t.unit) AS unit, coalesce(s.line_no, t.line_no) AS line_no,
       {S.strip('s.line')} AS source, {S.strip('t.line')} AS target
FROM src s FULL OUTER JOIN tgt t ON s.unit = t.unit AND s.line_no = t.line_no
""")

oracle("pair_tsv", f"""
WITH {_DOC_FILES},
p AS (SELECT s.unit, s.line_no, {S.strip('s.line')} AS source, {S.strip('t.line')} AS target
      FROM src s JOIN tgt t ON s.unit = t.unit AND s.line_no = t.line_no)
SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n_words, line_no) - 1 AS position
FROM (SELECT unit, line_no, len(string_split(source, ' '))::BIGINT AS n_words, source || chr(9) || target AS tsv FROM p)
""")

oracle("lines_head", f"""
WITH {S.doc_lines_cte()}
SELECT doc_id, line_no, line FROM doc_lines WHERE line_no < 5
""")

_SHARDS = f"""{S.doc_lines_cte()},
sh AS (SELECT doc_id, line_no, line, (line_no - 1) // 4 + 1 AS shard FROM doc_lines WHERE line_no >= 1)"""

oracle("shard_assign", f"""
WITH {_SHARDS}
SELECT doc_id, line_no, shard, 'train_' || CAST(shard AS VARCHAR) AS shard_name FROM sh
""")

oracle("shard_merge", f"""
WITH {_SHARDS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY shard DESC, line_no) - 1 AS merged_line_no,
       shard, line_no, line
FROM sh WHERE line <> ''
""")

# ---------------------------------------------------------------------------
# Tokens, predicates, ranks
# ---------------------------------------------------------------------------

_SIDES = """sides AS (
  SELECT pair_id, lang, 0 AS side, source AS txt FROM pairs
  UNION ALL SELECT pair_id, lang, 1 AS side, target AS txt FROM pairs
)"""

_PAIR_TOKENS = f"""{_SIDES},
tok_lists AS (SELECT pair_id, lang, side, {S.tokens('txt')} AS toks FROM sides),
pair_tokens AS (
  SELECT pair_id, lang, side, unnest(range(len(toks))) AS token_no, unnest(toks) AS word FROM tok_lists
)"""

oracle("tokenize", f"""
WITH {S.pairs_cte()}, {_SIDES}
SELECT pair_id, side, len({S.tokens('txt')})::BIGINT AS n_tokens, {S.tokenized('txt')} AS tokens FROM sides
""")

oracle("token_filter", f"""
WITH {S.pairs_cte()}, {_PAIR_TOKENS}
SELECT pair_id, side, token_no, word,
       contains({S.PUNCT}, word) AS is_punct,
       regexp_matches(word, {S.NUM}) AS is_number,
       CASE WHEN lower(lang) = 'de' THEN word IN {S.stop_list('german')} ELSE word IN {S.stop_list('english')} END AS is_stop,
       {S.admitted('word', 'lang')} AS admitted
FROM pair_tokens
""")

_PIECES = (f"regexp_extract_all(regexp_replace(source, '(\\A|[{WS}]+)([^{WS}])', ' ' || {PIECE} || '\\2', 'g'), "
           f"{PIECE} || '?(?:' || {S.TOK} || ')')")

oracle("detokenize", f"""
WITH {S.pairs_cte()}, pc AS (SELECT pair_id, {_PIECES} AS pieces FROM pairs)
SELECT pair_id, len(pieces)::BIGINT AS n_pieces, array_to_string(pieces, ' ') AS pieces,
       ltrim(replace(array_to_string(pieces, ''), {PIECE}, ' ')) AS detokenized
FROM pc
""")

oracle("rank_table", f"""
WITH {S.doc_lines_cte()},
w AS (SELECT doc_id, line_no, regexp_split_to_array({S.strip('line')}, '[{WS}]+')[1] AS word
      FROM doc_lines WHERE line_no > 0)
SELECT doc_id, word, max(line_no) AS rank FROM w WHERE word IS NOT NULL AND word <> '' GROUP BY doc_id, word
""")

oracle("corpus_ranks", f"""
WITH {S.ranks_cte()}
SELECT lang, word, cnt, rank FROM ranks
""")

oracle("rank_summary", f"""
WITH {S.ranks_cte()}
SELECT lang, count(*) AS vocab_size, arg_min(word, rank) AS most_frequent, arg_max(word, rank) AS least_frequent
FROM ranks GROUP BY lang
""")

oracle("vocabulary", f"""
WITH {S.pairs_cte()},
toks AS (
  SELECT 'src' AS side, unnest({S.tokens('source')}) AS token FROM pairs
  UNION ALL SELECT 'tgt' AS side, unnest({S.tokens('target')}) AS token FROM pairs
), c AS (SELECT side, token, count(*) AS cnt FROM toks GROUP BY side, token)
SELECT side, token, cnt, row_number() OVER (PARTITION BY side ORDER BY cnt DESC, token) AS freq_rank FROM c
""")

oracle("rank_lookup", f"""
WITH {S.pairs_cte()}, {S.ranks_cte()}, {_PAIR_TOKENS}
SELECT t.pair_id, t.side, t.token_no, t.word,
       (coalesce(r.rank, v.vocab) + 1)::BIGINT AS raw_rank,
       round(ln((coalesce(r.rank, v.vocab) + 1)::DOUBLE), 6) AS log_rank
FROM pair_tokens t LEFT JOIN ranks r ON r.lang = t.lang AND r.word = t.word LEFT JOIN vocab v ON v.lang = t.lang
WHERE {S.admitted('t.word', 't.lang')}
""")

oracle("freq_stat", f"""
WITH {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}
SELECT pair_id, round(freq_source, 6) AS freq_source, round(freq_target, 6) AS freq_target FROM freq
""")

for _same in ("freq_row", "freq_reuse"):
    oracle(_same, ORACLE["freq_stat"])

oracle("freq_ratio", f"""
WITH {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}
SELECT pair_id, round(freq_target / freq_source, 6) AS freq_ratio FROM freq
""")

oracle("freq_abs", f"""
WITH {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}
SELECT pair_id, round(freq_target, 6) AS freq_abs FROM freq
""")

oracle("rank_profile", f"""
WITH {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}
SELECT pair_id, side, round(avg(lr), 6) AS mean, round(max(lr), 6) AS max, round(stddev_pop(lr), 6) AS sd,
       round(quantile_cont(lr, 0.5), 6) AS median, round(quantile_cont(lr, 0.25), 6) AS q1,
       round(quantile_cont(lr, 0.75), 6) AS q3,
       round(quantile_cont(lr, 0.75) - quantile_cont(lr, 0.25), 6) AS iqr
FROM side_lr GROUP BY pair_id, side
""")

# ---------------------------------------------------------------------------
# Row-local features and bins
# ---------------------------------------------------------------------------

oracle("length_ratio", f"""
WITH {S.pairs_cte()}
SELECT pair_id, round(CASE WHEN length(source) = 0 THEN NULL ELSE length(target)::DOUBLE / length(source)::DOUBLE END, 6) AS length_ratio
FROM pairs
""")

oracle("length_abs", f"""
WITH {S.pairs_cte()}
SELECT pair_id, length(target)::DOUBLE AS length_abs FROM pairs
""")

oracle("edit_ratio", f"""
WITH RECURSIVE {S.pairs_cte()}, {S.lcs_cte()}
SELECT pair_id, round(lev, 6) AS edit_ratio FROM lev
""")

oracle("tree_depth", f"""
WITH RECURSIVE {S.pairs_cte()}, {S.depth_cte()}
SELECT pair_id, depth_source, depth_target FROM depth
""")

oracle("depth_ratio", f"""
WITH RECURSIVE {S.pairs_cte()}, {S.depth_cte()}
SELECT pair_id, round(greatest(depth_target::DOUBLE, 0.5) / greatest(depth_source::DOUBLE, 0.5), 6) AS depth_ratio FROM depth
""")

oracle("depth_abs", f"""
WITH RECURSIVE {S.pairs_cte()}, {S.depth_cte()}
SELECT pair_id, depth_target::DOUBLE AS depth_abs FROM depth
""")

_BUNDLE = f"WITH RECURSIVE {S.pairs_cte()}, {S.ranks_cte()}, {S.freq_cte()}, {S.depth_cte()}, {S.lcs_cte()}, {S.features_cte()}"


def _idx(f: str) -> str:
    return f"CAST(round((bin_{f} - 0.05) / 0.05) AS INTEGER) AS bin_idx_{f}"


oracle("bin_values", f"""
{_BUNDLE}
SELECT pair_id, {', '.join(_idx(f) for f in CF)}, {', '.join(f'round(bin_{f}, 2) AS bin_{f}' for f in CF)}
FROM binned
""")

oracle("feature_bundle", f"""
{_BUNDLE}
SELECT pair_id, {', '.join(f'round(exact_{f}, 6) AS exact_{f}' for f in CF)},
       {', '.join(f'round(bin_{f}, 2) AS bin_{f}' for f in CF)}
FROM binned
""")

_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, exact_{f} AS x, split FROM binned" for f in CF)
_LONG_BIN = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(bin_{f}, 2) AS value, split FROM binned" for f in CF)

oracle("feature_summary", f"""
{_BUNDLE}, lf AS ({_LONG})
SELECT feature, count(x) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean,
       round(stddev_pop(x), 6) AS std
FROM lf GROUP BY feature
""")

oracle("control_prefix", f"""
{_BUNDLE}
SELECT pair_id, {S.prefix()} AS prefix FROM binned
""")


def _snapped_prefix() -> str:
    from ctrltok.plans.queries import INFER_REQUEST
    parts = [S.token(f, S.bin_value(f"{float(v)!r}::DOUBLE", f)) for f, v in sorted(INFER_REQUEST.items())]
    return " || ".join(parts)


oracle("infer_prefix", f"""
WITH {S.doc_lines_cte()}
SELECT doc_id, line_no, {_snapped_prefix()} || {S.tokenized('line')} AS model_input FROM doc_lines
""")

# ---------------------------------------------------------------------------
# Parsing control tokens, ablation, profiles
# ---------------------------------------------------------------------------

_CONTROL_LINES = f"""{_BUNDLE},
cl0 AS (SELECT pair_id, turn, split, {S.prefix()} || {S.tokenized('source')} AS line FROM binned),
cl AS (SELECT pair_id, split, CASE WHEN turn % 2 = 1 THEN replace(line, '> <', '><') ELSE line END AS line FROM cl0),
parsed AS (
  SELECT pair_id, split, line, regexp_extract(line, {S.PREFIX}, 1) AS prefix,
         regexp_replace(line, {S.PREFIX}, '') AS sentence
  FROM cl
)"""


def _last_value(name: str, src: str = "prefix") -> str:
    pat = S.lit(rf"(?s).*<{name}_([0-9]+(?:\.[0-9]+)?)>")
    return f"CAST(nullif(regexp_extract({src}, {pat}, 1), '') AS DOUBLE)"


oracle("parse_tokens", f"""
{_CONTROL_LINES}
SELECT pair_id,
       CASE WHEN prefix = '' THEN NULL ELSE len(list_distinct(regexp_extract_all(prefix, {S.NAME}, 1))) END::BIGINT AS n_controls,
       {', '.join(f"{_last_value(B.TOKEN_NAMES[f])} AS {B.TOKEN_NAMES[f]}" for f in CF)},
       sentence
FROM parsed
""")


def _ablation_sql() -> str:
    rows = []
    for combo in combination_list():
        fs = sorted(combo)
        parts = []
        for f in fs:
            n = B.TOKEN_NAMES[f]
            v = _last_value(n)
            parts.append(f"CASE WHEN {v} IS NULL THEN '' ELSE '<{n}_' || CAST({v} AS VARCHAR) || '> ' END")
        rows.append(f"SELECT pair_id, '{'_'.join(fs)}' AS feature_set, {' || '.join(parts)} || sentence AS ablated_line FROM parsed")
    return "\nUNION ALL\n".join(rows)


oracle("feature_ablation", f"""
{_CONTROL_LINES}
{_ablation_sql()}
""")

def _features_list(bits: str) -> str:
    names = ", ".join(f"CASE WHEN ({bits} >> {i}) & 1 = 1 THEN '{f}' END" for i, f in enumerate(B.FEATURES))
    return f"list_filter([{names}], lambda f: f IS NOT NULL)"


oracle("feature_combinations", f"""
WITH cfg AS (
  SELECT CAST(p_partkey AS VARCHAR) AS exp_id, {_features_list('((p_partkey % 15) + 1)')} AS feats FROM part
), c AS (
  SELECT exp_id, feats, unnest(generate_series(1, (1 << len(feats)) - 2)) AS combo FROM cfg
), s AS (
  SELECT exp_id, combo, list_filter(feats, lambda f, i: (combo >> (i - 1)) & 1 = 1) AS subset FROM c
)
SELECT exp_id, combo::BIGINT AS combo, array_to_string(subset, '_') AS feature_set, len(subset)::BIGINT AS n_features FROM s
""")

oracle("value_counts", f"""
{_CONTROL_LINES},
nv AS (SELECT split, regexp_extract_all(prefix, {S.NAME}, 1) AS names, regexp_extract_all(prefix, {S.VALUE}, 1) AS vals FROM parsed),
v AS (SELECT split, unnest(names) AS name, CAST(unnest(vals) AS DOUBLE) AS value FROM nv)
SELECT name, value, split, GROUPING(split)::INTEGER AS pooled, count(*) AS cnt FROM v GROUP BY GROUPING SETS ((name, value, split), (name, value))
""")

oracle("hist_equal_width", f"""
{_BUNDLE}, lf AS ({_LONG}),
v AS (SELECT feature, x FROM lf WHERE x IS NOT NULL AND NOT isnan(x)),
b0 AS (SELECT feature, min(x) AS lo0, max(x) AS hi0 FROM v GROUP BY feature),
b AS (SELECT feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                      CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi,
                      CASE WHEN feature = 'levenshtein' THEN 50 ELSE 80 END AS n FROM b0),
k0 AS (SELECT v.feature, v.x, b.lo, b.hi, b.n, CAST(floor((v.x - b.lo) * (b.n::DOUBLE / (b.hi - b.lo))) AS INTEGER) AS k
       FROM v JOIN b USING (feature)),
k1 AS (SELECT feature, x, lo, hi, n, CASE WHEN k = n THEN n - 1 ELSE k END AS k FROM k0),
k2 AS (SELECT feature, x, lo, hi, n,
              CASE WHEN x < (CASE WHEN k >= n THEN hi ELSE k::DOUBLE * ((hi - lo) / n::DOUBLE) + lo END) THEN k - 1 ELSE k END AS k
       FROM k1),
k3 AS (SELECT feature, lo, hi, n,
              CASE WHEN x >= (CASE WHEN k + 1 >= n THEN hi ELSE (k + 1)::DOUBLE * ((hi - lo) / n::DOUBLE) + lo END)
                        AND k <> n - 1 THEN k + 1 ELSE k END AS bin
       FROM k2)
SELECT feature, bin, count(*) AS cnt, n AS n_bins,
       round(CASE WHEN bin >= n THEN hi ELSE bin::DOUBLE * ((hi - lo) / n::DOUBLE) + lo END, 6) AS bin_lo
FROM k3 GROUP BY feature, bin, n, lo, hi
""")

oracle("hist_fixed", f"""
{_BUNDLE}, lf AS ({_LONG_BIN}),
v AS (SELECT feature, split, CAST(floor((value - 0.01) / 0.05) AS INTEGER) AS bin FROM lf),
k AS (SELECT * FROM v WHERE bin >= 0 AND bin < CASE WHEN feature = 'levenshtein' THEN 20 ELSE 40 END)
SELECT feature, bin, split, count(*) AS cnt FROM k GROUP BY GROUPING SETS ((feature, bin, split), (feature, bin))
""")

# ---------------------------------------------------------------------------
# Model outputs and evaluation
# ---------------------------------------------------------------------------

_HYPS = """hyps AS (
  SELECT conv_id AS sample_id, (conv_id * 16777216 + turn) * 2 + 1 AS log_no,
         CAST('-0.' || CAST(turn AS VARCHAR) AS DOUBLE) AS score, replace(text, chr(10), ' ') AS text
  FROM conversations
)"""

oracle("hyp_parse", f"""
WITH {_HYPS}
SELECT sample_id, log_no, score, text FROM hyps
""")

oracle("best_hypothesis", f"""
WITH {_HYPS}
SELECT sample_id, arg_min(score, log_no) AS score, arg_min(text, log_no) AS text FROM hyps GROUP BY sample_id
""")

_TRIPLES = f"""tri AS (
  SELECT c.conv_id * 16777216 + c.turn AS pair_id, 'en' AS lang, {S.strip('c.text')} AS t0,
         {S.strip('n1.text')} AS t1, {S.strip('n2.text')} AS t2
  FROM conversations c
  JOIN conversations n1 ON n1.conv_id = c.conv_id AND n1.turn = c.turn + 1
  JOIN conversations n2 ON n2.conv_id = c.conv_id AND n2.turn = c.turn + 2
), req_pairs AS (SELECT pair_id, lang, t0 AS source, t2 AS target FROM tri),
real_pairs AS (SELECT pair_id, lang, {S.tokenized('t0')} AS source, t1 AS target FROM tri)"""

_MATCH = f"""WITH RECURSIVE {S.ranks_cte()}, {_TRIPLES},
{S.freq_cte('req_pairs', '_q')}, {S.depth_cte('req_pairs', '_q')}, {S.lcs_cte('req_pairs', '_q')}, {S.features_cte('req_pairs', '_q')},
{S.freq_cte('real_pairs', '_r')}, {S.depth_cte('real_pairs', '_r')}, {S.lcs_cte('real_pairs', '_r')}, {S.features_cte('real_pairs', '_r')},
cmp AS (
  {" UNION ALL ".join(
      f"SELECT q.pair_id, '{B.TOKEN_NAMES[f]}' AS name, round(q.bin_{f}, 2) AS requested, round(r.bin_{f}, 2) AS realised "
      f"FROM binned_q q JOIN binned_r r USING (pair_id) WHERE q.pair_id % 5 <> 0 AND q.bin_{f} IS NOT NULL" for f in CF)}
), cmp2 AS (
  SELECT *, coalesce(requested = realised, false) AS match, CASE WHEN requested <> realised THEN requested - realised END AS delta FROM cmp
)"""

oracle("feature_match", f"""
{_MATCH}
SELECT name, GROUPING(name)::INTEGER AS is_total, count(*) FILTER (WHERE match) AS n_match,
       count(*) FILTER (WHERE NOT match) AS n_mismatch, round(avg(delta), 6) AS avg_delta
FROM cmp2 GROUP BY ROLLUP (name)
""")

oracle("feature_match_totals", f"""
{_MATCH}
SELECT (SELECT count(*) FROM tri) AS n_pairs, (SELECT count(*) FROM tri WHERE pair_id % 5 <> 0) AS n_prefixed,
       (SELECT count(*) FROM tri) * {len(CF)} AS n_features_total,
       (SELECT count(*) FROM cmp2 WHERE match) AS n_matches
""")

_METRIC_ROWS = f"""{S.pairs_cte()},
mr AS (
  SELECT pair_id, {S.tokens('lower(source)')} AS src_tokens, {S.tokens('lower(target)')} AS ref_tokens FROM pairs
), mrows AS (
  SELECT pair_id, src_tokens, ref_tokens, list_filter(src_tokens, lambda t, j: j % 4 <> 0) AS hyp_tokens FROM mr
)"""


def _grams(role: str, col: str) -> str:
    return " UNION ALL ".join(
        f"SELECT pair_id, '{role}' AS role, {n} AS n, unnest({S.ngrams(col, n)}) AS gram FROM mrows" for n in range(1, 5))


oracle("bleu", f"""
WITH {_METRIC_ROWS},
g AS ({_grams('h', 'hyp_tokens')} UNION ALL {_grams('r', 'ref_tokens')}),
c AS (SELECT pair_id, n, gram, count(*) FILTER (WHERE role = 'h') AS h, count(*) FILTER (WHERE role = 'r') AS r
      FROM g GROUP BY pair_id, n, gram),
s AS (
  SELECT {', '.join(f"coalesce(sum(least(h, r)) FILTER (WHERE n = {n}), 0) AS m{n}, coalesce(sum(h) FILTER (WHERE n = {n}), 0) AS t{n}" for n in range(1, 5))},
         coalesce(sum(r) FILTER (WHERE n = 1), 0) AS ref_len
  FROM c
), p AS (
  SELECT *, t1 AS hyp_len,
         {', '.join(f"coalesce(CASE WHEN t{n} = 0 THEN NULL ELSE m{n}::DOUBLE / t{n}::DOUBLE END, 0.0) AS p{n}" for n in range(1, 5))},
         CASE WHEN t1 = 0 THEN 0.0 WHEN t1 >= ref_len THEN 1.0 ELSE exp(1.0 - ref_len::DOUBLE / t1::DOUBLE) END AS bp
  FROM s
)
SELECT round(CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0.0
                  ELSE 100.0 * bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4.0) END, 6) AS bleu,
       round(bp, 6) AS bp, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
       hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len
FROM p
""")


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


def _ratio(num: str, den: str) -> str:
    return f"coalesce(CASE WHEN ({den}) = 0 THEN NULL ELSE ({num})::DOUBLE / ({den})::DOUBLE END, 0.0)"


_SARI = f"""WITH {_METRIC_ROWS},
g AS ({_grams('s', 'src_tokens')} UNION ALL {_grams('c', 'hyp_tokens')} UNION ALL {_grams('r', 'ref_tokens')}),
c AS (SELECT pair_id, n, gram, count(*) FILTER (WHERE role = 's') AS s, count(*) FILTER (WHERE role = 'c') AS c,
             count(*) FILTER (WHERE role = 'r') AS r
      FROM g GROUP BY pair_id, n, gram),
d AS (SELECT *, least(s, c) AS k, least(s, c, r) AS kg, least(s, r) AS ka, greatest(s - c, 0) AS d,
             greatest(s - c - r, 0) AS dg, c > 0 AND s = 0 AS a, c > 0 AND s = 0 AND r > 0 AS ag,
             r > 0 AND s = 0 AS aall FROM c),
sums AS (
  SELECT pair_id, n,
         coalesce(sum(CASE WHEN k > 0 THEN kg::DOUBLE / k END), 0) AS keep_hit, count(*) FILTER (WHERE k > 0) AS keep_sys,
         coalesce(sum(CASE WHEN ka > 0 THEN kg::DOUBLE / ka END), 0) AS keep_found, count(*) FILTER (WHERE ka > 0) AS keep_ref,
         coalesce(sum(CASE WHEN d > 0 THEN dg::DOUBLE / d END), 0) AS del_hit, count(*) FILTER (WHERE d > 0) AS del_sys,
         count(*) FILTER (WHERE ag) AS add_hit, count(*) FILTER (WHERE a) AS add_sys, count(*) FILTER (WHERE aall) AS add_ref
  FROM d GROUP BY pair_id, n
), pooled AS (
  SELECT n, {', '.join(f'sum({x}) AS {x}' for x in ('keep_hit', 'keep_sys', 'keep_found', 'keep_ref', 'del_hit', 'del_sys', 'add_hit', 'add_sys', 'add_ref'))}
  FROM sums GROUP BY n
)"""


def _sari_scores(table: str, keys: str) -> str:
    return f"""r0 AS (
  SELECT {keys} n, {_ratio('keep_hit', 'keep_sys')} AS keep_p, {_ratio('keep_found', 'keep_ref')} AS keep_r,
         {_ratio('del_hit', 'del_sys')} AS del_p, {_ratio('add_hit', 'add_sys')} AS add_p, {_ratio('add_hit', 'add_ref')} AS add_r
  FROM {table}
), r1 AS (SELECT *, {_f1('keep_p', 'keep_r')} AS keep, {_f1('add_p', 'add_r')} AS addf FROM r0),
scores AS (
  SELECT {keys} 100.0 * sum(keep) / 4.0 AS keep, 100.0 * sum(del_p) / 4.0 AS deletion, 100.0 * sum(addf) / 4.0 AS addition
  FROM r1 {'GROUP BY pair_id' if keys else ''}
)"""


_SENT = f"""{_SARI}, {_sari_scores('sums', 'pair_id,')}, sent AS (
  SELECT m.pair_id, coalesce(s.keep, 0.0) AS keep, coalesce(s.deletion, 0.0) AS deletion, coalesce(s.addition, 0.0) AS addition,
         (coalesce(s.keep, 0.0) + coalesce(s.deletion, 0.0) + coalesce(s.addition, 0.0)) / 3.0 AS sari
  FROM mrows m LEFT JOIN scores s USING (pair_id)
)"""

oracle("sari", f"""
{_SENT}
SELECT pair_id, round(keep, 6) AS keep, round(deletion, 6) AS deletion, round(addition, 6) AS addition,
       round(sari, 6) AS sari
FROM sent
""")

oracle("sari_mean", f"""
{_SENT}
SELECT count(*) AS n_sentences, round(avg(sari), 6) AS sari, round(avg(keep), 6) AS keep,
       round(avg(deletion), 6) AS deletion, round(avg(addition), 6) AS addition
FROM sent
""")

oracle("sari_corpus", f"""
{_SARI}, {_sari_scores('pooled', '')}
SELECT (SELECT count(*) FROM mrows) AS n_sentences, round((keep + deletion + addition) / 3.0, 6) AS sari,
       round(keep, 6) AS keep, round(deletion, 6) AS deletion, round(addition, 6) AS addition
FROM scores
""")

oracle("fkgl", f"""
WITH {_METRIC_ROWS},
h AS (SELECT array_to_string(hyp_tokens, ' ') AS text FROM mrows),
w AS (SELECT text, regexp_extract_all(text, {S.lit(WORD_RUN_PATTERN)}) AS words FROM h),
cnt AS (
  SELECT CASE WHEN length({S.strip('text')}) = 0 THEN 0
              ELSE greatest(1, len(regexp_extract_all(text, {S.lit(SENTENCE_END_PATTERN)}))) END AS n_sent,
         len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: greatest(1, len(regexp_extract_all(lower(x), {S.lit(SYLLABLE_PATTERN)}))))), 0) AS n_syl
  FROM w
), s AS (SELECT sum(n_sent)::BIGINT AS n_sentences, sum(n_words)::BIGINT AS n_words, sum(n_syl)::BIGINT AS n_syllables FROM cnt)
SELECT n_sentences, n_words, n_syllables,
       round(0.39 * (n_words::DOUBLE / n_sentences::DOUBLE) + 11.8 * (n_syllables::DOUBLE / n_words::DOUBLE) - 15.59, 6) AS fkgl
FROM s
""")

oracle("embed_match", f"""
WITH v AS (SELECT vec_id // 200 AS part, label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (
  SELECT c.part, c.label AS cand, r.label AS ref, c.vec_id AS cid, r.vec_id AS rid,
         coalesce(list_cosine_similarity(c.e, r.e), 0.0) AS s
  FROM v c JOIN v r ON r.label = c.label + 1 AND r.part = c.part
), pr AS (SELECT part, cand, ref, avg(ms) AS precision FROM (SELECT part, cand, ref, cid, max(s) AS ms FROM sims GROUP BY ALL) GROUP BY ALL),
rc AS (SELECT part, cand, ref, avg(ms) AS recall FROM (SELECT part, cand, ref, rid, max(s) AS ms FROM sims GROUP BY ALL) GROUP BY ALL)
SELECT part::BIGINT AS part, cand::BIGINT AS cand, ref::BIGINT AS ref, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round({_f1('precision', 'recall')}, 6) AS f1
FROM pr JOIN rc USING (part, cand, ref)
""")

_TOKEN = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(4))


def _match_sql(name: str, pairs: str) -> str:
    """Weighted greedy match of ``pairs(cp, cl, rp, rl)`` as ``name(cp, cl, rp, rl, precision, recall, f1)``."""
    return f"""{name}_s AS (
  SELECT cp, cl, rp, rl, c.vec_id AS cid, r.vec_id AS rid, c.w AS cw, r.w AS rw, coalesce(list_cosine_similarity(c.e, r.e), 0.0) AS s
  FROM {pairs} JOIN v c ON c.part = cp AND c.label = cl JOIN v r ON r.part = rp AND r.label = rl
), {name}_p AS (SELECT cp, cl, rp, rl, coalesce(sum(m * w) / nullif(sum(w), 0), 0) AS precision
                FROM (SELECT cp, cl, rp, rl, cid, max(s) AS m, any_value(cw) AS w FROM {name}_s GROUP BY ALL) GROUP BY ALL),
{name}_r AS (SELECT cp, cl, rp, rl, coalesce(sum(m * w) / nullif(sum(w), 0), 0) AS recall
             FROM (SELECT cp, cl, rp, rl, rid, max(s) AS m, any_value(rw) AS w FROM {name}_s GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT *, {_f1('precision', 'recall')} AS f1 FROM {name}_p JOIN {name}_r USING (cp, cl, rp, rl))"""


oracle("embed_match_rescaled", f"""
WITH v0 AS (SELECT vec_id // 200 AS part, label, vec_id, CAST(embedding AS DOUBLE[]) AS e, {_TOKEN} AS token FROM embeddings),
sents AS (SELECT DISTINCT part, label FROM v0),
idf AS (SELECT token, ln(((SELECT count(*) FROM sents) + 1.0) / (count(*) + 1.0)) AS w
        FROM (SELECT DISTINCT part, label, token FROM v0) GROUP BY token),
v AS (SELECT v0.*, w FROM v0 JOIN idf USING (token)),
ranked AS (SELECT part, label, row_number() OVER (ORDER BY (part * 7919 + label::BIGINT * 104729) % 1000003, part, label) - 1 AS i FROM sents),
apart AS (SELECT a.part AS cp, a.label AS cl, b.part AS rp, b.label AS rl FROM ranked a JOIN ranked b ON b.i = (a.i + 1) % (SELECT count(*) FROM ranked)),
wanted AS (SELECT part AS cp, label AS cl, part AS rp, label + 1 AS rl FROM sents),
{_match_sql('far', 'apart')}, {_match_sql('near', 'wanted')},
base AS (SELECT avg(precision) AS bp, avg(recall) AS br, avg(f1) AS bf FROM far)
SELECT cp::BIGINT AS part, cl::BIGINT AS cand, rl::BIGINT AS ref, round((precision - bp) / (1.0 - bp), 6) AS precision,
       round((recall - br) / (1.0 - br), 6) AS recall, round((f1 - bf) / (1.0 - bf), 6) AS f1
FROM near, base
""")

# ---------------------------------------------------------------------------
# Audits
# ---------------------------------------------------------------------------

oracle("bad_split_counts", f"""
WITH {S.doc_lines_cte()},
fl AS (SELECT file, {S.strip('line')} AS s FROM doc_lines),
per AS (SELECT file, count(*) FILTER (WHERE starts_with(s, 'B.')) + count(*) FILTER (WHERE ends_with(s, 'z.')) AS zb,
               count(*) FILTER (WHERE ends_with(s, 'ca.')) AS ca FROM fl GROUP BY file),
ex AS (SELECT DISTINCT source AS file FROM documents UNION SELECT 'part' || CAST(p_partkey AS VARCHAR) FROM part),
filled AS (SELECT file, coalesce(per.zb, 0) AS zb, coalesce(per.ca, 0) AS ca FROM ex FULL OUTER JOIN per USING (file))
SELECT file, GROUPING(file)::INTEGER AS is_total, sum(zb)::BIGINT AS zb, sum(ca)::BIGINT AS ca FROM filled GROUP BY ROLLUP (file)
""")

_VOCABULARY = S.vocabulary_file()

_ROUNDTRIP = _VOCABULARY and f"""raw_pairs AS (
  SELECT c.conv_id * 16777216 + c.turn AS pair_id,
         CASE WHEN c.conv_id % 10 = 0 THEN 'test' WHEN c.conv_id % 10 = 1 THEN 'valid' ELSE 'train' END AS file,
         c.text AS source, n.text AS target
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
), both_sides AS (
  SELECT pair_id, file, 'source' AS side, {S.strip('source')} AS txt FROM raw_pairs
  UNION ALL SELECT pair_id, file, 'target', {S.strip('target')} FROM raw_pairs
), {S.segments_cte(_VOCABULARY, 'both_sides')}, {S.encoded_texts_cte('both_sides', 'pair_id, side')},
rt AS (
  SELECT s.pair_id, s.file, s.side, s.txt AS original, c.decoded AS decoded_original,
         ltrim(replace(replace(c.spaced, ' ', ''), {PIECE}, ' ')) AS decoded
  FROM both_sides s JOIN coded c USING (pair_id, side)
), rt2 AS (
  SELECT *, string_split(decoded_original, ' ') = string_split(decoded, ' ') AS same_cleaned,
         string_split(original, ' ') = string_split(decoded, ' ') AS same_raw
  FROM rt
)"""

if _VOCABULARY:
    oracle("roundtrip_counts", f"""
    WITH RECURSIVE {_ROUNDTRIP}
    SELECT file, side, count(*) AS n_lines, count(*) FILTER (WHERE NOT same_raw) AS not_matching,
           count(*) FILTER (WHERE NOT same_cleaned) AS not_matching_cleaned
    FROM rt2 GROUP BY file, side
    """)

    oracle("roundtrip_diff", f"""
    WITH RECURSIVE {_ROUNDTRIP}
    SELECT file, side, pair_id, same_raw, same_cleaned, original, decoded FROM rt2 WHERE NOT same_raw OR NOT same_cleaned
    """)

    _SUBWORDS = f"{S.pairs_cte()}, {_SIDES}, {S.segments_cte(_VOCABULARY, 'sides')}, {S.encoded_texts_cte('sides', 'pair_id, side')}"

    oracle("subword_tokens", f"""
    WITH RECURSIVE {_SUBWORDS}
    SELECT pair_id, side, n AS n_pieces, spaced AS pieces, decoded FROM coded
    """)

    oracle("subword_vocabulary", f"""
    WITH RECURSIVE {_SUBWORDS},
    toks AS (SELECT CASE WHEN side = 0 THEN 'src' ELSE 'tgt' END AS side, unnest(string_split(spaced, ' ')) AS token FROM coded WHERE n > 0),
    c AS (SELECT side, token, count(*) AS cnt FROM toks GROUP BY side, token)
    SELECT side, token, cnt, row_number() OVER (PARTITION BY side ORDER BY cnt DESC, token) AS freq_rank FROM c
    """)

    oracle("subword_corpus", f"""
    WITH RECURSIVE {_SUBWORDS},
    toks AS (SELECT pair_id, side, unnest(string_split(spaced, ' ')) AS word FROM coded WHERE n > 0),
    ranks AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM toks WHERE side = 0 GROUP BY word),
    vocab AS (SELECT count(*) AS vocab FROM ranks),
    lr AS (SELECT pair_id, side, ln(coalesce(rank, vocab)::DOUBLE + 1.0) AS lr FROM toks LEFT JOIN ranks USING (word), vocab
           WHERE {S.admitted('word', "'en'")}),
    q AS (SELECT pair_id, quantile_cont(lr, 0.75) FILTER (WHERE side = 0) AS qs, quantile_cont(lr, 0.75) FILTER (WHERE side = 1) AS qt
          FROM lr GROUP BY pair_id),
    f AS (
      SELECT p.pair_id, coalesce(qt, ln(vocab::DOUBLE + 1.0)) / coalesce(qs, ln(vocab::DOUBLE + 1.0)) AS exact_frequency,
             CASE WHEN length(source) = 0 THEN NULL ELSE length(target)::DOUBLE / length(source)::DOUBLE END AS exact_length
      FROM pairs p LEFT JOIN q USING (pair_id), vocab
    ), b AS (SELECT *, {S.bin_value('exact_frequency', 'frequency')} AS bin_frequency, {S.bin_value('exact_length', 'length')} AS bin_length FROM f),
    pre AS (SELECT *, {S.token('frequency', 'bin_frequency')} || {S.token('length', 'bin_length')} AS prefix FROM b)
    SELECT pair_id, 'frequency_length' AS feature_set, round(exact_frequency, 6) AS exact_frequency, prefix,
           prefix || s.spaced AS source_line, t.spaced AS target_line
    FROM pre JOIN (SELECT pair_id, spaced FROM coded WHERE side = 0) s USING (pair_id) JOIN (SELECT pair_id, spaced FROM coded WHERE side = 1) t USING (pair_id)
    """)

oracle("hyp_group", f"""
WITH {_HYPS}
SELECT sample_id, count(*) AS n_hyps, string_agg(text, chr(9) ORDER BY log_no) AS texts FROM hyps GROUP BY sample_id
""")

oracle("missing_ids", """
WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT r.id AS sample_id FROM (SELECT unnest(generate_series(0, (SELECT max(id) FROM ids))) AS id) r
WHERE r.id NOT IN (SELECT id FROM ids)
""")

oracle("missing_intervals", """
WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
n AS (SELECT id, lag(id, 1, -1) OVER (ORDER BY id) AS before FROM ids)
SELECT before + 1 AS first_missing, id - 1 AS last_missing, id - 1 - before AS n_missing FROM n WHERE id > before + 1
""")

# ---------------------------------------------------------------------------
# Files written and read back
# ---------------------------------------------------------------------------

_FLAT = f"""{S.pairs_cte()},
flat AS (SELECT pair_id, lang, split, row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1 AS line_no,
                regexp_replace(source, '[\n\r]', ' ', 'g') AS source, regexp_replace(target, '[\n\r]', ' ', 'g') AS target FROM pairs)"""

oracle("read_corpus", f"""
WITH {_FLAT}
SELECT split, split || '_' || CAST(line_no % 2 AS VARCHAR) AS stem, line_no // 2 AS line_no, {S.strip('source')} AS source,
       {S.strip('target')} AS target FROM flat
""")

oracle("shard_files", f"""
WITH {_FLAT}
SELECT split, line_no // 25 AS shard, line_no % 25 AS line_no, {S.strip('source')} AS source, {S.strip('target')} AS target FROM flat
""")

oracle("shard_merge_files", f"""
WITH {_FLAT}
SELECT row_number() OVER (ORDER BY line_no // 25 DESC, line_no) - 1 AS merged_line_no, line_no // 25 AS shard, source AS line
FROM flat WHERE split = 'train' AND source <> ''
""")

oracle("pair_tsv_file", f"""
WITH {_FLAT}
SELECT row_number() OVER (ORDER BY len(string_split(source, ' ')), pair_id) - 1 AS line_no, source || chr(9) || target AS tsv FROM flat
""")

_LENGTH_LEVEN = f"""
WITH RECURSIVE {_FLAT}, {S.lcs_cte('flat')},
f AS (SELECT *, CASE WHEN length(source) = 0 THEN NULL ELSE length(target)::DOUBLE / length(source)::DOUBLE END AS exact_length,
             lev AS exact_levenshtein FROM flat JOIN lev USING (pair_id)),
b AS (SELECT *, {S.bin_value('exact_length', 'length')} AS bin_length, {S.bin_value('exact_levenshtein', 'levenshtein')} AS bin_levenshtein FROM f)
SELECT lang, 'length_levenshtein' AS feature_set, split, line_no,
       coalesce({S.token('length', 'bin_length')}, '') || coalesce({S.token('levenshtein', 'bin_levenshtein')}, '') || {S.tokenized('source')} AS source_line,
       {S.tokenized('target')} AS target_line
FROM b
"""
oracle("control_corpus_files", _LENGTH_LEVEN)
oracle("control_corpus_resumed", _LENGTH_LEVEN)

oracle("rank_saved", f"""
WITH {S.ranks_cte()}
SELECT lang, word, rank FROM ranks
""")

# ---------------------------------------------------------------------------
# Experiments
# ---------------------------------------------------------------------------

_METRICS = """metrics AS (
  SELECT CAST(p_partkey AS VARCHAR) AS exp_id, p_retailprice / 100.0 AS bleu, p_size + p_retailprice / 1000.0 AS sari,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / 7.0 END AS fkgl,
         (p_partkey % 97) / 100.0 AS bertscore_precision, (p_partkey % 89) / 100.0 AS bertscore_recall,
         (p_partkey % 83) / 100.0 AS bertscore_f1
  FROM part
)"""

oracle("metric_parse", f"""
WITH {_METRICS}
SELECT exp_id, bleu, sari, fkgl, bertscore_precision, bertscore_recall, bertscore_f1 FROM metrics
""")


def _abbr() -> str:
    parts = [f"CASE WHEN (bits >> {i}) & 1 = 1 THEN '{short}' END" for i, (_, short) in enumerate(FEATURE_ABBR)]
    return f"CASE WHEN bits = 15 THEN 'all' ELSE concat_ws('_', {', '.join(parts)}) END"


oracle("experiment_overview", f"""
WITH {_METRICS},
cfg AS (
  SELECT CAST(p_partkey AS VARCHAR) AS exp_id, p_size, p_partkey, p_retailprice, (p_partkey % 15) + 1 AS bits
  FROM part WHERE p_size <= 25
)
SELECT c.exp_id AS id, CASE WHEN c.p_size % 2 = 0 THEN 'en' ELSE 'de' END AS language,
       {_abbr()} AS features,
       c.p_size::BIGINT AS batch_size,
       (c.p_size * CASE WHEN c.p_partkey % 4 = 0 THEN 1 ELSE c.p_partkey % 4 + 1 END)::BIGINT AS effective_batch_size,
       (c.p_size * 2)::BIGINT AS test_batch_size, (c.p_size + 10)::BIGINT AS max_epochs,
       (c.p_partkey % 8 + 1)::BIGINT AS beam_size, c.p_retailprice / 1.0e7 AS lr,
       m.bleu, m.sari, m.fkgl, m.bertscore_precision, m.bertscore_recall, m.bertscore_f1
FROM cfg c JOIN metrics m USING (exp_id)
""")

oracle("overview_csv", ORACLE["experiment_overview"])
