"""DuckDB SQL that answers the registered queries in another way."""

from __future__ import annotations

from millrace.functions.text import WHITESPACE_CODES
from millrace.operators.windows import SAMPLE_SETS
from millrace.plans import catalog as c

STRIP = " || ".join(f"chr({code})" for code in WHITESPACE_CODES)


def strip(text: str) -> str:
    return f"trim({text}, {STRIP})"


# Unicode White_Space as a character class; RE2 has no look-ahead, so the last space of a
# run is marked with chr(1) before the text is split.
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPLIT = (
    r"''s|''t|''re|''ve|''m|''ll|''d|\x01? ?\p{L}+|\x01? ?\p{N}+|\x01? ?[^"
    + SPACE + r"\p{L}\p{N}\x01]+|\x01?[" + SPACE + "]+"
)


def words(text: str) -> str:
    marked = f"regexp_replace({text}, '([{SPACE}])([^{SPACE}])', chr(1) || '\\1\\2', 'g')"
    return f"list_transform(regexp_extract_all({marked}, '{SPLIT}'), lambda w: replace(w, chr(1), ''))"


BYTE_ID = (
    "CASE WHEN b BETWEEN 33 AND 126 THEN b - 32 WHEN b BETWEEN 161 AND 172 THEN b - 66"
    " WHEN b BETWEEN 174 AND 255 THEN b - 67 WHEN b <= 32 THEN b + 189"
    " WHEN b BETWEEN 127 AND 160 THEN b + 95 ELSE 256 END"
)
IDS = "list_transform(regexp_extract_all(seq, '[0-9]+'), lambda x: x::BIGINT)"

DOC_WORDS = f"""
dw AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, {words('text')} AS ws FROM documents)),
counted AS (SELECT word, count(*) AS cnt FROM dw GROUP BY word)"""

CONVERSATIONS = f"""
kept AS (
  SELECT conv_id, turn, role, {strip('text')} AS content FROM conversations
  WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id
                    HAVING bool_or(role = 'assistant') AND bool_and({strip('text')} <> '')))"""

CHAT_WORDS = f"""
{CONVERSATIONS},
segments AS (
  SELECT conv_id, turn, role, 0 AS part, '<|im_start|>' || role || chr(10) AS text FROM kept
  UNION ALL SELECT conv_id, turn, role, 1, content FROM kept
  UNION ALL SELECT conv_id, turn, role, 2, '<|im_end|>' || chr(10) FROM kept),
cw AS MATERIALIZED (
  SELECT conv_id, turn, role, part, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT *, {words('text')} AS ws FROM segments))"""


def training(extra: str = "", rounds: int = c.MERGES) -> str:
    """CTEs dw, counted, w0..wN (word, cnt, seq) and merges; ``extra`` words are merged, not counted."""
    source = "counted" if not extra else (
        f"(SELECT * FROM counted UNION ALL SELECT DISTINCT word, 0 FROM {extra} WHERE word NOT IN (SELECT word FROM counted))"
    )
    steps = [f"""
w0 AS MATERIALIZED (
  SELECT word, cnt, '<' || array_to_string(list_transform(list_transform(regexp_extract_all(hex(encode(word)), '..'),
    lambda h: ('0x' || h)::INT), lambda b: {BYTE_ID}), '><') || '>' AS seq FROM {source})"""]
    for k in range(rounds):
        steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT ids[i] AS l, ids[i + 1] AS r, sum(cnt)::BIGINT AS cnt
  FROM (SELECT cnt, ids, unnest(range(1, len(ids))) AS i FROM (SELECT cnt, {IDS} AS ids FROM w{k}))
  GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 1),
w{k + 1} AS MATERIALIZED (
  SELECT word, w.cnt, replace(seq, '<' || l || '><' || r || '>', '<{257 + k}>') AS seq FROM w{k} w, m{k})""")
    steps.append("merges AS (" + " UNION ALL ".join(f"SELECT {k} AS rank, l, r, {257 + k} AS new_id, cnt FROM m{k}" for k in range(rounds)) + ")")
    steps.append(f"coded AS MATERIALIZED (SELECT word, {IDS} AS ids FROM w{rounds})")
    return ",".join(steps)


BPE = f"WITH RECURSIVE {DOC_WORDS},{training()}"
BPE_CHAT = f"WITH RECURSIVE {DOC_WORDS},{CHAT_WORDS},{training('cw')}"

DOC_TOKENS = """
lens AS MATERIALIZED (SELECT doc_id, sum(len(ids))::BIGINT AS n FROM dw JOIN coded USING (word) GROUP BY doc_id)"""


def sharding(rows: str, limit: int) -> str:
    """CTEs numbered (src, id, n, i, cum) and shards (src, shard_id, base, i0, stop) from (src, id, n)."""
    return f"""
numbered AS MATERIALIZED (
  SELECT src, id, n, row_number() OVER o AS i, sum(n) OVER o AS cum FROM ({rows})
  WINDOW o AS (PARTITION BY src ORDER BY id)),
starts(src, k, i0, base) AS (
  SELECT src, 0, i, cum - n FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.src, s.k + 1, x.i, x.cum - x.n FROM starts s JOIN numbered x ON x.src = s.src
  WHERE x.i > s.i0 AND x.cum - s.base > {limit} AND (x.cum - x.n - s.base <= {limit} OR x.i = s.i0 + 1)),
shards AS MATERIALIZED (
  SELECT src, k AS shard_id, base, i0, lead(i0) OVER (PARTITION BY src ORDER BY k) AS stop FROM starts),
placed AS MATERIALIZED (
  SELECT n.src, n.id, n.n, s.shard_id::BIGINT AS shard_id, (n.cum - n.n - s.base)::BIGINT AS tok_start, (n.cum - s.base)::BIGINT AS tok_end
  FROM numbered n JOIN shards s ON s.src = n.src AND n.i >= s.i0 AND (s.stop IS NULL OR n.i < s.stop)),
manifest AS MATERIALIZED (
  SELECT src, shard_id, min(id) AS first_doc, count(*) AS num_docs, sum(n)::BIGINT AS num_tokens FROM placed GROUP BY src, shard_id)"""


DOC_SHARDS = sharding("SELECT 'all' AS src, doc_id AS id, n FROM lens", c.SHARD_TOKENS)
LANG_SHARDS = sharding("SELECT lang AS src, doc_id AS id, n FROM lens JOIN documents USING (doc_id)", c.SHARD_TOKENS)

DOC_STREAM = """
stream AS MATERIALIZED (
  SELECT src, shard_id, tok_start + row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) - 1 AS spot, id
  FROM (SELECT doc_id, pos, generate_subscripts(ids, 1) AS j, unnest(ids) AS id FROM dw JOIN coded USING (word))
  JOIN (SELECT src, id AS doc_id, shard_id, tok_start FROM placed) USING (doc_id))"""

CHAT_STREAM = """
ct AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part, pos, j) - 1 AS spot, id,
    CASE WHEN role = 'assistant' AND part > 0 THEN id ELSE -100 END AS label
  FROM (SELECT conv_id, turn, role, part, pos, generate_subscripts(ids, 1) AS j, unnest(ids) AS id FROM cw JOIN coded USING (word)))"""
CHAT_SHARDS = CHAT_STREAM + "," + sharding("SELECT 'chat' AS src, conv_id AS id, count(*) AS n FROM ct GROUP BY conv_id", c.CHAT_SHARD_TOKENS)

BLOCKS = f"""
SELECT shard_id, spot // {c.BLOCK} AS block_id, string_agg(id, ' ' ORDER BY spot) AS ids FROM stream GROUP BY ALL"""


def uniform(*parts: str) -> str:
    return f"(('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:13])::BIGINT / 4503599627370496.0::DOUBLE)"


def draws(sources: list[tuple[str, float]], seq_len: int, seed: int = c.SEED, n: str | None = None) -> str:
    total, edges = 0.0, []
    for name, weight in sources:
        total += weight
        edges.append((name, total))
    pick = " ".join(f"WHEN u * {total!r}::DOUBLE < {edge!r}::DOUBLE THEN '{name}'" for name, edge in edges[:-1])
    pick = f"CASE {pick} ELSE '{edges[-1][0]}' END" if pick else f"'{edges[-1][0]}'"
    return f"""
drawn AS MATERIALIZED (
  SELECT worker, draw, seed, {pick} AS source FROM (
    SELECT worker, draw, {seed} + worker AS seed, {uniform(f'{seed} + worker', "'source'", 'draw')} AS u
    FROM (SELECT unnest(range(0, {c.WORKERS})) AS worker),
         (SELECT unnest(range(0, {n or f'sum(num_tokens)::BIGINT // {seq_len * c.WORKERS}'})) AS draw FROM manifest)))"""


def starts(seq_len: int, attempts: int) -> str:
    return f"""
spans AS MATERIALIZED (
  SELECT src AS source, shard_id, num_tokens, hi - num_tokens AS lo, hi, total FROM (
    SELECT *, sum(num_tokens) OVER (PARTITION BY src ORDER BY shard_id) AS hi, sum(num_tokens) OVER (PARTITION BY src) AS total
    FROM manifest WHERE num_tokens > {seq_len + 1})),
sized AS (SELECT DISTINCT source, total::BIGINT AS total FROM spans),
aimed AS MATERIALIZED (
  SELECT worker, draw, seed, attempt, source,
    least(floor({uniform('seed', "'shard'", 'draw', 'attempt')} * total)::BIGINT, total - 1) AS token
  FROM drawn JOIN sized USING (source), (SELECT unnest(range(0, {attempts})) AS attempt)),
planned AS MATERIALIZED (
  SELECT worker, draw, attempt, a.source, shard_id,
    least(floor({uniform('seed', "'start'", 'draw', 'attempt')} * (num_tokens - {seq_len + 1}))::BIGINT, num_tokens - {seq_len + 2}) AS start
  FROM aimed a JOIN spans s ON a.source = s.source AND token >= lo AND token < hi)"""


LANG_DRAWS = f"{BPE},{DOC_TOKENS},{LANG_SHARDS},{draws(c.MIXTURE, c.SEQ_LEN)}"

JSON_SHAPES = f"""
t AS (SELECT conv_id, turn, role, {strip('text')} AS content, text,
  array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> ''), chr(10)) AS parts
  FROM conversations),
g AS (
  SELECT conv_id, conv_id % 6 AS shape, bool_or(role = 'assistant') AS answered,
    bool_and(content <> '') AS whole,
    string_agg('<|im_start|>' || role || chr(10) || CASE WHEN conv_id % 6 = 2 THEN parts ELSE content END || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chatml,
    arg_min(content, turn) FILTER (role = 'user') AS u, arg_min(content, turn) FILTER (role = 'assistant') AS a,
    arg_min(content, turn) FILTER (role = 'system') AS s
  FROM t GROUP BY conv_id),
chatml AS (
  SELECT conv_id,
    CASE WHEN shape < 4 THEN CASE WHEN answered AND whole THEN chatml END
         WHEN u <> '' AND a <> '' THEN '<|im_start|>user' || chr(10) || u
           || CASE WHEN shape = 4 AND s <> '' THEN chr(10) || chr(10) || s ELSE '' END || '<|im_end|>' || chr(10)
           || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10) END AS text,
    CASE WHEN shape = 1 THEN 'chat' END AS dataset,
    CASE WHEN shape = 2 THEN 'web' END AS source,
    CASE WHEN shape = 0 THEN conv_id::VARCHAR END AS prompt_id,
    CASE WHEN shape = 5 THEN 'qa' END AS category
  FROM g)"""

SPECS = ", ".join(f"({i}, '{name}', '{kind}', {weight})" for i, (name, kind, weight) in enumerate(c.CORPORA))
TOTAL_WEIGHT = sum(weight for *_, weight in c.CORPORA)
LANG_NAMES = [name for name, _ in c.MIXTURE]

TOP_UP = """
ranked AS (
  SELECT doc_id, lang AS dataset, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, (SELECT count(*) FROM documents) AS total
  FROM documents),
topped AS (SELECT doc_id, dataset, k > total // 8 AS added, total // 4 AS target FROM ranked WHERE k <= total // 4)"""


def oracle_sql() -> dict[str, str]:
    lang_windows = f"{LANG_DRAWS},{starts(c.SEQ_LEN, 1)},{DOC_STREAM}"
    whole_steps = f"sum(num_tokens)::BIGINT // {c.SEQ_LEN * c.WORKERS} // {c.BATCH * c.ACCUMULATE} * {c.BATCH * c.ACCUMULATE}"
    eval_draws = draws(c.MIXTURE, c.SEQ_LEN, c.SEED + SAMPLE_SETS["train_eval"], whole_steps)
    eval_windows = f"{BPE},{DOC_TOKENS},{LANG_SHARDS},{eval_draws},{starts(c.SEQ_LEN, 1)},{DOC_STREAM}"
    halves = f"sum(num_tokens)::BIGINT // {c.SEQ_LEN * c.WORKERS} // 2 * 2"
    chat = f"{BPE_CHAT},{CHAT_SHARDS}"
    known = {
        "doc_filter": f"SELECT doc_id, lang, length(text)::BIGINT AS chars FROM documents WHERE {strip('text')} <> ''",
        "train_filter": "SELECT page_id, length(html)::BIGINT AS chars FROM pages WHERE html <> ''",
        "parquet_positions": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id FROM documents WHERE {strip('text')} <> ''",
        "pretok_word_counts": f"WITH {DOC_WORDS} SELECT word, cnt FROM counted",
        "pretok_doc_counts": f"SELECT doc_id, len({words('text')})::BIGINT AS n_words FROM documents",
        "bpe_pair_counts": f"""WITH {DOC_WORDS},{training(rounds=1)}
            SELECT ids[i] AS l, ids[i + 1] AS r, sum(cnt)::BIGINT AS cnt
            FROM (SELECT cnt, ids, unnest(range(1, len(ids))) AS i FROM (SELECT cnt, {IDS} AS ids FROM w0)) GROUP BY ALL""",
        "bpe_train": f"{BPE} SELECT rank::BIGINT AS rank, l, r, new_id::BIGINT AS new_id, cnt FROM merges",
        "bpe_vocab": f"""{BPE},
            tokens(k, spelled) AS (
              SELECT 0, list_concat(['<unk>'], list_transform(
                list_concat(range(33, 127), range(161, 173), range(174, 256), range(256, 324)), lambda p: chr(p::INT)))
              UNION ALL SELECT k + 1, list_append(spelled, spelled[l + 1] || spelled[r + 1]) FROM tokens JOIN merges ON rank = k)
            SELECT (i - 1)::BIGINT AS id, token FROM (
              SELECT generate_subscripts(spelled, 1) AS i, unnest(spelled) AS token FROM tokens WHERE k = {c.MERGES})""",
        "bpe_encode": f"""{BPE} SELECT doc_id, string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos) AS ids
            FROM dw JOIN coded USING (word) GROUP BY doc_id""",
        "bpe_encode_counts": f"{BPE},{DOC_TOKENS} SELECT doc_id, n AS n_tokens FROM lens",
        "stream_encode": f"{BPE},{DOC_TOKENS} SELECT doc_id, n AS n_tokens FROM lens",
        "bpe_decode": "SELECT doc_id, text FROM documents",
        "char_vocabulary": """SELECT ch, row_number() OVER (ORDER BY unicode(ch)) - 1 AS id
            FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''""",
        "char_encode": """WITH c AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS ch
              FROM (SELECT doc_id, string_split(text, '') AS s FROM documents)),
            v AS (SELECT ch, row_number() OVER (ORDER BY unicode(ch)) - 1 AS id FROM (SELECT DISTINCT ch FROM c WHERE ch <> ''))
            SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM c JOIN v USING (ch) GROUP BY doc_id""",
        "char_decode": "SELECT doc_id, text FROM documents",
        **{
            name: f"{BPE},{DOC_TOKENS},{DOC_SHARDS} SELECT shard_id, first_doc, num_docs, num_tokens FROM manifest"
            for name in ("shard_manifest", "shard_manifest_small")
        },
        "doc_offsets": f"{BPE},{DOC_TOKENS},{DOC_SHARDS} SELECT id AS doc_id, shard_id, tok_start, tok_end FROM placed",
        "shard_of_document": f"{BPE},{DOC_TOKENS},{DOC_SHARDS} SELECT id AS doc_id, shard_id FROM placed",
        "dataset_totals": f"""{BPE},{DOC_TOKENS},{DOC_SHARDS} SELECT count(*) AS num_shards, sum(num_docs)::BIGINT AS num_docs,
            sum(num_tokens)::BIGINT AS num_tokens, 'uint16' AS dtype FROM manifest""",
        "first_documents": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT (SELECT count(*) // 3 FROM documents)",
        "corpus_blocks": f"{BPE},{DOC_TOKENS},{DOC_SHARDS},{DOC_STREAM} {BLOCKS}",
        "binary_shards": f"{BPE},{DOC_TOKENS},{DOC_SHARDS},{DOC_STREAM} {BLOCKS}",
        "chat_convert": f"WITH {JSON_SHAPES} SELECT * FROM chatml WHERE text IS NOT NULL",
        "chat_totals": f"""WITH {JSON_SHAPES} SELECT count(*) AS rows_seen, count(text) AS rows_written,
            count(*) - count(text) AS rows_skipped FROM chatml""",
        "chat_limited": f"""WITH {JSON_SHAPES},
            n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS k FROM chatml WHERE text IS NOT NULL),
            edge AS (SELECT max(conv_id) AS e FROM n WHERE k <= greatest(1, (SELECT count(*) // 2 FROM n)))
            SELECT count(*) AS rows_seen, count(text) AS rows_written, count(*) - count(text) AS rows_skipped
            FROM chatml, edge WHERE conv_id <= e""",
        "chatml_render": f"""WITH {CONVERSATIONS} SELECT conv_id,
            string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
            FROM kept GROUP BY conv_id""",
        "role_map": "SELECT conv_id, turn, role FROM conversations",
        "content_parts": f"""SELECT conv_id, turn, nullif(array_to_string(list_filter(list_transform(
            regexp_split_to_array(text, '[,.]'), lambda s: {strip('s')}), lambda s: s <> ''), chr(10)), '') AS content FROM conversations""",
        "prompt_response": f"""SELECT conv_id, turn, CASE WHEN {strip('text')} <> '' THEN {strip('text')} || chr(10) || chr(10) || 'more' END AS prompt,
            CASE WHEN {strip('text')} <> '' THEN role END AS response FROM conversations""",
        "sft_labels": f"""{chat} SELECT conv_id, string_agg(id, ' ' ORDER BY spot) AS ids,
            string_agg(label, ' ' ORDER BY spot) AS labels FROM ct GROUP BY conv_id""",
        "sft_totals": f"""{chat} SELECT shard_id, count(DISTINCT conv_id) AS num_docs, count(*) AS num_tokens,
            count(*) FILTER (label <> -100) AS supervised_tokens FROM ct JOIN placed ON placed.id = conv_id GROUP BY shard_id""",
        "corpus_take": f"""WITH specs(src_ord, source, kind, weight) AS (VALUES {SPECS}),
            quota AS (SELECT *, CASE WHEN kind = 'local' THEN 1
              ELSE greatest(1, round_even((SELECT count(*) // 2 FROM documents) * weight::DOUBLE / {TOTAL_WEIGHT}, 0)) END AS n FROM specs),
            placed AS (SELECT src_ord, source, doc_id, n,
              CASE WHEN kind = 'parquet' THEN md5(concat_ws(':', {c.SEED} + src_ord, doc_id)) ELSE '' END AS place
              FROM documents JOIN quota USING (source) WHERE text <> '')
            SELECT src_ord::BIGINT AS src_ord, source, doc_id, place FROM placed
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY place, doc_id) <= n""",
        "mixture_draws": f"{LANG_DRAWS} SELECT worker, draw, source FROM drawn",
        "mixture_stream": f"""{BPE},{DOC_TOKENS},{LANG_SHARDS},{draws(c.MIXTURE, c.SEQ_LEN, n=halves)} SELECT worker, draw, source FROM drawn""",
        "window_starts": f"{LANG_DRAWS},{starts(c.SEQ_LEN, 1)} SELECT worker, draw, source, shard_id, start FROM planned",
        "windows_pretrain": f"""{lang_windows}
            SELECT worker, draw, source, p.shard_id, start,
              string_agg(s.id, ' ' ORDER BY s.spot) FILTER (s.spot < start + {c.SEQ_LEN}) AS x,
              string_agg(s.id, ' ' ORDER BY s.spot) FILTER (s.spot > start) AS y
            FROM (SELECT *, unnest(range(start, start + {c.SEQ_LEN + 1})) AS spot FROM planned) p
            JOIN stream s ON s.src = p.source AND s.shard_id = p.shard_id AND s.spot = p.spot GROUP BY ALL""",
        "eval_windows": f"""{eval_windows}
            SELECT worker, draw, source, p.shard_id, start, draw // {c.BATCH * c.ACCUMULATE} AS step, draw // {c.BATCH} AS batch_id,
              string_agg(s.id, ' ' ORDER BY s.spot) FILTER (s.spot < start + {c.SEQ_LEN}) AS x,
              string_agg(s.id, ' ' ORDER BY s.spot) FILTER (s.spot > start) AS y
            FROM (SELECT *, unnest(range(start, start + {c.SEQ_LEN + 1})) AS spot FROM planned) p
            JOIN stream s ON s.src = p.source AND s.shard_id = p.shard_id AND s.spot = p.spot GROUP BY ALL""",
        "text_files": """SELECT row_number() OVER (ORDER BY 'source=' || source) - 1 AS file_no,
              string_agg(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10), '' ORDER BY doc_id) AS text
            FROM documents GROUP BY source""",
        "table_rows": "SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0",
        "blank_lines": "SELECT doc_id, text FROM documents",
        "counts_fraction": """SELECT source, ' ' || tenths // 10 || '.' || tenths % 10 || CASE WHEN tenths % 2 = 0 THEN 'k' ELSE 'M ' END AS label,
              trunc((tenths // 10 || '.' || tenths % 10)::DOUBLE * CASE WHEN tenths % 2 = 0 THEN 1000 ELSE 1000000 END)::BIGINT AS parsed, chars AS plain
            FROM (SELECT source, sum(n_chars)::BIGINT AS chars, sum(n_chars)::BIGINT // 100 AS tenths FROM documents GROUP BY source)""",
        "tokenizer_json": f"{BPE},{DOC_TOKENS} SELECT doc_id, n AS n_tokens FROM lens",
        "windows_sft": f"""{chat},{draws([('chat', 1.0)], c.CHAT_SEQ_LEN)},{starts(c.CHAT_SEQ_LEN, 100)},
            flow AS MATERIALIZED (
              SELECT shard_id, tok_start + spot AS spot, ct.id, label,
                sum((label <> -100)::INT) OVER (PARTITION BY shard_id ORDER BY tok_start + spot) AS seen
              FROM ct JOIN placed ON placed.id = conv_id),
            good AS (
              SELECT worker, draw, source, p.shard_id, attempt, start FROM planned p
              JOIN flow a ON a.shard_id = p.shard_id AND a.spot = start
              JOIN flow b ON b.shard_id = p.shard_id AND b.spot = start + {c.CHAT_SEQ_LEN}
              WHERE b.seen > a.seen QUALIFY row_number() OVER (PARTITION BY worker, draw ORDER BY attempt) = 1)
            SELECT worker, draw, source, g.shard_id, start, attempt,
              string_agg(f.id, ' ' ORDER BY f.spot) FILTER (f.spot < start + {c.CHAT_SEQ_LEN}) AS x,
              string_agg(f.label, ' ' ORDER BY f.spot) FILTER (f.spot > start) AS y
            FROM (SELECT *, unnest(range(start, start + {c.CHAT_SEQ_LEN + 1})) AS spot FROM good) g
            JOIN flow f ON f.shard_id = g.shard_id AND f.spot = g.spot GROUP BY ALL""",
        "window_batches": f"""{LANG_DRAWS} SELECT worker, draw // {c.BATCH * c.ACCUMULATE} AS step, draw // {c.BATCH} AS batch_id,
            count(*) AS windows, min(draw) AS first_draw FROM drawn GROUP BY ALL""",
        "step_tokens": f"""{LANG_DRAWS} SELECT worker, draw // {c.BATCH * c.ACCUMULATE} AS step, count(*) AS windows,
            (draw // {c.BATCH * c.ACCUMULATE} + 1) * {c.BATCH * c.SEQ_LEN * c.ACCUMULATE} AS tokens_seen FROM drawn GROUP BY ALL""",
        "source_report": f"""{BPE},{DOC_TOKENS},{LANG_SHARDS},
            specs(source, weight) AS (VALUES {', '.join(f"('{n}', {w}::DOUBLE)" for n, w in c.MIXTURE)})
            SELECT source, weight, count(*) AS num_shards, sum(num_tokens)::BIGINT AS num_tokens, sum(num_docs)::BIGINT AS num_docs
            FROM manifest JOIN specs ON source = src GROUP BY ALL""",
        "normalise_rows": "SELECT doc_id, text, 'sample' AS dataset, source FROM documents WHERE text <> ''",
        "resume_topup": f"WITH {TOP_UP} SELECT doc_id, dataset, added FROM topped",
        "mixed_rebuild": f"WITH {TOP_UP} " + " UNION ALL ".join(
            f"SELECT {i}::BIGINT AS src_ord, doc_id FROM topped WHERE dataset = '{n}'" for i, n in enumerate([*LANG_NAMES, LANG_NAMES[0]])
        ),
        "sample_totals": f"""WITH {TOP_UP},
            s AS (SELECT dataset AS name, count(*) AS rows, max(target) AS target FROM topped GROUP BY dataset
              UNION ALL SELECT 'mixed_pretrain', count(*), NULL FROM topped)
            SELECT 'chat' AS section, name, rows, target FROM s UNION ALL SELECT 'pretrain', name, rows, target FROM s""",
        "seed_choice": """WITH s AS (SELECT lang AS name, source AS path, count(*) AS rows FROM documents GROUP BY ALL)
            SELECT name, path, rows FROM s WHERE rows < (SELECT max(rows) FROM s)
            QUALIFY row_number() OVER (PARTITION BY name ORDER BY rows DESC, path) = 1""",
        "counts_format": """WITH s AS (SELECT source, sum(n_chars)::BIGINT AS chars, (sum(n_chars) - sum(n_chars) % 1000)::BIGINT AS r FROM documents GROUP BY source)
            SELECT source,
              CASE WHEN r >= 1000000 AND r % 1000000 = 0 THEN r // 1000000 || 'm' WHEN r >= 1000 THEN r // 1000 || 'k' ELSE r::VARCHAR END AS label,
              CASE WHEN chars >= 1000000 AND chars % 1000000 = 0 THEN chars // 1000000 || 'm'
                   WHEN chars >= 1000 AND chars % 1000 = 0 THEN chars // 1000 || 'k' ELSE chars::VARCHAR END AS plain,
              r AS parsed FROM s""",
        "jsonl_limited": """SELECT text FROM (SELECT doc_id, text FROM documents WHERE text <> '' ORDER BY doc_id
            LIMIT (SELECT count(*) // 3 FROM documents WHERE text <> ''))""",
        "parquet_resume": """SELECT doc_id, length(text) AS chars, true AS absent FROM documents ORDER BY doc_id
            OFFSET (SELECT count(*) // 3 FROM documents)""",
        "token_table": f"{BPE},{DOC_TOKENS},{DOC_SHARDS} SELECT id AS doc_id, shard_id, tok_start, tok_end - tok_start AS n_tokens FROM placed",
        "chatml_file": f"WITH {JSON_SHAPES} SELECT text FROM chatml WHERE text IS NOT NULL",
        "stream_chat": f"WITH {JSON_SHAPES} SELECT text FROM chatml WHERE text IS NOT NULL",
        "blank_rows": f"""SELECT doc_id, {strip('t')} <> '' AS not_blank, t <> '' AS not_empty, {strip('t')} AS stripped FROM (
            SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN b WHEN 2 THEN b || text ELSE text END AS t
            FROM documents, (SELECT ' ' || chr(9) || chr(10) || chr(12288) AS b))""",
        "jsonl_documents": "SELECT doc_id, text, 'sample' AS dataset FROM documents WHERE text <> ''",
    }
    return known | {"windows_ranges": known["windows_sft"]}
