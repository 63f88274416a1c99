"""SQL (DuckDB) for every registered query that SQL can express.

Written on their own, from the meaning of each operator and mostly by the direct
way: pairwise comparison for ROC-AUC, a filter per threshold for the grid.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# --- shared inputs, the same formulas as in `inputs` -----------------------------------

LABELLED = "labelled AS (SELECT d.*, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
PRED = (
    LABELLED
    + """, pred AS (
  SELECT doc_id, text, label AS true_label, ((doc_id * 37 + n_chars) % 101) / 100e0 AS ai_probability,
         source AS dataset_name
  FROM labelled)"""
)
DECIDED = PRED + """, dec AS (
  SELECT *, CASE WHEN ai_probability >= 0.5e0 THEN 1 ELSE 0 END AS predicted_label FROM pred)"""
NAMED = """named AS (
  SELECT *, concat('part_', CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'NEGATIVE' ELSE 'other' END,
                   '.parquet') AS file_name
  FROM documents)"""
HOLED = """holed AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE text END AS text
  FROM documents)"""
REPLIES = """replies AS (
  SELECT doc_id,
    CASE doc_id % 10 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Yes.' WHEN 3 THEN 'nothing'
      WHEN 4 THEN 'yesterday' WHEN 5 THEN 'maybe no or yes' WHEN 6 THEN 'i think yes'
      WHEN 7 THEN 'ERROR: no route' WHEN 8 THEN 'unsure' ELSE '' END AS response,
    CASE doc_id % 8 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'YES' WHEN 3 THEN ' true '
      WHEN 4 THEN 'False' WHEN 5 THEN '1.0' WHEN 6 THEN 'maybe' ELSE NULL END AS label
  FROM documents)"""
JUDGED = (
    REPLIES
    + """, judged AS (
  SELECT doc_id, response, lower(trim(response)) AS r,
    CASE WHEN label IS NULL OR lower(trim(label)) IN ('no', 'false', '0') THEN 'no'
         WHEN lower(trim(label)) IN ('yes', 'true', '1') THEN 'yes' ELSE lower(trim(label)) END AS expected
  FROM replies),
ans AS (
  SELECT *, CASE WHEN r[1:3] = 'yes' THEN 'yes' WHEN r[1:2] = 'no' THEN 'no'
      WHEN regexp_matches(r, '\\b(yes|no)\\b') THEN regexp_extract(r, '\\b(yes|no)\\b', 1)
      ELSE 'unknown' END AS extracted
  FROM judged),
checked AS (
  SELECT *, CASE WHEN extracted = 'unknown' THEN NULL ELSE extracted = expected END AS is_correct FROM ans)"""
)
WS = r"'[^ \t\n\r\f\v]+'"
TOK = f"toks AS (SELECT doc_id, source, text, regexp_extract_all(text, {WS}) AS tokens FROM documents)"
LEN = f"lens AS (SELECT doc_id, source, len(regexp_extract_all(text, {WS}))::INT AS token_length FROM documents)"
CHUNKS = (
    TOK
    + """, chunks AS (
  SELECT doc_id, chunk, list_slice(tokens, chunk * 448 + 1, chunk * 448 + 512) AS words,
         ((doc_id * 31 + chunk * 17) % 23) / 22e0 AS p
  FROM (SELECT doc_id, tokens, unnest(range(0, CASE WHEN len(tokens) <= 512 THEN 1
          ELSE CAST(floor((len(tokens) - 512 + 447) / 448) AS BIGINT) + 1 END)) AS chunk FROM toks))"""
)
WORDS = r"""words AS (
  SELECT DISTINCT doc_id, label, word
  FROM (SELECT doc_id, label, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM labelled)
  WHERE regexp_full_match(word, '[a-z]{3,}'))"""
RATIOS = (
    f"{LABELLED}, {WORDS}"
    + """, n AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM labelled),
df AS (SELECT word, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 0) AS c0 FROM words GROUP BY word),
ratios AS (
  SELECT word, (c1 / n1) / (c0 / n0) AS ratio, c1 / n1 AS doc_freq_ai, c0 / n0 AS doc_freq_nonai,
         c1 AS num_docs_ai, c0 AS num_docs_nonai
  FROM df, n WHERE c1 > 0 AND c0 > 0)"""
)
RUNS = """runs AS (
  SELECT *, chunk_size / (seconds_per_batch / batch_size) AS tps FROM (
    SELECT CASE WHEN event_id % 4 = 0 THEN 'baseline' ELSE 'batched' END AS engine,
      CASE event_id % 5 WHEN 0 THEN 2000 WHEN 1 THEN 4000 WHEN 2 THEN 8000 WHEN 3 THEN 16000 ELSE 32000 END AS chunk_size,
      CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 16 END AS batch_size,
      abs(value) + 1e0 AS seconds_per_batch
    FROM events))"""


def ranked(sizes: str, seed: int) -> str:
    """A direct split: rank each class by hash and cut; ``sizes`` gives the three cut ranks."""
    return f"""{LABELLED}, r AS (
  SELECT doc_id, label, text, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || doc_id), doc_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM labelled),
cuts AS (SELECT *, {sizes} FROM r),
split AS (SELECT doc_id, label, text, CASE WHEN rn <= c1 THEN 'train' WHEN rn <= c2 THEN 'val'
    WHEN rn <= c3 THEN 'test' ELSE 'remaining' END AS split FROM cuts)"""


SPLIT = ranked("160 AS c1, 180 AS c2, 200 AS c3", 42)
SPLIT_FRACTIONS = ranked(
    "floor(n * 0.8e0) AS c1, floor(n * 0.8e0) + floor(n * 0.1e0) AS c2, "
    "floor(n * 0.8e0) + 2 * floor(n * 0.1e0) AS c3",
    7,
)

METRICS = """
  round(coalesce((tn + tp) / nullif(tn + fp + fn + tp, 0), 0), 6) AS accuracy,
  round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS nonai_precision,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS nonai_recall,
  round(coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), 6) AS nonai_f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS ai_precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS ai_recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS ai_f1"""
CELLS = """count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn,
  count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp,
  count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn,
  count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp"""
CM = f"{DECIDED}, cm AS (SELECT dataset_name, {CELLS} FROM dec GROUP BY dataset_name)"
CM_ALL = f"{DECIDED}, cm AS (SELECT {CELLS} FROM dec)"
CONF = """round(coalesce(avg(conf) FILTER (predicted_label = true_label), 0), 6) AS mean_confidence_correct,
  round(coalesce(avg(conf) FILTER (predicted_label <> true_label), 0), 6) AS mean_confidence_incorrect,
  round(coalesce(avg(conf), 0), 6) AS mean_confidence_overall"""
CONF_VALUE = "CASE WHEN predicted_label = 1 THEN ai_probability ELSE 1 - ai_probability END AS conf"
GRID_ROWS = f"""{PRED}, t AS (SELECT unnest([0.1e0,0.2e0,0.3e0,0.4e0,0.5e0,0.6e0,0.7e0,0.8e0,0.9e0]) AS threshold),
dec AS (SELECT *, CASE WHEN ai_probability >= threshold THEN 1 ELSE 0 END AS predicted_label FROM pred CROSS JOIN t),
rows AS (SELECT *, {CONF_VALUE} FROM dec)"""


def grid(scope: str) -> str:
    keys = "threshold" if scope == "" else "dataset_name, threshold" if scope == "dataset" else "threshold"
    head = "threshold" if scope == "" else f"'{scope}' AS scope, " + (
        "dataset_name, threshold" if scope == "dataset" else "NULL AS dataset_name, threshold"
    )
    return f"""SELECT {head}, tn, fp, fn, tp, {METRICS},
      mean_confidence_correct, mean_confidence_incorrect, mean_confidence_overall
    FROM (SELECT {keys}, {CELLS}, {CONF} FROM rows GROUP BY {keys})"""


def curve(by: str) -> str:
    """Precision-recall points by comparing every score with every row."""
    group = f"{by}, " if by else ""
    match = f"AND a.{by} = b.{by}" if by else ""
    sel = f"a.{by} AS {by}, " if by else ""
    return f"""{PRED}, s AS (SELECT DISTINCT {group}ai_probability AS threshold FROM pred),
pts AS (
  SELECT {sel}a.threshold, count(*) FILTER (b.true_label = 1 AND b.ai_probability >= a.threshold) AS tp,
    count(*) FILTER (b.true_label = 0 AND b.ai_probability >= a.threshold) AS fp,
    count(*) FILTER (b.true_label = 1) AS np
  FROM s a JOIN pred b ON true {match} GROUP BY ALL),
points AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN np > 0 THEN tp / np END AS recall FROM pts)"""


def auc(scope: str) -> str:
    same = "AND a.dataset_name = b.dataset_name" if scope == "dataset" else ""
    key = "dataset_name" if scope == "dataset" else "'all'"
    return f"""SELECT '{scope}' AS scope, {"c.k" if scope == "dataset" else "NULL"} AS dataset_name, c.n_pos, c.n_neg,
      round(w.auc, 6) AS roc_auc
    FROM (SELECT {key} AS k, count(*) FILTER (true_label = 1) AS n_pos, count(*) FILTER (true_label = 0) AS n_neg
          FROM pred GROUP BY 1) c
    LEFT JOIN (SELECT {"a.dataset_name" if scope == "dataset" else "'all'"} AS k,
          avg(CASE WHEN a.ai_probability > b.ai_probability THEN 1e0
                   WHEN a.ai_probability = b.ai_probability THEN 0.5e0 ELSE 0e0 END) AS auc
        FROM pred a JOIN pred b ON a.true_label = 1 AND b.true_label = 0 {same} GROUP BY 1) w ON c.k = w.k"""


def put(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- sources and sinks -----------------------------------------------------------------

put("corpus_scan", "SELECT 'documents.parquet' AS file_name, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
put("csv_round_trip", f"WITH {LABELLED} SELECT doc_id, text, label FROM labelled")
put("file_dispatch", "SELECT doc_id, quality, toxic FROM labels")
put("labelled_lines", f"WITH {LABELLED} SELECT regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS text, label FROM labelled")
put("line_count", f"WITH {LABELLED} SELECT count(*) AS lines FROM labelled")
put("partitioned_parquet", f"WITH {SPLIT} SELECT doc_id, label, split FROM split")
STATS = """round(avg(ai_probability), 6) AS mean, min(ai_probability) AS min, max(ai_probability) AS max,
  round(stddev_samp(ai_probability), 6) AS std"""
put("json_report", f"""WITH {PRED}
SELECT 'm' AS model, 'dataset' AS scope, dataset_name, {STATS}, NULL::DOUBLE AS not_a_number FROM pred GROUP BY dataset_name
UNION ALL SELECT 'm', 'combined', NULL, {STATS}, NULL FROM pred""")
put("text_report", f"""WITH {CM} SELECT concat(repeat('=', 80), chr(10), 'Dataset: ', dataset_name, chr(10), repeat('=', 80),
  chr(10), '  tn: ', tn, chr(10), '  fp: ', fp, chr(10), '  fn: ', fn, chr(10), '  tp: ', tp, chr(10)) AS value FROM cm""")
put("unlabelled_source", "SELECT count(*) AS n, count(*) AS unlabelled FROM documents")
put("nan_to_null", """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN NULL ELSE doc_id::DOUBLE END AS x,
  CASE WHEN doc_id % 5 < 3 THEN NULL ELSE doc_id::DOUBLE END AS x0, doc_id::DOUBLE AS x1 FROM documents""")

# --- preparation -----------------------------------------------------------------------

put("label_from_name", f"""WITH {NAMED} SELECT doc_id, file_name, CASE WHEN contains(lower(file_name), 'positive') THEN 1
  WHEN contains(lower(file_name), 'negative') THEN 0 END AS label FROM named""")
put("label_rejects", f"WITH {NAMED} SELECT file_name, count(*) AS n FROM named WHERE doc_id % 3 = 2 GROUP BY file_name")
put("drop_columns", "SELECT page_id, length(html)::INT AS html FROM pages")
put("clean_text", f"WITH {HOLED} SELECT doc_id, text FROM holed WHERE text <> ''")
put("clean_counts", f"WITH {HOLED} SELECT count(*) AS rows_before, count(*) FILTER (text <> '') AS rows_after FROM holed")
put("token_length", f"WITH {LEN} SELECT doc_id, token_length FROM lens")
put("token_length_word", r"""SELECT doc_id,
  len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^ \t\n\r\f\v\p{L}\p{N}_]'))::INT AS token_length FROM documents""")
put("token_length_plug_in", f"WITH {LEN} SELECT doc_id, token_length FROM lens")
put("length_filter", f"WITH {LEN} SELECT doc_id, token_length FROM lens WHERE token_length <= 1000")
put("length_filter_stats", f"""WITH {LEN} SELECT count(*) AS rows_before, round(avg(token_length), 6) AS mean_before,
  max(token_length)::BIGINT AS max_before, count(*) FILTER (token_length <= 1000) AS rows_after,
  round(avg(token_length) FILTER (token_length <= 1000), 6) AS mean_after,
  (max(token_length) FILTER (token_length <= 1000))::BIGINT AS max_after,
  count(*) FILTER (token_length > 1000) AS rows_over_limit, count(*) FILTER (token_length > 1000) AS removed,
  round(100e0 * count(*) FILTER (token_length > 1000) / count(*), 6) AS removed_pct,
  round(quantile_cont(token_length::DOUBLE, 0.5), 6) AS median_before,
  round(quantile_cont(token_length::DOUBLE, 0.5) FILTER (token_length <= 1000), 6) AS median_after FROM lens""")
put("length_stats_by_source", f"""WITH {LEN} SELECT source, count(*) AS rows_before, round(avg(token_length), 6) AS mean_before,
  max(token_length)::BIGINT AS max_before, round(quantile_cont(token_length::DOUBLE, 0.5), 6) AS median_before FROM lens GROUP BY source""")
put("normalize_label", f"""WITH {REPLIES} SELECT doc_id,
  CASE WHEN lower(trim(label)) IN ('yes', 'true', '1') THEN 1 ELSE 0 END AS label_int,
  CASE WHEN label IS NULL OR lower(trim(label)) IN ('no', 'false', '0') THEN 'no'
       WHEN lower(trim(label)) IN ('yes', 'true', '1') THEN 'yes' ELSE lower(trim(label)) END AS label_str,
  CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS number_int,
  CASE WHEN doc_id % 3 = 1 THEN 'yes' ELSE 'no' END AS number_str FROM replies""")
put("text_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
put("flat_text", "SELECT doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS flat FROM documents")
TEMPLATE_HEAD = """'Does the following text include anything related to AI or LLMs?' || chr(10)
  || 'If so, output ''Yes''. Otherwise, output ''No''.' || chr(10) || chr(10) || '<text>' || chr(10)"""
TEMPLATE_TAIL = """chr(10) || '</text>' || chr(10) || chr(10)
  || 'Remember to only output a single token: ''Yes'' or ''No''.'"""
put("prompt_fill", f"SELECT doc_id, {TEMPLATE_HEAD} || text || {TEMPLATE_TAIL} || chr(10) AS prompt FROM documents")
put("instruction_prompt", f"""WITH {LABELLED}, p AS (SELECT doc_id, label, '<bos><start_of_turn>user' || chr(10) || {TEMPLATE_HEAD}
    || text || {TEMPLATE_TAIL} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt FROM labelled)
SELECT doc_id, prompt || CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END || '<end_of_turn>' || chr(10) AS training,
  prompt AS inference FROM p""")


def chat_sql(source: str) -> str:
    """Turns numbered after the system message; one row per conversation."""
    return f"""s AS (SELECT *, row_number() OVER w - 1 AS i, first_value(role) OVER w AS r0, first_value(text) OVER w AS t0
   FROM ({source}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, CASE WHEN r0 = 'system' THEN i - 1 ELSE i END AS k FROM s),
bodies AS (SELECT conv_id, string_agg('<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || chr(10)
     || CASE WHEN k = 0 AND r0 = 'system' THEN t0 || chr(10) || chr(10) ELSE '' END
     || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<end_of_turn>' || chr(10), '' ORDER BY turn) AS body,
   bool_and((role = 'user') = (k % 2 = 0)) AS ok FROM t WHERE k >= 0 GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM s)"""


put("chat_render", f"""WITH {chat_sql("SELECT * FROM conversations")}
SELECT conv_id, CASE WHEN coalesce(ok, true) THEN '<bos>' || coalesce(body, '') || '<start_of_turn>model' || chr(10) END AS prompt,
  coalesce(ok, true) AS ok, CASE WHEN NOT ok THEN 'roles do not alternate' END AS reason
FROM c LEFT JOIN bodies USING (conv_id)""")
put("chat_violations", f"""WITH {chat_sql("SELECT * FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)")}
SELECT conv_id, 'roles do not alternate' AS reason FROM bodies WHERE NOT ok""")

put("chat_null_turns", """SELECT DISTINCT conv_id, 'a turn has no text' AS reason FROM conversations
WHERE conv_id % 4 = 0 AND turn = conv_id % 3""")

# --- replies ---------------------------------------------------------------------------

put("extract_yes_no", f"""WITH {JUDGED} SELECT doc_id, extracted, expected, is_correct,
  CASE WHEN is_correct THEN 'CORRECT' WHEN NOT is_correct THEN 'INCORRECT' ELSE 'UNKNOWN' END AS status,
  response[1:6] = 'ERROR:' AS is_error FROM checked""")
put("reply_summary", f"""WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (is_correct) AS correct,
  count(*) FILTER (NOT is_correct) AS incorrect, count(*) FILTER (extracted = 'unknown') AS unknown,
  round(100e0 * count(*) FILTER (is_correct) / count(is_correct), 6) AS accuracy,
  count(*) FILTER (extracted = 'yes') AS n_yes, count(*) FILTER (extracted = 'no') AS n_no,
  count(*) FILTER (extracted = 'unknown') AS n_unknown,
  round(100e0 * count(*) FILTER (extracted = 'yes') / count(*), 6) AS pct_yes,
  round(100e0 * count(*) FILTER (extracted = 'no') / count(*), 6) AS pct_no,
  round(100e0 * count(*) FILTER (extracted = 'unknown') / count(*), 6) AS pct_unknown FROM checked""")

# --- scores ----------------------------------------------------------------------------

put("prob_from_logprobs", f"""WITH {REPLIES}, lp AS (SELECT doc_id, response,
    CASE WHEN doc_id % 13 <> 0 THEN -(1 + doc_id % 7) / 4e0 END AS no,
    CASE WHEN doc_id % 11 <> 0 THEN -(1 + n_chars % 5) / 4e0 END AS yes
  FROM replies JOIN documents USING (doc_id))
SELECT doc_id, round(CASE WHEN doc_id % 17 = 0 THEN 0.5e0
  WHEN yes IS NOT NULL AND no IS NOT NULL THEN exp(yes) / (exp(no) + exp(yes))
  WHEN yes IS NOT NULL THEN exp(yes) WHEN no IS NOT NULL THEN 1 - exp(no)
  WHEN lower(response)[1:3] = 'yes' THEN 1e0 ELSE 0e0 END, 6) AS p FROM lp""")
SCORES = "sc AS (SELECT doc_id, (doc_id % 9) / 4e0 AS no, (n_chars % 9) / 4e0 AS yes FROM documents)"
put("prob_from_logits", f"WITH {SCORES} SELECT doc_id, round(exp(yes) / (exp(no) + exp(yes)), 6) AS p FROM sc")
put("prob_variants", f"""WITH {SCORES}, e AS (SELECT doc_id, exp(no) + exp(no - 1) + exp(-3e0) AS n, exp(yes) + exp(yes / 2) AS y FROM sc)
SELECT doc_id, round(y / (n + y), 6) AS p FROM e""")
put("decisions", f"""WITH {SCORES}, q AS (SELECT *, no / (no + yes + 1) AS p FROM sc)
SELECT doc_id, CASE WHEN p >= 0.25e0 THEN 1 ELSE 0 END AS by_threshold, CASE WHEN yes > no THEN 1 ELSE 0 END AS by_logits,
  CASE WHEN no >= yes AND no >= 1 THEN 0 WHEN yes >= 1 THEN 1 ELSE 2 END AS by_argmax,
  round(CASE WHEN p >= 0.25e0 THEN p ELSE 1 - p END, 6) AS confidence FROM q""")
put("class_names", f"WITH {LABELLED} SELECT doc_id, CASE label WHEN 1 THEN 'ai' WHEN 0 THEN 'nonai' END AS name, label AS id FROM labelled")
put("class_probability", """WITH q AS (SELECT doc_id, doc_id % 4 AS k, (doc_id % 10) / 10e0 AS p FROM documents)
SELECT doc_id, round(CASE WHEN k = 0 THEN 0.5e0 WHEN k = 1 THEN 1 - p ELSE p END, 6) AS ai,
  CASE WHEN k < 2 THEN 'nonai' ELSE 'ai' END AS top_label, round(p, 6) AS top_confidence FROM q""")
put("score_documents", """SELECT doc_id, CASE WHEN length(text) % 17 = 0 THEN 0.5e0 ELSE (length(text) % 101) / 100e0 END AS ai_probability,
  CASE WHEN length(text) % 17 = 0 THEN 'ERROR: unlucky length' END AS error FROM documents""")
ANSWERED = """q AS (SELECT doc_id, text, length(text) % 17 = 0 AS bad, length(text) % 3 > 0 AS sure,
    ((8 - length(text) % 8) % 8) / 4e0 AS no FROM documents),
a AS (SELECT *, CASE WHEN bad THEN 'ERROR: no route' WHEN sure THEN 'Yes' ELSE 'maybe no' END AS response FROM q)"""
put("score_replies", f"""WITH {ANSWERED} SELECT doc_id, response, CASE WHEN bad THEN response END AS error,
  round(CASE WHEN bad THEN 0.5e0 WHEN sure THEN exp(-0.25e0) / (exp(-0.25e0) + exp(no)) ELSE 0e0 END, 6) AS ai_probability FROM a""")
put("reply_classification", f"""WITH {ANSWERED}, e AS (SELECT md5(text) AS text_full, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS label, response,
    CASE WHEN response = 'Yes' THEN 'yes' ELSE 'no' END AS extracted FROM a JOIN labels USING (doc_id))
SELECT *, label = extracted AS is_correct FROM e""")
put("cached_predictions", f"""WITH {LABELLED} SELECT CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
  label AS true_label, source AS dataset_name,
  CASE WHEN length(text) % 17 = 0 THEN 0.5e0 ELSE (length(text) % 101) / 100e0 END AS ai_probability FROM labelled""")

# --- evaluation ------------------------------------------------------------------------

put("threshold_grid", f"WITH {GRID_ROWS} {grid('dataset')} UNION ALL {grid('combined')}")
put("threshold_grid_combined", f"WITH {GRID_ROWS} {grid('')}")
put("threshold_cells", f"""WITH {PRED}, t AS (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS threshold)
SELECT threshold, true_label, CASE WHEN ai_probability >= threshold THEN 1 ELSE 0 END AS pred, count(*) AS n
FROM pred CROSS JOIN t GROUP BY ALL""")
put("error_analysis", f"""WITH {DECIDED} SELECT doc_id, true_label, predicted_label, ai_probability,
  true_label = predicted_label AS is_correct FROM dec""")
put("confusion_matrix", f"WITH {CM} SELECT * FROM cm")
put("class_metrics", f"WITH {CM} SELECT dataset_name, tn, fp, fn, tp, {METRICS} FROM cm")
put("overall_metrics", f"""WITH {CM}, m AS (SELECT dataset_name, {METRICS} FROM cm)
SELECT dataset_name, accuracy, ai_f1 AS f1, ai_precision AS precision, ai_recall AS recall FROM m""")
put("classification_report", f"""WITH {CM_ALL},
k AS (SELECT 'Non-AI' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM cm
      UNION ALL SELECT 'AI', tp, tp + fp, tp + fn FROM cm),
m AS (SELECT class, hit, support, hit / said AS p, hit / support AS r, 2 * hit / (said + support) AS f FROM k)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM m""")
put("class_summary", f"""WITH {CM} SELECT dataset_name, tn + fp AS total_nonai, tn AS nonai_correct,
  round(100e0 * tn / nullif(tn + fp, 0), 6) AS nonai_correct_pct, fp AS nonai_flagged,
  round(100e0 * fp / nullif(tn + fp, 0), 6) AS nonai_flagged_pct, fn + tp AS total_ai, tp AS ai_detected,
  round(100e0 * tp / nullif(fn + tp, 0), 6) AS ai_detected_pct, fn AS ai_missed,
  round(100e0 * fn / nullif(fn + tp, 0), 6) AS ai_missed_pct FROM cm""")
put("mean_confidence", f"WITH {DECIDED}, rows AS (SELECT *, {CONF_VALUE} FROM dec) SELECT dataset_name, {CONF} FROM rows GROUP BY dataset_name")
put("confidence_split", f"""WITH {DECIDED} SELECT
  round(coalesce(avg(ai_probability) FILTER (predicted_label = true_label), 0), 6) AS mean_conf_correct,
  round(coalesce(avg(ai_probability) FILTER (predicted_label <> true_label), 0), 6) AS mean_conf_incorrect,
  round(avg(ai_probability), 6) AS mean_conf_overall,
  count(*) FILTER (predicted_label = true_label) AS n_correct, count(*) FILTER (predicted_label <> true_label) AS n_incorrect,
  round(100e0 * count(*) FILTER (predicted_label = true_label) / count(*), 6) AS pct_correct,
  round(100e0 * count(*) FILTER (predicted_label <> true_label) / count(*), 6) AS pct_incorrect FROM dec""")
put("prob_stats", f"""WITH {PRED} SELECT 'dataset' AS scope, dataset_name, {STATS} FROM pred GROUP BY dataset_name
UNION ALL SELECT 'combined', NULL, {STATS} FROM pred""")
put("sample_summary", f"""WITH {DECIDED}, s AS (SELECT *, {CONF_VALUE}, CASE WHEN doc_id % 3 > 0 THEN true_label END AS e FROM dec)
SELECT count(*) AS n, count(e) AS labelled, count(*) FILTER (e = predicted_label) AS correct,
  round(100e0 * count(*) FILTER (e = predicted_label) / count(e), 6) AS correct_pct,
  sum(predicted_label)::BIGINT AS predicted_ai, round(100e0 * sum(predicted_label) / count(*), 6) AS predicted_ai_pct,
  sum(1 - predicted_label)::BIGINT AS predicted_nonai, round(100e0 * sum(1 - predicted_label) / count(*), 6) AS predicted_nonai_pct,
  round(avg(ai_probability), 6) AS mean_probability, round(avg(conf), 6) AS mean_confidence FROM s""")
put("top1_metrics", f"""WITH {DECIDED}, a AS (SELECT count(*) AS n, avg(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END) AS s FROM dec)
SELECT n, round(s, 6) AS precision_at_1, round(s, 6) AS recall_at_1, round(s, 6) AS f1 FROM a""")
COUNTS = "count(*) AS n, count(*) FILTER (true_label = 1) AS n_ai, count(*) FILTER (true_label = 0) AS n_nonai"
put("dataset_counts", f"""WITH {PRED} SELECT 'dataset' AS scope, dataset_name, {COUNTS}, 1::BIGINT AS datasets FROM pred GROUP BY dataset_name
UNION ALL SELECT 'combined', NULL, {COUNTS}, count(DISTINCT dataset_name) FROM pred""")
put("dataset_names", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ai news' ELSE 'recipes' END AS dataset_name
FROM documents WHERE doc_id % 3 < 2""")
put("roc_auc_by_dataset", f"WITH {PRED} {auc('dataset')} UNION ALL {auc('combined')}")
put("roc_auc_overall", f"WITH {PRED}, r AS ({auc('combined')}) SELECT n_pos, n_neg, roc_auc FROM r")
END_POINT = "NULL::DOUBLE AS threshold, 0::BIGINT AS tp, 0::BIGINT AS fp, 1e0 AS precision, 0e0 AS recall"
put("pr_curve", f"""WITH {curve("")}
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points UNION ALL SELECT {END_POINT}""")
put("pr_curve_by_dataset", f"""WITH {curve("dataset_name")}
SELECT dataset_name, threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points
UNION ALL SELECT DISTINCT dataset_name, {END_POINT} FROM pred""")
put("optimal_threshold", f"""WITH {curve("")}, best AS (
  SELECT * FROM points WHERE recall >= 0.95e0 ORDER BY precision DESC, threshold LIMIT 1)
SELECT threshold, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(2 * precision * recall / (precision + recall), 6) AS f1 FROM best""")
put("optimal_threshold_by_dataset", f"""WITH {curve("dataset_name")}, best AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY precision DESC, threshold) AS rn FROM points WHERE recall >= 0.5e0),
g AS (SELECT DISTINCT dataset_name FROM pred)
SELECT g.dataset_name, threshold, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(2 * precision * recall / (precision + recall), 6) AS f1
FROM g LEFT JOIN best ON g.dataset_name = best.dataset_name AND rn = 1""")

# --- profile ---------------------------------------------------------------------------

put("label_distribution", f"""WITH {LABELLED} SELECT label, count(*) AS count,
  round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM labelled GROUP BY label""")
put("label_distribution_by_source", f"""WITH {LABELLED} SELECT source, label, count(*) AS count,
  round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM labelled GROUP BY source, label""")
put("imbalance_ratio", f"""WITH {LABELLED}, c AS (SELECT count(*) AS n FROM labelled GROUP BY label)
SELECT max(n) AS max_count, min(n) AS min_count, round(max(n) / min(n), 6) AS ratio FROM c""")


def number_profile(table: str, col: str, dtype: str, quartiles: bool = True) -> str:
    stats = {
        "nulls": f"count(*) - count({col})", "count": f"count({col})", "mean": f"avg({col})",
        "std": f"stddev_samp({col})", "min": f"min({col})", "max": f"max({col})",
    }
    if quartiles:
        stats |= {f"{q}%": f"quantile_cont({col}::DOUBLE, {q / 100})" for q in (25, 50, 75)}
    parts = [f"SELECT '{col}' AS \"column\", 'dtype' AS stat, NULL::DOUBLE AS value, '{dtype}' AS text"]
    parts += [f"SELECT '{col}', '{s}', round(({e})::DOUBLE, 6), NULL FROM {table}" for s, e in stats.items()]
    return " UNION ALL ".join(parts)


def text_profile(table: str, col: str) -> str:
    top = f"(SELECT {col} AS v, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, sha256({col}) LIMIT 1)"
    stats = {"nulls": f"count(*) - count({col})", "count": f"count({col})", "unique": f"count(DISTINCT {col})"}
    parts = [f"SELECT '{col}', 'dtype', NULL::DOUBLE, 'string'"]
    parts += [f"SELECT '{col}', '{s}', ({e})::DOUBLE, NULL FROM {table}" for s, e in stats.items()]
    parts += [f"SELECT '{col}', 'top', NULL, v FROM {top}", f"SELECT '{col}', 'freq', n::DOUBLE, NULL FROM {top}"]
    return " UNION ALL ".join(parts)


put("profile_columns", " UNION ALL ".join([
    number_profile("documents", "doc_id", "bigint"),
    number_profile("documents", "n_chars", "bigint"),
    *[text_profile("documents", c) for c in ("text", "lang", "source")],
    "SELECT '*', 'rows', count(*)::DOUBLE, NULL FROM documents",
    "SELECT '*', 'columns', 5e0, NULL",
]))
put("profile_approx", " UNION ALL ".join([
    number_profile("labels", "doc_id", "bigint", False),
    number_profile("labels", "quality", "int", False),
    number_profile("labels", "toxic", "int", False),
    "SELECT '*', 'rows', count(*)::DOUBLE, NULL FROM labels",
    "SELECT '*', 'columns', 3e0, NULL",
]))
put("value_counts_top5", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, sha256({c})) AS rank, {c} AS value, count(*) AS count
    FROM documents GROUP BY {c}""" for c in ("text", "lang", "source")
) + ") WHERE rank <= 5")

# --- keywords --------------------------------------------------------------------------

put("distinct_words", r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents),
u AS (SELECT DISTINCT doc_id, word FROM w WHERE regexp_full_match(word, '[a-z]{3,}'))
SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY word), '') AS words FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id""")
put("document_frequency", f"""WITH {LABELLED}, {WORDS} SELECT word, count(*) FILTER (label = 1) AS num_docs_ai,
  count(*) FILTER (label = 0) AS num_docs_nonai FROM words GROUP BY word""")
RATIO_COLS = """word, round(ratio, 6) AS ratio, round(doc_freq_ai, 6) AS doc_freq_ai, round(doc_freq_nonai, 6) AS doc_freq_nonai,
  num_docs_ai, num_docs_nonai"""
put("keyword_ratio", f"WITH {RATIOS} SELECT {RATIO_COLS} FROM ratios")
put("keyword_discriminative", f"WITH {RATIOS} SELECT {RATIO_COLS} FROM ratios WHERE ratio >= 1.2e0 AND doc_freq_ai >= 0.01e0")
put("keyword_top50", f"""WITH {RATIOS}, k AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, word) AS rank FROM ratios
  WHERE ratio >= 1.2e0 AND doc_freq_ai >= 0.01e0)
SELECT rank, word, round(ratio, 6) AS ratio, round(doc_freq_ai * 100, 6) AS ai_pct, round(doc_freq_nonai * 100, 6) AS nonai_pct,
  num_docs_ai, num_docs_nonai FROM k WHERE rank <= 50""")
put("keyword_stats", f"""WITH {RATIOS}, o AS (SELECT *, row_number() OVER (ORDER BY ratio, word) - 1 AS i, count(*) OVER () AS n FROM ratios)
SELECT count(*) AS words, round(max(ratio), 6) AS max_ratio, (SELECT word FROM ratios ORDER BY ratio DESC, word LIMIT 1) AS max_word,
  round(min(ratio), 6) AS min_ratio, (SELECT word FROM ratios ORDER BY ratio, word LIMIT 1) AS min_word,
  round(avg(ratio), 6) AS mean_ratio, round(max(ratio) FILTER (i = n // 2), 6) AS median_ratio FROM o""")
put("keyword_histogram", f"""WITH {RATIOS}, b AS (SELECT unnest([0.5e0, 1e0, 2e0, 100e0]) AS low, unnest([1e0, 2e0, 100e0, NULL]) AS high)
SELECT low, high, count(ratio) AS words FROM b LEFT JOIN ratios ON ratio >= low AND (high IS NULL OR ratio < high) GROUP BY low, high""")
put("word_frequency_join", f"""WITH {RATIOS} SELECT word, num_docs_ai, round(doc_freq_ai, 6) AS doc_freq_ai, num_docs_nonai,
  round(doc_freq_nonai, 6) AS doc_freq_nonai FROM ratios""")
put("vocab_intersect", f"WITH {LABELLED}, {WORDS} SELECT word FROM words WHERE label = 1 INTERSECT SELECT word FROM words WHERE label = 0")

# --- splits ----------------------------------------------------------------------------

put("split_assign", f"WITH {SPLIT} SELECT doc_id, label, text, split FROM split")
put("split_fractions", f"WITH {SPLIT_FRACTIONS} SELECT doc_id, label, split FROM split")
put("split_counts", f"""WITH {SPLIT} SELECT split, label, count(*) AS count,
  round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM split GROUP BY split, label""")
put("split_remaining", f"WITH {SPLIT} SELECT doc_id, label FROM split WHERE split = 'remaining'")
put("combine_shuffled", f"WITH {LABELLED} SELECT doc_id, label FROM labelled ORDER BY md5('42-combined:' || doc_id), doc_id")
put("union_all", """SELECT doc_id, source, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages""")
put("first_k_per_label", f"""WITH {LABELLED} SELECT doc_id, label FROM labelled
QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 25""")

# --- sequences -------------------------------------------------------------------------

IDS = TOK + ", ids AS (SELECT doc_id, list_transform(tokens, lambda t: length(t)) AS ids FROM toks)"
POSITIONS = IDS + """, pos AS (SELECT doc_id, ids,
    list_filter(range(0, len(ids)), lambda i: ids[i + 1] IN (2, 3)) AS starts,
    list_filter(range(0, greatest(len(ids) - 1, 0)), lambda i: ids[i + 1] IN (2, 3)) AS early FROM ids),
spots AS (SELECT doc_id, ids, coalesce(list_max(starts), 0) AS last_at, coalesce(list_min(early), 0) AS first_at,
    len(starts) > 0 AS found FROM pos)"""


def masked(at: str) -> str:
    return f"array_to_string(list_transform(range(0, len(ids)), lambda i: CASE WHEN i < {at} THEN -100 ELSE ids[i + 1] END), ',')"


put("truncate_tokens", f"WITH {IDS} SELECT doc_id, array_to_string(ids[1:100], ',') AS ids FROM ids")
put("mask_labels", f"WITH {POSITIONS} SELECT doc_id, {masked('last_at')} AS last, {masked('first_at')} AS first, (CASE WHEN found THEN last_at ELSE 0 END)::INT AS masked FROM spots")
put("pad_batch", f"""WITH {IDS}, b AS (SELECT doc_id, doc_id // 16 AS batch, ids, ids[1:len(ids) // 2] AS labels FROM ids),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS li, max(len(labels)) OVER (PARTITION BY batch) AS ll FROM b)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, li - len(ids)), lambda x: 0)), ',') AS ids,
  array_to_string(list_concat(labels, list_transform(range(0, ll - len(labels)), lambda x: -100)), ',') AS labels FROM m""")
put("answer_position", f"""WITH {POSITIONS}, a AS (SELECT doc_id, last_at AS position, ids[last_at + 1] AS token FROM spots WHERE len(ids) > 0)
SELECT doc_id, position::INT AS position, token::INT AS token, CASE WHEN token = 3 THEN 1 ELSE 0 END AS true_class FROM a""")
put("chunk_windows", f"WITH {CHUNKS} SELECT doc_id, chunk, array_to_string(words, ' ') AS words FROM chunks")
put("chunk_vote", f"""WITH {CHUNKS}, v AS (SELECT doc_id, max(CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END) AS prediction, max(p) AS confidence,
    count(*) AS num_chunks, sum(CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS ai_chunks,
    string_agg(CASE WHEN p > 0.5e0 THEN '1' ELSE '0' END, ',' ORDER BY chunk) AS chunk_predictions FROM chunks GROUP BY doc_id)
SELECT doc_id, prediction, round(confidence, 6) AS confidence, num_chunks, ai_chunks, num_chunks > 1 AS used_chunking, chunk_predictions FROM v""")
put("chunk_stats", f"""WITH {CHUNKS}, n AS (SELECT count(*) AS n FROM chunks GROUP BY doc_id)
SELECT count(*) AS total_docs, count(*) FILTER (n = 1) AS single_chunk_docs,
  round(100e0 * count(*) FILTER (n = 1) / count(*), 6) AS single_chunk_pct, count(*) FILTER (n > 1) AS multi_chunk_docs,
  round(100e0 * count(*) FILTER (n > 1) / count(*), 6) AS multi_chunk_pct, sum(n)::BIGINT AS total_chunks,
  max(n) AS max_chunks, round(avg(n), 6) AS mean_chunks FROM n""")

# --- cost ------------------------------------------------------------------------------

BEST = """best AS (SELECT chunk_size, batch_size, tps FROM runs_in
  QUALIFY row_number() OVER (PARTITION BY chunk_size ORDER BY tps DESC, batch_size) = 1)"""
put("best_config", f"WITH {RUNS}, {BEST.replace('runs_in', 'runs')} SELECT chunk_size, batch_size, round(tps, 6) AS tps FROM best")
put("engine_speedup", f"""WITH {RUNS}, {BEST.replace('runs_in', "(SELECT * FROM runs WHERE engine = 'batched')")},
base AS (SELECT chunk_size, max(tps) AS baseline_tps FROM runs WHERE engine = 'baseline' GROUP BY chunk_size)
SELECT chunk_size, round(baseline_tps, 6) AS baseline_tps, batch_size, round(tps, 6) AS tps, round(tps / baseline_tps, 6) AS speedup
FROM base JOIN best USING (chunk_size)""")
put("cost_projection", f"""WITH {LEN}, {RUNS}, t AS (SELECT source, sum(token_length)::BIGINT AS total_tokens FROM lens GROUP BY source),
h AS (SELECT source, total_tokens, total_tokens / (SELECT max(tps) FROM runs) / 3600 AS hours1, unnest([1, 4, 10, 20]) AS gpus FROM t)
SELECT source, total_tokens, gpus, round(hours1 / gpus * 3600, 8) AS seconds, round(hours1 / gpus, 8) AS hours,
  round(hours1 / gpus / 24, 8) AS days, round(hours1 / gpus * gpus * 2, 8) AS cost FROM h""")

# --- models ----------------------------------------------------------------------------

WEIGHTS = f"""{LABELLED}, c AS (SELECT label, count(*) AS count FROM labelled GROUP BY label),
w AS (SELECT label, count, sum(count) OVER () / (count(*) OVER () * count) AS weight FROM c)"""
put("class_weights", f"WITH {WEIGHTS} SELECT label, count, round(weight, 6) AS weight FROM w")
put("weight_ratio", f"WITH {WEIGHTS} SELECT round(max(weight) FILTER (label = 1) / max(weight) FILTER (label = 0), 6) AS ratio FROM w")

put("sample_rows", """SELECT doc_id, text[1:500] AS text, lang[1:500] AS lang, source[1:500] AS source, n_chars
FROM documents ORDER BY doc_id LIMIT 3""")
