"""Whole jobs as queries: corpus builds, long documents, growing prediction tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsieve.operators import curves, evaluate, model, profile_state, scoring, sequences
from textsieve.operators.chat import render_turns
from textsieve.operators.evaluate import evaluate_thresholds
from textsieve.plans.corpus import build_corpus
from textsieve.plans.evaluation import classify_by_reply, write_run_report
from textsieve.plans.long_documents import predict_long_documents
from textsieve.plans.replies import extend_replies, latest_replies
from textsieve.session import fresh_path
from textsieve.sources import sinks
from textsieve.sources.sinks import report_blocks

from . import inputs as src
from .oracles import ANSWERED, CHUNKS, CM, GRID_ROWS, IDS, LABELLED, METRICS, PRED, SPLIT_FRACTIONS, WS, grid, put
from .queries import _length_replier, _length_scorer, query, rounded

# --- files that do not agree ---------------------------------------------------------------

SIZES = {"train": 40, "val": 10, "test": 10}


def _odd_folder(spark, d) -> str:
    """The documents as a folder of data sets: with other columns, other types, without text, not Parquet, unnamed."""
    docs, folder = src.table(spark, d, "documents"), fresh_path(spark, "raw")

    def part(lang: str):
        return docs.where(F.col("lang") == lang)

    part("en").select("doc_id", "text", "n_chars", F.col("source").alias("origin")).write.parquet(f"{folder}/web_positive")
    de = part("de").select("text", F.col("n_chars").cast("string").alias("n_chars"), "doc_id", "lang")
    de.write.parquet(f"{folder}/news NEGATIVE")
    part("fr").select("doc_id", "n_chars").write.parquet(f"{folder}/titles_positive")
    part("es").select("text").write.text(f"{folder}/broken_negative")
    docs.where("doc_id % 10 = 0").select("doc_id", "text").write.parquet(f"{folder}/mixed")
    return folder


def _built(spark, d):
    target = fresh_path(spark, "corpus")
    corpus = build_corpus(
        spark, _odd_folder(spark, d), target, glob="part-*", max_tokens=400, sizes=SIZES, id_col="doc_id"
    )
    return corpus, spark.read.parquet(f"{target}/ledger")


@query
def corpus_by_file(spark, d):
    """The ledger by data set, and what the corpus holds of each."""
    corpus, ledger = _built(spark, d)
    kind = F.substring_index("reason", ":", 1).alias("reason")
    listed = ledger.groupBy("file_name", "used", kind).agg(F.sum("rows").alias("rows"))
    kept = corpus.groupBy("file_name").agg(
        F.count("*").alias("kept"),
        F.sum(F.col("token_length").cast("bigint")).alias("tokens"),
        F.count("origin").alias("origins"),
        F.sum(F.col("n_chars").try_cast("bigint")).alias("chars"),
    )
    return listed.join(kept, "file_name", "left")


put("corpus_by_file", f"""WITH l AS (SELECT *, len(regexp_extract_all(text, {WS})) AS tokens FROM documents),
d AS (
  SELECT 'web_positive' AS file_name, true AS used, NULL AS reason, *, source AS origin FROM l WHERE lang = 'en'
  UNION ALL SELECT 'news NEGATIVE', true, NULL, *, NULL FROM l WHERE lang = 'de'
  UNION ALL SELECT 'titles_positive', false, 'missing columns', *, NULL FROM l WHERE lang = 'fr'
  UNION ALL SELECT 'broken_negative', false, 'unreadable', *, NULL FROM l WHERE lang = 'es'
  UNION ALL SELECT 'mixed', false, 'file name holds neither positive nor negative', *, NULL FROM l WHERE doc_id % 10 = 0),
k AS (SELECT *, used AND tokens <= 400 AS stays FROM d)
SELECT file_name, used, reason, CASE WHEN reason = 'unreadable' THEN NULL ELSE count(*) END AS rows,
  CASE WHEN used THEN count(*) FILTER (stays) END AS kept, (sum(tokens) FILTER (stays))::BIGINT AS tokens,
  CASE WHEN used THEN count(origin) FILTER (stays) END AS origins, (sum(n_chars) FILTER (stays))::BIGINT AS chars
FROM k GROUP BY file_name, used, reason""")  # fmt: skip


@query
def corpus_splits(spark, d):
    """The corpus that is built of that folder, row by row."""
    corpus, _ = _built(spark, d)
    return corpus.select("doc_id", "file_name", "label", "token_length", "split", F.md5("text").alias("text"))


put("corpus_splits", f"""WITH l AS (
  SELECT *, len(regexp_extract_all(text, {WS}))::INT AS token_length, CASE lang WHEN 'en' THEN 1 ELSE 0 END AS label,
    CASE lang WHEN 'en' THEN 'web_positive' ELSE 'news NEGATIVE' END AS file_name
  FROM documents WHERE lang IN ('en', 'de')),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM l WHERE token_length <= 400)
SELECT doc_id, file_name, label, token_length, md5(text) AS text,
  CASE WHEN rn <= 40 THEN 'train' WHEN rn <= 50 THEN 'val' WHEN rn <= 60 THEN 'test' ELSE 'remaining' END AS split FROM r""")  # fmt: skip

# --- long documents ------------------------------------------------------------------------


@query
def long_document_votes(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    votes = predict_long_documents(docs, _length_scorer, size=512, overlap=64)
    return rounded(
        votes.select(
            "doc_id", "prediction", "predicted_class", "answer", "confidence", "num_chunks", "total_tokens",
            "ai_chunks", "used_chunking", "errors",
            F.array_join(F.transform("chunk_predictions", lambda x: x.cast("string")), ",").alias("chunk_predictions"),
        )
    )


put("long_document_votes", f"""WITH {CHUNKS},
pieces AS (SELECT c.doc_id, chunk, len(t.tokens) AS total_tokens,
    CASE WHEN len(t.tokens) <= 512 THEN t.text ELSE array_to_string(words, ' ') END AS piece
  FROM chunks c JOIN toks t ON c.doc_id = t.doc_id),
scored AS (SELECT *, length(piece) % 17 = 0 AS failed, CASE WHEN length(piece) % 17 = 0 THEN 0.5e0 ELSE (length(piece) % 101) / 100e0 END AS prob FROM pieces),
v AS (SELECT doc_id, max(CASE WHEN prob > 0.5e0 THEN 1 ELSE 0 END) AS prediction, max(prob) AS confidence, count(*) AS num_chunks,
    max(total_tokens)::INT AS total_tokens, count(*) FILTER (prob > 0.5e0) AS ai_chunks, count(*) FILTER (failed) AS errors,
    string_agg(CASE WHEN prob > 0.5e0 THEN '1' ELSE '0' END, ',' ORDER BY chunk) AS chunk_predictions FROM scored GROUP BY doc_id)
SELECT doc_id, prediction, CASE prediction WHEN 1 THEN 'ai' ELSE 'nonai' END AS predicted_class,
  CASE prediction WHEN 1 THEN 'AI' ELSE 'Non-AI' END AS answer, round(confidence, 6) AS confidence, num_chunks, total_tokens,
  ai_chunks, num_chunks > 1 AS used_chunking, errors, chunk_predictions FROM v""")  # fmt: skip

# --- a prediction table that grows -----------------------------------------------------------


def _grown_replies(spark, d):
    """A third of the documents, then all in two parts, then all again, which adds nothing."""
    docs = src.labelled(spark, d).select("doc_id", "text", "label", "source")
    path = fresh_path(spark, "replies")
    extend_replies(docs.where("doc_id % 3 = 0"), _length_replier, path, dataset="source")
    extend_replies(docs, _length_replier, path, dataset="source", parts=2)
    return latest_replies(extend_replies(docs, _length_replier, path, dataset="source"))


@query
def reply_table(spark, d):
    table = _grown_replies(spark, d).select("id", F.md5("text_full").alias("text_full"), "true_label", "response", "ai_probability", "attempt")
    return rounded(table)


REPLIED = f"""{ANSWERED}, pred AS (
  SELECT doc_id, text, quality AS true_label, source AS dataset_name, response,
    CASE WHEN bad THEN 0.5e0 WHEN sure THEN exp(-0.25e0) / (exp(-0.25e0) + exp(no)) ELSE 0e0 END AS ai_probability
  FROM a JOIN (SELECT doc_id, source FROM documents) USING (doc_id) JOIN labels USING (doc_id))"""
put("reply_table", f"""WITH {REPLIED} SELECT doc_id AS id, md5(text) AS text_full, true_label, response,
  round(ai_probability, 6) AS ai_probability, 1 AS attempt FROM pred""")


@query
def logprob_evaluation(spark, d):
    return rounded(evaluate_thresholds(_grown_replies(spark, d)))


put("logprob_evaluation", f"WITH {GRID_ROWS.replace(PRED, REPLIED)} {grid('dataset')} UNION ALL {grid('combined')}")


@query
def reply_results(spark, d):
    """Evaluated replies that name their documents, read back from the result file."""
    path = fresh_path(spark, "results")
    classify_by_reply(src.labelled(spark, d).select("doc_id", "text", "label"), _length_replier, path, key="doc_id")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/results_full")
    return rows.select(F.col("index").cast("bigint").alias("index"), "label", "response", "extracted", F.col("is_correct").cast("boolean").alias("is_correct"))


put("reply_results", f"""WITH {ANSWERED}, e AS (SELECT doc_id AS index, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS label, response,
    CASE WHEN response = 'Yes' THEN 'yes' ELSE 'no' END AS extracted FROM a JOIN labels USING (doc_id))
SELECT *, label = extracted AS is_correct FROM e""")

# --- reports of a run ----------------------------------------------------------------------


@query
def run_report(spark, d):
    """The document of a run, written, read back and taken apart again."""
    paths = write_run_report(src.predictions(spark, d), fresh_path(spark, "report"), model="m")
    lines = spark.read.text(paths["document"])
    metrics = "map<string,map<string,struct<tn:bigint,fp:bigint,fn:bigint,tp:bigint,accuracy:double,ai_f1:double>>>"
    fields = f"metadata struct<model:string,threshold:double>, results {metrics}, roc_auc array<struct<scope:string>>"
    document = lines.select(F.from_json("value", fields).alias("d")).select("d.*")
    by_set = document.select("metadata.model", F.size("roc_auc").alias("curves"), F.explode("results").alias("dataset", "points"))
    points = by_set.select("model", "curves", "dataset", F.explode("points").alias("threshold", "m"))
    return rounded(points.select("model", "curves", "dataset", F.col("threshold").cast("double").alias("threshold"), "m.*"))


put("run_report", f"""WITH {GRID_ROWS}, g AS ({grid('dataset')} UNION ALL {grid('combined')})
SELECT 'm' AS model, (SELECT count(DISTINCT dataset_name) + 1 FROM pred)::INT AS curves, coalesce(dataset_name, 'combined') AS dataset,
  threshold, tn, fp, fn, tp, accuracy, ai_f1 FROM g""")


@query
def class_report_text(spark, d):
    cm = evaluate.confusion_matrix(evaluate.with_decision(src.predictions(spark, d), 0.5), by=["dataset_name"])
    blocks = report_blocks(cm)
    return blocks.select("dataset_name", F.slice(F.split("value", "\n"), 2, 9).alias("lines")).select("dataset_name", F.array_join("lines", "|").alias("lines"))


put("class_report_text", f"""WITH {CM}, m AS (SELECT *, tn + fp AS s0, fn + tp AS s1, {METRICS} FROM cm),
x AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m),
c AS (SELECT *, s0 + s1 AS n FROM x)
SELECT dataset_name, concat_ws('|', 'Dataset: ' || dataset_name, repeat('=', 80), 'Samples: ' || n,
  repeat(' ', 14) || ' precision    recall        f1   support',
  printf('        Non-AI%10.4f%10.4f%10.4f%10d', round(p0, 4), round(r0, 4), round(f0, 4), s0),
  printf('            AI%10.4f%10.4f%10.4f%10d', round(p1, 4), round(r1, 4), round(f1, 4), s1),
  printf('      accuracy%30.4f%10d', round((tn + tp) / n, 4), n),
  printf('     macro avg%10.4f%10.4f%10.4f%10d', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), n),
  printf('  weighted avg%10.4f%10.4f%10.4f%10d', round((p0 * s0 + p1 * s1) / n, 4), round((r0 * s0 + r1 * s1) / n, 4), round((f0 * s0 + f1 * s1) / n, 4), n)) AS lines
FROM c""")  # fmt: skip


# --- scores that are no numbers --------------------------------------------------------------


@query
def holed_scores(spark, d):
    """Every mean and extreme over scores of which some are NaN and some null: one rule in all."""
    k = F.col("doc_id") % 7
    hole = F.when(k == 0, F.lit(float("nan"))).when(k != 1, F.col("ai_probability"))
    pred = evaluate.with_decision(src.predictions(spark, d).withColumn("ai_probability", hole))
    stats = evaluate.probability_stats(pred, "dataset_name").where("scope = 'dataset'").drop("scope")
    split = evaluate.confidence_split(pred, ["dataset_name"])
    sure = evaluate.mean_confidence(pred, ["dataset_name"])
    return rounded(stats.join(split, "dataset_name").join(sure, "dataset_name"))


put("holed_scores", f"""WITH {PRED}, h AS (SELECT *, CASE WHEN doc_id % 7 > 1 THEN ai_probability END AS p FROM pred),
x AS (SELECT *, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS hit FROM h),
y AS (SELECT *, hit = true_label AS ok, CASE WHEN hit = 1 THEN p ELSE 1 - p END AS sure FROM x)
SELECT dataset_name, round(avg(p), 6) AS mean, min(p) AS min, max(p) AS max, round(stddev_samp(p), 6) AS std,
  round(coalesce(avg(p) FILTER (ok), 0), 6) AS mean_conf_correct, round(coalesce(avg(p) FILTER (NOT ok), 0), 6) AS mean_conf_incorrect,
  round(coalesce(avg(p), 0), 6) AS mean_conf_overall, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_incorrect,
  round(100e0 * count(*) FILTER (ok) / count(*), 6) AS pct_correct, round(100e0 * count(*) FILTER (NOT ok) / count(*), 6) AS pct_incorrect,
  round(coalesce(avg(sure) FILTER (ok), 0), 6) AS mean_confidence_correct, round(coalesce(avg(sure) FILTER (NOT ok), 0), 6) AS mean_confidence_incorrect,
  round(coalesce(avg(sure), 0), 6) AS mean_confidence_overall FROM y GROUP BY dataset_name""")  # fmt: skip


def _odd_scorer():
    return lambda texts: [float("nan") if len(t) % 5 == 0 else float("inf") if len(t) % 7 == 0 else len(t) % 101 / 100 for t in texts]


@query
def unusable_results(spark, d):
    """A scorer whose results are not always numbers."""
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    return scoring.score_documents(docs, _odd_scorer).select("doc_id", "ai_probability", "error")


put("unusable_results", """SELECT doc_id, CASE WHEN length(text) % 5 = 0 OR length(text) % 7 = 0 THEN 0.5e0 ELSE (length(text) % 101) / 100e0 END AS ai_probability,
  CASE WHEN length(text) % 5 = 0 THEN 'ERROR: nan is no probability' WHEN length(text) % 7 = 0 THEN 'ERROR: inf is no probability' END AS error
FROM documents""")

# --- turns and batches -----------------------------------------------------------------------


@query
def chat_turns(spark, d):
    """Conversations as turns, in small blocks; some lose a turn, some a text."""
    turns = src.table(spark, d, "conversations").where("NOT (conv_id % 3 = 0 AND turn = 1)")
    hole = F.expr("conv_id % 5 = 0 AND turn = conv_id % 3")
    return render_turns(turns.withColumn("text", F.when(~hole, F.col("text"))), add_generation_prompt=True, block=2)


put("chat_turns", r"""WITH s AS (SELECT conv_id, turn, role, CASE WHEN NOT (conv_id % 5 = 0 AND turn = conv_id % 3) THEN text END AS text
  FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)),
n AS (SELECT *, row_number() OVER w - 1 AS place, first_value(role) OVER w AS r0, first_value(text) OVER w AS t0, count(*) OVER (PARTITION BY conv_id) AS total
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, CASE WHEN r0 = 'system' THEN place - 1 ELSE place END AS k FROM n),
c AS (SELECT conv_id, bool_or(text IS NULL) AS holed, coalesce(bool_and((role = 'user') = (k % 2 = 0)) FILTER (k >= 0), true) AS alternate FROM k GROUP BY conv_id)
SELECT conv_id, turn, place, NOT holed AND alternate AS ok,
  CASE WHEN holed THEN 'a turn has no text' WHEN NOT alternate THEN 'roles do not alternate' END AS reason,
  CASE WHEN NOT holed AND alternate THEN CASE WHEN place = 0 THEN '<bos>' ELSE '' END
    || CASE WHEN k < 0 THEN '' ELSE '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10)
      || CASE WHEN k = 0 AND r0 = 'system' THEN t0 || chr(10) || chr(10) ELSE '' END
      || regexp_replace(text, '^\s+|\s+$', '', 'g') || '<end_of_turn>' || chr(10) END
    || CASE WHEN place = total - 1 THEN '<start_of_turn>model' || chr(10) ELSE '' END END AS piece
FROM k JOIN c USING (conv_id)""")  # fmt: skip


def _batched(spark, d):
    return sequences.length_batches(src.token_ids(spark, d).select("doc_id", "input_ids"), 16, "doc_id", width=64, parts=2)


@query
def length_batches(spark, d):
    return _batched(spark, d).select("doc_id", "batch", F.size("input_ids").alias("n_tokens"))


BATCHES = f"""{IDS}, b AS (SELECT doc_id, len(ids)::INT AS n_tokens, ceil(len(ids) / 64)::INT AS bucket,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 2 AS part FROM ids),
batches AS (SELECT doc_id, n_tokens, concat_ws(':', bucket, part,
  (row_number() OVER (PARTITION BY bucket, part ORDER BY n_tokens, doc_id) - 1) // 16) AS batch FROM b)"""
put("length_batches", f"WITH {BATCHES} SELECT doc_id, batch, n_tokens FROM batches")


@query
def padding_by_order(spark, d):
    """What is padded when batches follow the length, and when they follow the id."""
    by_id = src.token_ids(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 16.0))
    shares = [sequences.padding_share(b).withColumn("order", F.lit(name)) for name, b in (("length", _batched(spark, d)), ("id", by_id))]
    return rounded(shares[0].unionByName(shares[1]))


put("padding_by_order", f"""WITH {BATCHES}, every AS (SELECT 'length' AS o, batch, n_tokens FROM batches
  UNION ALL SELECT 'id', (doc_id // 16)::VARCHAR, n_tokens FROM b),
g AS (SELECT o, batch, count(*) * max(n_tokens) AS padded, sum(n_tokens) AS tokens FROM every GROUP BY o, batch)
SELECT o AS "order", count(*) AS batches, sum(tokens)::BIGINT AS tokens, (sum(padded) - sum(tokens))::BIGINT AS padding,
  round((sum(padded) - sum(tokens)) / sum(padded), 6) AS padding_share FROM g GROUP BY o""")

# --- profiles that merge ------------------------------------------------------------------------


def _merged_state(spark, d):
    """A state for each language, as they would arrive day by day, written and merged in two steps."""
    docs = src.table(spark, d, "documents").withColumn("ratio", F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 7))
    path = sinks.write_parquet(profile_state.profile_state(docs, ["lang"]), fresh_path(spark, "states"))
    states = spark.read.parquet(path).withColumn("half", F.col("lang").isin("de", "en")).drop("lang")
    return docs, profile_state.merge_states(profile_state.merge_states(states, ["half"]).drop("half"))


@query
def profile_merged(spark, d):
    """What is exact in a merged profile."""
    _, state = _merged_state(spark, d)
    tidy = profile_state.profile_of_state(state).where("stat IN ('rows', 'nulls', 'count', 'mean', 'std', 'min', 'max') OR column = 'source'")
    return rounded(tidy.where("stat <> 'top'").select("column", "stat", "value"))


put("profile_merged", f"""WITH docs AS (SELECT *, CASE WHEN doc_id % 7 > 0 THEN n_chars / 7 END AS ratio FROM documents),
n AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v FROM docs" for c in ("doc_id", "n_chars", "ratio"))}),
t AS (SELECT 'text' AS col, text AS v FROM docs UNION ALL SELECT 'source', source FROM docs),
s AS (SELECT col, count(*) AS rows, count(*) - count(v) AS nulls, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, NULL AS uniq, NULL AS freq
  FROM n GROUP BY col UNION ALL
  SELECT t.col, count(*), count(*) - count(v), count(v), NULL, NULL, NULL, NULL, CASE t.col WHEN 'source' THEN count(DISTINCT v) END,
    CASE t.col WHEN 'source' THEN (SELECT max(c) FROM (SELECT count(*) AS c FROM docs GROUP BY source)) END FROM t GROUP BY t.col)
SELECT * FROM (SELECT col AS "column", unnest(['rows', 'nulls', 'count', 'mean', 'std', 'min', 'max', 'unique', 'freq']) AS stat,
  unnest([rows::DOUBLE, nulls::DOUBLE, count::DOUBLE, round(mean, 6), round(std, 6), round(min, 6), round(max, 6), uniq::DOUBLE, freq::DOUBLE]) AS value
FROM s) WHERE value IS NOT NULL""")  # fmt: skip


@query
def profile_merged_error(spark, d):
    """Whether the sketches of a merged profile keep their stated errors: ranks of the quartiles, distinct texts."""
    docs, state = _merged_state(spark, d)
    tidy = profile_state.profile_of_state(state)

    def found(column: str, stat: str):
        return tidy.where((F.col("column") == column) & (F.col("stat") == stat)).select("value").scalar()

    facts = {}
    for q, stat in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
        below, upto = (F.avg(hit.cast("double")) for hit in (F.col("n_chars") < found("n_chars", stat), F.col("n_chars") <= found("n_chars", stat)))
        facts[f"rank_of_{stat[:2]}"] = (below - profile_state.RANK_ERROR <= q) & (q <= upto + profile_state.RANK_ERROR)
    off = F.abs(found("text", "unique") / F.count_distinct("text") - 1)
    facts["distinct_texts"] = off < profile_state.DISTINCT_ERROR
    return docs.agg(*[fact.alias(name) for name, fact in facts.items()])


put("profile_merged_error", "SELECT true AS rank_of_25, true AS rank_of_50, true AS rank_of_75, true AS distinct_texts")

# --- what any fitted model must hold -----------------------------------------------------------


@query
def model_contract(spark, d):
    """Training, prediction, reload and threshold search on the splits, as facts that SQL can state."""
    from textsieve.operators import split

    docs = src.labelled(spark, d).select("doc_id", "text", "label")
    parts = split.stratified_split(docs, "label", "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, seed=7)
    fitted = model.train_text_classifier(parts.where("split = 'train'"), buckets=2**16, max_iter=10)
    val = model.predict(fitted, parts.where("split = 'val'"))
    threshold = curves.optimal_threshold(val.withColumnRenamed("label", "true_label"), 0.95)
    loaded, saved = model.load_model(spark, model.save_model(fitted, threshold, fresh_path(spark, "model")))
    seen = model.predict(fitted, parts.where("split <> 'remaining'"), 0.4)
    again = model.predict(loaded, parts.where("split <> 'remaining'"), 0.4).select("doc_id", F.col("ai_probability").alias("reloaded"))
    both = seen.join(again, "doc_id")
    train_auc = curves.roc_auc(seen.where("split = 'train'").withColumnRenamed("label", "true_label")).select(F.col("roc_auc") > 0.9)
    rule = (F.col("predicted_label") == (F.col("ai_probability") >= 0.4).cast("int")) & (
        F.col("predicted_class") == F.when(F.col("predicted_label") == 1, "ai").otherwise("nonai")
    )
    facts = both.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.every(F.abs(F.col("ai_probability") + F.col("nonai_probability") - 1) < 1e-9).alias("sums_to_one"),
        F.every((F.col("ai_probability") >= 0) & (F.col("ai_probability") <= 1)).alias("in_range"),
        F.every(rule).alias("class_follows_rule"),
        F.every(F.abs(F.col("ai_probability") - F.col("reloaded")) < 1e-12).alias("reloaded_is_fitted"),
    )
    return facts.withColumns({"train_auc_above_0_9": train_auc.scalar(), "recall_reached": saved.select(F.col("recall") >= 0.95).scalar()})


put("model_contract", f"""WITH {SPLIT_FRACTIONS} SELECT split, count(*) AS rows, true AS sums_to_one, true AS in_range, true AS class_follows_rule,
  true AS reloaded_is_fitted, true AS train_auc_above_0_9, true AS recall_reached FROM split WHERE split <> 'remaining' GROUP BY split""")
