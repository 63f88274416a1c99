"""One entry per operator: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textsieve.functions import labels as lab
from textsieve.functions import scores as sc
from textsieve.functions import text as tx
from textsieve.functions import tokens as tk
from textsieve.operators import chat, cost, curves, evaluate, keywords, model, prep, profile, scoring, sequences, split
from textsieve.operators import replies as rep
from textsieve.plans.evaluation import classify_by_reply, predict_and_cache
from textsieve.plans.training import run_pipeline
from textsieve.session import fresh_path
from textsieve.sources import gates, readers, sinks

from . import inputs as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed value: the instruction around a document.
TEMPLATE = (
    "Does the following text include anything related to AI or LLMs?\n"
    "If so, output 'Yes'. Otherwise, output 'No'.\n\n"
    "<text>\n{text}\n</text>\n\n"
    "Remember to only output a single token: 'Yes' or 'No'.\n"
)
MIN_RATIO, MIN_FREQ = 1.2, 0.01  # thresholds that some words of the test tables pass


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources and sinks -----------------------------------------------------------------


@query
def corpus_scan(spark, d):
    corpus = readers.read_corpus(spark, d, "documents*.parquet")
    return corpus.groupBy("file_name").agg(
        F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars")
    )


@query
def csv_round_trip(spark, d):
    docs = src.labelled(spark, d).select("doc_id", "text", "label")
    path = sinks.write_csv(docs, fresh_path(spark, "csv"))
    return readers.read_csv_split(spark, path, docs.schema)


@query
def file_dispatch(spark, d):
    return readers.read_file(spark, f"{d}/labels.parquet")


def _write_lines(spark, d) -> str:
    mark = F.when(F.col("label") == 1, F.lit("ai")).otherwise(F.lit("nonai"))
    lines = src.labelled(spark, d).select(
        F.concat(F.lit("__label__"), mark, F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value")
    )
    path = fresh_path(spark, "lines")
    lines.write.text(path)
    return path


@query
def labelled_lines(spark, d):
    return readers.read_labelled_lines(spark, _write_lines(spark, d)).select("text", "label")


@query
def line_count(spark, d):
    return readers.count_lines(spark, _write_lines(spark, d)).agg(F.sum("lines").alias("lines"))


@query
def partitioned_parquet(spark, d):
    docs = split.stratified_split(
        src.labelled(spark, d).select("doc_id", "label"), "label", "doc_id", {"train": 160, "val": 20, "test": 20}
    )
    path = sinks.write_parquet(docs, fresh_path(spark, "splits"), "split", suffix="_8k")
    return spark.read.parquet(path).select("doc_id", "label", "split")


@query
def json_report(spark, d):
    stats = evaluate.probability_stats(src.predictions(spark, d), "dataset_name")
    stats = stats.withColumn("not_a_number", F.lit(float("nan")))
    path = sinks.write_json_report(stats, fresh_path(spark, "report"), {"model": "m"})
    schema = "metadata struct<model:string,timestamp:string>, row struct<" + ",".join(
        f"{c}:{t}" for c, t in stats.dtypes
    ) + ">"
    back = spark.read.schema(schema).json(path)
    return rounded(back.select(F.col("metadata.model").alias("model"), "row.*"))


@query
def text_report(spark, d):
    decided = evaluate.with_decision(src.predictions(spark, d), 0.5)
    cm = evaluate.confusion_matrix(decided, by=["dataset_name"])
    return sinks.metric_blocks(cm)


@query
def unlabelled_source(spark, d):
    docs = gates.require_columns(src.table(spark, d, "documents"), ["text", "label"], on_missing="unlabelled")
    return docs.agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


@query
def nan_to_null(spark, d):
    x = F.col("doc_id").cast("double")
    holes = (
        F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("doc_id") % 5 == 1, F.lit(float("inf")))
        .when(F.col("doc_id") % 5 == 2, F.lit(float("-inf")))
        .otherwise(x)
    )
    docs = src.table(spark, d, "documents").select("doc_id", holes.alias("x"), F.array(holes, x).alias("xs"))
    clean = sinks.nan_to_null(docs)
    return clean.select("doc_id", "x", F.get("xs", F.lit(0)).alias("x0"), F.get("xs", F.lit(1)).alias("x1"))


# --- preparation -----------------------------------------------------------------------


@query
def label_from_name(spark, d):
    return prep.label_from_filename(src.named_files(spark, d)).select("doc_id", "file_name", "label")


@query
def label_rejects(spark, d):
    _good, bad = gates.split_rejects(prep.label_from_filename(src.named_files(spark, d)), "label")
    return bad.groupBy("file_name").agg(F.count("*").alias("n"))


@query
def drop_columns(spark, d):
    pages = prep.drop_if_present(src.table(spark, d, "pages"))
    return pages.select(*[F.length(c).alias(c) if t == "string" else F.col(c) for c, t in pages.dtypes])


@query
def clean_text(spark, d):
    return prep.drop_empty_text(src.holed_texts(spark, d)).select("doc_id", "text")


@query
def clean_counts(spark, d):
    return prep.clean_counts(src.holed_texts(spark, d))


def _with_length(spark, d, tokenizer="whitespace") -> DataFrame:
    return prep.add_token_length(src.table(spark, d, "documents"), tokenizer)


@query
def token_length(spark, d):
    return _with_length(spark, d).select("doc_id", "token_length")


@query
def token_length_word(spark, d):
    return _with_length(spark, d, "word").select("doc_id", "token_length")


def _split_tokenizer():
    return lambda texts: [len(t.split()) for t in texts]


@query
def token_length_plug_in(spark, d):
    return _with_length(spark, d, _split_tokenizer).select("doc_id", "token_length")


@query
def length_filter(spark, d):
    return prep.filter_max_tokens(_with_length(spark, d), 1000).select("doc_id", "token_length")


@query
def length_filter_stats(spark, d):
    return rounded(prep.length_stats(_with_length(spark, d), 1000))


@query
def length_stats_by_source(spark, d):
    return rounded(prep.length_stats(_with_length(spark, d), by=["source"]))


@query
def normalize_label(spark, d):
    raw = src.replies(spark, d)
    number = (F.col("doc_id") % 3).cast("double")
    return raw.select(
        "doc_id",
        lab.normalize_label(F.col("label"), "int").alias("label_int"),
        lab.normalize_label(F.col("label"), "str").alias("label_str"),
        lab.normalize_label(number, "int").alias("number_int"),
        lab.normalize_label(number, "str").alias("number_str"),
    )


@query
def text_preview(spark, d):
    return src.table(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query
def flat_text(spark, d):
    padded = F.concat(F.lit(" \n\t"), "text", F.lit("\r\n "))
    return src.table(spark, d, "documents").select("doc_id", tx.flatten_text(padded).alias("flat"))


@query
def prompt_fill(spark, d):
    return src.table(spark, d, "documents").select("doc_id", tx.fill_template(F.col("text"), TEMPLATE).alias("prompt"))


@query
def instruction_prompt(spark, d):
    return src.labelled(spark, d).select(
        "doc_id",
        tx.instruction_prompt(F.col("text"), TEMPLATE, F.col("label")).alias("training"),
        tx.instruction_prompt(F.col("text"), TEMPLATE).alias("inference"),
    )


@query
def chat_render(spark, d):
    return chat.render_chat(src.table(spark, d, "conversations"), add_generation_prompt=True)


@query
def chat_violations(spark, d):
    """Conversations of which some lose a turn, so that their roles no longer alternate."""
    turns = src.table(spark, d, "conversations")
    broken = turns.where(~((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1)))
    _good, bad = gates.split_rejects(chat.render_chat(broken), "ok")
    return bad.select("conv_id", "reason")


@query
def chat_null_turns(spark, d):
    """Conversations of which one turn has lost its text."""
    turns = src.table(spark, d, "conversations")
    hole = (F.col("conv_id") % 4 == 0) & (F.col("turn") == F.col("conv_id") % 3)
    _good, bad = gates.split_rejects(chat.render_chat(turns.withColumn("text", F.when(~hole, F.col("text")))), "ok")
    return bad.select("conv_id", "reason")


# --- replies ---------------------------------------------------------------------------


@query
def extract_yes_no(spark, d):
    found = rep.evaluate_replies(src.replies(spark, d))
    return found.select("doc_id", "extracted", "expected", "is_correct", "status", "is_error")


@query
def reply_summary(spark, d):
    return rounded(rep.reply_summary(rep.evaluate_replies(src.replies(spark, d))))


# --- scores ----------------------------------------------------------------------------


@query
def prob_from_logprobs(spark, d):
    p = sc.prob_from_logprobs(F.col("top"), F.col("response"), F.col("error"))
    return rounded(src.logprobs(spark, d).select("doc_id", p.alias("p")))


@query
def prob_from_logits(spark, d):
    p = sc.prob_from_scores(F.col("no"), F.col("yes"))
    return rounded(src.scores(spark, d).select("doc_id", p.alias("p")))


@query
def prob_variants(spark, d):
    no = F.array("no", F.col("no") - 1.0, F.lit(-3.0))
    yes = F.array("yes", F.col("yes") / 2)
    return rounded(src.scores(spark, d).select("doc_id", sc.prob_from_variants(no, yes).alias("p")))


@query
def decisions(spark, d):
    s = src.scores(spark, d).withColumn("p", F.col("no") / (F.col("no") + F.col("yes") + 1.0))
    return rounded(
        s.select(
            "doc_id",
            sc.decide(F.col("p"), 0.25).alias("by_threshold"),
            sc.decide_logits(F.col("no"), F.col("yes")).alias("by_logits"),
            sc.argmax_class(F.array("no", "yes", F.lit(1.0))).alias("by_argmax"),
            sc.confidence(F.col("p"), sc.decide(F.col("p"), 0.25)).alias("confidence"),
        )
    )


@query
def class_names(spark, d):
    named = src.labelled(spark, d).select("doc_id", lab.class_name(F.col("label")).alias("name"))
    return named.select("doc_id", "name", lab.class_id(F.col("name")).alias("id"))


@query
def class_probability(spark, d):
    p = (F.col("doc_id") % 10) / F.lit(10.0)
    labels = (
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("__label__nonai")))
        .when(F.col("doc_id") % 4 == 1, F.array(F.lit("__label__nonai"), F.lit("__label__ai")))
        .otherwise(F.array(F.lit("__label__ai"), F.lit("__label__nonai")))
    )
    probs = F.array(p, F.lit(1.0) - p)
    docs = src.table(spark, d, "documents").select("doc_id", labels.alias("labels"), probs.alias("probs"))
    top = sc.top_class(F.col("labels"), F.col("probs"))
    return rounded(
        docs.select(
            "doc_id",
            sc.class_probability(F.col("labels"), F.col("probs"), "__label__ai").alias("ai"),
            top["label"].alias("top_label"),
            top["confidence"].alias("top_confidence"),
        )
    )


def _length_scorer():
    def score(texts):
        if any(len(t) % 17 == 0 for t in texts):
            raise ValueError("unlucky length")
        return [(len(t) % 101) / 100 for t in texts]

    return score


@query
def score_documents(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    return scoring.score_documents(docs, _length_scorer).select("doc_id", "ai_probability", "error")


def _length_replier():
    def reply(texts):
        if any(len(t) % 17 == 0 for t in texts):
            raise ValueError("no route")
        return [("Yes", [("Yes", -0.25), ("No", -len(t) % 8 / 4)]) if len(t) % 3 else "maybe no" for t in texts]

    return reply


@query
def score_replies(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    replied = scoring.reply_documents(docs, _length_replier)
    return rounded(replied.select("doc_id", "response", "error", "ai_probability"))


@query
def reply_classification(spark, d):
    docs = src.labelled(spark, d).select("text", "label")
    rows, _summary = classify_by_reply(docs, _length_replier, fresh_path(spark, "replies"))
    full = rows.select("text_full", "label", "response", "extracted", "is_correct")
    return full.withColumn("text_full", F.md5("text_full"))


@query
def cached_predictions(spark, d):
    docs = src.labelled(spark, d).select("text", "label", "source")
    pred = predict_and_cache(docs, _length_scorer, fresh_path(spark, "predictions"), dataset="source")
    return pred.select("text", "true_label", "dataset_name", "ai_probability")


# --- evaluation ------------------------------------------------------------------------


@query
def threshold_grid(spark, d):
    return rounded(evaluate.evaluate_thresholds(src.predictions(spark, d)))


@query
def threshold_grid_combined(spark, d):
    return rounded(evaluate.evaluate_thresholds(src.predictions(spark, d), by=None))


@query
def threshold_cells(spark, d):
    grid = (0.25, 0.5, 0.75)
    binned = evaluate.bin_scores(src.predictions(spark, d), grid)
    cells = evaluate.cross_thresholds(binned, grid)
    return cells.groupBy("threshold", "true_label", "pred").agg(F.sum("n").alias("n"))


def _decided(spark, d, threshold=0.5) -> DataFrame:
    return evaluate.with_decision(src.predictions(spark, d), threshold)


@query
def error_analysis(spark, d):
    return _decided(spark, d).select("doc_id", "true_label", "predicted_label", "ai_probability", "is_correct")


@query
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_decided(spark, d), by=["dataset_name"])


@query
def class_metrics(spark, d):
    return rounded(evaluate.class_metrics(evaluate.confusion_matrix(_decided(spark, d), by=["dataset_name"])))


@query
def overall_metrics(spark, d):
    return rounded(evaluate.overall_metrics(evaluate.confusion_matrix(_decided(spark, d), by=["dataset_name"])))


@query
def classification_report(spark, d):
    return rounded(evaluate.classification_report(evaluate.confusion_matrix(_decided(spark, d))))


@query
def class_summary(spark, d):
    return rounded(evaluate.class_summary(evaluate.confusion_matrix(_decided(spark, d), by=["dataset_name"])))


@query
def mean_confidence(spark, d):
    return rounded(evaluate.mean_confidence(_decided(spark, d), ["dataset_name"]))


@query
def confidence_split(spark, d):
    return rounded(evaluate.confidence_split(_decided(spark, d)))


@query
def prob_stats(spark, d):
    return rounded(evaluate.probability_stats(src.predictions(spark, d), "dataset_name"))


@query
def sample_summary(spark, d):
    p = F.col("ai_probability")
    samples = src.predictions(spark, d).select(
        sc.decide(p).alias("predicted_class"),
        "ai_probability",
        sc.confidence(p, sc.decide(p)).alias("confidence"),
        F.when(F.col("doc_id") % 3 > 0, F.col("true_label")).alias("expected_label"),
    )
    return rounded(evaluate.sample_summary(samples))


@query
def top1_metrics(spark, d):
    return rounded(evaluate.top1_metrics(_decided(spark, d)))


@query
def dataset_counts(spark, d):
    return profile.dataset_counts(src.predictions(spark, d))


@query
def dataset_names(spark, d):
    files = ["/data/part_positive.parquet", "/data/part_NEGATIVE.parquet"]
    named = evaluate.attach_dataset_names(src.named_files(spark, d), files, ["ai news", "recipes"])
    return named.select("doc_id", "dataset_name")


@query
def roc_auc_by_dataset(spark, d):
    return rounded(curves.roc_auc_report(src.predictions(spark, d)))


@query
def roc_auc_overall(spark, d):
    return rounded(curves.roc_auc(src.predictions(spark, d)))


@query
def pr_curve(spark, d):
    return rounded(curves.pr_curve(src.predictions(spark, d)))


@query
def pr_curve_by_dataset(spark, d):
    return rounded(curves.pr_curve(src.predictions(spark, d), ["dataset_name"]))


@query
def optimal_threshold(spark, d):
    return rounded(curves.optimal_threshold(src.predictions(spark, d), 0.95))


@query
def optimal_threshold_by_dataset(spark, d):
    return rounded(curves.optimal_threshold(src.predictions(spark, d), 0.5, ["dataset_name"]))


# --- profile ---------------------------------------------------------------------------


@query
def label_distribution(spark, d):
    return rounded(profile.label_distribution(src.labelled(spark, d)))


@query
def label_distribution_by_source(spark, d):
    return rounded(profile.label_distribution(src.labelled(spark, d), ["source"]))


@query
def imbalance_ratio(spark, d):
    return rounded(profile.imbalance_ratio(src.labelled(spark, d)))


@query
def profile_columns(spark, d):
    return rounded(profile.profile(src.table(spark, d, "documents")))


@query
def profile_approx(spark, d):
    """Sketches instead of exact quantiles; only the exact statistics are compared."""
    stats = profile.profile(src.table(spark, d, "labels"), approx=True)
    return rounded(stats.where(~F.col("stat").isin("25%", "50%", "75%", "unique")))


@query
def value_counts_top5(spark, d):
    top = profile.value_counts(src.table(spark, d, "documents"))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query
def sample_rows(spark, d):
    return profile.sample_rows(src.table(spark, d, "documents"), 3, chars=500, order="doc_id")


# --- keywords --------------------------------------------------------------------------


@query
def distinct_words(spark, d):
    words = F.array_sort(tx.distinct_words(F.col("text")))
    return src.table(spark, d, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query
def document_frequency(spark, d):
    return keywords.document_frequency(src.labelled(spark, d))


def _ratios(spark, d) -> DataFrame:
    return keywords.corpus_keyword_ratios(src.labelled(spark, d))


@query
def keyword_ratio(spark, d):
    return rounded(keywords.rank_keywords(_ratios(spark, d)))


@query
def keyword_discriminative(spark, d):
    return rounded(keywords.discriminative_keywords(_ratios(spark, d), MIN_RATIO, MIN_FREQ))


@query
def keyword_top50(spark, d):
    top = keywords.top_keywords(keywords.discriminative_keywords(_ratios(spark, d), MIN_RATIO, MIN_FREQ))
    return rounded(top.withColumn("rank", F.col("rank").cast("bigint")))


@query
def keyword_stats(spark, d):
    return rounded(keywords.ratio_stats(_ratios(spark, d)))


@query
def keyword_histogram(spark, d):
    return keywords.ratio_histogram(_ratios(spark, d), (0.5, 1, 2, 100))


def _word_tables(spark, d) -> list[DataFrame]:
    docs = src.labelled(spark, d)
    return [keywords.word_frequencies(docs.where(F.col("label") == c)) for c in (1, 0)]


@query
def word_frequency_join(spark, d):
    return rounded(keywords.join_word_frequencies(*_word_tables(spark, d)))


@query
def vocab_intersect(spark, d):
    return keywords.shared_words(src.labelled(spark, d))


# --- splits ----------------------------------------------------------------------------


@query
def split_assign(spark, d):
    docs = src.labelled(spark, d).select("doc_id", "label", "text")
    return split.stratified_split(docs, "label", "doc_id", {"train": 160, "val": 20, "test": 20})


@query
def split_fractions(spark, d):
    docs = src.labelled(spark, d).select("doc_id", "label")
    return split.stratified_split(docs, "label", "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, seed=7)


@query
def split_counts(spark, d):
    return rounded(profile.label_distribution(split_assign(spark, d), ["split"]))


@query
def split_remaining(spark, d):
    return split.remaining(split_assign(spark, d)).select("doc_id", "label")


@query
def combine_shuffled(spark, d):
    docs = src.labelled(spark, d).select("doc_id", "label")
    parts = [docs.where(F.col("label") == c) for c in (1, 0)]
    return split.combine_shuffled(parts, "doc_id")


@query
def union_all(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "source")
    pages = src.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return split.union_all([docs, pages])


@query
def first_k_per_label(spark, d):
    return split.first_k_per_group(src.labelled(spark, d).select("doc_id", "label"), "label", "doc_id", 25)


# --- sequences -------------------------------------------------------------------------


def _digest(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query
def truncate_tokens(spark, d):
    ids = tk.truncate_tokens(F.col("input_ids"), 100)
    return src.token_ids(spark, d).select("doc_id", _digest(ids).alias("ids"))


@query
def mask_labels(spark, d):
    masked = src.token_ids(spark, d).select(
        "doc_id",
        tk.mask_prompt(F.col("input_ids"), [3], [2]).alias("last"),
        tk.mask_prompt(F.col("input_ids"), [3], [2], "first").alias("first"),
    )
    return masked.select(
        "doc_id",
        _digest(F.col("last")).alias("last"),
        _digest(F.col("first")).alias("first"),
        tk.mask_counts(F.col("last"))["masked"].alias("masked"),
    )


@query
def pad_batch(spark, d):
    ids = src.token_ids(spark, d).withColumns(
        {"batch": F.floor(F.col("doc_id") / 16.0), "labels": F.slice("input_ids", 1, F.floor(F.size("input_ids") / 2).cast("int"))}
    )
    padded = sequences.pad_batch(ids, "batch")
    return padded.select("doc_id", _digest(F.col("input_ids")).alias("ids"), _digest(F.col("labels")).alias("labels"))


@query
def answer_position(spark, d):
    masked = src.token_ids(spark, d).select("doc_id", tk.mask_prompt(F.col("input_ids"), [3], [2]).alias("labels"))
    found = masked.select("doc_id", tk.answer_position(F.col("labels"), 3).alias("a"))
    return found.where(F.col("a").isNotNull()).select("doc_id", "a.position", "a.token", "a.true_class")


@query
def chunk_windows(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", tx.whitespace_tokens(F.col("text")).alias("tokens"))
    chunks = sequences.chunk_tokens(docs, size=512, overlap=64)
    return chunks.select(
        "doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.array_join("chunk_tokens", " ").alias("words")
    )


@query
def chunk_vote(spark, d):
    votes = sequences.vote_chunks(src.chunk_predictions(spark, d))
    return rounded(
        votes.select(
            "doc_id", "prediction", "confidence", "num_chunks", "ai_chunks", "used_chunking",
            _digest(F.col("chunk_predictions")).alias("chunk_predictions"),
        )
    )


@query
def chunk_stats(spark, d):
    return rounded(sequences.chunk_stats(src.chunk_predictions(spark, d)))


# --- cost ------------------------------------------------------------------------------


@query
def best_config(spark, d):
    return rounded(cost.best_config(src.throughput_runs(spark, d)))


@query
def engine_speedup(spark, d):
    runs = src.throughput_runs(spark, d)
    return rounded(
        cost.speedup(runs.where(F.col("engine") == "baseline"), runs.where(F.col("engine") == "batched"))
    )


@query
def cost_projection(spark, d):
    return rounded(cost.cost_projection(_with_length(spark, d), src.throughput_runs(spark, d)), 8)


# --- models ----------------------------------------------------------------------------


@query
def class_weights(spark, d):
    return rounded(model.class_weights(src.labelled(spark, d)))


@query
def weight_ratio(spark, d):
    return rounded(model.weight_ratio(model.class_weights(src.labelled(spark, d))))


def _split_docs(spark, d) -> dict[str, DataFrame]:
    docs = src.labelled(spark, d).select("doc_id", "text", "label")
    parts = split.stratified_split(docs, "label", "doc_id", {"train": 0.6, "val": 0.2, "test": 0.2})
    path = sinks.write_parquet(parts, fresh_path(spark, "splits"), "split")
    saved = spark.read.parquet(path)
    return {name: saved.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}


@query
def train_predict(spark, d):
    parts = _split_docs(spark, d)
    fitted = model.train_text_classifier(parts["train"])
    return model.predict(fitted, parts["test"]).drop("text")


@query
def model_reload(spark, d):
    parts = _split_docs(spark, d)
    fitted = model.train_text_classifier(parts["train"])
    threshold = curves.optimal_threshold(
        model.predict(fitted, parts["val"]).withColumnRenamed("label", "true_label"), 0.95
    )
    path = model.save_model(fitted, threshold, fresh_path(spark, "model"))
    loaded, _ = model.load_model(spark, path)
    return model.predict(loaded, parts["test"]).drop("text")


@query
def train_evaluate(spark, d):
    parts = _split_docs(spark, d)
    result = run_pipeline(parts["train"], parts["val"], parts["test"], fresh_path(spark, "trained"))
    return result["grid"]
