"""Every operator as a query over the given tables: name -> function(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.fields import FEATURES, MIN_ROC_AUC, MODEL_ORDER, NO_ACTION, NUMERIC_FEATURES, OFFER_CALL, REQUEST_THRESHOLD, SEND_EMAIL, TONES
from stayline.functions import decisions, numbers, text
from stayline.operators import metrics, outreach, preparation, reports, scoring, selection, splits, training, validation
from stayline.plans import jobs
from stayline.session import freeze, scratch_path, stored
from stayline.sources import files
from stayline.sources import tables as t
from stayline.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LABEL, ID = "Churned", "CustomerId"
TRAINED_AT = "2024-01-01T00:00:00+00:00"
COMPANY, SENDER, ADDRESS = "Example Co", "Retention Team", "retention@example.com"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table with the learnable label in place of the given one."""
    return t.scored_customers(spark, sf_dir).drop("p_churn", "Exited")


def split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, training rows and test rows, from a written table since several passes follow."""
    rows = stored(training_rows(spark, sf_dir), "training")
    return rows, *splits.train_test(rows, splits.split_cuts(rows, ID, LABEL))


def linear_scorer(records: DataFrame) -> DataFrame:
    return records.withColumn("p_churn", F.round(t.linear_probability("full"), 6))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# --- Sources and sinks ---------------------------------------------------------


@query
def src_training_csv(spark, sf_dir):
    path = scratch_path(spark, "training_csv")
    t.training_table(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_training_csv(spark, path)


@query
def src_batch_csv(spark, sf_dir):
    records = t.raw_records(spark, sf_dir)
    empty = F.col("row_index") % 41 == 9
    names = [c for c in records.columns if c != "row_index"]
    path = scratch_path(spark, "records_csv")
    records.withColumns({n: F.when(~empty, F.col(n)) for n in names}).orderBy("row_index").select(names).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return files.read_record_csv(spark, path)


@query
def src_batch_json(spark, sf_dir):
    path = scratch_path(spark, "bodies")
    files.record_bodies(t.raw_records(spark, sf_dir)).write.text(path)
    records = files.read_record_bodies(spark, path, extra=("customer_id", "email"))
    return files.with_position(records, files.body_offsets(spark, path))


@query
def src_quoted_csv(spark, sf_dir):
    """Records of which some hold line breaks, quotes and commas in a quoted cell; files stay split among tasks."""
    records = t.raw_records(spark, sf_dir)
    names = [c for c in records.columns if c != "row_index"]
    broken = F.concat(F.col("customer_id"), F.lit('\nc/o "'), "Geography", F.lit('", 2nd floor\r\n'))
    path = scratch_path(spark, "quoted_csv")
    rows = records.withColumn("customer_id", F.when(F.col("row_index") % 5 == 2, broken).otherwise(F.col("customer_id")))
    rows.orderBy("row_index").select(names).write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return files.read_record_csv(spark, path)


@query
def src_json_positions(spark, sf_dir):
    """Entries of bodies of different sizes whose request ids are absent or shared by many."""
    key = F.col("c_custkey")
    entries = F.transform(F.sequence(F.lit(1), key % 4 + 1), lambda i: F.concat(F.lit('{"customer_id": "'), key.cast("string"), F.lit("-"), i.cast("string"), F.lit('"}')))
    request = F.when(key % 3 > 0, F.concat(F.lit('"request_id": '), (key % 7).cast("string"), F.lit(", "))).otherwise("")
    bodies = t.table(spark, sf_dir, "customer").select(key, F.concat(F.lit("{"), request, F.lit('"records": ['), F.array_join(entries, ", "), F.lit("]}")).alias("value"))
    path = scratch_path(spark, "bodies")
    bodies.orderBy("c_custkey").select("value").write.text(path)
    records = files.read_record_bodies(spark, path)
    return files.with_position(records, files.body_offsets(spark, path)).select("request_id", "customer_id", "row_index")


@query
def src_json_errors(spark, sf_dir):
    """Bodies of which some are cut short, blank, without records or with entries that are none: nothing is lost."""
    key = F.col("c_custkey").cast("string")
    whole = F.concat(F.lit('{"request_id": '), key, F.lit(', "records": [{"customer_id": "'), key, F.lit('", "CreditScore": true}'))
    kind = F.col("c_custkey") % 10
    bodies = t.table(spark, sf_dir, "customer").select(
        F.when(kind == 1, whole)
        .when(kind == 2, "")
        .when(kind == 3, F.concat(F.lit('{"request_id": '), key, F.lit("}")))
        .when(kind == 4, F.concat(whole, F.lit(', 5, "text", null]}')))
        .otherwise(F.concat(whole, F.lit("]}")))
        .alias("value")
    )
    path = scratch_path(spark, "bodies")
    bodies.write.text(path)
    records = files.read_record_bodies(spark, path).select(F.concat(F.lit("record, score "), "CreditScore").alias("what"))
    errors = files.read_body_errors(spark, path).select(F.col("message").alias("what"))
    return records.union(errors).groupBy("what").agg(F.count("*").alias("n"))


@query
def sink_tables(spark, sf_dir):
    rows, train, test = split_rows(spark, sf_dir)
    paths = files.write_sets(scratch_path(spark, "sets"), rows, train, test)
    parts = [
        spark.read.parquet(path).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n_rows"),
            F.sum(F.col(LABEL).cast("long")).alias("n_churned"),
            F.sum("CreditScore").alias("credit_total"),
        )
        for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def sink_feature_schema(spark, sf_dir):
    _, train, _ = split_rows(spark, sf_dir)
    prepared = preparation.fit_preparation(train)
    path = scratch_path(spark, "schema")
    schema = files.feature_schema(spark, train, prepared)
    schema.write.json(path)
    return spark.read.schema(schema.schema).json(path)


def fitted_logistic(spark, sf_dir) -> tuple[DataFrame, PipelineModel]:
    rows = stored(training_rows(spark, sf_dir), "training")
    matrix = jobs.training_matrix(rows, LABEL, ID)
    model = training.estimator("Logistic Regression", {"C": 1.0}, matrix.train.count()).fit(matrix.train)
    return rows, training.with_preparation(matrix.prepared, model, impute=True)


@query
def sink_model(spark, sf_dir):
    rows, model = fitted_logistic(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    before = scoring.model_scorer(model)(rows).withColumnRenamed("p_churn", "p_before")
    both = scoring.model_scorer(PipelineModel.load(path))(before)
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("p_churn") == F.col("p_before")).alias("n_same")
    )


@query
def sink_training_metadata(spark, sf_dir):
    _, train, test = split_rows(spark, sf_dir)
    scores = linear_scorer(test)
    values = metrics.metrics_report(scores, LABEL, "p_churn").first().asDict()
    schema = files.feature_schema(spark, train, preparation.fit_preparation(train))
    path = scratch_path(spark, "metadata")
    files.write_metadata(
        files.training_metadata(spark, MODEL_ORDER[0], "models/linear", TRAINED_AT, values, schema), path
    )
    return files.read_metadata(spark, path).select(
        "trained_at",
        "model_name",
        "version",
        "model_path",
        F.round(F.col("metrics")["roc_auc"], 6).alias("roc_auc"),
        F.round(F.col("metrics")["f1"], 6).alias("f1"),
        F.array_join("feature_schema.input_columns", ",").alias("input_columns"),
        F.array_join("feature_schema.transformed_columns", ",").alias("transformed_columns"),
    )


@query
def model_metadata_lookup(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir)
    known = rows.agg(F.count("*").alias("n")).select(
        F.lit("models/a").alias("model_path"),
        F.lit(MODEL_ORDER[0]).alias("model_name"),
        F.concat(F.lit("2.0."), F.col("n").cast("string")).alias("version"),
    )
    by_model = rows.withColumn("model_path", F.when(F.col(ID) % 2 == 0, "models/a").otherwise("models/b"))
    return (
        files.with_model_version(by_model, known)
        .groupBy("model_name", "model_version")
        .agg(F.count("*").alias("n_rows"))
    )


# --- Projections and predicates ---------------------------------------------------


@query
def proj_drop_ids(spark, sf_dir):
    return preparation.drop_ids(t.training_table(spark, sf_dir))


@query
def proj_features(spark, sf_dir):
    return preparation.select_features(t.training_table(spark, sf_dir))


@query
def proj_model_input(spark, sf_dir):
    return preparation.model_input(t.raw_records(spark, sf_dir))


@query
def proj_reindex(spark, sf_dir):
    rows = t.training_table(spark, sf_dir)
    flags = rows.withColumns(
        {"Geography_EUROPE": (F.col("Geography") == "EUROPE").cast("double"), "Gender_BUILDING": (F.col("Gender") == "BUILDING").cast("double")}
    )
    return preparation.align_columns(
        flags, [*NUMERIC_FEATURES, "Geography_ATLANTIS", "Geography_EUROPE", "Gender_BUILDING"]
    )


@query
def filter_usable_predictions(spark, sf_dir):
    return selection.usable(t.batch_results(spark, sf_dir)).select(
        "index", numbers.finite(F.col("p_churn")).alias("p_churn"), "recommended_action"
    )


@query
def filter_allowed_actions(spark, sf_dir):
    results = t.batch_results(spark, sf_dir).select("index", "recommended_action")
    listed = selection.with_actions(results, [f" {SEND_EMAIL} ", "", OFFER_CALL]).withColumn("list", F.lit("two"))
    return listed.unionByName(selection.with_actions(results, []).withColumn("list", F.lit("empty")))


@query
def probability_coerce(spark, sf_dir):
    key = F.col(ID)
    spelled = (
        F.when(key % 5 == 0, None)
        .when(key % 5 == 1, "n/a")
        .when(key % 5 == 2, " 0.25 ")
        .when(key % 5 == 3, "NaN")
        .otherwise(F.col("p_churn").cast("string"))
    )
    rows = t.scored_customers(spark, sf_dir).select(
        key.alias("index"), spelled.alias("churn_probability"), F.lit(0.9).alias("probability")
    )
    return rows.select("index", numbers.probability_source(rows).alias("p"))


@query
def probability_range(spark, sf_dir):
    results = t.batch_results(spark, sf_dir)
    return results.select("index", numbers.unit_probability(results, "p_churn").alias("p"))


# --- Validation ---------------------------------------------------------------------


def checked_records(spark, sf_dir):
    return validation.checked(t.raw_records(spark, sf_dir))


@query
def val_missing(spark, sf_dir):
    records = t.raw_records(spark, sf_dir)
    found = records.select("row_index", F.explode(validation.missing_problems(records)).alias("p"))
    return found.select("row_index", "p.field", "p.message")


@query
def val_numeric(spark, sf_dir):
    return validation.error_rows(checked_records(spark, sf_dir)).filter(F.col("message").startswith("Field '"))


@query
def val_errors(spark, sf_dir):
    return validation.error_rows(checked_records(spark, sf_dir))


@query
def val_valid_rows(spark, sf_dir):
    return validation.valid_rows(checked_records(spark, sf_dir)).select("row_index", "id", *FEATURES)


@query
def val_partial(spark, sf_dir):
    checked = checked_records(spark, sf_dir)
    good = linear_scorer(validation.valid_rows(checked)).select("row_index", "id", F.lit("valid").alias("kind"), "p_churn")
    bad = validation.error_rows(checked).select("row_index", "id", F.lit("error").alias("kind"), "message")
    return good.unionByName(bad, allowMissingColumns=True)


@query
def val_fail_fast(spark, sf_dir):
    checked = checked_records(spark, sf_dir)
    judged = validation.verdicts(checked)
    before = validation.summary(judged, "fail_fast").select("valid_records").scalar()
    scored = validation.valid_rows(checked, "fail_fast", judged).agg(F.count("*").alias("n")).scalar()
    errors = validation.error_rows(checked, "fail_fast", judged)
    return errors.withColumns({"valid_records": before, "n_results": scored})


@query
def val_summary(spark, sf_dir):
    judged = validation.verdicts(checked_records(spark, sf_dir))
    return validation.summaries(judged, {"all": F.lit(True)}).drop("records")


@query
def val_status(spark, sf_dir):
    cases = {
        "all": F.lit(True),
        "good rows": ~F.col("bad"),
        "bad rows": F.col("bad"),
        "no rows": F.col("row_index") < 0,
    }
    found = validation.summaries(validation.verdicts(checked_records(spark, sf_dir)), cases)
    return validation.with_status(found).select("records", "mode", "status")


@query
def record_id_batch(spark, sf_dir):
    key = F.col("row_index")
    records = t.raw_records(spark, sf_dir).select(
        "row_index",
        F.when(key % 3 != 0, F.col("customer_id")).alias("customer_id"),
        F.when(key % 2 != 0, key).alias("row_id"),
    )
    return records.select("row_index", validation.record_id(records).alias("record_id"))


@query
def record_id_outreach(spark, sf_dir):
    key = F.col("row_index")
    records = t.raw_records(spark, sf_dir).select(
        "row_index",
        F.when(key % 5 == 0, "  ").when(key % 5 == 1, F.concat(F.lit(" id-"), key, F.lit("\t"))).alias("id"),
        F.when(key % 3 != 0, F.col("customer_id")).alias("customer_id"),
        F.when(key % 2 != 0, key).alias("row_id"),
    )
    return records.select("row_index", validation.outreach_id(records).alias("record_id"))


# --- Splits ----------------------------------------------------------------------------


@query
def split_stratified(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir).select(ID, LABEL)
    return splits.with_split(rows, splits.split_cuts(rows, ID, LABEL))


@query
def split_unstratified(spark, sf_dir):
    rows = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ID))
    return splits.with_split(rows, splits.split_cuts(rows, ID))


@query
def kfold_stratified(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir).select(ID, LABEL)
    return splits.with_folds(rows, splits.fold_cuts(rows, ID, LABEL))


# --- Preparation -------------------------------------------------------------------------


@query
def prep_median_fit(spark, sf_dir):
    _, train, _ = split_rows(spark, sf_dir)
    medians = preparation.fit_medians(train)
    return spark.createDataFrame(list(medians.items()), "name string, median double")


@query
def prep_median_impute(spark, sf_dir):
    rows, train, _ = split_rows(spark, sf_dir)
    medians = preparation.fit_medians(train)
    prepared = preparation.Preparation(medians, dict.fromkeys(medians, 0.0), dict.fromkeys(medians, 1.0), {})
    return prepared.impute(rows).select(ID, *NUMERIC_FEATURES)


@query
def prep_scaler_fit(spark, sf_dir):
    _, train, _ = split_rows(spark, sf_dir)
    _, means, deviations = preparation.fit_numbers(train)
    fitted = spark.createDataFrame(
        [(n, means[n], deviations[n]) for n in NUMERIC_FEATURES], "name string, mean double, deviation double"
    )
    return rounded(fitted, "mean", "deviation")


@query
def prep_scale(spark, sf_dir):
    rows, train, _ = split_rows(spark, sf_dir)
    prepared = preparation.fit_preparation(train)
    return rounded(prepared.scaled(rows), *NUMERIC_FEATURES).select(ID, *NUMERIC_FEATURES)


@query
def prep_onehot_fit(spark, sf_dir):
    _, train, _ = split_rows(spark, sf_dir)
    levels = preparation.fit_categories(train)
    rows = [(c, i, level, f"{c}_{level}") for c, names in levels.items() for i, level in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, position int, level string, name string")


@query
def prep_onehot(spark, sf_dir):
    rows, train, _ = split_rows(spark, sf_dir)
    prepared = preparation.Preparation({}, {}, {}, preparation.fit_categories(train))
    key = F.col(ID)
    strange = F.when(key % 50 == 0, "ATLANTIS").when(key % 51 != 0, F.col("Geography"))
    return prepared.one_hot(rows.withColumn("Geography", strange)).select(ID, *[f"`{n}`" for n in prepared.names])


@query
def prep_assemble(spark, sf_dir):
    rows, train, _ = split_rows(spark, sf_dir)
    assembled = preparation.fit_preparation(train).assemble(rows)
    return assembled.select(ID, F.posexplode(vector_to_array("features")).alias("position", "value")).select(
        ID, "position", F.round("value", 6).alias("value")
    )


@query
def prep_class_weights(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir).select(LABEL)
    return rounded(preparation.class_weights(rows, LABEL), "weight")


# --- Training ------------------------------------------------------------------------------

def training_facts(spark, sf_dir, search: Callable[[DataFrame], training.Fitted]) -> DataFrame:
    """Fit one model family and report what it saw and whether its test scores pass the gate."""
    rows = stored(training_rows(spark, sf_dir), "training")
    matrix = jobs.training_matrix(rows, LABEL, ID)
    train = matrix.train.persist()
    found = search(train)
    train.unpersist()
    scores = training.side_by_side({found.name: found.model}, matrix.test, [ID, "label"])
    report = metrics.metrics_report(scores, "label", "score", by=["model"])
    counts = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return report.select(
        "model",
        F.lit(found.rows).cast("long").alias("n_train"),
        counts.alias("n_test"),
        (F.col("fn") + F.col("tp")).alias("n_test_churned"),
        F.lit(len(found.cv_scores)).alias("n_settings"),
        (F.col("roc_auc") >= MIN_ROC_AUC).alias("accepted"),
    )


def whole_search(name: str) -> Callable[[DataFrame], training.Fitted]:
    grid = training.settings_grid(training.FULL_GRIDS[name])
    return lambda train: training.grid_search(name, train, grid)


@query
def train_logistic(spark, sf_dir):
    return training_facts(spark, sf_dir, whole_search("Logistic Regression"))


@query
def train_tree(spark, sf_dir):
    return training_facts(spark, sf_dir, whole_search("Decision Tree"))


@query
def train_forest(spark, sf_dir):
    return training_facts(spark, sf_dir, whole_search("Random Forest"))


@query
def train_gbt(spark, sf_dir):
    return training_facts(spark, sf_dir, whole_search("Gradient Boosting"))


@query
def train_grid_search(spark, sf_dir):
    """The whole search of all four families: settings tried, and whether the best recorded one was taken."""
    rows = stored(training_rows(spark, sf_dir), "training")
    train = jobs.training_matrix(rows, LABEL, ID).train.persist()
    found = training.train_models(train)
    train.unpersist()
    facts = [
        (f.name, f.rows, len(f.cv_scores), f.cv_roc_auc == max(f.cv_scores), f.cv_roc_auc >= MIN_ROC_AUC)
        for f in found.values()
    ]
    return spark.createDataFrame(facts, "model string, n_train long, n_settings int, took_best boolean, accepted boolean")


def linear_scores(spark, sf_dir) -> DataFrame:
    """Scores of the fixed linear models side by side, long form."""
    each = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.round(t.linear_probability(name), 6).alias("score"))
            for name in t.LINEAR_MODELS
        ]
    )
    return t.scored_customers(spark, sf_dir).select(ID, F.col(LABEL).alias("label"), F.inline(each))


@query
def model_leaderboard(spark, sf_dir):
    return rounded(training.leaderboard(linear_scores(spark, sf_dir), list(t.LINEAR_MODELS)), "roc_auc")


@query
def model_select(spark, sf_dir):
    return training.select_model(model_leaderboard(spark, sf_dir))


@query
def train_run(spark, sf_dir):
    """A whole run with the full search, as read back from its metadata."""
    run = jobs.training_run(training_rows(spark, sf_dir), scratch_path(spark, "run"), TRAINED_AT, LABEL, ID)
    best = run.board.agg(F.max("roc_auc").alias("best"), F.count("*").alias("n"))
    measured = F.col("metrics")
    return files.read_metadata(spark, run.metadata_path).select(
        "trained_at",
        "version",
        (measured["tn"] + measured["fp"] + measured["fn"] + measured["tp"]).cast("long").alias("n_test"),
        best.select("n").scalar().alias("n_models"),
        (F.abs(measured["roc_auc"] - best.select("best").scalar()) < 1e-9).alias("took_best"),
        (measured["roc_auc"] >= MIN_ROC_AUC).alias("accepted"),
    )


# --- Scoring ----------------------------------------------------------------------------------


@query
def score_model(spark, sf_dir):
    """Every customer scored by a fitted model, checked against its coefficients over the prepared matrix."""
    rows, model = fitted_logistic(spark, sf_dir)
    *prepared, classifier = model.stages
    scored = scoring.with_label(scoring.model_scorer(model)(rows))
    for stage in prepared:
        scored = stage.transform(scored)
    weights = F.array(*[F.lit(float(w)) for w in classifier.coefficients])
    terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    margin = F.aggregate(terms, F.lit(float(classifier.intercept)), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-margin))
    return scored.select(
        ID,
        (F.abs(F.col("p_churn") - p) < 1e-9).alias("p_matches"),
        (F.col("predicted_label") == (F.col("p_churn") >= 0.5).cast("int")).alias("label_matches"),
    )


@query
def score_linear(spark, sf_dir):
    terms = t.linear_terms()
    weights = dict(t.LINEAR_MODELS["full"])
    intercept = weights.pop("intercept")
    rows = t.training_table(spark, sf_dir).withColumns({n: terms[n] for n in weights})
    return rounded(scoring.coefficient_scorer(weights, intercept)(rows), "p_churn").select(ID, "p_churn")


@query
def score_label(spark, sf_dir):
    return scoring.with_label(t.scored_customers(spark, sf_dir)).select(ID, "p_churn", "predicted_label")


@query
def score_batch(spark, sf_dir):
    batch = scoring.score_batch(t.raw_records(spark, sf_dir), linear_scorer, {"mode": "partial"})
    flagged = batch.results.drop("email", "record_id").withColumn("candidate", selection.is_candidate())
    return rounded(flagged, "clv", "net_gain")


def streamed(spark, sf_dir) -> streaming.StreamTables:
    """The raw records as a stream of several micro-batches, scored into its tables."""
    source, out = scratch_path(spark, "stream_in"), scratch_path(spark, "stream_out")
    t.raw_records(spark, sf_dir).repartition(4, "row_index").write.parquet(source)
    records = streaming.read_records(spark, source, spark.read.parquet(source).schema, files_per_trigger=2)
    streaming.write_scored(records, linear_scorer, out, scratch_path(spark, "stream_state")).awaitTermination()
    return streaming.read_scored(spark, out)


@query
def score_stream(spark, sf_dir):
    return rounded(streamed(spark, sf_dir).results.drop("batch"), "clv", "net_gain")


@query
def score_stream_errors(spark, sf_dir):
    return streamed(spark, sf_dir).errors.drop("batch")


@query
def score_stream_summary(spark, sf_dir):
    """The counts of all micro-batches together; each has a row and a status of its own."""
    counts = ["total_records", "valid_records", "invalid_records", "error_count"]
    return streamed(spark, sf_dir).summary.groupBy("mode", "status").agg(*[F.sum(n).alias(n) for n in counts])


# --- Metrics --------------------------------------------------------------------------------------


def label_and_score(spark, sf_dir) -> DataFrame:
    return t.scored_customers(spark, sf_dir).select(ID, LABEL, "p_churn")


def confused(spark, sf_dir) -> DataFrame:
    threshold = metrics.score_threshold("probability")
    return metrics.confusion(label_and_score(spark, sf_dir), LABEL, "p_churn", threshold)


@query
def met_confusion(spark, sf_dir):
    return confused(spark, sf_dir)


@query
def met_accuracy(spark, sf_dir):
    return rounded(metrics.threshold_metrics(confused(spark, sf_dir)).select("accuracy"), "accuracy")


@query
def met_precision_recall_f1(spark, sf_dir):
    names = ("precision", "recall", "f1")
    return rounded(metrics.threshold_metrics(confused(spark, sf_dir)).select(*names), *names)


@query
def met_balanced_accuracy(spark, sf_dir):
    return rounded(metrics.threshold_metrics(confused(spark, sf_dir)).select("balanced_accuracy"), "balanced_accuracy")


def histogram(spark, sf_dir) -> DataFrame:
    return metrics.score_histogram(label_and_score(spark, sf_dir), LABEL, "p_churn")


@query
def met_roc_auc(spark, sf_dir):
    return rounded(metrics.ranking_metrics(histogram(spark, sf_dir)).select("roc_auc"), "roc_auc")


@query
def met_average_precision(spark, sf_dir):
    return rounded(metrics.ranking_metrics(histogram(spark, sf_dir)).select("pr_auc"), "pr_auc")


@query
def met_resolve_k(spark, sf_dir):
    rows = t.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"))
    return rows.select(
        F.col("c_mktsegment").alias("segment"),
        "n_rows",
        *[metrics.rows_at_k(k, F.col("n_rows")).alias(name) for k, name in ((0.01, "k01"), (0.3, "k30"), (1.0, "k100"), (7, "seven"))],
    )


@query
def met_at_k(spark, sf_dir):
    return _lift(spark, sf_dir, [0.1, 1.0, 1, 25])


@query
def met_lift_curve(spark, sf_dir):
    return _lift(spark, sf_dir, [0.01, 0.05, 0.1, 0.2, 0.3])


def _lift(spark, sf_dir, k_values):
    curve = metrics.lift_curve(label_and_score(spark, sf_dir), LABEL, "p_churn", ID, k_values)
    return rounded(curve, "precision_at_k", "recall_at_k", "lift_at_k")


@query
def met_lift_ties(spark, sf_dir):
    """Scores rounded to one digit, so that every cut falls inside a large group of equal scores."""
    coarse = label_and_score(spark, sf_dir).withColumn("p_churn", F.round("p_churn", 1))
    curve = metrics.lift_curve(coarse, LABEL, "p_churn", ID)
    return rounded(curve, "precision_at_k", "recall_at_k", "lift_at_k")


REPORT = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "pr_auc"]


@query
def met_report(spark, sf_dir):
    rows = label_and_score(spark, sf_dir)
    counted = metrics.score_histogram(rows, LABEL, "p_churn")
    report = metrics.metrics_report(rows, LABEL, "p_churn", histogram=counted)
    lift = metrics.lift_curve(rows, LABEL, "p_churn", ID, histogram=counted)
    curve = lift.agg(F.array_sort(F.collect_list(F.struct("k", F.round("lift_at_k", 6).alias("lift")))).alias("curve"))
    lifts = {f"lift_{i}": curve.select(F.col("curve")[i]["lift"]).scalar() for i in range(5)}
    return rounded(report.withColumns(lifts), *REPORT)


@query
def met_by_group(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir).select("Geography", LABEL, "p_churn")
    return rounded(metrics.metrics_report(rows, LABEL, "p_churn", by=["Geography"]), *REPORT)


# --- Decisions ---------------------------------------------------------------------------------------


@query
def dec_clv(spark, sf_dir):
    key = F.col(ID)
    value = decisions.customer_value(
        F.when(key % 9 == 0, float("nan")).otherwise(F.col("Balance")),
        F.when(key % 8 != 0, F.when(key % 7 == 0, -F.col("Tenure")).otherwise(F.col("Tenure"))),
        F.col("EstimatedSalary"),
    )
    return t.training_table(spark, sf_dir).select(ID, F.round(value, 6).alias("clv"))


@query
def dec_action(spark, sf_dir):
    results = t.batch_results(spark, sf_dir)
    p = numbers.unit_probability(results, "p_churn")
    return results.select("index", p.alias("p")).withColumn("action", decisions.recommended_action(F.col("p")))


@query
def dec_action_cost(spark, sf_dir):
    results = t.batch_results(spark, sf_dir).select("index", "recommended_action")
    return decisions.add_action_cost(results, decisions.cost_table(spark))


@query
def dec_net_gain(spark, sf_dir):
    rows = t.decided_customers(spark, sf_dir)
    gain = decisions.net_gain(F.col("p_churn"), F.col("clv"), decisions.action_cost(F.col("recommended_action")))
    return rows.select(ID, F.round(gain, 6).alias("net_gain"))


@query
def dec_results(spark, sf_dir):
    rows = t.scored_customers(spark, sf_dir).withColumn("p_churn", F.when(F.col(ID) % 10 != 3, F.col("p_churn")))
    return rounded(decisions.add_decisions(rows), "clv", "net_gain").select(
        ID, "p_churn", "clv", "recommended_action", "net_gain"
    )


# --- Selection ------------------------------------------------------------------------------------------


@query
def sel_email_candidates(spark, sf_dir):
    return rounded(selection.email_candidates(t.batch_results(spark, sf_dir)), "net_gain")


@query
def sel_email_candidates_capped(spark, sf_dir):
    options = {
        "email_selection": {
            "min_p_churn": "0.35",
            "min_net_gain": 100,
            "max_candidates": 40,
            "allowed_actions": [SEND_EMAIL, NO_ACTION],
        }
    }
    rules = selection.candidate_rules(options)
    return rounded(selection.email_candidates(t.batch_results(spark, sf_dir), rules), "net_gain")


@query
def sel_recipients(spark, sf_dir):
    results = t.batch_results(spark, sf_dir).drop("email")
    return selection.recipients(results, t.raw_records(spark, sf_dir))


def shifted_results(spark, sf_dir) -> DataFrame:
    """Results some of whose positions point behind the last record."""
    results = t.batch_results(spark, sf_dir).drop("email")
    return results.withColumn("index", F.when(F.col("index") % 6 == 1, -F.col("index")).otherwise(F.col("index")))


@query
def sel_recipient_errors(spark, sf_dir):
    return selection.recipient_errors(shifted_results(spark, sf_dir), t.raw_records(spark, sf_dir))


@query
def sel_recipient_errors_positions(spark, sf_dir):
    """Results with indexes as texts: some out of range, some no numbers, some absent."""
    results = t.batch_results(spark, sf_dir).drop("email").withColumn("position", F.col("index"))
    at = F.col("position")
    said = (
        F.when(at % 6 == 1, F.format_string("-%d", at))
        .when(at % 7 == 2, F.format_string("row %d", at))
        .when(at % 5 != 3, F.format_string(" %d ", at))
    )
    return selection.recipient_errors(results.withColumn("index", said), t.raw_records(spark, sf_dir))


def top_targets(spark, sf_dir) -> DataFrame:
    return selection.targets(t.batch_results(spark, sf_dir), 0.6, 50)


@query
def sel_targets(spark, sf_dir):
    return top_targets(spark, sf_dir).select("rank", "id", "index", "email", "name", "p_churn")


@query
def sel_targets_no_email(spark, sf_dir):
    """Many equal probabilities, addresses optional: the tie order decides."""
    results = t.batch_results(spark, sf_dir).withColumn("p_churn", F.round("p_churn", 1))
    return selection.targets(results, 0.3, 200, require_email=False).select("rank", "id", "index", "email", "p_churn")


@query
def sel_targets_resort(spark, sf_dir):
    return selection.relisted(top_targets(spark, sf_dir)).select("position", "rank", "id", "index")


@query
def sel_metadata_merge(spark, sf_dir):
    given = F.create_map(F.lit("index"), F.lit("old"), F.lit("segment"), F.coalesce("name", F.lit("none")))
    results = t.batch_results(spark, sf_dir)
    some = F.when(F.col("index") % 2 == 0, given)
    chosen = selection.targets(results.withColumn("metadata", some), 0.6, 50)
    return chosen.select(
        "rank",
        F.col("metadata")["index"].alias("meta_index"),
        F.col("metadata")["segment"].alias("meta_segment"),
        F.col("metadata")["p_churn"].cast("double").alias("meta_p"),
        F.size("metadata").alias("n_entries"),
    )


# --- Text ---------------------------------------------------------------------------------------------------


@query
def txt_email_normalize(spark, sf_dir):
    return t.raw_records(spark, sf_dir).select("row_index", text.normal_email(F.col("email")).alias("email"))


@query
def txt_email_invalid(spark, sf_dir):
    return t.raw_records(spark, sf_dir).select("row_index", "email").filter(~text.is_email(text.strip(F.col("email"))))


@query
def txt_optional(spark, sf_dir):
    return t.batch_results(spark, sf_dir).select("index", text.strip_or_null(F.col("name")).alias("name"))


@query
def txt_strip_html(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query
def txt_sanitize_body(spark, sf_dir):
    return t.drafts(spark, sf_dir).select("draft_id", text.plain_body(F.col("body")).alias("body"))


@query
def txt_drop_subject_lines(spark, sf_dir):
    return t.drafts(spark, sf_dir).select("draft_id", text.body_without_subject_lines(F.col("body")).alias("body"))


@query
def txt_draft_check(spark, sf_dir):
    return t.drafts(spark, sf_dir).select("draft_id", text.draft_problem(F.col("body")).alias("problem"))


@query
def txt_draft_set_check(spark, sf_dir):
    return (
        t.draft_groups(spark, sf_dir)
        .withColumn("fine", text.draft_problem(F.col("body")) == "ok")
        .groupBy("group_id")
        .agg(F.count("*").alias("n_drafts"), F.bool_and("fine").alias("all_fine"))
        .withColumn("accepted", (F.col("n_drafts") == 3) & F.col("all_fine"))
    )


def draft_columns(df: DataFrame) -> list:
    return [text.normal_draft(F.col(f"draft_{n}")) for n in (1, 2, 3)]


@query
def txt_pick_resolve(spark, sf_dir):
    sets = t.draft_sets(spark, sf_dir)
    return sets.select("group_id", text.chosen_draft(F.col("answer"), draft_columns(sets)).alias("chosen"))


@query
def txt_selected_tone(spark, sf_dir):
    sets = t.draft_sets(spark, sf_dir)
    serious, witty, concise = draft_columns(sets)
    chosen = text.chosen_draft(F.col("answer"), [serious, witty, concise])
    tones = {"serious": serious, "witty": witty, "concise": concise}
    return sets.select("group_id", text.selected_tone(chosen, tones).alias("tone"))


@query
def txt_subject(spark, sf_dir):
    return t.drafts(spark, sf_dir).select("draft_id", text.subject_line(F.col("body"), COMPANY).alias("subject"))


@query
def txt_html_body(spark, sf_dir):
    return t.drafts(spark, sf_dir).select("draft_id", text.html_body(F.col("body")).alias("html"))


@query
def txt_prompt_batch(spark, sf_dir):
    listed = outreach.normal_recipients(selection.relisted(top_targets(spark, sf_dir)))
    return outreach.batch_prompt(listed, SENDER, COMPANY).drop("request_no")


@query
def txt_prompt_row(spark, sf_dir):
    rows = selection.above_threshold(t.batch_results(spark, sf_dir), 0.0)
    found = rows.withColumns({"id": validation.outreach_id(rows, "index"), "email": text.normal_email(F.col("email"))})
    asked = outreach.with_prompts(found.filter(F.col("email").isNotNull()), "witty", COMPANY, SENDER)
    return asked.select("index", "prompt")


@query
def txt_context_block(spark, sf_dir):
    rows = t.batch_results(spark, sf_dir)
    given = F.create_map(F.lit("company_name"), F.lit("Old Co"), F.lit("name"), F.col("name"), F.lit("action"), F.col("recommended_action"))
    context = text.merged_context(F.when(F.col("index") % 3 != 0, given), {"company_name": f" {COMPANY} ", "from_name": " ", "from_email": None})
    return rows.select("index", text.with_context(F.lit(" Write to them. "), context).alias("prompt"))


@query
def txt_picker_prompt(spark, sf_dir):
    """Three drafts to choose from, with context keys that are blank, padded or alike after trimming."""
    rows = t.batch_results(spark, sf_dir)
    again = F.when(F.col("index") % 4 == 0, " again ")
    context = F.create_map(F.lit(" name "), F.col("name"), F.lit("  "), F.lit("no key"), F.lit("action"), F.col("recommended_action"), F.lit("name"), again)
    drafts = [F.lit("First draft."), F.concat(F.lit("Second draft "), F.col("index").cast("string")), F.lit("Third draft.")]
    return rows.select("index", text.picker_prompt(drafts, context).alias("prompt"))


# --- Outreach and reports ---------------------------------------------------------------------------------------


@query
def out_recipients(spark, sf_dir):
    return outreach.normal_recipients(t.batch_results(spark, sf_dir)).select("index", "id", "email", "name", "skipped")


@query
def out_payload(spark, sf_dir):
    chosen = selection.targets(t.batch_results(spark, sf_dir), 0.6, 50, require_email=False)
    listed = freeze(outreach.normal_recipients(selection.relisted(chosen)))
    request = outreach.payload(listed, SENDER, COMPANY, from_email=ADDRESS).drop("request_no")
    return request.select(
        "company_name", "from_name", "message_prompt", "from_email", "tone_policy", "send_mode", F.posexplode("recipients").alias("place", "r")
    ).select(
        *[c for c in request.columns if c != "recipients"],
        "place",
        F.col("r.id").alias("id"),
        F.col("r.email").alias("email"),
        F.col("r.name").alias("name"),
        F.col("r.metadata")["index"].alias("meta_index"),
    )


def drafted_recipients(spark, sf_dir) -> DataFrame:
    """Recipients with drafts, every fifth of which is blank."""
    found = selection.recipients(t.batch_results(spark, sf_dir), t.raw_records(spark, sf_dir))
    asked = outreach.with_prompts(found, "serious", COMPANY, SENDER).withColumn(
        "context", outreach.context_of(COMPANY, SENDER, ADDRESS)
    )
    written = outreach.echo_writer(asked)
    return written.withColumn("draft", F.when(F.col("rank") % 5 == 0, "  \n").otherwise(F.col("draft")))


@query
def out_outbox(spark, sf_dir):
    messages = outreach.draft_rows(drafted_recipients(spark, sf_dir), COMPANY)
    return outreach.outbox(messages, ADDRESS, html=True)


@query
def out_draft_rows(spark, sf_dir):
    return outreach.drafts_and_errors(drafted_recipients(spark, sf_dir), COMPANY)


@query
def rep_errors_union(spark, sf_dir):
    stages = {
        "batch_validation": validation.error_rows(checked_records(spark, sf_dir)).select("row_index", "id", "field", "message"),
        "targeting": sel_recipient_errors(spark, sf_dir).drop("stage"),
        "draft": outreach.draft_errors(drafted_recipients(spark, sf_dir)).drop("stage"),
        "send": reports.send_errors(t.send_log(spark, sf_dir)).drop("stage"),
    }
    return reports.errors_by_stage(stages)


@query
def rep_send_outcome(spark, sf_dir):
    return reports.with_outcome(t.send_log(spark, sf_dir)).select("id", "sent_ok")


@query
def rep_send_status(spark, sf_dir):
    return reports.with_outcome(t.send_log(spark, sf_dir)).select("id", "send_status")


@query
def rep_send_summary(spark, sf_dir):
    return reports.send_summary(t.send_log(spark, sf_dir))


def record_options() -> jobs.OutreachOptions:
    return jobs.OutreachOptions(COMPANY, SENDER, ADDRESS, max_emails=20)


@query
def rep_outreach_summary(spark, sf_dir):
    records = t.raw_records(spark, sf_dir)
    batch = scoring.score_batch(records, linear_scorer, {"mode": "partial"})
    chosen = selection.recipients(batch.results, None, REQUEST_THRESHOLD, 20)
    return reports.outreach_summary(batch.summary, chosen, REQUEST_THRESHOLD, 20, True)


@query
def rep_outreach_status(spark, sf_dir):
    per_segment = (
        validation.checked(t.raw_records(spark, sf_dir))
        .groupBy("Geography")
        .agg(F.sum("n_problems").alias("n_errors"), F.count_if(~F.col("bad")).alias("n_valid"))
    )
    return per_segment.select("Geography", reports.outreach_status(F.col("n_errors"), F.col("n_valid")).alias("status"))


def runs_by_segment(spark, sf_dir) -> DataFrame:
    """One outreach run per region: rows, usable rows, selected, rows without an address."""
    rows = t.batch_results(spark, sf_dir).join(
        t.training_table(spark, sf_dir).select(F.col(ID).alias("index"), "Geography"), "index"
    )
    p = numbers.unit_probability(rows, "p_churn")
    usable = numbers.finite(F.col("p_churn")).isNotNull() | text.strip_or_null(F.col("recommended_action")).isNotNull()
    return rows.groupBy("Geography").agg(
        F.count("*").alias("n"),
        F.count_if(usable).alias("n_usable"),
        F.count_if(p >= 0.9).alias("n_selected"),
        F.count_if((p >= 0.9) & text.normal_email(F.col("email")).isNull()).alias("n_errors"),
    )


@query
def rep_run_summary(spark, sf_dir):
    mode = F.when(F.col("Geography") > "ASIA", "send").otherwise("dry_run")
    outcome = F.when(F.col("Geography") == "EUROPE", "Error").otherwise("sent")
    return runs_by_segment(spark, sf_dir).select(
        "Geography",
        *reports.run_summary(F.col("n"), F.col("n_usable"), F.col("n_selected"), outcome, mode, F.lit("Queued")),
    )


@query
def rep_run_status(spark, sf_dir):
    return runs_by_segment(spark, sf_dir).select(
        "Geography", reports.run_status(F.col("n_errors"), F.col("n_selected")).alias("status")
    )


@query
def out_from_batch(spark, sf_dir):
    config = jobs.BatchConfig(
        COMPANY, SENDER, ADDRESS, threshold=0.6, max_targets=30, recommended_actions=[OFFER_CALL], require_email=False
    )
    report = jobs.outreach_from_batch(t.batch_results(spark, sf_dir), config)
    made = report.result
    extra = {n: made.select(n).scalar() for n in ("selected_draft", "subject", "send_status")}
    n_errors = report.errors.agg(F.count("*").alias("n")).scalar()
    return report.summary.withColumns({**extra, "n_errors": n_errors})


@query
def out_writer_failure(spark, sf_dir):
    def away(requests):
        raise RuntimeError("writer is away")

    settings = {
        "company_name": COMPANY,
        "from_name": SENDER,
        "from_email": ADDRESS,
        "threshold": 0.6,
        "max_targets": 30,
        "recommended_actions": [OFFER_CALL],
        "require_email": False,
        "context": "none",
        "metadata": ["none"],
    }
    writers = {**dict.fromkeys(TONES, outreach.echo_writer), TONES[0]: away}
    report = jobs.outreach_from_batch(t.batch_results(spark, sf_dir), settings, writers=writers)
    found = report.errors.groupBy("stage", "message").agg(F.count("*").alias("n"))
    run = {n: report.summary.select(n).scalar() for n in ("status", "selected", "drafted", "sent")}
    drafts = {f"n_{tone}": report.result.agg(F.count(f"draft_{tone}").alias("n")).scalar() for tone in TONES}
    return found.withColumns({**run, **drafts})


@query
def out_from_records(spark, sf_dir):
    report = jobs.outreach_from_records(t.raw_records(spark, sf_dir), linear_scorer, record_options())
    n_errors = report.errors.agg(F.count("*").alias("n")).scalar()
    return report.summary.withColumn("n_errors", n_errors)
