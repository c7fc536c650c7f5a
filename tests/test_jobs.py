import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from stayline.fields import FEATURES, OFFER_CALL, SEND_EMAIL
from stayline.operators import outreach, reports, scoring, training
from stayline.plans import jobs
from stayline.plans.catalog import linear_scorer, training_rows
from stayline.session import scratch_path, stored
from stayline.sources import files
from stayline.sources import tables as t
from stayline.streaming import scoring as streaming

BODY = {
    "contract_version": "v1",
    "outreach_options": {"threshold": 0.65, "max_emails": 2, "dry_run": True, "tone": " Witty "},
    "context": {"company_name": " Co ", "from_name": "Me", "from_email": " ME@x.org"},
}


def test_options():
    options, problems = jobs.outreach_options(BODY)
    assert problems == []
    assert (options.company_name, options.tone, options.from_email, options.max_emails) == ("Co", "witty", "me@x.org", 2)
    options, _ = jobs.outreach_options({**BODY, "outreach_options": {}})
    assert (options.threshold, options.max_emails, options.dry_run, options.tone) == (0.65, 50, True, "serious")


def test_all_option_problems_are_reported_together():
    bad = {
        "contract_version": "v2",
        "outreach_options": {"threshold": 2, "max_emails": 51, "dry_run": "yes", "tone": "rude"},
        "context": {"company_name": " ", "from_email": "x"},
    }
    options, problems = jobs.outreach_options(bad)
    assert options is None
    assert [p["field"] for p in problems] == [
        "contract_version",
        "outreach_options.threshold",
        "outreach_options.max_emails",
        "outreach_options.dry_run",
        "outreach_options.tone",
        "context.company_name",
        "context.from_name",
        "context.from_email",
    ]
    assert jobs.outreach_options([])[0] is None
    assert [p["field"] for p in jobs.outreach_options({"contract_version": "v1", "context": 3})[1]][0] == "context"
    assert jobs.outreach_options({**BODY, "outreach_options": {"max_emails": 0}})[1][0]["message"].endswith("greater than 0")


def batch(spark, *rows):
    """Rows of (index, id, email, p)."""
    data = [(i, d, e, None, p, SEND_EMAIL if p and p < 0.6 else OFFER_CALL) for i, d, e, p in rows]
    return spark.createDataFrame(data, "index long, id string, email string, name string, p_churn double, recommended_action string")


# The search itself runs whole in the queries.
SMALL_GRIDS = {
    "Logistic Regression": {"C": [0.1, 1.0]},
    "Decision Tree": {"maxDepth": [5]},
    "Random Forest": {"numTrees": [20], "maxDepth": [10]},
    "Gradient Boosting": {"maxIter": [10], "stepSize": [0.1]},
}

CONFIG = jobs.BatchConfig("Example Co", "Customer Success", "success@example.com", threshold=0.8, max_targets=10)


def test_dry_run_selects_expected_targets(spark):
    rows = batch(
        spark,
        (0, "cust-c", "c@example.com", 0.95),
        (1, "cust-a", "a@example.com", 0.90),
        (2, "cust-b", "b@example.com", 0.30),
        (3, "cust-d", "d@example.com", None),
        (4, "cust-e", None, 0.99),
    )
    report = jobs.outreach_from_batch(rows, CONFIG)
    summary = report.summary.first().asDict()
    assert summary == {"total_rows": 5, "valid_predictions": 5, "selected": 2, "drafted": 2, "sent": 0, "status": "ok"}
    request = report.request.first()
    assert [r["id"] for r in request["recipients"]] == ["cust-a", "cust-c"]
    assert request["send_mode"] == "dry_run" and request["message_prompt"].endswith("2 recipients: cust-a, cust-c.")
    result = report.result.first()
    assert (result["status"], result["send_status"], result["selected_draft"]) == ("dry_run", "skipped", "serious")
    assert result["html"].startswith("<p>Write a retention outreach email")


def test_send_mode_counts_sent(spark):
    rows = batch(spark, (0, "a", "a@x.org", 0.9), (1, "b", "b@x.org", 0.9))
    config = jobs.BatchConfig("Co", "Me", dry_run=False)
    assert jobs.outreach_from_batch(rows, config, send_status="Queued").summary.first()["sent"] == 2
    assert jobs.outreach_from_batch(rows, config, send_status="bounced").summary.first()["sent"] == 0


def test_batch_errors_make_it_partial_or_error(spark):
    rows = batch(spark, (0, "a", "a@x.org", 0.9))
    problems = spark.createDataFrame([("0", "bad")], "id string, message string")
    assert jobs.outreach_from_batch(rows, CONFIG, "partial", problems).summary.first()["status"] == "partial"
    none = jobs.outreach_from_batch(rows.filter("p_churn > 1"), CONFIG, "partial", problems)
    assert none.summary.first()["status"] == "error" and none.request.count() == 0
    assert jobs.outreach_from_batch(rows, CONFIG, "odd").summary.first()["status"] == "partial"
    clean = jobs.outreach_from_batch(rows.filter("p_churn > 1"), CONFIG).summary.first()
    assert (clean["status"], clean["selected"]) == ("ok", 0)


def test_targets_without_address_are_skipped(spark):
    config = jobs.BatchConfig("Co", "Me", threshold=0.5, require_email=False)
    some = jobs.outreach_from_batch(batch(spark, (0, "a", None, 0.9), (1, "b", "b@x.org", 0.8)), config)
    assert some.summary.first()["status"] == "partial" and some.summary.first()["drafted"] == 2
    assert [r["id"] for r in some.request.first()["recipients"]] == ["b"]
    nobody = jobs.outreach_from_batch(batch(spark, (0, "a", None, 0.9)), config)
    assert nobody.summary.first().asDict() == {
        "total_rows": 1, "valid_predictions": 1, "selected": 1, "drafted": 0, "sent": 0, "status": "partial",
    }
    assert {r["stage"] for r in nobody.errors.collect()} == {"payload", "request_build"}


def test_writers_and_picker_are_pluggable(spark):
    def writer(body):
        return lambda df: df.withColumn("draft", F.lit(body))

    writers = {"serious": writer("Subject: x\nSerious."), "witty": writer("Witty."), "concise": writer("Concise.")}
    rows = batch(spark, (0, "a", "a@x.org", 0.9))
    report = jobs.outreach_from_batch(rows, CONFIG, writers=writers, picker=lambda drafts, context: F.lit("Option 2"))
    row = report.result.first()
    assert (row["selected_draft"], row["subject"], row["html"]) == ("witty", "Witty.", "<p>Witty.</p>")
    assert row["draft_serious"] == "Serious."
    broken = jobs.outreach_from_batch(rows, CONFIG, writers={**writers, "witty": writer(" ")})
    assert broken.result.first()["status"] == "error"
    assert broken.summary.first()["status"] == "partial" and broken.summary.first()["drafted"] == 0


def test_bad_config():
    with pytest.raises(ValueError, match="company_name"):
        jobs.BatchConfig(" ", "Me")
    with pytest.raises(ValueError, match="from_email"):
        jobs.BatchConfig("Co", "Me", "nope")


def test_settings_that_cannot_be_used_are_error_rows(spark):
    rows = batch(spark, (0, "a", "a@x.org", 0.9), (1, "b", "b@x.org", None))
    good = {"company_name": "Co", "from_name": "Me", "max_targets": "5", "from_email": " ", "recommended_actions": [" "]}
    assert jobs.outreach_from_batch(rows, good).summary.first()["selected"] == 1
    for odd, stage in (({"from_name": " "}, "config"), ({"max_targets": "many"}, "config"), ({"threshold": "nan"}, "target_selection")):
        report = jobs.outreach_from_batch(rows, {**good, **odd}, "odd")
        assert report.request is None and {r["stage"] for r in report.errors.collect()} == {stage, "batch"}
        summary = report.summary.first()
        assert (summary["status"], summary["total_rows"], summary["valid_predictions"], summary["selected"]) == ("error", 2, 2, 0)


def test_long_lists_become_several_requests(spark):
    rows = spark.range(2500).select(
        F.col("id").alias("index"), F.format_string("c%05d", "id").alias("id"), F.lit("a@x.org").alias("email"), F.lit("x").alias("name"), F.lit(0.9).alias("p_churn"), F.lit(OFFER_CALL).alias("recommended_action"),
    )
    report = jobs.outreach_from_batch(rows, jobs.BatchConfig("Co", "Me", max_targets=20_000))
    requests = report.request.orderBy("request_no").collect()
    assert [len(r["recipients"]) for r in requests] == [1000, 1000, 500]
    assert [i for r in requests for i in r["target_ids"]] == [f"c{i:05d}" for i in range(2500)]
    summary = report.summary.first()
    assert (summary["selected"], summary["drafted"], summary["status"]) == (2500, 2500, "ok")


def test_outreach_from_records(spark, sf_dir):
    options, _ = jobs.outreach_options({**BODY, "outreach_options": {"threshold": 0.5, "max_emails": 5, "dry_run": False}})
    records = t.raw_records(spark, sf_dir)
    dry = jobs.outreach_from_records(records, linear_scorer, options)
    messages = dry.messages.orderBy("rank").collect()
    assert len(messages) == 5 and all(m["subject"].startswith("Write a serious") for m in messages)
    total = dry.summary.first()
    assert total["n_valid"] + total["n_invalid"] == total["n_records"] == 150
    assert (total["n_selected"], total["max_emails"], total["status"]) == (5, 5, "partial")

    log = spark.createDataFrame(
        [(m["id"], None, i > 0, None) for i, m in enumerate(messages)], "id string, status string, ok boolean, status_code int"
    )
    sent = jobs.outreach_from_records(records, linear_scorer, options, send_log=log)
    assert sent.errors.filter("stage = 'send'").count() == 1

    def blank(df):
        return df.withColumn("draft", F.when(F.col("rank") > 1, F.col("prompt")))

    some = jobs.outreach_from_records(records, linear_scorer, options, writer=blank)
    assert some.messages.count() == 4 and some.summary.first()["n_selected"] == 4
    assert some.errors.filter("stage = 'draft'").first()["message"] == "writer returned an empty draft"


def test_send_rules(spark):
    log = spark.createDataFrame(
        [
            (0, None, True, 500), (1, None, False, 202), (2, None, None, 202), (3, None, None, 300),
            (4, "queued", None, None), (5, None, None, None), (6, "failed", True, None),
        ],
        "id int, status string, ok boolean, status_code int",
    )
    got = {r["id"]: (r["sent_ok"], r["send_status"]) for r in reports.with_outcome(log).collect()}
    assert got == {
        0: (True, "sent"), 1: (False, "error"), 2: (True, "sent"), 3: (False, "error"),
        4: (True, "queued"), 5: (False, "sent"), 6: (True, "failed"),
    }
    text_codes = spark.createDataFrame([("abc",), ("204",)], "c string").select(
        reports.send_status(F.lit(None), F.lit(None).cast("boolean"), F.col("c")).alias("s"),
        reports.send_ok(F.lit(None), F.lit(None).cast("boolean"), F.col("c")).alias("o"),
    )
    assert [tuple(r) for r in text_codes.collect()] == [("abc", False), ("sent", True)]


def test_outbox_rejects_a_bad_sender(spark):
    with pytest.raises(ValueError):
        outreach.outbox(spark.range(1), "nobody")


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    folder = scratch_path(spark, "run")
    return folder, jobs.training_run(training_rows(spark, "/root/testdata/sf0.01"), folder, "2024-05-05", "Churned", grids=SMALL_GRIDS, impute_when_scoring=True)


def test_training_run(spark, run):
    folder, done = run
    assert set(done.fitted) == set(SMALL_GRIDS) and done.roc_auc > 0.6
    board = {r["model"]: r["roc_auc"] for r in done.board.collect()}
    assert board[done.name] == max(board.values()) == pytest.approx(done.roc_auc)
    assert done.lift.count() == 5
    row = files.read_metadata(spark, done.metadata_path).first()
    assert (row["trained_at"], row["model_name"]) == ("2024-05-05", done.name)
    assert len(row["feature_schema"]["transformed_columns"]) == 18
    sizes = {n: spark.read.parquet(f"{folder}/{n}").count() for n in ("raw", "train", "test")}
    assert sizes["raw"] == 1500 == sizes["train"] + sizes["test"] and sizes["test"] == 300


def test_saved_model_scores_raw_features(spark, sf_dir, run):
    _, done = run
    rows = t.training_table(spark, sf_dir)
    before = scoring.model_scorer(done.model)(rows).select("CustomerId", F.col("p_churn").alias("a"))
    after = scoring.model_scorer(PipelineModel.load(done.model_path))(rows).select("CustomerId", "p_churn")
    both = before.join(after, "CustomerId")
    assert both.count() == 150 and both.filter("a <> p_churn or p_churn not between 0 and 1").count() == 0


def test_strict_scoring_refuses_missing_numbers(spark, sf_dir, run):
    _, done = run
    rows = stored(training_rows(spark, sf_dir), "rows")
    matrix = jobs.training_matrix(rows, "Churned")
    model = training.estimator("Logistic Regression", {"C": 1.0}, 100).fit(matrix.train)
    strict = scoring.model_scorer(training.with_preparation(matrix.prepared, model))
    loose = scoring.model_scorer(training.with_preparation(matrix.prepared, model, impute=True))
    whole = rows.dropna(subset=FEATURES)
    assert strict(whole).select("CustomerId", "p_churn").exceptAll(loose(whole).select("CustomerId", "p_churn")).count() == 0
    with pytest.raises(Exception, match="(?i)null|invalid"):
        strict(rows.withColumn("Age", F.lit(None).cast("double"))).agg(F.sum("p_churn")).collect()


def test_gate(spark):
    rows = spark.range(400).select(
        F.col("id").alias("CustomerId"), *[F.lit(1.0).alias(f) if f not in ("Geography", "Gender") else F.lit("x").alias(f) for f in FEATURES],
        (F.col("id") % 2).cast("int").alias("Exited"),
    )
    with pytest.raises(ValueError, match="no model reaches"):
        jobs.training_run(rows, scratch_path(spark, "bad"), "2024", grids={"Logistic Regression": {"C": [1.0]}})


def test_logistic_penalty_matches_newton(spark):
    """Balanced weights with regParam 1/(C n) give the minimum of C * summed loss + |w|^2 / 2."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.2] - 1)))).astype(int)
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(a), int(b), float(c)) for a, b, c in zip(x, y, weight)], ["features", "label", "weight"])
    model = training.estimator("Logistic Regression", {"C": 0.1}, 300).fit(df)
    full = np.c_[x, np.ones(300)]
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        gradient = 0.1 * full.T @ (weight * (p - y)) + np.r_[w[:3], 0]
        hessian = 0.1 * (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag([1, 1, 1, 0])
        w -= np.linalg.solve(hessian, gradient)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-3)


def test_grids():
    assert training.settings_grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    assert [len(training.settings_grid(g)) for g in training.FULL_GRIDS.values()] == [2, 6, 4, 4]
    with pytest.raises(ValueError):
        training.estimator("SVM", {}, 1)


def test_earlier_model_wins_ties(spark):
    board = spark.createDataFrame([("b", 2, 0.8), ("a", 1, 0.8), ("c", 3, 0.7)], "model string, position int, roc_auc double")
    assert training.select_model(board).first()["model"] == "a"
    assert not training.select_model(board, 0.9).first()["accepted"]


def test_stream_equals_batch_over_many_micro_batches(spark, sf_dir):
    source, out, sums = (scratch_path(spark, n) for n in ("in", "out", "sums"))
    records = stored(t.raw_records(spark, sf_dir), "records")
    records.repartition(6).write.parquet(source)
    live = streaming.read_records(spark, source, records.schema, files_per_trigger=2)
    results, problems = streaming.score_stream(live, linear_scorer)
    streaming.write_stream(results, out, scratch_path(spark, "s1")).awaitTermination()
    streaming.write_stream(problems, f"{out}-errors", scratch_path(spark, "s2")).awaitTermination()
    streaming.write_summaries(live, sums, scratch_path(spark, "s3")).awaitTermination()
    whole = scoring.score_batch(records, linear_scorer, {"mode": "partial"})
    streamed = spark.read.schema(results.schema).parquet(out)
    assert streamed.exceptAll(whole.results.select(*results.columns)).count() == 0
    assert streamed.count() == whole.results.count() > 0
    assert spark.read.schema(problems.schema).parquet(f"{out}-errors").count() == whole.errors.count()
    counted = spark.read.parquet(sums)
    assert counted.count() == 3 and counted.agg(F.sum("total_records")).first()[0] == 150


def test_replayed_stream_adds_nothing(spark, sf_dir):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    records = t.raw_records(spark, sf_dir)
    records.write.parquet(source)
    for _ in range(2):
        results, _ = streaming.score_stream(streaming.read_records(spark, source, records.schema), linear_scorer)
        streaming.write_stream(results, out, state).awaitTermination()
    assert spark.read.schema(results.schema).parquet(out).groupBy("index").count().filter("count > 1").count() == 0


def contents(tables):
    return [sorted(map(str, table.collect())) for table in (tables.results, tables.errors, tables.summary)]


def test_scored_stream_has_all_tables_of_a_batch_run(spark, sf_dir):
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    records = stored(t.raw_records(spark, sf_dir), "records")
    records.repartition(6).write.parquet(source)
    live = streaming.read_records(spark, source, records.schema, files_per_trigger=2)
    streaming.write_scored(live, linear_scorer, out, scratch_path(spark, "state")).awaitTermination()
    tables, whole = streaming.read_scored(spark, out), scoring.score_batch(records, linear_scorer, {"mode": "partial"})
    assert contents(streaming.StreamTables(tables.results.drop("batch"), tables.errors.drop("batch"), spark.range(0)))[:2] == [
        sorted(map(str, whole.results.select(*tables.results.drop("batch").columns).collect())),
        sorted(map(str, whole.errors.collect())),
    ]
    rows = tables.summary.collect()
    assert sorted(r.batch for r in rows) == [0, 1, 2] and {r.status for r in rows} == {"partial"}
    total = whole.summary.first()
    for name in ("total_records", "valid_records", "invalid_records", "error_count"):
        assert sum(r[name] for r in rows) == total[name]


def test_replayed_batch_changes_nothing(spark, sf_dir):
    out = scratch_path(spark, "out")
    records = stored(t.raw_records(spark, sf_dir), "records")
    write = streaming.batch_writer(linear_scorer, out)
    for number, part in enumerate((records.where("row_index < 70"), records.where("row_index >= 70"), records.limit(0))):
        write(part, number)
    before = contents(streaming.read_scored(spark, out))
    write(records.where("row_index >= 70"), 1)
    assert contents(streaming.read_scored(spark, out)) == before
    summary = {r.batch: (r.total_records, r.status) for r in streaming.read_scored(spark, out).summary.collect()}
    assert summary[2] == (0, "success") and summary[0][0] + summary[1][0] == records.count()


def test_stream_that_fails_half_way_goes_on_where_it_was(spark, sf_dir, monkeypatch):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    records = stored(t.raw_records(spark, sf_dir), "records")
    records.repartition(4).write.parquet(source)

    def run():
        live = streaming.read_records(spark, source, records.schema, files_per_trigger=2)
        streaming.write_scored(live, linear_scorer, out, state).awaitTermination()

    errors, calls = streaming.error_rows, []

    def fails_once(rows, *mode):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return errors(rows, *mode)

    monkeypatch.setattr(streaming, "error_rows", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    tables = streaming.read_scored(spark, out)
    assert tables.results.count() == scoring.score_batch(records, linear_scorer, {"mode": "partial"}).results.count()
    assert tables.results.groupBy("index").count().where("count > 1").count() == 0
    assert sorted(r.batch for r in tables.summary.collect()) == [0, 1]


@pytest.fixture(scope="module")
def small_matrix(spark):
    rows = stored(training_rows(spark, "/root/testdata/sf0.01"), "rows")
    train = jobs.training_matrix(rows, "Churned", "CustomerId").train
    yield stored(train.filter(F.xxhash64("features") % 3 == 0), "matrix")


def plain_auc(pairs):
    """Share of (positive, negative) pairs in the right order, ties a half."""
    good, bad = [p for p, y in pairs if y == 1], [p for p, y in pairs if y != 1]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_short_boosting_is_the_beginning_of_a_long_one(small_matrix):
    def scores(model):
        return [tuple(r) for r in model.transform(small_matrix).select("rawPrediction", "probability", "prediction").collect()]

    long = training.estimator("Gradient Boosting", {"maxIter": 12, "stepSize": 0.1}, 1).fit(small_matrix)
    for rounds in (1, 5, 12):
        short = training.estimator("Gradient Boosting", {"maxIter": rounds, "stepSize": 0.1}, 1).fit(small_matrix)
        assert scores(training.first_rounds(long, rounds)) == scores(short)


@pytest.mark.parametrize(
    "name, values",
    [("Logistic Regression", {"C": [0.001, 1.0]}), ("Decision Tree", {"maxDepth": [2, 4]}), ("Gradient Boosting", {"maxIter": [2, 8], "stepSize": [0.05, 0.2]})],
)
def test_search_agrees_with_plain_refits(small_matrix, name, values):
    grid = training.settings_grid(values)
    found = training.grid_search(name, small_matrix, grid)
    means = []
    for settings in grid:
        folds = []
        for fold in range(3):
            seen, left = small_matrix.filter(F.col("fold") != fold), small_matrix.filter(F.col("fold") == fold)
            model = training.estimator(name, settings, seen.count()).fit(seen)
            folds.append(plain_auc([(r[0][1], r[1]) for r in model.transform(left).select("probability", "label").collect()]))
        means.append(sum(folds) / 3)
    assert found.cv_scores == pytest.approx(means, abs=1e-9)
    best = max(range(len(grid)), key=lambda i: (round(means[i], 12), -i))
    assert found.settings == grid[best] and found.cv_roc_auc == pytest.approx(means[best], abs=1e-9)


def test_large_trees_are_fitted_and_scored_in_turn(small_matrix, monkeypatch):
    grid = training.settings_grid({"maxDepth": [2, 30], "minInstancesPerNode": [1, 2]})
    sizes = {0: 1000, 1: 1000, 2: 900}
    work = [(fold, settings) for fold in range(3) for settings in grid]
    lists = training.batches("Decision Tree", work, sizes, 4000)
    assert [len(x) for x in lists] == [7, 2, 2, 1] and sorted(map(str, sum(lists, []))) == sorted(map(str, work))
    assert training.batches("Random Forest", work, sizes, 1) == [work]

    together = training.grid_search("Decision Tree", small_matrix, grid)
    seen, plain = [], training.side_by_side
    monkeypatch.setattr(training, "HELD_NODES", 1)
    monkeypatch.setattr(training, "side_by_side", lambda models, *rest: seen.append(len(models)) or plain(models, *rest))
    apart = training.grid_search("Decision Tree", small_matrix, grid)
    assert seen == [1] * 12
    assert apart.cv_scores == pytest.approx(together.cv_scores, abs=1e-9) and apart.settings == together.settings


def test_a_forest_of_pieces_scored_in_passes_is_one_forest(small_matrix):
    settings = {"numTrees": 60, "maxDepth": 6}
    made = training.pieces("Random Forest", settings, 42)
    assert [dict(s)["numTrees"] for s, _ in made] == [25, 25, 10] and len({seed for _, seed in made}) == 3
    assert made[:2] == training.pieces("Random Forest", {**settings, "numTrees": 50}, 42)
    assert training.pieces("Random Forest", {"numTrees": 20}, 42) == [((("numTrees", 20),), 42)]
    rows = small_matrix.count()
    forest = training.joined([training.estimator("Random Forest", dict(s), rows, seed).fit(small_matrix) for s, seed in made])
    assert forest.getNumTrees == 60 and len({t.toDebugString for t in forest.trees}) > 50
    path = scratch_path(small_matrix.sparkSession, "forest")
    forest.save(path)
    forest = RandomForestClassificationModel.load(path)
    assert forest.getNumTrees == len(forest.trees) == 60
    plain = [r[0][1] for r in forest.transform(small_matrix).select("probability").collect()]
    assert len(training.in_parts(forest, 100)) > 2
    for most in (100, 10**9):
        parts = training.side_by_side({"a": forest, "b": forest}, small_matrix, ["label"], most).collect()
        for name in "ab":
            assert sorted(r["score"] for r in parts if r["model"] == name) == pytest.approx(sorted(plain), abs=1e-12)


def test_fits_of_forests_keep_the_node_of_each_row_and_rows_stay_whole(small_matrix):
    for name in ("Decision Tree", "Random Forest"):
        assert training.estimator(name, {"maxDepth": 30}, 10).getCacheNodeIds()
    laid = training.laid_out(small_matrix, 3)
    assert laid.rdd.getNumPartitions() == 3
    columns = ["features", "label", "weight", "fold"]
    assert sorted(map(str, laid.collect())) == sorted(map(str, small_matrix.select(*columns).collect()))
    laid.unpersist()


def test_forest_search_grows_shared_pieces_once(small_matrix, monkeypatch):
    fits = []
    plain = training.estimator

    def counted(name, settings, *rest):
        fits.append(dict(settings))
        return plain(name, settings, *rest)

    monkeypatch.setattr(training, "estimator", counted)
    found = training.grid_search("Random Forest", small_matrix, training.settings_grid({"numTrees": [25, 50], "maxDepth": [3]}))
    assert len(found.cv_scores) == 2 and found.model.getNumTrees == found.settings["numTrees"]
    assert len(fits) == 3 * 2 + found.settings["numTrees"] // 25 and {f["numTrees"] for f in fits} == {25}


def test_boosting_settings_share_fits():
    grid = training.settings_grid(training.FULL_GRIDS["Gradient Boosting"])
    assert [grid[j]["maxIter"] for j in training.staged("Gradient Boosting", grid).values()] == [200] * 4
    assert len(set(training.staged("Gradient Boosting", grid).values())) == 2
    assert training.staged("Random Forest", grid) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_a_failing_writer_gives_a_report_and_the_others_go_on(spark):
    rows = batch(spark, (0, "a", "a@x.org", 0.9), (1, "b", "b@x.org", 0.8))

    def fails_at_once(requests):
        raise RuntimeError("no writer today\nTraceback of something")

    def fails_in_a_task(requests):
        return requests.withColumn("draft", F.raise_error(F.lit("out of words")))

    def answers_nothing(requests):
        return requests.drop("prompt")

    fine = dict.fromkeys(("serious", "witty", "concise"), jobs.outreach.echo_writer)
    for bad, message in ((fails_at_once, "no writer today"), (fails_in_a_task, "out of words"), (answers_nothing, "draft")):
        report = jobs.outreach_from_batch(rows, CONFIG, writers={**fine, "witty": bad})
        errors = report.errors.collect()
        assert [r["stage"] for r in errors] == ["sales_manager"] and message in errors[0]["message"]
        result, summary = report.result.first(), report.summary.first()
        assert (result["status"], result["draft_witty"]) == ("error", None) and result["draft_serious"] and result["draft_concise"]
        assert (summary["status"], summary["selected"], summary["drafted"]) == ("partial", 2, 0)
    nobody = jobs.outreach_from_batch(rows.filter("p_churn > 1"), CONFIG, writers={**fine, "witty": fails_at_once})
    assert nobody.errors.count() == 0 and nobody.result.count() == 0


def test_context_and_metadata_of_a_batch(spark):
    rows = batch(spark, (0, "a", "a@x.org", 0.9))
    seen = {}

    def writer(requests):
        seen.update(requests.select("metadata").first()["metadata"])
        return jobs.outreach.echo_writer(requests)

    given = {"company_name": "Co", "from_name": "Me", "metadata": {"run": 7, "send_mode": "odd"}, "context": ["no"]}
    report = jobs.outreach_from_batch(rows, given, writers=dict.fromkeys(("serious", "witty", "concise"), writer))
    assert seen == {"run": "7", "send_mode": "dry_run", "target_ids": '["a"]'}
    assert [(r["stage"], r["message"]) for r in report.errors.collect()] == [
        ("config", "'context' must be a dictionary when provided")
    ]
    assert report.summary.first()["status"] == "partial" and report.result.first()["status"] == "dry_run"
