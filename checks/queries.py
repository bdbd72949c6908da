"""Registered queries: name -> callable (spark, sf_dir) -> DataFrame."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tiebreak.functions.rounding import exact_round
from tiebreak.operators import compare, evaluation, explore, facts, fixtures, matches as mt, model_selection as ms
from tiebreak.operators import names, scoring, standings as st, team_features as tf, training as tr
from tiebreak.operators.bracket import playoff_seeds
from tiebreak.operators.head_to_head import attach_head_to_head, head_to_head_record, pair_records, pair_records_point_in_time
from tiebreak.plans.forecast import forecast, history
from tiebreak.plans.live import live_feed
from tiebreak.plans.training import fit, predictions, prepare
from tiebreak.schemas import FEATURE_COLS, LABEL_COL
from tiebreak.session import checkpoint_root, materialize, scratch_path
from tiebreak.sources import feed as feed_source
from tiebreak.sources.models import ModelBundle, load_bundle, load_or_train, save_bundle
from tiebreak.sources.tables import load_matches, normalize_columns, read_table, write_observed, write_table
from tiebreak.streaming.feed_state import start_feed_state
from tiebreak.streaming.feed_stream import compact_feed, feed_stream, read_deduped, read_latest, start_feed_dedup

from . import derived as d

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources and sinks ------------------------------------------------------

@query
def scan_csv_roundtrip(spark, sf):
    """Deliveries land as CSV with untidy headers; the loader sniffs and converts them."""
    path = scratch_path(spark, "deliveries") + ".csv"
    raw = d.deliveries(spark, sf)
    untidy = raw.toDF(*[" " + c.replace("_", " ").title() for c in raw.columns])
    untidy.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    schema = ", ".join(f"`{u}` {t.split()[1]}" for u, t in zip(untidy.columns, d.DELIVERY_SCHEMA.split(",")))
    return load_matches(spark, [path + ".missing", path], d.DELIVERY_ORDER, schema)


@query
def normalize_columns_(spark, sf):
    raw = d.table(spark, sf, "customer")
    untidy = raw.select(F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Customer Name"),
                        F.col("c_mktsegment").alias("SEGMENT"))
    return normalize_columns(untidy)


@query
def matches_passthrough(spark, sf):
    """Match-level input: only missing winners go."""
    c = d.contests(spark, sf).selectExpr(
        "mid as match_id", "yr as season", "home as team1", "away as team2",
        "case when order_status = 'P' then null else away end as winner",
        "case when mid % 500 = 0 then 'Final' else 'League' end as stage")
    return mt.matches_from_table(c)


@query
def training_schema_default(spark, sf):
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    old = rows.drop("t1_h2h_win_rate")
    return tr.with_defaults(old, tr.TRAINING_DEFAULTS).select("match_id", "t1_win_rate", "t1_h2h_win_rate")


@query
def feed_parse(spark, sf):
    paths = d.write_feed_pages(spark, sf)
    return feed_source.read_feed(spark, {"current": paths["current"]})


@query
def feed_union(spark, sf):
    return feed_source.read_feed(spark, d.write_feed_pages(spark, sf))


@query
def feed_winner_lookup(spark, sf):
    won = feed_source.read_feed(spark, d.write_feed_pages(spark, sf)).where("winner <> ''")
    return won.select("endpoint_no", "page_no", "team1", "team2", "winner")


@query
def training_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "training")
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    write_table(rows, path, "csv")
    return read_table(spark, path, rows.schema, "csv").select(rows.columns)


# ---- deliveries to matches --------------------------------------------------

@query
def match_first_row(spark, sf):
    return mt.first_row_per_match(d.deliveries(spark, sf), d.DELIVERY_ORDER)


@query
def innings1_sides(spark, sf):
    return mt.innings_sides(d.deliveries(spark, sf), d.DELIVERY_ORDER)


@query
def match_sides_left_join(spark, sf):
    balls = d.deliveries(spark, sf)
    info = mt.first_row_per_match(balls, d.DELIVERY_ORDER)
    joined = mt.match_sides(info, mt.innings_sides(balls, d.DELIVERY_ORDER))
    return joined.select("match_id", "season", "team1", "team2", "match_won_by", "stage")


@query
def match_grain(spark, sf):
    return mt.match_grain(d.deliveries(spark, sf), d.DELIVERY_ORDER, ["season", "match_won_by", "stage"])


@query
def team_universe(spark, sf):
    return mt.team_universe(d.matches(spark, sf))


@query
def winner_column_overlap(spark, sf):
    balls = d.deliveries(spark, sf)
    grain = mt.match_grain(balls, d.DELIVERY_ORDER, ["match_won_by", "win_outcome"])
    return mt.winner_column_overlap(grain, mt.team_universe(balls, mt.SIDES))


def _grain(spark, sf):
    return mt.match_grain(d.deliveries(spark, sf), d.DELIVERY_ORDER)


@query
def season_parse(spark, sf):
    grain = _grain(spark, sf).withColumn("season_text", F.col("season"))
    return mt.with_season_number(grain).select("match_id", "season_text", "season")


@query
def drop_missing_sides(spark, sf):
    return mt.drop_missing_sides(_grain(spark, sf)).select("match_id", "team1", "team2")


@query
def drop_undecided(spark, sf):
    return mt.drop_undecided(_grain(spark, sf), "match_won_by").select("match_id", "match_won_by")


@query
def match_projection(spark, sf):
    grain = mt.with_season_number(_grain(spark, sf)).drop("city")
    return mt.match_projection(grain, "match_won_by")


@query
def deliveries_to_matches(spark, sf):
    """The whole converter, the winner column resolved from the data."""
    return mt.deliveries_to_matches(d.deliveries(spark, sf), d.DELIVERY_ORDER)


@query
def matches_sorted(spark, sf):
    return mt.sorted_matches(d.matches(spark, sf)).select("season", "match_id", "winner")


@query
def conversion_summary(spark, sf):
    summary = mt.conversion_summary(d.matches(spark, sf))
    return summary.select("matches", F.array_join("seasons", ",").alias("seasons"))


# ---- descriptive aggregates -------------------------------------------------

@query
def dataset_profile(spark, sf):
    return explore.dataset_profile(d.matches(spark, sf))


@query
def preview_head(spark, sf):
    return explore.preview(d.matches(spark, sf))


@query
def champions_last_match(spark, sf):
    return explore.champions_last_match(d.matches(spark, sf))


@query
def champions_final_stage(spark, sf):
    return explore.champions(d.matches(spark, sf))


@query
def title_counts(spark, sf):
    return explore.title_counts(explore.champions(d.matches(spark, sf)))


@query
def toss_impact(spark, sf):
    return explore.toss_impact(d.matches(spark, sf))


@query
def toss_decision_counts(spark, sf):
    return explore.toss_decision_counts(d.matches(spark, sf))


@query
def toss_bat_field(spark, sf):
    return explore.toss_bat_field(d.matches(spark, sf))


@query
def all_time_wins_top10(spark, sf):
    return explore.all_time_wins(d.matches(spark, sf))


@query
def matches_per_season(spark, sf):
    return explore.matches_per_season(d.matches(spark, sf))


@query
def win_rate_leaderboard(spark, sf):
    return explore.win_rate_leaderboard(tf.team_features(d.stored_matches(spark, sf))).select("team", "win_rate")


@query
def champions_desc(spark, sf):
    return explore.champions_newest_first(explore.champions(d.matches(spark, sf)))


@query
def percent_labels(spark, sf):
    rates = ["win_rate", "recent_win_rate", "toss_win_rate", "toss_to_win_rate"]
    labelled = explore.with_percent_labels(tf.team_features(d.stored_matches(spark, sf)), rates)
    return labelled.select("team", *[f"{r}_label" for r in rates])


# ---- team features ----------------------------------------------------------

@query
def team_features_cutoff(spark, sf):
    return tf.team_features(d.stored_matches(spark, sf), cutoff=1999)


@query
def team_match_sides(spark, sf):
    return facts.team_sides(d.matches(spark, sf), ["match_id", "season", "winner"])


def _features(spark, sf):
    return tf.team_features(d.stored_matches(spark, sf))


@query
def team_win_rate(spark, sf):
    return _features(spark, sf).select("team", "win_rate", "total_matches")


@query
def team_recent_form(spark, sf):
    return _features(spark, sf).select("team", "recent_win_rate")


@query
def team_titles(spark, sf):
    return _features(spark, sf).select("team", "titles")


@query
def team_toss_rate(spark, sf):
    return _features(spark, sf).select("team", "toss_win_rate")


@query
def team_toss_conversion(spark, sf):
    return _features(spark, sf).select("team", "toss_to_win_rate")


@query
def team_seasons_played(spark, sf):
    return _features(spark, sf).select("team", "seasons_played")


@query
def team_features_rounded(spark, sf):
    return tf.rounded_features(_features(spark, sf))


@query
def team_features_all(spark, sf):
    return _features(spark, sf)


@query
def last_n_seasons(spark, sf):
    return facts.last_seasons(d.matches(spark, sf))


def _point_in_time(m, keys=()):
    duels = materialize(facts.duel_facts(m, keys), "duels")
    team_facts = facts.team_season_facts(duels, explore.champions(m, keys), keys)
    return tf.team_features_point_in_time(team_facts, facts.season_index(duels, keys), keys)


@query
def team_features_point_in_time(spark, sf):
    return _point_in_time(d.stored_matches(spark, sf))


# ---- head to head -----------------------------------------------------------

@query
def h2h_win_rate(spark, sf):
    """Every ordered pair of the league's roster."""
    m = d.stored_matches(spark, sf)
    valid = st.teams_present(d.roster(spark), mt.team_universe(m))
    legs = st.both_legs(st.round_robin(valid))
    return attach_head_to_head(legs, pair_records(m)).select("team1", "team2", "t1_h2h_win_rate")


@query
def h2h_record(spark, sf):
    m = d.stored_matches(spark, sf)
    valid = st.teams_present(d.roster(spark), mt.team_universe(m))
    return head_to_head_record(st.round_robin(valid).select("team1", "team2"), pair_records(m))


@query
def h2h_meetings(spark, sf):
    return pair_records(d.matches(spark, sf)).select("side_a", "side_b", "meetings")


@query
def h2h_point_in_time(spark, sf):
    pair_facts = facts.pair_season_facts(facts.duel_facts(d.matches(spark, sf)))
    past = pair_records_point_in_time(pair_facts)
    rate = F.when(F.col("meetings") > 0, F.col("a_wins") / F.col("meetings")).otherwise(0.5)
    return past.select("season", "side_a", "side_b", rate.alias("a_win_rate"))


# ---- training set -----------------------------------------------------------

@query
def training_start_season(spark, sf):
    """Rows per season when training may start before the first season with a past."""
    rows = tr.training_rows(d.stored_matches(spark, sf), start=1995)
    return rows.groupBy("season").agg(F.count("*").alias("matches"))


@query
def training_feature_join(spark, sf):
    m = d.stored_matches(spark, sf)
    joined = tr.attach_team_features(
        tr.from_season(m, d.START_SEASON).select("match_id", "season", "team1", "team2"), _point_in_time(m),
        by=("season",))
    return joined.select("match_id", "season", "team1", "team2", "t1_win_rate", "t1_titles", "t1_seasons",
                         "t2_win_rate", "t2_titles", "t2_seasons")


@query
def training_dropped_new_teams(spark, sf):
    dropped = tr.dropped_matches(d.stored_matches(spark, sf), d.START_SEASON)
    return dropped.select("match_id", "season", "team1", "team2")


@query
def training_toss_label(spark, sf):
    return tr.with_label(d.matches(spark, sf)).select("match_id", "toss_winner_is_t1", LABEL_COL)


@query
def training_rows(spark, sf):
    return tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))


@query
def training_rows_rounded(spark, sf):
    return tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, digits=4, keep=("match_id",))


@query
def label_balance(spark, sf):
    return tr.label_balance(tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON))


# ---- model selection and evaluation -----------------------------------------

# an order key both engines can compute
SPLIT_RANGE = 104729


def _keyed_training(spark, sf):
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    rows = rows.withColumn("shuffle_key", (F.col("match_id") * 7919 + 42) % SPLIT_RANGE)
    return materialize(rows, "training")


def _split(spark, sf):
    return ms.stratified_split(_keyed_training(spark, sf), ["match_id"], key_range=SPLIT_RANGE)


def _stub_scored(rows):
    """Predictions of the closed-form scorer, and of a rule that always says 1."""
    p1 = scoring.linear_scorer(rows)
    return p1.withColumns({"prediction": (F.col("p1") >= 0.5).cast("int"), "baseline": F.lit(1)})


@query
def feature_vector(spark, sf):
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    values = ms.feature_vector(rows).select("match_id", vector_to_array("features").alias("v"))
    return values.select("match_id", *[F.col("v")[i].alias(f"v{i}") for i in range(len(FEATURE_COLS))])


@query
def stratified_split_counts(spark, sf):
    return _split(spark, sf).groupBy(LABEL_COL, "is_train").agg(F.count("*").alias("matches"))


@query
def stratified_split(spark, sf):
    return _split(spark, sf).select("match_id", LABEL_COL, "is_train")


@query
def stratified_folds(spark, sf):
    folds = ms.stratified_folds(_keyed_training(spark, sf), ["match_id"], key_range=SPLIT_RANGE)
    return folds.select("match_id", LABEL_COL, "fold")


@query
def season_forward_split(spark, sf):
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    return ms.season_forward_split(rows, 2001).groupBy("is_train").agg(F.count("*").alias("matches"))


@query
def accuracy(spark, sf):
    return evaluation.accuracy(_stub_scored(_split(spark, sf).where("NOT is_train")))


@query
def cv_mean_std(spark, sf):
    folds = ms.stratified_folds(_keyed_training(spark, sf), ["match_id"], key_range=SPLIT_RANGE)
    per_fold = evaluation.accuracy(_stub_scored(folds), by=["fold"])
    return evaluation.cv_mean_std(per_fold).select(
        exact_round(F.col("cv_mean"), 9).alias("cv_mean"), exact_round(F.col("cv_std"), 9).alias("cv_std"))


@query
def classification_report(spark, sf):
    return evaluation.classification_report(_stub_scored(_split(spark, sf).where("NOT is_train")))


@query
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_stub_scored(_split(spark, sf).where("NOT is_train")))


@query
def model_comparison(spark, sf):
    return evaluation.model_comparison(_stub_scored(_split(spark, sf).where("NOT is_train")), "baseline", "prediction")


def _train_test(spark, sf):
    rows = tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON, keep=("match_id",))
    split = prepare(materialize(rows, "training"))
    return split.where("is_train"), split.where("NOT is_train")


# the smallest tree count of the reference's grid, with its middle depth and rate
TREES = {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1}
_models = {}


def _fitted(spark, sf):
    """Train and test rows, forest and boosted trees; fitted once per application and input."""
    key = spark.sparkContext.applicationId, sf
    if key not in _models:
        train, test = _train_test(spark, sf)
        _models[key] = train, test, fit(ms.random_forest(), train), fit(ms.boosted_trees(TREES), train)
    return _models[key]


def _holdout(scored):
    """Rows of the hold-out, and whether the accuracy clears the bar of a useful model."""
    right = (F.col("prediction") == F.col(LABEL_COL)).cast("int")
    return scored.agg(F.count("*").alias("holdout_rows"), (F.avg(right) > 0.55).alias("useful"))


@query
def rf_baseline_accuracy(spark, sf):
    train, test = _train_test(spark, sf)
    return _holdout(fit(ms.random_forest(), train).transform(test))


@query
def gbt_accuracy(spark, sf):
    train, test = _train_test(spark, sf)
    return _holdout(fit(ms.boosted_trees(TREES), train).transform(test))


@query
def fitted_model_comparison(spark, sf):
    """Forest and boosted trees on the same hold-out rows; the gain is the difference."""
    _, test, forest, boosted = _fitted(spark, sf)
    c = evaluation.model_comparison(predictions(test, baseline=forest, model=boosted), "baseline", "model")
    gain = (F.col("model_accuracy") - F.col("baseline_accuracy")) * 100
    return c.select((F.col("baseline_accuracy") > 0.55).alias("baseline_useful"), (F.col("model_accuracy") > 0.55).alias("model_useful"),
                    (F.abs(F.col("improvement_points") - gain) < 1e-6).alias("gain_fits"))


# the shape of the quick grid, 16 combinations, with a tenth of its trees: a fit of the quick grid itself takes minutes
SEARCH_GRID = {"n_estimators": [10, 20], "max_depth": [2, 3], "learning_rate": [0.1, 0.2], "subsample": [0.8, 1.0]}


def _fold_vectors(spark, sf, folds):
    """Training vectors with their folds, stored, and the hold-out rows."""
    checkpoint_root(spark)
    train, test = _train_test(spark, sf)
    return materialize(ms.feature_vector(ms.stratified_folds(train, ["match_id"], folds=folds)), "vectors"), test


@query
def random_search_table(spark, sf):
    """Five of sixteen combinations, five folds each, on all training rows: what must hold of their scores."""
    vectors, _ = _fold_vectors(spark, sf, 5)
    found = ms.random_search(vectors, SEARCH_GRID, n_iter=5, folds=5, parallelism=8)
    chosen = F.lit(True)
    for name, value in found.best_params.items():
        chosen = chosen & (F.col("params")[name] == str(value))
    mean, rows = F.col("mean_accuracy"), vectors.count()
    return found.table.agg(
        F.lit(rows).cast("bigint").alias("train_rows"), F.count("*").alias("combinations"), F.count_distinct(F.to_json("params")).alias("different"),
        F.bool_and((mean >= 0) & (mean <= 1) & (F.col("std_accuracy") >= 0)).alias("in_range"),
        (F.max(mean) > 0.55).alias("useful"), (F.max(F.when(chosen, mean)) == F.max(mean)).alias("best_chosen"))


@query
def refit_best(spark, sf):
    """How far the best model of a search is from a fit of its parameters on all training rows: not at all."""
    vectors, test = _fold_vectors(spark, sf, 2)
    found = ms.random_search(vectors, SEARCH_GRID, n_iter=2, folds=2, parallelism=4)
    direct = ms.boosted_trees(found.best_params).fit(ms.in_layout(vectors, ["match_id"]))
    rows = ms.feature_vector(test)
    p = [m.transform(rows).select("match_id", vector_to_array("probability")[1].alias(c)) for m, c in ((found.model, "best"), (direct, "direct"))]
    return p[0].join(p[1], "match_id").agg(
        F.count("*").alias("holdout_rows"), F.max(F.abs(F.col("best") - F.col("direct"))).alias("moved"))


@query
def cv_fitted_mean_std(spark, sf):
    """Accuracies of five fitted folds as rows; mean and deviation of the tuner are those of the rows."""
    vectors, _ = _fold_vectors(spark, sf, 5)
    folds, mean, std = ms.cross_val_folds(vectors, {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.2}, parallelism=5)
    acc = F.col("accuracy")
    return folds.agg(
        F.count("*").alias("folds"), F.sum("matches").alias("train_rows"), (F.abs(F.avg(acc) - mean) < 1e-12).alias("mean_fits"),
        (F.abs(F.stddev_pop(acc) - std) < 1e-12).alias("std_fits"), (F.min(acc) > 0.55).alias("useful"))


@query
def feature_importances(spark, sf):
    found = evaluation.feature_importances(spark, _fitted(spark, sf)[3].stages[-1])
    return found.agg(F.count_distinct("feature").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"),
                     (F.min("importance") >= 0).alias("none_negative"))


@query
def model_roundtrip_score(spark, sf):
    """How far probabilities move when a model is stored and read back: not at all."""
    _, test, _, boosted = _fitted(spark, sf)
    path = scratch_path(spark, "model")
    save_bundle(spark, ModelBundle(boosted, best_params=TREES), path)
    before, after = (evaluation.model_scorer(m)(test).select("match_id", F.col("p1").alias(c))
                     for m, c in ((boosted, "p_before"), (load_bundle(spark, path).model, "p_after")))
    return before.join(after, "match_id").agg(
        F.count("*").alias("holdout_rows"), F.max(F.abs(F.col("p_before") - F.col("p_after"))).alias("moved"))


@query
def stored_model_reused(spark, sf):
    """The second request reads the stored model and trains nothing."""
    _, test, forest, _ = _fitted(spark, sf)
    path, calls = scratch_path(spark, "model"), []

    def train():
        calls.append(1)
        return ModelBundle(forest, accuracy=0.5)
    load_or_train(spark, path, train)
    again = load_or_train(spark, path, train)
    return again.model.transform(test).agg(F.count("prediction").alias("holdout_rows"), F.lit(len(calls)).alias("trained"))


@query
def score_fixtures_model(spark, sf):
    """The forecast with a fitted model in place of the closed form: all points are dealt out."""
    past = _past(spark, sf)
    table = forecast(past, d.roster(spark), evaluation.model_scorer(_fitted(spark, sf)[3])).table
    return table.agg(F.count("*").alias("teams"), F.round(F.sum("expected_points")).alias("points"),
                     F.min("rank").alias("best"), F.max("rank").alias("last"))


@query
def observed_write(spark, sf):
    """Matches and training rows are written; their summaries come from the writes."""
    matches = d.stored_matches(spark, sf)
    converted = write_observed(matches, scratch_path(spark, "matches"), mt.conversion_metrics())
    rows = tr.training_rows(matches, d.START_SEASON)
    seen = write_observed(rows, scratch_path(spark, "training"), tr.label_metrics(), partition_by=())
    return spark.createDataFrame(
        [(converted["matches"], ",".join(map(str, converted["seasons"])), seen["rows"], len(rows.columns), seen["team1_wins"])],
        "matches bigint, seasons string, training_rows bigint, columns int, team1_wins bigint")


@query
def training_shape(spark, sf):
    """Rows and columns of the training data."""
    shape = tr.dataset_shape(tr.training_rows(d.stored_matches(spark, sf), d.START_SEASON))
    return spark.createDataFrame([shape], "rows bigint, columns int")


@query
def winner_fallback(spark, sf):
    """No candidate column is present; the column that names teams is found among the others."""
    balls = d.deliveries(spark, sf).drop("win_outcome").withColumnRenamed("match_won_by", "outcome_text")
    return mt.deliveries_to_matches(balls, d.DELIVERY_ORDER, fallback=True).select("match_id", "season", "team1", "team2", "winner")


# ---- scoring, standings, bracket --------------------------------------------

def _past(spark, sf):
    return history(d.stored_matches(spark, sf))


def _pairs(spark, past, rows=d.ROSTER):
    return st.round_robin(st.teams_present(d.roster(spark, rows), past.features))


def _scored(spark, past):
    return st.score_round_robin(d.roster(spark), past.features, past.records, scoring.linear_scorer)


def _forecast(spark, sf, legs=2):
    return forecast(_past(spark, sf), d.roster(spark), scoring.linear_scorer, legs)


@query
def matchup_features(spark, sf):
    past = _past(spark, sf)
    return scoring.matchup_features(_pairs(spark, past).drop("place1", "place2"), past.features, past.records)


@query
def match_prediction_toss(spark, sf):
    past = _past(spark, sf)
    fixtures_ = scoring.with_toss_scenarios(_pairs(spark, past).select("team1", "team2"))
    return scoring.predict_matches(fixtures_, past.features, past.records, scoring.linear_scorer)


@query
def fixtures_without_features(spark, sf):
    past = _past(spark, sf)
    pairs = st.round_robin(d.roster(spark, d.ROSTER_WITH_STRANGER))
    return scoring.fixtures_without_features(pairs, past.features)


@query
def round_robin_pairs(spark, sf):
    """Every pair of the teams seen in the matches, in name order."""
    teams = mt.team_universe(d.matches(spark, sf)).withColumn(
        "ord", F.substring("team", 8, 10).cast("int"))
    return st.round_robin(teams).select("team1", "team2")


@query
def standings_two_leg(spark, sf):
    return _forecast(spark, sf).standings


@query
def standings_single_leg(spark, sf):
    return _forecast(spark, sf, legs=1).standings


@query
def standings_qualification(spark, sf):
    return _forecast(spark, sf).table.select("rank", "team", "qualifies", "tier")


@query
def standings_share_of_max(spark, sf):
    return _forecast(spark, sf).table.select("team", "expected_points", "share_of_leader")


@query
def playoff_cutoff(spark, sf):
    return st.playoff_cutoff(_forecast(spark, sf).standings)


@query
def matchup_detail(spark, sf):
    return _forecast(spark, sf).detail


@query
def playoff_seeds_(spark, sf):
    return playoff_seeds(_forecast(spark, sf).standings)


@query
def playoff_bracket_(spark, sf):
    return _forecast(spark, sf).bracket


@query
def champion_prediction_(spark, sf):
    return _forecast(spark, sf).champion


@query
def team_comparison_pivot(spark, sf):
    return compare.team_comparison(_features(spark, sf), "NATION_7", "NATION_21")


@query
def league_teams_valid(spark, sf):
    known = mt.team_universe(d.matches(spark, sf))
    return st.teams_present(d.roster(spark, d.ROSTER_WITH_STRANGER), known)


@query
def league_teams_missing(spark, sf):
    known = mt.team_universe(d.matches(spark, sf))
    return st.teams_missing(d.roster(spark, d.ROSTER_WITH_STRANGER), known)


# ---- many leagues at once ---------------------------------------------------

LEAGUE = ("league",)


@query
def champions_by_league(spark, sf):
    return explore.champions(d.matches(spark, sf, LEAGUE), LEAGUE)


@query
def all_time_wins_by_league(spark, sf):
    return explore.all_time_wins(d.matches(spark, sf, LEAGUE), 3, LEAGUE)


@query
def leaderboard_by_league(spark, sf):
    features = tf.team_features(d.stored_matches(spark, sf, LEAGUE), keys=LEAGUE)
    return explore.win_rate_leaderboard(features, 3, LEAGUE).select("league", "team", "win_rate")


@query
def team_features_by_league(spark, sf):
    return tf.team_features(d.stored_matches(spark, sf, LEAGUE), keys=LEAGUE)


@query
def training_rows_by_league(spark, sf):
    return tr.training_rows(d.stored_matches(spark, sf, LEAGUE), d.START_SEASON, LEAGUE, keep=("match_id",))


def _league_forecast(spark, sf):
    m = d.stored_matches(spark, sf, LEAGUE)
    return forecast(history(m, LEAGUE), d.league_rosters(spark, m), scoring.linear_scorer, keys=LEAGUE)


@query
def standings_by_league(spark, sf):
    return _league_forecast(spark, sf).table


@query
def playoff_bracket_by_league(spark, sf):
    return _league_forecast(spark, sf).bracket


# ---- names ------------------------------------------------------------------

def _feed_names(spark, sf):
    return d.feed(spark, sf).select(F.explode(F.array("team1", "team2")).alias("raw"))


@query
def normalize_team_names(spark, sf):
    known = mt.team_universe(d.matches(spark, sf))
    return names.normalize_names(_feed_names(spark, sf), known, d.aliases(spark))


@query
def normalize_team_names_or_raw(spark, sf):
    known = mt.team_universe(d.matches(spark, sf))
    named = names.attach_canonical(d.feed(spark, sf), ["team1", "team2"], known, d.aliases(spark), or_raw=True)
    return named.select("endpoint_no", "page_no", "team1_name", "team2_name")


@query
def team_dim_lookup(spark, sf):
    return names.team_dim_lookup(mt.team_universe(d.matches(spark, sf)), d.team_dim(spark), "#FF6B1A")


@query
def resolve_roster(spark, sf):
    """Entries: exact names, names with a known word, repeats and a stranger."""
    entries = ["NATION_3", "The NATION_1 Club", "NATION_3", "Old NATION_2", "Real Madrid", "xNATION_7x", "NATI"]
    rows = list(enumerate(entries, 1))
    return names.resolve_roster(d.roster(spark, rows), mt.team_universe(d.matches(spark, sf)))


# ---- fixture feed -----------------------------------------------------------

@query
def feed_season_filter(spark, sf):
    return fixtures.season_filter(d.feed(spark, sf), d.FEED_SEASON)


@query
def feed_season_filter_keep_all(spark, sf):
    """No series names the season, so everything stays."""
    return fixtures.season_filter(d.feed(spark, sf), "1890")


@query
def feed_dedup(spark, sf):
    return fixtures.dedup_feed(fixtures.season_filter(d.feed(spark, sf), d.FEED_SEASON))


@query
def feed_status_buckets(spark, sf):
    return fixtures.with_status_buckets(d.feed(spark, sf)).select(
        "endpoint_no", "page_no", "completed", "upcoming", "live")


def _live(spark, sf, season_text=None):
    return live_feed(d.feed(spark, sf), _past(spark, sf), scoring.linear_scorer, d.aliases(spark), season_text)


@query
def completed_last20(spark, sf):
    return _live(spark, sf).completed.select("page_no", "team1_name", "team2_name", "winner_name", "date")


@query
def upcoming_predictions(spark, sf):
    return _live(spark, sf, d.FEED_SEASON).upcoming


def _stream(spark, paths, out):
    stream = feed_stream(spark, paths)
    start_feed_dedup(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return stream.schema


@query
def feed_stream_dedup(spark, sf):
    """Pages streamed in two landings, late fixtures first and early ones after; equals the batch operator."""
    out, root = scratch_path(spark, "feed-stream"), scratch_path(spark, "feed")
    for part in ("yr >= 1998", "yr < 1998"):
        paths = d.write_feed_pages(spark, sf, part, root)
        schema = _stream(spark, paths, out)
    return read_deduped(spark, f"{out}/rows", schema)


@query
def feed_stream_state(spark, sf):
    """The same landings, then the first again, through keyed state; equals the batch operator."""
    out, root = scratch_path(spark, "feed-state"), scratch_path(spark, "feed")
    for part in ("yr >= 1998", "yr < 1998", "yr >= 1998"):
        stream = feed_stream(spark, d.write_feed_pages(spark, sf, part, root))
        start_feed_state(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return read_deduped(spark, f"{out}/rows", stream.schema)


@query
def feed_stream_latest(spark, sf):
    """Every fixture lands as scheduled first and with its result later; the result shows."""
    out, root = scratch_path(spark, "feed-stream"), scratch_path(spark, "feed")
    for early in (True, False):
        paths = d.write_feed_pages(spark, sf, root=root, early=early, single_file=True)
        schema = _stream(spark, paths, out)
    compact_feed(spark, f"{out}/rows", schema)
    return read_latest(spark, f"{out}/rows", schema)


@query
def feed_bad_items(spark, sf):
    """Pages of several items with unreadable ones among them: what is read, and what is listed as bad."""
    pages = feed_source.read_pages(spark, d.write_bad_pages(spark, sf))
    read = feed_source.parse_feed(pages).select(F.lit("row").alias("problem"))
    bad = feed_source.bad_items(pages).select("problem")
    return read.union(bad).groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {name.rstrip("_"): fn for name, fn in QUERIES.items()}
