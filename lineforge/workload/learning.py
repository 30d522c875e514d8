"""Delivery model: features, moments, fit, scoring and incremental batches."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.plans import delivery, gold, silver
from lineforge.session import run_dir
from lineforge.sources.tables import overwrite_table
from lineforge.workload.models import seed_of, silver_of
from lineforge.workload.registry import query
from lineforge.workload.scans import fresh_database
from lineforge.workload.sql import FEATURES, PREDICTED, WEIGHTS, with_

def fact_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.fact_parts(silver_of(spark, sf_dir), silver.silver_status(seed_of(spark)))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.features(fact_of(spark, sf_dir))


FEATURE_COLUMNS = (
    "polExternalID", "transportMode", "orderType", "orderedQuantity", "orderEntryDate",
    "shippedPGIDate", "ArrivalDate", "DaysToShip", "DaysToDelivery", "transportModeCode",
    "orderTypeCode",
)


@query("ml_features", with_(FEATURES, f"select {', '.join(FEATURE_COLUMNS)} from features"))
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(spark, sf_dir).select(*FEATURE_COLUMNS)


def _moments_sql() -> str:
    terms = ("intercept", *delivery.FEATURES, delivery.LABEL)
    value = {t: f"coalesce(cast({t} as bigint), 0)" for t in terms} | {"intercept": "1"}
    rows = [
        f"select '{a}' as term_a, '{b}' as term_b, "
        f"cast(coalesce(sum({value[a]} * {value[b]}), 0) as bigint) as sum_ab "
        f"from features where DaysToDelivery is not null"
        for i, a in enumerate(terms)
        for b in terms[i:]
    ]
    return with_(FEATURES, " union all ".join(rows))


@query("ml_moments", _moments_sql())
def ml_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.moments(features_of(spark, sf_dir))


def _determinant(entries: list[list[str]]) -> str:
    """Leibniz sum over the entries of a small square matrix, as SQL."""
    terms = []
    for order in permutations(range(len(entries))):
        swaps = sum(a > b for i, a in enumerate(order) for b in order[i + 1 :])
        factors = " * ".join(entries[i][j] for i, j in enumerate(order))
        terms.append(f"{'-' if swaps % 2 else '+'} {factors}")
    return "(0 " + " ".join(terms) + ")"


def _least_squares_ctes(ctes: str = FEATURES, rows: str = "features") -> str:
    """Least squares by Cramer's rule on the covariances of features and label."""
    n = range(len(delivery.FEATURES))
    x = [f"cast(coalesce({name}, 0) as double)" for name in delivery.FEATURES]
    y = f"cast({delivery.LABEL} as double)"
    sums = [f"covar_pop({x[i]}, {x[j]}) as c{i}{j}" for i in n for j in n]
    sums += [f"covar_pop({x[i]}, {y}) as y{i}, avg({x[i]}) as m{i}" for i in n]
    matrix = [[f"c{i}{j}" for j in n] for i in n]
    solved = []
    for k in n:
        replaced = [[f"y{i}" if j == k else matrix[i][j] for j in n] for i in n]
        solved.append(f"{_determinant(replaced)} / {_determinant(matrix)} as w{k}")
    intercept = " - ".join(["my", *(f"w{k} * m{k}" for k in n)])
    return f"""{ctes},
sums as (select {', '.join(sums)}, avg({y}) as my from {rows}
  where {delivery.LABEL} is not null),
solved as (select *, {', '.join(solved)} from sums),
model as (select *, {intercept} as w from solved)"""


def _fit_sql() -> str:
    rows = ["select 'intercept' as term, round(w, 6) as weight from model"]
    rows += [
        f"select '{name}', round(w{k}, 6) from model" for k, name in enumerate(delivery.FEATURES)
    ]
    return with_(_least_squares_ctes(), " union all ".join(rows))


@query("ml_fit", _fit_sql())
def ml_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the model fitted on all rows with a label."""
    weights = delivery.coefficients(delivery.fit(features_of(spark, sf_dir)))
    rounded = [(term, round(weight, 6)) for term, weight in weights.items()]
    return spark.createDataFrame(rounded, "term string, weight double")


def _rounds_sql() -> str:
    """The rounds as a recursive query over one row of state, sums taken from the features."""
    terms = ("intercept", *delivery.FEATURES)
    value = {t: f"coalesce(cast({t} as double), 0)" for t in (*delivery.FEATURES, delivery.LABEL)} | {"intercept": "1.0"}
    n = range(len(terms))
    sums = [f"coalesce(sum({value[terms[i]]} * {value[terms[j]]}), 0) as s{i}{j}" for i in n for j in n]
    sums += [f"coalesce(sum({value[terms[i]]} * {value[delivery.LABEL]}), 0) as y{i}" for i in n]
    steps = []
    for i in n:
        # Weights before i were moved in this round already.
        now = " + ".join(f"{f'v{j}' if j < i else f'w{j}'} * s{i}{j}" for j in n)
        steps.append(f"case when s{i}{i} < 0.00001 then w{i} else w{i} - 0.5 * ({now} - y{i}) / s{i}{i} end as v{i}")
    start = ", ".join(f"cast({0.5 if i == 0 else 0} as double) as w{i}" for i in n)
    body = f"{FEATURES}, sums as (select {', '.join(sums)} from features where {delivery.LABEL} is not null)"
    rows = " union all ".join(f"select '{t}' as term, round(w{i}, 6) as weight from r where k = 20" for i, t in enumerate(terms))
    moved = "(select r.*, s.* from r, sums s where k < 20) as state"
    for i in n:
        moved = f"(select *, {steps[i]} from {moved}) as moved{i}"
    return f"""with recursive {body},
r as (select 0 as k, {start} union all
  select k + 1, {', '.join(f'v{i}' for i in n)} from {moved})
{rows}"""


@query("ml_fit_rounds", _rounds_sql())
def ml_fit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after twenty rounds of coordinate updates on all rows with a label."""
    weights = delivery.fit_rounds(features_of(spark, sf_dir))
    rounded = [(term, round(weight, 6)) for term, weight in weights.items()]
    return spark.createDataFrame(rounded, "term string, weight double")


def _fitted() -> str:
    return " + ".join(
        ["w", *(f"w{k} * coalesce({name}, 0)" for k, name in enumerate(delivery.FEATURES))]
    )


def _score_saved_sql() -> str:
    total = _fitted()
    return with_(
        _least_squares_ctes(),
        f"""select transportMode, orderType, count(*) as n_rows,
        round(avg({total}), 3) as mean_days from features, model group by 1, 2""",
    )


@query("ml_score_saved", _score_saved_sql())
def ml_score_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save, load, predict every feature row with the loaded model; means by category."""
    path = run_dir(spark, "delivery_model")
    rows = features_of(spark, sf_dir)
    delivery.save_model(delivery.fit(rows), path)
    scored = delivery.predictions(rows, delivery.load_model(path), "2024-01-31 01:20:32")
    return scored.groupBy("transportMode", "orderType").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("PredictedDaysForDelivery"), 3).alias("mean_days"),
    )


# Small enough to leave rows on the smallest given tables; the job's own is HOLDOUT_ROWS.
HELD_OUT = 100


def _train_sql() -> str:
    ctes = f"""{FEATURES},
    numbered as (select *, row_number() over
      (order by orderEntryDate desc nulls last, polExternalID desc) as n from features),
    parts as (select *, cast('0x' || substr(md5('42:' || polExternalID), 1, 8) as bigint) % 100 < 33
      as is_test from numbered where n > {HELD_OUT}),
    train as (select * from parts where not is_test)"""
    return with_(
        _least_squares_ctes(ctes, "train"),
        f"""select count(*) as n_test, round(sqrt(avg(({delivery.LABEL} - ({_fitted()}))
          * ({delivery.LABEL} - ({_fitted()})))), 4) as rmse
        from parts, model where is_test and {delivery.LABEL} is not null""",
    )


@query("ml_train_evaluate", _train_sql())
def ml_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout of the last ``HELD_OUT`` rows, split, fit on the train part, error on the test part."""
    _, scored = delivery.train_and_evaluate(features_of(spark, sf_dir), HELD_OUT)
    error = F.col(delivery.LABEL).cast("double") - F.col(delivery.PREDICTION).cast("double")
    return scored.agg(
        F.count("*").alias("n_test"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse")
    )


@query(
    "ml_score",
    with_(FEATURES, f'select polExternalID, {PREDICTED} as "PredictedDaysForDelivery" from features'),
)
def ml_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = delivery.predict(features_of(spark, sf_dir), WEIGHTS)
    return scored.select("polExternalID", "PredictedDaysForDelivery")


@query(
    "rmse",
    with_(
        f"""{FEATURES}, e as (select cast(DaysToDelivery as double) - cast({PREDICTED} as double) as e
        from features)""",
        "select round(sqrt(avg(e * e)), 9) as rmse from e",
    ),
)
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = delivery.predict(features_of(spark, sf_dir), WEIGHTS)
    return delivery.rmse(scored).select(F.round("rmse", 9).alias("rmse"))


@query(
    "align_predictions",
    with_(
        FEATURES,
        f"""select {PREDICTED} as "PredictedDaysForDelivery", polExternalID, transportMode,
        orderType, orderedQuantity, DaysToShip,
        '2024-01-31 01:20:32' as "Prediction_Datetime" from features""",
    ),
)
def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.predictions(features_of(spark, sf_dir), WEIGHTS, "2024-01-31 01:20:32")


# Lines shipped up to this day were scored the morning after; so were, out of turn,
# the emergency lines of any date.
FIRST_SCORED = "1999-12-31"
FIRST_SCORING = "2000-01-01 01:20:32"
SECOND_SCORING = "2002-01-01 01:20:32"

_SCORED = f"""{FEATURES}, scored as (
  select {PREDICTED} as "PredictedDaysForDelivery", polExternalID, transportMode, orderType,
    orderedQuantity, DaysToShip, '{FIRST_SCORING}' as "Prediction_Datetime"
  from features where shippedPGIDate <= date '{FIRST_SCORED}' or orderType = 'EMERGENCY'),
fresh as (
  select * from extracted where polexternalid not in (select polExternalID from scored)
    and shippedpgidate > (select max("Prediction_Datetime") from scored))"""


@dataclass(frozen=True)
class Scoring:
    """The fact table and the prediction table after the first scoring, both written."""

    fact: DataFrame
    scored: DataFrame
    path: str
    table: str
    database: str


def after_first_scoring(spark: SparkSession, sf_dir: str) -> Scoring:
    database, location = fresh_database(spark, "scoring")
    table = "deliveryprediction"

    def store(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        return overwrite_table(
            df,
            f"{location}/{name}",
            name,
            database,
            database_location=location,
            partition=partition,
        )

    fact = store(fact_of(spark, sf_dir), "factparts")
    rows = delivery.features(fact).filter(
        (F.col("shippedPGIDate") <= F.lit(FIRST_SCORED).cast("date"))
        | (F.col("orderType") == "EMERGENCY")
    )
    first = delivery.with_day(delivery.predictions(rows, WEIGHTS, FIRST_SCORING))
    scored = store(first, table, delivery.SCORED_DAY)
    return Scoring(fact, scored, f"{location}/{table}", table, database)


@query(
    "new_rows_to_score",
    with_(
        _SCORED,
        """select polexternalid as "polExternalID", transportmode as "transportMode",
        ordertype as "orderType", shippedpgidate as "shippedPGIDate" from fresh""",
    ),
    fixture=after_first_scoring,
)
def new_rows_to_score(spark: SparkSession, first: Scoring) -> DataFrame:
    rows = delivery.new_rows_to_score(first.fact, first.scored)
    return rows.select("polExternalID", "transportMode", "orderType", "shippedPGIDate")


@query(
    "batch_size",
    with_(_SCORED, "select count(*) as n_rows, count(*) = 0 as is_empty from fresh"),
    fixture=after_first_scoring,
)
def batch_size(spark: SparkSession, first: Scoring) -> DataFrame:
    return delivery.batch_size(delivery.new_rows_to_score(first.fact, first.scored))


@query(
    "score_append",
    with_(
        _SCORED,
        f"""select * from scored union all
        select {PREDICTED}, polExternalID, transportMode, orderType, orderedQuantity, DaysToShip,
          '{SECOND_SCORING}'
        from features where polExternalID in (select polexternalid from fresh)""",
    ),
    fixture=after_first_scoring,
)
def score_append(spark: SparkSession, first: Scoring) -> DataFrame:
    """The prediction table after a second scoring."""
    done = delivery.score_batch(
        first.fact, first.scored, WEIGHTS, first.path, first.table, first.database, SECOND_SCORING
    )
    return done.drop(delivery.SCORED_DAY)
