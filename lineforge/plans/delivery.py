"""Delivery-time regression: features, moments, fit, scoring, incremental batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from lineforge.functions.categories import ORDER_TYPE_CODES, TRANSPORT_CODES, encode
from lineforge.functions.dates import PREDICTION_FORMAT, days_between, iso_date, stamp_text
from lineforge.operators.antijoin import not_in
from lineforge.operators.sampling import HOLDOUT_ROWS, holdout_head, split_train_test
from lineforge.plans.quality import drop_ship_after_arrival
from lineforge.session import run_dir
from lineforge.sources.files import write_parquet
from lineforge.sources.tables import append_table

FEATURES = ("transportModeCode", "orderTypeCode", "orderedQuantity", "DaysToShip")
LABEL = "DaysToDelivery"
PREDICTION = "PredictedDaysForDelivery"
SCORED_AT = "Prediction_Datetime"
SCORED_DAY = "scored_day"  # directory of the prediction table; not one of its rows' columns
OUTPUT = (
    PREDICTION,
    "polExternalID",
    "transportMode",
    "orderType",
    "orderedQuantity",
    "DaysToShip",
    SCORED_AT,
)


def extract(fact: DataFrame) -> DataFrame:
    """Lines that have a transport mode and an arrival date, with the columns in use."""
    return fact.filter(
        F.col("transportMode").isNotNull() & F.col("estimatedShipDate").isNotNull()
    ).select(
        F.col("polExternalID").alias("polExternalID"),
        F.col("transportMode").alias("transportMode"),
        F.col("orderType").alias("orderType"),
        F.col("orderEntryDate").alias("orderEntryDate"),
        F.col("orderedQuantity").alias("orderedQuantity"),
        F.col("shippedPGIDate").alias("shippedPGIDate"),
        F.col("carrierCode").alias("carrierCode"),
        F.col("estimatedShipDate").alias("ArrivalDate"),
    )


def prepare(extracted: DataFrame) -> DataFrame:
    """Dates parsed, impossible shipments removed, day counts and codes added."""
    dates = ("orderEntryDate", "shippedPGIDate", "ArrivalDate")
    parsed = extracted.withColumns({name: iso_date(F.col(name)) for name in dates})
    possible = drop_ship_after_arrival(parsed, "shippedPGIDate", "ArrivalDate")
    return possible.withColumns(
        {
            "DaysToShip": days_between(F.col("shippedPGIDate"), F.col("orderEntryDate")),
            LABEL: days_between(F.col("ArrivalDate"), F.col("orderEntryDate")),
            "transportModeCode": encode(F.col("transportMode"), TRANSPORT_CODES),
            "orderTypeCode": encode(F.col("orderType"), ORDER_TYPE_CODES),
        }
    )


def features(fact: DataFrame) -> DataFrame:
    return prepare(extract(fact))


def _filled(name: str) -> Column:
    """A missing feature adds nothing to a linear model."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def moments(df: DataFrame) -> DataFrame:
    """Sums of products of every pair of intercept, features and label.

    All a linear fit depends on, in one aggregate of fixed width; integers, so
    sums are exact and do not depend on the order of rows.
    """
    terms = {"intercept": F.lit(1).cast("bigint")}
    for name in (*FEATURES, LABEL):
        terms[name] = F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.filter(F.col(LABEL).isNotNull()).agg(
        *(F.coalesce(F.sum(terms[a] * terms[b]), F.lit(0)).alias(f"s{i}") for i, (a, b) in enumerate(pairs))
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(a).alias("term_a"), F.lit(b).alias("term_b"), F.col(f"s{i}").alias("sum_ab")
            )
            for i, (a, b) in enumerate(pairs)
        )
    )
    return sums.select(F.inline(rows))


def _assembly() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{n}_x" for n in FEATURES], outputCol="x")


def _with_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{name}_x": _filled(name) for name in FEATURES})


def fit(train: DataFrame) -> PipelineModel:
    """Least squares on the four features; rows without a label are left out.

    Rows alike in features and label are counted first, combined per task, and the
    count becomes the weight: the solution is the same, and the solver's passes run
    over the distinct rows only. The normal-equation solver moves nothing but sums
    of products.
    """
    labelled = train.filter(F.col(LABEL).isNotNull())
    distinct = labelled.groupBy(*FEATURES, LABEL).agg(F.count("*").alias("n"))
    weighted = _with_inputs(distinct).select(
        *(f"{name}_x" for name in FEATURES),
        F.col(LABEL).cast("double").alias("y"),
        F.col("n").cast("double").alias("weight"),
    )
    regression = LinearRegression(
        featuresCol="x",
        labelCol="y",
        weightCol="weight",
        predictionCol=PREDICTION,
        regParam=0.0,
        solver="normal",
    )
    weighted = weighted.persist()
    try:
        return Pipeline(stages=[_assembly(), regression]).fit(weighted)
    finally:
        weighted.unpersist()


# The linear booster's defaults and the job's number of rounds.
ROUNDS, LEARNING_RATE, BASE_SCORE = 20, 0.5, 0.5


def fit_rounds(
    train: DataFrame,
    rounds: int = ROUNDS,
    eta: float = LEARNING_RATE,
    l2: float = 0.0,
    l1: float = 0.0,
) -> dict[str, float]:
    """Weights after ``rounds`` rounds of coordinate updates on the squared error.

    A round moves the intercept, then each feature in turn, by ``eta`` times the step that
    minimises the penalised error along it; ``l2`` and ``l1`` count per row. A missing
    feature is 0. Every step follows from the sums of products in ``moments``, one pass
    over the rows whatever the number of rounds. Without rows all weights are 0. The
    result serves ``predict`` in place of a fitted pipeline; its intercept includes the
    score that the rounds start from.
    """
    sums: dict[tuple[str, str], float] = {}
    # One row with the sums of all pairs, 21 of them, is all that reaches the driver.
    pairs = moments(train).agg(F.collect_list(F.struct("term_a", "term_b", "sum_ab")).alias("pairs")).first()
    for a, b, total in pairs["pairs"]:
        sums[a, b] = sums[b, a] = float(total)
    n = sums["intercept", "intercept"]
    weights = dict.fromkeys(("intercept", *FEATURES), 0.0)
    weights["intercept"] = BASE_SCORE

    def slope(term: str) -> float:
        """Half the derivative of the squared error by a weight."""
        return sum(w * sums[term, other] for other, w in weights.items()) - sums[term, LABEL]

    for _ in range(rounds if n else 0):
        weights["intercept"] -= eta * slope("intercept") / n
        for name in FEATURES:
            curve, weight = sums[name, name], weights[name]
            if curve < 1e-5:
                continue
            pull, bend = slope(name) + l2 * n * weight, curve + l2 * n
            # A step doesn't cross zero while the penalty on absolute values holds it there.
            if weight - pull / bend >= 0:
                step = max(-(pull + l1 * n) / bend, -weight)
            else:
                step = min(-(pull - l1 * n) / bend, -weight)
            weights[name] = weight + eta * step
    return weights


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficients(model: PipelineModel) -> dict[str, float]:
    regression = model.stages[-1]
    return {
        "intercept": float(regression.intercept),
        **{n: float(c) for n, c in zip(FEATURES, regression.coefficients)},
    }


def linear(weights: Mapping[str, float]) -> Column:
    """A fitted model as a plain expression, which stays in generated code."""
    total = F.lit(float(weights["intercept"]))
    for name in FEATURES:
        total = total + F.lit(float(weights[name])) * _filled(name)
    return total


def predict(df: DataFrame, model: PipelineModel | Mapping[str, float]) -> DataFrame:
    """Every row with its prediction; rows are never split off, so none is realigned."""
    if isinstance(model, PipelineModel):
        scored = model.transform(_with_inputs(df)).drop("x", *(f"{n}_x" for n in FEATURES))
    else:
        scored = df.withColumn(PREDICTION, linear(model))
    return scored.withColumn(PREDICTION, F.col(PREDICTION).cast("float"))


def rmse(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    return scored.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def train_and_evaluate(
    rows: DataFrame, holdout_rows: int = HOLDOUT_ROWS
) -> tuple[PipelineModel, DataFrame]:
    """Leave out the last rows by entry date, split the rest, fit, and score the test part.

    Returns the model and the test rows with their predictions. Entry dates may be
    missing; the key decides among equal dates.
    """
    head = holdout_head(rows, ("orderEntryDate", "polExternalID"), holdout_rows)
    train, test = split_train_test(head, "polExternalID")
    model = fit(train)
    return model, predict(test.filter(F.col(LABEL).isNotNull()), model)


def predictions(
    df: DataFrame, model: PipelineModel | Mapping[str, float], as_of: str | None = None
) -> DataFrame:
    """The prediction table's rows: text categories, not codes, and the scoring time."""
    stamped = predict(df, model).withColumn(SCORED_AT, stamp_text(as_of, 0, PREDICTION_FORMAT))
    return stamped.select(*OUTPUT)


def after_watermark(
    df: DataFrame, scored: DataFrame, moment: str, watermark: str, bootstrap: bool = False
) -> DataFrame:
    """Rows whose ``moment`` text is above the largest ``watermark`` text.

    Texts are compared, so a date is below every time of the same day. While
    ``scored`` is empty nothing is selected, unless ``bootstrap`` lets all rows pass. Of a
    table laid out by day only the newest day is read.
    """
    if SCORED_DAY in scored.columns:
        newest = scored.agg(F.max(SCORED_DAY)).scalar()
        scored = scored.filter(F.col(SCORED_DAY) == newest)
    latest = scored.agg(F.max(watermark)).scalar()
    newer = F.col(moment) > latest
    return df.filter(newer | latest.isNull() if bootstrap else newer)


def new_rows_to_score(
    fact: DataFrame, scored: DataFrame, bootstrap: bool = False
) -> DataFrame:
    """Lines not scored yet and shipped after the last scoring.

    The batch is cut down by the watermark first; see ``not_scored`` for the rest.
    """
    recent = after_watermark(extract(fact), scored, "shippedPGIDate", SCORED_AT, bootstrap)
    return not_scored(recent, scored)


def not_scored(
    recent: DataFrame, scored: DataFrame, between: tuple[str | None, str | None] | None = None
) -> DataFrame:
    """Lines whose key is not in the prediction table.

    The prediction table only grows, so its keys are reduced to those of the batch before
    the anti join; a batch that is small at run time is broadcast for that, and the
    prediction table is not shuffled. With the batch's least and greatest key in
    ``between``, files of days whose keys all lie outside are passed over by their statistics.
    """
    batch_keys = recent.select("polExternalID").distinct()
    seen = scored.select("polExternalID")
    near = seen if between is None else seen.filter(F.col("polExternalID").between(*map(F.lit, between)))
    relevant = near.join(batch_keys, "polExternalID", "left_semi")
    return not_in(recent, relevant, "polExternalID", guard_on=scored)


def with_day(rows: DataFrame) -> DataFrame:
    """Predictions with the day of their scoring, by which their table is laid out."""
    return rows.withColumn(SCORED_DAY, F.substring(SCORED_AT, 1, 10))


def batch_size(df: DataFrame) -> DataFrame:
    """Number of rows to score and whether there is anything to do."""
    counted = df.agg(F.count("*").alias("n_rows"))
    return counted.withColumn("is_empty", F.col("n_rows") == 0)


def score_batch(
    fact: DataFrame,
    scored: DataFrame,
    model: PipelineModel | Mapping[str, float],
    path: str,
    table: str,
    database: str,
    as_of: str | None = None,
    bootstrap: bool = False,
) -> DataFrame:
    """Score what is new and append it; an empty batch appends nothing.

    Lines past the watermark are written aside first, so the fact table is scanned once.
    So is the scored batch: whether it is empty is then known without joining twice, and
    the append reads files rather than the table it appends to.
    """
    spark = fact.sparkSession
    past = after_watermark(extract(fact), scored, "shippedPGIDate", SCORED_AT, bootstrap)
    recent = write_parquet(past, run_dir(spark, "recent"))
    ends = recent.agg(F.min("polExternalID"), F.max("polExternalID")).first()
    batch = prepare(not_scored(recent, scored, tuple(ends)))
    rows = predictions(batch, model, as_of)
    rows = with_day(rows) if SCORED_DAY in scored.columns else rows
    fresh = write_parquet(rows, run_dir(spark, "scored"))
    if fresh.isEmpty():
        return scored
    return append_table(fresh, path, table, database)
