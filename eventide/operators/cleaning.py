"""Row filters, column projections and null handling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.definitions import KNOWN_FEATURES
from eventide.functions import columns as C
from eventide.operators.ordering import POSITION, exact_quantiles, global_positions

MIN_TRANSCRIPT = 100
MIN_ANALYZABLE = 500
REQUESTS_PER_BATCH = 10_000
RESPONSE_SCHEMA = (
    "features map<string,string>, qa_vs_prepared_summary string, most_notable_signal string, _bad string"
)
FEATURE_SCHEMA = "score double, evidence string, section string"


def reject_reason() -> Column:
    no_key = F.col("ticker").isNull() | (F.col("ticker") == "") | F.col("year").isNull() | F.col("quarter").isNull()
    short = F.col("transcript").isNull() | (F.length(C.stripped(F.col("transcript"))) < MIN_TRANSCRIPT)
    return F.when(no_key, "null_key").when(short, "empty").otherwise("kept")


def clean_transcripts(raw: DataFrame) -> DataFrame:
    return raw.where(reject_reason() == "kept")


def reject_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy(reject_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def last_quarters(df: DataFrame, n: int, today: dt.date) -> DataFrame:
    """The ``n`` quarters before the one ``today`` falls in."""
    now = today.year * 4 + (today.month - 1) // 3
    return df.where((F.col("year") * 4 + F.col("quarter") - 1).between(now - n, now - 1))


def year_range(df: DataFrame, spec: str) -> DataFrame:
    """``'2023'`` or ``'2023-2025'``, both ends included."""
    first, _, last = spec.partition("-")
    return df.where(F.col("year").between(int(first), int(last or first)))


def analyzable(df: DataFrame, text: str = "transcript") -> DataFrame:
    return df.where(F.length(text) >= MIN_ANALYZABLE)


def build_requests(
    work: DataFrame, instructions: str, order: list[str], batch: int = REQUESTS_PER_BATCH, **limits: int
) -> DataFrame:
    """(custom_id, prompt, batch_no) per transcript, ``batch`` requests to a batch."""
    prompt = F.concat(
        F.format_string("Transcript of %s, quarter %d of %d:\n\n", "ticker", "quarter", "year"),
        C.truncate_middle(F.col("transcript"), **limits), F.lit("\n\n" + instructions),
    )
    # only the order columns go through the range sort; the texts join their number back
    numbered = global_positions(work.select(*order), order, "requests")
    return work.join(numbered, order).select(
        *[c for c in order if c not in ("ticker", "quarter", "year")],
        C.custom_id(F.col("ticker"), F.col("quarter"), F.col("year")).alias("custom_id"),
        prompt.alias("prompt"),
        (F.floor(F.col(POSITION) / batch) + 1).alias("batch_no"),
    )


def parse_responses(raw: DataFrame) -> DataFrame:
    """Response text to a features map; rows that are not JSON keep ``valid = false``."""
    body = C.unfenced(F.col("text"))
    parsed = raw.withColumn(
        "_json", F.from_json(body, RESPONSE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    )
    objects = F.map_filter(F.col("_json.features"), lambda k, v: v.startswith("{"))
    scores = F.transform_values(objects, lambda k, v: F.from_json(v, FEATURE_SCHEMA))
    valid = F.col("_json").isNotNull() & F.col("_json._bad").isNull()
    return parsed.select(
        *raw.columns, valid.alias("valid"), F.when(valid, scores).alias("features"),
        F.when(valid, F.col("_json.most_notable_signal")).alias("most_notable_signal"),
    )


def explode_features(analysis: DataFrame, keys: list[str]) -> DataFrame:
    return analysis.select(*keys, F.explode("features").alias("feature", "v")).select(
        *keys, "feature", "v.score", "v.evidence", "v.section"
    )


def known_features(analysis: DataFrame, keys: list[str]) -> DataFrame:
    """One score column per known feature; invented extras are dropped."""
    return analysis.select(
        *keys, *[F.try_element_at("features", F.lit(f))["score"].alias(f"feat_{f}") for f in KNOWN_FEATURES]
    )


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def filing_keys(filings: DataFrame) -> DataFrame:
    """Upper-case ticker with the calendar quarter and year of the filing date."""
    ticker = resolve_column(filings, ["ticker", "symbol", "Ticker"])
    date = resolve_column(filings, ["filingDate", "filing_date", "date"])
    day = C.parsed_date(F.col(date))
    return filings.withColumns({
        "symbol": F.upper(F.col(ticker)), "quarter": F.quarter(day), "year": F.year(day), "filed_on": day,
    })


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, coverage): share of rows where the feature is present."""
    shares = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNotNull().cast("double")).alias("coverage"))
              for c in features]
    return df.agg(F.array(*shares).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def covered_features(df: DataFrame, features: list[str], share: float = 0.5) -> list[str]:
    """Features present in strictly more than ``share`` of the rows, in the given order."""
    kept = {r["feature"] for r in coverage(df, features).where(F.col("coverage") > share).collect()}
    return [f for f in features if f in kept]


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "value")
    rows = exact_quantiles(long, ["feature"], "value", {"median": 0.5}).collect()  # one per feature
    return {r["feature"]: r["median"] for r in rows}


def with_gaps(df: DataFrame, features: list[str]) -> list[str]:
    """Features that have a missing value, which is NULL or NaN."""
    gaps = [F.max((F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("int")).alias(f"_g{i}") for i, f in enumerate(features)]
    found = df.agg(*gaps).first() if gaps else []
    return [f for f, gap in zip(features, found) if gap]


def median_impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values become the exact column median, which is only worked out where values are missing."""
    gaps = with_gaps(df, features)
    return df.fillna({f: m for f, m in medians(df, gaps).items() if m is not None}) if gaps else df


def sanitize(df: DataFrame) -> DataFrame:
    return df.select(*[
        C.finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def redact_samples(samples: DataFrame) -> DataFrame:
    """Drop the quoted evidence from the nested samples of every feature."""
    return samples.withColumn("samples", F.transform("samples", lambda s: s.dropFields("evidence")))


def prune_weights(weights: DataFrame, eps: float, column: str = "weight") -> DataFrame:
    return weights.where(F.abs(column) > eps)
