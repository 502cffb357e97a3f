"""Queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import text as X
from eventide.operators import documents, lexicons
from eventide.plans.oracle_tables import sql
from eventide.plans.registry import query
from eventide.sources import warehouse as wh

# The given documents are invented prose, so frequent words stand in for the word lists.
LEXICONS = {"hedging": ["of the", "in", "is", "la"], "definitive": ["and", "to", "der"], "risk": ["that", "on", "with the", "que"]}
TERMS = ["the", "ion", "tion", "rewh", "of the", "eau", "ment", "den", "hea", "ora", "zu", "von", "st", "ein", "anon"]
MARKER = "the "


def spaced(terms: list[str]) -> str:
    """Alternation of the terms with two blanks between words and one around, the longer ones first."""
    return " (" + "|".join(t.replace(" ", "  ") for t in sorted(terms, key=lambda t: (-len(t) - t.count(" "), t))) + ") "


def norm(text: str) -> str:
    return f"(' ' || regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ')"


def n_hits(text: str, terms: list[str]) -> str:
    return f"len(regexp_extract_all({text}, '{spaced(terms)}'))"


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'))"


NORM = {"docs": f"select doc_id, text, {norm('text')} as t from documents"}


@query("lexicon_density", sql([], "select doc_id, words, lexicon, hits, round(case when words > 0 then hits * 1000e0 / words else 0 end, 6) as per_1000 from ("
       + " union all ".join(f"select doc_id, {n_words('t')} as words, '{k}' as lexicon, {n_hits('t', v)} as hits from docs" for k, v in LEXICONS.items()) + ") x", **NORM))
def q_density(spark, sf):
    out = documents.lexicon_density(wh.read(spark, sf, "documents"), ["doc_id"], "text", LEXICONS)
    return out.withColumn("per_1000", F.round("per_1000", 6))


OPENERS = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)"


@query("lexicon_table_density", sql(
    [], """
  select d.doc_id, d.words, d.lexicon, coalesce(h.hits, 0) as hits, round(case when d.words > 0 then coalesce(h.hits, 0) * 1000e0 / d.words else 0 end, 6) as per_1000
  from (select doc_id, len(u) as words, lexicon from tokens, (select distinct lexicon from terms) l) d
  left join (select doc_id, lexicon, count(*) as hits from (select doc_id, unnest(u) as term from tokens) t join terms using (term) group by 1, 2) h using (doc_id, lexicon)""",
    tokens="select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as u from documents",
    terms="select distinct lang as lexicon, regexp_extract(lower(text), '^[^\\p{L}\\p{N}]*([\\p{L}\\p{N}]+)', 1) as term from documents where regexp_matches(text, '[\\p{L}\\p{N}]')"))
def q_lexicon_table(spark, sf):
    """Density of every language's table of words that documents begin with, in all documents."""
    docs = wh.read(spark, sf, "documents")
    terms = docs.select(F.col("lang").alias("lexicon"), F.regexp_extract(F.lower("text"), OPENERS, 1).alias("term"))
    return lexicons.lexicon_density(docs, ["doc_id"], "text", terms).withColumn("per_1000", F.round("per_1000", 6))


@query("balance_score", sql([], f"""select doc_id, round(case when p + n > 0 then p / (1e0 * (p + n)) else 0.5e0 end, 6) as score
  from (select doc_id, {n_hits('t', LEXICONS['hedging'])} as p, {n_hits('t', LEXICONS['definitive'])} as n from docs) x""", **NORM))
def q_balance(spark, sf):
    t = X.normalised(F.col("text"))
    return wh.read(spark, sf, "documents").select(
        "doc_id", F.round(X.balance(t, LEXICONS["hedging"], LEXICONS["definitive"]), 6).alias("score"))


SPLIT = {
    "parts": f"""select doc_id, case when strpos(text, '{MARKER}') > 0 then left(text, strpos(text, '{MARKER}') - 1) else text end as prepared,
      case when strpos(text, '{MARKER}') > 0 then substr(text, strpos(text, '{MARKER}')) else '' end as qa from documents""",
}


@query("section_split", sql([], "select doc_id, length(prepared) as n_prepared, length(qa) as n_qa, md5(qa) as qa_digest from parts", **SPLIT))
def q_sections(spark, sf):
    prepared, qa = X.sections(F.col("text"), MARKER)
    return wh.read(spark, sf, "documents").select(
        "doc_id", F.length(prepared).cast("bigint").alias("n_prepared"), F.length(qa).cast("bigint").alias("n_qa"), F.md5(qa).alias("qa_digest"))


def _density(col: str) -> str:
    return f"case when {n_words(col)} > 0 then {n_hits(col, LEXICONS['risk'])} * 1000e0 / {n_words(col)} else 0e0 end"


@query("section_shift", sql([], "select doc_id, round(greatest(0, least(1, (dp - dq) / 1000)), 6) as shift from (select doc_id, "
       + _density("tp") + " as dp, " + _density("tq") + f" as dq from (select doc_id, {norm('prepared')} as tp, {norm('qa')} as tq from parts) y) x", **SPLIT))
def q_shift(spark, sf):
    return wh.read(spark, sf, "documents").select(
        "doc_id", F.round(X.section_shift(F.col("text"), MARKER, LEXICONS["risk"]), 6).alias("shift"))


_HAS = ", ".join(f"case when contains(t, ' {w.replace(' ', '  ')} ') then '{w}' end" for w in TERMS)


@query("novelty_vs_prior", sql(["transcripts"], """
  select ticker, quarter, year, len(terms) as n_terms, case when prior is not null then len(list_filter(terms, lambda x: not list_contains(prior, x))) end as n_new
  from (select *, lag(terms) over (partition by ticker order by year, quarter) as prior from firsts) z""",
    firsts=f"""select ticker, quarter, year, list_filter([{_HAS}], lambda x: x is not null) as terms from (
      select *, {norm('transcript')} as t, row_number() over (partition by ticker, quarter, year order by doc_id) as rn from transcripts) x where rn = 1"""))
def q_novelty(spark, sf):
    return documents.novelty_vs_prior(wh.transcripts(spark, sf), "ticker", "transcript", "doc_id", TERMS)


@query("specificity", sql([], f"""select doc_id, round(case when w > 0 then n * 100e0 / w else 0 end, 6) as specificity
  from (select doc_id, {n_words('t')} as w, len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*')) as n from docs) x""", **NORM))
def q_specificity(spark, sf):
    return wh.read(spark, sf, "documents").select("doc_id", F.round(X.specificity(F.col("text")), 6).alias("specificity"))


@query("turn_sections", sql([], f"""select conv_id, case role when 'user' then 'analyst' else 'management' end as side, count(*) as turns, sum({n_words('t')}) as words,
  sum({n_hits('t', LEXICONS['hedging'])}) as hedging from (select conv_id, role, {norm('text')} as t from conversations where role <> 'system') x group by 1, 2""",
    _none="select 1 as one"))
def q_turns(spark, sf):
    """Analyst and management turns of a dialogue, with their word counts and hedging hits."""
    t = X.normalised(F.col("text"))
    turns = wh.read(spark, sf, "conversations").where("role <> 'system'")
    side = F.when(F.col("role") == "user", "analyst").otherwise("management")
    return turns.groupBy("conv_id", side.alias("side")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(X.words(t)).alias("words"), F.sum(X.hits(t, LEXICONS["hedging"])).alias("hedging"))
