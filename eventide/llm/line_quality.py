"""Line-first cleaning with built-in expressions only: judge each line, remove failing lines, then judge the document.

A line (a ``\\n``-separated piece with a word) fails if one of these holds:

- punctuation: at least ``MARK_SHARE`` percent of its characters are marks of ``MARKS``;
- navigation: it has at least ``MIN_BARS`` menu separators and at least ``BAR_SHARE`` percent of its words are separators,
  or it is short and starts like a menu or a button;
- boilerplate: it has a phrase of ``BOILERPLATE``, or it equals an earlier line of the text.

The document is rejected if more than ``MAX_LOST`` percent of the characters of its lines are lost, or if the base rules
fail: too few words, or more than half of the words in three-word windows that the text repeats.

Cases: null and empty texts have no words, so the base rules reject them; texts are judged whole; repeated rows give
repeated results; only the key and the text are read, so other columns can't clash. Arrays of words and windows belong to
one text, so memory follows the longest text, not the table. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<>!_=~^{}[]\\"
MARK_SHARE, MIN_BARS, BAR_SHARE, MENU_CHARS, MAX_LOST = 10, 2, 25, 40, 40
MIN_WORDS, MAX_REPEATED = 50, 50

# How menus and buttons begin, and phrases of boilerplate (lower case).
MENU = ("home", "login", "log in", "sign in", "sign up", "register", "menu", "next", "previous", "back to", "skip to",
        "read more", "click here", "contact us", "about us", "share this", "search")
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
               "uses cookies", "enable javascript", "lorem ipsum", "powered by", "subscribe to our", "click here to")


def _count(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _with(value: Column, use) -> Column:
    """``use`` applied to a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(windows: Column) -> Column:
    """Words covered by three-word windows that occur at least twice; ``windows``: array of window hashes by place."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def twice(by_hash: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(by_hash, j)["h"] == x["h"], F.lit(False))
        hits = F.filter(by_hash, lambda x, j: F.coalesce((j > 0) & same(x, F.greatest(j - 1, F.lit(0))), F.lit(False)) | same(x, j + 1))
        return _with(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0).cast("bigint")).otherwise(_with(pairs, twice))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule that needs the line alone."""
    lower = F.lower(line)
    bars = _count(line, "|»›•")
    # a separator stands between words, so separators are compared with the spaces of the line
    navigation = (bars >= MIN_BARS) & (100 * bars >= BAR_SHARE * (_count(line, SPACES) + 1) / 2)
    short = (F.length(line) <= MENU_CHARS) & ~F.rtrim(line).rlike(r"[.!?…][\"'»”)]?$")
    menu = short & F.ltrim(lower).rlike(r"^(?:" + "|".join(MENU) + r")(?:[^\p{L}]|$)")
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(lower, F.lit(p))
    return (100 * _count(line, MARKS) >= MARK_SHARE * F.length(line)) | navigation | menu | phrase


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def _size(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))


def clean(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, ``text`` (as given), ``lines`` (with a word), ``kept_lines`` (distinct lines that pass, in order)."""
    rows = documents.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lines", _lines(F.col("text")))
    rows = rows.withColumn("first_lines", F.array_distinct("lines"))
    return rows.withColumn("kept_lines", F.filter("first_lines", lambda x: ~line_fails(x)))


def assess(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the base figures and verdict, ``kept``, lines and characters lost, and ``cleaned``, the text that is left."""
    rows = clean(documents, key, text).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select(
        key, "lines", "first_lines", "kept_lines", F.size("words").cast("bigint").alias("n_words"),
        F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
        ).alias("windows"),
        (F.length("text") - _count(F.col("text"), SPACES)).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        key, "n_words", "word_chars", "n_symbols", "kept_lines",
        (F.size("lines") - F.size("first_lines")).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("bigint").alias("n_lost_lines"),
        _size(F.col("lines")).alias("n_line_chars"),
        (_size(F.col("lines")) - _size(F.col("kept_lines"))).alias("n_lost_chars"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    lost = 100 * F.col("n_lost_chars") > MAX_LOST * F.col("n_line_chars")
    return rows.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~lost).alias("kept"), "n_lines", "n_lost_lines", "n_lost_chars",
        F.array_join("kept_lines", "\n").alias("cleaned"),
    )


def _sql_count(text: str, characters: str) -> str:
    plain = "".join("\\" + c if c in "[]\\^" else c for c in characters)
    return f"(length({text}) - length(regexp_replace({text}, '[{plain}]', '', 'g')))"


def oracle() -> str:
    """The same figures in DuckDB's SQL."""
    phrases = " or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    bars, marks = _sql_count("line", "|»›•"), _sql_count("line", MARKS)
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from dup) group by doc_id),
pieces as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from d),
lines as (select *, row_number() over (partition by doc_id, line order by place) > 1 as again from pieces where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (
  select doc_id, length(line) as size, again, again
    or 100 * {marks} >= {MARK_SHARE} * length(line)
    or ({bars} >= {MIN_BARS} and 100 * {bars} >= {BAR_SHARE} * (length(regexp_replace(line, '[^\x20\x09-\x0D]', '', 'g')) + 1) / 2.0)
    or (length(line) <= {MENU_CHARS} and not regexp_matches(rtrim(line, ' '), '[.!?…]["''»”)]?$') and regexp_matches(ltrim(lower(line), ' '), '^(?:{"|".join(MENU)})(?:[^\p{{L}}]|$)'))
    or {phrases} as fails
  from lines),
per as (select doc_id, count(*) as n_lines, count(*) filter (fails) as n_lost_lines, sum(size) as size, coalesce(sum(size) filter (fails), 0) as n_lost_chars,
  count(*) filter (again) as n_dup_lines from judged group by doc_id),
figures as (
  select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_lost_lines, 0)::bigint as n_lost_lines,
    coalesce(n_lost_chars, 0)::bigint as n_lost_chars, coalesce(size, 0) as size
  from d left join per on d.doc_id = per.doc_id left join rep on d.doc_id = rep.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lost_lines, n_lost_chars,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) and not 100 * n_lost_chars > {MAX_LOST} * size as kept
from figures
"""
