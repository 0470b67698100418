"""Row-wise string, number, date and array expressions.

Every function takes and returns a ``Column`` and stays inside the JVM, so the
same expression serves batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopword list the results have to agree with.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# The characters that count as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

DIGITS = r"[\p{Nd}²³¹⁰-⁹₀-₉]"
SPACE = r"(?U)\s+"
WORD = r"[\p{L}\p{N}_]{2,}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_decimal_comma(c) -> Column:
    """'12,5' -> 12.5."""
    return F.replace(_c(c), F.lit(","), F.lit(".")).cast("double")


def parse_yyyymmdd(c, strict: bool = True) -> Column:
    """Eight-digit date text; strict raises on bad text, lenient gives null."""
    return F.to_date(_c(c), "yyyyMMdd") if strict else F.try_to_date(_c(c), "yyyyMMdd")


def to_number_or_null(c) -> Column:
    return _c(c).try_cast("double")


def to_text(c) -> Column:
    """Text form; null becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def strip_ws(c) -> Column:
    """Remove any white space at both ends."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def trunc_int(c) -> Column:
    return _c(c).cast("bigint")


def first_token(c) -> Column:
    return F.split_part(_c(c), F.lit(" "), F.lit(1))


def date_parts(c) -> dict[str, Column]:
    """Year, month, weekday (Monday = 0) and quarter."""
    c = _c(c)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day_of_week": F.weekday(c),
        "quarter": F.quarter(c),
    }


def safe_ratio(num, den) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def round_half_even(c, digits: int = 4) -> Column:
    return F.bround(_c(c), digits)


def strip_digits(c) -> Column:
    return F.regexp_replace(_c(c), DIGITS, "")


def punct_to_space(c) -> Column:
    return F.regexp_replace(_c(c), r"\p{Punct}", " ")


def split_words(c) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(_c(c), SPACE), lambda w: w != "")


def _not_stopword(w: Column) -> Column:
    return ~w.isin(*STOPWORDS)


def _two_kinds_of_chars(w: Column) -> Column:
    return F.replace(w, F.substring(w, 1, 1), F.lit("")) != ""


def remove_stopwords(c) -> Column:
    return F.array_join(F.filter(split_words(c), _not_stopword), " ")


def drop_repeated_char_words(c) -> Column:
    """Drop words made of one character only, such as 'sss' or 'x'."""
    return F.array_join(F.filter(split_words(c), _two_kinds_of_chars), " ")


def drop_word(c, word: str = "unique") -> Column:
    return F.array_join(F.array_remove(split_words(c), word), " ")


def squeeze_spaces(c) -> Column:
    return F.array_join(split_words(c), " ")


def clean_text(c) -> Column:
    """Lower-case, no digits, no punctuation, no stopwords, no one-character
    words, no word 'unique', single spaces: one split and one filter pass."""
    words = split_words(punct_to_space(strip_digits(F.lower(to_text(c)))))
    keep = F.filter(
        words, lambda w: _not_stopword(w) & _two_kinds_of_chars(w) & (w != "unique")
    )
    return F.array_join(keep, " ")


def word_count(c) -> Column:
    return F.size(split_words(c))


def tokenize(c) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), 0)


def log1p(c) -> Column:
    """ln(1 + x); -inf at x = -1."""
    c = _c(c).cast("double")
    return F.when(c == -1.0, F.lit(float("-inf"))).otherwise(F.log1p(c))


def percent_to_fraction(c) -> Column:
    return _c(c) / F.lit(100.0)


def fraction_to_percent(c) -> Column:
    """0.29 -> 29; rounded before the cast so 0.29 does not become 28."""
    return F.round(_c(c) * 100).cast("int")


def parse_run_name(c) -> Column:
    """The part of a run file name from 'neighbors' on, without extension."""
    return F.regexp_extract(_c(c), r"(neighbors.*?)(?:\.\w+)?$", 1)


def run_param(c, name: str) -> Column:
    """The integer that follows ``name_`` in a run name."""
    return F.regexp_extract(_c(c), name + r"_(\d+)", 1).cast("int")


def parse_word_list(c) -> Column:
    """"['a', 'b']" -> array('a', 'b')."""
    parts = F.split(F.regexp_replace(_c(c), r"[\[\]']", ""), ",")
    return F.transform(parts, lambda w: F.trim(w))


def parse_params(c) -> Column:
    """Single-quoted dictionary text -> map<string,string>."""
    return F.from_json(F.replace(_c(c), F.lit("'"), F.lit('"')), "map<string,string>")


def bigrams(words) -> Column:
    """Each word joined with the next one."""
    w = _c(words)
    heads = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    return F.transform(heads, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
