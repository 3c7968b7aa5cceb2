"""String columns: cleaning, tokenising, extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, P.CONTROL_CHARS, "")


def strict_clean(c: Column) -> Column:
    """Normalise whitespace and glue units and slashes; null becomes ''.

    After the second step every run of whitespace is one plain space, so the
    glue rules and the final trim only need to know about that space.
    """
    c = drop_control_chars(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, P.UNICODE_SPACE, " ")
    c = F.regexp_replace(c, r"(?<=\p{Nd}) (?=[a-zA-Z])", "")
    c = F.regexp_replace(c, r"(?<=[a-zA-Z]) (?=/)", "")
    c = F.regexp_replace(c, r"(?<=/) (?=[a-zA-Z])", "")
    return F.trim(c)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends (``trim`` knows only the space)."""
    return F.trim(c, F.lit(P.SPACES))


def join_broken_lines(c: Column) -> Column:
    return F.regexp_replace(c, P.BROKEN_LINE, "$1$2")


def clause_number(c: Column) -> Column:
    found = F.regexp_extract(c, P.CLAUSE, 0)
    return F.when(found == "", F.lit(P.DEFAULT_CLAUSE)).otherwise(found)


def scrub_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, P.MARKUP_OPEN, ""), P.MARKUP_CLOSE, "")


def strip_option_prefix(c: Column) -> Column:
    return F.regexp_replace(c, P.OPTION_PREFIX, "")


def plain_speech(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, P.SPEECH_MARKS, ""), P.SPEECH_TAGS, "")


def rewritten_query(c: Column) -> Column:
    """A rewritten question arrives quoted: trim it, then drop the quotes."""
    return F.replace(strip(c), F.lit('"'), F.lit(""))


def session_title(c: Column) -> Column:
    return F.substring(c, 1, P.TITLE_CHARS)


def file_extension(filename: Column) -> Column:
    """Lower-cased last segment; a name without a dot yields the whole name."""
    return F.lower(F.element_at(F.split(filename, r"\."), -1))


def parser_route(ext: Column) -> Column:
    return (F.when(~ext.isin(*P.ALLOWED_EXTENSIONS), "rejected")
            .when(ext == "pdf", "pdf")
            .when(ext == "txt", "txt")
            .otherwise("other"))


def tokenize(c: Column, fn=None) -> Column:
    """Array of tokens: one per Han character, one per run of other letters or digits.

    ``fn`` swaps in another tokeniser (a pandas UDF over the column).
    """
    if fn is not None:
        return fn(c)
    return F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))


def nearby_parts(c: Column) -> Column:
    """(landmark, category) of a "what is near X" phrase; the phrase itself if it is none."""
    landmark = F.regexp_extract(c, P.NEARBY, 1)
    return F.struct(
        F.when(landmark == "", c).otherwise(landmark).alias("landmark"),
        F.when(landmark == "", c).otherwise(F.regexp_extract(c, P.NEARBY, 3)).alias("category"))


def weather_icon(c: Column) -> Column:
    return (F.when(c.contains("雨"), "rain")
            .when(c.contains("云") | c.contains("阴"), "cloud")
            .when(c.contains("雪"), "snow")
            .otherwise("sun"))


def forecast_icon(c: Column) -> Column:
    return F.when(c.contains("晴"), "sun").when(c.contains("雨"), "rain").otherwise("cloud")


def keyword_bucket(c: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """First matching rule wins; a rule matches when any of its words occurs."""
    out = None
    for words, label in rules:
        hit = c.contains(words[0])
        for w in words[1:]:
            hit = hit | c.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def tool_label(tool: Column) -> Column:
    return (F.when(tool.contains("route"), "route")
            .when(tool.contains("nearby"), "nearby")
            .when(tool.contains("weather"), "weather")
            .otherwise(""))


def cited_numbers(c: Column) -> Column:
    """1-based source numbers cited in an answer, in order of appearance.

    Wide digits count as digits; a number that is no int is null.
    """
    return F.transform(F.regexp_extract_all(c, F.lit(P.CITATION), F.lit(1)),
                       lambda n: F.translate(n, "０１２３４５６７８９", "0123456789").try_cast("int"))


def numbered_source(i: Column, text: Column) -> Column:
    return F.concat(F.lit("[资料"), i.cast("string"), F.lit("]: "), text)


def triple_line(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -"), relation, F.lit("-> "), target)


def speaker_line(role: Column, content: Column) -> Column:
    label = F.when(role == "user", P.USER_LABEL).otherwise(P.AI_LABEL)
    return F.concat(label, F.lit(": "), content)
