"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.profiles import Profile

#: Where lines end: what Python's splitlines breaks on.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
SENTENCES, SENTENCES_AND_CLAUSES = r"(?<=[.!?])(?U)\s+", r"(?<=[.!?;])(?U)\s+"


def collapse(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def words(c: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def normal_lines(c: Column) -> Column:
    """Lines with single blanks, without empty ones."""
    lines = F.split(F.replace(c, F.lit("\u00a0"), F.lit(" ")), LINE_ENDS)
    tidy = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.filter(tidy, lambda x: x != "")


def normalize(c: Column, strict: bool = False) -> Column:
    """Tidy text; blank text is null, or an error if strict."""
    lines = normal_lines(c)
    blank = F.raise_error(F.lit("the text is blank")) if strict else F.lit(None)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(blank.cast("string"))


def sentences(c: Column, pattern: str = SENTENCES_AND_CLAUSES) -> Column:
    """Stripped sentences, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def preview(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def pattern_words(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def clean_token(word: Column, lemma: Column, profile: Profile) -> tuple[Column, Column]:
    """(word, lemma) of a token in lower case; both null where the token is dropped: no word, too short, or a stop word that is not kept."""
    word, lemma = F.trim(F.lower(word)), F.trim(F.lower(F.coalesce(F.nullif(lemma, F.lit("")), word)))
    whole = f"^(?:{profile.token})$"
    stopped = (word.isin(*profile.stop) | lemma.isin(*profile.stop)) & ~(word.isin(*profile.keep) | lemma.isin(*profile.keep))
    kept = word.rlike(whole) & (F.length(word) >= 2) & ~stopped
    return F.when(kept, word), F.when(kept, F.when(lemma.rlike(whole), lemma).otherwise(word))


def markers(c: Column, profile: Profile) -> Column:
    """Names of the profile's markers that stand in a text, in the profile's order."""
    return F.array_compact(F.array(*[F.when(c.rlike("(?iuU)" + p), F.lit(name)) for name, p in profile.markers.items()]))


def skips(c: Column, profile: Profile) -> Column:
    out = F.lit(False)
    for prefix in profile.skip_prefixes:
        out = out | c.startswith(prefix)
    return out


def valid_input(c: Column, least: int = 20) -> Column:
    """The collapsed text; an error if it is too short to be judged."""
    tidy = collapse(c)
    return F.when(F.length(tidy) >= least, tidy).otherwise(F.raise_error(F.lit(f"the text has under {least} characters")).cast("string"))


def confidence_level(c: Column, names: tuple[str, str, str] = ("высокая", "средняя", "низкая")) -> Column:
    return F.when(c >= 0.75, names[0]).when(c >= 0.45, names[1]).otherwise(names[2])


def experiment_id(rate: Column, share: Column | None = None) -> Column:
    """lr_<rate>, and _data_<percent> where a share of the data is given."""
    name = F.concat(F.lit("lr_"), F.replace(F.format_string("%.0e", rate), F.lit("-"), F.lit("m")))
    return name if share is None else F.concat(name, F.lit("_data_"), (share * 100).cast("int").cast("string"))


def percent(c: Column, digits: int = 1) -> Column:
    """0.1234 as 12.3%."""
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def clamped_index(c: Column, n: int) -> Column:
    """A 1-based index in text form to a 0-based one within n; what is no number is the first."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(c.try_cast("int"), F.lit(1)) - 1))


#: Causes in the order of the rules, with what each says.
CAUSES = (
    ("шум в тексте", "обнаружены необычные или повреждённые символы"),
    ("короткий общий контекст", "в статье только %d слов"),
    ("междокументные ссылки", "текст активно ссылается на другие нормы и кодекс"),
    ("дисбаланс классов", "истинный класс представлен в train слабее медианного класса"),
    ("неоднозначность контекста", "лексика статьи подходит нескольким тематическим актам"),
)


def error_cause(text: Column, n: Column, class_count: Column, median_count: Column, profile: Profile) -> Column:
    """struct(cause, explanation): the first rule that holds."""
    low = F.lower(collapse(text))
    references = F.lit(0)
    for phrase in profile.references:
        references = references + low.contains(phrase).cast("int")
    rule = lambda k: F.struct(F.lit(CAUSES[k][0]).alias("cause"), (F.format_string(CAUSES[k][1], n) if "%" in CAUSES[k][1] else F.lit(CAUSES[k][1])).alias("explanation"))
    damaged = low.contains("�") | low.contains("\0")
    return F.when(damaged, rule(0)).when(n < 80, rule(1)).when(references >= 2, rule(2)).when(F.coalesce(class_count, F.lit(0)) < median_count, rule(3)).otherwise(rule(4))
