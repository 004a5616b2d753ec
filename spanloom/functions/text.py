"""Text and token expressions. All are Column to Column and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters other than tab, newline and return; private-use characters.
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
ICONS = r"[\x{F000}-\x{F8FF}]"
BLANK = r"(?U)^\s*$"
PUNCT = "[!-/:-@\\[-`{-~]"
ACCENTS = "[áàâãéêíóôõúç]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for a row, however often use refers to it.

    The optimiser puts a projected column's expression wherever the column is named, in lambdas too, where it
    would be evaluated for each element; a lambda's own variable it leaves alone.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between spaces, tabs and line ends; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), "")


def clean(text: Column) -> Column:
    """Icons become bullets, control characters go, and what is blank then becomes ''."""
    out = F.regexp_replace(F.regexp_replace(text, ICONS, "•"), CONTROL, "")
    return F.when(out.rlike(BLANK), "").otherwise(out)


def is_problematic(token: Column) -> Column:
    """Blank tokens, and tokens with control or private-use characters."""
    return token.isNull() | token.rlike(BLANK) | token.rlike(CONTROL) | token.rlike(PRIVATE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal(text: Column) -> Column:
    """Stripped, spaces joined, lower case."""
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def strict(text: Column) -> Column:
    """Stripped and lower case; null and blank are ''."""
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def shape(word: Column) -> Column:
    """Letters as x or X, digits as 9, other characters as they are."""
    out = F.regexp_replace(word, r"\p{IsLowercase}", "x")
    out = F.regexp_replace(out, r"\p{IsUppercase}", "X")
    return F.regexp_replace(out, r"[\p{Nd}²³¹]", "9")


def short_shape(word: Column) -> Column:
    """The shape with runs of one character as one."""
    return F.regexp_replace(shape(word), r"(?s)(.)\1+", "$1")


def count_of(word: Column, pattern: str) -> Column:
    return F.length(word) - F.length(F.regexp_replace(word, pattern, ""))


def word_flags(word: Column) -> dict[str, Column]:
    upper, lower = word.rlike(r"\p{IsUppercase}"), word.rlike(r"\p{IsLowercase}")
    return {
        "word_lower": F.lower(word),
        "is_upper": upper & ~lower,
        "is_title": upper & ~word.rlike(r"(?U)(\p{L}\p{IsUppercase}|(^|\P{L})\p{IsLowercase})"),
        "is_digit": word.rlike(r"^[\p{Nd}²³¹]+$"),
        "is_alpha": word.rlike(r"^\p{L}+$"),
        "word_length": F.length(word).cast("long"),
    }


def character_features(word: Column) -> dict[str, Column]:
    return {
        "num_uppercase": count_of(word, r"\p{IsUppercase}").cast("long"),
        "num_lowercase": count_of(word, r"\p{IsLowercase}").cast("long"),
        "num_digits": count_of(word, r"[\p{Nd}²³¹]").cast("long"),
        "num_punct": count_of(word, PUNCT).cast("long"),
        "has_hyphen": F.contains(word, F.lit("-")),
        "has_apostrophe": F.contains(word, F.lit("'")),
        "has_accent": F.lower(word).rlike(ACCENTS),
        "starts_with_upper": word.rlike(r"^\p{IsUppercase}"),
        "ends_with_punct": word.rlike(PUNCT + r"\z"),
    }


def affixes(word: Column, longest: int = 4) -> dict[str, Column]:
    """prefix_n and suffix_n in lower case, null where the word is shorter than n."""
    low = F.lower(word)
    out = {}
    for n in range(1, longest + 1):
        out[f"prefix_{n}"] = F.when(F.length(word) >= n, F.left(low, F.lit(n)))
        out[f"suffix_{n}"] = F.when(F.length(word) >= n, F.right(low, F.lit(n)))
    return out


def linguistic(word: Column) -> dict[str, Column]:
    return {
        "lemma_like": F.lower(word),
        "ling_alpha": word.rlike(r"^\p{L}+$"),
        "ling_digit": word.rlike(r"^[\p{Nd}²³¹]+$"),
        "is_punct": word.rlike(f"^{PUNCT}*\\z"),
    }


def position_features(pos: Column, size: Column) -> dict[str, Column]:
    return {
        "position": pos.cast("long"),
        "relative_position": F.coalesce(F.try_divide(pos.cast("double"), size.cast("double")), F.lit(0.0)),
        "is_first": pos == 0,
        "is_last": pos == size - 1,
    }


def lexicon_flags(word: Column, lexicon: Mapping[str, Iterable[str]], endings: Iterable[str] = (), any_of: str | None = None) -> dict[str, Column]:
    """is_<name> for each list of lower-case words, ends_with_<ending>, and whether the word is in any list."""
    low = F.lower(word)
    out = {f"is_{k}": low.isin(sorted(v)) for k, v in lexicon.items()}
    out |= {f"ends_with_{e}": low.endswith(e) for e in endings}
    if any_of:
        out[any_of] = low.isin(sorted({w for v in lexicon.values() for w in v}))
    return out


def ids(words: Column, vocabulary: Column, unknown: int = 1) -> Column:
    """Ids of words by a map; those not in it get the unknown id."""
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(vocabulary, w), F.lit(unknown)))


def pad(values: Column, size: int, filler: Column) -> Column:
    """Exactly `size` entries: cut, or filled up at the end."""
    return F.slice(F.concat(values, F.array_repeat(filler, size)), 1, size)


def char_ids(words: Column, vocabulary: Column, size: int = 20, unknown: int = 1, filler: int = 0) -> Column:
    """The ids of the first `size` lower-case characters of each word, filled up at the end."""
    chars = lambda w: F.filter(F.split(F.lower(w), ""), lambda c: c != "")
    return F.transform(words, lambda w: pad(ids(chars(w), vocabulary, unknown), size, F.lit(filler)))


def clamp(labels: Column, count: int, ignored: int = -100) -> Column:
    """Label ids within 0 and count - 1; the ignored id becomes 0."""
    return F.transform(labels, lambda x: F.when(x == ignored, 0).otherwise(F.greatest(F.lit(0), F.least(x, F.lit(count - 1)))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the word sets of two texts after normal(); 1 where both have none, 0 where one has none."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(normal(F.coalesce(c, F.lit(""))), " "), lambda t: t != ""))

    def share(s: Column) -> Column:
        both, every = F.size(F.array_intersect(s["x"], s["y"])).cast("double"), F.size(F.array_union(s["x"], s["y"]))
        return F.when(every == 0, 1.0).otherwise(both / every)

    return let(F.struct(words(a).alias("x"), words(b).alias("y")), share)
